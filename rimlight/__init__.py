"""Shot-streak and player-tracking analytics as PySpark DataFrame functions."""
