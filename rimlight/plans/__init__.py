"""The questions a user asks, composed of the operators."""

from rimlight.plans.coverage import coverage_bands, coverage_table
from rimlight.plans.enrich import enrich_games, enrich_shots
from rimlight.plans.hexchart import hex_shot_chart
from rimlight.plans.zonetable import zone_table

__all__ = [
    "coverage_bands",
    "coverage_table",
    "enrich_games",
    "enrich_shots",
    "hex_shot_chart",
    "zone_table",
]
