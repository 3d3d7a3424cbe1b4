"""SQL with the results of the registered queries, for DuckDB over the same Parquet tables."""

from __future__ import annotations

from rimlight.queries import PLAYER, SEASONS, STREAK

SEASON_LIST = ", ".join(f"'{s}'" for s in SEASONS)

# The adapters in SQL

EVENTS = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS shooter,
    strftime(date_trunc('week', ts), '%Y-%m-%d') AS slug_season, ts, event_id,
    CAST(event_id * 37 % 500 - 250 AS DOUBLE) AS location_x,
    CAST(event_id * 91 % 420 AS DOUBLE) AS location_y,
    value AS distance_shot,
    event_type IN ('click', 'purchase') AS is_shot_made,
    TRUE AS is_shot_attempted,
    CASE WHEN value > 50 THEN '3PT Field Goal' ELSE '2PT Field Goal' END AS type_shot,
    CASE WHEN value < 20 THEN 'Restricted Area' WHEN value < 50 THEN 'Mid-Range'
      WHEN value < 60 THEN 'Left Corner 3' WHEN value < 150 THEN 'Above the Break 3'
      ELSE 'Backcourt' END AS zone_basic,
    CASE WHEN value < 20 THEN 'Less Than 8 ft.' WHEN value < 40 THEN '8-16 ft.'
      WHEN value < 60 THEN '16-24 ft.' WHEN value < 150 THEN '24+ ft.'
      ELSE 'Back Court Shot' END AS zone_range,
    CASE event_id % 3 WHEN 0 THEN 'Center' WHEN 1 THEN 'Left Side' ELSE 'Right Side' END AS name_zone
  FROM events
), sh AS (
  SELECT *, location_x / 10 AS loc_x, location_y / 10 + 5.25 AS loc_y,
    CAST(is_shot_made AS INTEGER) AS made,
    CAST(is_shot_made AS INTEGER) * (CASE WHEN type_shot = '3PT Field Goal' THEN 3 ELSE 2 END) AS points,
    CAST(is_shot_made AS INTEGER) * (CASE WHEN zone_basic IN
      ('Above the Break 3', 'Backcourt', 'Left Corner 3', 'Right Corner 3') THEN 3 ELSE 2 END) AS zone_points
  FROM ev
)"""

# Runs as islands: equal results have a constant difference of the two row numbers.
STREAKS = EVENTS + """, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY shooter ORDER BY ts, event_id) AS rn,
    row_number() OVER (PARTITION BY shooter, is_shot_made ORDER BY ts, event_id) AS rm
  FROM sh
), runs AS (
  SELECT *, row_number() OVER (PARTITION BY shooter, is_shot_made, rn - rm ORDER BY rn) AS run
  FROM numbered
), previous AS (
  SELECT *, lag(run) OVER (PARTITION BY shooter ORDER BY rn) AS prev_run,
    lag(is_shot_made) OVER (PARTITION BY shooter ORDER BY rn) AS prev_made
  FROM runs
), ss AS (
  SELECT *, CASE WHEN prev_run IS NULL THEN NULL
      WHEN prev_run = 1 THEN CASE WHEN prev_made THEN '1 Make' ELSE '1 Miss' END
      ELSE CASE WHEN prev_run = 2 THEN '2' ELSE '3+' END || CASE WHEN prev_made THEN ' Makes' ELSE ' Misses' END
    END AS streak_col
  FROM previous
)"""

COVERED = STREAKS + """, cv AS (
  SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS game_id, event_id,
    coalesce(streak_col, '0') AS streak_col, shooter,
    'Team ' || CAST(event_id % 7 AS VARCHAR) AS shooter_team_name,
    type_shot, zone_basic, name_zone, zone_range, distance_shot, is_shot_attempted, is_shot_made,
    CASE event_id % 4 WHEN 0 THEN 'Wide Open' WHEN 1 THEN 'Open' WHEN 2 THEN 'Tight'
      ELSE 'Very Tight' END AS closest_defender_distance_bin,
    CASE WHEN event_id % 4 < 2 THEN 'Open' ELSE 'Tight' END AS coverage,
    CAST(is_shot_made AS INTEGER) AS fgm, 1 AS fga,
    CASE WHEN type_shot LIKE '%3PT%' THEN 1 ELSE 0 END AS three
  FROM ss
)"""

ORDER_SHOTS = """
os AS (
  SELECT 20000000 + o_orderkey // 40 AS game_id, o_orderkey AS event_id,
    'Supplier#' || lpad(CAST(o_orderkey % 97 AS VARCHAR), 9, '0') AS name_player,
    'Team ' || CAST(o_orderkey % 97 % 3 AS VARCHAR) AS name_team,
    CAST(o_orderkey % 5 * 60 + o_custkey % 60 AS INTEGER) AS shot_game_clock,
    o_orderpriority AS type_action,
    CASE WHEN o_totalprice > 250000 THEN '3PT Field Goal' ELSE '2PT Field Goal' END AS type_shot,
    CASE WHEN o_totalprice > 250000 THEN 'Above the Break 3' ELSE 'Mid-Range' END AS zone_basic,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Center' ELSE 'Left Side' END AS name_zone,
    CASE WHEN o_totalprice > 250000 THEN '24+ ft.' ELSE '8-16 ft.' END AS zone_range,
    floor(o_totalprice / 10000) AS distance_shot, TRUE AS is_shot_attempted,
    CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS is_shot_made,
    CASE o_orderkey % 4 WHEN 0 THEN '1 Make' WHEN 1 THEN '2 Misses' END AS streak_col
  FROM orders
), pl AS (
  SELECT s_suppkey AS player_id, s_name AS entity_name FROM supplier
)"""

_LINE_ENTITY = """
  SELECT CAST(CASE WHEN {player} = -1 THEN -1 ELSE ({player}) % 3 END AS BIGINT) AS team_id,
    CAST({player} AS BIGINT) AS player_id, CAST({x} AS DOUBLE) AS x_loc, CAST({y} AS DOUBLE) AS y_loc,
    CAST(0 AS DOUBLE) AS radius, l_quantity * 10 + l_linenumber * CAST(0.5 AS DOUBLE) AS game_clock,
    CASE WHEN l_returnflag <> 'N' THEN round(l_tax * 100) END AS shot_clock,
    CAST(1 + l_linenumber % 4 AS INTEGER) AS quarter,
    '00' || CAST(20000000 + l_orderkey // 40 AS VARCHAR) AS game_id, l_orderkey AS event_id,
    l_linenumber AS event_pos, CAST(l_partkey AS INTEGER) AS moment_pos,
    CAST(l_suppkey * 4 + {slot} AS INTEGER) AS entity_pos
  FROM lineitem"""
_BALL_X = "l_quantity * CAST(1.5 AS DOUBLE)"
_BALL_Y = "round(l_discount * 100)"

TRACKING = "tr AS (" + " UNION ALL ".join(
    _LINE_ENTITY.format(slot=slot, player=player, x=x, y=y)
    for slot, (player, x, y) in enumerate(
        [
            ("-1", _BALL_X, _BALL_Y),
            ("l_orderkey % 97", f"{_BALL_X} + l_partkey % 5 * CAST(0.6 AS DOUBLE)", _BALL_Y),
            ("l_suppkey", "l_partkey * 7 % 94", "l_suppkey * 3 % 50"),
            ("l_partkey % 61", f"{_BALL_X} + l_suppkey % 9", f"{_BALL_Y} + l_partkey % 4"),
        ]
    )
) + ")"

# Documents of orders: truncated for urgent orders, malformed for high-priority ones.
_LOG_ENTITY = """
  SELECT CAST(CASE WHEN {player} = -1 THEN -1 ELSE ({player}) % 3 END AS BIGINT) AS team_id,
    CAST({player} AS BIGINT) AS player_id, CAST({x} AS DOUBLE) AS x_loc, CAST({y} AS DOUBLE) AS y_loc,
    CAST(0 AS DOUBLE) AS radius,
    o_orderkey % 5 * 60 + o_custkey % 60 + 3 - CAST(1.5 AS DOUBLE) * n AS game_clock,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(24 - n - o_orderkey % 4 AS DOUBLE) END AS shot_clock,
    CAST(1 + o_orderkey % 4 AS INTEGER) AS quarter,
    '00' || CAST(20000000 + o_orderkey // 40 AS VARCHAR) AS game_id, o_orderkey AS event_id,
    0 AS event_pos, CAST(n AS INTEGER) AS moment_pos, {slot} AS entity_pos
  FROM orders, range(3) AS moments(n)
  WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"""

LOGS = "tr AS (" + " UNION ALL ".join(
    _LOG_ENTITY.format(slot=slot, player=player, x=x, y=y)
    for slot, (player, x, y) in enumerate(
        [
            ("-1", "o_orderkey * 3 % 90", "o_custkey * 7 % 48"),
            (
                "o_orderkey % 97",
                "o_orderkey * 3 % 90 + o_custkey % 3 + CAST(0.5 AS DOUBLE) * n",
                "o_custkey * 7 % 48",
            ),
            (
                "o_custkey % 89",
                "o_orderkey * 3 % 90 + o_custkey % 11 + n",
                "o_custkey * 7 % 48 + o_orderkey % 5",
            ),
            (
                "(o_orderkey + o_custkey) % 83",
                "o_orderkey * 3 % 90 + CAST(2.5 AS DOUBLE) * n",
                "o_custkey * 7 % 48 + o_custkey % 4",
            ),
        ]
    )
) + ")"

# Release frame and nearest opponent step by step over named rows
ENRICH = """, rt AS (
  SELECT t.* REPLACE (CAST(substr(t.game_id, 3) AS BIGINT) AS game_id,
      CASE WHEN t.x_loc > 47 THEN 94 - t.x_loc ELSE t.x_loc END AS x_loc),
    CASE WHEN t.player_id = -1 THEN 'Ball' ELSE p.entity_name END AS entity_name
  FROM tr t LEFT JOIN pl p ON t.player_id = p.player_id
), ball AS (
  SELECT game_id, event_id, game_clock, x_loc AS ball_x_loc, y_loc AS ball_y_loc
  FROM rt WHERE entity_name = 'Ball'
  QUALIFY row_number() OVER (PARTITION BY game_id, event_id, game_clock
    ORDER BY event_pos DESC, moment_pos DESC, entity_pos DESC) = 1
), cand AS (
  SELECT r.game_id, r.event_id, r.game_clock, r.quarter, s.name_player AS shooter, s.shot_game_clock,
    r.player_id AS shooter_id, r.team_id AS shooter_team_id, r.x_loc AS shooter_x_loc,
    r.y_loc AS shooter_y_loc, b.ball_x_loc, b.ball_y_loc, r.event_pos, r.moment_pos, r.entity_pos,
    sqrt((b.ball_x_loc - r.x_loc) * (b.ball_x_loc - r.x_loc)
      + (b.ball_y_loc - r.y_loc) * (b.ball_y_loc - r.y_loc)) AS dist_to_ball
  FROM rt r JOIN os s ON r.game_id = s.game_id AND r.event_id = s.event_id
    AND s.is_shot_made IS NOT NULL AND r.entity_name = s.name_player
  LEFT JOIN ball b ON b.game_id = r.game_id AND b.event_id = r.event_id AND b.game_clock = r.game_clock
  WHERE r.game_clock > s.shot_game_clock
), rel AS (
  SELECT * FROM cand WHERE dist_to_ball <= 1.75
  QUALIFY row_number() OVER (PARTITION BY game_id, event_id
    ORDER BY game_clock, event_pos DESC, moment_pos DESC, entity_pos DESC) = 1
), near AS (
  SELECT l.game_id, l.event_id, l.game_clock, l.shooter, r.entity_name AS closest_player,
    CASE WHEN l.shooter_team_id = r.team_id THEN 300
      ELSE sqrt((l.shooter_x_loc - r.x_loc) * (l.shooter_x_loc - r.x_loc)
        + (l.shooter_y_loc - r.y_loc) * (l.shooter_y_loc - r.y_loc)) END AS distance_to_shooter,
    r.event_pos, r.moment_pos, r.entity_pos
  FROM rel l JOIN rt r ON l.game_id = r.game_id AND l.event_id = r.event_id
    AND l.game_clock = r.game_clock AND l.quarter = r.quarter
  WHERE r.entity_name <> 'Ball' AND r.entity_name <> l.shooter
  QUALIFY row_number() OVER (PARTITION BY l.game_id, l.event_id ORDER BY distance_to_shooter,
    r.event_pos DESC, r.moment_pos DESC, r.entity_pos DESC) = 1
), nb AS (
  SELECT *, CASE WHEN distance_to_shooter >= 6 THEN 'Wide Open'
      WHEN distance_to_shooter BETWEEN 4 AND 6 THEN 'Open'
      WHEN distance_to_shooter BETWEEN 2 AND 4 THEN 'Tight'
      WHEN distance_to_shooter BETWEEN 0 AND 2 THEN 'Very Tight' END AS closest_defender_distance_bin
  FROM near
), en AS (
  SELECT n.game_id, n.event_id, coalesce(s.streak_col, '0') AS streak_col, n.shooter,
    s.name_team AS shooter_team_name, n.game_clock, s.type_action, s.type_shot, s.zone_basic,
    s.name_zone, s.zone_range, s.distance_shot, s.is_shot_attempted, s.is_shot_made,
    n.closest_player AS name_player, round(n.distance_to_shooter, 6) AS distance_to_shooter,
    n.closest_defender_distance_bin
  FROM nb n JOIN os s ON n.game_id = s.game_id AND n.event_id = s.event_id
), gated AS (
  SELECT * FROM en WHERE game_id IN (
    SELECT s.game_id FROM (SELECT game_id, count(*) AS n FROM os GROUP BY game_id) s
    JOIN (SELECT game_id, count(*) AS n FROM en GROUP BY game_id) e ON s.game_id = e.game_id
    WHERE s.n - e.n < 30)
)"""

ENRICHED = "WITH " + ORDER_SHOTS + ", " + TRACKING + ENRICH
INGESTED = "WITH " + ORDER_SHOTS + ", " + LOGS + ENRICH


def _lattice(anchor: str) -> str:
    """``cells``: rows ``s`` with the (x0, y0) of ``anchor`` and their cell."""
    return f""", anchored AS (
  SELECT s.*, {anchor}
), scaled AS (
  SELECT *, (loc_x - x0) / 1.5 AS u, (loc_y - y0) / (1.5 * sqrt(3)) AS v FROM anchored
), near_centres AS (
  SELECT *, CAST(floor(u + 0.5) AS BIGINT) AS j0, CAST(floor(v + 0.5) AS BIGINT) AS i0,
    CAST(floor(u) AS BIGINT) AS j1, CAST(floor(v) AS BIGINT) AS i1 FROM scaled
), chosen AS (
  SELECT *, (u - j0) * (u - j0) + 3 * (v - i0) * (v - i0)
    <= (u - j1 - 0.5) * (u - j1 - 0.5) + 3 * (v - i1 - 0.5) * (v - i1 - 0.5) AS on_first
  FROM near_centres
), cells AS (
  SELECT *, CASE WHEN on_first THEN 0 ELSE 1 END AS lat, CASE WHEN on_first THEN j0 ELSE j1 END AS j,
    CASE WHEN on_first THEN i0 ELSE i1 END AS i FROM chosen
)"""


LOWS = """floor(min(loc_x) / 1.5) * 1.5 - CAST(1e-6 AS DOUBLE) AS x0,
      floor(min(loc_y) / 1.5) * 1.5 - CAST(1e-6 AS DOUBLE) AS y0"""


def _own_lattice(source: str) -> str:
    return _lattice(
        f"""b.x0, b.y0 FROM {source} s JOIN (SELECT shooter, {LOWS}
    FROM {source} GROUP BY shooter) b ON s.shooter = b.shooter""",
    )


def _common_lattice(source: str) -> str:
    return _lattice(f"b.x0, b.y0 FROM {source} s, (SELECT {LOWS} FROM {source}) b")


HEX = "x0, y0, lat, j, i"
HEX6 = "round(x0, 6) AS x0, round(y0, 6) AS y0, lat, j, i"


def _stats(by: str = "") -> str:
    """``stats``: per cell the sums and the zone with most attempts."""
    return f""", counts AS (
  SELECT {by} {HEX}, zone_range, name_zone, count(*) AS attempts, sum(made) AS made, sum(points) AS points
  FROM cells GROUP BY {by} {HEX}, zone_range, name_zone
), per_cell AS (
  SELECT {by} {HEX}, count(*) AS hex_attempts, sum(made) AS hex_made, sum(points) AS hex_points
  FROM cells GROUP BY {by} {HEX}
), top_zone AS (
  SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY {by} {HEX}
    ORDER BY attempts DESC, zone_range, name_zone) = 1
), stats AS (
  SELECT t.* EXCLUDE (attempts, made, points), c.hex_attempts, c.hex_made, c.hex_points
  FROM top_zone t JOIN per_cell c USING ({by} {HEX})
)"""


CORNERS = """, offsets AS (
  SELECT * FROM (VALUES (0, 0.75, 1), (1, 0, 2), (2, -0.75, 1), (3, -0.75, -1), (4, 0, -2), (5, 0.75, -1))
    AS o(corner, dx, dy)
)"""
CENTER_X = "x0 + 1.5 * (j + lat / 2)"
CENTER_Y = "y0 + 1.5 * sqrt(3) * (i + lat / 2)"
DY = "dy * 1.5 / (2 * sqrt(3))"

ZONE = "zone_range, name_zone"
STREAK_RATES = """count(*) AS zone_attempts, sum(made) / count(*) AS zone_pct,
    CAST(sum(points) AS BIGINT) AS zone_points_scored, sum(points) / count(*) AS zone_points_per_shot"""
BASE_RATES = "sum(made) / count(*) AS league_pct, sum(zone_points) / count(*) AS league_pps"


def _r2(column: str) -> str:
    return f"CAST(round(CAST({column} AS DECIMAL(18, 6)), 2) AS DOUBLE)"


def _r4(column: str) -> str:
    return f"CAST(round(CAST({column} AS DECIMAL(18, 6)), 4) AS DOUBLE)"


def _r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


RANK = """CASE WHEN zone_range LIKE '%16-24%' THEN 18 WHEN regexp_matches(zone_range, '24+') THEN 24
      WHEN zone_range LIKE '%8-16%' THEN 12 WHEN zone_range LIKE '%Back Court%' THEN 40
      WHEN zone_range LIKE '%Less Than%' THEN 4 END"""


def _zones(scope: str, player: bool = False, seasons: bool = False) -> str:
    """``z``: zone rates after the streak joined null-safe to the base rates."""
    season = f"slug_season IN ({SEASON_LIST})" if seasons else "TRUE"
    own = f"shooter = '{PLAYER}'" if player else "TRUE"
    after = f"streak_col = '{STREAK}'"
    key = f"shooter, {ZONE}"
    if scope == "league":
        base = f"SELECT {ZONE}, {BASE_RATES} FROM ss WHERE {season} AND {after} GROUP BY {ZONE}"
        on = "TRUE"
    else:
        base = f"SELECT {key}, {BASE_RATES} FROM ss WHERE {season} AND {own} GROUP BY {key}"
        on = "a.shooter = b.shooter"
    return f""", z AS (
  SELECT a.*, b.league_pct, b.league_pps FROM (
    SELECT {key}, {STREAK_RATES} FROM ss WHERE {season} AND {own} AND {after} GROUP BY {key}) a
  LEFT JOIN ({base}) b ON {on} AND a.zone_range IS NOT DISTINCT FROM b.zone_range
    AND a.name_zone IS NOT DISTINCT FROM b.name_zone
)"""


LEAGUE_COLUMNS = f"""{ZONE}, {_r2('zone_pct')} AS zone_pct,
  {_r2('zone_points_per_shot')} AS zone_points_per_shot, {_r2('league_pps')} AS league_pps"""
SELF_COLUMNS = f"""{ZONE}, {_r2('zone_pct')} AS streak_fg_percent,
  {_r2('zone_points_per_shot')} AS zone_points_per_shot,
  round({_r2('zone_pct')} - {_r2('league_pct')}, 6) + 0.0 AS streak_diff"""


def _chart(scope: str, player: bool = False) -> str:
    own = f"AND shooter = '{PLAYER}'" if player else ""
    source = f", sel AS (SELECT * FROM ss WHERE streak_col = '{STREAK}' {own})"
    return f"""WITH {STREAKS}{source}{_own_lattice('sel')}{_stats('shooter,')}{_zones(scope, player)}{CORNERS},
joined AS (
  SELECT s.*, z.zone_pct, z.league_pct, z.zone_points_per_shot FROM stats s JOIN z
  ON s.shooter = z.shooter AND s.zone_range IS NOT DISTINCT FROM z.zone_range
    AND s.name_zone IS NOT DISTINCT FROM z.name_zone
), sized AS (
  SELECT j.*, 0.25 + 0.75 * ln(hex_attempts + 1) / ln(m.most + 1) AS radius_factor,
    {CENTER_X} AS cx, {CENTER_Y} AS cy
  FROM joined j JOIN (SELECT shooter, max(hex_attempts) AS most FROM joined GROUP BY shooter) m
    ON j.shooter = m.shooter
)
SELECT shooter, lat, j, i, {ZONE}, hex_attempts, corner, round(radius_factor, 6) AS radius_factor,
  round(-(cx + radius_factor * dx), 6) + 0.0 AS adj_x, round(cy + radius_factor * {DY}, 6) AS adj_y,
  round(least(greatest(zone_pct - league_pct, -0.15), 0.15), 6) + 0.0 AS bounded_fg_diff,
  round(least(greatest(zone_pct, 0.2), 0.7), 6) AS bounded_fg_pct,
  round(least(greatest(zone_points_per_shot, 0.5), 1.5), 6) AS bounded_points_per_shot
FROM sized, offsets"""


EFG = "(sum(fgm) + 0.5 * sum(three)) / sum(fga)"


def _efg(chosen: str) -> str:
    return f"""coalesce((sum(fgm) FILTER ({chosen}) + 0.5 * sum(three) FILTER ({chosen}))
      / sum(fga) FILTER ({chosen}), 0)"""


COVERAGE = f"""WITH {COVERED}, totals AS (
  SELECT shooter, count(*) AS total_fga, count(*) FILTER (coverage = 'Tight') / count(*) AS share
  FROM cv GROUP BY shooter
), teams AS (
  SELECT shooter, shooter_team_name FROM cv WHERE streak_col = '{STREAK}'
  QUALIFY row_number() OVER (PARTITION BY shooter ORDER BY game_id DESC, event_id DESC) = 1
), rates AS (
  SELECT shooter, count(*) AS streak_fga, {EFG} AS base_efg,
    {_efg("coverage = 'Open'")} AS open_efg, {_efg("coverage = 'Tight'")} AS tight_efg
  FROM cv WHERE streak_col = '{STREAK}' GROUP BY shooter
), coverage_rows AS (
  SELECT shooter_team_name, shooter, total_fga, streak_fga, {_r4('share')} AS percent_fga_tight,
    {_r4('base_efg')} AS base_streak_efg, {_r4('open_efg')} AS efg_open, {_r4('tight_efg')} AS efg_tight,
    {_r4('tight_efg - open_efg')} + 0.0 AS coverage_diff
  FROM rates JOIN totals USING (shooter) JOIN teams USING (shooter)
)"""


def _breaks(source: str, column: str) -> str:
    """``breaks``: exact percentiles, interpolated between neighbouring order statistics."""
    return f"""sorted AS (
  SELECT CAST({column} AS DOUBLE) AS x, row_number() OVER (ORDER BY {column}) AS r, count(*) OVER () AS n
  FROM {source} WHERE {column} IS NOT NULL
), places AS (
  SELECT k, 1 + CAST(n - 1 AS DOUBLE) * (k * CAST(0.01 AS DOUBLE)) AS place
  FROM range(101) AS steps(k), (SELECT max(n) AS n FROM sorted)
), breaks AS (
  SELECT CAST(k AS INTEGER) AS percent, CASE WHEN a.x = b.x THEN a.x
    ELSE (1 - (place - floor(place))) * a.x + (place - floor(place)) * b.x END AS breakpoint
  FROM places JOIN sorted a ON a.r = floor(place) JOIN sorted b ON b.r = ceil(place)
)"""


def _banded(source: str, column: str, keep: str) -> str:
    return f"""SELECT {keep}, (SELECT count(*) FROM breaks WHERE breakpoint < {column}) AS band FROM {source}"""


VISIBLE = r"""regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'gis')"""
LINKS = rf"""WITH tags AS (
  SELECT page_id, unnest(regexp_extract_all({VISIBLE}, '<a\s[^>]*>', 0, 'is')) AS tag,
    generate_subscripts(regexp_extract_all({VISIBLE}, '<a\s[^>]*>', 0, 'is'), 1) - 1 AS link_pos
  FROM pages
), quoted AS (
  SELECT page_id, CAST(link_pos AS INTEGER) AS link_pos,
    regexp_extract(tag, '\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1, 'is') AS q
  FROM tags
), links AS (
  SELECT page_id, link_pos, replace(replace(replace(replace(replace(
      regexp_replace(q, '^["'']|["'']$', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS href
  FROM quoted WHERE q <> ''
)"""

_PRIORITY_LOGS = """SELECT '00' || CAST(20000000 + o_orderkey // 40 AS VARCHAR) AS game_id, *
  FROM orders"""

ORACLE_SQL: dict[str, str] = {
    # Streaks and scans
    "streak_labels": f"WITH {STREAKS} SELECT event_id, shooter, coalesce(streak_col, '0') AS streak_col FROM ss",
    "streak_label_counts": f"""WITH {STREAKS} SELECT coalesce(streak_col, '0') AS streak_col,
        count(*) AS shots, count(*) FILTER (is_shot_made) AS made FROM ss GROUP BY 1""",
    "selector_values": f"WITH {EVENTS} SELECT DISTINCT shooter, slug_season FROM ev",
    "selector_seasons": f"WITH {EVENTS} SELECT DISTINCT slug_season FROM ev",
    "player_streak_scan": f"""WITH {STREAKS} SELECT location_x, location_y, distance_shot, is_shot_made,
        is_shot_attempted, type_shot, zone_range, name_zone FROM ss
        WHERE shooter = '{PLAYER}' AND slug_season IN ({SEASON_LIST}) AND streak_col = '{STREAK}'""",
    "league_streak_scan": f"""WITH {STREAKS} SELECT is_shot_attempted, is_shot_made, zone_basic, zone_range,
        name_zone FROM ss WHERE slug_season IN ({SEASON_LIST}) AND streak_col = '{STREAK}'""",
    "season_table_scan": f"""WITH {STREAKS} SELECT is_shot_attempted, is_shot_made, zone_basic, zone_range,
        name_zone FROM ss WHERE slug_season IN ({SEASON_LIST}) AND streak_col = '{STREAK}'""",
    "player_base_scan": f"""WITH {STREAKS} SELECT event_id, slug_season, is_shot_made, zone_basic, zone_range,
        name_zone FROM ss WHERE shooter = '{PLAYER}'""",
    "coverage_scan": f"""WITH {COVERED} SELECT shooter, shooter_team_name, streak_col, type_shot, zone_basic,
        name_zone, zone_range, distance_shot, is_shot_attempted, is_shot_made,
        closest_defender_distance_bin FROM cv WHERE streak_col = '{STREAK}'""",
    "totals_scan": f"WITH {COVERED} SELECT shooter, closest_defender_distance_bin, is_shot_attempted FROM cv",
    "active_players": """SELECT 'https://pictures.example/' || CAST(s_suppkey AS VARCHAR) AS urlPlayerHeadshot,
        s_name AS namePlayer FROM supplier WHERE 2005 + s_nationkey > 2014""",
    "result_diagnostics": f"""WITH {ORDER_SHOTS} SELECT name_team, count(*) AS shot_rows,
        count(*) FILTER (is_shot_made IS NULL) AS unknown_rows FROM os GROUP BY name_team""",
    # Expressions
    "shot_columns": f"""WITH {EVENTS} SELECT event_id, loc_x, loc_y, made AS shot_made_numeric,
        CASE WHEN is_shot_made THEN 'made' ELSE 'missed' END AS shot_made_flag, 1 AS shot_attempted_flag,
        CASE WHEN lower(type_shot) = '3pt field goal' THEN 3 ELSE 2 END AS type_value,
        CASE WHEN zone_basic IN ('Above the Break 3', 'Backcourt', 'Left Corner 3', 'Right Corner 3')
          THEN 3 ELSE 2 END AS zone_value, {RANK} AS zone_rank, type_shot LIKE '%3PT%' AS is_three FROM sh""",
    "tracking_columns": f"""WITH {ORDER_SHOTS}, {TRACKING}{ENRICH}, d AS (
        SELECT *, sqrt((x_loc - 5.25) * (x_loc - 5.25) + (y_loc - 25) * (y_loc - 25)) AS dist FROM rt)
      SELECT game_id, event_id, event_pos, moment_pos, entity_pos, entity_name AS name_player,
        round(x_loc, 6) AS x_loc, round(dist, 6) AS hoop_dist,
        CASE WHEN dist / 4 >= 6 THEN 'Wide Open' WHEN dist / 4 >= 4 THEN 'Open' WHEN dist / 4 >= 2 THEN 'Tight'
          ELSE 'Very Tight' END AS bin, CASE WHEN dist / 4 >= 4 THEN 'Open' ELSE 'Tight' END AS coverage FROM d""",
    "shot_clocks": f"""WITH {ORDER_SHOTS} SELECT event_id, shot_game_clock,
        coalesce(streak_col, '0') AS streak_col FROM os""",
    "number_columns": f"""SELECT event_id,
        {_r4('least(greatest(value / 100 - 1, CAST(-0.15 AS DOUBLE)), CAST(0.15 AS DOUBLE))')} AS bounded_diff,
        {_r4('value / nullif(event_id % 5, 0)')} AS safe_ratio,
        {_r4('floor(value / 1.5) * 1.5 - CAST(1e-6 AS DOUBLE)')} AS low_bound,
        {_r4('ceil(value / 1.5) * 1.5 + CAST(1e-6 AS DOUBLE)')} AS high_bound,
        {_r2('value / 7')} AS two_digits,
        {_r4('round(0.25 + 0.75 * ln(floor(value) + 1) / ln(501), 6)')} AS radius_factor FROM events""",
    # Zones
    "zone_vs_league": f"""WITH {STREAKS}{_zones('league')} SELECT shooter, {ZONE}, zone_attempts,
        zone_points_scored, {_r6('zone_pct', 'zone_points_per_shot', 'league_pct', 'league_pps')} FROM z""",
    "zone_rates": f"""WITH {EVENTS}, r AS (SELECT slug_season, {ZONE}, {STREAK_RATES} FROM sh
        GROUP BY slug_season, {ZONE}) SELECT slug_season, {ZONE}, zone_attempts, zone_points_scored,
        {_r6('zone_pct', 'zone_points_per_shot')} FROM r""",
    "base_zone_rates": f"""WITH {EVENTS}, r AS (SELECT slug_season, {ZONE}, {BASE_RATES} FROM sh
        GROUP BY slug_season, {ZONE}) SELECT slug_season, {ZONE}, {_r6('league_pct', 'league_pps')} FROM r""",
    "zone_table_league": f"WITH {STREAKS}{_zones('league', player=True)} SELECT {LEAGUE_COLUMNS} FROM z",
    "zone_table_self": f"WITH {STREAKS}{_zones('self', player=True)} SELECT {SELF_COLUMNS} FROM z",
    "zone_tables_league": f"""WITH {STREAKS}{_zones('league', seasons=True)}
        SELECT shooter, {LEAGUE_COLUMNS} FROM z""",
    "zone_tables_self": f"WITH {STREAKS}{_zones('self', seasons=True)} SELECT shooter, {SELF_COLUMNS} FROM z",
    # Hexagons
    "hex_cells": f"""WITH {EVENTS}{_own_lattice('sh')}
        SELECT shooter, {HEX6}, count(*) AS attempts FROM cells GROUP BY shooter, {HEX}""",
    "hex_cells_all": f"""WITH {EVENTS}{_common_lattice('sh')}{_stats()} SELECT {HEX6}, {ZONE}, hex_attempts,
        round(hex_made / hex_attempts, 6) AS hex_pct, CAST(hex_points AS BIGINT) AS hex_points_scored,
        round(hex_points / hex_attempts, 6) AS hex_points_per_shot FROM stats""",
    "hex_cells_fixed": f"""WITH {EVENTS}{_lattice('CAST(-25 AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0 FROM sh s')}
        SELECT {HEX}, {ZONE}, count(*) AS attempts, CAST(sum(made) AS BIGINT) AS made,
        CAST(sum(points) AS BIGINT) AS points FROM cells GROUP BY {HEX}, {ZONE}""",
    "hex_dominant_zone": f"""WITH {EVENTS}{_own_lattice('sh')}{_stats('shooter,')}
        SELECT shooter, {HEX6}, {ZONE} FROM stats""",
    "hex_corners": f"""WITH {EVENTS}{_common_lattice('sh')}{_stats()}{CORNERS}
        SELECT lat, j, i, corner, round({CENTER_X}, 6) + 0.0 AS center_x, round({CENTER_Y}, 6) + 0.0 AS center_y,
        round({CENTER_X} + dx, 6) + 0.0 AS x, round({CENTER_Y} + {DY}, 6) + 0.0 AS y FROM stats, offsets""",
    "hex_chart": _chart("league"),
    "hex_chart_self": _chart("self"),
    "hex_chart_player": _chart("league", player=True),
    "chart_rows": f"""WITH {STREAKS} SELECT shooter, {ZONE}, loc_x, loc_y, count(*) AS attempts,
        CAST(sum(made) AS BIGINT) AS made, CAST(sum(points) AS BIGINT) AS points FROM ss
        WHERE streak_col = '{STREAK}' GROUP BY shooter, {ZONE}, loc_x, loc_y""",
    # Coverage and percentiles
    "coverage_table": f"{COVERAGE} SELECT * FROM coverage_rows",
    "coverage_totals": f"""WITH {COVERED} SELECT shooter, count(*) AS total_fga,
        count(*) FILTER (coverage = 'Tight') AS total_tight_attempts,
        round(count(*) FILTER (coverage = 'Tight') / count(*), 6) AS percent_fga_tight FROM cv GROUP BY shooter""",
    "streak_efg": f"""WITH {COVERED} SELECT shooter, streak_col, CAST(sum(fgm) AS BIGINT) AS fgm,
        count(*) AS fga, CAST(sum(three) AS BIGINT) AS threes, round({EFG}, 6) AS base_streak_efg
        FROM cv WHERE streak_col = '{STREAK}' GROUP BY shooter, streak_col""",
    "coverage_efg": f"""WITH {COVERED} SELECT shooter, streak_col, coverage, CAST(sum(fgm) AS BIGINT) AS fgm,
        count(*) AS fga, CAST(sum(three) AS BIGINT) AS threes, round(sum(fgm) / count(*), 6) AS fg_percent,
        round({EFG}, 6) AS efg_percent
        FROM cv WHERE streak_col = '{STREAK}' GROUP BY shooter, streak_col, coverage""",
    "coverage_pivot": f"""WITH {COVERED} SELECT shooter,
        round({_efg("coverage = 'Open'")}, 6) AS efg_percent_open,
        round({_efg("coverage = 'Tight'")}, 6) AS efg_percent_tight,
        count(*) FILTER (coverage = 'Open') AS fga_open, count(*) FILTER (coverage = 'Tight') AS fga_tight
        FROM cv WHERE streak_col = '{STREAK}' GROUP BY shooter""",
    "shooter_teams": f"{COVERAGE} SELECT shooter, shooter_team_name FROM teams",
    "coverage_percentile_bands": f"""{COVERAGE}, {_breaks('coverage_rows', 'base_streak_efg')}
        {_banded('coverage_rows', 'base_streak_efg', 'shooter, base_streak_efg')}""",
    "percentile_breaks": f"""WITH {_breaks('events', 'value')}
        SELECT percent, round(breakpoint, 6) AS breakpoint FROM breaks""",
    "percentile_bands": f"WITH {_breaks('events', 'value')} {_banded('events', 'value', 'event_id, value')}",
    # Tracking
    "ball_positions": f"{ENRICHED} SELECT * FROM ball",
    "release_frame": f"""{ENRICHED} SELECT game_id, event_id, game_clock, quarter, shooter, shot_game_clock,
        shooter_id, shooter_team_id,
        {_r6('shooter_x_loc', 'shooter_y_loc', 'ball_x_loc', 'ball_y_loc', 'dist_to_ball')} FROM rel""",
    "nearest_opponent": f"""{ENRICHED} SELECT game_id, event_id, shooter, closest_player,
        {_r6('distance_to_shooter')}, closest_defender_distance_bin FROM nb""",
    "enriched_shots": f"{ENRICHED} SELECT * FROM en",
    "quality_gate": f"{ENRICHED} SELECT * FROM gated",
    "game_coverage": f"""WITH {ORDER_SHOTS} SELECT game_id, count(*) AS game_shots,
        count(*) FILTER (is_shot_made) AS enriched_shots, count(*) - count(*) FILTER (is_shot_made) < 30 AS kept
        FROM (SELECT * REPLACE (CAST(game_id AS VARCHAR) AS game_id) FROM os) GROUP BY game_id
        HAVING count(*) FILTER (is_shot_made) > 0""",
    # Ingest and storage
    "flatten_nested": f"WITH {LOGS} SELECT * FROM tr",
    "flatten_good_events": f"""WITH logs AS ({_PRIORITY_LOGS}) SELECT game_id,
        CAST(12 * count(*) FILTER (o_orderpriority <> '2-HIGH') AS BIGINT) AS entity_rows,
        count(*) FILTER (o_orderpriority <> '2-HIGH') AS game_events FROM logs
        WHERE o_orderpriority <> '1-URGENT' GROUP BY game_id HAVING game_events > 0""",
    "log_problems": f"""WITH logs AS ({_PRIORITY_LOGS}) SELECT
        CASE o_orderpriority WHEN '1-URGENT' THEN 'corrupt document' ELSE 'malformed event' END AS problem,
        CASE o_orderpriority WHEN '1-URGENT' THEN NULL ELSE game_id END AS game_id, count(*) AS documents
        FROM logs WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL""",
    "tracking_csv": f"""WITH {TRACKING} SELECT * REPLACE (round(x_loc, 6) AS x_loc, round(y_loc, 6) AS y_loc)
        FROM tr""",
    "enriched_sink": f"""WITH {COVERED} SELECT game_id, event_id, streak_col, shooter, type_shot,
        closest_defender_distance_bin FROM cv""",
    "ingest_games": f"{INGESTED} SELECT * FROM gated",
    "extract_links": rf"""{LINKS} SELECT page_id, link_pos, href, href AS url,
        list_extract(string_split(href, '/'), -1) AS base_name FROM links""",
    "extract_links_rewritten": rf"""{LINKS}, u AS (SELECT *, 'https://host.example' || replace(href, '/th', '') AS url
        FROM links WHERE contains(href, 'e')) SELECT page_id, link_pos, href, url,
        list_extract(string_split(string_split(url, 'er')[1], '/'), -1) AS base_name FROM u""",
    "union_filled": f"""WITH {EVENTS}, {ORDER_SHOTS.strip()}, u AS (
        SELECT event_id, shooter, zone_range, NULL AS name_team FROM ev
        UNION ALL SELECT event_id, NULL, zone_range, name_team FROM os)
      SELECT zone_range, count(event_id) AS event_id_rows, count(shooter) AS shooter_rows,
        count(name_team) AS name_team_rows FROM u GROUP BY zone_range""",
    "snake_names": """SELECT s_suppkey AS id_player, s_name AS name_player,
        CAST(2005 + s_nationkey AS INTEGER) AS year_season_last,
        'https://pictures.example/' || CAST(s_suppkey AS VARCHAR) AS url_player_headshot FROM supplier""",
}
# the same results by other paths
ORACLE_SQL["streak_labels_cut"] = ORACLE_SQL["streak_labels"]
ORACLE_SQL["streak_labels_batches"] = ORACLE_SQL["streak_labels"]
ORACLE_SQL["coverage_page"] = (
    ORACLE_SQL["coverage_table"] + " ORDER BY streak_fga DESC NULLS LAST, shooter NULLS LAST LIMIT 15 OFFSET 15"
)
for _same in ("zone_tables_league", "zone_tables_self", "coverage_table", "percentile_breaks"):
    ORACLE_SQL[f"{_same}_kept"] = ORACLE_SQL[_same]
# Streaks over all shots of the games that have a usable document.
ORACLE_SQL["ingest_carried_labels"] = f"""{INGESTED}, ks AS (
  SELECT game_id, event_id, name_player, is_shot_made FROM os
  WHERE is_shot_made IS NOT NULL AND '00' || CAST(game_id AS VARCHAR) IN (SELECT game_id FROM tr)
), nu AS (
  SELECT *, row_number() OVER (PARTITION BY name_player ORDER BY game_id, event_id) AS rn,
    row_number() OVER (PARTITION BY name_player, is_shot_made ORDER BY game_id, event_id) AS rm FROM ks
), ru AS (
  SELECT *, row_number() OVER (PARTITION BY name_player, is_shot_made, rn - rm ORDER BY rn) AS run FROM nu
), pr AS (
  SELECT game_id, event_id, lag(run) OVER (PARTITION BY name_player ORDER BY rn) AS run,
    lag(is_shot_made) OVER (PARTITION BY name_player ORDER BY rn) AS made FROM ru
)
SELECT g.* REPLACE (CASE WHEN p.run IS NULL THEN '0'
    WHEN p.run = 1 THEN CASE WHEN made THEN '1 Make' ELSE '1 Miss' END
    ELSE CASE WHEN p.run = 2 THEN '2' ELSE '3+' END || CASE WHEN made THEN ' Makes' ELSE ' Misses' END
  END AS streak_col)
FROM gated g JOIN pr p ON g.game_id = p.game_id AND g.event_id = p.event_id"""
ORACLE_SQL["ingest_two_batches"] = ORACLE_SQL["ingest_games"]
ORACLE_SQL["ingest_documents"] = ORACLE_SQL["ingest_games"]
ORACLE_SQL["flatten_documents"] = ORACLE_SQL["flatten_nested"].replace("SELECT * FROM tr", "SELECT * EXCLUDE (event_pos) FROM tr")
_WHOLE = "CAST(game_id AS BIGINT) % 5 <> 0"
for _name in ("flatten_odd_documents", "flatten_split_documents"):
    ORACLE_SQL[_name] = f"{ORACLE_SQL['flatten_documents']} WHERE {_WHOLE}"
# each order that parses has an event and one without moments
ORACLE_SQL["split_document_problems"] = f"""WITH logs AS ({_PRIORITY_LOGS}) SELECT game_id,
    CASE WHEN {_WHOLE} THEN NULL ELSE 'corrupt document' END AS problem,
    CAST(CASE WHEN {_WHOLE} THEN count(*) + count(*) FILTER (o_orderpriority <> '2-HIGH') ELSE 0 END AS BIGINT) AS events
    FROM logs WHERE o_orderpriority <> '1-URGENT' GROUP BY game_id"""
ORACLE_SQL["stored_shots"] = f"""WITH {ORDER_SHOTS.strip()} SELECT CAST(game_id AS VARCHAR) AS game_id, event_id,
    name_player, name_team, type_shot FROM os"""
ORACLE_SQL["stored_players"] = "SELECT s_suppkey AS \"idPlayer\", s_name AS \"namePlayer\" FROM supplier"
for _name in ("release_frame", "nearest_opponent", "enriched_shots"):
    ORACLE_SQL[f"{_name}_merge"] = ORACLE_SQL[_name]
for _name in ("append", "compacted"):
    ORACLE_SQL[f"enriched_sink_{_name}"] = ORACLE_SQL["enriched_sink"]
