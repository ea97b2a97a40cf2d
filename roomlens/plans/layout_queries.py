"""Queries over the rooms of the driver tables, with their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import relations as R
from ..sources.driver_tables import LAYOUT_SQL, entities, rooms

Query = Callable[[SparkSession, str], DataFrame]


def _of_entities(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(entities(spark, sf_dir))


def _of_both(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(rooms(spark, sf_dir), entities(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "pair_distance": _of_entities(R.pair_distance),
    "view_angle": _of_entities(R.view_angle),
    "inspect_entity": _of_entities(R.inspect_entity),
    "inspect_room": _of_both(R.inspect_room),
    "nearest_entity": _of_entities(R.nearest),
    "overlap_pairs": _of_entities(R.overlap_pairs),
    "duplicate_labels": _of_entities(R.duplicate_labels),
    "validation": _of_both(R.validation),
    "occupied_area": _of_both(R.occupied_area),
    "slide_distance": _of_both(R.slide_distance),
    "ray_trace": _of_entities(R.ray_trace),
    "placement_certificate": _of_both(R.placement_certificate),
    "placement_axis_aligned": _of_both(R.placement_axis_aligned),
    "movable_preferred": _of_both(R.movable_objects),
    "path_preferred": _of_both(R.path_ends),
}

_C = "c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM entities)"
_PAIRS = f"""{_C},
p AS (SELECT a.room_id, a.seq AS a_seq, b.seq AS b_seq, a.label AS a_label, b.label AS b_label, a.cx AS a_cx, a.cy AS a_cy, b.cx - a.cx AS dx, b.cy - a.cy AS dy
      FROM c a JOIN c b ON a.room_id = b.room_id AND a.seq < b.seq)"""
#: Where the segment of a pair enters and leaves the slabs of a rectangle, and whether it touches it, at more than an end.
SLAB = """  CASE WHEN abs(dx) < 1e-9 THEN CASE WHEN a_cx < x1 - 1e-9 OR a_cx > x2 + 1e-9 THEN 2.0 ELSE 0.0 END ELSE least((x1 - a_cx) / dx, (x2 - a_cx) / dx) END AS ex,
  CASE WHEN abs(dx) < 1e-9 THEN CASE WHEN a_cx < x1 - 1e-9 OR a_cx > x2 + 1e-9 THEN -1.0 ELSE 1.0 END ELSE greatest((x1 - a_cx) / dx, (x2 - a_cx) / dx) END AS lx,
  CASE WHEN abs(dy) < 1e-9 THEN CASE WHEN a_cy < y1 - 1e-9 OR a_cy > y2 + 1e-9 THEN 2.0 ELSE 0.0 END ELSE least((y1 - a_cy) / dy, (y2 - a_cy) / dy) END AS ey,
  CASE WHEN abs(dy) < 1e-9 THEN CASE WHEN a_cy < y1 - 1e-9 OR a_cy > y2 + 1e-9 THEN -1.0 ELSE 1.0 END ELSE greatest((y1 - a_cy) / dy, (y2 - a_cy) / dy) END AS ly"""
MET = "greatest(ex, ey, 0.0) <= least(lx, ly, 1.0) + 1e-9 AND (least(lx, ly, 1.0) - greatest(ex, ey, 0.0) > 1e-9 OR greatest(ex, ey, 0.0) BETWEEN 1e-9 AND 1 - 1e-9)"
_BLOCKER = "NOT is_soft AND NOT is_ceiling"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join([LAYOUT_SQL.strip(), *parts[:-1]]) + "\n" + parts[-1]


def _occupied(where: str) -> str:
    return f"""boxes AS (SELECT e.room_id, greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, room_w) AS x2, least(y2, room_h) AS y2
          FROM entities e JOIN rooms r ON r.room_id = e.room_id WHERE {where}),
kept AS (SELECT * FROM boxes WHERE x1 < x2 AND y1 < y2),
bx AS (SELECT room_id, x, lead(x) OVER (PARTITION BY room_id ORDER BY x) AS nx FROM (SELECT room_id, x1 AS x FROM kept UNION SELECT room_id, x2 FROM kept)),
byy AS (SELECT room_id, y, lead(y) OVER (PARTITION BY room_id ORDER BY y) AS ny FROM (SELECT room_id, y1 AS y FROM kept UNION SELECT room_id, y2 FROM kept)),
occ AS (SELECT bx.room_id, sum((nx - x) * (ny - y)) AS occupied FROM bx JOIN byy ON bx.room_id = byy.room_id
        WHERE EXISTS (SELECT 1 FROM kept k WHERE k.room_id = bx.room_id AND k.x1 <= x AND nx <= k.x2 AND k.y1 <= y AND ny <= k.y2) GROUP BY bx.room_id),
floor AS (SELECT r.room_id, r.source_group, coalesce(occupied, 0.0)::double AS occupied, room_w * room_h - coalesce(occupied, 0.0)::double AS free
          FROM rooms r LEFT JOIN occ ON occ.room_id = r.room_id WHERE r.room_id IN (SELECT room_id FROM entities))"""


_CATALOG = "catalog(source_group, item, width, depth) AS (VALUES " + ", ".join(f"('{g}', '{n}', {w}::double, {d}::double)" for g, items in R.CATALOG.items() for n, w, d in items) + ")"


def _preferred(where: str, tokens: dict[str, tuple[str, ...]], least: int) -> str:
    liked = " OR ".join(f"(source_group = '{g}' AND regexp_matches(lower(label), '{'|'.join(parts)}'))" for g, parts in tokens.items())
    return _with(
        f"k AS (SELECT e.room_id, label, ({liked}) AS liked FROM entities e JOIN rooms r ON r.room_id = e.room_id WHERE {where}),"
        f"n AS (SELECT *, count(*) FILTER (liked) OVER (PARTITION BY room_id) AS n FROM k)",
        f"SELECT room_id, label, liked FROM n WHERE n < {least} OR liked",
    )


ORACLES: dict[str, str] = {
    "pair_distance": _with(_PAIRS, "SELECT room_id, a_label, b_label, round(sqrt(dx * dx + dy * dy), 6) AS distance FROM p"),
    "view_angle": _with(_PAIRS, "SELECT room_id, a_label, b_label, round(degrees(acos(greatest(-1.0, least(1.0, dy / sqrt(dx * dx + dy * dy))))), 6) AS angle FROM p WHERE sqrt(dx * dx + dy * dy) > 1e-12"),
    "inspect_entity": _with(_C, "SELECT room_id, label, kind, round(cx, 6) AS cx, round(cy, 6) AS cy, x1, y1, x2, y2, round((x2 - x1) * (y2 - y1), 6) AS area, len(list_distinct([[x1, y1], [x2, y1], [x2, y2], [x1, y2]]))::int AS n_vertices FROM c"),
    "inspect_room": _with(
        "g AS (SELECT room_id, kind, type, count(*) AS n, string_agg(label, ', ' ORDER BY seq) AS ids FROM entities GROUP BY ALL)",
        "SELECT g.room_id, source_group, round(room_w * room_h, 6) AS room_area, kind, type, n, ids FROM g JOIN rooms r ON r.room_id = g.room_id",
    ),
    "nearest_entity": _with(
        _C,
        "n AS (SELECT a.room_id, a.seq AS a_seq, a.label AS a_label, b.seq AS b_seq, b.label AS b_label, round(sqrt((b.cx - a.cx) * (b.cx - a.cx) + (b.cy - a.cy) * (b.cy - a.cy)), 6) AS distance FROM c a JOIN c b ON a.room_id = b.room_id AND a.seq <> b.seq)",
        "SELECT room_id, a_label, rank, b_label, distance FROM (SELECT *, row_number() OVER (PARTITION BY room_id, a_seq ORDER BY distance, b_seq)::int AS rank FROM n) WHERE rank <= 3",
    ),
    "overlap_pairs": _with(
        f"k AS (SELECT * FROM entities WHERE {_BLOCKER} AND kind = 'object')",
        "SELECT * FROM (SELECT a.room_id, a.label AS a_label, b.label AS b_label, round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)), 6) AS area FROM k a JOIN k b ON a.room_id = b.room_id AND a.seq < b.seq) WHERE area > 1e-5",
    ),
    "duplicate_labels": _with("SELECT room_id, lower(type) AS name, count(*) AS n FROM entities GROUP BY ALL HAVING count(*) > 1"),
    "validation": _with(
        """v AS (SELECT e.*, room_w, room_h, kind <> 'object' AS opening,
  (x2 - x1) * (y2 - y1) - greatest(0, least(x2, room_w) - greatest(x1, 0)) * greatest(0, least(y2, room_h) - greatest(y1, 0)) > 1e-5 AS out,
  CASE WHEN x1 >= 0 AND y1 >= 0 AND x2 <= room_w AND y2 <= room_h THEN least(x1, y1, room_w - x2, room_h - y2)
       ELSE sqrt(greatest(x1 - room_w, -x2, 0) ** 2 + greatest(y1 - room_h, -y2, 0) ** 2) END AS off FROM entities e JOIN rooms r ON r.room_id = e.room_id)""",
        f"k AS (SELECT * FROM entities WHERE {_BLOCKER} AND kind = 'object')",
        "o AS (SELECT a.room_id, count(*) AS n FROM k a JOIN k b ON a.room_id = b.room_id AND a.seq < b.seq WHERE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 1e-5 GROUP BY ALL)",
        """SELECT v.room_id, count(*) AS n_entities, count(*) FILTER (out AND NOT opening) AS n_outside, count(*) FILTER (out AND opening) AS n_openings_outside,
  count(*) FILTER (opening AND off > 0.05) AS n_detached, coalesce(any_value(o.n), 0)::bigint AS n_overlaps, count(*) >= 2 AND count(*) FILTER (out AND NOT opening) = 0 AS valid
FROM v LEFT JOIN o ON o.room_id = v.room_id GROUP BY v.room_id""",
    ),
    "occupied_area": _with(_occupied("kind = 'object' AND NOT is_ceiling"), "SELECT room_id, round(occupied, 6) AS occupied, round(free, 6) AS free FROM floor"),
    "slide_distance": _with(
        f"k AS (SELECT e.*, room_w, room_h FROM entities e JOIN rooms r ON r.room_id = e.room_id WHERE {_BLOCKER} AND kind = 'object')",
        "met AS (SELECT a.*, b.x1 AS ox1, b.y1 AS oy1, b.x2 AS ox2, b.y2 AS oy2, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS lx, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS ly FROM k a JOIN k b ON a.room_id = b.room_id AND a.seq <> b.seq)",
        """g AS (SELECT room_id, seq, max(greatest(0, lx) * greatest(0, ly)) AS overlap,
  min(greatest(0, oy1 - y2)) FILTER (lx > 2e-7 AND oy1 - y2 >= -2e-7) AS up, min(greatest(0, y1 - oy2)) FILTER (lx > 2e-7 AND y1 - oy2 >= -2e-7) AS down,
  min(greatest(0, x1 - ox2)) FILTER (ly > 2e-7 AND x1 - ox2 >= -2e-7) AS "left", min(greatest(0, ox1 - x2)) FILTER (ly > 2e-7 AND ox1 - x2 >= -2e-7) AS "right" FROM met GROUP BY ALL)""",
        """w AS (SELECT k.*, overlap, direction, CASE direction WHEN 'up' THEN least(room_h - y2, coalesce(up, room_h)) WHEN 'down' THEN least(y1, coalesce(down, y1)) WHEN 'left' THEN least(x1, coalesce("left", x1)) ELSE least(room_w - x2, coalesce("right", room_w)) END AS way
      FROM k LEFT JOIN g ON g.room_id = k.room_id AND g.seq = k.seq CROSS JOIN (VALUES ('up'), ('down'), ('left'), ('right')) d(direction))""",
        """SELECT room_id, label, direction, round(CASE WHEN x1 < 0 OR y1 < 0 OR x2 > room_w OR y2 > room_h OR coalesce(overlap, 0) > 1e-8 THEN 0 ELSE greatest(0, way - 1e-5) END, 6) AS distance FROM w""",
    ),
    "ray_trace": _with(
        _PAIRS,
        f"t AS (SELECT p.*, e.label AS c_label, {SLAB} FROM p JOIN entities e ON e.room_id = p.room_id AND e.seq <> a_seq AND e.seq <> b_seq)",
        f"SELECT room_id, a_label, b_label, string_agg(lower(c_label), ',' ORDER BY round(greatest(ex, ey, 0.0), 9), lower(c_label)) AS hits FROM t WHERE {MET} GROUP BY ALL",
    ),
    "placement_certificate": _with(
        _occupied(_BLOCKER),
        _CATALOG,
        "SELECT room_id, item, round(free, 6) AS free, round(width * depth, 6) AS asked, round(free, 6) + 1e-7 < width * depth AS certified_false FROM floor JOIN catalog USING (source_group)",
    ),
    "placement_axis_aligned": _with(
        _CATALOG,
        f"k AS (SELECT room_id, x1, y1, x2, y2 FROM entities WHERE {_BLOCKER})",
        "held AS (SELECT * FROM rooms WHERE room_id IN (SELECT room_id FROM entities))",
        "t AS (SELECT room_id, room_w, room_h, item, width AS w, depth AS d FROM held JOIN catalog USING (source_group) UNION ALL SELECT room_id, room_w, room_h, item, depth, width FROM held JOIN catalog USING (source_group))",
        "xs AS (SELECT room_id, 0.0::double AS x FROM held UNION SELECT room_id, x2 FROM k)",
        "ys AS (SELECT room_id, 0.0::double AS y FROM held UNION SELECT room_id, y2 FROM k)",
        "tried AS (SELECT t.*, x, y FROM t JOIN xs ON xs.room_id = t.room_id AND x >= 0 AND x + w <= room_w + 1e-9 JOIN ys ON ys.room_id = t.room_id AND y >= 0 AND y + d <= room_h + 1e-9)",
        "fit AS (SELECT DISTINCT room_id, item FROM tried WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.room_id = tried.room_id AND x < k.x2 - 1e-9 AND k.x1 + 1e-9 < x + w AND y < k.y2 - 1e-9 AND k.y1 + 1e-9 < y + d))",
        "SELECT DISTINCT t.room_id, t.item, fit.item IS NOT NULL AS fits FROM t LEFT JOIN fit ON fit.room_id = t.room_id AND fit.item = t.item",
    ),
    "movable_preferred": _preferred(f"{_BLOCKER} AND kind = 'object'", R.MOVABLE, 1),
    "path_preferred": _preferred(_BLOCKER, R.PATH_ENDS, 2),
}
