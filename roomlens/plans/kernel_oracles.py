"""DuckDB forms of queries over the geometry kernel."""

from __future__ import annotations

from ..sources.driver_tables import LAYOUT_SQL
from . import layout_queries

SEED = 7
_RANK = f"sha256('{SEED}:' || source_group || ':' || room_id || ':{{task}}:' || {{name}})"
#: Entities of a room in the order of its list.
_LISTED = """listed AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY CASE kind WHEN 'object' THEN 0 WHEN 'window' THEN 1 ELSE 2 END, seq) AS nth, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM entities)"""
_VALID = f"valid AS (SELECT room_id FROM ({layout_queries.ORACLES['validation']}) WHERE valid)"
_HITS = f"""t AS (SELECT p.*, e.label AS c_label, {layout_queries.SLAB} FROM p JOIN entities e ON e.room_id = p.room_id AND e.label <> a_label AND e.label <> b_label),
h AS (SELECT room_id, a_label, b_label, list(c_label ORDER BY round(greatest(ex, ey, 0.0), 9), lower(c_label)) AS hits FROM t WHERE {layout_queries.MET} GROUP BY ALL)"""
_PAIR = "a.room_id, a.label AS a_label, b.label AS b_label, a.cx AS a_cx, a.cy AS a_cy, b.cx - a.cx AS dx, b.cy - a.cy AS dy"

_VISIBILITY = f"""WITH {LAYOUT_SQL.strip()}, {_LISTED}, {_VALID},
every AS (SELECT {_PAIR}, source_group FROM listed a JOIN listed b ON a.room_id = b.room_id AND a.nth < b.nth JOIN valid ON valid.room_id = a.room_id JOIN rooms ON rooms.room_id = a.room_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY {_RANK.format(task="visibility", name="a_label || ':' || b_label")}) AS rank FROM every) WHERE rank <= 100),
{_HITS},
m AS (SELECT p.*, hits, row_number() OVER (PARTITION BY p.room_id ORDER BY hits IS NULL, CASE WHEN hits IS NULL THEN -rank ELSE rank END) AS pick FROM p LEFT JOIN h ON h.room_id = p.room_id AND h.a_label = p.a_label AND h.b_label = p.b_label)
SELECT room_id, a_label AS object_1, b_label AS object_2, CASE WHEN hits IS NULL THEN '[]' ELSE '["' || array_to_string(hits, '","') || '"]' END AS hits FROM m WHERE pick = 1"""

_REPOSITIONING = f"""WITH {LAYOUT_SQL.strip()}, {_VALID}, s AS ({layout_queries.ORACLES["slide_distance"]}), liked AS ({layout_queries.ORACLES["movable_preferred"]}),
d AS (SELECT s.*, row_number() OVER (PARTITION BY room_id ORDER BY {_RANK.format(task="repositioning", name="label")}, {_RANK.format(task="repositioning", name="direction")}) AS n
      FROM s JOIN liked USING (room_id, label) JOIN valid USING (room_id) JOIN rooms USING (room_id)),
m AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY distance < 0.01, CASE WHEN distance < 0.01 THEN -n ELSE n END) AS pick FROM d)
SELECT room_id, label AS object_to_move, direction, printf('%.3f', distance) AS distance FROM m WHERE pick = 1"""

_PLURAL = r"CASE WHEN n = 1 THEN name WHEN regexp_matches(name, '[^aeiou ]y$') THEN regexp_replace(name, 'y$', 'ies') WHEN regexp_matches(name, '(s|x|z|ch|sh)$') THEN name || 'es' ELSE name || 's' END"
_TOOLS = f"""WITH {LAYOUT_SQL.strip()}, {_LISTED}, {_VALID}, area AS ({layout_queries.ORACLES["occupied_area"]}),
p AS (SELECT {_PAIR} FROM listed a JOIN listed b ON a.room_id = b.room_id AND a.nth + 1 = b.nth), {_HITS},
g AS (SELECT room_id, kind, type, replace(type, '_', ' ') AS name, count(*) AS n, string_agg(label, ', ' ORDER BY nth) AS ids FROM listed GROUP BY ALL),
lines AS (SELECT *, '- ' || n || ' ' || ({_PLURAL}) || ' with ' || CASE WHEN n = 1 THEN 'ID' ELSE 'IDs' END || ' [' || ids || '].' AS line FROM g),
held AS (SELECT room_id, coalesce(sum(n) FILTER (kind = 'object'), 0)::bigint AS objects, coalesce(sum(n) FILTER (kind <> 'object'), 0)::bigint AS openings,
  string_agg(line, chr(10) ORDER BY type) FILTER (kind = 'object') AS inventory, coalesce(max(line) FILTER (kind = 'door'), '- 0 doors.') AS doors, coalesce(max(line) FILTER (kind = 'window'), '- 0 windows.') AS windows FROM lines GROUP BY ALL),
said AS (
SELECT room_id || '/inspect_room' AS call_id, 'inspect_room' AS tool, 'Room type: ' || replace(source_group, '_', ' ') || '.' || chr(10) || 'Room floor area: ' || printf('%.3f', room_w * room_h) || ' square meters.' || chr(10) || objects || ' objects:' || chr(10)
  || coalesce(inventory || chr(10), '') || openings || ' openings:' || chr(10) || doors || chr(10) || windows AS output, NULL AS error FROM held JOIN rooms USING (room_id)
UNION ALL SELECT room_id || '/calculator', 'calculator', 'The result is ' || printf('%.3f', room_w * room_h) || '.', NULL FROM held JOIN rooms USING (room_id)
UNION ALL SELECT room_id || '/occupied_floor_area', 'occupied_floor_area', 'The occupied floor area is ' || printf('%.3f', occupied) || ' square meters.', NULL FROM area JOIN valid USING (room_id)
UNION ALL SELECT room_id || '/inspect_entity/' || label, 'inspect_entity', 'Entity ''' || label || ''' is ' || CASE kind WHEN 'object' THEN 'an ' ELSE 'a ' END || kind || '. Its polygon centroid is x=' || printf('%.3f', cx) || ', y=' || printf('%.3f', cy)
  || ' meters. Its axis-aligned bounding box is min_x=' || printf('%.3f', x1) || ', min_y=' || printf('%.3f', y1) || ', max_x=' || printf('%.3f', x2) || ', and max_y=' || printf('%.3f', y2) || ' meters. Its polygon area is ' || printf('%.3f', (x2 - x1) * (y2 - y1)) || ' square meters and it has 4 vertices.', NULL FROM listed
UNION ALL SELECT room_id || '/pair_distance/' || a_label || '/' || b_label, 'pair_distance', 'The Euclidean distance between the polygon centroids of ''' || a_label || ''' and ''' || b_label || ''' is ' || printf('%.3f', sqrt(dx * dx + dy * dy)) || ' meters.', NULL FROM p
UNION ALL SELECT room_id || '/view_angle/' || a_label || '/' || b_label, 'view_angle', CASE WHEN sqrt(dx * dx + dy * dy) > 1e-12 THEN 'The view angle from the polygon centroid of ''' || a_label || ''' to ''' || b_label || ''' is ' || printf('%.3f', degrees(acos(greatest(-1.0, least(1.0, dy / sqrt(dx * dx + dy * dy)))))) || ' degrees from north (the positive y-axis).' END,
  CASE WHEN sqrt(dx * dx + dy * dy) <= 1e-12 THEN 'LayoutError: view angle is undefined for coincident centroids' END FROM p
UNION ALL SELECT p.room_id || '/ray_trace/' || p.a_label || '/' || p.b_label, 'ray_trace', 'The centroid-to-centroid segment from ''' || p.a_label || ''' to ''' || p.b_label || ''' intersects ' || CASE WHEN hits IS NULL THEN 'no other entities: [].'
  ELSE len(hits) || ' other ' || CASE WHEN len(hits) = 1 THEN 'entity' ELSE 'entities' END || ' in traversal order: [' || array_to_string(hits, ', ') || '].' END, NULL
  FROM p LEFT JOIN h ON h.room_id = p.room_id AND h.a_label = p.a_label AND h.b_label = p.b_label)
SELECT call_id, tool, output, error::varchar AS error FROM said"""


def _curve(points: int = 16) -> str:
    """The table of the distance, a row of it after the other, for paths of that many points each."""
    far = lambda i, j: f"sqrt((e[{2 * i + 1}] - e[{2 * (points + j) + 1}]) ** 2 + (e[{2 * i + 2}] - e[{2 * (points + j) + 2}]) ** 2)"

    def cell(i: int, j: int) -> str:
        before = [f"r{i - 1}.c{j}"] * (i > 0) + [f"r{i - 1}.c{j - 1}"] * (i > 0 and j > 0) + [f"d{j - 1}"] * (j > 0)
        return f"greatest({far(i, j)}, least({', '.join(before)}))" if before else far(i, j)

    rows = [f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), r0 AS (SELECT vec_id, e, {', '.join(f'{cell(0, j)} AS d{j}' for j in range(points))} FROM e)"]
    kept = lambda i: f"q{i} AS (SELECT vec_id, e, {', '.join(f'd{j} AS c{j}' for j in range(points))} FROM r{i})"
    for i in range(1, points):
        rows.append(kept(i - 1))
        cells = ", ".join(cell(i, j).replace(f"r{i - 1}.", f"q{i - 1}.") + f" AS d{j}" for j in range(points))
        rows.append(f"r{i} AS (SELECT vec_id, e, {cells} FROM q{i - 1})")
    return ",\n".join(rows) + f"\nSELECT vec_id, round(d{points - 1}, 6) AS distance FROM r{points - 1}"


ORACLES: dict[str, str] = {
    "visibility": _VISIBILITY,
    "repositioning": _REPOSITIONING,
    "tool_outputs": _TOOLS,
    "curve_distance": _curve(),
}
