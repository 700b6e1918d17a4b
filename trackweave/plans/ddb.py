"""DuckDB SQL of the adapters' tables, and a few shorthands, for the plans' oracle SQL."""

from __future__ import annotations

_EVENTS = "SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, ts, CAST(floor((epoch(ts) - 1704067200) / {0}) AS INTEGER) AS t FROM events"

TABLES = {
    "nodes": f"SELECT event_type AS sequence_id, event_id AS index, t, user_id AS label, user_id // 2 AS parent, value AS center_0, k AS center_1, value AS area, value AS axis_major_length, k AS axis_minor_length, k / 16 AS orientation, value * k / 100 AS intensity_mean FROM ({_EVENTS.format(3600)})",
    "tracks": f"SELECT 'events' AS sequence_id, event_id AS index, t, user_id AS label_track, user_id // 2 AS parent_track, value AS center_0, k AS center_1, 'original' AS cell_source FROM ({_EVENTS.format(86400)}) QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY ts, event_id) = 1",
    "preds": "SELECT l_returnflag AS sequence_id, l_orderkey AS src, l_partkey AS dst, l_tax * 20 - 1 AS p0, l_discount * 40 - 2 AS p1, l_quantity / 25 - 1 AS p2, CAST(l_linenumber % 3 AS INTEGER) AS y, CAST(l_suppkey % 4 AS INTEGER) AS dataloader_idx FROM lineitem",
    "pixels": f"SELECT event_type AS sequence_id, t, CAST(floor(value) AS INTEGER) AS y, CAST(k AS INTEGER) AS x, min(user_id) AS label, max(value - floor(value)) AS intensity FROM ({_EVENTS.format(86400)}) GROUP BY ALL",
    "edges": "SELECT l_returnflag AS sequence_id, l_orderkey AS src, l_partkey AS dst, CAST(l_linenumber % 3 AS INTEGER) AS y, CAST(l_orderkey % 48 AS INTEGER) AS t, CAST(l_suppkey % 3 + 1 AS INTEGER) AS dist_temp, l_quantity AS dist_spat, l_discount AS overlap, l_tax AS iou, l_discount - l_tax AS relative_size, l_tax * 10 AS intensity_mean_diff FROM lineitem",
    "vectors": "SELECT 'embeddings' AS sequence_id, vec_id AS index, embedding, label FROM embeddings",
}
TABLES["dense_preds"] = f"SELECT sequence_id, src % 200 AS src, dst % 200 AS dst, p0, p1, p2, y, dataloader_idx FROM ({TABLES['preds']}) WHERE src % 200 <> dst % 200"

TABLES["base"] = TABLES["tracks"]
#: Variants of tracks; they also stand as tracks for the common parts of a query.
_EARLY = f"SELECT * FROM ({TABLES['tracks']}) WHERE (t < 12 OR label_track >= 40) AND (t >= 15 OR label_track < 40)"
_BRIEF = f"SELECT sequence_id, index, t, CASE WHEN label_track % 4 = 0 THEN label_track * 1000 + CAST(floor(t / 2) AS BIGINT) ELSE label_track END AS label_track, CASE WHEN label_track % 8 = 1 THEN parent_track ELSE 0 END AS parent_track, center_0, center_1, cell_source FROM ({TABLES['tracks']})"
VARIANTS = {"early": f"early AS ({_EARLY}), tracks AS (SELECT * FROM early)", "brief": f"brief AS ({_BRIEF}), tracks AS (SELECT * FROM brief)"}


def sql(body: str, *tables: str) -> str:
    """The query with the named tables before it."""
    return "WITH RECURSIVE " + ", ".join(VARIANTS.get(t) or f"{t} AS ({TABLES[t]})" for t in tables) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")


def r(expression: str, name: str) -> str:
    """A double as both engines give it: to six places, without a negative zero."""
    return f"round({expression}, 6) + 0.0 AS {name}"
