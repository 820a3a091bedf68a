"""SQL for DuckDB, with the signal views as named parts."""

from __future__ import annotations

import re

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DUCKDB = {
    "E": "(SELECT CAST(floor(vec_id / 100) AS INT) acc, CAST(floor(vec_id / 4) AS BIGINT) w, CAST(vec_id % 4 AS INT) sp, label, CAST(i - 1 AS INT) n, CAST(embedding[i] AS DOUBLE) x FROM (SELECT *, unnest(generate_series(1, len(embedding))) i FROM embeddings))",
    "V": "(SELECT event_id, (epoch_us(ts) - 1704067200000000) / 1e6 t, epoch_us(ts) - 1704067200000000 us, CAST(user_id % 4 AS INT) st, user_id, event_type ch, value FROM events)",
    "DAYS": "CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)",
    "STRING": "VARCHAR",
    "FIXED7": "printf('%.7f', 60310 + (acc + 0.5) / 86400)",
    "LASTS": "' 0.0000116 '",
    "TONE0": "CASE WHEN a0 > 0 THEN ' ' ELSE '' END || printf('%.5e', a0) || ' ' || CASE WHEN a1 > 0 THEN ' ' ELSE '' END || printf('%.5e', a1)",
    "TONE1": "CASE WHEN b0 > 0 THEN ' ' ELSE '' END || printf('%.5e', b0) || ' ' || CASE WHEN b1 > 0 THEN ' ' ELSE '' END || printf('%.5e', b1)",
}


def _filled(text: str, parts: dict[str, str]) -> str:
    text = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", text)  # doubles, as the engines' decimals differ
    text = re.sub(r"\{RANGE (\d+)\}", parts["RANGE"], text)
    for _ in range(3):
        text = re.sub(r"\{(\w+)\}", lambda m: parts.get(m[1], m[0]), text)
    return text


def duckdb_sql(text: str) -> str:
    return _filled(text, DUCKDB | {t: t for t in TABLES} | {"RANGE": r"(SELECT CAST(range AS INT) k FROM range(\1))"})

