"""Named queries over the fixture tables, each with an equivalent SQL text."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}

_MODULES = ["rows", "aggregates", "text", "features", "sampling", "evaluation", "monitoring", "storage", "models", "streams"]


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def load() -> None:
    for module in _MODULES:
        importlib.import_module(f"registry.{module}")


def flagship_sql() -> str:
    """Monthly label shares: rules applied step by step in SQL."""
    from registry.text import _HIT, cleaned, sentence_list
    from registry.views import EMAILS, TARGET

    return f"""WITH {EMAILS},
kept AS (SELECT * FROM emails WHERE email IS NOT NULL AND length(email) > 0 AND state = 'closed'
  AND time >= TIMESTAMP '2022-08-01 00:00:00' AND time <= TIMESTAMP '2023-09-30 00:00:00'),
latest AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY time DESC, snapshot_id) AS rn FROM kept),
quoted AS (SELECT *, replace(replace(email, '`', ''''), '’', '''') AS q FROM latest WHERE rn = 1),
lines AS (SELECT snapshot_id, unnest(string_split(q, chr(10))) AS p, generate_subscripts(string_split(q, chr(10)), 1) AS i FROM quoted),
firsts AS (SELECT snapshot_id, p, min(i) AS i FROM lines GROUP BY snapshot_id, p),
joined AS (SELECT snapshot_id, string_agg(p, chr(10) ORDER BY i) AS t FROM firsts GROUP BY snapshot_id),
said AS (SELECT snapshot_id, array_to_string(list_filter({sentence_list('t')}, lambda s: NOT ({_HIT})), ' ') AS t FROM joined),
final AS (SELECT q.time, {TARGET} AS target FROM quoted q JOIN said s ON s.snapshot_id = q.snapshot_id WHERE length({cleaned('s.t')}) > 0),
c AS (SELECT CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, target, count(*) AS n FROM final GROUP BY 1, 2, 3)
SELECT year, month, target, n AS count, round(n / sum(n) OVER (PARTITION BY year, month), 9) AS percentage FROM c"""
