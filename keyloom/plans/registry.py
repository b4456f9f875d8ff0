"""A registry of queries: a name, a Spark plan, and DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The keyspaces of keyloom.sources.keyspaces as SQL.
VIEWS = {
    "h": "SELECT 'user:' || user_id AS key, event_type AS field, value, epoch_us(ts) // 1000 AS ms, (epoch_us(ts) // 1000) * 65536 + event_id % 65536 AS hlc, "
    "(event_id % 3)::INT AS origin, event_id, epoch_us(ts) // 1000 + floor(value * 1000)::BIGINT AS ttl_ms, event_type = 'error' AS tomb FROM events",
    "hm": "SELECT key, field, arg_max(value, row(hlc, origin)) AS value, arg_max(ttl_ms, row(hlc, origin)) AS ttl_ms FROM h GROUP BY key, field",
    "str": "SELECT 'cust:' || c_custkey AS key, c_name || '|' || c_mktsegment AS value, c_custkey AS seq FROM customer",
    "seg": "SELECT DISTINCT 'seg:' || c_mktsegment AS key, printf('n%02d', c_nationkey) AS member FROM customer",
    "br": "SELECT DISTINCT 'brand:' || p_brand AS key, p_type || '/' || p_size AS member FROM part",
    "z": "SELECT 'rank:' || c_nationkey AS key, c_name AS member, c_acctbal AS score FROM customer",
    "zp": "SELECT 'parts:' || p_brand AS key, p_name AS member, max(p_size)::DOUBLE AS score FROM part GROUP BY ALL",
    "l": "SELECT 'order:' || l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos, l_partkey % 50 AS value FROM lineitem",
    "ln": "SELECT key, pos AS index, value, count(*) OVER (PARTITION BY key) AS n FROM l",
    "s": "SELECT 'st:' || user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS seq, event_type AS type, json_extract_string(props, '$.k') AS k FROM events",
    "hits": "SELECT 'hits:' || event_type AS key, (user_id % 4)::INT AS node, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) AS pos FROM events",
    "doc": "SELECT 'ev:' || event_id AS key, props AS doc FROM events",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the keyspaces that it names, in the order that they need each other."""
    import re

    need: set[str] = set()

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                add(VIEWS[name])

    add(sql)
    parts = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in need]
    if not parts:
        return sql
    if sql.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + sql.lstrip()[5:]
    return "WITH " + ", ".join(parts) + " " + sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query named twice: {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add
