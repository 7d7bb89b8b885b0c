"""Registration of queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: White space and other character classes in the regex dialect of DuckDB.
DUCK_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DUCK_WORD = r"[\p{L}\p{N}_]+(?:[''’\-][\p{L}\p{N}_]+)*"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; sql gives the same rows in DuckDB."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def squash_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{DUCK_SPACE}+', ' ', 'g'))"


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"
