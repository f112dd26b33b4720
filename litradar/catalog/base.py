"""Registry of the checkable queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pages import PAGE_NOISE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ROWS: dict[str, str] = {}


def entry(name: str, rows: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with the inventory rows it covers and, where there is one, its DuckDB form."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        ROWS[name] = rows
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# white space as the expressions see it, for the DuckDB regular expressions
WS = r"[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def stripped_sql(x: str) -> str:
    """A page without its noise, white space in one."""
    for pattern in PAGE_NOISE:
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def unescape_sql(x: str) -> str:
    """The entities of the given tables; the ampersand comes last."""
    for name, code in (("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("nbsp", 160), ("copy", 169), ("middot", 183), ("amp", 38)):
        x = f"replace({x}, '&{name};', chr({code}))"
    return x


def unit_sql(x: str, eps: str = "1e-12") -> str:
    return f"list_transform({x}, lambda q: q / (sqrt(list_dot_product({x}, {x})) + {eps}))"
