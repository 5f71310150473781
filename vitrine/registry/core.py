"""Registration of queries: a Spark callable, the tables it reads and its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare, spread
from .views import DUCK_VIEWS, SPARK_VIEWS


TEXT_VIEWS = {"v_html": "part", "v_page": "pages", "v_doc": "documents"}


class Tables:
    """Lazy access to the parquet tables of one directory and to the derived views."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = prepare(spark), directory

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        """A view of :mod:`registry.views`; nested views become CTEs of one statement."""
        sql = with_views(f"SELECT * FROM {name}", SPARK_VIEWS)
        if name in TEXT_VIEWS:  # wide text for per-row extraction: spread the source table
            source = TEXT_VIEWS[name]
            spread(self.table(source)).createOrReplaceTempView(f"spread_{source}")
            return self.spark.sql(re.sub(rf"\bFROM {source}\b", f"FROM spread_{source}", sql))
        return self.spark.sql(_bind_tables(sql, self.directory))


RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _bind_tables(sql: str, directory: str) -> str:
    pattern = r"\b(FROM|JOIN)\s+(%s)\b" % "|".join(RAW)
    return re.sub(pattern, lambda m: f"{m[1]} parquet.`{directory}/{m[2]}.parquet`", sql)


def _needed(sql: str, views: dict[str, str], seen: list[str]) -> list[str]:
    for name in re.findall(r"\bv_[a-z_0-9]+\b", sql):
        if name in views and name not in seen:
            _needed(views[name], views, seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(sql: str, views: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of every view it mentions, dependencies first."""
    views = DUCK_VIEWS if views is None else views
    names = _needed(sql, views, [])
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in names)
    recursive = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if recursive:
        keyword = "WITH RECURSIVE " if recursive[1] else "WITH "
        return f"{keyword}{ctes},\n{sql[recursive.end():]}"
    return f"WITH {ctes}\n{sql}"


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Decorator registering ``build(tables)`` under ``name`` for the SURVEY ids."""

    def register(build: Callable[[Tables], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, ids, build, with_views(sql) if sql else None)
        return build

    return register


# --- SQL text helpers for the DuckDB twins -----------------------------------------


def sql_round(x: str, digits: int) -> str:
    """SQL of :func:`vitrine.functions.rounding.exact_round`; ``x`` must be a column name."""
    s = f"{10 ** digits}::DOUBLE"
    hi = f"({x} * 134217729::DOUBLE - ({x} * 134217729::DOUBLE - {x}))"
    p = f"({x} * {s})"
    err = f"(({hi} * {s} - {p}) + ({x} - {hi}) * {s})"
    f = f"floor({p})"
    return (
        f"(({f} + CASE WHEN {p} - {f} > 0.5 OR ({p} - {f} = 0.5 AND ({err} > 0 OR ({err} = 0 AND {f} % 2 <> 0)))"
        f" THEN 1 ELSE 0 END) / {s})"
    )


def sql_whole(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS INTEGER)"


def sql_pct(x: str) -> str:
    return sql_whole(f"{x} * 100::DOUBLE")


def sql_text(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
