"""The catalogue of queries: each name with its DataFrame form and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import prepare

FLAGSHIP = "patent_pipeline"

_FORMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (tables) under its name; tables(name) reads a table of the folder asked for."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _FORMS[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from .plans import entities, files, linked, linking, pipelines, texts, vectors  # noqa: F401  each registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_FORMS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
