"""Sinks: delimited text, JSON, one folder a key, an inverted index and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.retrieval import inverted_index


def write_tsv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A TSV folder with header; arrays become sorted joined text."""
    flat = [F.array_join(F.array_sort(F.transform(c.name, lambda x: x.cast("string"))), sep).alias(c.name) if isinstance(c.dataType, T.ArrayType) else F.col(c.name) for c in df.schema]
    df.select(*flat).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def write_json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """A record a line; a folder for each value of ``by`` if given."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).json(path)


def write_index(docs: DataFrame, doc: str, fields: dict[str, float], path: str) -> None:
    """An inverted index, sorted by token within folders by field, so that a lookup reads few row groups."""
    inverted_index(docs, doc, fields).repartition("field", "token").sortWithinPartitions("token", "doc").write.mode("overwrite").partitionBy("field").parquet(path)


def write_vectors(df: DataFrame, path: str, cell: str) -> None:
    """Vectors in folders by cell: a search opens the cells it probes."""
    df.repartition(cell).write.mode("overwrite").partitionBy(cell).parquet(path)
