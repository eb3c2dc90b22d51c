"""A caller's columns kept apart from an operator's own, so that no name can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of that exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def apart(df: DataFrame, *results: str, **needed: Column) -> DataFrame:
    """df as one struct column ``row`` of its columns, without those named like a result in any case of letters, beside the values needed, by name."""
    taken = {x.lower() for x in results}
    kept = [named(c).alias(c) for c in df.columns if c.lower() not in taken]
    return df.select((F.struct(*kept) if kept else F.struct(F.lit(None).alias(""))).alias("row"), *(v.alias(k) for k, v in needed.items()))


def together(df: DataFrame, **results: Column) -> DataFrame:
    """The columns of ``row`` again, of which one named in results has its new value at its old place; the other results follow."""
    names = [f.name for f in df.schema["row"].dataType.fields if f.name]
    own = {k: v for k, v in results.items() if k in names}
    return df.select(*((own[c] if c in own else F.col("row").getField(c)).alias(c) for c in names), *(v.alias(k) for k, v in results.items() if k not in own))
