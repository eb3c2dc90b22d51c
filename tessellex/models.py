"""The one interface of models: a scorer takes batches of rows and gives them back with its columns.

Every model of the pipelines (encoder, tagger, pair scorer, mention detector) is such a function over
Arrow batches. The defaults need no weights: character codes, cosine, and the dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    """Batches of input columns to batches of output columns, row for row."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def apply(df: DataFrame, scorer: Scorer, inputs: list[str], outputs: str) -> DataFrame:
    """df with the scorer's columns (DDL text) added; the scorer sees the inputs only."""

    @F.pandas_udf(outputs)
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from scorer(parts)

    names = [x.split()[0] for x in outputs.split(", ")]
    return df.withColumn("_scored", run(F.struct(*inputs))).select(*(c for c in df.columns if c not in names), *(F.col(f"_scored.{n}").alias(n) for n in names))


def character_encoder(dim: int = 128) -> Scorer:
    """text to v: counts of lower-cased characters in dim bins, scaled to length 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = np.zeros((len(part), dim))
            for k, text in enumerate(part.iloc[:, 0]):
                np.add.at(out[k], [ord(c) * 131 % dim for c in (text or "").lower()], 1.0)
            lengths = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.DataFrame({"v": list(np.divide(out, lengths, out=np.zeros_like(out), where=lengths > 0))})

    return run


def cosine_pair_scorer(encoder: Callable[[], Scorer] = character_encoder) -> Scorer:
    """(left, right) texts to score: the cosine of their codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder()
        for part in batches:
            a, b = (np.stack(next(iter(code(iter([part.iloc[:, [k]]]))))["v"]) for k in (0, 1))
            yield pd.DataFrame({"score": (a * b).sum(axis=1)})

    return run


def rerank(df: DataFrame, scorer: Scorer, pair: list[str], key: str, candidate: str, top: int) -> DataFrame:
    """The top candidates of each key by a pair scorer, ties to the smaller candidate."""
    from pyspark.sql import window as W

    scored = apply(df, scorer, pair, "score double").withColumn("score", F.round("score", 9))
    return scored.withColumn("rank", F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc("score"), candidate))).filter(F.col("rank") <= top)
