"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .columns import apart, named, together

#: What a document without any letter, or a model without languages, gives.
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    table = np.zeros(0x110000, dtype=np.int32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            table[c] = ord(x.lower()[0])
    return table


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of a text's lower-cased words, padded by one blank, as packed codes in ascending order; and their counts.

    A run of characters that aren't letters counts as one blank, and the blank alone as no n-gram.
    """
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)].astype(np.int64)
    codes = np.concatenate([[0], codes, [0]])
    letter = codes != 0
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # of a run of blanks the first stays
    kept[0] = True
    codes = codes[kept]
    one = codes[codes != 0]
    if not len(one):
        return one, one
    two = codes[:-1] << 21 | codes[1:]
    three = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[codes[1:-1] != 0]
    found = np.sort(np.concatenate([one, two | 1 << 62, three]))
    begins = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[begins], np.diff(np.append(begins, len(found)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    """Each language's n-grams in rank order, as one table: codes ascending, and each language's rank of each code."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, ranked_codes: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(ranked_codes)
        codes = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.asarray(ranked_codes[x], dtype=np.int64) for x in languages)]))
        ranks = np.full((len(languages), len(codes)), size, dtype=np.int32)
        for k, x in enumerate(languages):
            ranks[k, np.searchsorted(codes, ranked_codes[x])] = np.arange(len(ranked_codes[x]))
        return cls(languages, codes, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language whose profile is least out of place, ties to the smaller name; and 1 less its distance over the largest possible one."""
        own = ranked(*ngrams(text), self.size) if text else self.codes[:0]
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        place = np.arange(len(own))
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        moved = np.where(known, np.abs(self.ranks[:, at] - place), self.size)
        moved = np.where(self.ranks[:, at] == self.size, self.size, moved).sum(axis=1)
        best = int(moved.argmin())
        return self.languages[best], float(1 - moved[best] / (self.size * len(own)))


#: Parts in which n-grams of a language are ranked before their best are.
PARTS = 16


def fit(df: DataFrame, text: str = "text", lang: str = "lang", size: int = 400, rows_per_language: int = 1000) -> Profiles:
    """Profiles of the ``size`` most frequent n-grams of each language.

    Learns from whole texts with a language, at most ``rows_per_language`` different ones of each
    language: those of the smallest hash of the text, so that copies count once. Rows whose text or
    language is null are left out. The driver gets languages x size codes. An empty table gives
    profiles without languages, which find no language for any text.

    Hashes are spread evenly, so a bound on them, from the estimated number of a language's different
    texts, lets through hardly more than are needed (below it rather too many: 1.3 times, and 100);
    only these meet to be ranked. In the rare case that fewer are let through, so many are learned from.
    """
    labelled = df.select(named(lang).alias("lang"), named(text).alias("text")).filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    share = (1.3 * rows_per_language + 100) / F.approx_count_distinct("h", 0.02)
    cuts = labelled.groupBy("lang").agg(F.when(share < 1, -(2.0**63) + share * 2.0**64).otherwise(2.0**63).alias("cut"))
    below = labelled.join(F.broadcast(cuts), "lang").filter(F.col("h").cast("double") <= F.col("cut"))  # a row for each language
    texts = below.groupBy("lang", "h").agg(F.first("text").alias("text"))
    smallest = F.row_number().over(W.Window.partitionBy("lang").orderBy("h"))
    sample = texts.withColumn("r", smallest).filter(F.col("r") <= rows_per_language).drop("r")

    def counts(parts):
        for part in parts:
            for name, group in part.groupby("lang"):
                found = [ngrams(x) for x in group["text"]]
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([n for _, n in found])) if len(codes) else []
                yield pd.DataFrame({"lang": name, "code": codes, "n": np.asarray(total, dtype=np.int64)})

    best = sample.select("lang", "text").mapInPandas(counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    for by in (["lang", F.pmod(F.xxhash64("code"), F.lit(PARTS))], ["lang"]):
        frequent = F.row_number().over(W.Window.partitionBy(*by).orderBy(F.desc("n"), "code"))
        best = best.withColumn("r", frequent).filter(F.col("r") <= size)
    rows = best.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "code"))).alias("codes")).collect()
    return Profiles.of({r["lang"]: [c["code"] for c in r["codes"]] for r in rows}, size)


def predict(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """df with lang_pred and score (0 to 1) from each whole text alone.

    A null text, and one without a letter, gives ``und`` and 0.0. Columns of df named like the two
    results, in any case of letters, are replaced by them; all others stay. Rows repeat as they do in df.
    """
    found = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(found)
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(x) for x in texts], columns=["lang_pred", "score"])

    # a filter on what was found would else be pushed below, and every text judged twice, in workers of their own
    held = apart(df, "lang_pred", "score", text=named(text)).withColumn("judged", judge.asNondeterministic()("text"))
    return together(held, lang_pred=F.col("judged.lang_pred"), score=F.col("judged.score"))
