"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoders
from .columns import apart, named, together


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "replace"))


def balanced(texts: list[str], most_bytes: int, pieces: Callable[[str, int], list[str]]) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of (indexes, pieces) of at most ``most_bytes`` UTF-8 bytes, unless one piece alone has more.

    A longer text comes in pieces, as ``pieces`` cuts it where no token can cross; what it leaves
    whole is a batch of its own.
    """
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        own = n_bytes(text)
        # a piece of so many characters keeps within the bytes if they are spread evenly, with room for the way to the next cut
        for piece in [text] if own <= most_bytes else pieces(text, max(1, most_bytes * len(text) // own // 2)):
            n = own if piece is text else n_bytes(piece)
            if held and size + n > most_bytes:
                yield at, held
                at, held, size = [], [], 0
            at.append(i)
            held.append(piece)
            size += n
    if at:
        yield at, held


def token_counts(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512, batch_bytes: int = 262_144) -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text.

    Counts are those of the file's own library, without begin, end or other added tokens; special
    strings inside a text count as the library's default has it. A null or empty text has 0 bytes
    and 0 tokens. Columns of df named like the three results, in any case of letters, are replaced by
    them; all others stay. Rows repeat as they do in df. Texts go to the encoder's batch call in
    batches balanced by UTF-8 bytes, and a text beyond a batch is cut where no token can cross; only
    lengths return from the workers. The path must be readable on the executors.
    """

    @F.pandas_udf("long")
    def lengths(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoders.load(tokenizer_path)
        for part in parts:
            texts = part.fillna("").tolist()
            found = np.zeros(len(texts), dtype=np.int64)
            for at, pieces in balanced(texts, batch_bytes, encoder.pieces):
                np.add.at(found, at, encoder.count_batch(pieces))
            yield pd.Series(found)

    held = apart(df, "n_bytes", "n_tokens", "over_limit", text=named(text)).withColumn("n", lengths("text"))
    return together(held, n_bytes=F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), n_tokens=F.col("n"), over_limit=F.col("n") > limit)
