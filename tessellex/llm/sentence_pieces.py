"""Encoding and decoding with a SentencePiece file, by a forward pass over a trie of distinct marked words.

For a unigram file the walk is Viterbi's: a prefix has the largest score sum of its segmentations and
the last piece of that one, and words that share a prefix share both.

For a BPE file, whose pieces are merged by rank, the best segmentation of a prefix follows from its
last piece: the pieces before it are the best segmentation of what precedes, and two neighbours can
stand side by side if and only if the two of them encoded alone stay apart. So each prefix has one
forward state, its last piece, and words that share a prefix share its states. That takes the place
of score sums, whose maximum is no BPE segmentation; results equal the library's.

A path's states are kept for its first DEPTH characters only; a longer word goes on with the last ones
that a piece can reach, so a word of any length takes a few bytes for each of its characters.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import apart, named, together

#: The mark that stands for a space.
MARK = "▁"
#: A marked word: its marks, then what follows up to the next mark.
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Bytes of words, and pairs of pieces, that a worker keeps; beyond that it starts anew. Words beyond DEPTH characters aren't kept.
KEPT_BYTES, KEPT_PAIRS = 224 << 20, 2_000_000
#: Characters of a word whose states the next word can share.
DEPTH = 128
#: What the score of a character outside a unigram vocabulary lies below that of the least likely piece, as the library has it.
UNKNOWN_PENALTY = 10.0
#: The state of a prefix that ends in a character outside the vocabulary; its identity as a piece.
OUTSIDE = -1


class PieceModel:
    """A SentencePiece BPE or unigram model with byte fallback, identity normalization and a leading mark; by_score walks a BPE model as if it were unigram."""

    def __init__(self, path: str, by_score: bool = False):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, trainer = spec.normalizer_spec, spec.trainer_spec
        if trainer.model_type not in (1, 2) or not trainer.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE or unigram model with byte fallback, no character map, white space kept and a leading mark is needed")
        self.by_score = by_score or trainer.model_type == 1
        normal = [(p.piece, i, p.score) for i, p in enumerate(spec.pieces) if p.type == 1]
        self.ids = {p: i for p, i, _ in normal}
        if any(p.type == 4 for p in spec.pieces) or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces of the user or with a mark inside can't be walked")
        if not self.by_score and not all(c in self.ids for p in self.ids for c in p):
            raise ValueError("a BPE piece with characters that are no pieces can't be walked")
        self.scores = {i: x for _, i, x in normal}
        self.unknown = min((x for _, _, x in normal), default=0.0) - UNKNOWN_PENALTY
        self.feeds = any("\n" in p for p in self.ids)
        self.rank = {i: k for k, (_, i, _) in enumerate(sorted(normal, key=lambda x: -x[2]))}
        self.pieces = [p.piece for p in spec.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i, p in enumerate(spec.pieces) if p.type in (2, 3, 5)}
        #: How each piece reads alone; control pieces and bytes that are no whole character need more care.
        self.plain = [chr(self.byte_of[i]) if i in self.byte_of else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.careful = self.control | {i for b, i in self.bytes.items() if b >= 0x80}
        self.trie: dict = {}
        for p, i, _ in normal:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def parts(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece i when it is encoded alone; None for a character, and for a piece that merging never makes (which is then never used)."""
        if i not in self.halves:
            now = [self.ids[c] for c in self.pieces[i]]
            last = None
            while len(now) > 1:
                found = [(self.rank[m], k) for k, (a, b) in enumerate(zip(now, now[1:])) if (m := self.ids.get(self.pieces[a] + self.pieces[b])) is not None]
                if not found:
                    break
                k = min(found)[1]
                last = (now[k], now[k + 1])
                now[k : k + 2] = [self.ids[self.pieces[now[k]] + self.pieces[now[k + 1]]]]
            self.halves[i] = last if len(now) == 1 else None
        return self.halves[i]

    def reached(self, i: int) -> bool:
        return len(self.pieces[i]) == 1 or self.parts(i) is not None

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the pieces a and b, side by side, are what merging makes of their text.

        Takes back their merges, the latest first, and looks each time for a merge across the border
        that would have come earlier: before a's own merge, or not after b's, as the leftmost of
        equals goes first.
        """
        key = a << 20 | b
        known = self.beside.get(key)
        if known is not None:
            return known
        if len(self.beside) >= KEPT_PAIRS:
            self.beside.clear()
        rank, pieces = self.rank, self.pieces
        limit, known = len(rank), self.reached(a) and self.reached(b)
        while known:
            across = self.ids.get(pieces[a] + pieces[b])
            if across is not None and rank[across] < limit:
                known = False
                break
            at = rank[a] if len(pieces[a]) > 1 else -1
            bt = rank[b] if len(pieces[b]) > 1 else -1
            if at < 0 and bt < 0:
                break
            if at > bt:
                limit, a = at, self.parts(a)[1]
            else:
                limit, b = bt + 1, self.parts(b)[0]
        self.beside[key] = known
        return known

    def fits(self, before: int, i: int) -> bool:
        """Whether piece i can follow a prefix that ends in the piece before."""
        return self.reached(i) if before == OUTSIDE else self.stay_apart(before, i)

    def forward(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids as 32-bit words) of distinct words in ascending order, by a depth-first walk of their trie.

        The path to the present node holds, for each prefix, its last piece (for unigram files its
        score too) and the vocabulary nodes that pieces begun earlier have reached; a word starts from
        the prefix it shares with the one before. A character outside the vocabulary is a piece of its
        own, beside which all pieces stay.
        """
        lengths, walk = list(map(len, self.pieces)), self._by_score if self.by_score else self._by_merges
        last, sums = array("i", [OUTSIDE]), array("f", [0.0])
        open_: list[list[tuple[int, dict]]] = [[]]
        before = ""
        for word in words:
            shared = 0
            for x, y in zip(before[: len(open_) - 1], word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], sums[shared + 1 :], open_[shared + 1 :]
            walk(word, shared, last, sums, open_)
            out = array("i")
            end = len(word)
            while end:
                i = last[end]
                if i == OUTSIDE:
                    out.extend(self.bytes[x] for x in reversed(word[end - 1].encode("utf-8", "replace")))
                    end -= 1
                else:
                    out.append(i)
                    end -= lengths[i]
            out.reverse()
            yield word, out.tobytes()
            before = word

    def _by_merges(self, word: str, shared: int, last: array, sums: array, open_: list[list[tuple[int, dict]]]) -> None:
        """The last piece of each prefix beyond ``shared`` characters: the longest that stays apart from what precedes it."""
        root, known, going = self.trie, self.beside.get, open_[shared]
        for end in range(shared, len(word)):
            c, piece, now = word[end], OUTSIDE, []
            going.append((end, root))
            for begin, node in going:  # the longest piece first
                node = node.get(c)
                if node is not None:
                    now.append((begin, node))
                    if piece == OUTSIDE:
                        i = node.get("")
                        if i is not None:
                            own = last[begin]
                            fits = known(own << 20 | i) if own >= 0 else None
                            if self.fits(own, i) if fits is None else fits:
                                piece = i
            going.pop()
            going = now
            last.append(piece)
            if end < DEPTH:
                open_.append(now)

    def _by_score(self, word: str, shared: int, last: array, sums: array, open_: list[list[tuple[int, dict]]]) -> None:
        """The last piece of the largest score sum of each prefix beyond ``shared`` characters, of equal ones the longest; sums are rounded to 32 bits, as the library does."""
        root, going = self.trie, open_[shared]
        for end in range(shared, len(word)):
            c = word[end]
            going = [(begin, node[c]) for begin, node in [*going, (end, root)] if c in node]
            if end < DEPTH:
                open_.append(going)
            ways = [(array("f", [sums[begin] + self.scores[node[""]]])[0], node[""], begin) for begin, node in going if "" in node]
            if not ways or ways[-1][2] != end:
                ways.append((array("f", [sums[end] + self.unknown])[0], OUTSIDE, end))
            total, piece, _ = max(ways, key=lambda x: x[0])  # of equal ones the first
            last.append(piece)
            sums.append(total)

    def split(self, text: str) -> list[str]:
        """The words of a text, as keys of self.words: without their mark where each has just one, which all but those that begin with a line feed have.

        A line feed that is no piece joins none on either side, so it begins a word of its own. Words
        of other texts keep their marks.
        """
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text or self.feeds:
            return WORD.findall(MARK + text.replace(" ", MARK))
        return text.replace("\n", " \n").split(" ")

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the distinct words of all of them that aren't known yet are sorted and walked once."""
        if self.held > KEPT_BYTES:
            self.words.clear()
            self.held = 0
        split = [self.split(x) for x in texts]
        known = self.words
        new = set().union(*split).difference(known)
        # a word that begins with a mark has all its marks; one that begins with a line feed has none
        marked = {w: w if w[:1] in ("\n", MARK) else MARK + w for w in new}
        walked = dict(self.forward(sorted(set(marked.values()))))
        here = {w: walked[m] for w, m in marked.items()}
        kept = {w: ids for w, ids in here.items() if len(w) <= DEPTH}
        self.held += sum(map(len, kept.values())) + 200 * len(kept)
        known.update(kept)
        if len(kept) < len(here):
            known = _Two(here, known)
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, runs of byte pieces read as UTF-8 (what isn't, each byte as U+FFFD), marks as spaces, without the leading one."""
        ids = ids.tolist()
        if self.careful.isdisjoint(ids):
            text = "".join(map(self.plain.__getitem__, ids))
            return text[1:] if ids and self.pieces[ids[0]].startswith(MARK) else text
        out: list[str] = []
        raw = bytearray()
        first = True
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                first = False
                continue
            out.append(_read(bytes(raw)))
            raw.clear()
            if i is None or i in self.control:
                out.append(" \u2047 " if i is not None and self.pieces[i] == "<unk>" else "")
                continue
            out.append(self.plain[i][1:] if first and self.pieces[i].startswith(MARK) else self.plain[i])
            first = False
        return "".join(out)


class _Two:
    """Words of this batch first, then those that are kept."""

    def __init__(self, here: dict[str, bytes], known: dict[str, bytes]):
        self.here, self.known = here, known

    def __getitem__(self, word: str) -> bytes:
        return self.known[word] if word in self.known else self.here[word]


def _read(raw: bytes) -> str:
    """UTF-8 characters of bytes; each byte that is part of none as U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[k : k + n].decode("utf-8"))
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            k += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(df: DataFrame, model_path: str, text: str = "text", out: str = "piece_ids", batch_chars: int = 4_000_000) -> DataFrame:
    """df with the ids (array of int) of each whole text, without begin and end, as the library gives them.

    A null text gives null, an empty one no ids. A column named like ``out`` is replaced; rows repeat
    as in df. The path must be readable on the executors. Each batch of texts is encoded at once.
    """

    @F.pandas_udf("array<int>")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model(model_path)
        for part in parts:
            texts = part.fillna("").tolist()
            found: list[np.ndarray] = []
            begin, held = 0, 0
            for k, x in enumerate(texts):
                held += len(x)
                if held > batch_chars:
                    found += known.encode_batch(texts[begin : k + 1])
                    begin, held = k + 1, 0
            yield pd.Series(found + known.encode_batch(texts[begin:]))

    held = apart(df, out, text=named(text)).withColumn("ids", encoded(F.coalesce("text", F.lit(""))))
    return together(held, **{out: F.when(F.col("text").isNotNull(), F.col("ids"))})


def decode(df: DataFrame, model_path: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """df with the text of each array of ids; null for null, and for ids outside the vocabulary an error. Spaces and marks both decode to spaces."""

    @F.pandas_udf("string")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model(model_path)
        for part in parts:
            yield pd.Series([None if x is None else known.decode(x) for x in part])

    return together(apart(df, out, ids=named(ids)).withColumn("decoded", decoded("ids")), **{out: F.col("decoded")})


ROUND_TRIP = "n_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean"


def round_trip(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """df with n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256 (hex) and exact (the decoded text is the text, its marks as spaces).

    Encodes and decodes in one pass; a null text counts as empty, with no pieces. Columns named like
    the four results are replaced by them.
    """

    @F.pandas_udf(ROUND_TRIP)
    def tripped(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = model(model_path)
        for part in parts:
            rows = []
            texts = part.tolist()
            for k in range(0, len(texts), 2000):
                for x, ids in zip(texts[k : k + 2000], known.encode_batch(texts[k : k + 2000])):
                    back = known.decode(ids)
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == x.replace(MARK, " ")))
            yield pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "decoded_sha256", "exact"])

    names = ("n_pieces", "ids_crc32", "decoded_sha256", "exact")
    held = apart(df, *names, text=named(text)).withColumn("trip", tripped(F.coalesce("text", F.lit(""))))
    return together(held, **{c: F.col("trip").getField(c) for c in names})
