"""Loading of public tokenizer files and exact encoding of whole texts.

A ``.json`` file is read by ``tokenizers``; a ``.model`` file by ``sentencepiece``. A ``.json`` of
the plain byte-level BPE kind is also compiled to the equal ``tiktoken`` table (ids in merge order,
the same splitting pattern, the same added tokens), which gives the same ids several times faster.
Every other kind stays with its own library. ``tests/llm/test_tokens.py`` holds the two against
each other.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np

#: Fixed value: the splitting pattern of byte-level BPE with use_regex.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Equal to the pattern above on texts without two blanks in a row, and cheaper as it looks at nothing ahead.
SINGLE_BLANK_PATTERN = BYTE_LEVEL_PATTERN.replace(r"\s+(?!\S)|", "")
TWO_BLANKS = re.compile(r"\s\s")
#: Between a non-blank and a single space that precedes a non-blank, every pattern above ends a token.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The same where the mark \u2581 stands for a space too.
SAFE_CUT_OF_MARKED = re.compile("(?<=[^\\s\u2581]) (?=[^\\s\u2581])")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def compiled(spec: dict):
    """The equal tiktoken encodings of a tokenizer file's content, for any text and for texts without two blanks in a row; None if it isn't of the plain kind."""
    import tiktoken

    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    )
    if not plain:
        return None
    letters, vocab = byte_alphabet(), model["vocab"]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    in_order = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
    if not in_order or any(vocab.get(c, 256) >= 256 for c in letters) or len(vocab) - len(added.keys() & vocab.keys()) != 256 + len(merges):
        return None
    ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items() if piece not in added}
    return tuple(tiktoken.Encoding("compiled", pat_str=p, mergeable_ranks=ranks, special_tokens=added) for p in (BYTE_LEVEL_PATTERN, SINGLE_BLANK_PATTERN))


def safe_pieces(text: str, limit: int, safe: re.Pattern = SAFE_CUT) -> list[str]:
    """text cut into pieces of about ``limit`` characters, only where no token can cross: before a single space between non-blanks.

    A stretch without such a place stays whole, however long it is.
    """
    if len(text) <= limit:
        return [text]
    out, begin = [], 0
    while len(text) - begin > limit:
        cut = safe.search(text, begin + limit)
        if not cut:
            break
        out.append(text[begin : cut.start()])
        begin = cut.start()
    return [*out, text[begin:]]


class JsonEncoder:
    """Ids as ``tokenizers`` gives them with add_special_tokens=False and its other defaults."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.fast = compiled(json.load(f))

    @cached_property
    def library(self):
        """Read only where it is needed: it takes more memory than the compiled table."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            fast = self.fast[TWO_BLANKS.search(text) is None]
            try:
                return np.concatenate([fast.encode_to_numpy(x, allowed_special="all") for x in safe_pieces(text, 65_536)])
            except ValueError:  # blank runs of a million characters exhaust the pattern engine's stack; the library has no such bound
                pass
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def count_batch(self, texts: list[str]) -> list[int]:
        """The number of ids of each text, by the library's batch call."""
        if self.fast is None:
            return [len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        out = [0] * len(texts)
        for kind in (False, True):  # with two blanks in a row somewhere, and without
            at = [k for k, x in enumerate(texts) if (TWO_BLANKS.search(x) is None) == kind]
            try:
                found = [len(ids) for ids in self.fast[kind].encode_batch([texts[k] for k in at], num_threads=1, allowed_special="all")]
            except ValueError:  # see encode
                found = [len(self.encode(texts[k])) for k in at]
            for k, n in zip(at, found):
                out[k] = n
        return out

    def pieces(self, text: str, limit: int) -> list[str]:
        return safe_pieces(text, limit) if self.fast is not None else [text]


class ModelEncoder:
    """Ids as ``sentencepiece`` gives them, without begin and end."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        whole = any(p.type == 4 or re.search("[^\u2581]\u2581", p.piece) for p in spec.pieces)
        #: Words stand apart: each begins with its own mark, no piece reaches from one into the next, and nothing is normalized.
        self.by_word = not (norm.precompiled_charsmap or not norm.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix or whole)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text), dtype=np.uint32)

    def count_batch(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]

    def pieces(self, text: str, limit: int) -> list[str]:
        """Cut at single spaces, which go: the mark that each piece gets at its beginning stands for the one before it."""
        if not self.by_word:
            return [text]
        first, *rest = safe_pieces(text, limit, SAFE_CUT_OF_MARKED)
        return [first, *(x[1:] for x in rest)]


@lru_cache(maxsize=4)
def load(path: str) -> JsonEncoder | ModelEncoder:
    """The encoder of a tokenizer file, kept once in each worker process."""
    return JsonEncoder(path) if path.endswith(".json") else ModelEncoder(path)
