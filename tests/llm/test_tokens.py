import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessellex.llm import encoders, packing, sentence_pieces, token_counts

from .helpers import ROWS, SMALL, documents

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(JSON)
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = ["", " ", "  ", "a  b", "a \n b", "<|endoftext|>", "x<|endoftext|> y", "it's we'll", "  x", "\x1c a\x1d\x1d b", "  z", "日本 語", "12 345", "a" * 5000, " " * 3000 + "b", "\r\n\r\n", "é é", "▁x", "<s> </s>", "\x00", "----" * 40]
words = st.text(st.sampled_from(" \n\t'abAz<|>endoftx.,0129é日😀▁ \x1f"), max_size=60)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(words)
def test_json_ids_equal_the_library(text):
    assert encoders.load(JSON).fast is not None
    assert encoders.load(JSON).encode(text).tolist() == ids(text)


def test_json_ids_of_odd_texts():
    for text in ODD:
        assert encoders.load(JSON).encode(text).tolist() == ids(text), text[:40]


def test_word_vocabulary_stays_with_its_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert encoders.load(path).fast is None
    assert encoders.load(path).encode("Some words here").tolist() == Tokenizer.from_file(path).encode("Some words here", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(words, st.integers(1, 20))
def test_safe_pieces_keep_all_ids(text, limit):
    pieces = encoders.safe_pieces(text, limit)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in ids(p)] == ids(text)


def test_counts(spark):
    df = token_counts.token_counts(documents(spark), JSON, batch_bytes=100)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect())
    expected = sorted((-1 if i is None else i, len((t or "").encode()), len(ids(t or "")), len(ids(t or "")) > 512) for i, t in ROWS)
    assert found == expected and df.columns.count("n_tokens") == 1
    assert token_counts.token_counts(documents(spark).limit(0), JSON).count() == 0


def check_pieces(rows, documents, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in documents.items():
        whole = np.array([*ids(text or ""), 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(whole)
            assert r["ids_crc32"] == zlib.crc32(whole[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole)
    padding = 0
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert set(by_doc) == set(documents)
    return padding


def test_packing_round_trip(spark):
    rows = {i: t for i, t in ROWS if i != 2}  # ids once each, the null id too
    df = documents(spark, list(rows.items()))
    for windows in (1, 2, 32):
        assert check_pieces(packing.pack(df, JSON, capacity=64, open_windows=windows).collect(), rows, 64) == 0
    assert packing.pack(df.limit(0), JSON).collect() == []


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(docs.repartition(7), JSON).collect()
    assert check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 1024) == 0


def test_packing_of_repeated_rows(spark):
    rows = packing.pack(documents(spark, [(1, "a b c"), (1, "a b c")]), JSON).collect()
    assert sorted(r["length"] for r in rows if r["start"] == 0) and sum(r["length"] for r in rows) == 2 * len([*ids("a b c"), 0])


@settings(max_examples=300, deadline=None)
@given(words)
def test_piece_ids_and_text_equal_the_library(text):
    known = sentence_pieces.model(MODEL)
    found = known.encode_batch([text])[0]
    assert found.tolist() == PIECES.encode(text)
    assert known.decode(found) == PIECES.decode(PIECES.encode(text)) == text.replace("▁", " ")


def test_piece_ids_of_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()] + ODD
    known = sentence_pieces.PieceModel(MODEL)
    assert [x.tolist() for x in known.encode_batch(texts)] == PIECES.encode(texts)
    for raw in ([*known.bytes.values()], [known.bytes[0xE3], known.bytes[0x81]], [0, 1, 2, 300]):
        assert known.decode(np.array(raw, dtype=np.int32)) == PIECES.decode(list(raw))


def test_piece_columns(spark):
    df = sentence_pieces.encode(documents(spark), MODEL)
    back = sentence_pieces.decode(df, MODEL).collect()
    assert all(r["decoded"] == r["text"] and (r["piece_ids"] is None) == (r["text"] is None) for r in back)
    trips = sentence_pieces.round_trip(documents(spark), MODEL).collect()
    assert len(trips) == len(ROWS) and all(r["exact"] for r in trips)
    assert sentence_pieces.round_trip(documents(spark).limit(0), MODEL).count() == 0


def test_batches_are_balanced_by_bytes():
    texts = ["ab " * 100, "日本 " * 100, "x", "", "words and words " * 500, "日" * 3000]
    for most in (64, 1000, 5000):
        whole = dict.fromkeys(range(len(texts)), "")
        for at, pieces in token_counts.balanced(texts, most, encoders.safe_pieces):
            sizes = [len(p.encode()) for p in pieces]
            assert sum(sizes) <= most or len(pieces) == 1
            for i, p in zip(at, pieces):
                whole[i] += p
            assert len(pieces) == 1 or " " not in texts[at[0]][most:] or max(sizes) <= most + 20
        assert list(whole.values()) == texts


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=5), st.integers(1, 40))
def test_counts_of_batches_equal_the_library(texts, most):
    for path, expected in ((JSON, [len(ids(t)) for t in texts]), (MODEL, [len(x) for x in PIECES.encode(texts)])):
        encoder, found = encoders.load(path), [0] * len(texts)
        for at, pieces in token_counts.balanced(texts, most, encoder.pieces):
            for i, n in zip(at, encoder.count_batch(pieces)):
                found[i] += n
        assert found == expected


def unigram_file(path):
    """A small unigram vocabulary with byte fallback, written by rule."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        spec.pieces.add(piece=piece, score=0.0, type=kind)
    for b in range(256):
        spec.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=6)
    for k, piece in enumerate(["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "aba", "bab", "▁▁", "abab", "c", "ca", "▁bac", "é", "日本"]):
        spec.pieces.add(piece=piece, score=-2.0 - (k + 2) ** 0.5 * 1.7 % 3, type=1)
    spec.trainer_spec.model_type, spec.trainer_spec.byte_fallback = 1, True
    spec.normalizer_spec.name, spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces, spec.normalizer_spec.escape_whitespaces = "identity", True, False, True
    path.write_bytes(spec.SerializeToString())
    return str(path)


def test_score_walk_equals_the_library_on_a_unigram_file(tmp_path):
    path = unigram_file(tmp_path / "unigram.model")
    known, library = sentence_pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = np.random.default_rng(5)
    texts = ["".join(rnd.choice(list("aaabbbc é日本x\n"), int(n))) for n in rnd.integers(0, 40, 400)]
    assert [x.tolist() for x in known.encode_batch(texts)] == library.encode(texts)
    assert [known.decode(x) for x in known.encode_batch(texts)] == texts


def test_long_words_take_little_memory():
    import tracemalloc

    known = sentence_pieces.PieceModel(MODEL)
    known.encode_batch(["warm up"])
    for text in ("abcdefghij" * 100_000, "é" * 300_000):
        tracemalloc.start()
        found = known.encode_batch([text])[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak <= 60 * len(text) + 2_000_000 and not known.words.get(text)
        assert known.decode(found) == text
    short = "abcdefghij" * 300 + "日" * 200
    assert known.encode_batch([short, short[:150], short[:140]])[0].tolist() == PIECES.encode(short)
