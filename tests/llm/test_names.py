"""Columns of the caller, whatever their names, stay as they are; only those named like a result are replaced."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessellex.llm import ann, fingerprints, langid, line_dedup, packing, pii, sentence_pieces, simhash, token_counts, url_filters

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Names that operators use inside, or used to; of results; in other cases of letters; and with odd characters.
NAMES = (
    "_lost _doc _th _gone rank _t _email _ip _card _phone _iban _ssn _judged _trip _ row doc th dk lost pieces judged trip n h t ids decoded digest short full asked e rh rp rv "
    "key node size t1 t2 anonymous least component root label bucket data word pair bits code Lines_Total LINES_DROPPED Lang_Pred Score Fingerprint Host Path RULE Verdict "
    "N_Tokens n_Bytes Over_Limit N_Pieces Ids_crc32 Exact Decoded_SHA256 PII Piece_Ids many first near line s email ip card phone iban ssn _deal _deals dotted.name tick`ed"
).split()
TEXTS = [(1, "The quick brown fox jumps over the lazy dog, again and again.\nWrite to a.b@example.com"), (2, "The quick brown fox jumps over the lazy dog, again and again."), (None, None), (2, "")]


def table(spark):
    df = spark.createDataFrame([(i, t, "http://www.example.com/en/x", [1.0, 2.0]) for i, t in TEXTS], "doc_id long, text string, url string, embedding array<float>")
    seen, out = {c.lower() for c in df.columns}, df
    for k, name in enumerate(NAMES):
        if name.lower() not in seen:
            seen.add(name.lower())
            out = out.select("*", F.lit(k).alias(name))
    return out


def profiles():
    return langid.Profiles.of({"en": [1, 2, 3]}, 400)


@pytest.mark.parametrize(
    "results, operator",
    [
        (("lang_pred", "score"), lambda df: langid.predict(df, profiles())),
        (("fingerprint",), fingerprints.fingerprint),
        (("host", "path", "rule", "verdict"), lambda df: url_filters.judge(df, df.sparkSession.createDataFrame([("example.com", "/en/", "block")], "host string, path string, verdict string"))),
        (("lines_total", "lines_dropped"), line_dedup.dedup_lines),
        (("n_bytes", "n_tokens", "over_limit"), lambda df: token_counts.token_counts(df, JSON)),
        (("piece_ids",), lambda df: sentence_pieces.encode(df, MODEL)),
        (("n_pieces", "ids_crc32", "decoded_sha256", "exact"), lambda df: sentence_pieces.round_trip(df, MODEL)),
        (("pii",), pii.find),
        ((), simhash.representatives),
    ],
    ids=["langid", "fingerprint", "url", "lines", "tokens", "pieces", "trip", "pii", "near"],
)
def test_other_columns_stay(spark, results, operator):
    df = table(spark)
    found = operator(df)
    assert len({c.lower() for c in found.columns}) == len(found.columns)
    for c in results:
        assert found.columns.count(c) == 1
    kept = [c for c in df.columns if c.lower() not in results]
    assert [c for c in found.columns if c not in results] == kept
    rows = found.collect()
    assert len(rows) == len(TEXTS) - (operator is simhash.representatives) * 1
    first = df.first()
    for r in rows:
        assert all(r[c] == first[c] for c in kept if c not in ("doc_id", "text"))
    assert found.write.format("noop").mode("overwrite").save() is None


def test_narrow_operators_do_not_mind(spark):
    df = table(spark)
    assert simhash.classes(df).count() == fingerprints.against_edits(df).count() == len(TEXTS)
    assert {r["doc_id"] for r in packing.pack(df, JSON).collect()} == {1, 2, None}
    assert ann.search(df.withColumn("vec_id", F.monotonically_increasing_id()), F.col("vec_id") >= 0, k=2).count() > 0
