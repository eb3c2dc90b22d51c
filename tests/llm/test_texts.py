import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellex.functions import staging
from tessellex.llm import fingerprints, langid, line_dedup, pii, queries, url_filters

from .helpers import BASE, ROWS, SMALL, documents, levenshtein

# language ID


def out_of_place(profile, own, size):
    return sum(abs(profile.index(g) - k) if g in profile else size for k, g in enumerate(own))


def test_language_by_definition(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    profiles = langid.fit(df, size=60)
    ranks = {x: [int(profiles.codes[i]) for i in row.argsort(kind="stable") if row[i] < 60] for x, row in zip(profiles.languages, profiles.ranks)}
    for r in df.limit(30).collect():
        own = langid.ranked(*langid.ngrams(r["text"]), 60).tolist()
        distance = {x: out_of_place(p, own, 60) for x, p in ranks.items()}
        best = min(distance, key=lambda x: (distance[x], x))
        assert profiles.predict(r["text"]) == (best, pytest.approx(1 - distance[best] / (60 * len(own))))


def test_language_accuracy_on_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = [r for r in queries.op1_language_id(spark, SMALL).collect() if r["held_out"]]
    assert len(rows) > 30 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_language_of_awkward_rows(spark):
    df = documents(spark)
    profiles = langid.fit(df)
    rows = langid.predict(df, profiles).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        has = any(c.isalpha() for c in r["text"] or "")
        assert r["lang_pred"] == ("en" if has else "und") and (has or r["score"] == 0)
    none = langid.fit(df.limit(0))
    assert none.predict("text") == ("und", 0.0) and langid.predict(df.limit(0), none).count() == 0


# fingerprints


def plain_fingerprint(text):
    """Length code, ratios and quartile levels, with loops over bytes and sorted counts."""
    data = list(text.encode())
    counts = [0] * 256
    padded = data + [0] * max(0, 5 - len(data)) if data else []
    for at in range(len(padded) - 4):
        for k, (i, j) in enumerate([(1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4)]):
            h = (padded[at] * 2654435761 + padded[at + i] * 2246822519 + padded[at + j] * 3266489917 + k * 0x9E3779B1) % 2**32
            h = (h ^ h >> 15) * 0x85EBCA6B % 2**32
            counts[h >> 24] += 1
    q1, q2, q3 = (sorted(counts)[at] for at in (63, 127, 191))
    ratios = (15 * q1 // q3) * 16 + 15 * q2 // q3 if q3 else 0
    bits = "".join(f"{(c > q1) + (c > q2) + (c > q3):02b}" for c in counts)
    return f"{min(255, round(math.log(len(data) + 1, 1.1))):02x}{ratios:02x}{int(bits, 2):0128x}"


def plain_likeness(a, b):
    x, y = (bin(int(f, 16))[2:].zfill(528) for f in (a, b))
    moves = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(int(x[k : k + 2], 2) - int(y[k : k + 2], 2))] for k in range(16, 528, 2))
    header = 2 * abs(int(a[:2], 16) - int(b[:2], 16)) + 2 * (abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16)))
    return 1.0 if a == b else max(0.0, 1 - (moves + min(64, header)) / (416 + 64))


def test_digest_and_likeness_by_definition():
    rnd = np.random.default_rng(11)
    texts = ["", "a", "ab", "abcde", "é", "日本語のテキスト 😀", "x" * 5000, BASE, BASE + "!", BASE * 40, " ".join(f"w{k}" for k in rnd.integers(0, 900, 8000))]
    texts += ["".join(rnd.choice(list("abcdef ghé"), int(n))) for n in rnd.integers(0, 400, 40)]
    found = [fingerprints.digest(t) for t in texts]
    assert found == [plain_fingerprint(t) for t in texts]
    for a in found[:16]:
        for b in found:
            assert fingerprints.likeness(a, b) == pytest.approx(plain_likeness(a, b), abs=1e-12) == pytest.approx(fingerprints.likeness(b, a), abs=1e-12)
    assert found[0] == "0" * 132 and {len(f) for f in found} == {132}
    assert fingerprints.likeness(found[7], found[8]) > 0.8 > fingerprints.likeness(found[7], found[10])


def test_edits_by_definition(spark):
    for rows in (ROWS, ROWS[:1], [(3, None), (3, None)], [(1, "a"), (1, "b"), (2, "c d e f g")]):
        order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        expected = []
        for (i, own), (_, after) in zip(order, order[1:] + order[:1]):
            half = len(own) // 2
            changed = own[: len(own) - half] + after[:half]
            expected.append((i, len(own), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.digest(own), fingerprints.digest(changed), fingerprints.likeness(fingerprints.digest(own), fingerprints.digest(changed)), fingerprints.likeness(fingerprints.digest(own), fingerprints.digest(after))))
        for parts in (1, 3, 8):
            found = [tuple(r) for r in fingerprints.against_edits(documents(spark, rows), parts=parts).collect()]
            assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert fingerprints.against_edits(documents(spark).limit(0)).collect() == []


def test_ranges_of_many_cuts(spark):
    cuts = sorted({(k * 7919) % 100_003 for k in range(300)})
    ids = spark.range(0, 100_003, 97).withColumn("part", fingerprints._range_of(F.col("id"), cuts))
    assert all(r["part"] == sum(c <= r["id"] for c in cuts) for r in ids.collect())


def test_likeness_tells_edits_from_strangers(spark):
    rows = queries.op2_fingerprints(spark, SMALL).collect()
    assert len(rows) == 200
    long = [r for r in rows if r["n_chars"] > 500]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.9 * len(long)
    assert fingerprints.likeness("00" * 66, fingerprints.digest("")) == 1


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80), st.text(max_size=80))
def test_likeness_is_bounded_and_symmetric(a, b):
    x, y = fingerprints.digest(a), fingerprints.digest(b)
    assert fingerprints.likeness(x, x) == 1 and 0 <= fingerprints.likeness(x, y) == fingerprints.likeness(y, x) <= 1


# URL filters

URLS = ["http://A.Example.com/en/1?q", "https://www.example.com/en/x", "http://example.org", "ftp://net/es/1#a", "x.net/fr/", "http://net/es", "http://:80/a", "://", "http://a.net?/fr/", None, "", "http://xcom/en/", "http://com./", "http://deep.www.example.com/en/a/b", "http://u@Example.COM/en/"]


def test_urls_by_definition(spark, monkeypatch):
    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (url, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    rules = spark.createDataFrame(queries.URL_RULES + [("x", None, None)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(u, "h", 1) for u in URLS + URLS[:2]], "url string, host string, Verdict int").repartition(3)
    found = [tuple(r) for r in url_filters.judge(pages, rules).select("url", "host", "path", "rule", "verdict").collect()]
    assert sorted(found, key=repr) == sorted(map(judge, URLS + URLS[:2]), key=repr)
    assert {r["verdict"] for r in url_filters.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), rules).collect() == []
    monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(staging, "HOT_ROWS", 3)
    hot = pages.unionByName(pages).unionByName(pages)
    found = [tuple(r) for r in url_filters.judge(hot, rules, short=1).select("url", "host", "path", "rule", "verdict").collect()]
    assert sorted(found, key=repr) == sorted([*map(judge, URLS + URLS[:2])] * 3, key=repr)


def test_short_prefixes_meet_and_whole_digests_confirm(spark):
    """One hex digit leaves 16 prefixes, so expressions meet rules that aren't theirs; the join is on the prefix alone."""
    rules = spark.createDataFrame([(f"h{k}.com", "/", "block") for k in range(64)], "host string, path string, verdict string")
    keyed = rules.select(F.sha2(F.concat("host", "path"), 256).alias("full"), F.col("host").alias("rank"))
    asked = spark.createDataFrame([(e,) for e in ("a.h1.com/", "h1.com/", "com/")], "e string").select(F.sha2("e", 256).alias("asked"))
    met = url_filters.candidates(asked, keyed, 1)
    assert met.count() > 3 and met.filter("asked = full").count() == 1
    assert met.filter("substring(asked, 1, 1) <> substring(full, 1, 1)").count() == 0
    pages = spark.createDataFrame([("http://a.h1.com/x",), ("http://h64.com/",), ("http://h1.com",)], "url string")
    assert [(r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules, short=1).orderBy("url").collect()] == [("h1.com/", "block"), (None, "allow"), (None, "allow")]


def test_a_suffix_that_all_pairs_have_is_dealt_out(spark, monkeypatch):
    """With the broadcast refused, rows of com/ are in many partitions, and results stay."""
    monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(staging, "HOT_ROWS", 100)
    sizes = []
    salted = url_filters.salted

    def watched(many, once, on, how="inner", counts=None):
        out = salted(many, once, on, how, counts)
        sizes.append(sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()))
        return out

    monkeypatch.setattr(url_filters, "salted", watched)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pages = spark.range(4000).select(F.concat(F.lit("http://h"), "id", F.lit(".com/a")).alias("url"))
        rules = spark.createDataFrame([("com", "/", "block"), ("h7.com", "/a", "allow")], "host string, path string, verdict string")
        found = {r["verdict"]: r["count"] for r in url_filters.judge(pages, rules).groupBy("verdict").count().collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert found == {"block": 3999, "allow": 1}
    assert sum(sizes[0]) == 4001 and sizes[0][-1] < 0.6 * 4001


# line dedup


def dedup(rows, least=24, edits=1):
    lines = {}
    order = sorted(((i, t) for i, t in rows if t is not None), key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in order:
        for k, s in enumerate(t.split("\n")):
            if len(s) >= least:
                place = (i is not None, i or 0, k)
                lines[s] = min(lines.get(s, place), place)
    gone = {s for s, p in lines.items() if any(q < p and abs(len(s) - len(x)) <= edits and levenshtein(s, x) <= edits for x, q in lines.items() if x != s)}
    out = []
    for i, t in rows:
        pieces = [] if t is None else t.split("\n")
        kept = [s for k, s in enumerate(pieces) if len(s) < least or (s not in gone and lines[s] == (i is not None, i or 0, k))]
        out.append((i, None if t is None else "\n".join(kept), len(pieces), len(pieces) - len(kept)))
    return sorted(out, key=repr)


LINE = "abcdefghij klmnopqrst uvwxyz 0123456789"
VARIANTS = [LINE, LINE[1:], LINE[:-1], LINE + "!", "!" + LINE, LINE.replace("k", "K"), LINE.replace("k", "Q"), LINE.replace("k", ""), LINE.replace("kl", "lk"), LINE[:20] + "x" + LINE[20:], LINE.replace("a", "é"), LINE[:24], LINE[:25], LINE[:23], LINE[5:30], LINE[::-1]]


@pytest.mark.parametrize("edits", [0, 1])
def test_lines_by_definition(spark, edits):
    rows = [*ROWS, *((20 + k, "\n".join([v, "own line number %d of this text" % (k * 137)])) for k, v in enumerate(VARIANTS)), (60, "\n".join(VARIANTS[::-1])), (61, "\n" * 5)]
    rows = [r for r in rows if r[0] != 6]
    found = line_dedup.dedup_lines(documents(spark, rows), max_edits=edits)
    assert sorted(((r["doc_id"], r["text"], r["lines_total"], r["lines_dropped"]) for r in found.collect()), key=repr) == dedup(rows, edits=edits)
    assert line_dedup.dedup_lines(documents(spark).limit(0)).collect() == []


def test_lines_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(staging, "HOT_ROWS", 2)
    rows = [(k, v) for k, v in enumerate([*VARIANTS, *VARIANTS[:3] * 4])]
    found = line_dedup.dedup_lines(documents(spark, rows))
    assert sorted(((r["doc_id"], r["text"], r["lines_total"], r["lines_dropped"]) for r in found.collect()), key=repr) == dedup(rows)


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


PRIVATE = [
    "a.b@c.d", "x@y", "a@b..c", "é@b.c", "a@b.c_d@e.f", "a@b.c@d.e", "..a@-.-", "a@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.0255", "0000.0.0.0", "99999999999999999999.1.1.1",
    "4111111111111111", "4111-1111 1111-1111", "4111  1111 1111 1111", "4111 1111 1111 1111 9", "+4111111111111111", "+1 (988) 555-2485", "+1....", "+12-345-678-9", "+1 23", "++123456789", "￿1 4111￿1111",
    "1 " * 40, "4" * 40, "a" * 3000, "1" * 3000, ".1" * 2000, "a@" + "b." * 3000 + "c", "1 " * 4000, "日本 1.1.1.1 é x@y.z", "GB82WEST12345698765432", "GB82WEST12345698765433", "my ssn is 123-45-6789", "123-45-6789", "ssn 000-45-6789",
]


def test_spans_by_definition(spark):
    texts = [t for _, t in ROWS] + PRIVATE
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, pii string").repartition(4)
    rows = {r["doc_id"]: r["pii"] for r in pii.find(df).collect()}
    for k, t in enumerate(texts):
        if t and "￿" in t:
            continue
        assert [(s["kind"], s["start"], s["end"], s["value"]) for s in rows[k] if s["kind"] in PATTERNS] == base_spans(t), t[:50]
    added = {t: [s["kind"] for s in rows[k] if s["kind"] not in PATTERNS] for k, t in enumerate(texts)}
    assert added["GB82WEST12345698765432"] == ["iban"] and added["my ssn is 123-45-6789"] == ["ssn"]
    ibans = {"DE89 3704 0044 0532 0130 00 THE END": (0, 27), "so DE89370400440532013000, GB82 WEST 1234 5698 7654 32 too": (3, 25), "xDE89370400440532013000": None, "DE89370400440532013000x": None, "DE89  3704 0044 0532 0130 00": None, "XX89370400440532013000": None}
    found = pii.find(spark.createDataFrame([(t,) for t in ibans], "text string")).collect()
    assert {r["text"]: next(((s["start"], s["end"]) for s in r["pii"] if s["kind"] == "iban"), None) for r in found} == ibans
    assert max(len(r["pii"]) for r in found) == 2
    assert not any(added[t] for t in ("GB82WEST12345698765433", "123-45-6789", "ssn 000-45-6789"))
    assert pii.find(df.limit(0)).collect() == []


def test_random_spans(spark):
    import random

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab1234567890..@@-- +()é_%") for _ in range(rnd.randint(0, 120))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.find(df).collect():
        assert [(s["kind"], s["start"], s["end"], s["value"]) for s in r["pii"] if s["kind"] in PATTERNS] == base_spans(r["text"]), r["text"]


def test_many_spans_and_redaction(spark):
    text = " ".join(f"10.0.{k // 250}.{k % 250}" for k in range(1500))
    df = spark.createDataFrame([(1, text), (2, "a@b.c +1 (988) 555-2485 é"), (3, None), (4, "none"), (5, "4111.1111.1111.1111@x.y and 1.1.1.1")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(df).withColumn("masked", pii.redacted(F.col("text"), F.col("pii"))).collect()}
    assert [(s["start"], s["end"]) for s in rows[1]["pii"]] == [m.span() for m in re.finditer(PATTERNS["ip"], text)]
    assert rows[1]["masked"] == " ".join(["<IP>"] * 1500)
    assert rows[2]["masked"] == "<EMAIL> <PHONE> é" and rows[3]["masked"] is None and rows[4]["masked"] == "none"
    assert rows[5]["masked"] == "<EMAIL> and <IP>"
