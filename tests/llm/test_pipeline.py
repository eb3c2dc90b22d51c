"""Every stage of the pipeline against a plain version of its own."""

import collections
import re

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessellex.llm import langid, queries

from .helpers import ROWS, SMALL, components, levenshtein
from .test_neighbours import jaccard

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = {
    "en": "the people of the town went to the market and bought bread while the children played near the river with their dogs",
    "de": "die leute der stadt gingen auf den markt und kauften brot während die kinder am fluss mit ihren hunden spielten",
}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], DOCUMENT).repartition(3)


def words_of(rnd, language, n):
    return " ".join(rnd.choice(PROSE[language].split(), n))


def plain_grams(text):
    out = collections.Counter()
    for word in "".join(c.lower()[0] if c.isalpha() else " " for c in text).split():
        padded = f" {word} "
        out.update(padded[k : k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1))
    out.pop(" ", None)
    return out


def test_language_id(spark):
    rnd = np.random.default_rng(1)
    rows = [(k, words_of(rnd, x, 40) + f" {x}{k}", x) for k, x in enumerate(["en", "de"] * 20)]
    rows += [(100, words_of(rnd, "en", 30), None), (101, words_of(rnd, "de", 30), "en"), (102, "", "en"), (103, None, None), (104, "12 345 --", "de"), (105, "ｘｑ ｚｚ 漢字 漢字", None)]
    found = corpus_pipeline.language_id(spark, documents(spark, rows), "")
    kept = {r["doc_id"]: r["lang"] for r in found.collect()}
    learned = langid.fit(documents(spark, rows))
    counts = {x: collections.Counter() for x in ("en", "de")}
    for _, t, x in rows:
        if x and t is not None:
            counts[x].update(plain_grams(t))

    def packed(g):
        code = 0
        for c in g:
            code = code << 21 | (0 if c == " " else ord(c))
        return code | (1 << 62 if len(g) == 2 else 0)

    rank = {x: {g: k for k, g in enumerate(sorted(n, key=lambda g: (-n[g], packed(g)))[:400])} for x, n in counts.items()}

    def judged(text):
        grams = plain_grams(text or "")
        if not grams:
            return None
        own = sorted(grams, key=lambda g: (-grams[g], packed(g)))[:400]
        away = {x: sum(abs(rank[x][g] - k) if g in rank[x] else 400 for k, g in enumerate(own)) for x in rank}
        best = min(sorted(away), key=away.get)
        return best if 1 - away[best] / (400 * len(own)) >= corpus_pipeline.LEAST_SCORE else None

    assert learned.languages == ["de", "en"]
    assert kept == {i: x for i, t, _ in rows if (x := judged(t))}
    assert kept[100] == "en" and kept[101] == "de" and not {102, 103, 104} & set(kept)


def test_language_id_judges_each_text_once(spark):
    found = corpus_pipeline.language_id(spark, documents(spark, [(k, words_of(np.random.default_rng(k), x, 20), x) for k, x in enumerate(["en", "de"] * 3)]), "")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [judge") == 1


def test_dedup_lines(spark):
    rnd = np.random.default_rng(2)
    lines = [words_of(rnd, "en", 8) for _ in range(12)]
    rows = []
    for k in range(40):
        some = [str(x) for x in rnd.choice(lines, 4)] + ["short line"]
        if k % 3 == 0:
            at = int(rnd.integers(len(some[0])))
            some[0] = some[0][:at] + "q" + some[0][at + k % 2 :]
        rows.append((k, "\n".join(some), "en"))
    found = corpus_pipeline.dedup_lines(spark, documents(spark, rows), "").collect()
    seen, expected = [], {}
    for i, text, _ in rows:
        kept = []
        for line in text.split("\n"):
            again = len(line) >= 24 and any(abs(len(line) - len(x)) <= 1 and levenshtein(line, x) <= 1 for x in seen)
            if len(line) >= 24:
                seen.append(line)
            if not again:
                kept.append(line)
        expected[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in found} == expected and all(r["n_chars"] == len(r["text"]) for r in found)


def test_near_dedup(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    texts = dict(rows)
    named = components(list(texts), lambda a, b: jaccard(texts[a] or "", texts[b] or "") >= 0.8)
    kept = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(named.values())) and all(r["text"] == texts[r["doc_id"]] for r in kept)


def test_redact(spark):
    texts = {
        1: "write to jo@example.org or call +1 988 555 2485 now",
        2: "card 4111 1111 1111 1111, not 4111 1111 1111 1112, from 10.0.0.255 or 10.0.0.256",
        3: "iban DE89 3704 0044 0532 0130 00 AND DE89 3704 0044 0532 0130 01; ssn 123-45-6789, number 123-45-6789",
        4: "nothing here",
        5: None,
        6: "a@b.c,d@e.f " * 300,
    }
    found = {r["doc_id"]: r for r in corpus_pipeline.redact(spark, documents(spark, [(i, t, "en") for i, t in texts.items()]), "").collect()}
    assert found[1]["text"] == "write to <EMAIL> or call <PHONE> now"
    assert found[2]["text"] == "card <CARD>, not 4111 1111 1111 1112, from <IP> or 10.0.0.256"
    assert re.fullmatch("iban <IBAN> AND DE89 3704 0044 0532 0130 01; ssn <SSN>, number (<SSN>|123-45-6789)", found[3]["text"])
    assert found[4]["text"] == "nothing here" and found[5]["text"] is None and found[6]["text"] == "<EMAIL>,<EMAIL> " * 300
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in found.values())


def test_pack(spark):
    rnd = np.random.default_rng(3)
    rows = [(k, words_of(rnd, "en", int(rnd.integers(1, 900))), "en") for k in range(30)]
    found = corpus_pipeline.pack(spark, documents(spark, rows), "").collect()
    sequences = collections.Counter()
    for r in found:
        sequences[r["sequence_id"]] += r["length"]
    assert sum(sequences.values()) == sum(len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    assert all(n <= 1024 and (n == 1024 or n & (n - 1) == 0) for n in sequences.values())


def test_pipeline_of_awkward_rows(spark, tmp_path):
    rows = pd.DataFrame([(i, t, "en" if t else None, "s", len(t or "")) for i, t in ROWS], columns=["doc_id", "text", "lang", "source", "n_chars"])
    rows["doc_id"] = rows["doc_id"].astype("Int64")
    rows.to_parquet(tmp_path / "documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in found} >= {0, 7, 8, 9} and not {3, 4, 5} & {r["doc_id"] for r in found}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "dedup_lines", "near_dedup", "redact", "pack"] and queries.queries()["pipeline"]
    (tmp_path / "none").mkdir()
    rows[:0].to_parquet(tmp_path / "none" / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
