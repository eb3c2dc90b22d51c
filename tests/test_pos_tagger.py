"""The tagger against a plain version on generated tagged text, and what it learns."""

import math
from collections import Counter

import numpy as np
import pytest

from tessellex.operators import pos_tagger
from tessellex.session import prepare

TAGS = ["ADJ", "DET", "NOUN", "VERB"]
NEXT = {"": [0.1, 0.6, 0.2, 0.1], "ADJ": [0.2, 0.0, 0.7, 0.1], "DET": [0.4, 0.0, 0.6, 0.0], "NOUN": [0.1, 0.1, 0.2, 0.6], "VERB": [0.2, 0.5, 0.2, 0.1]}
ENDINGS = {"ADJ": "ous", "NOUN": "tion", "VERB": "ize"}


def sentences(rnd, n, words):
    out = []
    for _ in range(n):
        tags, before = [], ""
        for _ in range(int(rnd.integers(3, 12))):
            before = str(rnd.choice(TAGS, p=NEXT[before]))
            tags.append(before)
        tokens = [str(rnd.choice(["the", "a", "this"])) if t == "DET" else f"w{int(rnd.zipf(1.4)) % words}" + (ENDINGS[t] if rnd.random() < 0.7 else "x") for t in tags]
        out.append((tokens, tags))
    return out


def plain_tagger(train):
    """Counts in dictionaries, and the best path by trying every tag at every place."""
    each = Counter((w, t) for tokens, tags in train for w, t in zip(tokens, tags))
    totals, seen = Counter(), Counter()
    for (w, t), n in each.items():
        totals[t] += n
        seen[w] += n
    names, every = sorted(totals), sum(totals.values())
    suffix = Counter()
    for (w, t), n in each.items():
        if seen[w] <= 10:
            for k in range(1, min(4, len(w)) + 1):
                suffix[w[-k:], t] += n
    pairs = Counter(p for _, tags in train for p in zip(["", *tags], [*tags, ""]))
    turn = lambda a, b: math.log((pairs[a, b] + 1) / sum(pairs[a, c] + 1 for c in ["", *names]))

    def score(w, t):
        if seen[w]:
            return math.log((each[w, t] + 0.01 * totals[t] / every) / (seen[w] + 0.01) / (totals[t] / every))
        for k in range(min(4, len(w)), 0, -1):
            s = w[-k:]
            held = sum(suffix[s, c] for c in names)
            if held:
                share = totals[t] / every
                return math.log((suffix[s, t] + share) / (held + 1) / share)
        return 0.0

    def tag(tokens):
        best = {t: (turn("", t) + score(tokens[0], t), [t]) for t in names}
        for w in tokens[1:]:
            best = {t: max(((s + turn(p[-1], t) + score(w, t), [*p, t]) for s, p in best.values()), key=lambda x: x[0]) for t in names}
        return max(((s + turn(p[-1], ""), p) for s, p in best.values()), key=lambda x: x[0])[1]

    return tag


def test_tagger_equals_a_plain_one(spark):
    prepare(spark)
    rnd = np.random.default_rng(15)
    train, held = sentences(rnd, 400, 300), sentences(rnd, 150, 600)
    tagger = pos_tagger.fit(spark.createDataFrame(train, "w array<string>, t array<string>").repartition(3), "w", "t")
    df = spark.createDataFrame([(k, tokens) for k, (tokens, _) in enumerate(held)] + [(900, []), (901, None), (902, ["qqq"])], "number long, w array<string>")
    found = pos_tagger.tag(df, tagger, "w")
    assert found.columns == ["number", "w", "tags"]
    rows = {r["number"]: r["tags"] for r in found.collect()}
    plain = plain_tagger(train)
    own = [rows[k] for k in range(len(held))]
    assert sum(a == plain(tokens) for a, (tokens, _) in zip(own, held)) >= len(held) - 1  # sums in another order may break a tie otherwise
    right = sum(a == b for x, (_, y) in zip(own, held) for a, b in zip(x, y)) / sum(len(y) for _, y in held)
    common = Counter(t for _, y in held for t in y).most_common(1)[0][1] / sum(len(y) for _, y in held)
    assert right > 0.85 > common
    assert rows[900] == [] and rows[901] is None and len(rows[902]) == 1
    with pytest.raises(ValueError):
        pos_tagger.fit(spark.createDataFrame([], "w array<string>, t array<string>"), "w", "t")


def test_words_meet_chunks_of_rows_and_not_each_token(spark, monkeypatch):
    prepare(spark)
    rnd = np.random.default_rng(16)
    tagger = pos_tagger.fit(spark.createDataFrame(sentences(rnd, 100, 80), "w array<string>, t array<string>"), "w", "t")
    rows = [(k, tokens) for k, (tokens, _) in enumerate(sentences(rnd, 40, 120))] + [(900, []), (901, None), (902, ["the", None, "the"]), (903, ["the"] * 300)]
    told = []
    for chunk in (1 << 20, 25):
        monkeypatch.setattr(pos_tagger, "CHUNK_TOKENS", chunk, raising=False)
        found = pos_tagger.tag(spark.createDataFrame(rows, "number long, w array<string>").coalesce(2), tagger, "w")
        assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
        told.append({r["number"]: r["tags"] for r in found.collect()})
    assert told[0] == told[1] and set(told[0]) == {k for k, _ in rows}
    assert told[0][900] == [] and told[0][901] is None and all(len(told[0][k]) == len(w) for k, w in rows if w)
