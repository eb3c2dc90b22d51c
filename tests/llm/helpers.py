"""Small tables with every awkward case: nulls, empty and very long texts, repeated rows, extra columns."""

import pandas as pd

SMALL = "/root/testdata/sf0.001"
BASE = "The quick brown fox jumps over the lazy dog while seven wise owls look on from the old oak tree near the river"
TEXTS = {
    0: BASE + ".\nA second line that is long enough to count as one here.\nshort",
    1: BASE + "!\nA second line that is long enough to count as one there.\nshort",
    2: BASE + ".\nA second line that is long enough to count as one here.\nshort",
    3: None,
    4: "",
    5: "   \n\t ",
    6: "x" * 30_000 + " y" * 3000,
    7: "Write to bo.b@mail.example.com or +1 (988) 555-2485, card 4111 1111 1111 1111, host 10.0.0.255",
    8: "日本語のテキスト ﬁ ½ é é 😀 " * 3,
    9: "one",
    10: "one",
    11: BASE.replace("lazy", "sleepy") + ".\nAnother line that differs from all of the others in this table.",
}
ROWS = [(i, t) for i, t in TEXTS.items()] + [(2, TEXTS[2]), (None, "a row without an id, and with some words of its own")]


def documents(spark, rows=ROWS):
    """doc_id, text and columns named like results of the operators."""
    return spark.createDataFrame([(i, t, "en", "x", 1.5, "r", 7, "z") for i, t in rows], "doc_id long, text string, lang string, lang_pred string, score double, fingerprint string, n_tokens int, component_id string").repartition(3)


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def components(nodes, linked):
    """The smallest node of each node's component, by comparing all pairs."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def frame(spark, rows, schema):
    return spark.createDataFrame(pd.DataFrame(rows), schema) if rows else spark.createDataFrame([], schema)
