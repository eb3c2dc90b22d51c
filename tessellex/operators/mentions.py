"""Mentions, their candidates and what models see of them; scores of links; neighbourhood graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from .tagging import bio_spans


def last_and_first_words(left: Column, right: Column, last: int = 25, first: int = 10) -> tuple[Column, Column]:
    """The last words of the left and the first of the right context."""
    words = F.split(left, " ", -1)
    return F.array_join(F.slice(words, F.greatest(F.size(words) - last, F.lit(0)) + 1, F.lit(last)), " "), F.array_join(F.slice(F.split(right, " ", -1), 1, first), " ")


def fitting(mentions: Column, most: int) -> Column:
    """Of mentions (start, end exclusive) in order, those that end within ``most`` tokens of the first one's start."""
    begin = F.get(mentions, F.lit(0))["start"]
    near = F.zip_with(mentions, F.array_repeat(begin, F.size(mentions)), lambda m, b: F.struct(m.alias("m"), (m["end"] - b <= most).alias("fits")))
    return F.transform(F.filter(near, lambda z: z["fits"]), lambda z: z["m"])


def mention_windows(df: DataFrame, tokens: str, mentions: str, most: int) -> DataFrame:
    """df with window (tokens) and shifted (mentions within it): trailing mentions that don't fit into ``most`` tokens go, and what room is left goes to both sides."""
    kept = df.withColumn("_kept", fitting(F.col(mentions), most))
    kept = kept.withColumn("_start", F.coalesce(F.get("_kept", F.lit(0))["start"], F.lit(0))).withColumn("_end", F.coalesce(F.array_max(F.transform("_kept", lambda m: m["end"])), F.lit(0)))
    left, right = T.context(F.col(tokens), F.col("_start"), F.col("_end"), most)
    kept = kept.withColumn("_left", left).withColumn("_right", right).withColumn("_off", F.col("_start") - F.size("_left"))
    window = F.concat("_left", F.slice(tokens, F.col("_start") + 1, F.col("_end") - F.col("_start")), "_right")
    moved = F.zip_with("_kept", F.array_repeat("_off", F.size("_kept")), lambda m, o: F.struct((m["start"] - o).alias("start"), (m["end"] - o).alias("end")))
    return kept.withColumn("window", window).withColumn("shifted", moved).drop("_kept", "_start", "_end", "_left", "_right", "_off")


def candidate_text(title: Column, description: Column, tag: str, most: int) -> Column:
    """Tokens of a candidate: title, tag, description, cut to leave room for two marks."""
    return F.slice(F.concat(F.split(title, " ", -1), F.array(F.lit(tag)), F.split(description, " ", -1)), 1, most - 2)


def truncated_pair(a: Column, b: Column, most: int) -> tuple[Column, Column]:
    """Two token arrays as they are after dropping from the end of the longer one (of equals the second) until both fit."""
    nb = F.least(F.size(b), F.greatest(F.lit(most // 2), most - F.size(a)))
    return F.slice(a, F.lit(1), F.least(F.size(a), most - nb)), F.slice(b, F.lit(1), nb)


def quoted_aliases(aliases: Column) -> Column:
    """Aliases in quotes, joined by blanks; characters beyond the basic plane go, empty ones too."""
    plain = F.transform(aliases, lambda a: F.trim(F.regexp_replace(a, r"[\x{10000}-\x{10FFFF}]", "")))
    return F.array_join(F.transform(F.filter(plain, lambda a: a != ""), lambda a: F.concat(F.lit('"'), a, F.lit('"'))), " ")


def cross_pairs(df: DataFrame, context: str, candidates: str, most: int) -> DataFrame:
    """A row for each candidate (token arrays) of a mention, with pos and pair: the context, then the candidate without its first token, cut."""
    return df.select("*", F.posexplode(candidates).alias("pos", "_c")).withColumn("pair", F.slice(F.concat(context, F.slice("_c", F.lit(2), F.greatest(F.size("_c") - 1, F.lit(0)))), 1, most)).drop("_c")


def candidate_priors(anchors: DataFrame, mentions: DataFrame) -> DataFrame:
    """(mention, entity, p): the share of each entity among the anchors spelled like the mention, in title case where that is the more frequent spelling, else as it is; if neither occurs, letter case aside.

    anchors: text, entity; mentions: mention, unique.
    """
    counts = anchors.groupBy("text", "entity").agg(F.count("*").alias("n"))
    totals = counts.groupBy("text").agg(F.sum("n").alias("all"))
    asked = mentions.select("mention", F.explode(F.array(F.struct(F.lit(0).alias("own"), F.initcap("mention").alias("text")), F.struct(F.lit(1).alias("own"), F.col("mention").alias("text")))).alias("t")).select("mention", "t.own", "t.text")
    best = asked.join(totals, "text").groupBy("mention").agg(F.max_by(F.struct("text", "all"), F.struct("all", -F.col("own"))).alias("b")).select("mention", "b.text", "b.all")
    exact = best.join(counts, "text").select("mention", "entity", (F.col("n") / F.col("all")).alias("p"))
    lower = counts.groupBy(F.lower("text").alias("low"), "entity").agg(F.sum("n").alias("n")).withColumn("all", F.sum("n").over(W.Window.partitionBy("low")))
    rest = mentions.join(best.select("mention"), "mention", "left_anti").withColumn("low", F.lower("mention")).join(lower, "low").select("mention", "entity", (F.col("n") / F.col("all")).alias("p"))
    return exact.unionByName(rest)


def coref_scores(pairs: DataFrame, priors: DataFrame) -> DataFrame:
    """(doc, mention, entity, score): the mean prior of an entity over the longer mentions that a mention is part of. pairs: doc, mention, full; priors: mention, entity, p."""
    per = pairs.groupBy("doc", "mention").agg(F.count_distinct("full").alias("n"))
    summed = pairs.select("doc", "mention", "full").distinct().join(priors.withColumnRenamed("mention", "full"), "full").groupBy("doc", "mention", "entity").agg(F.sum("p").alias("s"))
    return summed.join(per, ["doc", "mention"]).select("doc", "mention", "entity", (F.col("s") / F.col("n")).alias("score"))


def gold_rank(candidates: Column, gold: Column) -> Column:
    """The 1-based place of the gold candidate; -1 if it isn't there."""
    at = F.array_position(candidates, gold)
    return F.when(at > 0, at).otherwise(-1).cast("int")


def pruned(df: DataFrame, key: str, score: str, threshold: float, most: int) -> DataFrame:
    """The rows of each key whose score passes the threshold; where none does, its ``most`` best finite ones. df's (key, score) order is made total by the column id."""
    by = W.Window.partitionBy(key)
    rows = df.withColumn("_n", F.row_number().over(by.orderBy(F.desc(score), "id"))).withColumn("_any", F.max(F.col(score) >= threshold).over(by))
    return rows.filter(F.when(F.col("_any"), F.col(score) >= threshold).otherwise((F.col("_n") <= most) & (F.col(score) > float("-inf")))).drop("_n", "_any")


def tagged_phrases(df: DataFrame, key: str, lemmas: str, pos: str, tags: str, symbols: list[str] = ()) -> DataFrame:
    """(key, phrase, start, end): phrases of tagged spans, end inclusive, from lower-cased lemmas: none that begins or ends with a function word's tag, punctuation off but for listed phrases, none of a single word."""
    spans = bio_spans(df, key, tags).join(df.select(key, lemmas, pos), key)
    part = lambda c: F.slice(c, F.col("start") + 1, F.col("end") - F.col("start") + 1)
    bad = ("ADP", "DET", "CCONJ", "SCONJ", "PRON", "AUX")
    kept = spans.withColumn("_p", part(pos)).filter(~F.element_at("_p", 1).isin(*bad) & ~F.element_at("_p", -1).isin(*bad))
    phrase = T.strip_punctuation(F.lower(F.array_join(part(lemmas), " ")), list(symbols))
    return kept.select(key, phrase.alias("phrase"), "start", "end").filter(F.contains("phrase", F.lit(" ")))


def span_agreement(df: DataFrame, key: str, gold: str, predicted: str) -> DataFrame:
    """One row: b_precision (predicted B that are gold B), and the shares of gold spans that a predicted span of the sequence equals in length (loose) or in place (strict)."""
    each = df.select(F.explode(F.arrays_zip(F.col(gold).alias("g"), F.col(predicted).alias("p"))).alias("z"))
    b = each.agg(F.try_divide(F.count_if((F.col("z.p") == "B-FOT") & (F.col("z.g") == "B-FOT")), F.count_if(F.col("z.p") == "B-FOT")).alias("b_precision"))
    g, p = bio_spans(df, key, gold), bio_spans(df, key, predicted)
    size = (F.col("end") - F.col("start")).alias("size")
    sizes = p.select(key, size).distinct().withColumn("loose", F.lit(1))
    places = p.select(key, "start", "end").withColumn("strict", F.lit(1))
    found = g.withColumn("size", F.col("end") - F.col("start")).join(sizes, [key, "size"], "left").join(places, [key, "start", "end"], "left")
    return b.crossJoin(found.agg(F.avg(F.coalesce("loose", F.lit(0))).alias("loose"), F.avg(F.coalesce("strict", F.lit(0))).alias("strict")))


def thresholds(df: DataFrame, key: str, entity: str, score: str, correct: str, gold: int, values: list[float], most: int = 100) -> DataFrame:
    """(threshold, precision, recall, f1) for each value: of each key the best row of each entity, the first ``most`` by score, those that pass."""
    from .metrics import rates

    first = df.withColumn("_n", F.row_number().over(W.Window.partitionBy(key, entity).orderBy(F.desc(score), "id"))).filter("_n = 1")
    top = first.withColumn("_n", F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc(score), "id"))).filter(F.col("_n") <= most)
    counts = [F.struct(F.lit(v).alias("threshold"), F.count_if(F.col(score) >= v).alias("predicted"), F.count_if((F.col(score) >= v) & F.col(correct)).alias("tp")) for v in values]
    table = top.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return table.select("threshold", *rates(F.col("tp"), F.col("predicted"), F.lit(gold)))


def class_index(df: DataFrame, most: int = 10_000) -> DataFrame:
    """(class, layer, part, ids) over entities (id, codes, layer): a class is a code's first character, a missing layer counts as 3.

    The ids of a class and layer are dealt by a hash into as many sorted parts as keep them to about
    ``most`` each, so that no row and no task holds a whole class.
    """
    each = df.select("id", F.coalesce("layer", F.lit(3)).alias("layer"), F.explode(F.array_distinct(F.transform(F.filter("codes", lambda c: c != ""), lambda c: F.substring(c, 1, 1)))).alias("class"))
    sizes = each.groupBy("class", "layer").agg(F.ceil(F.count("*") / most).alias("parts"))  # as many rows as there are classes and layers
    dealt = each.join(F.broadcast(sizes), ["class", "layer"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    return dealt.groupBy("class", "layer", "part").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def star_edges(links: DataFrame, centre: str, target: str, order: str, most: int = 100, negatives: int = 0, seed: int = 42) -> DataFrame:
    """(graph, node, place, label): each centre's first ``most`` different neighbours in page order, label 1; and for each graph ``negatives`` copies of its places filled with targets that a hash draws from all, label 0.

    A drawn target is looked up by its number among all targets, so no two tables are crossed.
    """
    from .ids import dense_ids

    first = links.groupBy(centre, target).agg(F.min(order).alias("_o"))
    ranked = first.withColumn("place", F.row_number().over(W.Window.partitionBy(centre).orderBy("_o", target))).filter(F.col("place") <= most)
    own = ranked.select(F.col(centre).cast("string").alias("graph"), F.col(target).alias("node"), "place", F.lit(1).alias("label"))
    if not negatives:
        return own
    pool = dense_ids(links.select(F.col(target).alias("node")).distinct(), ["node"], "number", 0)
    n = pool.count()
    drawn = own.select("graph", "place", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("copy")).withColumn("number", F.pmod(F.crc32(F.concat_ws("|", "graph", F.col("place").cast("string"), F.col("copy").cast("string"), F.lit(str(seed)))), F.lit(n)))
    fakes = drawn.join(pool, "number").select(F.concat_ws("#", "graph", F.col("copy").cast("string")).alias("graph"), "node", "place", F.lit(0).alias("label"))
    return own.unionByName(fakes)


def graph_classifier(vectors: DataFrame, graphs: DataFrame, train: DataFrame):
    """A fitted classifier of graphs: the mean of their nodes' vectors through logistic regression. Gives (model, features of all graphs)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    pooled = graphs.join(vectors.select("node", array_to_vector(F.col("v")).alias("f")), "node").groupBy("graph").agg(Summarizer.mean(F.col("f")).alias("features"))
    return LogisticRegression(maxIter=50, regParam=0.01).fit(pooled.join(train, "graph")), pooled


def in_batch_accuracy(df: DataFrame, batch: str, row: str, scores: str) -> DataFrame:
    """(batch, accuracy): how often a row's best score is the one at its own place; the first of equals is the best."""
    hit = F.array_position(scores, F.array_max(scores)) - 1 == F.col(row)
    return df.groupBy(batch).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("accuracy"))


def annotated(tokens: Column, tags: Column) -> Column:
    """Tokens in one line, each tagged one with its tag's first letter in brackets."""
    return F.array_join(F.zip_with(tokens, tags, lambda w, t: F.when(t == "O", w).otherwise(F.concat(F.lit("["), F.substring(t, 1, 1), F.lit(":"), w, F.lit("]")))), " ")
