"""Near-duplicates by the Jaccard similarity of character n-gram sets: exact, without all pairs of a cluster.

Prefix filter: of m grams in order of rarity, two sets that reach the threshold share one of the first m - ceil(t m) + 1.
They even share many of those: what lies behind the earlier end of both prefixes can't make up for it. So candidates are
pairs with enough prefix grams in common, and few of them fail the comparison of the sets. Equal texts are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwork.functions.text import ngrams
from loomwork.operators import similar
from loomwork.operators.graph import components
from loomwork.operators.joins import small_enough
from loomwork.operators.store import stored

#: A gram with more texts than this is crowded: there, texts are first compared with one of them only.
CROWD = 32
#: Rounds of such comparisons before those that are left are made.
STARS = 2


def text_key(text: str) -> Column:
    """What stands for a text: a 64-bit hash."""
    return F.xxhash64(text)


def gram_sets(frames: list[DataFrame], text: str, n: int) -> DataFrame:
    """(t, l, g, s0, s1, ...): the different texts of all frames with length and gram set, and whether each frame holds it; null texts go."""
    marked = [f.select(F.col(text).alias("x"), *(F.lit(i == k).alias(f"s{k}") for k in range(len(frames)))) for i, f in enumerate(frames)]
    every = reduce(DataFrame.unionByName, marked).filter("x IS NOT NULL")
    one = every.groupBy(text_key("x").alias("t")).agg(F.first("x").alias("x"), *(F.max(f"s{k}").alias(f"s{k}") for k in range(len(frames))))
    return stored(one.select("t", F.length("x").alias("l"), F.transform(ngrams("x", n), lambda g: F.xxhash64(g)).alias("g"), *(f"s{k}" for k in range(len(frames)))))


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(g, t, l, m, p, s0, ...) of each gram in a text's prefix of p grams that another text has too, with its number of texts df."""
    marks = [c for c in sets.columns if c.startswith("s")]
    grams = sets.select("t", "l", F.size("g").alias("m"), *marks, F.explode("g").alias("g"))
    shared = grams.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = grams.join(shared, "g", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("_rn", F.row_number().over(W.partitionBy("t").orderBy("df", "g")))
    p = F.col("m") - F.ceil(F.lit(threshold) * F.col("m")) + 1
    return stored(ranked.withColumn("p", p.cast("int")).filter((F.col("_rn") <= F.col("p")) & (F.col("df") > 1)).select("g", "df", "t", "l", "m", "p", *marks))


def _side(entries: DataFrame, name: str, *more: str) -> DataFrame:
    return entries.select("g", *(F.col(c).alias(f"{name}{c}") for c in ("t", "l", "m", "p", *more)))


def _fits(threshold: float, ratio: tuple[float, float], either: bool) -> Column:
    """Sizes that can reach the threshold, and lengths in the ratio (one way or, with ``either``, one of both)."""
    way = lambda a, b: F.try_divide(F.col(a), F.greatest(F.lit(1), F.col(b))).between(*ratio)
    lengths = way("al", "bl") | way("bl", "al") if either else way("al", "bl")
    return (F.least("am", "bm") >= F.lit(threshold) * F.greatest("am", "bm")) & lengths


def _enough(threshold: float) -> Column:
    """Whether n common prefix grams and all of the rest of the set whose prefix ends first could make up the overlap that the threshold takes."""
    need = F.ceil(F.lit(threshold) / (1 + F.lit(threshold)) * (F.col("am") + F.col("bm")) - 1e-9)
    return F.col("n") + F.greatest(F.col("am") - F.col("ap"), F.col("bm") - F.col("bp")) >= need


def _counted(met: DataFrame) -> DataFrame:
    return met.groupBy("at", "al", "am", "ap", "bt", "bl", "bm", "bp").agg(F.count("*").alias("n"))


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(at, al, bt, bl, jaccard) of those pairs whose sets reach the threshold. Only sets that are in a pair are shuffled, if those are few."""
    pairs = stored(pairs.select("at", "al", "bt", "bl"))
    ids = pairs.select(F.explode(F.array("at", "bt")).alias("t")).distinct()
    if small_enough(ids):
        sets = sets.join(F.broadcast(ids), "t", "left_semi")
    a = sets.select(F.col("t").alias("at"), F.col("g").alias("ag"))
    b = sets.select(F.col("t").alias("bt"), F.col("g").alias("bg"))
    common = F.size(F.array_intersect("ag", "bg"))
    found = pairs.join(a, "at").join(b, "bt").withColumn("jaccard", common / (F.size("ag") + F.size("bg") - common))
    return found.filter(F.col("jaccard") >= threshold).select("at", "al", "bt", "bl", "jaccard")


def near_evaluation(df: DataFrame, evaluation: DataFrame, text: str, threshold: float = 0.85, n: int = 5, ratio: tuple[float, float] = (0.75, 1.33)) -> DataFrame:
    """``df`` with near_evaluation: whether some text of ``evaluation`` has a similarity of ``threshold`` or more to the row's, and a length in ``ratio`` to it (the row's over the other's).

    ``text`` is a normal form in both. An equal text counts, an empty one too; a null one is near nothing.
    """
    sides = [f.select(text_key(text).alias("t"), F.lit(side).alias("side"), F.col(text).alias("x")) for f, side in ((df, 1), (evaluation, 2))]
    near = similar.similar(sides[0].unionByName(sides[1]), threshold, n).filter(F.try_divide("al", F.greatest(F.lit(1), "bl")).between(*ratio)).select("at")
    same = sides[1].filter("x IS NOT NULL").select(F.col("t").alias("at"))
    found = stored(near.unionByName(same).distinct().withColumnRenamed("at", "_t"))
    rows = df.withColumn("_t", text_key(text))
    found = found.withColumn("_near", F.lit(True))
    out = rows.join(F.broadcast(found) if small_enough(found) else found, "_t", "left")
    return out.withColumn("near_evaluation", F.coalesce(F.col("_near") & F.col(text).isNotNull(), F.lit(False))).select(*df.columns, "near_evaluation")


def _all_links(df: DataFrame, text: str, threshold: float, n: int, ratio: tuple[float, float]) -> DataFrame:
    """(at, al, bt, bl, jaccard) of all pairs of different texts with the similarity, lengths in ``ratio`` one way or the other."""
    way = lambda a, b: F.try_divide(F.col(a), F.greatest(F.lit(1), F.col(b))).between(*ratio)
    return similar.similar(df.select(text_key(text).alias("t"), F.lit(3).alias("side"), F.col(text).alias("x")), threshold, n).filter(way("al", "bl") | way("bl", "al"))


def near_pairs(df: DataFrame, id_col: str, text: str, threshold: float = 0.85, n: int = 5, ratio: tuple[float, float] = (0.75, 1.33)) -> DataFrame:
    """(id_a, id_b, jaccard) of near-duplicate classes, each by the least id of its text; id_a is the lesser.

    The length ratio holds for id_a's text over id_b's. Rows of equal text are one class (see :func:`near_groups` for
    membership), so copies are not expanded; all links between different texts are there.
    """
    links = _all_links(df, text, threshold, n, ratio)
    first = stored(df.filter(F.col(text).isNotNull()).groupBy(text_key(text).alias("t")).agg(F.min(id_col).alias("id")))
    out = links.join(first.select(F.col("t").alias("at"), F.col("id").alias("_a")), "at").join(first.select(F.col("t").alias("bt"), F.col("id").alias("_b")), "bt")
    long, short = F.when(F.col("_a") < F.col("_b"), F.col("al")).otherwise(F.col("bl")), F.when(F.col("_a") < F.col("_b"), F.col("bl")).otherwise(F.col("al"))
    out = out.filter(F.try_divide(long, F.greatest(F.lit(1), short)).between(*ratio))
    return out.select(F.least("_a", "_b").alias(f"{id_col}_a"), F.greatest("_a", "_b").alias(f"{id_col}_b"), "jaccard")


def near_groups(df: DataFrame, id_col: str, text: str, threshold: float = 0.85, n: int = 5, ratio: tuple[float, float] = (0.75, 1.33)) -> DataFrame:
    """(id, class_id, group_id) of each row: the least id of its text, and the least id that near-duplicates lead to.

    Texts link if their similarity is ``threshold`` or more and their lengths are in ``ratio`` one way or the other. A row
    with a null text is a class and a group of its own. Where a gram is crowded, its texts are first compared with one of them;
    what that joins is not compared again. Then, in each gram, the texts outside its largest group are compared with all those
    of other groups: every link either is found or lies within a group. So near copies of each other cost in proportion to
    their number.
    """
    sets = gram_sets([df], text, n)
    entries = prefixes(sets, threshold)
    links, groups = None, None
    for k in range(STARS + 1):
        labelled = entries if groups is None else entries.join(groups, "t", "left")
        labelled = labelled.withColumn("c", F.col("t") if groups is None else F.coalesce("label", "t")).drop("label")
        if k < STARS:
            crowded = labelled.filter(F.col("df") > CROWD)
            hubs = crowded.groupBy("g").agg(F.min_by(F.struct("t", "l", "m", "p", "c"), F.xxhash64("t", F.lit(k))).alias("h")).select("g", *(F.col(f"h.{c}").alias(f"b{c}") for c in ("t", "l", "m", "p", "c")))
            met = _side(crowded, "a", "c").join(hubs, "g").filter("ac <> bc")
            pairs = _counted(met.filter(_fits(threshold, ratio, True))).filter("n > 1 AND 5 * n >= least(ap, bp)")  # likely ones; none is lost, the last round has the others
        else:
            cells = stored(labelled)
            many = cells.groupBy("g", "c").agg(F.count("*").alias("_k")).groupBy("g").agg(F.count("*").alias("_groups"), F.max_by("c", F.struct("_k", "c")).alias("_most")).filter("_groups > 1")
            cells = stored(cells.join(many.select("g", "_most"), "g"))
            met = _side(cells.filter("c <> _most"), "a", "c", "_most").join(_side(cells, "b", "c"), "g").filter("ac <> bc AND (bc = a_most OR at < bt)")
            lesser = F.col("at") < F.col("bt")  # a pair comes the same way round from every gram
            met = met.filter(_fits(threshold, ratio, True)).select(*(F.when(lesser, F.col(f"{x}{c}")).otherwise(F.col(f"{y}{c}")).alias(f"{x}{c}") for x, y in ("ab", "ba") for c in ("t", "l", "m", "p")))
            pairs = _counted(met).filter(_enough(threshold))
        found = stored(compared(pairs, sets, threshold).select(F.col("at").alias("a"), F.col("bt").alias("b")))
        if k < STARS and not found.limit(1).count() and k:
            continue
        links = found if links is None else links.unionByName(found)
        groups = stored(components(links).withColumnRenamed("node", "t"))
    first = df.filter(F.col(text).isNotNull()).groupBy(text_key(text).alias("t")).agg(F.min(id_col).alias("class_id")).join(groups, "t", "left").withColumn("label", F.coalesce("label", "t"))
    first = stored(first)
    least = first.groupBy("label").agg(F.min("class_id").alias("group_id"))
    members = stored(first.join(least, "label").select(F.col("t").alias("_t"), "class_id", "group_id"))
    rows = df.select(F.col(id_col), F.when(F.col(text).isNotNull(), text_key(text)).alias("_t"))
    out = rows.join(F.broadcast(members) if small_enough(members) else members, "_t", "left")
    return out.select(id_col, F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("group_id", id_col).alias("group_id"))


def near_links(df: DataFrame, id_col: str, text: str, threshold: float = 0.85, n: int = 5, ratio: tuple[float, float] = (0.75, 1.33)) -> DataFrame:
    """:func:`near_groups` with n_links, the number of other texts that the row's text links with: all links are worked out for it."""
    links = stored(_all_links(df, text, threshold, n, ratio).select(F.col("at").alias("a"), F.col("bt").alias("b")))
    groups = components(links).withColumnRenamed("node", "t")
    degree = links.select(F.explode(F.array("a", "b")).alias("t")).groupBy("t").agg(F.count("*").alias("n_links"))
    first = df.filter(F.col(text).isNotNull()).groupBy(text_key(text).alias("t")).agg(F.min(id_col).alias("class_id"))
    first = stored(first.join(groups, "t", "left").join(degree, "t", "left").withColumn("label", F.coalesce("label", "t")))
    least = first.groupBy("label").agg(F.min("class_id").alias("group_id"))
    members = stored(first.join(least, "label").select(F.col("t").alias("_t"), "class_id", "group_id", "n_links"))
    rows = df.select(F.col(id_col), F.when(F.col(text).isNotNull(), text_key(text)).alias("_t"))
    out = rows.join(F.broadcast(members) if small_enough(members) else members, "_t", "left")
    return out.select(id_col, F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("group_id", id_col).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
