"""Aggregations and metrics (survey A1-A19): partial aggregation before every shuffle, ties broken explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(df: DataFrame, *by: Column) -> DataFrame:
    """A1: rows per value, null as its own value."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def tag_frequencies(df: DataFrame, tags: str) -> DataFrame:
    """A1 on an array column; null and empty arrays add nothing."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def most_common(df: DataFrame, by: Column, n: int) -> DataFrame:
    """A2: the n most frequent values, equal counts by value."""
    return df.groupBy(by.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def pattern(names: Column) -> Column:
    """A3: names joined by ' -> ', null and blank ones left out."""
    return F.array_join(F.filter(names, lambda x: x.isNotNull() & (F.trim(x) != "")), " -> ")


def accuracy(score: Column) -> Column:
    """A4: mean, 0 for no rows."""
    return F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6)


def totals_and_groups(df: DataFrame, group: str, measures: dict[str, Column], unknown: str = "unknown", overall: str = "all") -> DataFrame:
    """Measures over all rows and per group in one pass (grouping sets); null groups count as `unknown`. No rows give no totals."""
    x = df.withColumn(group, F.coalesce(F.col(group), F.lit(unknown)))
    g = x.rollup(group).agg(F.grouping(group).alias("__g"), *(c.alias(k) for k, c in measures.items()))
    return g.withColumn(group, F.when(F.col("__g") == 1, overall).otherwise(F.col(group))).drop("__g")


def confusion(pred: Column, gold: Column, positive: str = "yes") -> dict[str, Column]:
    """Tp, fp, tn, fn, precision, recall, f1, accuracy and yes_ratio as aggregates; 0 where a denominator is 0."""
    p, g = F.coalesce(pred == positive, F.lit(False)), F.coalesce(gold == positive, F.lit(False))
    tp, fp, tn, fn = F.count_if(p & g), F.count_if(p & ~g), F.count_if(~p & ~g), F.count_if(~p & g)
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return {"tp": tp, "fp": fp, "tn": tn, "fn": fn, "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "accuracy": div(tp + tn, tp + fp + tn + fn), "yes_ratio": div(tp + fp, tp + fp + tn + fn)}


def soft_accuracy(pred: Column, answers: Column) -> Column:
    """A10: each annotator left out once, min(1, matches of the others / 3), averaged; 0 without annotators."""
    n = F.size(answers)
    hits = F.size(F.filter(answers, lambda a: a == pred))
    own = lambda a: F.least(F.lit(1.0), (hits - F.when(a == pred, 1).otherwise(0)) / 3)
    return F.when(n > 0, F.aggregate(answers, F.lit(0.0), lambda s, a: s + own(a)) / n).otherwise(0.0)


def anls(pred: Column, golds: Column, floor: float = 0.5) -> Column:
    """The best 1 - edit distance / longer length over the golds, 0 below the floor; two empty strings give 0."""
    p = F.lower(F.trim(pred))
    one = lambda g: F.coalesce(F.try_divide(F.levenshtein(p, F.lower(F.trim(g))).cast("double"), F.greatest(F.length(p), F.length(F.lower(F.trim(g))))), F.lit(1.0))
    best = F.coalesce(F.array_max(F.transform(golds, lambda g: 1 - one(g))), F.lit(0.0))
    return F.when(best >= floor, best).otherwise(0.0)


def bleu4(df: DataFrame, pred: str, gold: str, group: list[str]) -> DataFrame:
    """Corpus BLEU-4 per group from clipped n-gram counts summed over rows, on lower-case words; no smoothing."""
    def words(c: str) -> Column:
        return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+"), lambda w: w != "")

    def grams(c: str, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.array_join(F.slice(c, i, n), " "))
        return F.when(F.size(c) >= n, made).otherwise(F.array().cast("array<string>"))

    def clipped(p: str, g: str) -> Column:
        times = lambda arr, v: F.size(F.filter(arr, lambda y: y == v))
        return F.aggregate(F.array_distinct(p), F.lit(0), lambda s, v: s + F.least(times(F.col(p), v), times(F.col(g), v)))

    x = df.select(*group, words(pred).alias("p"), words(gold).alias("g"))
    sums = [F.sum(F.size("p")).alias("lp"), F.sum(F.size("g")).alias("lg")]
    for n in range(1, 5):
        x = x.withColumns({f"p{n}": grams("p", n), f"g{n}": grams("g", n)})
        sums += [F.sum(clipped(f"p{n}", f"g{n}")).alias(f"m{n}"), F.sum(F.size(f"p{n}")).alias(f"t{n}")]
    y = x.groupBy(*group).agg(*sums)
    logs = sum((F.log(F.when(F.col(f"m{n}") > 0, F.col(f"m{n}") / F.col(f"t{n}"))) for n in range(1, 5)), F.lit(0.0)) / 4
    brevity = F.when(F.col("lp") >= F.col("lg"), 1.0).otherwise(F.exp(1 - F.col("lg") / F.col("lp")))
    return y.select(*group, F.round(F.coalesce(brevity * F.exp(logs), F.lit(0.0)), 6).alias("bleu4"))


def running_accuracy(df: DataFrame, order: list[str], score: str, by: list[str]) -> DataFrame:
    """Accuracy of the rows up to each one in a total order, within `by`; null scores do not count.

    Two levels, so a hot group is no single task: rows are range-partitioned by group and order, each partition's sums
    per group are added up before the running sum is taken inside a partition.
    """
    from ..session import cut_lineage

    s = cut_lineage(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))  # partition numbers must not change
    per = s.groupBy(*by, "__part").agg(F.sum(score).alias("__s"), F.count(score).alias("__n"))
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "__part", F.coalesce(F.sum("__s").over(w), F.lit(0.0)).alias("__s"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__n"))
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "__part"]]
    x = s.alias("l").join(per.alias("r"), same).select("l.*", "r.__s", "r.__n")
    mean = F.try_divide(F.col("__s") + F.coalesce(F.sum(score).over(inside), F.lit(0.0)), F.col("__n") + F.count(score).over(inside))
    return x.withColumn("running", F.round(mean, 6)).drop("__part", "__s", "__n")


def majority(df: DataFrame, key: str, vote: str, first: str) -> DataFrame:
    """The most frequent vote per key; ties go to the vote seen first by `first`. Null votes do not count.

    Votes are counted per (key, vote) first, so a hot key is spread over its votes before the last step.
    """
    c = df.where(F.col(vote).isNotNull()).groupBy(key, vote).agg(F.count("*").alias("n"), F.min(first).alias("at"))
    return c.groupBy(key).agg(F.max_by(vote, F.struct("n", (-F.col("at").cast("double")).alias("m"))).alias("majority"), F.max("n").alias("votes"))


def nested_first(df: DataFrame, key: list[str], outer: str, inner: str, value: str, order: list[str]) -> DataFrame:
    """Per key a map outer -> map inner -> value, the first value by order, keys sorted; null outer, inner and value left out."""
    first = df.where(F.col(outer).isNotNull() & F.col(inner).isNotNull() & F.col(value).isNotNull()).groupBy(*key, outer, inner).agg(F.min_by(value, F.struct(*order)).alias(value))
    per = first.groupBy(*key, outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, value)))).alias("m"))
    by_name = lambda a, b: F.when(a[outer] < b[outer], -1).when(a[outer] > b[outer], 1).otherwise(0)
    return per.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(outer, "m")), by_name)).alias("results"))


def text_by_key(items: Column, key: str, text: str, sep: str = "\n") -> Column:
    """Map from each distinct key of an array of structs to its texts joined in order; null texts count as ''."""
    keys = F.array_distinct(F.transform(items, lambda x: F.coalesce(x[key], F.lit(""))))
    join = lambda k: F.array_join(F.transform(F.filter(items, lambda x: F.coalesce(x[key], F.lit("")) == k), lambda x: F.coalesce(x[text], F.lit(""))), sep)
    return F.map_from_arrays(keys, F.transform(keys, join))


def rate(cond: Column) -> Column:
    """Share of rows, 0 for none."""
    return F.round(F.coalesce(F.count_if(cond) / F.count("*"), F.lit(0.0)), 6)


def sample_length(texts: Column, has_image: Column, image_words: int = 128) -> Column:
    """Words of all turns plus a constant for an image; negative for text-only samples."""
    n = F.aggregate(texts, F.lit(0), lambda s, t: s + F.when(F.trim(F.coalesce(t, F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+"))))
    return F.when(has_image, n + image_words).otherwise(-n)
