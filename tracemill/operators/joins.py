"""Joins and lookups (survey J1-J23). Keys that are null match nothing unless a docstring says otherwise.

No side is broadcast by hint: Catalyst and AQE choose by measured size. `lookup` may hint after measuring the small side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def keep_matching(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of left with a partner in right, columns and duplicates of left unchanged."""
    on = [on] if isinstance(on, str) else on
    return left.join(right.select(on), on, "left_semi")


def drop_matching(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of left without a partner in right; null keys of left stay."""
    on = [on] if isinstance(on, str) else on
    return left.join(right.select(on), on, "left_anti")


def resume(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """R4, R5 by key: items not yet in the output. Positions are not used, since failures never reach the output."""
    return drop_matching(work, done, key)


def escalate(first: DataFrame, second: DataFrame, key: str, good: Column, first_name: str = "first", second_name: str = "second") -> DataFrame:
    """All good rows of first, and good rows of second whose key first has not solved, one per key (lowest row by all columns).

    A row of first that is not good does not shut out second. Rows with a null key are kept from first and left out of second.
    """
    ok = first.where(good)
    rest = second.where(good & F.col(key).isNotNull()).join(ok.select(key), key, "left_anti")
    one = rest.groupBy(key).agg(F.min(F.struct(*rest.columns)).alias("r")).select("r.*")
    return ok.withColumn("origin", F.lit(first_name)).unionByName(one.withColumn("origin", F.lit(second_name)), allowMissingColumns=True)


def interval_join(points: DataFrame, spans: DataFrame, on: list[str], point: str, start: str, end: str, slack_days: int = 1) -> DataFrame:
    """Inner on keys with point between start and end plus slack, by date. One hash or sort-merge join with the range as residual."""
    p = F.to_date(F.col(point))
    cond = (p >= F.to_date(F.col(start))) & (p <= F.date_add(F.to_date(F.col(end)), slack_days))
    return points.join(spans, on).where(cond)


def lookup(df: DataFrame, dim: DataFrame, on: list[str], take: dict[str, Column]) -> DataFrame:
    """Left join to a dimension with fallbacks. take: column -> expression for a missing or null value.

    The reduced dimension is measured first and hinted only if its rows and bytes are few (session.broadcast_if_small). Its keys must be unique; duplicates are reduced
    to the smallest row, so no row of df multiplies.
    """
    d = dim.groupBy(*on).agg(*(F.min(c).alias(f"__{c}") for c in take))
    d = broadcast_if_small(d)
    x = df.join(d, on, "left")
    return x.withColumns({c: F.coalesce(f"__{c}", e) for c, e in take.items()}).drop(*(f"__{c}" for c in take))


def grouped(df: DataFrame, key: list[str], name: str, *cols: str) -> DataFrame:
    """One row per key with its rows as a sorted array of structs, aggregated before any join."""
    return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))


def with_predictions(meta: DataFrame, results: DataFrame, key: str, pred: str = "pred") -> DataFrame:
    """Every item with its prediction, '' where there is none, so unanswered items count."""
    return meta.join(results.select(key, pred), key, "left").withColumn(pred, F.coalesce(pred, F.lit("")))


def zip_by_order(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """N-th row with n-th row under explicit total orders; the longer side's rest is dropped.

    Positions come from range-sorted partitions whose sizes are counted first, not from one global window.
    """
    return numbered(left, left_order, "__pos").join(numbered(right, right_order, "__pos"), "__pos").drop("__pos")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds consecutive numbers from 0 in a total order: range partitions, their counts (one row each), then a number within."""
    from pyspark.sql import Window

    from ..session import cut_lineage

    s = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    s = cut_lineage(s)  # partition numbers must not change between the two uses
    counts = s.groupBy("__part").count()
    before = counts.withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count")).select("__part", "__before")
    w = Window.partitionBy("__part").orderBy(*order)
    return s.join(before, "__part").withColumn(name, F.col("__before") + F.row_number().over(w) - 1).drop("__part", "__before")


def compare_predictors(ours: DataFrame, other: DataFrame, third: DataFrame, key: str, ok: str = "score") -> DataFrame:
    """Rows both main predictors have, with the third's answer or 'MISSING' text, and a fallback score."""
    x = ours.select(key, F.col(ok).alias("ours")).join(other.select(key, F.col(ok).alias("other")), key)
    return x.join(third.select(key, F.col(ok).cast("string").alias("third")), key, "left").withColumn("third", F.coalesce("third", F.lit("MISSING")))


def key_by_containment(names: Column, wanted: Column) -> Column:
    """The first key (by name) that contains the wanted text or is contained in it; null if none."""
    low = F.lower(F.trim(wanted))
    hit = F.array_sort(F.filter(names, lambda k: F.lower(k).contains(low) | low.contains(F.lower(k))))
    return F.get(hit, F.lit(0))


def letter_by_text(options: Column, value: Column) -> Column:
    """The letter whose option text equals the value, both trimmed and in lower case."""
    rev = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(options), lambda e: F.struct(F.lower(F.trim(e["value"])), e["key"]))))
    return F.element_at(rev, F.lower(F.trim(value)))
