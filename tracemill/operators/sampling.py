"""Windows, de-duplication, caps and deterministic sampling (survey W1-W16, L1, L2, U1-U4).

Chance is replaced by order under md5(seed|key), which gives equal results on any partitioning; keep probabilities use
its first eight hex digits. Counts, caps and ratios are those of the survey.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def luck(seed: int | str, *key: Column) -> Column:
    """A hex string that orders rows at random but reproducibly; null keys count as ''."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in key)))


def chance(seed: int | str, *key: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(luck(seed, *key), 1, 8), 16, 10).cast("double") / 2**32


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by order. The order must be total, else ties are arbitrary.

    An aggregate (min_by), not a window: a key's rows are reduced before the shuffle, so a hot key is no hot task.
    """
    o = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), o).alias("__r")).select(*by, "__r.*")


def distinct_by(df: DataFrame, *key: Column) -> DataFrame:
    """One row per derived key, the smallest by all its columns that can be ordered."""
    cols = [f.name for f in df.schema if f.dataType.typeName() != "map"]
    names = [f"__k{i}" for i in range(len(key))]
    x = df.withColumns(dict(zip(names, key)))
    return x.groupBy(*names).agg(F.min_by(F.struct(*df.columns), F.struct(*cols)).alias("__r")).select("__r.*")


def capped(df: DataFrame, by: list[str], cap: int, order: list[Column], total: int | None = None) -> DataFrame:
    """At most `cap` rows per key by order, then at most `total` of all by the same order.

    A cheap top-k first cuts every key to `cap` rows within hash slices, so the final window never holds a hot key whole.
    """
    o = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    x = df.select("*", *o, F.pmod(F.xxhash64(*by, *order), F.lit(64)).alias("__slice"))
    names = [f"__o{i}" for i in range(len(order))]
    for part in ([*by, "__slice"], by):
        x = x.withColumn("__rk", F.row_number().over(Window.partitionBy(*part).orderBy(*names))).where(F.col("__rk") <= cap)
    x = x.drop("__rk", "__slice")
    x = x.orderBy(*names).limit(total) if total is not None else x
    return x.drop(*names)


def take_ratio(df: DataFrame, by: str, targets: DataFrame, order: list[Column]) -> DataFrame:
    """Of each type at most its target (by, target: one row per type); types without a target are dropped.

    The first order column is a luck string. Its first three hex digits split every type into 4096 slices; slice counts
    say which slices are kept whole, and only the one slice in which a type reaches its target is ranked. So no task
    holds a hot type, and counts are exact.
    """
    names = [f"__o{i}" for i in range(len(order))]
    x = df.withColumns(dict(zip(names, order))).withColumn("__slice", F.substring(names[0], 1, 3))
    per = x.groupBy(by, "__slice").agg(F.count("*").alias("__n"))  # at most 4096 rows per type
    per = per.withColumn("__before", F.sum("__n").over(Window.partitionBy(by).orderBy("__slice")) - F.col("__n")).join(targets, by)
    per = per.where(F.col("__before") < F.col("target")).withColumn("__whole", F.col("__before") + F.col("__n") <= F.col("target"))
    x = x.join(per.select(by, "__slice", "__whole", (F.col("target") - F.col("__before")).alias("__left")), [by, "__slice"])
    edge = x.where(~F.col("__whole")).withColumn("__rk", F.row_number().over(Window.partitionBy(by, "__slice").orderBy(*names)))
    return x.where("__whole").select(df.columns).unionByName(edge.where(F.col("__rk") <= F.col("__left")).select(df.columns))


def shuffled(df: DataFrame, seed: int, key: list[str], limit: int) -> DataFrame:
    """The first `limit` rows in random order (top-k, no full sort)."""
    return df.orderBy(luck(seed, *map(F.col, key)), *key).limit(limit)


def thinned(df: DataFrame, where: Column, keep: float, seed: int, key: list[str]) -> DataFrame:
    """Rows for which `where` holds are kept with a probability, all others always."""
    return df.where(~F.coalesce(where, F.lit(False)) | (chance(seed, *map(F.col, key)) < keep))


def chunk_floor(no: Column, n: Column, k: int) -> Column:
    """Chunk of row no (from 0) of n in k chunks of n // k, the rest in the last."""
    size = F.greatest(F.floor(n / k), F.lit(1))
    return F.least(F.floor(no / size), F.lit(k - 1)).cast("int")


def chunk_ceil(no: Column, n: Column, k: int) -> Column:
    """Chunks of ceil(n / k)."""
    return F.floor(no / F.greatest(F.ceil(n / k), F.lit(1))).cast("int")


def best_of_buckets(df: DataFrame, uid: list[str], bucket: list[str], score: str, per_bucket: int, total: int, seed: int = 0) -> DataFrame:
    """Buckets by best score, then name; in each, rows by score then luck; up to per_bucket rows whose uid is not
    taken yet, total rows at most. A row may stand in several buckets.

    At most `total` rows of a bucket can be taken before it is visited, so its first total + per_bucket distinct uids
    suffice; only the first `total` buckets can give anything. The greedy walk sees no more than that: buckets come
    sorted to one task whose rows are bounded by total * (total + per_bucket), both parameters. Null scores count last.
    """
    key = F.col("__uid")
    x = df.withColumn("__uid", F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in uid))).withColumn("__luck", luck(seed, key))
    cols = df.columns
    x = x.withColumn("__s", F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    x = x.groupBy(*bucket, "__uid").agg(F.max_by(F.struct(*cols, "__luck"), "__s").alias("r"), F.max("__s").alias("__s")).select(*bucket, "__uid", "__s", "r.__luck", F.struct(*(F.col(f"r.{c}").alias(c) for c in cols)).alias("__row"))
    need = total + per_bucket
    x = capped(x, bucket, need, [-F.col("__s"), F.col("__luck"), F.col("__uid")])
    best = x.groupBy(*bucket).agg(F.max("__s").alias("__best")).orderBy(F.desc("__best"), *bucket).limit(total).select(*bucket)
    x = x.join(best, bucket, "left_semi")
    slim = x.select(*bucket, "__uid", "__s", "__luck")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__s", "__luck", "__uid"], ascending=[False, True, True], kind="stable")
        tops = pdf.groupby(bucket, dropna=False)["__s"].max().reset_index().sort_values(["__s", *bucket], ascending=[False, *[True] * len(bucket)])
        groups = dict(iter(pdf.groupby(bucket, dropna=False)))
        taken: set[str] = set()
        out = []
        for name in tops[bucket].itertuples(index=False, name=None):
            n = 0
            for r in groups[name].itertuples(index=False):
                if len(taken) >= total or n >= per_bucket:
                    break
                if r[len(bucket)] not in taken:
                    taken.add(r[len(bucket)])
                    out.append(r[: len(bucket) + 1])
                    n += 1
        return pd.DataFrame(out, columns=[*bucket, "__uid"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*bucket, "__uid").schema)
    picked = slim.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(lambda pdf: walk(pdf.drop(columns="__one")), schema)
    return x.join(picked, [*bucket, "__uid"]).select("__row.*")


def length_batches(df: DataFrame, key: str, length: str, batch: int, world: int, seed: int = 0) -> DataFrame:
    """Random megabatches of batch * world rows; within each, rows by length descending go to the rank with the
    smallest sum so far that is not full. A megabatch that does not divide evenly is dealt in turn. Adds megabatch and rank.
    Signs keep modalities apart. The split is a fold over one megabatch's rows, batch * world at most."""
    from .joins import numbered

    x = df.withColumn("__sign", F.signum(length)).withColumn("__luck", luck(seed, F.col(key)))
    x = numbered(x, ["__sign", "__luck", key], "__no").withColumn("megabatch", F.floor(F.col("__no") / (batch * world)))
    rows = x.groupBy("megabatch").agg(F.sort_array(F.collect_list(F.struct((-F.abs(length)).alias("k"), "__luck", F.struct(*df.columns).alias("row")))).alias("rows"))
    full = F.size("rows") / world
    inf = F.lit(float("inf"))

    def place(s: Column, r: Column) -> Column:
        at = F.array_position(s["sums"], F.array_min(s["sums"])) - 1
        now = F.get(s["counts"], at.cast("int")) + 1
        sums = F.transform(s["sums"], lambda v, i: F.when(i != at, v).when(now >= full, inf).otherwise(v - r["k"]))
        counts = F.transform(s["counts"], lambda n, i: F.when(i == at, n + 1).otherwise(n))
        return F.struct(sums.alias("sums"), counts.alias("counts"), F.concat(s["ranks"], F.array(at.cast("int"))).alias("ranks"))

    start = F.struct(F.array(*[F.lit(0.0)] * world).alias("sums"), F.array(*[F.lit(0)] * world).alias("counts"), F.array().cast("array<int>").alias("ranks"))
    even = F.aggregate("rows", start, place)["ranks"]
    turn = F.transform("rows", lambda r, i: (i % world).cast("int"))
    ranks = F.when(F.size("rows") % world == 0, even).otherwise(turn)
    return rows.select("megabatch", F.inline(F.arrays_zip(F.col("rows.row").alias("r"), ranks.alias("rank")))).select("r.*", "megabatch", "rank")


def union_tagged(sources: dict[str, DataFrame], tag: str = "origin") -> DataFrame:
    """All rows of all sources with the source's name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn(tag, F.lit(n)) for n, d in sources.items()))
