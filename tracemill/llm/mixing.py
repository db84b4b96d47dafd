"""Mixing sources to target weights over a time-varying curriculum.

Training time t runs from 0 to 1. Source k has the weight w_k(t) = share_k * (1 + slope_k * (1 - 2t)): its integral over
all of training is its target share, whatever the slope. Slopes are centred so that the weights of all sources add up to
the same at every t. Positive slopes put a source early, negative ones late.

The integral W_k(t) = share_k * (t + slope_k * (t - t^2)) says how much of source k has been asked for by time t. It is
compared with what the source can deliver at most: inverted, it gives the time at which the source runs dry, and a target
whose source runs dry before the end cannot be met. What a source does deliver is spread over all of training by the same
schedule: a record that covers the delivered size up to c is due when t + slope_k * (t - t^2) = c / delivered, a quadratic
that is inverted in closed form. Sorting by position (range partitioning) yields the curriculum.

Cumulative sizes come from a two-level prefix sum: records of a source are spread over hash buckets, as many as the
records need, buckets are summed first, and only then is a running sum taken inside a bucket, so a source with a third of
all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage

#: Cases in a bucket of the two-level prefix sum, on average over all sources.
BUCKET_CASES = 20_000


def source_key(c: Column) -> Column:
    """Spelling-free name of a source: case, separators, a leading folder and a trailing version are dropped; blank gives null."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"^.*[/\\]", "")
    x = F.regexp_replace(x, r"[(\[]?\s*\bv(er(sion)?)?\.?\s*\d+(\.\d+)*\s*[)\]]?\s*$", "")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}]", "")
    return F.when(F.length(x) > 0, x)


#: The frameworks' long names, without separators.
FRAMEWORK_NAMES = {"continuoustoolcalling": "I", "interleavedthinkingwithimages": "II", "multiagentcollaboration": "III", "clinicalsimulation": "IV"}


def framework_key(c: Column) -> Column:
    """I to IV from a roman or arabic number, with or without the word framework, or from the long name; anything else null."""
    x = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")
    x = F.regexp_replace(F.trim(x), r"^framework ?", "")
    number = F.regexp_extract(x, r"^(iv|iii|ii|i|[1-4])(?: |$)", 1)
    flat = F.regexp_replace(x, " ", "")
    by_number = F.when(number.isin("i", "1"), "I").when(number.isin("ii", "2"), "II").when(number.isin("iii", "3"), "III").when(number.isin("iv", "4"), "IV")
    by_name = None
    for name, key in FRAMEWORK_NAMES.items():
        cond = flat.endswith(name)
        by_name = F.when(cond, key) if by_name is None else by_name.when(cond, key)
    return F.coalesce(by_number, by_name)


def case_sizes(cases: DataFrame) -> DataFrame:
    """(case_id, src, fw, size): re-delivered cases once, spelling removed, size in characters of the question (null: 0)."""
    x = cases.select("case_id", source_key(F.col("source_dataset")).alias("src"), framework_key(F.col("framework")).alias("fw"), F.coalesce(F.length("question"), F.lit(0)).cast("bigint").alias("size"))
    return x.distinct()


def demands(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: (mix_id, src, fw, share, max_repeats, have, total, demand, unmet). A source without cases has size 0.

    unmet: have * max_repeats is below share * total. Null shares and repeats count as 0. Repeated target rows count once;
    two targets of the same source each see the whole source.
    """
    t = targets.select("mix_id", source_key(F.col("source_dataset")).alias("src"), framework_key(F.col("framework")).alias("fw"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).dropDuplicates(["mix_id"])
    have = sizes.where("src is not null and fw is not null").groupBy("src", "fw").agg(F.sum("size").alias("have"))
    whole = Window.partitionBy()  # over the listed sources: at most one row per target
    listed = have.join(t.select("src", "fw").distinct(), ["src", "fw"], "left_semi").withColumn("total", F.sum("have").over(whole))
    x = t.join(listed, ["src", "fw"], "left").withColumn("total", F.coalesce(F.max("total").over(whole), F.lit(0)))
    x = x.withColumn("have", F.coalesce("have", F.lit(0))).withColumn("demand", F.col("share") * F.col("total"))
    return x.withColumn("unmet", F.col("have") * F.col("max_repeats") < F.col("demand"))


def with_slopes(plan: DataFrame, spread: float = 0.5) -> DataFrame:
    """Slopes for a plan: larger sources first, at most `spread` before centring.

    The raw slope falls from +spread to -spread with the rank of the share; the share-weighted mean is taken off, and all are
    shrunk alike where one would make a weight negative, so that the weights keep adding up to the same.
    """
    w = Window.orderBy(F.desc("share"), "mix_id")  # a few rows: one per target
    all_ = Window.partitionBy()
    n = F.count("*").over(all_)
    x = plan.withColumn("raw", F.lit(spread) * (1 - 2 * (F.row_number().over(w) - 1) / F.greatest(n - 1, F.lit(1))))
    mean = F.sum(F.col("raw") * F.col("share")).over(all_) / F.sum("share").over(all_)
    x = x.withColumn("raw", F.col("raw") - F.coalesce(mean, F.lit(0.0)))
    return x.withColumn("slope", F.col("raw") * F.least(F.lit(1.0), 0.95 / F.greatest(F.max(F.abs("raw")).over(all_), F.lit(1e-9)))).drop("raw")


def mix_plan(sizes: DataFrame, targets: DataFrame, spread: float = 0.5, shrink: bool = False) -> DataFrame:
    """demands() with the schedule: adds slope, runs_dry, delivered and planned, the size of the whole mix that shares refer to.

    runs_dry: the time at which the integrated schedule has asked for all the source can deliver, 1 if it never does.
    delivered: min(demand, have * max_repeats). shrink: planned is the largest size at which every target can
    be met but for those of sources that have nothing, in place of the size of all listed cases, and demands are shares of it.
    """
    x = with_slopes(demands(sizes, targets), spread).withColumn("most", (F.col("have") * F.col("max_repeats")).cast("double"))
    planned = F.col("total").cast("double")
    if shrink:
        planned = F.least(planned, F.coalesce(F.min(F.when((F.col("share") > 0) & (F.col("most") > 0), F.col("most") / F.col("share"))).over(Window.partitionBy()), F.lit(0.0)))
    x = x.withColumn("planned", planned)
    dry = F.when(F.col("demand") > F.col("most"), position(F.col("most") / F.col("demand"), F.col("slope"))).otherwise(1.0)
    x = x.withColumn("runs_dry", dry)
    return x.withColumn("demand", F.col("share") * F.col("planned")).withColumn("delivered", F.least("demand", "most"))


def unmet_targets(plan: DataFrame) -> DataFrame:
    """(mix_id) of targets whose source runs dry before the end."""
    return plan.where("runs_dry < 1 and unmet").select("mix_id")


def position(part: Column, slope: Column) -> Column:
    """t in [0, 1] with t + slope * (t - t^2) = part: the inverse of a source's cumulative demand."""
    b = 1 + slope
    root = F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * slope * part))
    return F.when(F.abs(slope) < 1e-9, part).otherwise(2 * part / (b + root))  # the form without cancellation


def mix(cases: DataFrame, targets: DataFrame, spread: float = 0.5, bucket_cases: int = BUCKET_CASES, shrink: bool = False) -> DataFrame:
    """(position, mix_id, case_id, repeat, size): the training order, range-sorted by position.

    Each source delivers min(demand, size * max_repeats) characters: whole passes over its cases and a last partial pass,
    which ends with the first case that reaches the demand. What it delivers spans all of training by the source's schedule,
    also where it falls short. Cases of unlisted sources are left out; cases of size 0 of a listed source come once per pass.
    Equal positions are ordered by mix_id, case_id and repeat. shrink as in mix_plan().
    """
    sizes = cut_lineage(case_sizes(cases))
    buckets = -(-sizes.count() // bucket_cases) or 1
    plan = mix_plan(sizes, targets, spread, shrink).where("delivered > 0")
    x = sizes.join(broadcast_if_small(plan.select("mix_id", "src", "fw", "have", "demand", "delivered", "max_repeats", "slope")), ["src", "fw"])
    h = F.xxhash64("mix_id", "case_id")
    x = x.withColumn("h", h).withColumn("bucket", F.pmod(h, F.lit(buckets)))
    per = x.groupBy("mix_id", "bucket").agg(F.sum("size").alias("in_bucket"))  # at most targets * buckets rows
    before = per.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("mix_id").orderBy("bucket")) - F.col("in_bucket")).select("mix_id", "bucket", "before")
    x = x.join(before, ["mix_id", "bucket"])
    run = F.sum("size").over(Window.partitionBy("mix_id", "bucket").orderBy("h", "case_id").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("start", F.col("before") + run - F.col("size"))
    # passes this case takes part in: all r with r * have + start < demand, at most max_repeats
    passes = F.least(F.col("max_repeats"), F.ceil((F.col("demand") - F.col("start")) / F.col("have"))).cast("int")
    x = x.withColumn("passes", passes).where("passes > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    part = F.least(F.lit(1.0), (F.col("repeat") * F.col("have") + F.col("start") + F.col("size") / 2) / F.col("delivered"))
    x = x.select(position(part, F.col("slope")).alias("position"), "mix_id", "case_id", "repeat", "size")
    return x.repartitionByRange("position", "mix_id", "case_id", "repeat").sortWithinPartitions("position", "mix_id", "case_id", "repeat")


def mix_report(cases: DataFrame, targets: DataFrame, shrink: bool = False, **kw) -> DataFrame:
    """(mix_id, target_share, share_of_plan, share_of_mix, records, passes, unmet): the shares reached of the planned size and of what the mix holds.

    A target that can be met reaches its share of the planned size to within one case; where others cannot, the mix is smaller
    and its share of the mix is larger.
    """
    plan = mix_plan(case_sizes(cases), targets, shrink=shrink)
    got = mix(cases, targets, shrink=shrink, **kw).groupBy("mix_id").agg(F.sum("size").alias("size"), F.count("*").alias("records"), (F.max("repeat") + 1).alias("passes"))
    x = plan.join(got, "mix_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    all_ = F.sum("size").over(Window.partitionBy())

    def share(of: Column) -> Column:
        return F.round(F.coalesce(F.col("size") / F.when(of > 0, of), F.lit(0.0)), 6)

    return x.select("mix_id", F.col("share").alias("target_share"), share(F.col("planned")).alias("share_of_plan"), share(all_).alias("share_of_mix"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("passes", F.lit(0)).alias("passes"), "unmet")
