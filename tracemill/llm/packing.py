"""Filling containers of fixed capacity: vector bin packing with the dot-product heuristic.

An item (a document, a conversation, or the remainder of one that exceeds a container) uses three things at once: tokens,
one segment and its loss-bearing tokens. Each container has a limit for all three. Of items that exceed the capacity, the
pieces that fill a container are containers of their own at once; everything else is never split.

Items are spread by a hash over shards of a bounded number of items, so no task holds more than one shard's sizes (no
texts). In a shard, containers are filled one after another: of the items that fit, the one whose demand vector has the
largest dot product with what is left in the container (both relative to the limits) goes in. Equal demand vectors form a
class, so the choice is made over classes, not items. Each shard leaves at most a few containers open.

Loss-bearing tokens are those a model is trained to predict: of a conversation the replies, of plain text all of them.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


@dataclass(frozen=True)
class Limits:
    """Limits of one container. Segments default to one per 16 tokens, loss-bearing tokens to the capacity."""

    tokens: int
    segments: int | None = None
    loss: int | None = None

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.segments or max(1, self.tokens // 16), self.loss or self.tokens


#: Specs at most: they are read by the driver.
MAX_SPECS = 1_000
#: Items in a shard: bounds a task's memory (about 100 bytes an item).
SHARD_ITEMS = 60_000
PIECES = "spec_name string, container string, doc_id bigint, piece int, tokens bigint, loss_tokens bigint, split boolean"


def fill(items: list[tuple[int, int]], limits: tuple[int, int, int]) -> list[list[int]]:
    """Containers as lists of indices into items (tokens, loss tokens). Ties: more tokens first, then the earlier item.

    A class is a (tokens, loss) pair. Classes are kept by tokens; for one token size the dot product grows with loss, so
    per size only the largest loss that fits needs a look, and sizes are looked at from the largest that fits downwards
    until no smaller one can have a larger product.
    """
    cap, seg, loss_cap = limits
    by: dict[int, dict[int, list[int]]] = {}
    for k in range(len(items) - 1, -1, -1):
        by.setdefault(items[k][0], {}).setdefault(items[k][1], []).append(k)
    sizes = sorted(by)
    losses = {t: sorted(x) for t, x in by.items()}
    out: list[list[int]] = []
    while sizes:
        left_t, left_s, left_l = cap, seg, loss_cap
        box: list[int] = []
        while left_s and sizes:
            at = bisect_right(sizes, left_t) - 1
            best, choice = -1.0, None
            wt, wl = left_t / cap / cap, left_l / loss_cap / loss_cap
            while at >= 0:
                t = sizes[at]
                if best >= 0 and t * wt + min(t, left_l) * wl <= best:
                    break
                ls = losses[t]
                j = bisect_right(ls, left_l) - 1
                if j >= 0 and (v := t * wt + ls[j] * wl) > best:
                    best, choice = v, (t, ls[j])
                at -= 1
            if choice is None:
                break
            t, m = choice
            stack = by[t][m]
            box.append(stack.pop())
            left_t, left_s, left_l = left_t - t, left_s - 1, left_l - m
            if not stack:
                del by[t][m]
                losses[t].remove(m)
                if not losses[t]:
                    del by[t], losses[t]
                    sizes.remove(t)
        if not box:
            raise ValueError("an item exceeds a limit of an empty container")
        out.append(box)
    return out


def read_specs(specs: DataFrame) -> dict[str, Limits]:
    """Limits by spec_name; columns max_segments and max_loss_tokens are read where the table has them. Null or negative capacities are no specs."""
    extra = [c if c in specs.columns else F.lit(None).cast("int").alias(c) for c in ("max_segments", "max_loss_tokens")]
    rows = specs.where("capacity_tokens > 0 and spec_name is not null").select("spec_name", "capacity_tokens", *extra).distinct().limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    return {r["spec_name"]: Limits(int(r["capacity_tokens"]), r["max_segments"], r["max_loss_tokens"]) for r in rows}


def pack(sizes: DataFrame, specs: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(spec_name, container, doc_id, piece, tokens, loss_tokens, split): every document in containers of every spec.

    sizes: (doc_id, tokens, loss_tokens), repeated rows count once; specs as read_specs() takes them, a few rows.
    A document with no tokens takes a segment and no room. Null sizes count as 0. `split` is true for the pieces of documents
    that exceed a limit, whose whole-container pieces come first.
    """
    sizes = sizes.select("doc_id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("tokens"), F.greatest(F.coalesce("loss_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("loss_tokens")).where("doc_id is not null").dropDuplicates(["doc_id"])
    sizes = cut_lineage(sizes)  # texts are measured once
    caps = read_specs(specs)
    spark = sizes.sparkSession
    if not caps:
        return spark.createDataFrame([], PIECES)
    vec = {k: v.vector() for k, v in caps.items()}
    per_spec = F.explode(F.array(*(F.struct(F.lit(k).alias("spec_name"), F.lit(v[0]).cast("bigint").alias("cap"), F.lit(v[2]).cast("bigint").alias("loss_cap")) for k, v in vec.items())))
    x = sizes.select("*", per_spec.alias("s")).select("s.*", "doc_id", "tokens", F.least("loss_tokens", "tokens").alias("loss"))
    # pieces of at most one container: each takes at most cap tokens and loss_cap loss-bearing tokens
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("cap")), F.ceil(F.col("loss") / F.col("loss_cap"))).cast("int")
    x = x.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    even = F.col("n") > F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("cap")))
    whole = F.when(even, F.floor(F.col("tokens") / F.col("n")) + (F.col("piece") < F.col("tokens") % F.col("n")).cast("int")).otherwise(F.least(F.col("cap"), F.col("tokens") - F.col("piece").cast("bigint") * F.col("cap")))
    share = F.floor(F.col("loss") / F.col("n")) + (F.col("piece") < F.col("loss") % F.col("n")).cast("int")
    x = x.select("spec_name", "doc_id", "piece", whole.cast("bigint").alias("tokens"), F.when(F.col("n") > 1, F.least(share, whole)).otherwise(F.col("loss")).cast("bigint").alias("loss_tokens"), (F.col("n") > 1).alias("split"), "cap")
    full = F.col("tokens") >= F.col("cap")
    alone = x.where(full).select("spec_name", F.concat_ws("-", F.lit("whole"), "doc_id", "piece").alias("container"), "doc_id", "piece", "tokens", "loss_tokens", "split")
    x = x.where(~full).drop("cap")
    # one remainder a document and spec, but for pieces cut by the loss limit
    items = x.groupBy("spec_name").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    shards = max(1, -(-items // shard_items))

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        spec, no = key[0], int(key[1])
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        boxes = fill(list(zip(pdf["tokens"].tolist(), pdf["loss_tokens"].tolist())), vec[spec])
        name = [""] * len(pdf)
        for b, box in enumerate(boxes):
            for k in box:
                name[k] = f"{no}-{b}"
        pdf["container"] = name
        return pdf[["spec_name", "container", "doc_id", "piece", "tokens", "loss_tokens", "split"]]

    x = x.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    return x.groupBy("spec_name", "shard").applyInPandas(shard, PIECES).unionByName(alone)


def container_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_name, containers, items, tokens, unused_share, full_segments, full_loss) per spec; partial sums per container first.

    full_segments, full_loss: containers with no segment, or under one percent of the loss-bearing tokens, left.
    """
    rows = [(k, *v.vector()) for k, v in read_specs(specs).items()]
    caps = F.broadcast(packed.sparkSession.createDataFrame(rows, "spec_name string, cap long, segments long, loss long"))  # MAX_SPECS rows at most
    per = packed.groupBy("spec_name", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"), F.sum("loss_tokens").alias("bearing")).join(caps, "spec_name")
    per = per.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.round(1 - F.sum("used") / F.sum("cap"), 6).alias("unused_share"), F.count_if(F.col("items") >= F.col("segments")).alias("full_segments"), F.count_if(F.col("bearing") >= 0.99 * F.col("loss")).alias("full_loss"))
    return per


def oversized(packed: DataFrame) -> DataFrame:
    """(spec_name, doc_id): documents that lie in more than one container."""
    return packed.where("split").groupBy("spec_name", "doc_id").agg(F.count_distinct("container").alias("n")).where("n > 1").select("spec_name", "doc_id")
