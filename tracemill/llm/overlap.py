"""Records of evaluation splits that occur, exactly or almost, in the training split.

Questions are compared by their words in order: the longest common subsequence of the words, over the longer question,
must reach `agree`. Equal word sequences are one class, so copies are compared once and expanded at the end, or only counted.

Candidates come from an exact prefix filter on rare shingles. A shingle here is a set of one to five words of a text, gaps
allowed. Say two texts of n and m words agree in T >= agree * max(n, m) words. Each text then has at most
d = n - ceil(agree * n) words outside the common part, so under any one order of all words the i-th of the common words
is among the first d + i words of both texts. Words are ordered rarest first, by a frequency table of fixed size over all
classes (only the order depends on it, not the result; the k-th occurrence of a word in a text is a word of its own). A
shingle grows from its rarest word by the next common ones until it is expected in at most FEW texts, which both texts
reckon alike from the table, or has five words: where words are rare single ones do, and as the corpus grows and words
become frequent, shingles become longer, so that candidates keep growing with the texts and not with their square.

Prefixes of the evaluation side are the index and the training side probes it. Filters on the lengths and on the places of
a shingle's first and last word come before the words are compared. No list is capped: shingles that are still expected in
many texts are split by a salt in proportion. Very long texts, whose prefixes have more words, use shingles of fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import attach, broadcast_if_small, cut_lineage
from .mixing import source_key

#: Nine tenths of the words of either text; of the longer one, which may have words added, a little less. Unrelated
#: questions stay below 0.84.
AGREE = 0.88
#: Words in a shingle at most, and the number of texts in which a shingle is expected that needs no more words.
WIDTH, FEW = 5, 1
#: Sets of words in a prefix at most; longer texts, whose prefixes are longer, have shingles of fewer words for it.
SHINGLES = 256
#: Cells of the frequency table: 4 bytes each, whatever the input's size.
CELLS = 1 << 18
#: A shingle expected in more texts than this is spread over as many salts as it takes, and so are a class's or a source id's members.
HOT = 5_000


def words_of(c: Column) -> Column:
    """Words without case and punctuation, in order: runs of letters and digits; each ideograph is a word of its own."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))


def source_number(c: Column) -> Column:
    """The number of a source id without its prefix and leading zeros; an id without digits is its letters in lower case."""
    x = F.lower(F.trim(c))
    digits = F.regexp_extract(x, r"(\d+)\D*$", 1)
    stripped = F.regexp_replace(digits, r"^0+(?=\d)", "")
    flat = F.regexp_replace(x, r"[^\p{L}\p{N}]", "")
    return F.when(F.length(digits) > 0, stripped).when(F.length(flat) > 0, flat)


def records(cases: DataFrame) -> DataFrame:
    """(case_id, train, split, src, sid, cid, words): words as 64-bit hashes, cid the 16 bytes of their md5 (null without words). Rows with no known split or id are left out."""
    split = F.lower(F.trim("split"))
    w = words_of(F.col("question"))
    x = cases.select("case_id", split.alias("split"), source_key(F.col("source_dataset")).alias("src"), source_number(F.col("source_id")).alias("sid"), F.when(F.size(w) > 0, w).alias("w"))
    x = x.where("split in ('train', 'validation', 'test') and case_id is not null").withColumn("train", F.col("split") == "train")
    return x.withColumn("cid", F.unhex(F.md5(F.array_join("w", " ")))).withColumn("words", F.transform("w", lambda v: F.xxhash64(v))).drop("w")


def lcs_at_least(a: list, b: list, need: int) -> bool:
    """Whether the longest common subsequence of two word lists reaches need (bit-parallel, one integer step a word)."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        if u:
            v = (v + u | v - u) & full
    return len(a) - v.bit_count() >= need


def _ceil(x: float) -> int:
    return round(x) if abs(x - round(x)) < 1e-9 else int(x) + 1


def spare(n: int, agree: float) -> int:
    """Words of a text of n words that may lie outside the common part."""
    return n - _ceil(agree * n)


@lru_cache(None)
def widths(n: int, agree: float) -> frozenset[int]:
    """Words a shingle of a text of n words may end at: those of all lengths the longer of two matching texts can have.

    The longer text decides, so both know it. It has at most SHINGLES sets of so many words in its prefix, and no more words
    than the fewest that two different matching texts have in common.
    """
    k = 1
    while not spare(k, agree) and k <= WIDTH:
        k += 1
    most = max(1, min(WIDTH, k - 1))
    reach = {spare(m, agree) for m in range(n, int(n / agree + 1e-9) + 1)}
    return frozenset(max([w for w in range(2, most + 1) if comb(d + w, w) <= SHINGLES], default=1) for d in reach)


def frequency_table(classes: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Counts of words by cell over all classes: a fixed number of cells reaches the driver, however large the input."""
    x = classes.select(F.explode("words").alias("h")).groupBy(F.pmod("h", F.lit(cells)).cast("int").alias("cell")).count()
    out = np.zeros(cells, np.int64)
    got = x.toPandas()
    out[got["cell"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def shingles(words: np.ndarray, freq: np.ndarray, texts: int, agree: float, few_texts: float = FEW, hot: int = HOT) -> list[tuple[int, int, int, int]]:
    """(hash, place of its first word, of its last, salts) of every shingle of a text's prefix; the place of a word that stands twice is -1."""
    d, sizes = spare(len(words), agree), widths(len(words), agree)
    most = max(sizes)
    f = freq[words % len(freq)]
    few = np.lexsort((words, f))[: d + most + 1].tolist()
    h, fs = words[few].tolist(), f[few].tolist()
    n = len(few)
    token, at = [], few[:]
    for i in range(n):
        if i and h[i] == h[i - 1]:
            at[i] = at[i - 1] = -1
            token.append(token[-1] * 0x9E3779B97F4A7C15 + 1 & MASK)
        else:
            token.append(h[i] & MASK)
    n = min(n, d + most)
    out: list[tuple[int, int, int, int]] = []

    def put(key: int, start: int, last: int, expected: float) -> None:
        out.append((key - (1 << 64) if key >> 63 else key, start, last, 1 + int(expected / hot)))

    def grow(key: int, expected: float, size: int, i: int, start: int) -> None:
        for j in range(i, min(n, d + size)):
            k = (key ^ token[j]) * 0xD6E8FEB86659FD93 & MASK
            k ^= k >> 32
            e = min(expected, expected * fs[j] / texts) if size > 1 else fs[j]
            place = at[j] if size == 1 else start
            if e <= few_texts:
                put(k, place, at[j], e)
                continue
            if size in sizes:
                put(k ^ size, place, at[j], e)
            if size < most:
                grow(k, e, size + 1, j + 1, place)

    grow(0, 0.0, 1, 0, -1)
    return out


MASK = (1 << 64) - 1


def prefixes(classes: DataFrame, table, texts: int, train: bool, agree: float, few: float = FEW, hot: int = HOT) -> DataFrame:
    """(cid, n, h, salt, at, last): the shingles of each class's prefix."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freq = table.value
        for pdf in it:
            who, keys, salt, at, last = [], [], [], [], []
            for i, (cid, words) in enumerate(zip(pdf["cid"], pdf["words"])):
                if not len(words):
                    continue
                for k, a, z, salts in shingles(words, freq, texts, agree, few, hot):
                    for s in (0,) if salts == 1 else (int.from_bytes(cid[:4], "big") % salts,) if train else range(salts):
                        who.append(i)
                        keys.append(k)
                        salt.append(s)
                        at.append(a)
                        last.append(z)
            out = pdf[["cid", "n"]].iloc[who].reset_index(drop=True)
            yield out.assign(h=np.array(keys, np.int64), salt=np.array(salt, np.int32), at=np.array(at, np.int32), last=np.array(last, np.int32))

    return classes.select("cid", "n", "words").mapInPandas(run, "cid binary, n int, h bigint, salt int, at int, last int")


def candidates(classes: DataFrame, agree: float = AGREE, few: float = FEW, hot: int = HOT) -> DataFrame:
    """(cid_t, cid_e): pairs of different classes that share a shingle and pass the filters."""
    table = classes.sparkSession.sparkContext.broadcast(frequency_table(classes))
    texts = max(1, classes.count())
    t, e = (prefixes(classes.where(c), table, texts, c == "in_train", agree, few, hot).alias(c) for c in ("in_train", "in_eval"))
    near = t.join(e, ["h", "salt"]).where("in_train.cid != in_eval.cid")
    near = near.where(F.least("in_train.n", "in_eval.n") >= F.greatest("in_train.n", "in_eval.n") * F.lit(agree) - 1e-9)
    most = F.floor(F.greatest("in_train.n", "in_eval.n") * F.lit(1 - agree) + 1e-9)  # words either text can have to itself
    for c in ("at", "last"):
        near = near.where((F.col(f"in_train.{c}") < 0) | (F.col(f"in_eval.{c}") < 0) | (F.abs(F.col(f"in_train.{c}") - F.col(f"in_eval.{c}")) <= most))
    return near.select(F.col("in_train.cid").alias("cid_t"), F.col("in_eval.cid").alias("cid_e")).distinct()


def similar_classes(classes: DataFrame, agree: float = AGREE, few: float = FEW, hot: int = HOT) -> DataFrame:
    """(cid_t, cid_e): pairs of different classes, one with training and one with evaluation rows, whose words agree."""
    w = classes.select("cid", "words")
    near = candidates(classes, agree, few, hot).join(w.select(F.col("cid").alias("cid_e"), F.col("words").alias("words_e")), "cid_e").join(w.select(F.col("cid").alias("cid_t"), F.col("words").alias("words_t")), "cid_t")

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ok = [lcs_at_least(a.tolist(), b.tolist(), _ceil(agree * max(len(a), len(b)))) for a, b in zip(pdf["words_t"], pdf["words_e"])]
            yield pdf.loc[np.array(ok, bool), ["cid_t", "cid_e"]]

    return near.mapInPandas(verify, "cid_t binary, cid_e binary")


@dataclass
class Links:
    """Overlaps by class. members: (case_id, train, split, src, sid, cid); linked: (cid_t, cid_e), equal classes included."""

    members: DataFrame
    linked: DataFrame


def links(cases: DataFrame, agree: float = AGREE, few: float = FEW, hot: int = HOT) -> Links:
    """Classes of equal questions and the pairs of classes that overlap; nothing is expanded.

    Words are compared by their 64-bit hashes. Null, empty and wordless questions match nothing by question; a null source or
    id matches nothing by source. Re-delivered rows count once; a null case_id is no case.
    """
    rec = cut_lineage(records(cases))  # texts are taken apart once
    classes = rec.where("cid is not null").groupBy("cid").agg(F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_eval"), F.any_value("words").alias("words"))
    classes = cut_lineage(classes.withColumn("n", F.size("words")))
    same = classes.where("in_train and in_eval").select(F.col("cid").alias("cid_t"), F.col("cid").alias("cid_e"))
    return Links(rec.drop("words").distinct(), similar_classes(classes, agree, few, hot).unionByName(same))


def _expanded(a: DataFrame, members: DataFrame, keys: list[str], most: int = HOT) -> DataFrame:
    """a joined to members, whose frequent keys are spread over salts in proportion to their rows (at most total / most such keys)."""
    n = members.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__salts"))
    hot = broadcast_if_small(n)
    one = F.coalesce("__salts", F.lit(1))
    a = a.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("__salts")
    members = members.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*members.columns), one).cast("int")).drop("__salts")
    return a.join(members, [*keys, "__salt"]).drop("__salt")


def overlaps(cases: DataFrame, agree: float = AGREE, few: float = FEW, hot: int = HOT) -> DataFrame:
    """(case_id_t, case_id_e, by_source, by_question): every pair of a training case and an evaluation case that overlap.

    Nulls, empty questions and re-delivered rows as in links(). Each pair comes once, with both reasons.
    """
    x = links(cases, agree, few, hot)
    members = cut_lineage(x.members)
    m = members.select("case_id", "train", "cid").where("cid is not null")
    mt, me = m.where("train").select(F.col("cid").alias("cid_t"), F.col("case_id").alias("case_id_t")), m.where("not train").select(F.col("cid").alias("cid_e"), F.col("case_id").alias("case_id_e"))
    by_q = _expanded(_expanded(x.linked, mt, ["cid_t"], hot), me, ["cid_e"], hot).select("case_id_t", "case_id_e", F.lit(False).alias("by_source"), F.lit(True).alias("by_question"))
    s = members.where("src is not null and sid is not null").select("case_id", "train", "src", "sid")
    by_s = _expanded(s.where("not train").withColumnRenamed("case_id", "case_id_e").drop("train"), s.where("train").withColumnRenamed("case_id", "case_id_t").drop("train"), ["src", "sid"], hot)
    by_s = by_s.select("case_id_t", "case_id_e", F.lit(True).alias("by_source"), F.lit(False).alias("by_question"))
    return by_q.unionByName(by_s).groupBy("case_id_t", "case_id_e").agg(F.max("by_source").alias("by_source"), F.max("by_question").alias("by_question"))


def pair_rows(found: DataFrame) -> DataFrame:
    """(case_id_a, case_id_b), a < b."""
    return found.select(F.least("case_id_t", "case_id_e").alias("case_id_a"), F.greatest("case_id_t", "case_id_e").alias("case_id_b"))


def link_counts(x: Links) -> DataFrame:
    """(case_id, split, source, class_id, links): one row per evaluation case with its class and the number of training cases it overlaps.

    Counted from classes, not from pairs: partners by question plus partners by source less those that are both. A case
    without words has no class; a null source is ''.
    """
    members = cut_lineage(x.members)
    t = members.where("train")
    by_class = t.where("cid is not null").groupBy(F.col("cid").alias("cid_t")).agg(F.count("*").alias("n"))
    by_source = t.where("src is not null and sid is not null").groupBy("src", "sid").agg(F.count("*").alias("by_source"))
    by_both = t.where("cid is not null and src is not null and sid is not null").groupBy(F.col("cid").alias("cid_t"), "src", "sid").agg(F.count("*").alias("n_both"))
    linked = cut_lineage(x.linked)
    by_question = linked.join(by_class, "cid_t").groupBy(F.col("cid_e").alias("cid")).agg(F.sum("n").alias("by_question"))
    kinds = members.where("not train").groupBy("cid", "src", "sid").agg(F.count("*").alias("same"))  # what decides a case's links, once
    both = kinds.where("cid is not null and src is not null and sid is not null").withColumnRenamed("cid", "cid_e").join(linked, "cid_e").join(by_both, ["cid_t", "src", "sid"]).groupBy(F.col("cid_e").alias("cid"), "src", "sid").agg(F.sum("n_both").alias("both"))
    kinds = kinds.join(by_question, "cid", "left").join(by_source, ["src", "sid"], "left").join(both, ["cid", "src", "sid"], "left")
    n = sum(F.coalesce(c, F.lit(0)) * f for c, f in (("by_question", 1), ("by_source", 1), ("both", -1)))
    keys = {c: F.coalesce(F.col(c).cast("string") if c != "cid" else F.hex(c), F.lit("")) for c in ("cid", "src", "sid")}
    counts = kinds.select(*(v.alias(f"k_{k}") for k, v in keys.items()), n.cast("bigint").alias("links"), F.col("same").alias("count"))
    e = members.where("not train").select("case_id", "split", *(v.alias(f"k_{k}") for k, v in keys.items()))
    e = attach(e, counts.drop("count"), ["k_cid", "k_src", "k_sid"], counts.select("k_cid", "k_src", "k_sid", "count"))
    return e.select("case_id", "split", F.col("k_src").alias("source"), F.when(F.col("k_cid") != "", F.lower("k_cid")).alias("class_id"), "links")


def overlap_report(counted: DataFrame) -> DataFrame:
    """(split, source, cases, overlapping, pairs, share) of link_counts: evaluation cases with a training twin, per split and source."""
    x = counted.groupBy("split", "source").agg(F.count("*").alias("cases"), F.count_if(F.col("links") > 0).alias("overlapping"), F.sum("links").alias("pairs"))
    return x.withColumn("share", F.round(F.col("overlapping") / F.col("cases"), 6))
