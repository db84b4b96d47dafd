"""Packing and mixing against their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.llm import mixing as M
from tracemill.llm import packing as K


@pytest.mark.parametrize("seed", range(5))
def test_fill_respects_all_limits_and_the_heuristic(seed):
    r = random.Random(seed)
    limits = (100, 6, 80)
    items = [(t := r.randint(0, 100), r.randint(0, min(t, 80))) for _ in range(200)]
    boxes = K.fill(items, limits)
    assert sorted(i for b in boxes for i in b) == list(range(200))
    for b in boxes:
        assert sum(items[i][0] for i in b) <= 100 and len(b) <= 6 and sum(items[i][1] for i in b) <= 80
    # brute force of the rule: at every step the best fitting dot product
    left = set(range(200))
    for b in boxes:
        t, s, m = limits
        for i in b:
            fits = [j for j in left if items[j][0] <= t and items[j][1] <= m and s]
            dot = lambda j: items[j][0] * t / 100**2 + items[j][1] * m / 80**2  # noqa: E731, B023
            assert abs(dot(i) - max(map(dot, fits))) < 1e-9
            left.discard(i)
            t, s, m = t - items[i][0], s - 1, m - items[i][1]


def test_pack(spark):
    r = random.Random(1)
    rows = [(i, r.choice([0, 1, 50, 99, 100, 101, 250, 1000]), 0) for i in range(500)] + [(3, None, None), (None, 5, 5)]
    rows = [(i, t, t) for i, t, _ in rows if i != 3 or t is None]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, tokens long, loss_tokens long").withColumn("container", F.lit("clash"))
    specs = spark.createDataFrame([("s", 100), ("big", 400), ("bad", None)], "spec_name string, capacity_tokens int")
    p = K.pack(df, specs, shard_items=100)
    got = p.collect()
    want = {i: t or 0 for i, t, _ in rows if i is not None}
    for name, cap in (("s", 100), ("big", 400)):
        mine = [x for x in got if x["spec_name"] == name]
        total: dict = {}
        box: dict = {}
        for x in mine:
            total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["tokens"]
            box[x["container"]] = box.get(x["container"], 0) + x["tokens"]
        assert total == want and max(box.values()) <= cap
        assert {x["doc_id"] for x in mine if x["split"]} == {i for i, t in want.items() if t > cap}
    assert sorted(tuple(x) for x in K.oversized(p).collect()) == sorted([("s", i) for i, t in want.items() if t > 100] + [("big", i) for i, t in want.items() if t > 400])
    assert K.pack(df.where("false"), specs).count() == 0
    assert {x["spec_name"] for x in K.container_report(p, specs).collect()} == {"s", "big"}


@pytest.mark.parametrize("tokens, loss, binds", [(10, 0, "segments"), (90, 5, "tokens"), (20, 20, "loss"), (500, 60, "tokens"), (60, 60, "loss")])
def test_each_limit_binds(spark, tokens, loss, binds):
    df = spark.createDataFrame([(i, tokens, loss) for i in range(60)], "doc_id long, tokens long, loss_tokens long")
    specs = spark.createDataFrame([("s", 100, 6, 40)], "spec_name string, capacity_tokens int, max_segments int, max_loss_tokens int")
    got = K.pack(df, specs).collect()
    box: dict = {}
    for x in got:
        b = box.setdefault(x["container"], [0, 0, 0])
        b[0], b[1], b[2] = b[0] + x["tokens"], b[1] + 1, b[2] + x["loss_tokens"]
    assert all(b[0] <= 100 and b[1] <= 6 and b[2] <= 40 for b in box.values())
    assert sum(b[0] for b in box.values()) == 60 * tokens and sum(b[2] for b in box.values()) == 60 * loss
    full = {"tokens": lambda b: b[0] + tokens > 100, "segments": lambda b: b[1] == 6, "loss": lambda b: b[2] + min(loss, 30) > 40}[binds]
    assert sum(map(full, box.values())) >= len(box) - 1
    assert {x["split"] for x in got} == {tokens > 100 or loss > 40}
    rep = K.container_report(K.pack(df, specs), specs).first()
    assert (rep["full_segments"] > 0) == (binds == "segments") and rep["containers"] == len(box)


@pytest.mark.parametrize("given, want", [("datasets/mimic_cxr_vqa", "mimiccxrvqa"), ("PathVQA (v1.0)", "pathvqa"), (" Path-VQA", "pathvqa"), ("", None), (None, None), ("MIMIC CXR VQA ", "mimiccxrvqa")])
def test_source_key(spark, given, want):
    assert spark.createDataFrame([(given,)], "a string").select(M.source_key(F.col("a"))).first()[0] == want


@pytest.mark.parametrize(
    "given, want",
    [("Framework II: Interleaved Thinking with Images", "II"), ("framework iii - multi-agent collaboration", "III"), ("Framework 4", "IV"), ("IV", "IV"), ("I", "I"), ("  FRAMEWORK I:CONTINUOUS TOOL CALLING ", "I"), ("clinical_simulation", "IV"), ("Interleaved Thinking with Images", "II"), ("other", None), (None, None), ("", None)],
)
def test_framework_key(spark, given, want):
    assert spark.createDataFrame([(given,)], "a string").select(M.framework_key(F.col("a"))).first()[0] == want


CASES = "case_id long, source_dataset string, framework string, question string, mix_id int"
TARGETS = "mix_id long, source_dataset string, framework string, target_share double, max_repeats int"


def test_mix(spark):
    rows = [(i, "A", "I", "x" * (1 + i % 7), 0) for i in range(600)] + [(1000 + i, "b", "II", "y" * 5, 0) for i in range(60)] + [(2000, None, "I", "zz", 0), (2001, "A", None, "zz", 0), (2002, "C", "I", "zz", 0), (2003, "A", "I", None, 0)]
    cases = spark.createDataFrame(rows + rows[:50], CASES)
    targets = spark.createDataFrame([(1, "A", "I", 0.6, 1), (2, "B", "II", 0.3, 2), (3, "D", "I", 0.1, 9)], TARGETS)
    plan = {r["mix_id"]: r for r in M.demands(M.case_sizes(cases), targets).collect()}
    have_a, have_b = sum(1 + i % 7 for i in range(600)), 300
    assert plan[1]["have"] == have_a and plan[2]["have"] == have_b and plan[3]["have"] == 0
    assert plan[1]["total"] == have_a + have_b
    assert {k for k, r in plan.items() if r["unmet"]} == {k for k, h, s, m in ((1, have_a, 0.6, 1), (2, have_b, 0.3, 2), (3, 0, 0.1, 9)) if h * m < s * (have_a + have_b)}
    out = M.mix(cases, targets, bucket_cases=80).collect()
    pos = [(r["position"], r["mix_id"], r["case_id"], r["repeat"]) for r in out]
    assert pos == sorted(pos) and all(0 <= p[0] <= 1 for p in pos)
    for k, m, h in ((1, 1, have_a), (2, 2, have_b)):
        mine = [r for r in out if r["mix_id"] == k]
        demand = plan[k]["demand"]
        size = sum(r["size"] for r in mine)
        assert min(demand, h * m) <= size <= min(demand + 7, h * m)
        assert max(r["repeat"] for r in mine) < m and len({(r["case_id"], r["repeat"]) for r in mine}) == len(mine)
    # what falls short is spread over the whole run as well
    for k in (1, 2):
        mine = [r["position"] for r in out if r["mix_id"] == k]
        assert min(mine) < 0.05 and max(mine) > 0.95
    rep = {r["mix_id"]: r for r in M.mix_report(cases, targets).collect()}
    assert abs(sum(r["share_of_mix"] for r in rep.values()) - 1) < 1e-4 and rep[3]["share_of_mix"] == 0
    for k, r in rep.items():
        assert r["unmet"] or abs(r["share_of_plan"] - r["target_share"]) < 0.01
    two = targets.where("mix_id < 3")
    assert all(abs(r["share_of_mix"] - r["target_share"] / 0.9) < 0.01 for r in M.mix_report(cases, two, shrink=True).collect())
    assert M.mix(cases.where("false"), targets).count() == 0 and M.mix(cases, targets.where("false")).count() == 0


def test_slopes_are_centred_and_weights_stay_positive(spark):
    for shares in ([0.97, 0.01, 0.01, 0.01], [0.25] * 4, [1.0], [0.5, 0.5]):
        plan = spark.createDataFrame([(i, s) for i, s in enumerate(shares)], "mix_id long, share double")
        got = M.with_slopes(plan, 0.9).collect()
        assert abs(sum(r["share"] * r["slope"] for r in got)) < 1e-12 and all(abs(r["slope"]) <= 0.95 + 1e-9 for r in got)


def test_positions_invert_the_cumulative_demand(spark):
    for s in (-0.9, -0.3, 0.0, 0.5, 0.95):
        for part in (0.0, 0.1, 0.5, 0.99, 1.0):
            t = spark.range(1).select(M.position(F.lit(part), F.lit(s))).first()[0]
            assert abs(t + s * (t - t * t) - part) < 1e-9
