"""Filters, trajectories, sampling, joins, metrics, linking, streaming and sources on small fixtures."""

import gzip
import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from tracemill.operators import filters as P
from tracemill.operators import joins as J
from tracemill.operators import linking as K
from tracemill.operators import metrics as M
from tracemill.operators import sampling as W
from tracemill.operators import shred
from tracemill.operators import trajectory as T
from tracemill.sources import readers, writers
from tracemill.streaming import runtime as R

LOG = "idx string, question string, status string, is_correct boolean, gt_answer_raw array<string>, gt_answer_norm array<string>, gt_is_empty_list boolean, content_type string, semantic_type string, num_tools int, assistant_final string, tool_trace array<struct<event:string,tool_name:string,args:map<string,string>,content_text:string,content_preview:string>>"


def call(t):
    return ("tool_call", t, {"thought": "x"}, None, None)


def result(t, text):
    return ("tool_result", t, {}, text, None)


def test_behaviour_tags(spark):
    seg, exp = "chest_xray_segmentation", "chest_xray_expert"
    rows = [
        ("a", "q", "ok", False, ["x"], ["x"], False, "abnormality", "query", None, "y", [call(seg), result(seg, "Error: failed")]),
        ("b", "q", "ok", True, ["x"], ["x"], False, "abnormality", "query", None, "y", [call(seg), result(seg, "Error")]),
        ("c", "q", "ok", False, ["x"], ["x"], False, "abnormality", "query", None, "y", [call(exp), result(exp, "fine but long enough")]),
        ("d", "q", "ok", None, ["x"], ["x"], False, "plane", "choose", 5, "y", None),
        ("e", "q", "ok", False, ["edema"], ["edema"], False, "x", "query", 4, "clear lungs", [call(exp), result(exp, "clear lungs")]),
    ]
    x = P.behaviour(spark.createDataFrame(rows, LOG))
    got = {r["idx"]: (r["tags"], r["score"]) for r in x.collect()}
    assert got["a"] == (["seg_failed_no_recovery", "tool_failure_no_fallback"], 10 + 6 + 1)
    assert got["b"] == (["seg_failed"], 1)
    assert got["c"][0] == ["single_expert_wrong"] and got["c"][1] == 3
    assert got["d"] == ([], 0)
    assert got["e"][1] == -(10**9)
    kept = {r["idx"]: (r["tags"], r["score"]) for r in P.keep_single_expert(x.withColumn("content_type", F.lit("colour"))).collect()}
    assert kept["c"] == ([], 1)


def test_tree_paths_reach_every_leaf_or_fail(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(30)], "parent string, child string")
    assert {r["node"] for r in T.tree_paths(edges, "0").collect()} == {str(i + 1) for i in range(30)}
    with pytest.raises(Exception, match="RECURSION"):
        T.tree_paths(edges, "0", depth=10).collect()


def test_repeat_filters(spark):
    df = spark.createDataFrame([(["a", None, "a"], ["a", "a"], ["t"] * 3, ["t"] * 4, [True] * 3, [True] * 4)], "x array<string>, y array<string>, r3 array<string>, r4 array<string>, c3 array<boolean>, c4 array<boolean>")
    r = df.select(P.repeats_adjacent(F.col("x")), P.repeats_previous_call(F.col("y")), P.repeated_test(F.col("r3"), F.col("c3")), P.repeated_test(F.col("r4"), F.col("c4")), P.repeats_previous_call(F.array().cast("array<string>"))).first()
    assert list(r) == [False, True, False, True, False]


@pytest.mark.parametrize("text, want", [("short", False), ("x" * 60, True), ("Answer: x", False), ("**a", True), ("", True), (None, True), ("y" * 59 + ".", False)])
def test_truncated(spark, text, want):
    assert spark.createDataFrame([(text,)], "a string").select(P.truncated(F.col("a"))).first()[0] is want


def test_cascade_partitions_its_input(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 7 > 0, F.col("id")))
    kept, dropped = P.split_by_reason(df, P.reject([("null", F.col("v").isNull()), ("big", F.col("v") > 50)]))
    assert kept.count() + dropped.count() == 100
    assert {r[0] for r in dropped.select("drop_reason").distinct().collect()} == {"null", "big"}


AGENTS = "id int, difficulty string, agents array<struct<agent_role:string,instruction:string,messages:array<struct<role:string,content:string>>>>"


def agent(role, *texts, instruction=""):
    return (role, instruction, [("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)])


def test_traces(spark):
    five = [agent("Recruiter", "q", "panel of three"), agent("Heart expert", "q", "a long enough opinion.", "more", "Yes. I agree with that."), agent("x", "q", "summary of all views", instruction="Summarizing and synthesizing"), agent("y", "q", "fine with me here"), agent("Moderator", "q", "final answer is B.")]
    df = spark.createDataFrame([(1, "intermediate", five), (2, "basic", [agent("solo", "q", "bad")]), (3, "intermediate", []), (4, None, None)], AGENTS)
    r = {x["id"]: x for x in df.select("id", P.complete_trace(F.col("agents")).alias("c"), P.trace_structure(F.col("difficulty"), F.col("agents")).alias("s"), P.good_responses(F.col("agents")).alias("g"), P.truncated_for_type("5", F.col("agents")).alias("t"), T.expert_rows(F.lit("Q"), F.col("agents")).alias("e"), T.synthesis_row(F.lit("Q"), F.col("agents"), F.col("difficulty")).alias("y"), T.recruitment_row(F.lit("Q"), F.col("agents"), F.col("difficulty")).alias("rec")).collect()}
    assert (r[1]["c"], r[1]["s"], r[1]["g"], r[1]["t"]) == (True, None, True, False)
    assert [e["role"] for e in r[1]["e"]] == ["Heart expert"]
    assert r[1]["y"][1]["value"] == "<think>summary of all views</think>\nfinal answer is B."
    assert r[1]["rec"][1]["value"] == "panel of three"
    assert r[2]["g"] is False and r[2]["t"] is True
    assert r[3]["s"] == "intermediate_too_few_agents" and r[3]["c"] is False
    assert r[4]["c"] is False and r[4]["g"] is True


def test_log_to_chat_and_steps(spark):
    trace = [call("zoom"), result("zoom", "seen"), call("ocr"), result("ocr", "text")]
    df = spark.createDataFrame([("q", trace, "A"), ("q", [call("z"), call("z")], "A"), ("q", trace, "unknown"), (None, None, "A")], "q string, t array<struct<event:string,tool_name:string,args:map<string,string>,content_text:string,content_preview:string>>, a string")
    out = [r[0] for r in df.select(T.log_to_chat(F.col("q"), F.col("t"), F.col("a"))).collect()]
    assert [t["from"] for t in out[0]] == ["human", "function_call", "observation", "function_call", "observation", "gpt"]
    assert out[1] is None and out[2] is None and [t["from"] for t in out[3]] == ["human", "gpt"]
    steps = df.limit(1).select(T.log_to_chat(F.col("q"), F.col("t"), F.col("a")).alias("x")).select(T.numbered_calls(F.col("x"))).first()[0]
    assert [(s["step"], s["observation"]) for s in steps] == [(1, "seen"), (2, "text")]


TURNS = "turns array<struct<from:string,value:string>>"


def test_turn_rewrites(spark):
    t = [("human", "<image> look"), ("function_call", '<think>x</think>{"name": "Terminate", "arguments": {"ans": "B"}}')]
    df = spark.createDataFrame([(t, ["i1", "i2"])], f"{TURNS}, images array<string>")
    r = df.select(T.align_image_tags(F.col("turns"), F.col("images")).alias("a"), T.finish_terminate(F.col("turns")).alias("f"), T.align_system(F.lit("Think first. Be kind."), F.col("turns"), "Think first.").alias("s")).first()
    assert r["a"]["turns"] is None and r["a"]["reason"] == "rejected_not_enough_image_observations"
    assert [x["from"] for x in r["f"]] == ["human", "function_call", "observation", "gpt"] and r["f"][-1]["value"] == "B"
    assert r["s"] == "Think first. Be kind."
    ok = df.select(T.align_image_tags(F.col("turns"), F.array(F.lit("i1")))["turns"].alias("t")).first()["t"]
    assert sum(x["value"].count("<image>") for x in ok) == 1
    texts = spark.createDataFrame([(7, 0, "new")], "id int, step int, text string")
    new = T.replace_thinking(df.withColumn("id", F.lit(7)), texts, "id").first()
    assert new["turns"][1]["value"].startswith("<think>new</think>\n{") and new["retrospective"]
    m = [("user", str(i)) if i % 2 == 0 else ("assistant", "No.") for i in range(7)] + [("assistant", "Yes, one thing")]
    d = spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>").select(T.debate_rows(F.col("m"))).first()[0]
    assert [x["participated"] for x in d] == [False, True]
    assert d[0]["turns"][1]["value"].startswith("No, I have nothing")


def test_replay_rounds(spark):
    df = spark.createDataFrame([(["<think>a</think>x", "<think>b</think>y"], ["o1"], ["r1"])], "r array<string>, o array<string>, c array<string>")
    out = df.select(T.rounds_to_chat(F.lit("q"), F.col("r"), F.col("o"), F.col("c"))).first()[0]
    assert [t["from"] for t in out] == ["human", "function_call", "observation", "gpt"]
    assert out[-1]["value"] == "<think>r1 b</think>y"


def test_greedy_buckets_match_a_plain_walk(spark):
    r = random.Random(4)
    rows = [(i, f"u{r.randrange(40)}", r.choice("ab"), r.choice("xyz"), r.randrange(6)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, u string, k string, t string, s int")
    got = W.best_of_buckets(df, ["u"], ["k", "t"], "s", 3, 12, 5).collect()
    assert len(got) == 12 and len({x["u"] for x in got}) == 12
    import hashlib

    luck = lambda u: hashlib.md5(f"5|{u}".encode()).hexdigest()
    best: dict = {}
    for _, u, k, t, s in rows:
        b = best.setdefault((k, t), {})
        b[u] = max(b.get(u, -1), s)
    taken, want = set(), []
    for key in sorted(best, key=lambda b: (-max(best[b].values()), b)):
        n = 0
        for u in sorted(best[key], key=lambda u: (-best[key][u], luck(u), u)):
            if len(taken) < 12 and n < 3 and u not in taken:
                taken.add(u)
                want.append((*key, u))
                n += 1
    assert sorted((x["k"], x["t"], x["u"]) for x in got) == sorted(want)


def test_caps_chunks_and_batches(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 5))
    got = W.capped(df, ["k"], 10, [F.col("id")]).groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).collect()
    assert all(r["n"] == 10 for r in got) and {r["m"] for r in got if r["k"] == 0} == {9}
    n = spark.range(10)
    a = n.select(W.chunk_floor(F.col("id"), F.lit(10), 3).alias("f"), W.chunk_ceil(F.col("id"), F.lit(10), 3).alias("c")).collect()
    assert [sum(r["f"] == i for r in a) for i in range(3)] == [3, 3, 4] and [sum(r["c"] == i for r in a) for i in range(3)] == [4, 4, 2]
    b = W.length_batches(df.withColumn("len", F.col("id") + 1), "id", "len", 10, 4).groupBy("megabatch", "rank").agg(F.sum("len").alias("s"), F.count("*").alias("n")).collect()
    assert len(b) == 100 and all(r["n"] == 10 for r in b)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_same_choice_on_any_partitioning(spark, parts):
    df = spark.range(500).repartition(parts)
    assert [r[0] for r in W.shuffled(df, 3, ["id"], 5).collect()] == [r[0] for r in W.shuffled(spark.range(500), 3, ["id"], 5).collect()]


def test_joins(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 0.0), (None, 1.0), (1, 1.0)], "k int, s double")
    b = spark.createDataFrame([(2, 1.0), (2, 1.0), (3, 1.0), (None, 1.0), (1, 1.0)], "k int, s double")
    got = J.escalate(a, b, "k", F.col("s") == 1).groupBy("origin", "k").count().collect()
    assert {(r["origin"], r["k"]): r["count"] for r in got} == {("first", 1): 2, ("first", None): 1, ("second", 2): 1, ("second", 3): 1}
    assert J.resume(a, b, "k").count() == 1
    assert J.resume(J.resume(a, b, "k"), b, "k").count() == 1
    z = J.zip_by_order(spark.range(5).withColumnRenamed("id", "x"), spark.range(3).select((F.col("id") * 10).alias("y")), ["x"], ["y"])
    assert sorted(tuple(r) for r in z.collect()) == [(0, 0), (1, 10), (2, 20)]
    dim = spark.createDataFrame([(1, "one"), (1, "uno")], "k int, name string")
    assert {r["k"]: r["name"] for r in J.lookup(a, dim, ["k"], {"name": F.lit("?")}).collect()} == {1: "one", 2: "?", None: "?"}


def test_metrics(spark):
    df = spark.createDataFrame([("abc", ["abd"]), ("abc", ["xyz"]), ("", [""])], "p string, g array<string>")
    assert [round(r[0], 3) for r in df.select(M.anls(F.col("p"), F.col("g"))).collect()] == [0.667, 0.0, 0.0]
    v = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4), ("k", None, 0)], "k string, v string, t int")
    assert M.majority(v, "k", "v", "t").first()["majority"] == "b"
    s = spark.createDataFrame([("a", ["a", "a", "a", "a", "b"])], "p string, g array<string>").select(M.soft_accuracy(F.col("p"), F.col("g"))).first()[0]
    assert round(s, 4) == 1.0
    bleu = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat", 1), ("x", "y", 2), (None, None, 3)], "p string, g string, k int")
    assert {r["k"]: r["bleu4"] for r in M.bleu4(bleu, "p", "g", ["k"]).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    t = M.totals_and_groups(spark.createDataFrame([], "k string, s double"), "k", {"n": F.count("*"), "acc": M.accuracy(F.col("s"))}).collect()
    assert t == []  # no rows, no totals
    e = spark.createDataFrame([([("a", "1"), ("b", None), ("a", "2")],)], "x array<struct<t:string,v:string>>").select(M.text_by_key(F.col("x"), "t", "v")).first()[0]
    assert e == {"a": "1\n2", "b": ""}


def test_linking(spark):
    mk = spark.createDataFrame
    st = mk([(1, 10, "d1", "AP", "20230105"), (1, 10, "d2", "PA", "20230105"), (1, 11, "d3", "PA", "bad"), (2, 12, "d4", "LL", "20230105")], "subject_id long, study_id long, dicom_id string, viewposition string, studydate string")
    ad = mk([(1, 100, "2023-01-05 10:00:00", "2023-01-06 10:00:00")], "subject_id long, hadm_id long, admittime string, dischtime string")
    notes = mk([(1, 100, "note")], "subject_id long, hadm_id long, note string")
    lab = mk([(1, 10, 1.0)], "subject_id long, study_id long, edema double")
    pat = mk([(1, "F", 63)], "subject_id long, gender string, anchor_age int")
    dx = mk([(1, 100, 1, "I1", 10), (1, 100, 2, "I2", 10)], "subject_id long, hadm_id long, seq_num int, icd_code string, icd_version int")
    ti = mk([("I9", 10, "x")], "icd_code string, icd_version int, long_title string")
    labs = mk([(100, 5, "9", "g", 1.0, 8.0), (100, 6, "1", None, None, None), (999, 5, "1", "g", 0.0, 2.0)], "hadm_id long, itemid long, value string, valueuom string, ref_range_lower double, ref_range_upper double")
    it = mk([(5, "Hb", "Blood")], "itemid long, label string, category string")
    r = K.link(st, ad, notes, lab, pat, dx, ti, labs, it).collect()
    assert len(r) == 1 and r[0]["dicom_id"] == "d2" and r[0]["diagnosis"] == "I1"
    assert r[0]["results"] == {"Blood": {"Hb": "9 g (high)"}, "Other": {"Item_6": "1"}}
    assert K.label_names and mk([(1.0, -1.0, None)], "a double, b double, c double").select(K.label_names({"a": F.col("a"), "b": F.col("b"), "c": F.col("c")})).first()[0] == {"a": "Positive", "b": "Uncertain"}


def test_shredding_round_trip_and_defined_cases(spark):
    rows = [(1, ["a", None, "b"], '[{"x": 1, "findings": ["p", null]}, null, "s"]'), (2, [], " "), (3, None, "[Phone call] he said"), (4, ["a"], '{"episodes": null}'), (5, ["a"], '{"episodes": ["s"]}'), (1, ["a", None, "b"], '[{"x": 1, "findings": ["p", null]}, null, "s"]'), (None, ["z"], "t"), (6, None, None), (7, None, "{broken"), (8, None, '[{"findings": {}}]')]
    df = spark.createDataFrame(rows, "case_id long, r array<string>, h string").withColumn("body", F.lit("clash")).withColumn("hash", F.lit(1))
    b = shred.bridge(df, "t", "case_id", [shred.Node("r", "r", "array"), shred.Node("history", "h", "json")])
    got = sorted((x["parent_id"], x["node"], x["key1"], x["key2"]) for x in b.collect())
    assert got == [(1, "history", "0", ""), (1, "history", "2", ""), (1, "history.findings", "0", "0"), (1, "r", "0", ""), (1, "r", "2", ""), (3, "history", "0", ""), (4, "r", "0", ""), (5, "history", "0", ""), (5, "r", "0", ""), (7, "history", "0", ""), (8, "history", "0", "")]
    by = {(x["parent_id"], x["node"], x["key1"]): x for x in b.collect()}
    assert by[1, "history", "2"]["hash"] == by[5, "history", "0"]["hash"]  # equal subtrees, one identity
    assert by[4, "r", "0"]["parent_hash"] == by[5, "r", "0"]["parent_hash"] != by[1, "r", "0"]["parent_hash"]
    assert shred.objects(b).count() == b.select("hash").distinct().count() and shred.objects(b).agg(F.sum("occurrences")).first()[0] == b.count()
    assert shred.canonical_json({"b": 1, "a": [True]})[0] == shred.canonical_json({"a": [True], "b": 1})[0] != shred.canonical_json({"a": [1], "b": 1})[0]
    assert shred.canonical_json("5")[0] != shred.canonical_json(5)[0] != shred.canonical_json(5.0)[0]
    empty = shred.bridge(df.where("false"), "t", "case_id", [shred.Node("r", "r", "array")])
    assert empty.count() == 0


def test_every_parent_hash_is_an_object(spark):
    rows = [(1, {"a": {"x": "1", "y": None}, "b": {}}, [(1, "t")], '[{"findings": ["p", "p"]}, 5, "5"]'), (2, {"b": {"x": "1"}}, [(1, "t"), None, (1, None)], "[5]"), (3, {"c": {"x": "1"}, "a": None}, [], "prose"), (4, {"a": {"x": "1"}}, [(1, "t")], "prose"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id long, m map<string, map<string, string>>, s array<struct<n: int, t: string>>, h string")
    nodes = [shred.Node("m", "m", "map2"), shred.Node("s", "s", "array"), shred.Node("h", "h", "json")]
    b = shred.bridge(df, "t", "id", nodes, between=True)
    obj = shred.objects(b)
    assert b.where("parent_hash is not null").join(obj.select(F.col("hash").alias("parent_hash")), "parent_hash", "left_anti").count() == 0
    got = b.collect()
    inner = {(r["parent_id"], r["key1"]): r["hash"] for r in got if r["node"] == "m" and r["level"] == "inner"}
    assert set(inner) == {(1, "a"), (2, "b"), (3, "c"), (4, "a")} and len(set(inner.values())) == 1  # one inner map, stored once
    whole = {r["parent_id"]: r["hash"] for r in got if r["node"] == "m" and r["level"] == "collection"}
    assert whole[1] == whole[4] != whole[2]
    records = {r["parent_id"]: r["hash"] for r in got if r["level"] == "record"}
    assert len(records) == 5 == len(set(records.values()))
    items = {(r["parent_id"], r["key1"]): (r["hash"], r["kind"]) for r in got if r["node"] == "h" and r["level"] == "child"}
    assert items[1, "1"] == items[2, "0"] != items[1, "2"] and items[1, "2"][1] == "string"
    assert [r["key1"] for r in got if r["level"] == "inner" and r["node"] == "h.findings"] == ["0"]
    children = shred.bridge(df, "t", "id", nodes)
    assert children.count() == sum(r["level"] == "child" for r in got) and {r["level"] for r in children.collect()} == {"child"}


def test_sources_and_sinks(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nnot json\n{"x": 2}\n')
    got = readers.jsonl_tolerant(spark, f"{p}/a.jsonl", "x int").collect()
    assert sorted((r["x"], r["_parse_error"], r["_raw"]) for r in got if r["x"]) == [(1, False, None), (2, False, None)] and [r["_raw"] for r in got if r["_parse_error"]] == ["not json"]
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, f"{p}/a.jsonl", "x int").collect()
    assert readers.jsonl_skipping(spark, f"{p}/a.jsonl", "x int").count() == 2
    (tmp_path / "chunk_1.jsonl").write_text('{"x": 1}\n{bad\n{"x": 3}\n')
    (tmp_path / "chunk_2.jsonl").write_text('{"x": 4}\n')
    assert sorted(r["x"] for r in readers.chunks(spark, p, "x int").collect()) == [1, 4]
    assert readers.jsonl_limited(spark, [f"{p}/chunk_2.jsonl:1", f"{p}/a.jsonl:1"], "x int").count() == 2
    (tmp_path / "j").mkdir()
    (tmp_path / "j/ok.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "j/b_traces.json").write_text('[{"x": 3}]')
    (tmp_path / "j/obj.json").write_text('{"x": 9}')
    assert sorted(r["x"] for r in readers.json_folder(spark, f"{p}/j", "x int").collect()) == [1, 2]
    assert readers.json_array(spark, f"{p}/j/ok.json", "x int").count() == 2
    (tmp_path / "o.json").write_text('{"k1": {"x": 1}, "k2": {"x": 2}}')
    assert sorted(tuple(r) for r in readers.json_object(spark, f"{p}/o.json", "x int").collect()) == [("k1", 1), ("k2", 2)]
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("a,b,d\n1,x,20230105\n2,y,nope\n")
    assert [str(r["d"]) for r in readers.gzip_csv(spark, f"{p}/c.csv.gz", "a int, b string, d string", ["a", "d"], dates={"d": "yyyyMMdd"}).orderBy("a").collect()] == ["2023-01-05", "None"]
    (tmp_path / "i.tsv").write_text("id\timage\n1\taGk=\n")
    assert bytes(readers.tsv_images(spark, f"{p}/i.tsv", "id int, image string").first()["image"]) == b"hi"
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        for n, data in (("1.json", b'{"a": 1}'), ("1.jpg", b"img")):
            info = tarfile.TarInfo(n)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    r = readers.tar_samples(spark, f"{p}/s.tar").first()
    assert (r["key"], json.loads(r["json"]), bytes(r["image"])) == ("1", {"a": 1}, b"img")
    assert readers.prompt_sections("[A]\nx\n[B]\ny\nz") == {"A": "x", "B": "y\nz"}
    spark.range(3).write.parquet(f"{p}/q/train-0.parquet")
    assert readers.parquet_split(spark, f"{p}/q", "train").where("split = 'train'").count() == 3
    with pytest.raises(Exception):
        readers.parquet_split(spark, f"{p}/q", "test").count()
    assert json.loads(readers.tool_manifest('{"tools": [{"name": "a", "args_schema": {"properties": {"thought": {}, "x": {"type": "string"}}}}, {"name": "b", "args_schema": {"properties": {"y": {"type": "array", "items": {}}}}}]}')) == [{"name": "a", "description": "", "parameters": {"type": "object", "properties": {"x": {"type": "string"}}}}]
    writers.write_by_type(spark.createDataFrame([("a", 1), ("b", 2)], "sft_type string, x int"), f"{p}/out")
    assert spark.read.json(f"{p}/out").count() == 2
    imgs = spark.createDataFrame([(bytearray(b"1"),), (bytearray(b"1"),), (bytearray(b"2"),), (None,)], "c binary")
    assert writers.write_images_once(imgs, "c", f"{p}/img").count() == 2


def test_streaming(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [("a", "one"), ("a", "Terminate"), ("b", "x"), ("b", "y"), ("c", None)]
    spark.createDataFrame(rows, "item string, text string").coalesce(1).write.parquet(src)
    q = R.per_batch(R.stream_results(spark, src, "item string, text string"), lambda df: {"raw": df, "n": df.groupBy("item").count()}, out, f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{out}/raw").count() == 5 and spark.read.parquet(f"{out}/n").count() == 3
    s = R.item_states(R.stream_results(spark, src, "item string, text string"), 2)
    q = s.writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["item"]: (r["rounds"], r["status"]) for r in spark.sql("select * from states").collect()} == {"a": (2, "finished"), "b": (2, "finished"), "c": (1, "processing")}
    w = R.dispatch(spark.range(400), "id", [("a", 1.0, 4.0), ("b", 3.0, 3.0)], seed=2).groupBy("worker").count().collect()
    assert {r["worker"] for r in w} == {"a", "b"} and 240 < {r["worker"]: r["count"] for r in w}["b"] < 360
    assert R.dispatch(spark.range(1), "id", [("a", 1.0, 4.0), ("b", 3.0, 3.0)], "shortest_queue").first()["worker"] == "b"


def test_boxes(spark):
    from tracemill.operators import boxes as X

    b = [(0.0, 0.0, 10.0, 10.0, 0.9), (0.0, 0.0, 10.0, 10.5, 0.8), (20.0, 20.0, 30.0, 30.0, 0.7), (None, 0.0, 1.0, 1.0, 0.5)]
    df = spark.createDataFrame([(b,), (None,), ([],)], "b array<struct<x1:double,y1:double,x2:double,y2:double,score:double>>")
    r = df.select(X.nms(F.col("b")).alias("n"), X.subplots(F.col("b")).alias("s")).collect()
    assert [x["score"] for x in r[0]["n"]] == [0.9, 0.7] and [x["score"] for x in r[0]["s"]] == [0.8, 0.7] and r[1]["n"] == [] == r[2]["n"]
    p = spark.createDataFrame([([0, 1, 0, 1], [5.0, 7.0, 5.0, 9.0]), ([0, 0, 0, 0], [1.0] * 4)], "m array<int>, v array<double>")
    m = p.select(X.mask_statistics(F.col("m"), F.col("v"), F.lit(2)).alias("s"), X.window_level(F.col("v"), 7.0, 4.0).alias("w")).collect()
    assert tuple(m[0]["s"]) == (2, 1.0, 0.5, 1, 0, 1, 1, 8.0) and m[1]["s"] is None and m[0]["w"] == [0.0, 127.5, 0.0, 255.0]


def test_prompts_and_language(spark):
    from tracemill.functions import text as X

    df = spark.createDataFrame([("seen", "observation", "ask", "EN-us"), (" ", "image", "ask", None)], "o string, m string, q string, l string")
    r = df.select(X.next_prompt(F.col("o"), F.col("m"), F.col("q")), P.in_language(F.col("l"))).collect()
    assert [tuple(x) for x in r] == [("OBSERVATION:\nseen\n\nask", True), ("ask", False)]
    assert P.existing(df.withColumnRenamed("o", "p"), spark.createDataFrame([("seen",)], "path string"), "p").count() == 1


def test_length_batches_split_greedily(spark):
    import random

    r = random.Random(3)
    rows = [(i, r.choice([1, 1, 1, -1]) * r.randint(1, 60)) for i in range(230)]
    got = W.length_batches(spark.createDataFrame(rows, "id long, len int").withColumn("rows", F.lit("clash")), "id", "len", 5, 4, seed=2).collect()
    assert sorted((x["id"], x["len"]) for x in got) == sorted(rows) and {x["rows"] for x in got} == {"clash"}
    by: dict = {}
    for x in got:
        by.setdefault(x["megabatch"], []).append(x)
    for mega in by.values():
        if len(mega) % 4:
            continue
        sums, counts = [0.0] * 4, [0] * 4
        for v in sorted((abs(x["len"]) for x in mega), reverse=True):
            k = sums.index(min(sums))
            sums[k], counts[k] = sums[k] + v, counts[k] + 1
            if counts[k] == len(mega) // 4:
                sums[k] = float("inf")
        ranks = [[abs(x["len"]) for x in mega if x["rank"] == k] for k in range(4)]
        assert [len(x) for x in ranks] == [len(mega) // 4] * 4 == counts
    assert W.length_batches(spark.createDataFrame([], "id long, len int"), "id", "len", 5, 4).count() == 0


@pytest.mark.parametrize(
    "given, want",
    [
        ("2) intermediate\n\nneeds two views", "<think>needs two views</think>\n2) intermediate"),
        ("**Difficulty: 1) Basic**\n\n**Reasoning:** one fact", "<think>one fact</think>\n1) Basic"),
        ("Difficulty Assessment: it is hard. 3) advanced", "<think>it is hard.</think>\n3) advanced"),
        ("1) basic", "<think>Based on the nature of this medical query, it can be classified accordingly.</think>\n1) basic"),
        ("hard to say", "<think>hard to say</think>"),
    ],
)
def test_difficulty_assessments(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(T.difficulty_think(F.col("t"))).first()[0] == want


def test_difficulty_rows(spark):
    schema = "id int, q string, d string, agents array<struct<agent_role:string,instruction:string,messages:array<struct<role:string,content:string>>>>"
    own = [("Difficulty Assessor", "", [("user", "q"), ("assistant", "1) basic: easy")])]
    rows = [(1, "Q", "advanced", own), (2, "Q", "basic", None), (3, "Q", "intermediate", []), (4, "Q", "advanced", []), (5, "Q", None, None), (6, "Q", "basic", [("Difficulty Assessor", "", [])])]
    got = {r["id"]: r["t"] for r in spark.createDataFrame(rows, schema).select("id", T.difficulty_row(F.col("q"), F.col("agents"), F.col("d"), F.col("id") == 1).alias("t")).collect()}
    assert got[1][0]["value"].startswith("<image>\n") and got[1][1]["value"] == "<think>easy</think>\n1) basic"
    assert got[2][1]["value"].endswith("1) basic") and got[3][1]["value"].endswith("2) intermediate")
    assert got[4] is got[5] is got[6] is None


def test_only_found_nodes_have_paths(spark):
    edges = spark.createDataFrame([("r'", "a", True), ("a", "b", False), ("b", "c", True), ("a", "d", None)], "parent string, child string, seen boolean")
    assert {(r["node"], r["path"]) for r in T.tree_paths(edges, "r'", "seen").collect()} == {("a", "r' > a"), ("c", "r' > a > b > c")}


def test_attach_and_measured_broadcasts(spark):
    from tracemill.session import attach, broadcast_if_small

    x = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("k"), "id")
    counts = x.groupBy("k").count()
    got = attach(x, counts.select("k", F.length("k").alias("n")), ["k"], counts)
    assert got.count() == 3000 and got.where("n != length(k)").count() == 0
    big = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("s"), F.array("id").alias("a"))
    small, large = broadcast_if_small(big, size=5000), broadcast_if_small(big, size=500)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
    assert small.count() == large.count() == 10
