"""Truth tables of text functions and parsers."""

import pytest
from pyspark.sql import functions as F

from tracemill.functions import fuzzy as Z
from tracemill.functions import lenient as L
from tracemill.functions import text as X


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return tuple(df.select(*cols).first())


@pytest.mark.parametrize(
    "f, given, want",
    [
        (X.strip_explanations, "The organ (left) is liver. More", "the organ"),
        (X.strip_explanations, None, ""),
        (X.norm_yes_no, "Yes, it is", "yes"),
        (X.norm_yes_no, "it is FALSE", "no"),
        (X.norm_yes_no, "y", "yes"),
        (X.norm_yes_no, "maybe", ""),
        (X.title_yes_no, " YES", "Yes"),
        (X.title_yes_no, "yes, it is", "yes, it is"),
        (X.basic_norm, "Heart & Lung!", "heart and lung"),
        (X.final_answer, "a\n[FINAL] liver\nmore", "liver"),
        (X.final_answer, "liver.", "liver"),
        (X.final_answer, None, ""),
        (X.strip_think, "<think>a\nb</think>\nc", "c"),
        (X.think_block, "<think> a </think> c", "a"),
        (X.finding_norm, "NG-Tube / PICC line", "ng tube picc"),
        (X.format_thought, "Thought: x\nFinal Answer: y", "<think>x</think>\ny"),
        (X.format_thought, "thought\na\nb", "<think>a</think>\nb"),
        (X.format_thought, "**Key Knowledge:** k **Total Analysis:** t", "<think>k</think>\nt"),
        (X.format_thought, "plain", "plain"),
        (X.difficulty_of, "I think Intermediate suits", "intermediate"),
        (X.short_answer_norm, "The two lungs.", "2 lungs"),
        (X.drop_tags, "a <|x|>  <image> b", "a b"),
        (lambda c: X.cut_at(c, "##"), "a ## b", "a"),
        (lambda c: X.truncate_sentence(c, 10), "abcdefg. hij", "abcdefg. ..."),
        (lambda c: X.truncate_sentence(c, 10), "short", "short"),
        (lambda c: X.tagged_section(c, "DIFF"), "x [DIFF] yes [/DIFF]", "yes"),
        (lambda c: X.anonymise_paths(c, F.lit("P")), "see p10/p1000/s5/ab-1.jpg or /mnt/x/y.png", "see P or P"),
    ],
)
def test_scalar(spark, f, given, want):
    assert one(spark, f(F.col("a")), a=given)[0] == want


def test_structures(spark):
    assert [tuple(p) for p in one(spark, X.points(F.col("a"), F.lit(200), F.lit(100)), a='x="50" y="25" x="150" y="1"')[0]] == [(100.0, 25.0)]
    assert [tuple(e) for e in one(spark, X.hierarchy_edges(F.col("a")), a="m > a > b")[0]] == [("m", "a"), ("a", "b")]
    assert one(spark, X.hierarchy_edges(F.col("a")), a=None)[0] == []
    assert one(spark, X.list_items(F.col("a")), a="['x', y; z]")[0] == ["x", "y", "z"]
    assert tuple(one(spark, X.last_call(F.col("a")), a="f(1) then g(2, 3)")[0]) == ("g", "2, 3")
    assert one(spark, X.last_call(F.col("a")), a="none")[0] is None
    box = F.array(*(F.lit(float(v)) for v in (10, 10, 110, 60)))
    assert one(spark, X.pad_box(box, F.lit(120), F.lit(60)), a="")[0] == [0.0, 5.0, 120.0, 60.0]
    assert one(spark, X.fill_placeholders(F.col("a"), F.array(F.lit("1"))), a="p <box> q <box> r")[0] == "p 1 q  r"
    assert one(spark, X.key_values(F.col("a")), a="a=1,b=2")[0] == {"a": "1", "b": "2"}
    opts = F.create_map(F.lit("A"), F.lit("lung cyst"), F.lit("B"), F.lit("renal colic"))
    assert one(spark, X.best_option(F.col("a"), opts), a="It is a renal colic.")[0] == "B"
    assert one(spark, X.best_option(F.col("a"), opts), a="nothing")[0] is None
    assert one(spark, X.simulated_path(F.col("a")), a="k") == one(spark, X.simulated_path(F.col("a")), a="k")


def test_ratios():
    assert Z.ratio("abc", "abc") == 100 and Z.ratio("abcd", "abxd") == 75 and Z.ratio("", "a") == 0
    assert Z.partial_ratio("liver", "the liver is") == 100
    assert Z.token_sort_ratio("iv and oral", "oral and iv") == 100
    assert Z.token_set_ratio("left lung", "the left lung lobe") == 100
    assert Z.token_set_ratio("", "x") == 0


@pytest.mark.parametrize("n", range(30))
def test_lcs_by_table(n):
    import random

    r = random.Random(n)
    a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in "ab")
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert Z.lcs(a, b) == t[-1][-1]


def test_lenient():
    assert L.last_object('text {"a":{"b":1}} tail') == '{"a":{"b":1}}'
    assert L.last_object(None) is None and L.last_object("} x") is None
    assert L.first_object('x {bad} ```json\n{"k": 1}\n```') == '{"k": 1}'
    assert L.tool_calls('<tool_call>{"name": "f", "arguments": {"b": 1, "a": 2}}</tool_call>') == [("f", '{"a": 2, "b": 1}')]
    assert L.tool_calls("actions: [{'API_name': 'g', 'API_params': {}}] end") == [("g", "{}")]
    assert L.tool_calls("[]") == [] and L.tool_calls(None) == []
    assert L.valid_call('<think>x</think>{"name": 1, "arguments": {}}') and not L.valid_call("[]") and not L.valid_call('{"name": 1}')
    assert L.repair_call('<think>x {"name": "f"}') == '<think>x</think>\n{"name": "f"}'
    assert L.repair_call('{"a": 1}\n{"b": 2}').strip() == '[{"a": 1}, {"b": 2}]'
    assert L.clean_observation("('text', {'m': 1})") == "text" and L.clean_observation("plain") == "plain"
    assert L.signature("f", "{'b': 1, 'a': 2}") == 'f::{"a": 2, "b": 1}'
    assert L.bad_schema('{"x": {"type": "array", "items": {}}}') and not L.bad_schema('{"type": "array", "items": {"type": "string"}}')
    assert L.redact('{"base64_data": "abc", "k": [{"image": "z", "n": 1}]}') == '{"base64_data": "<redacted>", "k": [{"image": "<redacted>", "n": 1}]}'
    assert L.sections("History: a\nExam: b\nc", ("history", "exam")) == {"history": "a", "exam": "b\nc"}
    assert L.exam_lines("HEENT: ok\nfree text") == {"HEENT": "ok", "General": "free text"}
