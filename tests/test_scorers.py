"""Truth tables of the scorers."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import scorers as E


def scored(spark, name, pred, gold, **more):
    df = spark.createDataFrame([(pred, gold)], "pred string, gold string").select("*", *(v().alias(k) for k, v in more.items()))
    r = E.score(df, name, "pred", "gold", *more).first()
    return r["score"], r["reason"]


OPTS = {"options": lambda: F.create_map(F.lit("A"), F.lit("Lipoma"), F.lit("B"), F.lit("Cyst"))}


@pytest.mark.parametrize(
    "name, pred, gold, want, more",
    [
        ("pathology", "Yes, it is", "yes", 1, {}),
        ("pathology", "no", "true", 0, {}),
        ("pathology", "bile ducts", "bile duct cells and canals", 1, {}),
        ("pathology", "", "liver", 0, {}),
        ("pathology", None, "liver", 0, {}),
        ("pathology", "hepatocelular carcinoma", "hepatocellular carcinomas seen", 1, {}),
        ("short_answer", "CT scan", "computed tomography", 1, {}),
        ("short_answer", "", "lung", 0, {}),
        ("short_answer", "kidnay", "kidney", 1, {}),
        ("radiology", "woman", "female", 1, {}),
        ("radiology", "iv", "oral and iv", 0, {}),
        ("radiology", "left side", "left hemisphere", 1, {}),
        ("radiology", "absent", "no", 1, {}),
        ("multiple_choice", "B", "cyst", 1, OPTS),
        ("multiple_choice", "A", "cyst", 0, OPTS),
        ("letter_choice", "Answer: (C)", "C", 1, OPTS),
        ("letter_choice", "A lesion, so C", "A", 1, OPTS),
        ("letter_choice", "cyst", "B", 1, OPTS),
    ],
)
def test_rules(spark, name, pred, gold, want, more):
    assert scored(spark, name, pred, gold, **more)[0] == want


@pytest.mark.parametrize("pred, gold, want", [("", [], 1), ("no acute findings", ["effusion"], 0), ("bilateral effusions seen", ["effusion", "edema"], 1), ("yes", ["yes"], 1), ("x", None, 0), ("", None, 1), ("None", [], 1)])
def test_findings(spark, pred, gold, want):
    df = spark.createDataFrame([(pred, gold)], "p string, g array<string>")
    assert df.select(E.findings(F.col("p"), F.col("g"))["score"]).first()[0] == want


def test_small_ones(spark):
    df = spark.createDataFrame([("the answer is (b) x", "B", "unknown", "It is not there. Yes.", "… maybe, but yes", "The answer is B.", "[0.85]", "7, 8.5\nx")], "a string, b string, c string, d string, e string, f string, g string, h string")
    r = df.select(
        E.exam_contains(F.col("a"), F.col("b")),
        E.contains_label(F.col("c"), F.lit("no")),
        E.object_presence(F.col("d")),
        E.rightmost_label(F.col("e")),
        E.science_choice(F.col("f"), F.lit(1))["score"],
        E.judged_similar(F.col("g")),
        E.score_pair(F.col("h")),
        E.score_pair(F.col("a"))["a"],
        E.contains_any(F.lit("Pleural effusion."), F.array(F.lit("effusion"))),
        E.dispatch(F.lit("medqa"), F.col("a"), F.lit(""))["score"],
        E.chart_value(F.lit("12.5%"), F.lit("12"))["score"],
        E.last_letter(F.lit("(A) then Answer: B")),
    ).first()
    assert list(r) == [1.0, 1.0, "no", "yes", 1.0, True, (7.0, 8.5), -1.0, 1.0, 1.0, 1.0, "A"]


def test_registry():
    with pytest.raises(ValueError):
        E.register("pathology", E.pathology)


def test_nfkc_only_touches_what_it_must(spark):
    from tracemill.functions.unicode import with_nfkc

    df = spark.createDataFrame([(1, "ﬁne ½", ["²", None], {"A": "Ｘ", "B": None}), (2, "plain", ["x"], {"A": "y"}), (3, None, None, None), (4, "", [], {})], "id int, s string, a array<string>, m map<string,string>")
    got = {r["id"]: (r["s"], r["a"], r["m"]) for r in with_nfkc(df, "s", "a", "m").collect()}
    assert got == {1: ("fine 1⁄2", ["2", None], {"A": "X", "B": None}), 2: ("plain", ["x"], {"A": "y"}), 3: (None, None, None), 4: ("", [], {})}
    two = spark.createDataFrame([("ﬁbrosis", "Fibrosis", "keep"), ("cyst", "Ｆibrosis", "keep")], "pred string, gold string, __0 string").withColumnRenamed("__0", "extra")
    assert sorted((r["score"], r["pred"]) for r in E.score(two, "pathology", "pred", "gold").collect())[1] == (1.0, "ﬁbrosis")


def test_dispatch_takes_the_answer_out_first(spark):
    rows = [
        (1, "medqa", "<think>not (A)</think>\n(B) because", "b", 1.0),
        (2, "medqa", "Thought: (B)\nAnswer: (A)\n(B)", "B", 0.0),
        (3, "pubmedqa", "Answer: maybe", "maybe", 1.0),
        (4, "pathvqa", "<think>yes</think> no", "No", 1.0),
        (5, "pathvqa", "fibroadenomas", "fibroadenoma", 1.0),
        (6, "pathvqa", "fibroadenona of brest", "fibroadenoma of breast", 1.0),
        (7, "pathvqa", "gout", "lipoma", 0.0),
        (8, "pathvqa", "", "lipoma", 0.0),
        (9, "medqa", "anything", None, 1.0),
        (10, "other", "anything", "x", 1.0),
        (11, None, None, "x", 1.0),
        (12, "pathvqa", "<think>x</think>   ", "x", 1.0),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "id int, dataset string, response string, label string").withColumn("reason", F.lit("clash"))
    got = {r["id"]: r["score"] for r in E.check_correct(df.drop("reason"), "dataset", "response", "label").collect()}
    assert got == {r[0]: r[4] for r in rows}
