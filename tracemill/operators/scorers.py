"""Answer scorers (survey E1-E17): Column builders that give struct<score double, reason string>.

They disagree on purpose; each keeps its own order of rules. A missing prediction is an empty answer. Rules up to the
fuzzy one are built-in expressions. The fuzzy ratios run only on rows those rules left undecided: `score` splits the
frame, so no Python sees a decided row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.fuzzy import fuzzy, fuzzy_max
from ..functions.unicode import with_nfkc

OPEN = "undecided"


def verdict(cond_score: list[tuple[Column, float, str]], last: str = "mismatch", last_score: float = 0.0) -> Column:
    """First rule whose condition holds (null counts as false)."""
    out = None
    for c, s, r in cond_score:
        v = F.struct(F.lit(s).alias("score"), F.lit(r).alias("reason"))
        out = F.when(c, v) if out is None else out.when(c, v)
    end = F.struct(F.lit(last_score).alias("score"), F.lit(last).alias("reason"))
    return out.otherwise(end) if out is not None else end


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, also inside lambda functions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def either_contains(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


# E1, E2 -----------------------------------------------------------------------------------------------------------


def pathology(pred: Column, gold: Column) -> Column:
    """E1 and E2 without symbolic verification: yes/no gold by equality, else exact, containment, token subset; else undecided."""
    gyn = X.norm_yes_no(gold)
    p, g, pc, gc = X.norm_text(pred), X.norm_text(gold), X.strip_explanations(pred), X.strip_explanations(gold)
    return verdict(
        [
            ((gyn != "") & (X.norm_yes_no(pred) == gyn), 1.0, "yesno"),
            (gyn != "", 0.0, "yesno"),
            ((g != "") & (p == g), 1.0, "open_exact"),
            ((gc != "") & (pc == gc), 1.0, "open_exact_clean"),
            ((g == "") | (p == ""), 0.0, "open_empty"),
            (either_contains(p, g), 1.0, "open_contain_norm"),
            (either_contains(pc, gc), 1.0, "open_contain_clean"),
            (X.token_subset(p, g) | X.token_subset(pc, g), 1.0, "open_token_subset"),
        ],
        OPEN,
    )


def pathology_fuzzy(pred: Column, gold: Column) -> Column:
    p, g, pc = X.norm_text(pred), X.norm_text(gold), X.strip_explanations(pred)
    return fuzzy_max([(n, a, g) for n in ("partial_ratio", "token_set_ratio", "ratio") for a in (p, pc)])


# E3 ---------------------------------------------------------------------------------------------------------------


def findings(pred: Column, gold: Column) -> Column:
    """Gold is an array of strings. Null and [] mean none; a negative answer to a positive gold is wrong; else any gold contained or soft-matched."""
    none = gold.isNull() | (F.size(gold) == 0)
    norm = F.array_distinct(F.filter(F.transform(gold, lambda x: X.finding_norm(x)), lambda x: x != ""))
    g = F.when(none, F.array(F.lit("none"))).otherwise(norm)
    made = F.struct(g.alias("g"), X.final_answer(pred).alias("final"))
    made = let(made, lambda v: F.struct(v["g"].alias("g"), v["final"].alias("final"), X.finding_norm(v["final"], fluff=True).alias("p")))
    made = let(made, lambda v: F.struct(v["g"].alias("g"), v["final"].alias("final"), v["p"].alias("p"), X.terms_of(v["p"]).alias("terms")))
    return let(made, lambda v: _findings(v["g"], v["final"], v["p"], v["terms"]))


def _findings(g: Column, final: Column, p: Column, terms: Column) -> Column:
    only = lambda *w: (F.size(g) > 0) & (F.size(F.array_except(g, F.array(*map(F.lit, w)))) == 0)
    pyn = F.when(p.rlike(r"\byes\b"), "yes").when(p.rlike(r"\bno\b"), "no").otherwise("")
    negative = X.is_negative_finding(p)
    hit = F.exists(g, lambda x: p.contains(x) | F.exists(terms, lambda t: X.soft_match(x, t)))
    return verdict(
        [
            (F.size(g) == 0, 0.0, "no_gold"),
            (only("none") & (negative | X.is_negative_finding(final) | (p == "")), 1.0, "none_ok"),
            (only("none"), 0.0, "none_wrong"),
            (only("yes", "no") & F.array_contains(g, pyn), 1.0, "yesno"),
            (only("yes", "no"), 0.0, "yesno"),
            (negative, 0.0, "negative_vs_positive"),
            (hit, 1.0, "matched"),
        ]
    )


# E4 ---------------------------------------------------------------------------------------------------------------

#: Variants and their canonical form. Longer ones are replaced first, as substrings.
SHORT_SYNONYMS = {
    "computed tomography": "ct",
    "ct scan": "ct",
    "cta": "ct",
    "magnetic resonance imaging": "mri",
    "mr": "mri",
    "mr image": "mri",
    "x ray": "xray",
    "x-ray": "xray",
    "xray image": "xray",
    "ultrasound": "us",
    "ultrasonography": "us",
    "thorax": "chest",
    "pulmonary": "lung",
    "lungs": "lung",
    "abdomen": "abdominal",
    "abdominal": "abdomen",
    "kidneys": "kidney",
    "hepatic": "liver",
    "left side": "left",
    "right side": "right",
    "lt": "left",
    "rt": "right",
    "true": "yes",
    "false": "no",
}
#: Words a short answer is compared without.
SHORT_STOPWORDS = ["a", "an", "the", "of", "to", "in", "on", "and"]


def canonical_short(c: Column) -> Column:
    """Stopwords out, whole-string synonym, else substring synonyms longest first and the whole string once more."""
    s = F.array_join(F.filter(F.split(X.basic_norm(c), " "), lambda t: (t != "") & ~t.isin(SHORT_STOPWORDS)), " ")
    known = list(SHORT_SYNONYMS)
    by_length = {k: SHORT_SYNONYMS[k] for k in sorted(known, key=len, reverse=True)}
    r = X.squeeze(X.replace_all(s, by_length))
    return F.when(s.isin(known), X.lookup(s, SHORT_SYNONYMS)).otherwise(X.lookup(r, SHORT_SYNONYMS))


def short_answer(pred: Column, gold: Column) -> Column:
    """E4 up to the fuzzy rules."""
    p, g = canonical_short(pred), canonical_short(gold)
    pt, gt = F.split(p, " "), F.split(g, " ")
    return verdict(
        [
            ((p == g) & (p != ""), 1.0, "exact"),
            ((p == "") | (g == ""), 0.0, "empty"),
            (either_contains(p, g), 1.0, "substring"),
            (F.size(F.array_except(gt, pt)) == 0, 1.0, "token_subset_gold_in_pred"),
            (F.size(F.array_except(pt, gt)) == 0, 1.0, "token_subset_pred_in_gold"),
        ],
        OPEN,
    )


def short_answer_fuzzy(pred: Column, gold: Column) -> Column:
    p, g = canonical_short(pred), canonical_short(gold)
    return fuzzy_max([("ratio", p, g), ("partial_ratio", p, g)])


# E5 ---------------------------------------------------------------------------------------------------------------

#: Number words and concept groups (name: alternatives).
CONCEPT_NUMBERS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "zero": "0", "none": "0"}
CONCEPTS = {
    "male": ["man", "boy", "gentleman"],
    "female": ["woman", "girl", "lady"],
    "frontal": ["ap", "pa", "anterior posterior", "posterior anterior", "coronal"],
    "lateral": ["lat", "side view"],
    "air": ["gas"],
    "left side": ["left hemisphere", "left lung", "left lobe"],
    "right side": ["right hemisphere", "right lung", "right lobe"],
    "intestine": ["bowel", "colon", "small intestine", "large intestine"],
    "iv": ["intravenous"],
    "oral": ["po"],
}
#: Words a radiology answer is compared without.
RADIOLOGY_STOP = ["and", "or", "with", "without", "the", "a", "an", "in", "on", "of", "to"]


def radiology_norm(c: Column) -> Column:
    return X.basic_norm(c, " and ", " or ")


def concept(s: Column) -> Column:
    return X.lookup(s, {a: k for k, alts in CONCEPTS.items() for a in alts} | CONCEPT_NUMBERS)


def radiology_yes_no(c: Column) -> Column:
    t = radiology_norm(c)
    w = lambda p: t.rlike(rf"\b(?:{p})\b")
    return F.when(t.rlike(r"^yes( |$)"), "yes").when(t.rlike(r"^no( |$)"), "no").when(w("yes"), "yes").when(w("no"), "no").when(w("true"), "yes").when(w("false"), "no").when(w("absent|not present|not seen|no evidence"), "no").when(w("present|seen|evident"), "yes")


def radiology(pred: Column, gold: Column) -> Column:
    """E5 up to the fuzzy rule. A yes/no mismatch is not final."""
    g, p = radiology_norm(gold), radiology_norm(pred)
    gc, pc = concept(g), concept(p)
    words = lambda s: F.array_distinct(F.filter(F.split(s, " "), lambda t: (t != "") & ~t.isin(RADIOLOGY_STOP)))
    gt, pt = words(g), words(p)
    one = F.get(gt, F.lit(0))
    contained = F.when(F.size(gt) > 1, F.size(F.array_except(gt, pt)) == 0).when(F.size(gt) == 1, F.exists(pt, lambda t: concept(t) == concept(one)) | p.contains(one)).otherwise(False)
    return verdict(
        [
            (radiology_yes_no(gold) == radiology_yes_no(pred), 1.0, "yesno_match"),
            (gc == pc, 1.0, "exact_canon"),
            (contained, 1.0, "containment"),
            (gc.contains("left") & pc.contains("left"), 1.0, "lateralization_match"),
            (gc.contains("right") & pc.contains("right"), 1.0, "lateralization_match"),
        ],
        OPEN,
    )


def radiology_fuzzy(pred: Column, gold: Column) -> Column:
    return fuzzy("token_sort_ratio", radiology_norm(gold), radiology_norm(pred))


# E6, E7, E13 ------------------------------------------------------------------------------------------------------


def option_yes_no(c: Column) -> Column:
    t = X.basic_norm(c)
    w = lambda p: t.rlike(rf"\b(?:{p})\b")
    return F.when(w("yes"), "yes").when(w("no"), "no").when(w("true"), "yes").when(w("false"), "no").when(w("normal|no anomaly|no abnormal"), "no").when(w("abnormal|anomaly|abnormality present|lesion|fracture"), "yes")


def option_prediction(pred: Column, options: Column) -> Column:
    """The text of the option whose letter (a-d) stands alone first, else the normalised prediction."""
    letter = F.upper(F.regexp_extract(F.lower(F.trim(X.text_or_empty(pred))), r"\b([abcd])\b", 1))
    return X.basic_norm(F.coalesce(F.when(letter != "", F.element_at(options, letter)), pred))


def multiple_choice(pred: Column, gold: Column, options: Column) -> Column:
    """E6 up to the fuzzy rule; options is a map A-D -> text. If both sides read as yes or no, that decides."""
    gy, py = option_yes_no(gold), option_yes_no(pred)
    g, p = X.basic_norm(gold), option_prediction(pred, options)
    return verdict([(gy == py, 1.0, "yesno"), (gy.isNotNull() & py.isNotNull(), 0.0, "yesno_mismatch"), ((p != "") & (p == g), 1.0, "exact"), (either_contains(p, g), 1.0, "substring"), ((p == "") | (g == ""), 0.0, "mismatch")], OPEN)


def multiple_choice_fuzzy(pred: Column, gold: Column, options: Column) -> Column:
    return fuzzy("ratio", option_prediction(pred, options), X.basic_norm(gold))


def letter_choice(pred: Column, gold: Column, options: Column) -> Column:
    """The first standalone A-E, else the letter of the option with the same text."""
    letter = F.regexp_extract(F.upper(F.trim(X.text_or_empty(pred))), r"\b([A-E])\b", 1)
    same = F.filter(F.map_entries(options), lambda e: F.upper(F.trim(e["key"])).isin(*"ABCDE") & (X.basic_norm(e["value"]) == X.basic_norm(pred)))
    by_text = F.coalesce(F.upper(F.trim(F.get(same, F.size(same) - 1)["key"])), F.lit(""))
    g = F.upper(F.trim(X.text_or_empty(gold)))
    return verdict([((letter != "") & (letter == g), 1.0, "letter"), (letter != "", 0.0, "letter"), ((by_text != "") & (by_text == g), 1.0, "option_text"), (by_text != "", 0.0, "option_text")], "unparsed")


def science_choice(pred: Column, answer_index: Column, letters: str = "ABCDE") -> Column:
    """The exact letter, an 'A. ' prefix, or exactly one 'The answer is X.'; else failed."""
    p = X.text_or_empty(pred)
    found = F.regexp_extract_all(p, F.lit(r"The answer is ([A-Z])."), 1)
    got = F.when(p.isin(*letters), p).when(p.rlike(rf"^[{letters}]\. "), F.substring(p, 1, 1)).when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("FAILED")
    return verdict([(got == "FAILED", 0.0, "failed"), (F.position(got, F.lit(letters)) - 1 == answer_index, 1.0, "letter")])


# E8-E12, E14, E16, E17 ----------------------------------------------------------------------------------------------


def chart_value(pred: Column, gold: Column) -> Column:
    """E8 without symbolic verification: equality, then without % and decimals. A null prediction is the text 'None'."""
    p = F.trim(F.lower(F.replace(F.coalesce(pred, F.lit("None")), F.lit('"'), F.lit(""))))
    g = F.trim(F.lower(F.replace(X.text_or_empty(gold), F.lit('"'), F.lit(""))))
    whole = F.substring_index(F.replace(p, F.lit("%"), F.lit("")), ".", 1)
    return verdict([(p == g, 1.0, "equal"), ((p.contains("%") | p.contains(".")) & (whole == g), 1.0, "truncated")])


#: Answer patterns, in the order in which their matches are listed.
LETTER_PATTERNS = [
    r"Answer:\s*\(?([A-E])\)?",
    r"The correct answer is\s*\(?([A-E])\)?",
    r"Final Answer:\s*\(?([A-E])\)?",
    r"Correct Answer:\s*\(?([A-E])\)?",
    r"\*\*Answer:\s*\(?([A-E])\)?\*\*",
    r"\(([A-E])\)",
    r"(?:^|\n)\s*([A-E])\)\s",
    r"^([A-E])$",
]
#: Patterns of a verdict, in the order they are tried.
VERDICT_PATTERNS = [r"answer:\s*(yes|no|maybe)", r"final answer:\s*(yes|no|maybe)", r"conclusion:\s*(yes|no|maybe)", r"\*\*(yes|no|maybe)\*\*"]


def last_letter(c: Column) -> Column:
    """The last match in pattern order (not text order); null if none."""
    all_ = F.concat(*(F.regexp_extract_all(X.text_or_empty(c), F.lit(f"(?im){p}"), 1) for p in LETTER_PATTERNS))
    return F.when(F.size(all_) > 0, F.upper(F.element_at(all_, -1)))


def exam_contains(pred: Column, gold: Column) -> Column:
    """E9, containment of '(x)'."""
    return F.lower(F.trim(X.text_or_empty(pred))).contains(F.concat(F.lit("("), F.lower(F.trim(X.text_or_empty(gold))), F.lit(")"))).cast("double")


def rightmost_label(c: Column) -> Column:
    """The last match of the first pattern that matches, else the rightmost of yes, no, maybe in the last 100 characters; else unknown."""
    t = F.lower(X.text_or_empty(c))
    hits = [F.regexp_extract_all(t, F.lit(p), 1) for p in VERDICT_PATTERNS]
    tail = F.reverse(F.when(F.length(t) > 100, F.substring(t, -100, 100)).otherwise(t))
    # positions from the end: the smallest distance of a label's start wins
    at = lambda w: F.when(F.locate(w[::-1], tail) > 0, F.struct((F.locate(w[::-1], tail) + len(w)).alias("d"), F.lit(w).alias("w")))
    near = F.array_min(F.filter(F.array(at("yes"), at("no"), at("maybe")), lambda x: x.isNotNull()))
    return F.coalesce(*(F.when(F.size(h) > 0, F.element_at(h, -1)) for h in hits), near["w"], F.lit("unknown"))


def contains_label(pred: Column, gold: Column) -> Column:
    """E10 and E11 on one label: plain containment after lower-casing, quirks of substrings included."""
    return F.lower(F.trim(X.text_or_empty(pred))).contains(F.lower(F.trim(X.text_or_empty(gold)))).cast("double")


def contains_any(pred: Column, golds: Column) -> Column:
    """Any normalised label in the normalised prediction."""
    p = X.basic_norm(pred)
    return F.coalesce(F.exists(golds, lambda g: p.contains(X.basic_norm(g))), F.lit(False)).cast("double")


def dispatch(dataset: Column, answer: Column, label: Column) -> Column:
    """E12 on an extracted answer: struct(score, reason) by the dataset's scorer. An empty label and an unknown dataset count as
    correct; an answer about pathology that no rule decides is undecided."""
    sure = lambda s, reason: F.struct(s.cast("double").alias("score"), F.lit(reason).alias("reason"))
    return (
        F.when(X.text_or_empty(label) == "", sure(F.lit(1.0), "no_label"))
        .when(dataset == "medqa", sure(exam_contains(answer, label), "letter"))
        .when(dataset == "pubmedqa", sure(contains_label(answer, label), "label"))
        .when(dataset == "pathvqa", pathology_answer(answer, label))
        .when(dataset == "mimic-cxr-vqa", sure(findings(answer, F.array(label))["score"], "findings"))
        .otherwise(sure(F.lit(1.0), "no_scorer"))
    )


def pathology_answer(pred: Column, gold: Column) -> Column:
    """The pathology rules as the dispatcher has them: both answers' tokens are compared with the plain gold, and an empty one is undecided by rule."""
    gyn = X.norm_yes_no(gold)
    p, g, pc, gc = X.norm_text(pred), X.norm_text(gold), X.strip_explanations(pred), X.strip_explanations(gold)
    return verdict(
        [
            ((gyn != "") & (X.norm_yes_no(pred) == gyn), 1.0, "yesno"),
            (gyn != "", 0.0, "yesno"),
            ((g != "") & (p == g) | (gc != "") & (pc == gc), 1.0, "exact"),
            (either_contains(p, g) | either_contains(pc, gc), 1.0, "contains"),
            (X.token_subset(p, g) | X.token_subset(pc, g), 1.0, "tokens"),
            ((g == "") | (p == ""), 0.0, "empty"),
        ],
        OPEN,
    )


def check_correct(df: DataFrame, dataset: str, response: str, label: str) -> DataFrame:
    """Df with score and reason. The answer is taken out of the response first; text is compared in NFKC; answers about
    pathology that the rules leave undecided go through the fuzzy rule (70), and only they."""
    x = df.withColumns({"__a": X.answer_of(F.col(response)), "__l": X.text_or_empty(F.col(label))})
    x = with_nfkc(x, "__a", "__l").withColumn("__v", dispatch(F.col(dataset), F.col("__a"), F.col("__l")))
    x = x.withColumns({"score": F.col("__v.score"), "reason": F.col("__v.reason")}).drop("__v")
    rest = x.where(F.col("reason") == OPEN).withColumn("__r", pathology_fuzzy(F.col("__a"), F.col("__l")))
    rest = rest.withColumns({"score": (F.col("__r") >= 70).cast("double"), "reason": F.when(F.col("__r") >= 70, "fuzzy").otherwise("mismatch")}).drop("__r")
    return x.where(F.col("reason") != OPEN).unionByName(rest).drop("__a", "__l")


def object_presence(c: Column) -> Column:
    """No if the first sentence, without commas, has the word No, not or no; else yes."""
    words = F.split(F.replace(F.substring_index(X.text_or_empty(c), ".", 1), F.lit(","), F.lit("")), " ")
    return F.when(F.arrays_overlap(words, F.array(F.lit("No"), F.lit("not"), F.lit("no"))), "no").otherwise("yes")


def judged_similar(c: Column, threshold: float = 0.8) -> Column:
    """The bracketed score of a recorded judgement against the threshold; no score is wrong."""
    return F.coalesce(F.regexp_extract(X.text_or_empty(c), r"\[\s*([01](?:\.\d+)?)\s*\]", 1).try_cast("double") >= threshold, F.lit(False))


def score_pair(c: Column) -> Column:
    """Two numbers on the first line, blank or comma between, else (-1, -1)."""
    parts = F.split(F.trim(F.replace(F.substring_index(X.text_or_empty(c), "\n", 1), F.lit(","), F.lit(" "))), r"\s+")
    a, b = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    ok = (F.size(parts) == 2) & a.isNotNull() & b.isNotNull()
    return F.struct(F.when(ok, a).otherwise(-1.0).alias("a"), F.when(ok, b).otherwise(-1.0).alias("b"))


#: name -> (rules, fuzzy column, threshold). The registry a task plugs into.
REGISTRY: dict[str, tuple[Callable[..., Column], Callable[..., Column] | None, int]] = {
    "pathology": (pathology, pathology_fuzzy, 70),
    "findings": (findings, None, 0),
    "short_answer": (short_answer, short_answer_fuzzy, 80),
    "radiology": (radiology, radiology_fuzzy, 85),
    "multiple_choice": (multiple_choice, multiple_choice_fuzzy, 80),
    "letter_choice": (letter_choice, None, 0),
    "science_choice": (science_choice, None, 0),
}


#: Scorers that compare text in NFKC.
NORMALISED = {"pathology", "radiology", "multiple_choice"}


def register(name: str, rules: Callable[..., Column], fuzzy_rule: Callable[..., Column] | None = None, threshold: int = 80) -> None:
    """Adds a scorer under a name; an existing name is an error."""
    if name in REGISTRY:
        raise ValueError(f"scorer {name} exists")
    REGISTRY[name] = (rules, fuzzy_rule, threshold)


def score(df: DataFrame, name: str, *cols: str, threshold: int | None = None) -> DataFrame:
    """Adds score and reason. Undecided rows alone go through the fuzzy rule (reason fuzzy, or mismatch below the threshold)."""
    rules, fuzzy_rule, least = REGISTRY[name]
    given, names = df.columns, [f"__{i}" for i in range(len(cols))]
    df = df.withColumns({n: F.col(c) for n, c in zip(names, cols)})
    if name in NORMALISED:
        df = with_nfkc(df, *(n for n in names if dict(df.dtypes)[n] in ("string", "array<string>", "map<string,string>")))
    cols = tuple(names)
    v = rules(*map(F.col, cols))
    out = df.withColumn("__v", v).withColumns({"score": F.col("__v.score"), "reason": F.col("__v.reason")}).drop("__v")
    if fuzzy_rule is None:
        return out.select(*given, "score", "reason")
    least = least if threshold is None else threshold
    rest = out.where(F.col("reason") == OPEN).withColumn("__r", fuzzy_rule(*map(F.col, cols)))
    rest = rest.withColumns({"score": (F.col("__r") >= least).cast("double"), "reason": F.when(F.col("__r") >= least, "fuzzy").otherwise("mismatch")}).drop("__r")
    return out.where(F.col("reason") != OPEN).unionByName(rest).select(*given, "score", "reason")
