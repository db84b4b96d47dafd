"""Predicates, taggers and reject cascades (survey F1-F23, F25, F26). JSON-bound ones (F14, F24) are in functions.lenient.

Predicates are Columns that are never null. A cascade names the first failing rule, so kept and dropped rows together
are always the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_empty

#: Marks of a failed tool.
FAILURE_MARKERS = ["error", "failed", "traceback", "exception", "invalid", "badrequest", "timeout", "connection refused", "maximum"]
#: Words that deny a finding.
NEGATION_MARKERS = ["no", "none", "negative", "normal", "without", "absent", "not seen", "no evidence"]
#: Words that state a finding.
AFFIRM_MARKERS = ["present", "seen", "found", "there is", "there are", "identified", "demonstrates", "shows"]
#: Findings and the words a tool may use for them.
TOOL_SYNONYMS = {
    "ng tube": ["ng tube", "nasogastric", "enteric tube", "feeding tube", "dobhoff"],
    "pleural effusion": ["pleural effusion", "effusion"],
    "lung opacity": ["lung opacity", "opacity", "infiltrate", "consolidation"],
    "enlarged cardiac silhouette": ["enlarged cardiac silhouette", "cardiomegaly", "enlarged heart"],
}
#: Content types that are about behaviour.
BEHAVIOUR_TYPES = ["presence", "anatomy", "attribute", "plane", "gender", "size"]
#: Phrases of a question that asks to point.
POINTING = ["point out", "locate", "where is", "show me"]
#: Symptoms a question must name before reasoning may. Eleven, and three more for traces.
SYMPTOMS = ["cough", "fever", "shortness of breath", "dyspnea", "chest pain", "symptom", "history of", "chills", "weight loss", "night sweats", "clinical history"]
TRACE_SYMPTOMS = [*SYMPTOMS, "patient reports", "patient complains", "patient states"]
#: Characters that may end a finished response.
TERMINAL = ".!?。！？)）]】\"'*`"
#: Tag weights.
WEIGHTS = {
    "seg_failed_no_recovery": 10,
    "seg_failed_no_retry": 7,
    "tool_task_mismatch_plane": 6,
    "tool_failure_no_fallback": 6,
    "grounding_on_none": 5,
    "negation_misread": 5,
    "tool_failure_with_fallback_but_wrong": 2,
    "single_expert_wrong": 2,
    "seg_failed": 1,
}


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def any_in(t: Column, words: list[str]) -> Column:
    """Any word as a substring of lower-case text."""
    low = F.lower(text_or_empty(t))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def wrong(is_correct: Column) -> Column:
    """Only a real false is wrong; null is not."""
    return true(~is_correct)


def answers(raw: Column, norm: Column) -> Column:
    """Lower-case ground truths without blanks: the normalised list if it has any, else the raw one."""
    pick = F.when(F.size(norm) > 0, norm).otherwise(F.coalesce(raw, F.array().cast("array<string>")))
    return F.filter(F.transform(pick, lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x, F.lit("")) != "")


def toxic(question: Column, raw: Column, norm: Column) -> Column:
    """an empty raw list, or a pointing question whose truth is none."""
    none = true(F.exists(norm, lambda x: F.lower(x) == "none"))
    return true(F.size(raw) == 0) | none & any_in(question, POINTING)


def tool_text(event: Column) -> Column:
    return F.coalesce(F.when(event["content_text"] != "", event["content_text"]), event["content_preview"], F.lit(""))


def calls_of(trace: Column) -> Column:
    """Names of the calls in order."""
    names = F.transform(F.filter(trace, lambda e: e["event"] == "tool_call"), lambda e: F.trim(text_or_empty(e["tool_name"])))
    return F.coalesce(F.filter(names, lambda n: n != ""), F.array().cast("array<string>"))


def results_of(trace: Column) -> Column:
    return F.filter(F.coalesce(trace, F.array()), lambda e: e["event"] == "tool_result")


def failed(text: Column) -> Column:
    """F3 on one result: a marker, an error status, or an empty response."""
    low = F.lower(text_or_empty(text))
    return any_in(text, FAILURE_MARKERS) | low.contains("response': ''") | low.contains('response": ""')


def tool_limit(status: Column, is_correct: Column, calls: Column, text: Column, gold: Column, pred: Column, only: str = "chest_xray_expert") -> Column:
    """one expert alone, too few truths in its text (by synonym), short text, and an answer that repeats it."""
    low = F.lower(text_or_empty(text))
    syn = F.create_map(*(x for k, v in TOOL_SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    named = lambda g: low.contains(g) | true(F.exists(F.element_at(syn, g), lambda s: low.contains(s)))
    hits = F.size(F.filter(gold, named))
    few = hits < F.greatest(F.lit(1), F.floor(F.lit(0.6) * F.size(gold)))
    words = F.array_distinct(F.slice(F.regexp_extract_all(low, F.lit(r"([a-zA-Z_]+)"), 1), 1, 200))
    p = F.lower(text_or_empty(pred))
    overlap = F.size(F.filter(words, lambda w: p.contains(w))) / F.greatest(F.size(words), F.lit(1))
    one = (F.size(F.array_distinct(calls)) == 1) & (F.get(calls, F.lit(0)) == only)
    real = (F.size(gold) > 0) & (gold != F.array(F.lit("none")))
    return true((status == "ok") & wrong(is_correct) & one & real & few & (F.length(low) < 2000) & (overlap > 0.6))


def behaviour(df: DataFrame) -> DataFrame:
    """Adds tags and score to tool logs (schema of the tool_logs fixture). Tool-limit rows score -1e9."""
    trace = F.col("tool_trace")
    calls, results = calls_of(trace), results_of(trace)
    of = lambda tool: F.array_join(F.transform(F.filter(results, lambda e: F.trim(text_or_empty(e["tool_name"])) == tool), tool_text), "\n")
    gold = answers(F.col("gt_answer_raw"), F.col("gt_answer_norm"))
    x = df.withColumns({"__calls": calls, "__results": F.transform(results, tool_text), "__gold": gold, "__wrong": wrong(F.col("is_correct"))})
    calls, bad, w, gold = F.col("__calls"), F.exists("__results", failed), F.col("__wrong"), F.col("__gold")
    has = lambda *names: F.arrays_overlap(calls, F.array(*map(F.lit, names)))
    n = F.coalesce("num_tools", F.size(calls))
    seg_bad = has("chest_xray_segmentation") & any_in(of("chest_xray_segmentation"), FAILURE_MARKERS)
    retry = F.size(F.filter(calls, lambda c: c == "chest_xray_segmentation")) >= 2
    other = has("chest_xray_classifier", "chest_xray_report_generator", "chest_xray_expert")
    kind, sem = F.lower(F.trim(F.coalesce("content_type", F.lit("unknown")))), F.lower(F.trim(F.coalesce("semantic_type", F.lit("unknown"))))
    single = F.size(F.array_distinct(calls))
    plane = ((kind == "plane") | (sem == "choose")) & any_in(F.col("question"), ["ap", "pa", "perspective"])
    empty = true(F.col("gt_is_empty_list"))
    all_text = F.array_join("__results", "\n")
    tag = lambda c, t: F.when(true(c), t)
    tags = F.array_compact(
        F.array(
            F.when(true(seg_bad & ~retry & ~other & w), "seg_failed_no_recovery").when(true(seg_bad & ~retry & w), "seg_failed_no_retry").when(true(seg_bad), "seg_failed"),
            tag((n >= 4) & w, "multi_tool_panic"),
            tag(plane & has("image_visualizer", "chest_xray_report_generator", "chest_xray_segmentation", "xray_phrase_grounding") & w, "tool_task_mismatch_plane"),
            tag(empty & has("xray_phrase_grounding") & w, "grounding_on_none"),
            tag(empty & any_in(all_text, NEGATION_MARKERS) & any_in(F.col("assistant_final"), AFFIRM_MARKERS) & w, "negation_misread"),
            F.when(true(bad & w & (single <= 1)), "tool_failure_no_fallback").when(true(bad & w), "tool_failure_with_fallback_but_wrong"),
            tag(w & (single == 1) & (F.get(calls, F.lit(0)) == "chest_xray_expert"), "single_expert_wrong"),
        )
    )
    weight = F.create_map(*(F.lit(v) for kv in WEIGHTS.items() for v in kv))
    panic = F.when((F.size(gold) >= 1) & (gold != F.array(F.lit("none"))), 6).otherwise(1)
    total = F.aggregate(tags, F.lit(0), lambda s, t: s + F.when(t == "multi_tool_panic", panic).otherwise(F.coalesce(F.element_at(weight, t), F.lit(0)))) + w.cast("int")
    limit = tool_limit(F.col("status"), F.col("is_correct"), calls, of("chest_xray_expert"), gold, F.col("assistant_final"))
    return x.withColumns({"tags": tags, "score": F.when(limit, -(10**9)).otherwise(total)}).drop("__calls", "__results", "__gold", "__wrong")


def keep_single_expert(df: DataFrame, most_truths: int = 4) -> DataFrame:
    """single_expert_wrong stays for verify questions, behaviour types and short abnormality lists; else the tag and two points go."""
    kind, sem = F.lower(F.trim(F.coalesce("content_type", F.lit("unknown")))), F.lower(F.trim(F.coalesce("semantic_type", F.lit("unknown"))))
    gold = answers(F.col("gt_answer_raw"), F.col("gt_answer_norm"))
    like = (sem == "verify") | kind.isin(BEHAVIOUR_TYPES) | (kind == "abnormality") & (F.size(gold) <= most_truths)
    strip = F.array_contains("tags", "single_expert_wrong") & ~like
    return df.withColumns({"score": F.when(strip, F.greatest(F.lit(0), F.col("score") - 2)).otherwise(F.col("score")), "tags": F.when(strip, F.array_remove("tags", "single_expert_wrong")).otherwise(F.col("tags"))})


def easy(status: Column, is_correct: Column, failures: Column, tools: Column, answer: Column) -> Column:
    """ok, right, no failures, at most one tool, an answer."""
    return true((status == "ok") & is_correct & (F.coalesce(failures, F.lit(0)) == 0) & (F.coalesce(tools, F.lit(0)) <= 1) & (F.trim(text_or_empty(answer)) != ""))


def reject(rules: list[tuple[str, Column]]) -> Column:
    """the name of the first rule that holds, null for a kept row. Rules after it are not evaluated; null is no."""
    return F.coalesce(*(F.when(true(c), F.lit(n)) for n, c in rules))


def unasked_symptom(text: Column, question: Column, symptoms: list[str] = SYMPTOMS) -> Column:
    """F8: a symptom in the text that the question does not name."""
    t, q = F.lower(text_or_empty(text)), F.lower(text_or_empty(question))
    out = F.lit(False)
    for s in symptoms:
        out = out | t.contains(s) & ~q.contains(s)
    return out


def repeats_previous_call(signatures: Column) -> Column:
    """a call equal to the previous call, whatever turns lie between (signatures of the calls alone)."""
    n = F.size(signatures)
    return true(F.when(n > 1, F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.get(signatures, i) == F.get(signatures, i - 1))))


def repeats_adjacent(signatures: Column) -> Column:
    """equal signatures on adjacent turns; a turn that is no call has a null signature and resets."""
    return repeats_previous_call(signatures)


def longest_run(tests: Column, is_call: Column) -> Column:
    """the longest run of the same test over calls. Turns that are no calls are skipped, a call without a test resets.

    tests and is_call are arrays of equal length.
    """
    turns = F.filter(F.zip_with(tests, is_call, lambda t, c: F.struct(t.alias("t"), c.alias("c"))), lambda x: x["c"])
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x["t"].isNull(), 0).when(x["t"] == s["last"], s["run"] + 1).otherwise(1)
        return F.struct(x["t"].alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(turns, start, step, lambda s: s["best"])


def repeated_test(tests: Column, is_call: Column, repeats: int = 3) -> Column:
    """`repeats` repetitions, so one more than that in a row."""
    return true(longest_run(tests, is_call) > repeats)


def total_length(texts: Column, *more: Column) -> Column:
    """characters of all turns and further fields; nulls count 0."""
    n = F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.lit(0), lambda s, t: s + F.coalesce(F.length(t), F.lit(0)))
    for m in more:
        n = n + F.coalesce(F.length(m), F.lit(0))
    return n


def thinks_in_circles(text: Column, longer: int = 3000, sentences: int = 10, share: float = 0.3) -> Column:
    """long text of many sentences (over 20 characters) of which few are distinct."""
    s = F.filter(F.transform(F.split(text_or_empty(text), r"\."), lambda s: F.trim(s)), lambda x: F.length(x) > 20)
    return true((F.length(text) > longer) & (F.size(s) > sentences) & (F.size(F.array_distinct(s)) / F.size(s) < share))


def terminate_checks(turns: Column, images: Column) -> Column:
    """reason or null. turns: array of struct(from, name, arguments map, value).

    Exactly one Terminate call, ans its only argument, the final turn equal to it, as many image tags as images.
    """
    calls = F.filter(turns, lambda t: (t["from"] == "function_call") & (t["name"] == "Terminate"))
    args = F.get(calls, F.lit(0))["arguments"]
    last = F.element_at(turns, -1)
    tags = F.aggregate(turns, F.lit(0), lambda s, t: s + F.coalesce(F.regexp_count(t["value"], F.lit("<image>")), F.lit(0)))
    return reject(
        [
            ("terminate_count", F.size(calls) != 1),
            ("terminate_args", (F.size(args) != 1) | ~F.array_contains(F.map_keys(args), "ans")),
            ("final_differs", F.trim(last["value"]) != F.trim(F.element_at(args, "ans"))),
            ("image_tags", tags != F.coalesce(F.size(images), F.lit(0))),
        ]
    )


def complete_trace(agents: Column) -> Column:
    """F16: every agent has messages, the last by the assistant, none a recorded final error."""
    ok = lambda a: (F.size(a["messages"]) > 0) & (F.get(a["messages"], F.size(a["messages"]) - 1)["role"] == "assistant") & ~F.exists(a["messages"], lambda m: text_or_empty(m["content"]).rlike(r"Error in .* after 8 retries"))
    return true(F.forall(agents, ok)) & true(F.size(agents) > 0)


def trace_structure(difficulty: Column, agents: Column) -> Column:
    """reason or null."""
    has = lambda f: F.exists(agents, f)
    mid = difficulty == "intermediate"
    return reject(
        [
            ("basic_too_few_agents", (difficulty == "basic") & (F.size(agents) < 1)),
            ("intermediate_too_few_agents", mid & (F.size(agents) < 5)),
            ("intermediate_missing_recruiter", mid & ~has(lambda a: F.lower(text_or_empty(a["agent_role"])) == "recruiter")),
            ("intermediate_missing_summarizer", mid & ~has(lambda a: F.lower(text_or_empty(a["instruction"])).contains("summarizing and synthesizing"))),
            ("intermediate_missing_moderator", mid & ~has(lambda a: F.lower(text_or_empty(a["agent_role"])) == "moderator")),
        ]
    )


def good_responses(agents: Column, least: int = 10) -> Column:
    """the last assistant response of each agent has `least` characters or is a bare yes, no or list of numbers."""

    def ok(a: Column) -> Column:
        last = F.get(a["messages"], F.size(a["messages"]) - 1)
        t = F.trim(text_or_empty(last["content"]))
        return ~true(last["role"] == "assistant") | t.rlike(r"(?i)^(yes|no|(?:\d+(?:\s*,\s*\d+)*))$") | (F.length(t) >= least)

    return F.coalesce(F.forall(agents, ok), F.lit(True))


def truncated(text: Column) -> Column:
    """under 5 characters, odd bold marks, or over 50 characters without a terminal character (unless it has 'Answer: x')."""
    t = F.rtrim(text_or_empty(text))
    short = F.length(F.trim(t)) < 5
    bold = F.regexp_count(t, F.lit(r"\*\*")) % 2 != 0
    end = F.lit(TERMINAL).contains(F.substring(t, -1, 1))
    return short | bold | ~t.rlike(r"\bAnswer:\s*\S") & (F.length(t) > 50) & ~end


#: Which agent's response each output type looks at (F20); types not named are not checked.
TRUNCATION_TARGETS = {"5": "last", "1r": "recap", "2r": "recap", "5r": "recap"}


def truncated_for_type(kind: str, agents: Column) -> Column:
    """truncation of the agent that matters for an output type."""
    target = TRUNCATION_TARGETS.get(kind)
    if target is None:
        return F.lit(False)
    said = lambda a: F.get(F.reverse(F.filter(a["messages"], lambda m: m["role"] == "assistant")), F.lit(0))["content"]
    if target == "last":
        final = F.get(agents, F.size(agents) - 1)
        return F.when(F.coalesce(F.size(agents), F.lit(0)) == 0, True).otherwise(F.when(said(final).isNotNull(), truncated(said(final))).otherwise(False))
    named = F.filter(agents, lambda a: F.lower(text_or_empty(a["agent_role"])).contains(target))
    return true(F.exists(named, lambda a: said(a).isNotNull() & truncated(said(a))))


def frontal(view: Column) -> Column:
    """PA and AP only, any case."""
    return true(F.upper(F.trim(view)).isin("PA", "AP"))


def view_priority(view: Column) -> Column:
    return F.when(F.upper(F.trim(view)) == "PA", 0).when(F.upper(F.trim(view)) == "AP", 1)


#: Words of a chest radiograph report and of other modalities.
CHEST_WORDS, OTHER_MODALITIES = ["chest", "cxr", "portable ap", "pa and lat"], ["ct ", "computed tomography", "mri", "magnetic resonance", "ultrasound"]


def chest_report(text: Column, head: int = 500) -> Column:
    """the first 500 characters name a chest film and no other modality (the head is the rule, not a shortcut)."""
    t = F.substring(text_or_empty(text), 1, head)
    return any_in(t, CHEST_WORDS) & ~any_in(t, OTHER_MODALITIES)


def valid_scenario(osce: Column) -> Column:
    """the four required parts are there."""
    return osce.isNotNull() & osce["objective_for_doctor"].isNotNull() & osce["patient_actor"].isNotNull() & osce["physical_examination_findings"].isNotNull() & osce["correct_diagnosis"].isNotNull()


def in_language(lang: Column, wanted: str = "en") -> Column:
    """the language code without region or case."""
    return true(F.lower(F.substring_index(F.trim(lang), "-", 1)) == wanted)


def existing(df: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """rows whose file is in a listing (column path), as one semi-join instead of a look-up per row."""
    return df.join(listing.select(F.col("path").alias(path)), path, "left_semi")


def none_like(c: Column) -> Column:
    """null, or the text nan or none."""
    return c.isNull() | true(F.lower(F.trim(c.cast("string"))).isin("nan", "none"))


def options_until_none(options: Column) -> Column:
    """options up to the first that is none-like."""
    stop = F.array_min(F.filter(F.transform(options, lambda o, i: F.when(none_like(o), i)), lambda i: i.isNotNull()))
    return F.when(stop.isNull(), options).otherwise(F.slice(options, F.lit(1), stop))


def split_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped rows; dropped rows carry drop_reason."""
    x = df.withColumn("drop_reason", reason)
    return x.where("drop_reason is null").drop("drop_reason"), x.where("drop_reason is not null")
