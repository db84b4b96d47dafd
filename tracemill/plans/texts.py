"""Queries of text functions, filters and metrics over whole cases, examples and documents (X*, F*, A*), with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filters as P
from ..operators import metrics as M
from ..session import table
from .relational import cases
from .scoring import _TOK, NORM, S, scores
from .trajectories import examples

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


C = "(select distinct case_id, coalesce(question, '') as q, coalesce(model_answer, '') as a, ground_truth as g, difficulty, example_reasoning from demo_case)"
E = "(select distinct example_id, messages, images from data_example)"
_STRIP = r"regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"


def _texts(spark, d):
    x = cases(spark, d, "question", "model_answer", "ground_truth", "difficulty")
    return x.select("case_id", X.text_or_empty(F.col("question")).alias("q"), X.text_or_empty(F.col("model_answer")).alias("a"), F.col("ground_truth").alias("g"), "difficulty")


@query(
    f"""with t as (select *, '<think>' || q || '</think>' || chr(10) || a as t from {C})
select case_id, trim(regexp_extract(t, '<think>(.*?)</think>', 1, 's'), ' ') as block, trim(regexp_replace(t, '<think>.*?</think>\\s*', '', 'gs'), ' ') as rest, lower(regexp_extract(a, '\\b(basic|intermediate|advanced)\\b', 1, 'i')) as level,
 case lower(trim(a, ' ')) when 'yes' then 'Yes' when 'no' then 'No' else a end as title, trim(regexp_replace(regexp_replace('[INST]<image> ' || q || ' <|end|>[/INST]', '<\\|[^|]*\\|>|<image>|\\[/?INST\\]', ' ', 'g'), '[\\s\\x{{00A0}}]+', ' ', 'g'), ' ') as plain,
 case when q = '' then '<think>(t) </think>' || chr(10) || a else '<think>(t) ' || q || '</think>' || chr(10) || a end as tagged from t"""
)
def x12_think(spark, d):
    """X3, X12, X20's level, X45."""
    x = _texts(spark, d).withColumn("t", F.concat(F.lit("<think>"), "q", F.lit("</think>\n"), "a"))
    return x.select("case_id", X.think_block(F.col("t")).alias("block"), X.strip_think(F.col("t")).alias("rest"), X.difficulty_of(F.col("a")).alias("level"), X.title_yes_no(F.col("a")).alias("title"), X.drop_tags(F.concat(F.lit("[INST]<image> "), "q", F.lit(" <|end|>[/INST]"))).alias("plain"), X.tag_think(F.col("t"), F.lit("(t) ")).alias("tagged"))


_FIT = "trim(q, ' ') != '' and trim(a, ' ') != '' and not contains(a, '<think>') and not regexp_matches(q || a, 'answer:|thought|key knowledge', 'i')"


@query(
    f"""with t as (select *, {_STRIP.format("q || chr(10) || a")} as stray from {C} where {_FIT})
select case_id, case case_id % 3 when 0 then '<think>' || {_STRIP.format("q")} || '</think>' || chr(10) || {_STRIP.format("a")}
 when 1 then '<think>' || {_STRIP.format("regexp_extract(stray, '^(.*)\\n([^\\n]*)$', 1, 's')")} || '</think>' || chr(10) || {_STRIP.format("regexp_extract(stray, '^(.*)\\n([^\\n]*)$', 2, 's')")} else a end as formatted from t"""
)
def x19_thoughts(spark, d):
    """Marked thoughts, stray ones, and plain text."""
    x = _texts(spark, d).where(F.expr(_FIT.replace("trim(q, ' ')", "trim(q)").replace("trim(a, ' ')", "trim(a)").replace("regexp_matches(q || a, 'answer:|thought|key knowledge', 'i')", "rlike(q || a, '(?i)answer:|thought|key knowledge')")))
    n = F.col("case_id") % 3
    t = F.when(n == 0, F.concat(F.lit("Thought: "), "q", F.lit("\nFinal Answer: "), "a")).when(n == 1, F.concat(F.lit("thought\n"), "q", F.lit("\n"), "a")).otherwise(F.col("a"))
    return x.select("case_id", X.format_thought(t).alias("formatted"))


@query(
    f"""with t as (select case_id, g, trim(case when case_id % 2 = 0 then a || ' Overall the panel holds that this is (' || chr((65 + case_id % 3)::int) || ') as said' else a end, ' ') as t from {C}),
l as (select *, regexp_extract_all(t, '(\\([A-J]\\)[^\\n()]{{0,80}})', 1) as ls, lower(regexp_extract(t, '\\b(yes|no|maybe)\\b', 1, 'i')) as word from t)
select case_id, case when len(string_split_regex(t, '\\s+')) <= 10 then t when len(ls) > 0 then case when ls[-1][2:2] = 'A' and trim(coalesce(g, '')) != '' then '(A) ' || g when ls[-1][2:2] = 'B' then '(B) lipoma' else trim(ls[-1]) end when word != '' then word else t end as answer from l"""
)
def x21_answers(spark, d):
    """X21 with the options' texts."""
    t = F.when(F.col("case_id") % 2 == 0, F.concat("a", F.lit(" Overall the panel holds that this is ("), F.get(F.array(*map(F.lit, "ABC")), (F.col("case_id") % 3).cast("int")), F.lit(") as said"))).otherwise(F.col("a"))
    return _texts(spark, d).select("case_id", X.concise_answer(t, F.create_map(F.lit("A"), F.col("g"), F.lit("B"), F.lit("lipoma"))).alias("answer"))


_SCORE = "case when contains(right(a, 200), {v}) then 4 * length({r}) when contains(a, {v}) then 2 * length({r}) when len(list_intersect({t}, {u})) >= 0.6 * len({t}) then length({r}) else 0 end"
_OPTIONS = [("A", "g"), ("B", "'the lungs are clear'"), ("C", "'no answer can be given here'")]
_SCORES = ", ".join(_SCORE.format(v=NORM.format(v), r=v, t=_TOK.format(NORM.format(v)), u=_TOK.format("a")) + f" as s{k}" for k, v in _OPTIONS)


@query(
    f"""with t as (select case_id, g, {NORM.format("a")} as a from {C} where g is not null), s as (select case_id, {_SCORES} from t)
select case_id, case when greatest(sA, sB, sC) <= 5 then null when sA >= sB and sA >= sC then 'A' when sB >= sC then 'B' else 'C' end as letter from s"""
)
def x22_options(spark, d):
    """The option an answer means."""
    opts = F.create_map(F.lit("A"), F.col("g"), F.lit("B"), F.lit("the lungs are clear"), F.lit("C"), F.lit("no answer can be given here"))
    return _texts(spark, d).where("g is not null").select("case_id", X.best_option(F.col("a"), opts).alias("letter"))


@query(
    f"""with t as (select case_id, '[DIAGNOSIS]' || coalesce(g, '') || '[/DIAGNOSIS] [PLAN] ' || a as t from {C})
select case_id, coalesce(nullif(trim(regexp_extract(t, '\\[DIAGNOSIS\\](.*?)\\[/DIAGNOSIS\\]', 1, 'is')), ''), '') as diagnosis, case when length(trim(regexp_extract(t, '\\[PLAN\\](.*?)(?:\\[/?[A-Z_ ]+\\]|$)', 1, 'is'))) > 20 then trim(regexp_extract(t, '\\[PLAN\\](.*?)(?:\\[/?[A-Z_ ]+\\]|$)', 1, 'is')) else '' end as plan, '' as missing, trim(split_part(t, '[PLAN]', 1)) as head from t"""
)
def x26_sections(spark, d):
    """X23's cut at a marker, X26."""
    t = F.concat(F.lit("[DIAGNOSIS]"), F.coalesce("g", F.lit("")), F.lit("[/DIAGNOSIS] [PLAN] "), "a")
    return _texts(spark, d).select("case_id", X.tagged_section(t, "DIAGNOSIS").alias("diagnosis"), X.tagged_section(t, "PLAN").alias("plan"), X.tagged_section(t, "OTHER").alias("missing"), X.cut_at(t, "[PLAN]").alias("head"))


@query(
    f"""with t as (select example_id, example_id % 4 as n, images, coalesce(messages[2].content, '') as c from {E})
select example_id, coalesce(case when n = 3 then images[1] else images[n + 1] end, images[-1], images[1]) as image, (20 + n)::varchar || '-year-old' || case n when 0 then ' male' when 1 then ' female' else '' end as who,
 '(A) ' || c || chr(10) || '(B) no' as options, case when trim(c) != '' then c else 'else' end as core, 'see ' || c || ' and ' || n::varchar || ' and ' as filled, 'zoom' as call, n::varchar || ',7' as args, n::varchar as v from t"""
)
def x39_fields(spark, d):
    """X36, X39, X40, X41, X43, X44, X46."""
    c, n = X.text_or_empty(F.get("messages", F.lit(1))["content"]), F.col("n")
    x = examples(spark, d, "messages", "images").withColumn("n", F.col("example_id") % 4)
    s = n.cast("string")
    call = X.last_call(F.concat(F.lit("crop(1) then zoom("), s, F.lit(",7) done")))
    return x.select(
        "example_id",
        X.resolve_image(F.when(n == 3, "img_original").otherwise(F.concat(F.lit("img_round_"), s)), F.col("images")).alias("image"),
        X.demographics(20 + n, F.when(n == 0, "m").when(n == 1, "F")).alias("who"),
        X.options_text(F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), c)).alias("options"),
        X.core_parameter(F.create_map(F.lit("text"), F.lit("else"), F.lit("ans"), c)).alias("core"),
        X.fill_placeholders(F.lit("see <box> and <box> and <box>"), F.array(c, s)).alias("filled"),
        call["name"].alias("call"),
        call["args"].alias("args"),
        F.element_at(X.key_values(F.concat(F.lit("k=1,n="), s)), "n").alias("v"),
    )


_MARKS = " or ".join(f"contains(lower(coalesce(m.content, '')), '{w}')" for w in P.FAILURE_MARKERS)


@query(f"select example_id, coalesce(bool_or({_MARKS} or contains(lower(m.content), 'response'': ''''') or contains(lower(m.content), 'response\": \"\"')), false) as failed from (select example_id, unnest(case when len(messages) > 0 then messages else [null] end) as m from {E}) group by example_id")
def f3_failed(spark, d):
    """F3 over all messages of an example."""
    return examples(spark, d, "messages").select("example_id", F.coalesce(F.exists("messages", lambda m: P.failed(m["content"])), F.lit(False)).alias("failed"))


@query(
    f"""with t as (select *, case when example_reasoning is not null then map_entries(example_reasoning) end as e from {C})
select case_id, coalesce(len(e) > 0 and len(list_filter(e, lambda x: regexp_matches(coalesce(x.value, ''), 'Error in .* after 8 retries'))) = 0, false) as complete,
 case when difficulty = 'basic' and len(e) < 1 then 'basic_too_few_agents' when difficulty = 'intermediate' and len(e) < 5 then 'intermediate_too_few_agents' when difficulty = 'intermediate' and len(list_filter(e, lambda x: lower(x.key) = 'recruiter')) = 0 then 'intermediate_missing_recruiter'
 when difficulty = 'intermediate' and e is not null then 'intermediate_missing_summarizer' end as reason, coalesce(len(list_filter(e, lambda x: not (regexp_matches(trim(coalesce(x.value, '')), '^(yes|no|(?:\\d+(?:\\s*,\\s*\\d+)*))$', 'i') or length(trim(coalesce(x.value, ''))) >= 10))) = 0, true) as good from t"""
)
def f16_traces(spark, d):
    """Each role's reasoning as an agent."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    agents = F.transform(F.map_entries("example_reasoning"), lambda e: F.struct(e["key"].alias("agent_role"), F.lit("Say what you see").alias("instruction"), F.array(message("user", F.lit("?")), message("assistant", e["value"])).alias("messages")))
    x = table(spark, d, "demo_case").select("case_id", "difficulty", agents.alias("agents")).dropDuplicates(["case_id"])
    return x.select("case_id", P.complete_trace(F.col("agents")).alias("complete"), P.trace_structure(F.col("difficulty"), F.col("agents")).alias("reason"), P.good_responses(F.col("agents")).alias("good"))


_CHEST = " or ".join(f"contains(h, '{w}')" for w in P.CHEST_WORDS)
_OTHER = " or ".join(f"contains(h, '{w}')" for w in P.OTHER_MODALITIES)


@query(
    f"""with t as (select doc_id, lang, lower(left(coalesce(text, ''), 500)) as h from documents)
select doc_id, ({_CHEST}) and not ({_OTHER}) as chest, coalesce(lower(split_part(trim(lang), '-', 1)) = 'en', false) as english, lang is null or lower(trim(lang)) in ('nan', 'none') as no_lang from t"""
)
def f23_chest(spark, d):
    """F21's language, F23 and F26 over all documents."""
    x = table(spark, d, "documents")
    return x.select("doc_id", P.chest_report(F.col("text")).alias("chest"), P.in_language(F.col("lang")).alias("english"), P.none_like(F.col("lang")).alias("no_lang"))


@query(
    f"""with t as (select sample_id, pred as p, [gold, gold, 'no', 'yes', 'yes'] as l from {S} where pred is not null and gold is not null),
h as (select *, len(list_filter(l, lambda x: x = p)) as hits from t)
select sample_id, round(list_sum(list_transform(l, lambda x: least(1.0, (hits - (x = p)::int) / 3))) / 5, 6) as soft from h"""
)
def a10_soft(spark, d):
    """A10 with five annotators."""
    x = scores(spark, d, "gold", "pred").where("pred is not null and gold is not null")
    return x.select("sample_id", F.round(M.soft_accuracy(F.col("pred"), F.array("gold", "gold", F.lit("no"), F.lit("yes"), F.lit("yes"))), 6).alias("soft"))


@query(
    f"""with w as (select example_id, coalesce(len(images), 0) > 0 as seen, coalesce(list_sum(list_transform(messages, lambda m: case when trim(coalesce(m.content, '')) = '' then 0 else len(string_split_regex(trim(m.content), '\\s+')) end)), 0)::int as n from {E} where messages is not null)
select example_id, (case when seen then n + 128 else -n end)::int as length from w"""
)
def a19_lengths(spark, d):
    """A19 of chat examples."""
    x = examples(spark, d, "messages", "images").where("messages is not null")
    return x.select("example_id", M.sample_length(F.transform("messages", lambda m: m["content"]), F.coalesce(F.size("images"), F.lit(0)) > 0).alias("length"))


@query(
    f"""select example_id, role, string_agg(c, chr(10) order by i) as texts from (select example_id, i, coalesce(messages[i].role, '') as role, coalesce(messages[i].content, '') as c from (select *, unnest(range(1, len(messages) + 1)) as i from {E})) group by example_id, role"""
)
def a17_by_role(spark, d):
    """What each role says in an example."""
    return examples(spark, d, "messages").select("example_id", F.explode(M.text_by_key(F.col("messages"), "role", "content")).alias("role", "texts"))
