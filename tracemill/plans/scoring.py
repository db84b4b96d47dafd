"""Queries of scorers and metrics on the score table (E*, A*, J10, X*), with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import sampling as W
from ..operators import scorers as E
from ..session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def scores(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """per_sample once per row with the columns asked for, model names in one spelling."""
    x = table(spark, d, "per_sample")
    return x.select("sample_id", *(F.lower("model_name").alias("model") if c == "model" else c for c in columns)).distinct()


S = "(select distinct sample_id, task_name, lower(model_name) as model, idx, score, gold, pred, question, image_path, scored_at from per_sample)"
_P = r"'[!-/:-@\[-`{{-~]'"
NORM = r"trim(regexp_replace(lower(trim(coalesce({0}, ''))), '\s+', ' ', 'g'))"
_BN = r"trim(regexp_replace(regexp_replace(replace(lower(trim(coalesce({0}, ''))), '&', 'and'), " + _P + r", '', 'g'), '\s+', ' ', 'g'))"
_RN = _BN.replace("'&', 'and')", "'&', ' and ')").replace("replace(lower(trim(coalesce({0}, ''))), '&', ' and ')", "replace(replace(lower(trim(coalesce({0}, ''))), '&', ' and '), '/', ' or ')")
_YN = r"case when regexp_matches({0}, '\byes\b') then 'yes' when regexp_matches({0}, '\bno\b') then 'no' when regexp_matches({0}, '\btrue\b') then 'yes' when regexp_matches({0}, '\bfalse\b') then 'no' when {0} = 'y' then 'yes' when {0} = 'n' then 'no' else '' end"
_STRIP = r"trim(regexp_replace(trim(regexp_extract(trim(regexp_extract(trim(regexp_replace({0}, '\([^)]*\)', '', 'g')), '^([^.;:\n\r]*)', 1)), '^(.*?)(?:\b(?:is|are)\b|$)', 1)), '\s+', ' ', 'g'))"
_TOK = r"list_distinct(list_filter(list_transform(string_split_regex(trim(regexp_replace(regexp_replace({0}, '[^a-z0-9\s\-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: case when length(t) > 3 and ends_with(t, 's') and not ends_with(t, 'ss') then t[:-2] else t end), lambda t: t != ''))"


@query(
    f"""with s as (select *, {NORM.format("pred")} as p, {NORM.format("gold")} as g from {S}),
t as (select *, {_YN.format("g")} as gyn, {_YN.format("p")} as pyn, {_STRIP.format("p")} as pc, {_STRIP.format("g")} as gc from s),
u as (select *, {_TOK.format("p")} as pt, {_TOK.format("pc")} as pct, {_TOK.format("g")} as gt from t),
v as (select sample_id, case when gyn != '' then 'yesno' when g != '' and p = g then 'open_exact' when gc != '' and pc = gc then 'open_exact_clean'
 when g = '' or p = '' then 'open_empty' when contains(p, g) or contains(g, p) then 'open_contain_norm'
 when pc != '' and gc != '' and (contains(pc, gc) or contains(gc, pc)) then 'open_contain_clean'
 when len(list_intersect(pt, gt)) > 0 and len(list_intersect(pt, gt)) >= 0.6 * len(pt) or len(list_intersect(pct, gt)) > 0 and len(list_intersect(pct, gt)) >= 0.6 * len(pct) then 'open_token_subset' else 'undecided' end as reason, gyn, pyn from u)
select sample_id, reason, case when reason = 'yesno' then (gyn = pyn)::double when reason in ('open_empty', 'undecided') then 0.0 else 1.0 end as score from v"""
)
def e1_rules(spark, d):
    """E1, E2 up to the fuzzy rule, with reasons."""
    v = E.pathology(F.col("pred"), F.col("gold"))
    return scores(spark, d, "gold", "pred").select("sample_id", v["reason"].alias("reason"), v["score"].alias("score"))


@query()
def e1_scored(spark, d):
    """E1 with its fuzzy tail."""
    return E.score(scores(spark, d, "gold", "pred"), "pathology", "pred", "gold").select("sample_id", "score", "reason")


_FT = list(X.FINDING_TERMS.items())


def _fold(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


_FN = r"trim(regexp_replace(regexp_replace(" + _fold("replace(replace(replace(trim(lower(coalesce({0}, ''))), '_', ' '), '-', ' '), '/', ' ')", _FT) + r", '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_FL = r"trim(regexp_replace(" + _fold("{0}", [(w, " ") for w in X.FLUFF]) + r", '\s+', ' ', 'g'))"
_FINAL = r"(case when ends_with(trim(coalesce({0}, '')), '.') then left(trim({0}), -1) else trim(coalesce({0}, '')) end)"
_NEG = "(trim(lower({0})) in (" + ", ".join(f"'{w}'" for w in X.NEGATIVE_WORDS) + ") or regexp_replace(lower({0}), '[^a-z]', '', 'g') in (" + ", ".join(f"'{w}'" for w in X.NEGATIVE_LETTERS) + ")" + "".join(f" or contains(lower({{0}}), '{p}')" for p in X.NEGATIVE_PHRASES) + ")"


@query(
    f"""with s as (select sample_id, gold, {_FINAL.format("pred")} as fin from {S}),
t as (select *, {_FL.format(_FN.format("fin"))} as p, case when gold is null then ['none'] else list_filter([{_FN.format("gold")}], lambda x: x != '') end as g from s),
u as (select *, list_distinct(list_filter(list_transform(string_split_regex(p, '\\s*(?:,|;|\\band\\b|\\bor\\b|\\.|\\n)\\s*'), lambda x: trim(x)), lambda x: x != '')) as terms, case when regexp_matches(p, '\\byes\\b') then 'yes' when regexp_matches(p, '\\bno\\b') then 'no' else '' end as pyn from t),
w as (select *, len(g) > 0 and (contains(p, g[1]) or len(list_filter(terms, lambda t: contains(t, g[1]) or len(list_intersect(list_distinct(string_split(g[1], ' ')), string_split(t, ' '))) = len(list_distinct(string_split(g[1], ' '))) or len(list_filter(list_intersect(list_distinct(string_split(g[1], ' ')), string_split(t, ' ')), lambda y: length(y) > 2 and y not in ('and', 'with', 'the'))) >= 2 or len(list_filter(list_intersect(list_distinct(string_split(g[1], ' ')), string_split(t, ' ')), lambda y: length(y) > 2 and y not in ('and', 'with', 'the'))) >= 0.5 * len(list_distinct(string_split(g[1], ' '))))) > 0) as hit from u),
r as (select sample_id, pyn, g, case when len(g) = 0 then 'no_gold' when g = ['none'] and ({_NEG.format("p")} or {_NEG.format("fin")} or p = '') then 'none_ok' when g = ['none'] then 'none_wrong' when g[1] in ('yes', 'no') then 'yesno' when {_NEG.format("p")} then 'negative_vs_positive' when hit then 'matched' else 'mismatch' end as reason from w)
select sample_id, reason, case when reason in ('none_ok', 'matched') then 1.0 when reason = 'yesno' then (pyn = g[1])::double else 0.0 end as score from r"""
)
def e3_findings(spark, d):
    """E3 with the gold as a list of one; a null gold is the empty list."""
    g = F.when(F.col("gold").isNotNull(), F.array("gold"))
    v = E.findings(F.col("pred"), g)
    return scores(spark, d, "gold", "pred").select("sample_id", v["reason"].alias("reason"), v["score"].alias("score"))


_SYN = sorted(E.SHORT_SYNONYMS, key=len, reverse=True)
_SYN_MAP = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in E.SHORT_SYNONYMS.items()) + "}"
_STOPPED = "array_to_string(list_filter(string_split({0}, ' '), lambda t: t != '' and t not in ('" + "', '".join(E.SHORT_STOPWORDS) + "')), ' ')"
_REPLACED = "trim(regexp_replace(" + _fold("{0}", [(k, E.SHORT_SYNONYMS[k]) for k in _SYN]) + ", '\\s+', ' ', 'g'))"


@query(
    f"""with s as (select sample_id, {_STOPPED.format("__P__")} as p0, {_STOPPED.format("__G__")} as g0 from {S}), k as (select {_SYN_MAP} as m),
r as (select *, {_REPLACED.format("p0")} as p1, {_REPLACED.format("g0")} as g1 from s, k),
c as (select sample_id, coalesce(m[p0], m[p1], p1) as p, coalesce(m[g0], m[g1], g1) as g from r),
v as (select *, string_split(p, ' ') as pt, string_split(g, ' ') as gt from c)
select sample_id, case when p = g and p != '' then 'exact' when p = '' or g = '' then 'empty' when contains(p, g) or contains(g, p) then 'substring' when len(list_filter(gt, lambda t: not list_contains(pt, t))) = 0 then 'token_subset_gold_in_pred' when len(list_filter(pt, lambda t: not list_contains(gt, t))) = 0 then 'token_subset_pred_in_gold' else 'undecided' end as reason from v""".replace("__P__", _BN.format("pred")).replace("__G__", _BN.format("gold"))
)
def e4_rules(spark, d):
    """E4 up to the fuzzy rules."""
    return scores(spark, d, "gold", "pred").select("sample_id", E.short_answer(F.col("pred"), F.col("gold"))["reason"].alias("reason"))


@query()
def e4_scored(spark, d):
    return E.score(scores(spark, d, "gold", "pred"), "short_answer", "pred", "gold").select("sample_id", "score", "reason")


_CON = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in ({a: c for c, alts in E.CONCEPTS.items() for a in alts} | E.CONCEPT_NUMBERS).items()) + "}"
_RYN = r"case when regexp_matches({0}, '^yes( |$)') then 'yes' when regexp_matches({0}, '^no( |$)') then 'no' when regexp_matches({0}, '\byes\b') then 'yes' when regexp_matches({0}, '\bno\b') then 'no' when regexp_matches({0}, '\btrue\b') then 'yes' when regexp_matches({0}, '\bfalse\b') then 'no' when regexp_matches({0}, '\b(?:absent|not present|not seen|no evidence)\b') then 'no' when regexp_matches({0}, '\b(?:present|seen|evident)\b') then 'yes' end"
_RW = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t != '' and t not in ('" + "', '".join(E.RADIOLOGY_STOP) + "')))"


@query(
    f"""with s as (select sample_id, {_RN.format('pred')} as p, {_RN.format('gold')} as g, {_CON} as m from {S}),
v as (select *, coalesce(m[p], p) as pc, coalesce(m[g], g) as gc, {_RW.format("p")} as pt, {_RW.format("g")} as gt, {_RYN.format("p")} as py, {_RYN.format("g")} as gy from s)
select sample_id, case when py = gy then 'yesno_match' when pc = gc then 'exact_canon'
 when len(gt) > 1 and len(list_filter(gt, lambda t: not list_contains(pt, t))) = 0 or len(gt) = 1 and (contains(p, gt[1]) or len(list_filter(pt, lambda t: coalesce(m[t], t) = coalesce(m[gt[1]], gt[1]))) > 0) then 'containment'
 when contains(gc, 'left') and contains(pc, 'left') or contains(gc, 'right') and contains(pc, 'right') then 'lateralization_match' else 'undecided' end as reason from v"""
)
def e5_rules(spark, d):
    """E5 up to the fuzzy rule."""
    return scores(spark, d, "gold", "pred").select("sample_id", E.radiology(F.col("pred"), F.col("gold"))["reason"].alias("reason"))


@query()
def e5_scored(spark, d):
    return E.score(scores(spark, d, "gold", "pred"), "radiology", "pred", "gold").select("sample_id", "score", "reason")


def _options(gold: str, question: str):
    """A four-option map for a row: the gold under the letter its question's length picks."""
    n = F.pmod(F.length(question), F.lit(4))
    return F.map_from_arrays(F.array(*map(F.lit, "ABCD")), F.array(*(F.when(n == k, F.col(gold)).otherwise(F.lit(f"other {k}")) for k in range(4))))


@query(
    f"""with s as (select sample_id, upper(trim(coalesce(pred, ''))) as u, {_BN.format("pred")} as p, {_BN.format("gold")} as g, {_BN.format("question")} as q from {S}),
v as (select sample_id, regexp_extract(u, '\\b([A-E])\\b', 1) as letter, case when p = q then 'C' when p = g then 'A' else '' end as by_text from s)
select sample_id, case when letter != '' then 'letter' when by_text != '' then 'option_text' else 'unparsed' end as reason, (case when letter != '' then letter else by_text end = 'A')::double as score from v"""
)
def e7_letter(spark, d):
    """The gold is option A, the question option C."""
    v = E.letter_choice(F.col("pred"), F.lit("a"), F.create_map(F.lit("A"), F.col("gold"), F.lit("b"), F.lit("no such option"), F.lit("C"), F.col("question")))
    return scores(spark, d, "gold", "pred", "question").select("sample_id", v["reason"].alias("reason"), v["score"].alias("score"))


@query()
def e6_scored(spark, d):
    x = scores(spark, d, "gold", "pred", "question").withColumn("options", _options("gold", "question"))
    return E.score(x, "multiple_choice", "pred", "gold", "options").select("sample_id", "score", "reason")


@query(
    f"""with s as (select sample_id, lower(trim(replace(coalesce(pred, 'None'), '"', ''))) as p, lower(trim(replace(coalesce(gold, ''), '"', ''))) as g from {S})
select sample_id, case when p = g then 'equal' when (contains(p, '%') or contains(p, '.')) and split_part(replace(p, '%', ''), '.', 1) = g then 'truncated' else 'mismatch' end as reason from s"""
)
def e8_chart(spark, d):
    return scores(spark, d, "gold", "pred").select("sample_id", E.chart_value(F.col("pred"), F.col("gold"))["reason"].alias("reason"))


_PATS = [p.replace("\\*", "[*]") for p in E.LETTER_PATTERNS]


@query(
    "with c as (select distinct case_id, coalesce(model_answer, '') as a, coalesce(ground_truth, '') as g from demo_case), m as (select case_id, a, g, "
    + " || ".join(f"regexp_extract_all(a, '(?im){p}', 1)" for p in E.LETTER_PATTERNS)
    + " as l from c) select case_id, upper(l[-1]) as letter, contains(lower(trim(a)), '(' || lower(trim(g)) || ')')::double as contained from m"
)
def e9_letters(spark, d):
    x = table(spark, d, "demo_case").select("case_id", "model_answer", "ground_truth").distinct()
    return x.select("case_id", E.last_letter(F.col("model_answer")).alias("letter"), E.exam_contains(F.col("model_answer"), F.col("ground_truth")).alias("contained"))


@query(
    "with c as (select distinct case_id, lower(coalesce(model_answer, '')) as t, coalesce(ground_truth, '') as g from demo_case), r as (select *, reverse(right(t, 100)) as tail from c), "
    "p as (select *, case when instr(tail, 'sey') > 0 then instr(tail, 'sey') + 3 else 999 end as y, case when instr(tail, 'on') > 0 then instr(tail, 'on') + 2 else 999 end as n, case when instr(tail, 'ebyam') > 0 then instr(tail, 'ebyam') + 5 else 999 end as m from r) select case_id, coalesce("
    + ", ".join(f"regexp_extract_all(t, '{p}', 1)[-1]" for p in E.VERDICT_PATTERNS)
    + ", case when least(y, n, m) = 999 then 'unknown' when m = least(y, n, m) then 'maybe' when n = least(y, n, m) then 'no' else 'yes' end) as label, contains(trim(t), lower(trim(g)))::double as contained from p"
)
def e10_labels(spark, d):
    x = table(spark, d, "demo_case").select("case_id", "model_answer", "ground_truth").distinct()
    return x.select("case_id", E.rightmost_label(F.col("model_answer")).alias("label"), E.contains_label(F.col("model_answer"), F.col("ground_truth")).alias("contained"))




@query(f"select sample_id, (gold is not null and contains({_BN.format('pred')}, {_BN.format('gold')}))::double as score from {S}")
def e11_containment(spark, d):
    return scores(spark, d, "gold", "pred").select("sample_id", E.contains_any(F.col("pred"), F.when(F.col("gold").isNotNull(), F.array("gold"))).alias("score"))


# The answer of a response, and the pathology rules on it, written from the definition rather than from the code above.
_AFTER = r"trim(split_part(regexp_replace(regexp_extract({0}, '{1}', 1, 's'), '^\s+|\s+$', '', 'g'), chr(10), 1))"
_ANSWER = f"""case when {_AFTER.format("t", "</think>\\s*(.+)")} != '' then {_AFTER.format("t", "</think>\\s*(.+)")} when regexp_matches(t, '\\banswer:\\s*.+', 'is') then trim(split_part(regexp_replace(regexp_extract(t, '\\banswer:\\s*(.+)', 1, 'is'), '^\\s+|\\s+$', '', 'g'), chr(10), 1)) else t end"""


def _tasks(spark, d):
    """Scores with their dataset; every third response has its answer after a thought, every third after a label."""
    p = F.coalesce("pred", F.lit(""))
    said = F.when(F.col("sample_id") % 3 == 0, F.concat(F.lit("<think>no, maybe\nnot</think>\n"), p, F.lit("\nas seen"))).when(F.col("sample_id") % 3 == 1, F.concat(F.lit("Thought: unclear\nAnswer: "), p)).otherwise(p)
    return scores(spark, d, "task_name", "gold", "pred").select("sample_id", "task_name", F.replace(F.col("task_name"), F.lit("_"), F.lit("-")).alias("dataset"), "gold", said.alias("response"))


_TASKS = f"""r as (select sample_id, task_name, replace(task_name, '_', '-') as name, coalesce(gold, '') as gold, case sample_id % 3 when 0 then '<think>no, maybe' || chr(10) || 'not</think>' || chr(10) || coalesce(pred, '') || chr(10) || 'as seen' when 1 then 'Thought: unclear' || chr(10) || 'Answer: ' || coalesce(pred, '') else coalesce(pred, '') end as t from {S}),
a as (select *, {_ANSWER} as pred from r),
s as (select *, {NORM.format("pred")} as p, {NORM.format("gold")} as g from a),
n as (select *, {_YN.format("g")} as gyn, {_YN.format("p")} as pyn, {_STRIP.format("p")} as pc, {_STRIP.format("g")} as gc from s),
u as (select *, {_TOK.format("p")} as pt, {_TOK.format("pc")} as pct, {_TOK.format("g")} as gt from n)"""


@query(
    f"""with {_TASKS}
select sample_id, case when gold = '' then 'no_label' when name = 'medqa' then 'letter' when name = 'pubmedqa' then 'label' when name = 'mimic-cxr-vqa' then 'findings' when name != 'pathvqa' then 'no_scorer'
 when gyn != '' then 'yesno' when p = g and g != '' or pc = gc and gc != '' then 'exact' when p != '' and g != '' and (contains(p, g) or contains(g, p)) or pc != '' and gc != '' and (contains(pc, gc) or contains(gc, pc)) then 'contains'
 when len(list_intersect(pt, gt)) > 0 and len(list_intersect(pt, gt)) >= 0.6 * len(pt) or len(list_intersect(pct, gt)) > 0 and len(list_intersect(pct, gt)) >= 0.6 * len(pct) then 'tokens' when p = '' or g = '' then 'empty' else 'undecided' end as reason,
 (case when name = 'medqa' and gold != '' then contains(lower(trim(pred)), '(' || lower(trim(gold)) || ')')::int when name = 'pubmedqa' and gold != '' then contains(lower(trim(pred)), lower(trim(gold)))::int when name = 'pathvqa' and gyn != '' and gold != '' then (pyn = gyn)::int end)::double as correct from u"""
)
def e12_dispatch(spark, d):
    """The scorer and rule of each answer, and whether it is correct where a label or yes and no decide."""
    x = _tasks(spark, d).withColumns({"a": X.answer_of(F.col("response")), "l": X.text_or_empty(F.col("gold"))})
    v = E.dispatch(F.col("dataset"), F.col("a"), F.col("l"))
    return x.select("sample_id", v["reason"].alias("reason"), F.when(v["reason"].isin("letter", "label", "yesno"), v["score"]).alias("correct"))


@query()
def e12_scored(spark, d):
    """E12 with its fuzzy tail: accuracy per task."""
    x = E.check_correct(_tasks(spark, d), "dataset", "response", "gold")
    return x.groupBy("task_name").agg(F.count("*").alias("answers"), M.accuracy(F.col("score")).alias("accuracy"))


@query(
    f"""select sample_id, case when len(list_intersect(string_split(replace(split_part(coalesce(pred, ''), '.', 1), ',', ''), ' '), ['No', 'not', 'no'])) > 0 then 'no' else 'yes' end as answer from {S}"""
)
def e14_presence(spark, d):
    return scores(spark, d, "pred").select("sample_id", E.object_presence(F.col("pred")).alias("answer"))


@query(
    f"""with s as (select task_name, gold = 'yes' as g, coalesce(pred = 'yes', false) as p from {S} where gold in ('yes', 'no')),
c as (select task_name, count(*) filter (p and g) as tp, count(*) filter (p and not g) as fp, count(*) filter (not p and not g) as tn, count(*) filter (not p and g) as fn from s group by task_name)
select task_name, tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1,
 round((tp + tn) / (tp + fp + tn + fn), 6) as accuracy, round((tp + fp) / (tp + fp + tn + fn), 6) as yes_ratio from c"""
)
def a8_confusion(spark, d):
    x = scores(spark, d, "task_name", "gold", "pred").where("gold in ('yes', 'no')")
    return x.groupBy("task_name").agg(*(c.alias(k) for k, c in M.confusion(F.col("pred"), F.col("gold")).items()))


@query(
    f"""select case when grouping(task_name) = 1 then 'all' else task_name end as task_name, count(*) as n, count(*) filter (score = 1) as correct, count(*) filter (gold in ('yes', 'no')) as yes_no,
 round(coalesce(avg(coalesce(score, 0)), 0), 6) as accuracy from {S} group by rollup (task_name)"""
)
def a5_totals(spark, d):
    return M.totals_and_groups(scores(spark, d, "task_name", "score", "gold"), "task_name", {"n": F.count("*"), "correct": F.count_if(F.col("score") == 1), "yes_no": F.count_if(F.col("gold").isin("yes", "no")), "accuracy": M.accuracy(F.coalesce("score", F.lit(0.0)))})


@query(f"select pred as value, count(*) as n from {S} where pred is not null group by pred order by n desc, pred limit 20")
def a2_most_common(spark, d):
    return M.most_common(scores(spark, d, "pred").where("pred is not null"), F.col("pred"), 20)


@query(
    "select tools as pattern, count(*) as n from (select distinct case_id, array_to_string(list_filter(list_transform(tools_called, lambda t: t.tool), lambda x: x is not null and trim(x) != ''), ' -> ') as tools from demo_case where tools_called is not null) group by tools"
)
def a3_tool_patterns(spark, d):
    x = table(spark, d, "demo_case").where("tools_called is not null").select("case_id", M.pattern(F.col("tools_called.tool")).alias("pattern")).distinct()
    return M.frequencies(x, F.col("pattern"))


@query(
    f"""with v as (select idx, pred, count(*) as n, min(sample_id) as first_at from {S} where pred is not null group by idx, pred)
select idx, arg_max(pred, n::double * 1e12 - first_at) as majority, max(n) as votes from v group by idx"""
)
def a15_majority(spark, d):
    return M.majority(scores(spark, d, "idx", "pred"), "idx", "pred", "sample_id")


@query(
    f"""select sample_id, round(greatest(0, case when v >= 0.5 then v else 0 end), 6) as anls from (select sample_id, coalesce(1 - levenshtein(lower(trim(pred)), lower(trim(gold))) / nullif(greatest(length(lower(trim(pred))), length(lower(trim(gold)))), 0), 0) as v from {S} where gold is not null and pred is not null)"""
)
def a11_anls(spark, d):
    return scores(spark, d, "gold", "pred").where("gold is not null and pred is not null").select("sample_id", F.round(M.anls(F.col("pred"), F.array("gold")), 6).alias("anls"))


@query(f"select sample_id, model, round(avg(score) over (partition by model order by scored_at, sample_id rows unbounded preceding), 6) as running from {S}")
def a14_running(spark, d):
    return M.running_accuracy(scores(spark, d, "model", "score", "scored_at"), ["scored_at", "sample_id"], "score", ["model"]).select("sample_id", "model", "running")


@query()
def a12_bleu(spark, d):
    return M.bleu4(scores(spark, d, "task_name", "gold", "pred"), "pred", "gold", ["task_name"])


@query(
    f"""with c as (select distinct case_id, question, is_correct from demo_case), r as (select idx, min_by(coalesce(pred, ''), scored_at::varchar || lpad(sample_id::varchar, 12, '0')) as pred from {S} where model = 'frontier_x' group by idx)
select case_id, coalesce(pred, '') as pred from c left join r on idx = case_id::varchar"""
)
def j10_missing_predictions(spark, d):
    from ..operators.joins import with_predictions

    res = scores(spark, d, "model", "idx", "pred", "scored_at").where("model = 'frontier_x'").groupBy("idx").agg(F.min_by(F.coalesce("pred", F.lit("")), F.struct("scored_at", "sample_id")).alias("pred"))
    meta = table(spark, d, "demo_case").select("case_id", F.col("case_id").cast("string").alias("idx")).distinct()
    return with_predictions(meta, res, "idx").select("case_id", "pred")


@query(
    f"""select sample_id, {NORM.format("question")} as norm, {_STRIP.format(NORM.format("question"))} as stripped, {_BN.format("question")} as basic, {_FN.format("question")} as finding from {S}"""
)
def x_normalisers(spark, d):
    q = F.col("question")
    return scores(spark, d, "question").select("sample_id", X.norm_text(q).alias("norm"), X.strip_explanations(q).alias("stripped"), X.basic_norm(q).alias("basic"), X.finding_norm(q).alias("finding"))


@query(f"select task_name, model, round(avg(score), 6) as mean_score, count(*) as n from {S} group by task_name, model")
def a1_score_means(spark, d):
    return scores(spark, d, "task_name", "model", "score").groupBy("task_name", "model").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))


@query(f"select idx, task_name, min_by(sample_id, coalesce(score, -1) * -1e12 + sample_id) as sample_id from {S} where idx is not null group by idx, task_name")
def w4_first_per_item(spark, d):
    """Per item and task the best-scored row, the lowest id on ties; null scores last."""
    x = scores(spark, d, "task_name", "idx", "score").where("idx is not null").select("idx", "task_name", "sample_id", "score")
    return W.first_per(x, ["idx", "task_name"], [-F.coalesce("score", F.lit(-1.0)), F.col("sample_id")]).select("idx", "task_name", "sample_id")
