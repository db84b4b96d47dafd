"""Queries of filters, text functions and trajectory operators (F*, T*, X*, R*) on cases and chat examples, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lenient as J
from ..functions import text as X
from ..operators import filters as P
from ..operators import joins
from ..operators import metrics as M
from ..operators import trajectory as T
from ..session import table
from ..streaming import runtime as R
from .relational import C, cases
from .scoring import S, scores

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def examples(spark, d, *columns):
    """data_example once per row with the columns asked for."""
    return table(spark, d, "data_example").select("example_id", *columns).distinct()


E = "(select distinct example_id, source_dataset, messages, images from data_example)"


@query(
    f"""select case_id, case when coalesce(trim(ground_truth), '') = '' then 'no_truth' when coalesce(not is_correct, false) then 'wrong' when is_correct is null then 'unknown' when length(coalesce(question, '')) > 600 then 'too_long'
 when coalesce(image_file, '') = '' and coalesce(len(tools_called), 0) <= 1 and trim(coalesce(model_answer, ''), ' ') != '' then 'easy' when coalesce(image_file, '') = '' then 'no_image' end as drop_reason from (select distinct case_id, ground_truth, is_correct, question, image_file, model_answer, tools_called from demo_case)"""
)
def f7_cascade(spark, d):
    """first failing rule per case, null for kept ones."""
    rules = [
        ("no_truth", F.trim(X.text_or_empty(F.col("ground_truth"))) == ""),
        ("wrong", P.wrong(F.col("is_correct"))),
        ("unknown", F.col("is_correct").isNull()),
        ("too_long", F.length(X.text_or_empty(F.col("question"))) > 600),
        ("easy", P.easy(F.when(X.text_or_empty(F.col("image_file")) == "", "ok"), F.col("is_correct"), F.lit(0), F.greatest(F.size("tools_called"), F.lit(0)), F.col("model_answer"))),
        ("no_image", X.text_or_empty(F.col("image_file")) == ""),
    ]
    return cases(spark, d, "question", "ground_truth", "is_correct", "image_file", "tools_called", "model_answer").select("case_id", P.reject(rules).alias("drop_reason"))


_SYM = " or ".join(f"(contains(lower(coalesce(model_answer, '')), '{s}') and not contains(lower(coalesce(question, '')), '{s}'))" for s in P.SYMPTOMS)


@query(f"select case_id, ({_SYM}) as unasked from {C}")
def f8_unasked_symptoms(spark, d):
    return cases(spark, d, "question", "model_answer").select("case_id", P.unasked_symptom(F.col("model_answer"), F.col("question")).alias("unasked"))


@query(f"""select case_id, (coalesce(list_contains(['none'], lower(ground_truth)), false) and (contains(lower(coalesce(question, '')), 'point out') or contains(lower(coalesce(question, '')), 'locate') or contains(lower(coalesce(question, '')), 'where is') or contains(lower(coalesce(question, '')), 'show me'))) or ground_truth is null as toxic from {C}""")
def f1_toxic(spark, d):
    """F1 with the ground truth as a list; null is the empty list."""
    gold = F.when(F.col("ground_truth").isNotNull(), F.array("ground_truth")).otherwise(F.array().cast("array<string>"))
    return cases(spark, d, "question", "ground_truth").select("case_id", P.toxic(F.col("question"), gold, gold).alias("toxic"))


_LEN = "list_transform(messages, lambda m: length(m.content) % 3)"


@query(
    f"""with e as (select example_id, messages, {_LEN} as sig, list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: length(m.content) % 3) as calls from {E})
select example_id, len(list_filter(range(1, len(calls)), lambda i: calls[i] = calls[i + 1])) > 0 as repeats_previous, len(list_filter(range(1, len(sig)), lambda i: sig[i] = sig[i + 1])) > 0 as repeats_adjacent, list_sum(list_transform(messages, lambda m: coalesce(length(m.content), 0)))::bigint as chars from e"""
)
def f9_repeats(spark, d):
    """F9, F10, F12 with length modulo 3 as signature."""
    sig = lambda ms: F.transform(ms, lambda m: (F.length(m["content"]) % 3).cast("string"))
    calls = sig(F.filter("messages", lambda m: m["role"] == "assistant"))
    return examples(spark, d, "messages").select("example_id", P.repeats_previous_call(calls).alias("repeats_previous"), P.repeats_adjacent(sig(F.col("messages"))).alias("repeats_adjacent"), P.total_length(F.col("messages.content")).cast("bigint").alias("chars"))


@query(
    """with g as (select distinct case_id, example_reasoning['Moderator'] as t from demo_case), r as (select case_id, rtrim(coalesce(t, '')) as t from g)
select case_id, length(trim(t)) < 5 or len(regexp_extract_all(t, '\\*\\*')) % 2 != 0 or (not regexp_matches(t, '\\bAnswer:\\s*\\S') and length(t) > 50 and not contains('.!?。！？)）]】"''*`', right(t, 1))) as truncated from r"""
)
def f19_truncation(spark, d):
    """F19 on the moderator's text (the survey's rule; the training-data operator for cut text is another)."""
    x = table(spark, d, "demo_case").select("case_id", F.element_at("example_reasoning", "Moderator").alias("t")).distinct()
    return x.select("case_id", P.truncated(F.col("t")).alias("truncated"))


@query(
    f"""with m as (select example_id, i, (length(messages[i].content) % 3)::varchar as t from (select *, unnest(range(1, len(messages) + 1)) as i from {E}) where messages[i].role = 'assistant'),
n as (select *, row_number() over (partition by example_id order by i) - row_number() over (partition by example_id, t order by i) as island from m), k as (select example_id, t, island, count(*) as k from n where t is not null group by all),
r as (select example_id, max(k) as run from k group by example_id), s as (select example_id, coalesce(list_aggregate(list_transform(messages, lambda m: coalesce(m.content, '')), 'string_agg', '. '), '') as text, messages from {E}),
u as (select *, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: length(x) > 20) as ss from s)
select example_id, case when messages is not null then coalesce(run, 0)::int end as run, messages is not null and length(text) > 500 and len(ss) > 4 and len(list_distinct(ss)) / len(ss) < 0.9 as circles from u left join r using (example_id)"""
)
def f11_runs(spark, d):
    """longest run of equal reply lengths (mod 3) and loops of thought per example."""
    tests = F.transform("messages", lambda m: (F.length(m["content"]) % 3).cast("string"))
    is_call = F.transform("messages", lambda m: m["role"] == "assistant")
    text = F.array_join(F.transform("messages", lambda m: X.text_or_empty(m["content"])), ". ")
    return examples(spark, d, "messages").select("example_id", P.longest_run(tests, is_call).alias("run"), P.thinks_in_circles(text, 500, 4, 0.9).alias("circles"))


@query(
    f"""with t as (select example_id, list_filter(messages, lambda m: m.role != 'system') as ms from {E}), u as (select example_id, unnest(range(0, len(ms) // 2)) as i, ms from t)
select example_id, i::int as pair, coalesce(ms[2 * i + 1].content, '') as question, coalesce(ms[2 * i + 2].content, '') as answer from u"""
)
def t22_pairs(spark, d):
    """Messages to turns, turns to question/answer rows."""
    x = examples(spark, d, "messages").select("example_id", T.from_messages(F.col("messages")).alias("turns"))
    return T.unroll_pairs(x, ["example_id"], F.col("turns"))


@query(
    f"""with t as (select example_id, list_transform(list_filter(messages, lambda m: m.role != 'system'), lambda m: coalesce(m.content, '')) as vs from {E})
select example_id, list_transform(vs, lambda v: case when contains(v, '<image>') then '<image>' || chr(10) || trim(replace(v, '<image>', ''), ' ') else v end) as texts from t"""
)
def t23_image_first(spark, d):
    x = examples(spark, d, "messages").select("example_id", T.image_token_first(T.from_messages(F.col("messages"))).alias("turns"))
    return x.select("example_id", F.col("turns.value").alias("texts"))


@query(
    f"""with e as (select coalesce(len(images), 0) as n, len(list_filter(messages, lambda m: m.role = 'user')) as humans, len(list_filter(messages, lambda m: m.role = 'tool' and regexp_matches(lower(coalesce(m.content, '')), 'image|crop|zoom|img_round'))) as seen from {E}),
r as (select case when n = 0 then 'rejected_no_images' when humans = 0 then 'rejected_no_human' when seen < n - 1 then 'rejected_not_enough_image_observations' end as reason from e) select reason, count(*) as n from r group by reason"""
)
def t3_image_tags(spark, d):
    """Reject reasons over all examples."""
    x = examples(spark, d, "messages", "images").select(T.align_image_tags(T.from_messages(F.col("messages")), F.col("images"))["reason"].alias("reason"))
    return M.frequencies(x, F.col("reason"))


@query()
def t14_rendered(spark, d):
    """Tool calls of a case as a log, as a chat row, and rendered as steps."""
    ev = lambda t: F.array(
        F.struct(F.lit("tool_call").alias("event"), t["tool"].alias("tool_name"), F.create_map(F.lit("thought"), X.text_or_empty(t["purpose"]), F.lit("step"), t["step"].cast("string")).alias("args"), F.lit(None).cast("string").alias("content_text"), F.lit(None).cast("string").alias("content_preview")),
        F.struct(F.lit("tool_result").alias("event"), t["tool"].alias("tool_name"), F.create_map().cast("map<string,string>").alias("args"), F.concat(F.lit("result of "), X.text_or_empty(t["tool"])).alias("content_text"), F.lit(None).cast("string").alias("content_preview")),
    )
    x = table(spark, d, "demo_case").where("size(tools_called) > 0").select("case_id", "question", "model_answer", "tools_called").distinct()
    x = x.withColumn("trace", F.flatten(F.transform(F.filter("tools_called", lambda t: t.isNotNull()), ev)))
    x = x.select("case_id", T.log_to_chat(F.col("question"), F.col("trace"), F.col("model_answer")).alias("turns"))
    return x.select("case_id", F.size("turns").alias("n_turns"), T.render(F.col("turns")).alias("rendered"))


def _assessors():
    """Agents with an assessment in one of five shapes, or none, by the case's number."""
    q, n = X.text_or_empty(F.col("question")), F.col("case_id") % 6
    t = F.when(n == 0, F.concat(F.lit("**Difficulty: 2) Intermediate**\n\n**Reasoning:** "), q)).when(n == 1, F.concat(F.lit("1) basic\n\n: "), q)).when(n == 2, "Difficulty assessment: it is hard. 3) advanced").when(n == 3, F.concat(F.lit(" "), q, F.lit(" "))).when(n == 4, "2) intermediate")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.when(t.isNotNull(), F.array(F.struct(F.lit("Difficulty Assessor").alias("agent_role"), F.lit("Assess").alias("instruction"), F.array(message("user", q), message("assistant", t)).alias("messages"))))


@query(
    f"""with c as (select *, case case_id % 6 when 0 then '**Difficulty: 2) Intermediate**' || chr(10) || chr(10) || '**Reasoning:** ' || coalesce(question, '') when 1 then '1) basic' || chr(10) || chr(10) || ': ' || coalesce(question, '') when 2 then 'Difficulty assessment: it is hard. 3) advanced' when 3 then ' ' || coalesce(question, '') || ' ' when 4 then '2) intermediate' end as t from {C}),
a as (select *, regexp_replace(regexp_replace(t, '\\*{{2,}}', '', 'g'), '^\\s+|\\s+$', '', 'g') as clean from c),
l as (select *, regexp_extract(clean, '(\\d\\)\\s*(?:basic|intermediate|advanced))', 1, 'i') as lvl, regexp_replace(regexp_extract(clean, 'Reasoning:?\\s*(.+)', 1, 'is'), '^\\s+|\\s+$', '', 'g') as why,
 regexp_replace(regexp_replace(clean, '^.*?\\d\\)\\s*(?:basic|intermediate|advanced)', '', 'is'), '^[\\s:#\\-]+|\\s+$', '', 'g') as aft, trim(regexp_replace(trim(regexp_extract(clean, '^(.*?)\\d\\)\\s*(?:basic|intermediate|advanced)', 1, 'is')), '^.*(?:Difficulty|Assessment)\\s*:?\\s*', '', 'i')) as bef from a),
d as (select *, case when t is null then case difficulty when 'basic' then '{T.DIFFICULTY_ANSWERS['basic']}' when 'intermediate' then '{T.DIFFICULTY_ANSWERS['intermediate']}' end when lvl = '' then '<think>' || clean || '</think>'
 else '<think>' || coalesce(nullif(why, ''), nullif(aft, ''), nullif(bef, ''), '{T.DIFFICULTY_UNSAID}') || '</think>' || chr(10) || lvl end as made from l)
select case_id, 'direct' as sft_type, coalesce(question, '') as asked, trim(model_answer, ' ') as answer from {C} where trim(coalesce(model_answer, ''), ' ') != '' and not contains(model_answer, '<tool_call>')
union all select case_id, 'difficulty', case when image_file is not null then '<image>' || chr(10) else '' end || replace('{T.DIFFICULTY_PROMPT}', '{{question}}', coalesce(question, '')), made from d where made is not null and trim(coalesce(t, 'x')) != ''
union all select case_id, 'truth', coalesce(question, ''), trim(ground_truth, ' ') from {C} where trim(coalesce(ground_truth, ''), ' ') != ''"""
)
def t11_fan_out(spark, d):
    """One case to rows of up to three types in one pass."""
    agents = _assessors()
    kinds = {"direct": T.direct_answer(F.col("question"), F.col("model_answer")), "difficulty": T.difficulty_row(F.col("question"), agents, F.col("difficulty"), F.col("image_file").isNotNull()), "truth": T.direct_answer(F.col("question"), F.col("ground_truth"))}
    x = T.fan_out(cases(spark, d, "difficulty", "question", "ground_truth", "model_answer", "image_file"), kinds, ["case_id"])
    return x.select("case_id", "sft_type", F.element_at("turns", 1)["value"].alias("asked"), F.element_at("turns", -1)["value"].alias("answer"))


@query(
    "select o_orderkey, slot, question from (select o_orderkey, unnest([{'slot': 'status', 'question': o_orderstatus}, {'slot': 'priority', 'question': o_orderpriority}, {'slot': 'price', 'question': case when o_totalprice > 200000 then 'high' else 'N/A' end}], recursive := true) from orders) where question is not null and question != 'N/A'"
)
def t16_long_questions(spark, d):
    x = table(spark, d, "orders").withColumn("price", F.when(F.col("o_totalprice") > 200000, "high").otherwise("N/A"))
    return T.long_questions(x, ["o_orderkey"], {"o_orderstatus": "status", "o_orderpriority": "priority", "price": "price"})


@query(
    """with recursive e as (select r_name as parent, n_name as child from nation join region on r_regionkey = n_regionkey union all select 'world', r_name from region), w as (select child as node, 'world > ' || child as path, 1 as level from e where parent = 'world' union all select e.child, w.path || ' > ' || e.child, w.level + 1 from w join e on e.parent = w.node)
select node, path, level from w where contains(lower(node), 'a') and level > 1 or node = 'ASIA'"""
)
def t19_tree_paths(spark, d):
    """Paths below a root."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    e = n.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")).union(table(spark, d, "region").select(F.lit("world"), "r_name"))
    e = e.withColumn("seen", F.lower("child").contains("a") & (F.col("parent") != "world") | (F.col("child") == "ASIA"))
    return T.tree_paths(e, "world", "seen")


@query(
    f"""with w as (select case_id, [ground_truth] || list_filter(['renal colic', 'stable angina', 'lipoma'], lambda x: x != ground_truth) as t from {C} where ground_truth is not null),
h as (select case_id, list_sort(list_transform(t[1:4], lambda x: md5('0|' || case_id::varchar || '|' || x) || x)) as p, t[1] as g from w)
select case_id, chr((64 + list_position(list_transform(p, lambda x: x[33:]), g))::int) as letter, list_aggregate(list_transform(p, lambda x: x[33:]), 'string_agg', '|') as options from h"""
)
def t21_distractors(spark, d):
    x = cases(spark, d, "ground_truth").where("ground_truth is not null")
    s = T.with_distractors(F.col("ground_truth"), F.array(F.lit("renal colic"), F.lit("stable angina"), F.lit("lipoma")), F.col("case_id"))
    return x.select("case_id", s["letter"].alias("letter"), F.array_join(F.map_values(s["options"]), "|").alias("options"))


@query(
    f"""with p as (select sample_id, question from {S}) select sample_id, case when length(question) <= 60 then question else (case when contains(left(question, 60), '.') and length(left(question, 60)) - instr(reverse(left(question, 60)), '.') + 1 > 30 then left(left(question, 60), length(left(question, 60)) - instr(reverse(left(question, 60)), '.') + 1) else left(question, 60) end) || ' ...' end as short from p"""
)
def x33_truncate(spark, d):
    return scores(spark, d, "question").select("sample_id", X.truncate_sentence(F.col("question"), 60).alias("short"))


_AFTER = "case when contains(a, 'Final Answer:') then trim(substr(a, instr(a, 'Final Answer:') + 13), ' ') else a end"


@query(
    f"""with c as (select case_id, trim(coalesce(model_answer, ''), ' ') as a from {C}), t as (select case_id, {_AFTER} as t from c)
select case_id, coalesce({", ".join(f"nullif(trim(regexp_extract(t, '(?ims){p}', 1), ' '), '')" for p in X.ANSWER_MARKERS)}, case when ends_with(t, '.') then left(t, -1) else t end) as answer from t"""
)
def x11_final_answers(spark, d):
    return cases(spark, d, "model_answer").select("case_id", X.final_answer(F.col("model_answer")).alias("answer"))


@query(f"select sample_id, split_part(image_path, '/', 2) as folder, md5(coalesce(image_path, '')) as h, list_filter(list_transform(string_split_regex(regexp_replace(trim(coalesce(question, '')), '^\\[|\\]$', '', 'g'), '[,;\\n]'), lambda x: trim(x)), lambda x: x != '') as items from {S}")
def x28_lists(spark, d):
    """List items of the question, folder and md5 of the path."""
    x = scores(spark, d, "question", "image_path")
    return x.select("sample_id", F.split_part("image_path", F.lit("/"), F.lit(2)).alias("folder"), F.md5(X.text_or_empty(F.col("image_path"))).alias("h"), X.list_items(F.col("question")).alias("items"))


@query("select vec_id, least(999, floor(abs(embedding[1]) / 10 * 1000))::int as gx, round(greatest(0.0, abs(embedding[1])::double - 0.1 * (abs(embedding[3])::double + 1)), 4) as px from embeddings")
def x30_boxes(spark, d):
    """Grid coordinate and padded left edge of boxes [|a|, |b|, |a| + |c| + 1, |b| + |d| + 1]."""
    v = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    box = F.array(v(0), v(1), v(0) + v(2) + 1, v(1) + v(3) + 1)
    x = table(spark, d, "embeddings").select("vec_id", box.alias("b"), v(0).alias("a"))
    return x.select("vec_id", X.to_grid(F.col("a"), F.lit(10)).alias("gx"), F.round(X.pad_box(F.col("b"), F.lit(1000), F.lit(1000))[0], 4).alias("px"))


@query()
def x15_tool_calls(spark, d):
    """Calls in the action sections, their signatures and validity."""
    x = examples(spark, d, "messages").select("example_id", F.posexplode("messages").alias("no", "m")).where("m.content is not null").select("example_id", "no", F.regexp_extract("m.content", r'(?s)"action[^"]*"\s*(\[.*?\])\s*(?:\n"value|$)', 1).alias("a")).where("a != ''")
    calls = J.tool_calls_col(F.col("a"))
    return x.select("example_id", "no", F.size(calls).alias("calls"), J.signature_col(F.get(calls, F.lit(0))["name"], F.get(calls, F.lit(0))["arguments"]).alias("signature"), J.valid_call_col(F.col("a")).alias("valid"))


@query("select event_id, event_type, (props::json ->> '$.k')::int as k from events where json_valid(props)")
def x_props(spark, d):
    return table(spark, d, "events").where(F.get_json_object("props", "$").isNotNull()).select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


_EV = "(select user_id, row_number() over (partition by user_id order by ts, event_id) as n, event_type = 'error' as stop from events)"


@query(f"with f as (select user_id, count(*) as total, min(case when stop then n end) as first_stop from {_EV} group by user_id) select user_id, least(coalesce(first_stop, total), 5)::int as rounds, case when coalesce(first_stop, total + 1) <= total or total >= 5 then 'finished' else 'processing' end as status from f")
def r2_item_states(spark, d):
    """Replayed states of users' events; an error event ends an item, five rounds at most."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return R.replay_states(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "error", "Terminate"), 5)


@query("select user_id, max(ts) as last_seen from events group by user_id having max(ts) >= (select max(ts) from events) - interval 3600 seconds")
def r7_live(spark, d):
    """Users seen in the last hour of the data."""
    e = table(spark, d, "events").select("user_id", "ts")
    end = e.agg(F.max("ts").cast("timestamp_ntz")).first()[0]
    return R.live_workers(e, "user_id", "ts", F.lit(end).cast("timestamp_ntz"), 3600)


@query(
    "with h as (select o_orderkey, ('0x' || left(md5('4|' || o_orderkey::varchar), 8))::bigint / 4294967296.0 as c from orders) select o_orderkey, case when c < 0.25 then 'a' when c < 0.5 then 'b' else 'c' end as worker from h"
)
def r8_dispatch(spark, d):
    return R.dispatch(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", [("a", 1.0, 0.0), ("b", 1.0, 3.0), ("c", 2.0, 1.0)], "lottery", 4)


@query(f"select case_id, case coalesce(lower(trim(difficulty)), '') when 'basic' then 'basic' else 'intermediate' end as level from {C}")
def r12_routing(spark, d):
    return cases(spark, d, "difficulty").select("case_id", R.route(F.col("difficulty"), "intermediate").alias("level"))


@query(
    f"""with k as (select task_name, model, avg(score) as s from {S} group by task_name, model) select task_name, model, round(s, 6) as mean_score from k where s < (select avg(score) from {S})"""
)
def j11_below_average(spark, d):
    """Groups under the overall mean."""
    x = scores(spark, d, "task_name", "model", "score")
    mean = x.agg(F.avg("score")).first()[0]
    k = x.groupBy("task_name", "model").agg(F.avg("score").alias("s"))
    return k.where(F.col("s") < F.lit(mean)).select("task_name", "model", F.round("s", 6).alias("mean_score"))


@query(
    f"""with o as (select case_id, letter, txt from (select case_id, ground_truth as g from {C} where ground_truth is not null), lateral (select * from (values ('A', 'stable angina'), ('B', 'lipoma'), ('C', 'renal colic')) v(letter, txt)) where txt = lower(trim(g)))
select case_id, letter from o"""
)
def j22_option_letters(spark, d):
    opts = F.create_map(F.lit("A"), F.lit("stable angina"), F.lit("B"), F.lit("lipoma"), F.lit("C"), F.lit("renal colic"))
    return cases(spark, d, "ground_truth").select("case_id", joins.letter_by_text(opts, F.col("ground_truth")).alias("letter")).where("letter is not null")


_SQ = "osce_examination"


@query(f"select scenario_id, {_SQ}.objective_for_doctor is not null and {_SQ}.patient_actor is not null and {_SQ}.physical_examination_findings is not null and {_SQ}.correct_diagnosis is not null as valid from (select distinct scenario_id, {_SQ} from demo_scenario)")
def f25_valid_scenarios(spark, d):
    x = table(spark, d, "demo_scenario").select("scenario_id", "osce_examination").dropDuplicates(["scenario_id"])
    return x.select("scenario_id", P.valid_scenario(F.col("osce_examination")).alias("valid"))


@query(f"select subject_id, study_id, count(*) filter (upper(trim(viewposition)) in ('PA', 'AP')) as frontal, count(*) as images from (select distinct * from studies) group by subject_id, study_id")
def f22_views(spark, d):
    x = table(spark, d, "studies").distinct()
    return x.groupBy("subject_id", "study_id").agg(F.count_if(P.frontal(F.col("viewposition"))).alias("frontal"), F.count("*").alias("images"))
