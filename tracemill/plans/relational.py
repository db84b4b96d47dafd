"""Queries of joins, windows, sampling and linking (J*, W*, U*, L*, A*), with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import linking as K
from ..operators import metrics as M
from ..operators import sampling as W
from ..session import table
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


def cases(spark, d, *columns):
    """demo_case once per row with the columns asked for."""
    return table(spark, d, "demo_case").select("case_id", *columns).distinct()


C = "(select distinct case_id, source_dataset, framework, source_id, split, difficulty, question, ground_truth, model_answer, is_correct, image_file, created_at from demo_case)"
ST = "(select distinct * from studies)"


def studies(spark, d):
    return table(spark, d, "studies").distinct()


@query(f"select case_id, split from {C} c where exists (select 1 from {S} s where s.idx = c.case_id::varchar and s.score = 1.0)")
def j1_scored_cases(spark, d):
    """Cases with a full score."""
    ok = table(spark, d, "per_sample").where("score = 1.0").select(F.col("idx").try_cast("bigint").alias("case_id"))
    return J.keep_matching(cases(spark, d, "split"), ok, "case_id").select("case_id", "split")


@query(f"select case_id from {C} c where not exists (select 1 from {S} s where s.idx = c.case_id::varchar)")
def j12_resume(spark, d):
    """Cases nobody has scored yet."""
    done = table(spark, d, "per_sample").select(F.col("idx").try_cast("bigint").alias("case_id"))
    return J.resume(cases(spark, d).select("case_id"), done, "case_id")


@query(f"select distinct case_id from {C} c where exists (select 1 from {S} s where s.idx = c.case_id::varchar and s.score = 0.0 and s.model = 'agent_4b')")
def j13_rerun(spark, d):
    bad = table(spark, d, "per_sample").where("score = 0.0 and lower(model_name) = 'agent_4b'").select(F.col("idx").try_cast("bigint").alias("case_id"))
    return J.keep_matching(cases(spark, d).select("case_id"), bad, "case_id")


@query(
    f"""with a as (select idx, sample_id from {S} where model = 'agent_4b' and score = 1), b as (select idx, min(sample_id) as sample_id from {S} where model = 'frontier_x' and score = 1 and idx is not null and idx not in (select idx from a where idx is not null) group by idx)
select idx, sample_id, 'first' as origin from a union all select idx, sample_id, 'second' from b"""
)
def j14_escalation(spark, d):
    x = scores(spark, d, "model", "idx", "score").select("idx", "sample_id", "model", "score")
    a, b = (x.where(F.col("model") == m).select("idx", "sample_id", "score") for m in ("agent_4b", "frontier_x"))
    return J.escalate(a, b, "idx", F.coalesce(F.col("score") == 1, F.lit(False))).select("idx", "sample_id", "origin")


@query("select l_orderkey, l_linenumber, o_custkey from lineitem join orders on l_orderkey = o_orderkey where l_shipdate::date >= o_orderdate::date and l_shipdate::date <= o_orderdate::date + 30")
def j3_range(spark, d):
    """Equi and range join."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", F.col("o_orderdate").alias("o_end"))
    x = J.interval_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), o, ["l_orderkey"], "l_shipdate", "o_orderdate", "o_end", 30)
    return x.select("l_orderkey", "l_linenumber", "o_custkey")


@query(
    f"""with p as (select scenario_id, any_value(subject_id) as subject_id from demo_scenario group by scenario_id), s as (select subject_id, count(*) as images, count(distinct study_id) as studies from {ST} group by subject_id)
select scenario_id, p.subject_id, coalesce(images, 0) as images, coalesce(studies, 0) as studies from p left join s using (subject_id)"""
)
def j5_scenario_images(spark, d):
    """Scenarios with their subject's images, counted per subject before the join, so a hot subject costs no fan-out."""
    s = studies(spark, d).groupBy("subject_id").agg(F.count("*").alias("images"), F.countDistinct("study_id").alias("studies"))
    p = table(spark, d, "demo_scenario").select("scenario_id", "subject_id").distinct()
    return p.join(s, "subject_id", "left").select("scenario_id", "subject_id", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("studies", F.lit(0)).alias("studies"))


@query(f"select sample_id, coalesce(difficulty, 'unrated ' || idx) as difficulty from {S} s left join (select case_id, min(difficulty) as difficulty from {C} group by case_id) c on c.case_id::varchar = s.idx")
def j6_lookup_fallback(spark, d):
    """A score's case difficulty, with a fallback for unknown cases and cases without one."""
    dim = cases(spark, d, "difficulty").select(F.col("case_id").cast("string").alias("idx"), "difficulty")
    x = J.lookup(scores(spark, d, "idx").select("sample_id", "idx"), dim, ["idx"], {"difficulty": F.concat(F.lit("unrated "), F.col("idx"))})
    return x.select("sample_id", "difficulty")


@query("select o_orderkey, count(*) as n, sum(l_quantity) as qty from orders join lineitem on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT' group by o_orderkey")
def j8_restricted_facts(spark, d):
    """Facts of the needed orders only (semi-join before aggregation)."""
    need = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    x = J.keep_matching(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), need, "l_orderkey")
    return x.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query(
    """with a as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as no from orders), b as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as no from customer)
select o_orderkey, c_custkey from a join b using (no)"""
)
def j17_zip(spark, d):
    """The n-th order by date with the n-th customer by balance."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    c = table(spark, d, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("neg"))
    return J.zip_by_order(o, c, ["o_orderdate", "o_orderkey"], ["neg", "c_custkey"]).select("o_orderkey", "c_custkey")


@query(f"select a.case_id as case_a, b.case_id as case_b from {C} a join {C} b on a.image_file = b.image_file and lower(trim(a.question)) = lower(trim(b.question)) and a.case_id < b.case_id")
def j18_text_key(spark, d):
    """Composite key of image and lower-case question."""
    x = cases(spark, d, "question", "image_file").where("image_file is not null and question is not null").select("case_id", "image_file", F.lower(F.trim("question")).alias("q"))
    y = x.select(F.col("case_id").alias("case_b"), "image_file", "q")
    return x.withColumnRenamed("case_id", "case_a").join(y, ["image_file", "q"]).where("case_a < case_b").select("case_a", "case_b")


_M = f"(select idx, task_name, avg(score) as score from {S} where model = '{{0}}' and idx is not null group by idx, task_name)"


@query(
    f"""select count(*) as n, count(*) filter (a.score > 0.5 or b.score > 0.5) as upper_bound, count(*) filter (a.score > 0.5) as ours, count(*) filter (coalesce(c.score, b.score) > 0.5) as fallback, count(*) filter (c.idx is null) as missing
from {_M.format("agent_4b")} a join {_M.format("frontier_x")} b using (idx, task_name) left join {_M.format("baseline_s")} c using (idx, task_name)"""
)
def j20_three_predictors(spark, d):
    """Two required predictors, an optional third, upper bound and fallback counts."""
    x = scores(spark, d, "task_name", "model", "idx", "score").where("idx is not null").groupBy("model", "idx", "task_name").agg(F.avg("score").alias("score")).withColumn("key", F.concat_ws("|", "idx", "task_name"))
    a, b, c = (x.where(F.col("model") == m).select("key", "score") for m in ("agent_4b", "frontier_x", "baseline_s"))
    y = J.compare_predictors(a, b, c, "key")
    third = F.col("third").try_cast("double")
    # a partner whose mean is null counts as missing only if it has no row, so presence is joined too
    y = y.join(c.select("key", F.lit(True).alias("has")), "key", "left")
    return y.agg(F.count("*").alias("n"), F.count_if((F.col("ours") > 0.5) | (F.col("other") > 0.5)).alias("upper_bound"), F.count_if(F.col("ours") > 0.5).alias("ours"), F.count_if(F.coalesce(third, F.col("other")) > 0.5).alias("fallback"), F.count_if(F.col("has").isNull()).alias("missing"))


@query(
    """with t as (select distinct scenario_id, osce_examination.test_results as r from demo_scenario), e as (select scenario_id, unnest(map_entries(r)) as e from t)
select scenario_id, e.key as panel, list_sort(list_filter(map_keys(e.value), lambda k: contains(lower(k), 'sodium') or contains('sodium', lower(k))))[1] as hit from e where e.value is not null"""
)
def j21_containment_lookup(spark, d):
    """J21 over every panel of test results."""
    x = table(spark, d, "demo_scenario").select("scenario_id", F.col("osce_examination.test_results").alias("r")).dropDuplicates(["scenario_id"])
    x = x.select("scenario_id", F.explode("r").alias("panel", "m")).where("m is not null")
    return x.select("scenario_id", "panel", J.key_by_containment(F.map_keys("m"), F.lit("sodium")).alias("hit"))


@query(
    f"""select subject_id, study_id, dicom_id, viewposition from (select *, row_number() over (partition by subject_id, study_id order by case upper(trim(viewposition)) when 'PA' then 0 else 1 end, dicom_id, studydate nulls first) as rn from {ST} where upper(trim(viewposition)) in ('PA', 'AP') and subject_id is not null and study_id is not null) where rn = 1"""
)
def w1_best_view(spark, d):
    return K.best_view(studies(spark, d)).select("subject_id", "study_id", "dicom_id", "viewposition")


_DATE = "coalesce(try_strptime(studydate, '%Y%m%d'), try_strptime(studydate, '%Y-%m-%d'))::date"


@query(f"select subject_id, min(dt) as first_date, max(dt) as last_date, count(distinct study_id) as studies from (select *, {_DATE} as dt from {ST}) where dt is not null group by subject_id")
def w2_study_span(spark, d):
    """W2, S9 dates: first and last valid study date per subject, two spellings of dates, others dropped."""
    x = studies(spark, d).withColumn("dt", K.study_date(F.col("studydate"))).where("dt is not null")
    return x.groupBy("subject_id").agg(F.min("dt").alias("first_date"), F.max("dt").alias("last_date"), F.countDistinct("study_id").alias("studies"))


@query(
    f"""with v as (select subject_id, study_id, dicom_id, {_DATE} as dt, row_number() over (partition by subject_id, study_id order by case upper(trim(viewposition)) when 'PA' then 0 else 1 end, dicom_id, studydate nulls first) as rn from {ST} where upper(trim(viewposition)) in ('PA', 'AP') and subject_id is not null and study_id is not null),
p as (select scenario_id, any_value(subject_id) as subject_id, any_value(created_at)::date as made from demo_scenario group by scenario_id),
m as (select scenario_id, v.*, row_number() over (partition by scenario_id order by dt, study_id) as k from p join v using (subject_id) where rn = 1 and dt is not null and dt <= made and made <= dt + 366)
select scenario_id, subject_id, study_id, dt as study_date from m where k = 1"""
)
def k_linked_studies(spark, d):
    """Per scenario the earliest frontal study of its subject in the year before it was created."""
    v = K.best_view(studies(spark, d)).withColumn("dt", K.study_date(F.col("studydate"))).where("dt is not null").select("subject_id", "study_id", "dt")
    p = table(spark, d, "demo_scenario").select("scenario_id", "subject_id", F.col("created_at").cast("date").alias("at")).distinct()
    x = J.interval_join(p, v.withColumn("end", F.col("dt")), ["subject_id"], "at", "dt", "end", 366)
    return K.earliest(x.select("scenario_id", "subject_id", "study_id", "dt"), ["scenario_id"], "dt", "study_id").select("scenario_id", "subject_id", "study_id", F.col("dt").alias("study_date"))


@query(f"select sample_id, idx, question, image_path from (select *, row_number() over (partition by idx, image_path, left(question, 80) order by sample_id) as rn from {S}) where rn = 1")
def w5_composite_key(spark, d):
    """One row per (item, image, first 80 characters of the question); the 80 are the key's definition."""
    return W.distinct_by(scores(spark, d, "idx", "question", "image_path"), F.col("idx"), F.col("image_path"), F.substring("question", 1, 80)).select("sample_id", "idx", "question", "image_path")


@query(
    f"""with r as (select sample_id, task_name, md5('7|' || sample_id::varchar) as h from {S} where score = 0.0), k as (select *, row_number() over (partition by task_name order by h, sample_id) as rn from r)
select sample_id, task_name from k where rn <= 10 order by h, sample_id limit 40"""
)
def w9_capped(spark, d):
    """Ten per task, then forty in all, by luck."""
    x = scores(spark, d, "task_name", "score").where("score = 0.0").select("sample_id", "task_name")
    return W.capped(x, ["task_name"], 10, [W.luck(7, F.col("sample_id")), F.col("sample_id")], 40)


@query(
    f"""with c as (select case_id, framework, md5('3|' || case_id::varchar) as h from {C} where framework is not null), n as (select framework, count(*) as n from c group by framework), t as (select framework, floor(least(n, 0.5 * (select max(n) from n)))::bigint as target from n),
k as (select c.*, row_number() over (partition by framework order by h, case_id) as rn from c) select case_id, framework from k join t using (framework) where rn <= target"""
)
def w10_ratio(spark, d):
    """Of each framework at most half as many as the largest has."""
    x = cases(spark, d, "framework").where("framework is not null").select("case_id", "framework")
    n = x.groupBy("framework").count()
    m = n.agg(F.max("count")).first()[0] or 0
    t = n.select("framework", F.floor(F.least(F.col("count").cast("double"), F.lit(0.5 * m))).alias("target"))
    return W.take_ratio(x, "framework", t, [W.luck(3, F.col("case_id")), F.col("case_id")])


@query(f"select case_id from {C} order by md5('5|' || case_id::varchar), case_id limit 100")
def w12_shuffled(spark, d):
    return W.shuffled(cases(spark, d).select("case_id"), 5, ["case_id"], 100)


@query(f"select sample_id from {S} where not coalesce(pred = 'yes', false) or ('0x' || left(md5('1|' || sample_id::varchar), 8))::bigint / 4294967296.0 < 0.33")
def w13_thinned(spark, d):
    """A third of the rows with the answer yes, all others."""
    return W.thinned(scores(spark, d, "pred").select("sample_id", "pred"), F.col("pred") == "yes", 0.33, 1, ["sample_id"]).select("sample_id")


@query(
    "with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as no, count(*) over () as n from orders) select o_orderkey, least(no // greatest(n // 7, 1), 6)::int as floor_chunk, (no // greatest(ceil(n / 7)::bigint, 1))::int as ceil_chunk from n"
)
def w14_chunks(spark, d):
    """Seven chunks by both rules."""
    o = table(spark, d, "orders").select("o_orderkey")
    n = F.lit(o.count())
    return J.numbered(o, ["o_orderkey"], "no").select("o_orderkey", W.chunk_floor(F.col("no"), n, 7).alias("floor_chunk"), W.chunk_ceil(F.col("no"), n, 7).alias("ceil_chunk"))


@query()
def w7_buckets(spark, d):
    """Greedy choice over (task, model) buckets by score."""
    x = scores(spark, d, "task_name", "model", "idx", "score").where("score is not null").select("sample_id", "idx", "task_name", "model", "score")
    return W.best_of_buckets(x, ["idx"], ["task_name", "model"], "score", 5, 60, 11).select("sample_id", "task_name", "model")


@query(
    f"""with recursive c as (select case_id, case when image_file is not null then length(question) else -length(question) end as len, md5('0|' || case_id::varchar) as h from {C} where question is not null),
n as (select *, (row_number() over (order by sign(len), h, case_id) - 1) // 32 as megabatch from c),
r as (select *, row_number() over (partition by megabatch order by abs(len) desc, h) - 1 as i, count(*) over (partition by megabatch) as n from n),
g as (select megabatch, 0::bigint as i, [0, 0, 0, 0]::double[] as sums, [0, 0, 0, 0]::int[] as counts, 0 as rank, 0::bigint as chars from (select distinct megabatch from r)
 union all select g.megabatch, g.i + 1, list_transform(sums, lambda v, j: case when j != list_position(sums, list_min(sums)) then v when counts[j] + 1 >= n / 4 then 'infinity'::double else v + abs(len) end),
 list_transform(counts, lambda v, j: case when j = list_position(sums, list_min(sums)) then v + 1 else v end), case when n % 4 = 0 then list_position(sums, list_min(sums)) - 1 else g.i % 4 end, abs(len) from g join r on r.megabatch = g.megabatch and r.i = g.i)
select megabatch, rank::int as rank, count(*) as n, sum(chars)::bigint as chars from g where i > 0 group by megabatch, rank"""
)
def w16_length_batches(spark, d):
    """Sums of lengths per megabatch and rank."""
    x = cases(spark, d, "question", "image_file").where("question is not null").select("case_id", F.when(F.col("image_file").isNotNull(), F.length("question")).otherwise(-F.length("question")).alias("len"))
    return W.length_batches(x, "case_id", "len", 8, 4).groupBy("megabatch", "rank").agg(F.count("*").alias("n"), F.sum(F.abs("len")).alias("chars"))


@query(f"select 'case' as origin, case_id as id, question from {C} union all select 'sample', sample_id, question from {S}")
def u1_union_tagged(spark, d):
    """U1, U2."""
    a = cases(spark, d, "question").select(F.col("case_id").alias("id"), "question")
    b = scores(spark, d, "question").select(F.col("sample_id").alias("id"), "question")
    return W.union_tagged({"case": a, "sample": b}).select("origin", "id", "question")


@query("select l_partkey from lineitem where l_quantity > 45 except select l_partkey from lineitem where l_quantity < 12")
def u3_difference(spark, d):
    """Parts that were ordered in large lots and never in small ones."""
    x = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    return x.where("l_quantity > 45").select("l_partkey").subtract(x.where("l_quantity < 12").select("l_partkey"))


@query(
    "with t as (select s_nationkey, s_suppkey, p_size, p_type, p_partkey from (select l_suppkey, l_partkey, count(*) from lineitem group by l_suppkey, l_partkey) join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey) select s_nationkey, count(*) as parts, sum(p_size) as size from t group by s_nationkey"
)
def j19_multiway(spark, d):
    """Three-way join by ids, pairs reduced first."""
    x = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    x = x.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    return x.groupBy("s_nationkey").agg(F.count("*").alias("parts"), F.sum("p_size").alias("size"))


@query(
    f"""select task_name, round(count(*) filter (pred is not null) / count(*), 6) as answered, round(count(*) filter (coalesce(score, 0) = 1) / count(*), 6) as right_share from {S} group by task_name"""
)
def a18_rates(spark, d):
    return scores(spark, d, "task_name", "score", "pred").groupBy("task_name").agg(M.rate(F.col("pred").isNotNull()).alias("answered"), M.rate(F.coalesce("score", F.lit(0.0)) == 1).alias("right_share"))


@query(
    """with t as (select distinct scenario_id, osce_examination.test_results as m from demo_scenario), o as (select scenario_id, unnest(map_entries(m)) as e from t), i as (select scenario_id, e.key as outer_key, unnest(map_entries(e.value)) as f from o),
j as (select scenario_id, outer_key, '{' || string_agg('"' || f.key || '":"' || f.value || '"', ',' order by f.key) || '}' as inner_map from i where f.value is not null group by scenario_id, outer_key)
select scenario_id, '{' || string_agg('"' || outer_key || '":' || inner_map, ',' order by outer_key) || '}' as results from j group by scenario_id"""
)
def a16_nested_results(spark, d):
    """Tests per scenario as a nested map again, the first value by text."""
    x = table(spark, d, "demo_scenario").select("scenario_id", F.explode("osce_examination.test_results").alias("category", "m")).select("scenario_id", "category", F.explode("m").alias("test", "value"))
    return M.nested_first(x, ["scenario_id"], "category", "test", "value", ["value"]).select("scenario_id", F.to_json("results").alias("results"))
