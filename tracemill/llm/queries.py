"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from . import bpe, cutoff, mixing, mojibake, overlap, packing, pairs

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.unmet_targets(mixing.mix_plan(mixing.case_sizes(table(spark, d, "demo_case")), table(spark, d, "mix_targets")))


def p1_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "demo_case"), table(spark, d, "mix_targets"))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "demo_case"), table(spark, d, "mix_targets"))


def p1_exact(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mix shrunk until every target is met."""
    return mixing.mix_report(table(spark, d, "demo_case"), table(spark, d, "mix_targets"), shrink=True)


def p1_plan(spark: SparkSession, d: str) -> DataFrame:
    x = mixing.mix_plan(mixing.case_sizes(table(spark, d, "demo_case")), table(spark, d, "mix_targets"))
    return x.select("mix_id", "have", F.round("demand", 3).alias("demand"), F.round("delivered", 3).alias("delivered"), F.round("slope", 6).alias("slope"), F.round("runs_dry", 6).alias("runs_dry"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.values(table(spark, d, "demo_case"), table(spark, d, "data_example"))


def _all_values(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.all_values(table(spark, d, "demo_case"), table(spark, d, "data_example"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.verdicts(_all_values(spark, d)).where(F.col("tab") != cutoff.ANSWERS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_values(_verdicts(spark, d))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_rates(_verdicts(spark, d), mixing.source_key(F.col("source")))


def p2_lengths(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d).where("text != ''")
    lengths = v.select("tab", mixing.source_key(F.col("source")).alias("source_key"), F.xxhash64("text").alias("h"), cutoff.length_columns(F.col("text")).alias("lengths"))
    return cutoff.exposed_lengths(cut_lineage(lengths))


def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.hidden_limits(cutoff.value_rows(cut_lineage(cutoff.looked_at(_values(spark, d)))))


def p2_evidence(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.evidence(cutoff.verdicts(_all_values(spark, d), mark_all=True).where(F.col("tab") != cutoff.ANSWERS))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.pair_rows(overlap.overlaps(table(spark, d, "demo_case")))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return overlap.link_counts(overlap.links(table(spark, d, "demo_case")))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(overlap.link_counts(overlap.links(table(spark, d, "demo_case"))))


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(pairs.pairs_and_values(table(spark, d, "demo_case"), table(spark, d, "data_example")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d)


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).groupBy("tab", "defect").agg(F.count("*").alias("pairs"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"), bpe.Vocabulary(spark))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids are not their text: none."""
    docs, v = table(spark, d, "documents"), bpe.Vocabulary(spark)
    back = bpe.decode_documents(bpe.encode_documents(docs, v), v).withColumnRenamed("text", "decoded")
    return back.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").where("decoded != text").select("doc_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack(bpe.token_counts(docs, bpe.Vocabulary(spark)), table(spark, d, "pack_specs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.oversized(_packed(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_report(_packed(spark, d), table(spark, d, "pack_specs"))


def _example_specs(spark: SparkSession, d: str) -> DataFrame:
    """pack_specs for instruction data: half of a container may bear loss, and it holds a conversation per 128 tokens at most."""
    return table(spark, d, "pack_specs").select("spec_name", "capacity_tokens", F.floor(F.col("capacity_tokens") / 128).cast("int").alias("max_segments"), F.floor(F.col("capacity_tokens") / 2).cast("int").alias("max_loss_tokens"))


def p7_examples(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of data_example under limits on tokens, conversations and the replies' tokens."""
    return packing.pack(bpe.conversation_counts(table(spark, d, "data_example"), bpe.Vocabulary(spark)), _example_specs(spark, d))


def p7_examples_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_report(p7_examples(spark, d), _example_specs(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents"))


def p8_key(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.learn(mojibake.prepared(table(spark, d, "documents")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_mix, p1_shares, p1_exact, p1_plan, p2_found, p2_rates, p2_lengths, p2_limits, p2_evidence, p4_found, p4_links, p4_report, p5_found, p5_counts, p6_ids, p6_roundtrip, p7_found, p7_containers, p7_report, p7_examples, p7_examples_report, p8_found, p8_restored, p8_key)}

_SRC = r"nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '^.*[/\\]', ''), '[(\[]?\s*\bv(er(sion)?)?\.?\s*\d+(\.\d+)*\s*[)\]]?\s*$', ''), '[^\p{{L}}\p{{N}}]', '', 'g'), '')"
_LENGTHS = """with v as (select distinct 'demo_case' as tab, case_id, -1 as no, source_dataset as source, example_reasoning['Moderator'] as t from demo_case where case_id is not null
 union all select distinct 'data_example', example_id, i - 1, source_dataset, messages[i].content from (select *, unnest(range(1, len(messages) + 1)) as i from data_example where example_id is not null)),
texts as (select distinct tab, coalesce({src}, '') as src, t from v where t != ''),
c as (select tab, src, t, length(t) as n, strlen(t) as utf8, length(regexp_replace(t, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) as wide, length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) as other,
 length(t) - length(replace(t, '"', '')) as quotes, length(t) - length(replace(t, chr(10), '')) as lines, length(t) - length(regexp_replace(t, '[\\\\\t\r]', '', 'g')) as esc,
 length(t) - length(replace(t, '&', '')) as amp, length(t) - length(regexp_replace(t, '[<>]', '', 'g')) as angle, length(t) - length(replace(t, chr(39), '')) as apos from texts),
l as (select tab, src, t, [n, utf8, n + wide, n + 4 * amp + 3 * angle + 5 * (quotes + apos), n + quotes + esc + lines, n + quotes + esc + lines + 5 * other + 6 * wide, n + lines] as ls from c),
r as (select tab, src, t, lsource, no, ls[no] as length from (select *, unnest(list_distinct(['', src])) as lsource from l), (select unnest(range(1, 8)) as no)),
counts as (select tab, lsource, no, length, count(*) as values from r group by all),
near as (select *, greatest((sum(values) over (partition by tab, lsource, no order by length range between 8 preceding and 8 following) - values) / 16, 0.1) as usual from counts),
cand as (select *, round(values * ln(values / usual) - values + usual, 6) as dev from near where values >= 5 and values >= 3 * usual and values * ln(values / usual) - values + usual >= 12),
votes as (select r.tab, r.src, r.t, arg_max({{'s': cand.lsource, 'no': cand.no, 'l': cand.length, 'u': cand.usual}}, row(dev, cand.lsource != '', -cand.no, -cand.length)) as v from r join cand using (tab, lsource, no, length) group by all),
kept as (select tab, v.s as source, v.no as no, v.l as length, v.u as u, count(*) as values from votes group by all)
select tab, source, ['chars', 'utf8', 'utf16', 'entities', 'json', 'json_ascii', 'crlf'][no] as variant, length, values, round(u, 4) as usual from kept where values >= 5 and values >= 3 * u and values * ln(values / u) - values + u >= 12"""
_FW = """case when regexp_matches(regexp_replace({0}, '^framework ?', ''), '^(i|1)( |$)') then 'I'
 when regexp_matches(regexp_replace({0}, '^framework ?', ''), '^(ii|2)( |$)') then 'II'
 when regexp_matches(regexp_replace({0}, '^framework ?', ''), '^(iii|3)( |$)') then 'III'
 when regexp_matches(regexp_replace({0}, '^framework ?', ''), '^(iv|4)( |$)') then 'IV'
 when ends_with(replace({0}, ' ', ''), 'continuoustoolcalling') then 'I' when ends_with(replace({0}, ' ', ''), 'interleavedthinkingwithimages') then 'II'
 when ends_with(replace({0}, ' ', ''), 'multiagentcollaboration') then 'III' when ends_with(replace({0}, ' ', ''), 'clinicalsimulation') then 'IV' end"""
_FW = _FW.format("trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))")

_PLAN = f"""
with c as (select distinct case_id, {_SRC.format("source_dataset")} as src, {_FW.format("framework")} as fw, coalesce(length(question), 0) as size from demo_case),
have as (select src, fw, sum(size)::bigint as have from c where src is not null and fw is not null group by src, fw),
t as (select mix_id, {_SRC.format("source_dataset")} as src, {_FW.format("framework")} as fw, target_share as share, max_repeats from mix_targets),
total as (select sum(have) as total from have where exists (select 1 from t where t.src = have.src and t.fw = have.fw)),
p as (select t.*, coalesce(have, 0) as have, share * total as demand, (coalesce(have, 0) * max_repeats)::double as most, 0.5 * (1 - 2 * (row_number() over (order by share desc, mix_id) - 1) / greatest(count(*) over () - 1, 1)) as raw from t left join have using (src, fw) cross join total),
q as (select *, raw - sum(raw * share) over () / sum(share) over () as mid from p),
r as (select *, mid * least(1, 0.95 / max(abs(mid)) over ()) as slope from q),
plan as (select *, least(demand, most) as delivered, case when demand > most then case when abs(slope) < 1e-9 then most / demand else 2 * (most / demand) / (1 + slope + sqrt((1 + slope) ** 2 - 4 * slope * most / demand)) end else 1 end as runs_dry from r)"""

ORACLE: dict[str, str] = {
    "p2_lengths": _LENGTHS.format(src=_SRC.format("source")),
    "p1_found": _PLAN + " select mix_id from plan where have * max_repeats < demand",
    "p1_plan": _PLAN + " select mix_id, have, round(demand, 3) as demand, round(delivered, 3) as delivered, round(slope, 6) as slope, round(runs_dry, 6) as runs_dry from plan",
}
