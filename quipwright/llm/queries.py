"""Queries of the llm subpackage, each over its whole tables, and oracle SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quipwright.llm import consensus, history, languages, lookalike, mixing, moderation, packing, spans, splits
from quipwright.session import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.torn_groups(table(spark, d, "solution"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_records(table(spark, d, "solution"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return moderation.scored_lane(table(spark, d, "harvest_records"), table(spark, d, "content_labels"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = _scored(spark, d).where(f"record_id is not null and score >= {moderation.THRESHOLD}")
    return found.select("record_id").distinct()


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return moderation.rates(_scored(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    lane = table(spark, d, "harvest_records").where("lane = 'icanhazdadjoke'").select("record_id", "text")
    return moderation.group_mentions(lane, materialize(_scored(spark, d), "scored"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(table(spark, d, "harvest_records"), table(spark, d, "language_samples"))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return languages.segments_of_lane(table(spark, d, "harvest_records"), table(spark, d, "language_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(history.lane_batch(table(spark, d, "harvest_records"), table(spark, d, "harvest_files")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.Consensus(table(spark, d, "panel_votes")).labels().select("item", "reaction")


def p5_judges(spark: SparkSession, d: str) -> DataFrame:
    return consensus.Consensus(table(spark, d, "panel_votes")).judges()


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    found = consensus.Consensus(table(spark, d, "panel_votes")).agreement()
    return found.withColumns({c: F.round(c, 9) for c in ("observed", "expected", "alpha")})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_pairs_of(table(spark, d, "harvest_records"))


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_records(table(spark, d, "harvest_records")).select("record_id", "form")


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_classes(table(spark, d, "harvest_records"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(materialize(p8_containers(spark, d), "packed"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.documents_with_shared_span(table(spark, d, "documents"))


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_part(table(spark, d, "documents")).withColumn("share", F.round("share", 9))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p2_found, p2_scores, p2_rates, p2_groups, p3_found, p3_segments, p4_found, p5_found, p5_judges, p5_agreement, p7_found, p7_forms, p7_classes, p8_containers, p8_report, p9_mix, p9_shares,
        p10_found, p10_spans, p10_share,
    )
}

_KEY = r"nullif(lower(regexp_replace({}, '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g')), '')"
_SETUP, _AUTHOR, _USE = (_KEY.format(c) for c in ("setup_key", "author_key", "usage"))
_VOTES = r"""
with r as (select vote_id, item, coalesce(judge_id, '') judge_id, persona, regexp_replace(lower(reaction), '[^a-z]', '', 'g') x from panel_votes where item is not null and coalesce(ok, true)),
c as (select *, case when starts_with(x, 'silen') then 'silence' when starts_with(x, 'groan') then 'groan' when starts_with(x, 'smil') then 'smile' when starts_with(x, 'laugh') then 'laugh' end reaction from r),
v as (select item, judge_id, persona, reaction from (select *, row_number() over (partition by vote_id order by item, judge_id, persona, reaction) n from c where reaction is not null and vote_id is not null) where n = 1
  union all select distinct item, judge_id, persona, reaction from c where reaction is not null and vote_id is null)
"""
_RUNS = """
with w as (select doc_id, unnest(range(0, greatest(length(text) - 199, 0))) o, text from documents where doc_id is not null),
s as (select doc_id, o, md5(substring(text, o + 1, 200)) h from w),
k as (select h from s group by h having count(distinct doc_id) > 1), hit as (select doc_id, o from s semi join k using (h))
"""

# The other operators are iterative, learnt, or need code-point arithmetic; they are tested against brute force instead.
ORACLES: dict[str, str] = {
    "p1_found": f"""
with recursive t as (select id, 's' || {_SETUP} s, case when starts_with({_AUTHOR}, 'au_') then 'a' || {_AUTHOR} end a, {_USE} u from solution),
e as (select distinct 'i' || id u, s v from t where id is not null and s is not null union select 'i' || id, a from t where id is not null and a is not null union select s, a from t where s is not null and a is not null),
b as (select u, v from e union select v, u from e),
reach(x, y) as (select u, u from b union select reach.x, b.v from reach join b on reach.y = b.u),
g as (select x, min(y) c from reach group by x),
n as (select coalesce(g1.c, g2.c, g3.c, 'i' || id) c, id, u from t left join g g1 on g1.x = 'i' || id left join g g2 on g2.x = s left join g g3 on g3.x = a)
select distinct id from n where id is not null and c in (select c from n group by c having count(distinct u) > 1)""",
    "p5_agreement": _VOTES + """
, n as (select item, reaction, count(*) n from v group by 1, 2), m as (select item, sum(n) m, sum(n * (n - 1)) same from n group by 1 having sum(n) > 1),
o as (select count(*) n_items, sum(m) n_votes, sum(same / (m - 1)) agree from m), p as (select reaction, sum(n) n from n join m using (item) group by 1), q as (select sum(n * (n - 1)) chance from p)
select n_items, n_votes, round(agree / n_votes, 9) observed, round(chance / (n_votes * (n_votes - 1)), 9) expected, round((agree / n_votes - chance / (n_votes * (n_votes - 1))) / (1 - chance / (n_votes * (n_votes - 1))), 9) alpha from o, q""",
    "p10_found": _RUNS + "select distinct doc_id from hit",
    "p10_share": _RUNS + """
, c as (select doc_id, sum(least(200, coalesce(d, 200))) c from (select doc_id, lead(o) over (partition by doc_id order by o) - o d from hit) group by 1)
select d.doc_id, coalesce(length(text), 0) n_chars, coalesce(c, 0) shared_chars, round(coalesce(c / nullif(length(text), 0), 0), 9) share from documents d left join c using (doc_id) where d.doc_id is not null""",
}
