"""Corpus queries: samples, censuses, screens, duplicates and overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quipwright.functions import scores, rights, text as tx
from quipwright.operators import corpus as op, matching
from quipwright.plans.base import Plans
from quipwright.session import table

P = Plans()
_NORM = r'''lower(trim(regexp_replace(translate({0}, '’‘“”', chr(39) || chr(39) || '""'), '\s+', ' ', 'g')))'''
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@P.query("""
select doc_id, source, lang, n_chars from (
  select *, row_number() over (partition by source order by sha256(text) nulls first, doc_id) rn from documents) t
where rn <= 20""")
def capped_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return op.hash_sample(docs, 20, ["source"], F.sha2("text", 256), "doc_id").select("doc_id", "source", "lang", "n_chars")


@P.query("""
select case when grouping(source) = 0 then 'source' when grouping(lang) = 0 then 'lang' when grouping(record_kind) = 0 then 'record_kind' when grouping(license) = 0 then 'license' else 'all' end dim,
  coalesce(source, lang, record_kind, license, 'all') as value, count(*) n
from (select coalesce(source, '(null)') source, coalesce(lang, '(null)') lang, coalesce(record_kind, '(null)') record_kind, coalesce(license, '(null)') license from documents)
group by grouping sets ((source), (lang), (record_kind), (license), ())""")
def census_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    return op.census(table(spark, d, "documents"), "source", "lang", "record_kind", "license")


_FAMILY = r"regexp_replace(regexp_extract(lower(trim(coalesce({0}, ''))), '^([^:/(]*)', 1), '[ _.-]*[0-9]*$', '')"


@P.query(f"""
with f as (select case when {_FAMILY.format('source')} = '' then 'unknown' else {_FAMILY.format('source')} end g from harvest_records),
s as (select g, count(*) n from f group by g)
select (select g from s order by n desc, g limit 1) top, max(n) n, round(max(n) / sum(n), 9) share, count(*) groups from s""")
def top_family_share(spark: SparkSession, d: str) -> DataFrame:
    rows = op.top_share(table(spark, d, "harvest_records"), rights.source_family(F.col("source")))
    return rows.withColumn("share", F.round("share", 9))


@P.query(f"""
select case when {_FAMILY.format('source')} = '' then 'unknown' else {_FAMILY.format('source')} end family, count(*) n, count(distinct source) sources
from harvest_records group by 1""")
def source_families(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").select("source", rights.source_family(F.col("source")).alias("family"))
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


def _licence_case() -> str:
    low = r"regexp_replace(lower(coalesce(license, '')), '\s+', ' ', 'g')"
    return "case " + " ".join(f"when regexp_matches({low}, '{p}') then '{n}'" for n, p in rights.LICENCE_RULES) + " else 'unclassified' end"


@P.query(f"select lane, {_licence_case()} licence, count(*) n from harvest_records group by 1, 2")
def licence_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "harvest_records").groupBy("lane", rights.licence_class(F.col("license")).alias("licence")).agg(F.count("*").alias("n"))


@P.query(r"""
select count(*) rows_in, count(*) filter (text is null) dropped_present,
  count(*) filter (text is not null and not length(trim(text)) >= m) dropped_length,
  count(*) filter (text is not null and length(trim(text)) >= m and regexp_matches(text, '(?i)umbrella')) dropped_denied,
  count(*) filter (text is not null and length(trim(text)) >= m and not regexp_matches(text, '(?i)umbrella')) rows_kept
from (select text, case when regexp_matches(text, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') then 3 else 8 end m from harvest_records)""")
def screens_with_drops(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    stages = {"present": c.isNotNull(), "length": F.length(F.trim(c)) >= tx.min_chars(c), "denied": ~c.rlike("(?iu)umbrella")}
    return op.staged_screens(table(spark, d, "harvest_records"), stages)


@P.query(f"""
with f as (select {_NORM.format('text')} k, count(*) n, min(text) a, max(text) b from harvest_records where text is not null group by 1 having count(*) > 1)
select count(*) as groups, coalesce(sum(n), 0) as rows, count(*) filter (a = b) identical, count(*) filter (a <> b) varied from f""")
def normal_text_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return op.duplicate_profile(table(spark, d, "harvest_records"), "text")


@P.query("""
select doc_id from documents where text is not null and substr(sha256(trim(text)), 1, 16) not in
  (select substr(sha256(trim(text)), 1, 16) from harvest_records where text is not null)""")
def exact_digest_anti(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return op.unseen(docs, table(spark, d, "harvest_records").where("text is not null"), F.col("text")).select("doc_id")


@P.query("""
with w as (select doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) w from documents where text is not null),
r as (select regexp_extract_all(lower(text), '([a-z0-9]+)', 1) w from harvest_records where lane = 'gutenberg' and text is not null),
exact as (select distinct doc_id from w where len(w) > 0 and array_to_string(w, ' ') in (select array_to_string(w, ' ') from r)),
runs as (select distinct array_to_string(list_slice(w, i, i + 11), ' ') s from r, unnest(generate_series(1, len(w) - 11)) t(i)),
near as (select distinct doc_id from w, unnest(generate_series(1, len(w) - 11)) t(i) where array_to_string(list_slice(w, i, i + 11), ' ') in (select s from runs))
select doc_id, 'exact' kind from exact union all select doc_id, 'shingle' from near where doc_id not in (select doc_id from exact)""")
def shingle_overlap_12(spark: SparkSession, d: str) -> DataFrame:
    reference = table(spark, d, "harvest_records").where("lane = 'gutenberg' and text is not null").select(F.col("text").alias("ref"))
    return op.overlap(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), reference, "doc_id", "text", "ref")


@P.query("select word, count(*) n from (select unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) word from documents) group by word")
def word_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return op.word_counts(table(spark, d, "documents"), "text")


@P.query(f"""
with t as (select source, unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) x from documents),
u as (select source, regexp_replace(x, '''s$', '') word from t),
c as (select source, word, count(*) n from u where length(word) >= 3 and word not like '%''%' and word not in ({_STOP}) group by 1, 2)
select * from (select source, word, n, row_number() over (partition by source order by n desc, word) as rank from c) where rank <= 25""")
def top_words_per_source(spark: SparkSession, d: str) -> DataFrame:
    return op.top_words(table(spark, d, "documents"), "text", "source", 25)


@P.query("""
with t as (select doc_id, unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) word from documents),
f as (select word, count(*) f from t group by word), n as (select sum(f) n from f)
select doc_id, round(avg(-ln((f + 1) / (n + 1))), 6) mean_rarity, round(max(-ln((f + 1) / (n + 1))), 6) max_rarity from t join f using (word), n group by doc_id""")
def rarity_features(spark: SparkSession, d: str) -> DataFrame:
    rows = op.rarity(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return rows.select("doc_id", F.round("mean_rarity", 6).alias("mean_rarity"), F.round("max_rarity", 6).alias("max_rarity"))


@P.query("""
select coalesce(lang, '(null)') lang, count(*) n, count(*) filter (record_kind is not null) labelled,
  count(*) filter (record_kind in ('joke', 'proverb', 'caption')) specific, round(avg(case when record_kind in ('joke', 'proverb', 'caption') then 1.0 else 0.0 end), 9) share
from documents group by 1""")
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    specific = F.coalesce(F.col("record_kind").isin("joke", "proverb", "caption"), F.lit(False))
    return table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("(null)")).alias("lang")).agg(
        F.count("*").alias("n"), F.count_if(F.col("record_kind").isNotNull()).alias("labelled"), F.count_if(specific).alias("specific"),
        F.round(F.avg(specific.cast("double")), 9).alias("share"),
    )


@P.query("""
select coalesce(lang, '(null)') lang, count(*) filter (record_kind = 'joke') joke, count(*) filter (record_kind = 'quote') quote, count(*) filter (record_kind = 'anecdote') anecdote,
  count(*) filter (record_kind = 'monologue') monologue from documents group by 1""")
def kind_crosstab(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["joke", "quote", "anecdote", "monologue"]
    counts = table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("(null)")).alias("lang")).pivot("record_kind", kinds).agg(F.count(F.lit(1)))
    return counts.fillna(0, kinds)


@P.query("""
select key, record_id, lane, harvested_at from (
  select substr(sha256(trim(text)), 1, 16) as key, record_id, lane, harvested_at,
    row_number() over (partition by substr(sha256(trim(text)), 1, 16) order by harvested_at desc nulls last, record_id desc) r from harvest_records where text is not null)
where r = 1""")
def latest_record_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("text is not null").select(F.substring(F.sha2(F.trim("text"), 256), 1, 16).alias("key"), "record_id", "lane", "harvested_at")
    return op.latest_wins(rows, ["key"], F.col("harvested_at"), F.col("record_id")).select("key", "record_id", "lane", "harvested_at")


@P.query(f"""
select record_id, lane from (
  select record_id, lane, row_number() over (partition by {_NORM.format('text')} order by file, line_no) r from harvest_records where text is not null) where r = 1""")
def first_record_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("text is not null").select("record_id", "lane", tx.norm_text(F.col("text")).alias("k"), "file", "line_no")
    first = rows.groupBy("k").agg(F.min_by(F.struct("record_id", "lane"), F.struct("file", "line_no")).alias("r"))
    return first.select("r.record_id", "r.lane")


_FOLD = "cast(('0x' || substr(sha256({0}), 1, 8)) as bigint) % 10"


@P.query(f"""
with s as (select {_NORM.format('text')} g, case when {_FOLD.format("source || ':' || cast(doc_id as varchar)")} = 8 then 'dev' when {_FOLD.format("source || ':' || cast(doc_id as varchar)")} = 9 then 'test' else 'train' end split
  from documents where text is not null and source is not null),
e as (select g, count(distinct split) s from s group by g)
select count(*) as groups, count(*) filter (s > 1) leaking from e""")
def split_leak_audit(spark: SparkSession, d: str) -> DataFrame:
    fold = F.conv(F.substring(F.sha2(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 10
    rows = table(spark, d, "documents").where("text is not null and source is not null").withColumn("split", F.when(fold == 8, "dev").when(fold == 9, "test").otherwise("train"))
    return op.split_leaks(rows, tx.norm_text(F.col("text")), "split")


@P.query(r"""
with s as (select source, [least(floor(len(regexp_extract_all(text, '([\p{L}\p{N}_]+)', 1)) / 5), 20), least(floor(length(text) / 30), 20),
   length(text) - length(replace(text, '.', '')), length(text) - length(replace(text, ',', '')), length(text) - length(replace(text, ':', ''))] g from documents where text is not null),
c as (select source, g, count(*) c from s group by all), b as (select g, max(c) t, sum(c) n from c group by g)
select cast(sum(n) as bigint) n, round(sum(t) / sum(n), 9) majority from b""")
def surface_signature_majority(spark: SparkSession, d: str) -> DataFrame:
    """How often the commonest source of a text's shape is its source."""
    shaped = table(spark, d, "documents").where("text is not null").select("source", tx.surface_signature(F.col("text")).alias("shape"))
    rows = op.majority_share(shaped, F.col("source"), "shape")
    return rows.withColumn("majority", F.round("majority", 9))


@P.query(r"""
with x as (select doc_id, text, source arm, lang premise, case when doc_id % 10 = 8 then 'validation' when doc_id % 10 = 9 then 'test' else 'train' end split, license from documents),
n as (select coalesce(array_to_string(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), ' '), '') t, count(*) c from x group by 1)
select 'rows_present' as check, (select count(*) from x) > 0 ok, (select count(*) from x) n
union all select 'unique_ids', count(*) = count(distinct doc_id), count(*) - count(distinct doc_id) from x
union all select 'unique_texts', sum(c) = count(*), cast(sum(c) - count(*) as bigint) from n
union all select 'balanced', max(c) = min(c), max(c) - min(c) from (select count(*) c from x group by arm)
union all select 'premise_isolation', count(*) = 0, count(*) from (select premise from x group by premise having count(distinct split) > 1)
union all select 'one_licence', count(distinct coalesce(license, '')) = 1, count(distinct coalesce(license, '')) from x
union all select 'no_links', count(*) filter (regexp_matches(text, '(?i)https?://|@[a-z0-9_]|\b(?:facebook|instagram|tiktok|youtube|twitter|reddit)\b')) = 0, count(*) filter (regexp_matches(text, '(?i)https?://|@[a-z0-9_]|\b(?:facebook|instagram|tiktok|youtube|twitter|reddit)\b')) from x""")
def release_audit(spark: SparkSession, d: str) -> DataFrame:
    from quipwright.operators import bundles

    rows = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("source").alias("arm"), F.col("lang").alias("premise"), scores.split_by_index(F.col("doc_id")).alias("split"), "license")
    return bundles.audit(rows, "item_id", "text", "split", balanced=["arm"], isolated=["premise"], single=["license"]).where("check <> 'shape_tells'")


@P.query("""
select doc_id, band, turn from (
  select doc_id, band, row_number() over (partition by band order by sha256(cast(doc_id as varchar)), doc_id) turn
  from (select doc_id, cast(floor(log2(1 + n_chars)) as int) band from documents where n_chars is not null))
order by turn, band limit 60""")
def stratified_round_robin(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars")
    return op.round_robin(docs, F.floor(F.log2(1 + F.col("n_chars"))).cast("int"), 60, F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").select("doc_id", "band", "turn")


@P.query("""
with r as (select doc_id, lang, row_number() over (order by doc_id) - 1 r, count(*) over () n from documents),
e as (select doc_id, lang, cast(r // greatest(1, n // 50) as int) i, count(*) over () m from r where r % greatest(1, n // 50) = 0 and r < greatest(1, n // 50) * 50)
select a.doc_id, a.lang, b.lang control from e a join e b on b.i = (a.i + 7) % a.m""")
def rotated_controls(spark: SparkSession, d: str) -> DataFrame:
    return op.rotated(table(spark, d, "documents"), "doc_id", "lang", 7, 50)


@P.query("""
with k as (select source from documents where source is not null group by source having count(*) >= 20)
select doc_id, source from documents where source in (select source from k)""")
def large_sources_only(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(docs.groupBy("source").agg(F.count("*").alias("n")).where("n >= 20"), "source", "left_semi").select("doc_id", "source")


@P.query(r"""
select record_id, count(*) n from (select record_id, unnest(string_split_regex(text, '(?:\r?\n)+| / ')) part from harvest_records where lane = 'wikiquote' and text is not null)
where length(trim(part)) between 20 and 400 group by record_id""")
def block_split(spark: SparkSession, d: str) -> DataFrame:
    from quipwright.sources.readers import blocks

    rows = table(spark, d, "harvest_records").where("lane = 'wikiquote' and text is not null").select("record_id", "text")
    return blocks(rows, "text", r"(?:\r?\n)+| / ", 20, 400).groupBy("record_id").agg(F.count("*").alias("n"))


@P.query("""
select f.file, f.n as declared, count(r.record_id) actual from harvest_files f left join harvest_records r using (file) where f.feed is null group by 1, 2
having f.n is distinct from count(r.record_id)""")
def wrong_file_counts(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "harvest_files").where("feed is null").select("file", F.col("n").alias("declared"))
    counts = table(spark, d, "harvest_records").groupBy("file").agg(F.count("*").alias("actual"))
    joined = files.join(counts, "file", "left").fillna(0, ["actual"])
    return joined.where(~F.col("declared").eqNullSafe(F.col("actual")))


@P.query("""
with h as (select sha256(cast(to_json({'p_name': p_name, 'p_partkey': p_partkey, 'p_size': p_size}) as varchar)) h from part),
s as (select count(*) as rows, """ + ", ".join(f"sum(cast(('0x' || substr(h, {1 + 8 * i}, 8)) as bigint)) s{i}" for i in range(4)) + """ from h)
select rows, sha256(concat_ws('-', s0, s1, s2, s3)) digest from s""")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    from quipwright.sources.sinks import wide_digest

    return wide_digest(table(spark, d, "part").select("p_name", "p_partkey", "p_size"))


@P.query(f"""
with n as (select {_NORM.format('text')} k, lane, record_id from harvest_records where text is not null and trim(text) <> ''),
f as (select k, lane, min(record_id) v from n group by 1, 2), r as (select *, row_number() over (partition by k order by lane) r from f)
select sha256(a.k) as key, a.lane first_group, a.v first_value, b.lane second_group, b.v second_value from r a join r b on a.k = b.k and a.r = 1 and b.r = 2""")
def same_text_across_lanes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("trim(text) <> ''").select(F.sha2(tx.norm_text(F.col("text")), 256).alias("key"), "lane", "record_id")
    return matching.across_groups(rows, "key", "lane", "record_id", "record_id")


@P.query(f"""
with u as (select k, min(lane) lane from (select {_NORM.format('text')} k, lane from harvest_records where text is not null) group by k having min(lane) = max(lane)),
m as (select source, lane from (select source, {_NORM.format('text')} k from harvest_records where source is not null and text is not null) join u using (k))
select source, min(lane) lane from m group by source having min(lane) = max(lane)""")
def unanimous_lane_of_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("text is not null").select("source", "lane", tx.norm_text(F.col("text")).alias("k"))
    return matching.unanimous(rows.select("k", "lane"), rows.where("source is not null").select("source", "k"), "k", "lane", "source")


@P.query("""
with g as (select h, r from unnest([100000.0, 200000.0, 300000.0, 400000.0, 600000.0]) a(h), unnest([1.0, 100.0, 1000.0, 5000.0]) b(r)),
p as (select h, r, count(*) filter (o_totalprice <= h and o_custkey >= r) i, count(*) n from g, orders where o_orderstatus = 'P' and o_custkey >= 100 group by 1, 2),
c as (select h, r, count(*) filter (o_totalprice <= h and o_custkey >= r) i, count(*) n from g, orders where o_orderstatus = 'F' and o_custkey < 50 group by 1, 2)
select h s_hi, r r_floor, p.i admitted, c.n rejected from p join c using (h, r) where p.i = p.n and c.i = 0""")
def feasible_thresholds(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderstatus", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    positives, controls = orders.where("o_orderstatus = 'P' and o_custkey >= 100"), orders.where("o_orderstatus = 'F' and o_custkey < 50")
    return matching.feasible_region(positives, controls, "o_totalprice", "o_custkey", [100000.0, 200000.0, 300000.0, 400000.0, 600000.0], [1.0, 100.0, 1000.0, 5000.0])


@P.query()
def either_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("lane = 'wq_multilang' and text is not null").select("record_id", F.coalesce("meta.language", F.lit("")).alias("language"), tx.norm_text(F.col("text")).alias("k"), F.coalesce("meta.translation_en", F.col("text")).alias("t"))
    return matching.neither_seen(rows, "language", "k", "t", "record_id").select("record_id", "language")
