"""Text queries: keys, features, splits, edits and rule labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quipwright.functions import features, text as tx
from quipwright.operators.labels import DOMAINS, FORMS, GENERIC, QUESTION, coverage, label
from quipwright.plans.base import Plans
from quipwright.session import table

P = Plans()
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@P.query(r"""
select record_id, sha256(lower(trim(regexp_replace(translate(text, '’‘“”', '''''""'), '\s+', ' ', 'g')))) text_key,
  regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') letters, substr(sha256(lane || chr(31) || text), 1, 20) digest
from harvest_records where lane = 'jokeapi' and text is not null""")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("lane = 'jokeapi' and text is not null")
    c = F.col("text")
    return rows.select("record_id", F.sha2(tx.norm_text(c), 256).alias("text_key"), tx.norm_key(c).alias("letters"), tx.digest(F.col("lane"), c).alias("digest"))


@P.query(features.SURFACE_SQL.format(table="harvest_records", key="record_id", text="text", where="where lane = 'icanhazdadjoke' and text is not null"))
def surface_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("lane = 'icanhazdadjoke' and text is not null")
    return rows.select("record_id", *[c.alias(n) for n, c in features.surface(F.col("text")).items()])


@P.query(r"""
with s as (select record_id, regexp_extract_all(lower(meta.setup), '([a-z'']+)', 1) a, regexp_extract_all(lower(meta.punchline), '([a-z'']+)', 1) b
  from harvest_records where lane = 'jokeapi' and meta.setup is not null and meta.punchline is not null)
select record_id, len(a) setup_words, len(b) punch_words, round(len(b) / greatest(1, len(a) + len(b)), 9) punch_share,
  len(list_intersect(list_distinct(a), list_distinct(b))) shared,
  round(len(list_intersect(list_distinct(a), list_distinct(b))) / greatest(1, len(list_distinct(list_concat(a, b)))), 9) jaccard
from s""")
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("lane = 'jokeapi' and meta.setup is not null and meta.punchline is not null")
    return rows.select("record_id", *[c.alias(n) for n, c in features.pair(F.col("meta.setup"), F.col("meta.punchline")).items()])


@P.query(features.THIRTY_SQL)
def thirty_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("lane = 'jokeapi' and meta.setup is not null and meta.punchline is not null")
    scored = features.thirty(rows.select("record_id", F.col("meta.setup").alias("setup"), F.col("meta.punchline").alias("punchline")), "record_id", "setup", "punchline")
    return scored.select("record_id", *(F.round(c, 6).alias(c) for c in scored.columns if c != "record_id"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").rlike(r"^[0-9A-Za-z_]+")).select("doc_id", F.regexp_replace("text", r"^([0-9A-Za-z_]+)", "<$1/>").alias("t"))


@P.query(r"""
with m as (select doc_id, regexp_replace(text, '^(\w+)', '<\1/>') t from documents where regexp_matches(text, '^\w+'))
select doc_id, regexp_extract(t, '<([^/>]*)/>', 1) original, regexp_replace(t, '<[^/>]*/>', 'Umbrella') edited, regexp_replace(t, '<([^/>]*)/>', '\1') restored from m""")
def marker_edits(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _marked(spark, d).select("doc_id", tx.marked_word(t).alias("original"), tx.apply_edit(t, F.lit("Umbrella")).alias("edited"), tx.unmark(t).alias("restored"))


@P.query(r"""
with w as (select record_id, string_split_regex(trim(text), '\s+') w from harvest_records where lane = 'jokeapi' and trim(text) <> '')
select record_id, array_to_string(w[1:greatest(1, cast(floor(len(w) * 0.5) as int))], ' ') half, array_to_string(w[1:greatest(1, cast(floor(len(w) * 0.7) as int))], ' ') most from w""")
def dose_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("lane = 'jokeapi' and trim(text) <> ''")
    return rows.select("record_id", tx.dose(F.col("text"), 0.5).alias("half"), tx.dose(F.col("text"), 0.7).alias("most"))


def _split_sql() -> str:
    cases = []
    for mark in tx.SEPARATORS:
        m, size = mark.replace("\n", "' || chr(10) || '"), len(mark)
        tail = f"string_split(t, '{m}')[-1]"
        cases.append((f"contains(t, '{m}') and regexp_matches(trim({tail}), '\\S\\s+\\S')", f"substr(t, 1, length(t) - length({tail}) - {size}) || '{mark.strip()}'", f"trim({tail})"))
    at = "greatest(1, cast(floor(len(w) * 0.7) as int))"
    pick = lambda i, other: "case " + " ".join(f"when {c[0]} then {c[i]}" for c in cases) + f" else {other} end"
    return f"""with t as (select record_id, trim(text) t, string_split_regex(trim(text), '\\s+') w from harvest_records where lane = 'icanhazdadjoke' and trim(text) <> '')
select record_id, {pick(1, f"array_to_string(w[1:{at}], ' ')")} setup, {pick(2, f"array_to_string(w[{at} + 1:], ' ')")} punchline from t"""


@P.query(_split_sql())
def setup_punchline_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("lane = 'icanhazdadjoke' and trim(text) <> ''")
    return rows.select("record_id", tx.split_pair(F.col("text")).alias("p")).select("record_id", "p.setup", "p.punchline")


def _re2(pattern: str) -> str:
    """A pattern for DuckDB: its word borders know no other alphabets, and it cannot look ahead."""
    if not pattern.isascii():
        pattern = pattern.replace(r"\b", "")
    return pattern.replace(r"(so\s+(?!\w+ly\b)|such\b|like\b)", r"(so\s+(\w*\b[^\w]|\w*[^l\W]y\b|\w*[^y\W]\b)|such\b|like\b)").replace("'", "''")


def _count(words: tuple[str, ...]) -> str:
    return rf"len(regexp_extract_all(lower(raw), '\b({'|'.join(words)})\b'))"


_HITS = ", ".join(f"case when regexp_matches(t, '(?i){_re2(p)}') then '{n}' end" for n, p in FORMS.items())
_COUNTS = ", ".join(f"{{'c': -{_count(w)}, 'd': '{d}'}}" for d, w in DOMAINS.items())
_FORM_SQL = rf"""
with x as (select record_id, coalesce(text, '') raw, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) t, coalesce(meta.setup <> '' and meta.punchline <> '', false) two, meta.language lang from harvest_records where lane in ('icanhazdadjoke', 'jokeapi')),
h as (select *, list_filter([{_HITS}], lambda x: x is not null) hits, list_sort(list_filter([{_COUNTS}], lambda x: x.c < 0)) counts from x),
f as (select *, case when len(hits) > 0 then hits[1] when length(t) > 900 then 'shaggy_dog' when regexp_matches(t, '(?i){QUESTION}') and (two or contains(t, '?') and not ends_with(t, '?')) then 'q_and_a' when two then 'setup_punchline'
  when length(t) <= 240 and not contains(t, '?') and length(t) - length(replace(t, '.', '')) <= 2 then 'one_liner' else 'unknown' end form from h)
"""


@P.query(_FORM_SQL + """
select record_id, form, case when len(hits) > 0 then array_to_string(hits, ',') when form = 'unknown' then '' else form end all_forms, coalesce(counts[1].d, 'general') as domain, array_to_string(list_transform(counts, lambda c: c.d), ',') all_domains,
  coalesce(-counts[1].c, 0) hits from f""")
def form_and_domain(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled(spark, d)
    return rows.select("record_id", "form", F.array_join("all_forms", ",").alias("all_forms"), "domain", F.array_join("all_domains", ",").alias("all_domains"), "hits")


@P.query(_FORM_SQL + f"""
select coalesce(lang, 'unknown') as language, count(*) n, count(*) filter (form <> 'unknown') labelled, round(avg(case when form <> 'unknown' then 1.0 else 0 end), 3) share,
  count(*) filter (form not in ('unknown', {', '.join(repr(g) for g in GENERIC)})) specific, round(avg(case when form not in ('unknown', {', '.join(repr(g) for g in GENERIC)}) then 1.0 else 0 end), 3) specific_share from f group by 1""")
def form_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage(_labelled(spark, d), "language")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("lane in ('icanhazdadjoke', 'jokeapi')")
    flat = rows.select("record_id", "text", F.col("meta.setup").alias("setup"), F.col("meta.punchline").alias("punchline"), F.col("meta.language").alias("language"))
    return label(flat, "text", "setup", "punchline")


@P.query(r"""
with w as (select unnest(regexp_extract_all(text, '([0-9A-Za-z]+)', 1)) w from documents)
select case when lower(w) in (""" + _STOP + r""") then 'function' when regexp_matches(w, '^[0-9]') then 'number' when regexp_matches(w, '^[A-Z]') then 'name'
  when lower(w) like '%ly' and length(w) > 4 then 'adverb' when regexp_matches(lower(w), '(ing|ed|ise|ize)$') and length(w) > 4 then 'verb'
  when regexp_matches(lower(w), '(ous|ful|ive|able|al|ish|less)$') and length(w) > 4 then 'adjective' else 'noun' end pos, count(*) n, count(distinct lower(w)) kinds
from w group by 1""")
def parts_of_speech(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([0-9A-Za-z]+)"), 1)).alias("w"))
    return tokens.groupBy(tx.pos_guess(F.col("w")).alias("pos")).agg(F.count("*").alias("n"), F.count_distinct(F.lower("w")).alias("kinds"))


@P.query(r"""
with w as (select distinct unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) w from documents),
g as (select w, len(regexp_extract_all(w, '([aeiouy]+)', 1)) g, w like '%e' and not regexp_matches(w, '(le|ee|ye)$') s, regexp_matches(w, '[^aeiouy]le$') l, regexp_extract(regexp_replace(w, '([^aeiouy])e$', '\1'), '([aeiouy]+[^aeiouy]*)$', 1) rhyme from w)
select greatest(1, g - case when s and g > 1 then 1 else 0 end + case when l then 1 else 0 end) syllables, count(*) n, count(distinct rhyme) rhymes from g group by 1""")
def syllables_and_rhymes(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "documents").select(F.explode(tx.words(F.col("text"), "[a-z]+")).alias("w")).distinct()
    return kinds.groupBy(tx.syllables(F.col("w")).alias("syllables")).agg(F.count("*").alias("n"), F.count_distinct(tx.rhyme_key(F.col("w"))).alias("rhymes"))


@P.query("""
select coalesce(case lower(trim(l)) """ + " ".join(f"when '{k}' then '{v}'" for k, v in tx.LANGUAGE_NAMES.items()) + """ else replace(lower(trim(l)), '_', '-') end, '(null)') code, count(*) n
from (select meta.language l from harvest_records) group by 1""")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    code = F.coalesce(tx.language_code(F.col("meta.language")), F.lit("(null)"))
    return table(spark, d, "harvest_records").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@P.query(r"""
with r as (select record_id, meta.setup s, meta.punchline p from harvest_records where lane = 'jokeapi')
select count(*) rows_in, count(*) filter (s is null or p is null) dropped_present,
  count(*) filter (s is not null and p is not null and not (length(s) between 8 and 300 and length(p) between 2 and 200)) dropped_length,
  count(*) filter (s is not null and p is not null and length(s) between 8 and 300 and length(p) between 2 and 200 and contains(s, p)) dropped_contained,
  count(*) filter (s is not null and p is not null and length(s) between 8 and 300 and length(p) between 2 and 200 and not contains(s, p)) rows_kept from r""")
def pair_screens(spark: SparkSession, d: str) -> DataFrame:
    from quipwright.operators.corpus import staged_screens

    s, p = F.col("meta.setup"), F.col("meta.punchline")
    stages = {"present": s.isNotNull() & p.isNotNull(), "length": F.length(s).between(8, 300) & F.length(p).between(2, 200), "contained": ~s.contains(p)}
    return staged_screens(table(spark, d, "harvest_records").where("lane = 'jokeapi'"), stages)


@P.query()
def offline_signals(spark: SparkSession, d: str) -> DataFrame:
    """Surprisal of punchlines with and without the setup, and the scores built on both."""
    from quipwright.functions import signals as sg

    rows = table(spark, d, "harvest_records").where("lane = 'jokeapi' and meta.setup is not null and meta.punchline is not null")
    s, p = F.col("meta.setup"), F.col("meta.punchline")
    costs = rows.select("record_id", sg.offline_profile(F.lit(""), p).alias("bare"), sg.offline_profile(s, p).alias("framed"), sg.leak_share(s, F.lit(""), p).alias("leak"))
    means = costs.select("record_id", "leak", sg.mean_cost(F.col("bare")).alias("mean"), sg.peak_cost(F.col("bare")).alias("peak"), (sg.mean_cost(F.col("bare")) - sg.mean_cost(F.col("framed"))).alias("resolution"), F.size("bare.tokens").alias("n"))
    m, r = F.col("mean"), F.greatest(F.lit(0.0), F.col("resolution"))
    e = F.coalesce(F.try_divide(r, "n"), F.lit(0.0))
    return means.select("record_id", "mean", "peak", "leak", r.alias("resolution"), sg.laugh_score(m, r, e, F.lit(0.0)).alias("score"), sg.failure_mode(m, r, e, F.lit(0.0)).alias("failure"))
