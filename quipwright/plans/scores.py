"""Composite scores, styles, reply parsing and item texts over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quipwright.functions import scores as sc
from quipwright.operators import bundles, validate
from quipwright.plans.base import Plans
from quipwright.session import table

P = Plans()


@P.query("""
select event_id, round(greatest(-10, least(10, case event_type when 'click' then 1.4 when 'view' then 0.7 when 'purchase' then 1.0 when 'signup' then -1.2 else -0.8 end * round(value) / 10)), 2) response,
  round(least(1.0, least(1.0, round(value) / 31 / 3.0) * 0.9 + least(0.2, 0.02 * (user_id % 15))), 3) reward from events""")
def response_scores(spark: SparkSession, d: str) -> DataFrame:
    """Events read as reactions of a room."""
    e, v = F.col("event_type"), F.round("value") / 10
    kinds = {"laughter_seconds": e == "click", "smile_level": e == "view", "applause_level": e == "purchase", "groan_level": e == "signup", "silence_seconds": ~e.isin("click", "view", "purchase", "signup")}
    rows = table(spark, d, "events")
    return rows.select("event_id", sc.response_score(**{k: F.when(c, v) for k, c in kinds.items()}).alias("response"), sc.laughter_reward(F.round("value") / 31, F.col("user_id") % 15).alias("reward"))


_TENTHS = "cast(greatest(0, least(10, round_even({}, 0))) as int)"


@P.query(f"""
with v as (select l_orderkey, l_linenumber, {_TENTHS.format('l_quantity / 5')} a, {_TENTHS.format('l_discount * 100')} b, {_TENTHS.format('l_tax * 125')} c, {_TENTHS.format('l_suppkey % 11')} r from lineitem)
select l_orderkey, l_linenumber, round((a + b + c + a + b + c + 7) / 7.0 - 0.75 * r, 2) total, round(case when r > 9 then 0 else a * greatest(0, 1 - b / 2.93 / 10.0) * greatest(0, 1 - c / 7.37 / 10.0) * greatest(0, least(1, 0.5 + (r - 5) / 11.71)) end, 1) offramp,
  round(case when c > 8 then 0 else a * greatest(0, 1 - b / 2.93 / 10.0) end, 3) callback from v""")
def panel_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", sc.tenths(F.col("l_quantity") / 5).alias("a"), sc.tenths(F.col("l_discount") * 100).alias("b"), sc.tenths((F.col("l_tax") * 125)).alias("c"), sc.tenths(F.col("l_suppkey") % 11).alias("r")
    )
    a, b, c, r = (F.col(x) for x in "abcr")
    parts = dict(zip(sc.MERITS, (a, b, c, a, b, c, F.lit(7)))) | {sc.RISK: r}
    flags = F.when(r > 9, F.array(F.lit("flag"))).otherwise(F.array().cast("array<string>"))
    off = sc.offramp_score(a, b / 2.93, c / 7.37, (r - 5) / 11.71, flags)
    return rows.select("l_orderkey", "l_linenumber", sc.panel_total(parts).alias("total"), off.alias("offramp"), sc.callback_score(a.cast("double"), b / 2.93, F.when(c > 8, "quoted")).alias("callback"))


_AXIS = "case when {} then 8.0 when not any_ then {} else 0.0 end"


def _style_sql() -> str:
    tests = {a: "(" + " or ".join(f"contains(low, '{t}')" for t in terms) + ")" for a, terms in sc.STYLE_TERMS.items()}
    any_ = " or ".join(tests.values())
    cells = ", ".join(_AXIS.format(t, sc.ASSUMED.get(a, 0.0)) for a, t in tests.items())
    return f"with t as (select doc_id, lower(coalesce(text, '')) low from documents), a as (select *, {any_} any_ from t), s as (select doc_id, [{cells}] s from a), "


_INDEX = {a: i + 1 for i, a in enumerate(sc.AXES)}


@P.query(_style_sql() + f"""
n as (select s.doc_id, s.s, p.s t from s join s p on p.doc_id = s.doc_id + 1),
r as (select *, sqrt(list_sum(list_transform(list_zip(s, t), lambda x: (x[1] - x[2]) ** 2))) / sqrt({len(sc.AXES)}) far from n)
select doc_id, round(far, 3) distance, round(greatest(0, least(10, far * 0.9 + 7 * 0.45 + 5 * 0.35 - 3 * 0.55)), 3) risk, case when round(greatest(0, least(10, far * 0.9 + 3.25)), 3) >= 7 then 'high' when round(greatest(0, least(10, far * 0.9 + 3.25)), 3) >= 4 then 'medium' else 'low' end as level,
  coalesce(nullif(array_to_string(list_filter([case when t[{_INDEX['political']}] - s[{_INDEX['political']}] >= 4 then 'repositioning' end, case when t[{_INDEX['aggressive']}] - s[{_INDEX['aggressive']}] >= 4 then 'trust' end,
    case when t[{_INDEX['blue']}] - s[{_INDEX['blue']}] >= 4 or t[{_INDEX['dark']}] - s[{_INDEX['dark']}] >= 4 then 'threat' end, case when t[{_INDEX['absurdist']}] - s[{_INDEX['absurdist']}] >= 4 and s[{_INDEX['observational']}] >= 6 then 'recognition' end], lambda x: x is not null), ','), ''), 'weak_bridge') failures from r""")
def style_shifts(spark: SparkSession, d: str) -> DataFrame:
    """What every document's style is against that of the next."""
    styled = table(spark, d, "documents").select("doc_id", sc.style_of(F.col("text")).alias("s"))
    pairs = styled.join(styled.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t")), "doc_id").withColumn("x", sc.style_shift(F.col("s"), F.col("t")))
    return pairs.select("doc_id", "x.distance", "x.risk", "x.level", F.array_join("x.failures", ",").alias("failures"))


@P.query(r"""
with w as (select record_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') w from harvest_records where lane = 'icanhazdadjoke' and trim(text) <> ''),
c as (select *, greatest(1, cast(floor(len(w) * 0.4) as int)) n from w)
select record_id, array_to_string(w[1:n], ' ') setup, array_to_string(w[n + 1:], ' ') punchline, case when record_id % 10 = 8 then 'validation' when record_id % 10 = 9 then 'test' else 'train' end split from c""")
def share_cuts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where(r"lane = 'icanhazdadjoke' and trim(text) <> ''")
    return rows.select("record_id", sc.share_cut(F.col("text")).alias("c"), sc.split_by_index(F.col("record_id")).alias("split")).select("record_id", "c.setup", "c.punchline", "split")


@P.query(r"""
with r as (select record_id, concat('{"jokes": ["', replace(meta.setup, '"', ''''), '", " ', replace(meta.punchline, '"', ''''), ' ", "', upper(replace(meta.setup, '"', '''')), '"]}') as reply, replace(meta.setup, '"', '''') s, replace(meta.punchline, '"', '''') p
  from harvest_records where lane = 'jokeapi' and meta.setup is not null and meta.punchline is not null and not contains(meta.setup, '\') and not contains(meta.punchline, '\')),
n as (select record_id, trim(regexp_replace(s, '\s+', ' ', 'g')) s, trim(regexp_replace(p, '\s+', ' ', 'g')) p from r)
select record_id, case when s = '' and p = '' then 0 when s = '' or p = '' or lower(s) = lower(p) then 1 else 2 end n, case when s <> '' then s else p end as first from n""")
def reply_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of records, prose around the JSON, parsed again."""
    rows = table(spark, d, "harvest_records").where("lane = 'jokeapi' and meta.setup is not null and meta.punchline is not null").where("instr(meta.setup, '\\\\') = 0 and instr(meta.punchline, '\\\\') = 0")
    clean = lambda c: F.replace(F.col(c), F.lit('"'), F.lit("'"))
    reply = F.concat(F.lit('Here they are: {"jokes": ["'), clean("meta.setup"), F.lit('", " '), clean("meta.punchline"), F.lit(' ", "'), F.upper(clean("meta.setup")), F.lit('"]} Enjoy.'))
    found = rows.select("record_id", sc.candidates(reply).alias("c"))
    return found.select("record_id", F.size("c").cast("long").alias("n"), F.coalesce(F.get("c", F.lit(0)), F.lit("")).alias("first"))


@P.query("""
select record_id, concat_ws(':', coalesce(source, ''), coalesce(meta.api_id, '')) stable_id, array_to_string(list_filter([text, meta.setup, meta.punchline, meta.category, meta.language], lambda x: x is not null and x <> ''), ' ') searchable,
  coalesce(nullif(meta.translation_en, ''), nullif(meta.punchline, '')) first_filled from harvest_records where lane in ('jokeapi', 'wq_multilang')""")
def item_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "harvest_records").where("lane in ('jokeapi', 'wq_multilang')")
    none = F.array().cast("array<struct<signal_type:string,audience_segment:string,notes:string>>")
    fields = [F.col(c) for c in ("text", "meta.setup", "meta.punchline", "meta.category", "meta.language")]
    meta = F.create_map(F.lit("translation_en"), F.col("meta.translation_en"), F.lit("gold"), F.col("meta.punchline"))
    return rows.select(
        "record_id", sc.stable_id(F.col("source"), F.col("meta.api_id")).alias("stable_id"), sc.searchable(fields, F.array().cast("array<string>"), none).alias("searchable"), sc.first_filled(meta, ("translation_en", "gold")).alias("first_filled")
    )


@P.query("""
with a as (select item, judge_id, key, value from (select item, judge_id, unnest(map_keys(scores)) as key, unnest(map_values(scores)) as value from panel_votes where scores is not null and item is not null)),
m as (select key, round(avg(value), 6) v from a group by key)
select key, v mean, case when v >= 0 then 'up' else 'down' end as pole from m""")
def axis_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "panel_votes").where("scores is not null and item is not null").select(F.explode("scores").alias("key", "value"))
    return rows.groupBy("key").agg(F.round(F.avg("value"), 6).alias("mean")).withColumn("pole", F.when(F.col("mean") >= 0, "up").otherwise("down"))


@P.query("""
select 'no_price' problem, count(*) n, min(cast(l_orderkey as varchar)) as first from lineitem where not (l_extendedprice between 1000 and 100000) having count(*) > 0
union all select 'odd_quantity', count(*), min(cast(l_orderkey as varchar)) from lineitem where not (l_quantity between 1 and 49 and l_quantity = floor(l_quantity)) having count(*) > 0
union all select 'repeated_id', count(*), min(id) from (select id from solution where id is not null group by id having count(*) > 1) having count(*) > 0""")
def bundle_problems(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
    found = bundles.listed(lines, "l_orderkey", {"no_price": bundles.number_in(F.col("l_extendedprice"), 1000, 100000), "odd_quantity": bundles.number_in(F.col("l_quantity"), 1, 49, whole=True)})
    return bundles.summary(found.union(bundles.repeated(table(spark, d, "solution").where("id is not null"), "id", "repeated_id")))


@P.query("""
with f as (select line, try_cast(line as json) j from harvest_raw),
k as (select line, unnest(json_keys(j)) as key from f where j is not null and json_type(j) = 'OBJECT')
select key field, count(*) n from k where key not in ('text', 'meta', 'source', 'license') group by key""")
def unexpected_fields(spark: SparkSession, d: str) -> DataFrame:
    """Top-level fields of the raw lines outside a closed schema."""
    rows = table(spark, d, "harvest_raw").where(F.try_parse_json("line").isNotNull())
    found = bundles.closed(rows.withColumn("k", F.monotonically_increasing_id()), "k", "line", ["text", "meta", "source", "license"], ())
    return found.where("problem like 'unexpected:%'").groupBy(F.substring("problem", 12, 1000).alias("field")).agg(F.count("*").alias("n"))
