"""Surface features of texts and of setup-punchline pairs, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quipwright.functions import text as tx


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def surface(c: Column) -> dict[str, Column]:
    """Counts and ratios of one text; a text without words has ratios of 0."""
    w = tx.words(c)
    n = F.size(w)
    letters = F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x))
    vowels = F.aggregate(w, F.lit(0), lambda s, x: s + F.greatest(F.lit(1), F.size(F.regexp_extract_all(x, F.lit("([aeiouy]+)"), 1))))
    initials = F.transform(w, lambda x: F.substring(x, 1, 1))
    one = F.greatest(F.lit(1), n)
    return {
        "n_chars": F.length(c), "n_words": n, "mean_word": F.round(letters / one, 9), "distinct_share": F.round(F.size(F.array_distinct(w)) / one, 9),
        "long_words": F.size(F.filter(w, lambda x: F.length(x) >= 7)), "vowel_groups": F.round(vowels / one, 9),
        "alliteration": F.round((n - F.size(F.array_distinct(initials))) / F.greatest(F.lit(1), n - 1), 9),
        "commas": _count(c, ","), "quotes": _count(c, "[\"“”]"), "questions": _count(c, r"\?"), "exclaims": _count(c, "!"), "digits": _count(c, "[0-9]"),
        "capitals": _count(c, "[A-Z]"), "ends_question": F.rtrim(c).endswith("?"),
    }


SURFACE_SQL = r"""
with s as (select {key} as k, {text} t, regexp_extract_all(lower({text}), '([a-z'']+)', 1) w from {table} {where})
select k as {key}, length(t) n_chars, len(w) n_words, round(length(array_to_string(w, '')) / greatest(1, len(w)), 9) mean_word, round(len(list_distinct(w)) / greatest(1, len(w)), 9) distinct_share,
  len(list_filter(w, lambda x: length(x) >= 7)) long_words,
  round(coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '([aeiouy]+)', 1))))), 0) / greatest(1, len(w)), 9) vowel_groups,
  round((len(w) - len(list_distinct(list_transform(w, lambda x: x[1:1])))) / greatest(1, len(w) - 1), 9) alliteration,
  len(regexp_extract_all(t, ',')) commas, len(regexp_extract_all(t, '["“”]')) quotes, len(regexp_extract_all(t, '\?')) questions, len(regexp_extract_all(t, '!')) exclaims,
  len(regexp_extract_all(t, '[0-9]')) digits, len(regexp_extract_all(t, '[A-Z]')) capitals, rtrim(t) like '%?' ends_question
from s"""


def pair(setup: Column, punchline: Column) -> dict[str, Column]:
    """How a punchline relates to its setup."""
    a, b = tx.words(setup), tx.words(punchline)
    shared = F.size(F.array_intersect(a, b))
    return {
        "setup_words": F.size(a), "punch_words": F.size(b), "punch_share": F.round(F.size(b) / F.greatest(F.lit(1), F.size(a) + F.size(b)), 9),
        "shared": shared, "jaccard": F.round(shared / F.greatest(F.lit(1), F.size(F.array_union(a, b))), 9),
    }


def _phonetic(words: Column, name: str) -> dict[str, Column]:
    n = F.size(words)
    initials = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.substring(w, 1, 1))
    vowels = F.regexp_replace(F.array_join(words, ""), "[^aeiouy]", "")
    most = F.greatest(*(F.length(vowels) - F.length(F.replace(vowels, F.lit(v), F.lit(""))) for v in "aeiouy"))
    return {
        f"{name}_alliteration": F.when(n > 1, (n - F.size(F.array_distinct(initials))) / (n - 1)).otherwise(0.0),
        f"{name}_assonance": F.when(F.length(vowels) > 1, most / F.length(vowels)).otherwise(0.0),
    }


def thirty(df: DataFrame, key: str, setup: str, punchline: str) -> DataFrame:
    """(key, 30 features) of setup-punchline pairs; rarities by the words of all pairs of ``df``.

    Null parts are empty texts. The frequencies are one aggregate over the exploded words, joined back.
    """
    base = df.select(F.col(key).alias("_k"), F.coalesce(setup, F.lit("")).alias("s"), F.coalesce(punchline, F.lit("")).alias("p"))
    base = base.withColumns({"sw": tx.words(F.col("s")), "pw": tx.words(F.col("p"))})
    s, p, sw, pw = (F.col(c) for c in ("s", "p", "sw", "pw"))
    both, every = F.concat(s, p), F.concat(sw, pw)
    syl = lambda w: F.aggregate(w, F.lit(0), lambda a, x: a + tx.syllables(x))
    chars = lambda w: F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    one = lambda c: F.greatest(F.lit(1), c)
    tail = lambda w: F.when(F.size(w) > 0, F.right(F.element_at(w, -1), F.lit(3))).otherwise("")
    cols = {
        "setup_chars": F.length(s), "punch_chars": F.length(p), "setup_words": F.size(sw), "punch_words": F.size(pw), "word_ratio": F.size(pw) / one(F.size(sw)),
        "setup_syllables": syl(sw), "punch_syllables": syl(pw), "syllable_ratio": syl(pw) / one(syl(sw)), "punch_syl_per_word": syl(pw) / one(F.size(pw)),
        "setup_mean_wordlen": chars(sw) / one(F.size(sw)), "punch_mean_wordlen": chars(pw) / one(F.size(pw)),
        "sentences": _count(F.concat_ws(" ", s, p), "[.!?]+"), "questions": _count(both, r"\?"), "exclaims": _count(both, "!"), "quotes": _count(both, "[\"']"), "digits": _count(both, r"\p{Nd}"),
        "caps_words": F.size(F.filter(F.split(F.concat_ws(" ", s, p), r"\s+"), lambda w: w.rlike(r"^\p{Lu}"))),
        "type_token_ratio": F.size(F.array_distinct(every)) / one(F.size(every)), "echo_frac": F.size(F.array_intersect(pw, sw)) / one(F.size(F.array_distinct(pw))),
        **_phonetic(pw, "punch"), **_phonetic(every, "pair"), "end_rhyme": F.when((tail(sw) != "") & (tail(sw) == tail(pw)), 1.0).otherwise(0.0),
    }
    flat = base.select("_k", *(c.cast("double").alias(n) for n, c in cols.items()))
    tokens = base.select("_k", F.lit("setup").alias("b"), F.posexplode("sw").alias("i", "w")).union(base.select("_k", F.lit("punch").alias("b"), F.posexplode("pw").alias("i", "w")))
    freq = tokens.groupBy("w").agg(F.count("*").alias("f"))
    total = freq.agg(F.sum("f").alias("n"))
    value = tokens.join(freq, "w").crossJoin(F.broadcast(total)).withColumn("v", -F.ln((F.col("f") + 1) / (F.col("n") + 1)))  # total: one row
    agg = []
    for b in ("punch", "setup"):
        v = F.when(F.col("b") == b, F.col("v"))
        agg += [F.avg(v).alias(f"{b}_rarity_mean"), F.max(v).alias(f"{b}_rarity_max"), F.max_by("v", F.when(F.col("b") == b, F.col("i"))).alias(f"{b}_rarity_final")]
    out = flat.join(value.groupBy("_k").agg(*agg), "_k", "left").fillna(0.0)
    return out.select(F.col("_k").alias(key), *(c for c in out.columns if c != "_k"))


_BARE = "trim(x, '''')"
_GROUPS = f"len(regexp_extract_all({_BARE}, '[aeiouy]+'))"
_SYL = (
    f"case when {_BARE} = '' then 0 else greatest(1, {_GROUPS} - case when {_BARE} like '%e' and not regexp_matches({_BARE}, '(le|ee|ye)$') and {_GROUPS} > 1 then 1 else 0 end"
    f" + case when regexp_matches({_BARE}, '[^aeiouy]le$') then 1 else 0 end) end"
)


def _sum(w: str, what: str) -> str:
    return f"coalesce(list_sum(list_transform({w}, lambda x: {what})), 0)"


def _phonetic_sql(w: str, name: str) -> str:
    v = f"regexp_replace(array_to_string({w}, ''), '[^aeiouy]', '', 'g')"
    most = ", ".join(f"length({v}) - length(replace({v}, '{c}', ''))" for c in "aeiouy")
    return (
        f"round(case when len({w}) > 1 then (len({w}) - len(list_distinct(list_transform({w}, lambda x: x[1:1])))) / (len({w}) - 1) else 0 end, 6) {name}_alliteration, "
        f"round(case when length({v}) > 1 then greatest({most}) / length({v}) else 0 end, 6) {name}_assonance"
    )


THIRTY_SQL = rf"""
with r as (select record_id, meta.setup s, meta.punchline p, regexp_extract_all(lower(meta.setup), '([a-z'']+)', 1) sw, regexp_extract_all(lower(meta.punchline), '([a-z'']+)', 1) pw
  from harvest_records where lane = 'jokeapi' and meta.setup is not null and meta.punchline is not null),
t as (select record_id, 'setup' b, unnest(sw) w, unnest(generate_series(1, len(sw))) i from r union all select record_id, 'punch', unnest(pw), unnest(generate_series(1, len(pw))) from r),
f as (select w, count(*) f from t group by w), n as (select sum(f) n from f),
v as (select record_id, b, i, -ln((f + 1) / (n + 1)) v from t join f using (w), n),
a as (select record_id, avg(v) filter (b = 'punch') pm, max(v) filter (b = 'punch') px, arg_max(v, i) filter (b = 'punch') pf, avg(v) filter (b = 'setup') sm, max(v) filter (b = 'setup') sx, arg_max(v, i) filter (b = 'setup') sf from v group by 1),
y as (select *, {_sum('sw', _SYL)} ss, {_sum('pw', _SYL)} ps, list_concat(sw, pw) aw, s || p sp from r)
select record_id, length(s) * 1.0 setup_chars, length(p) * 1.0 punch_chars, len(sw) * 1.0 setup_words, len(pw) * 1.0 punch_words, round(len(pw) / greatest(1, len(sw)), 6) word_ratio, ss * 1.0 setup_syllables, ps * 1.0 punch_syllables,
  round(ps / greatest(1, ss), 6) syllable_ratio, round(ps / greatest(1, len(pw)), 6) punch_syl_per_word, round({_sum('sw', 'length(x)')} / greatest(1, len(sw)), 6) setup_mean_wordlen,
  round({_sum('pw', 'length(x)')} / greatest(1, len(pw)), 6) punch_mean_wordlen, len(regexp_extract_all(s || ' ' || p, '[.!?]+')) * 1.0 sentences, len(regexp_extract_all(sp, '\?')) * 1.0 questions,
  len(regexp_extract_all(sp, '!')) * 1.0 exclaims, len(regexp_extract_all(sp, '["'']')) * 1.0 quotes, len(regexp_extract_all(sp, '\p{{Nd}}')) * 1.0 digits,
  len(list_filter(string_split_regex(s || ' ' || p, '\s+'), lambda x: regexp_matches(x, '^\p{{Lu}}'))) * 1.0 caps_words, round(len(list_distinct(aw)) / greatest(1, len(aw)), 6) type_token_ratio,
  round(len(list_intersect(list_distinct(pw), list_distinct(sw))) / greatest(1, len(list_distinct(pw))), 6) echo_frac, {_phonetic_sql('pw', 'punch')}, {_phonetic_sql('aw', 'pair')},
  case when len(sw) > 0 and right(sw[-1], 3) = right(pw[-1], 3) then 1.0 else 0.0 end end_rhyme,
  round(coalesce(pm, 0), 6) punch_rarity_mean, round(coalesce(px, 0), 6) punch_rarity_max, round(coalesce(pf, 0), 6) punch_rarity_final, round(coalesce(sm, 0), 6) setup_rarity_mean, round(coalesce(sx, 0), 6) setup_rarity_max,
  round(coalesce(sf, 0), 6) setup_rarity_final
from y left join a using (record_id)"""
