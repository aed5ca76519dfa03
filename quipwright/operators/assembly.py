"""Assembling study inputs: graded pairs, screened candidates, timed scripts, gaps between demand and supply, ranked catalogues, and sets on disk."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quipwright.functions import scores as sc, style as st, text as tx
from quipwright.operators import ranks, studies, validate
from quipwright.sources import sinks

# Seconds of a beat at least, words a second, the hold after a turn, the pause between beats.
LEAST_BEAT, WORDS_A_SECOND, HOLD, PAUSE = 1.2, 2.6, 0.8, 0.4


def graded_pairs(df: DataFrame, key: str, text: str, edits: tuple[str, str], grades: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(singles, pairs) of marked texts with two graded edits each.

    singles (key, side, setup, punchline, grade): both edits cut at the mark. pairs (key, winner): which is graded
    higher; ties carry no preference and are left out, as is a text without a mark or with a null grade.
    """
    side = lambda n, i: F.struct(F.lit(n).alias("side"), sc.edit_cut(F.col(text), F.col(edits[i])).alias("cut"), F.col(grades[i]).cast("double").alias("grade"))
    both = df.select(key, F.inline(F.array(side("a", 0), side("b", 1)))).where("cut is not null and grade is not null")
    singles = both.select(key, "side", "cut.setup", "cut.punchline", "grade")
    a, b = (F.col(g).cast("double") for g in grades)
    pairs = df.where(F.col(text).rlike("<[^/>]+/>") & (F.abs(a - b) > 1e-9)).select(key, F.when(a > b, "a").otherwise("b").alias("winner"))
    return singles, pairs


def screened_candidates(df: DataFrame, setup: str, punchline: str, group: str, least: int, order: str) -> DataFrame:
    """Rows whose parts pass ``screen_pair``, the first by ``order`` of every pair that differs in case alone, of groups that keep ``least`` of them."""
    good = df.where(F.col(group).isNotNull() & tx.screen_pair(F.trim(setup), F.trim(punchline)))
    keyed = good.withColumn("key", F.sha2(F.lower(F.concat_ws("\x1f", F.trim(setup), F.trim(punchline))), 256))
    rest = [c for c in keyed.columns if c != "key"]
    first = keyed.groupBy("key").agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select("key", "r.*")
    large = first.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(group)
    return first.join(large, group, "left_semi")


def timed_beats(df: DataFrame, key: str, script: str) -> DataFrame:
    """(key, position, beat, said, visual, begins, ends) of scripts in lines of HOOK:, BUILD: and SNAP:, what is shown in brackets.

    A beat lasts as long as its words are spoken, at least LEAST_BEAT seconds, a turn (SNAP) HOLD longer; PAUSE parts beats.
    """
    lines = F.regexp_extract_all(F.col(script), F.lit(r"(?i)((?:HOOK|BUILD|SNAP)\s*:\s*.+)"), 1)
    rows = df.select(key, F.posexplode(lines).alias("position", "part"))
    body = F.regexp_replace("part", r"^\w+\s*:\s*", "")
    rows = rows.select(key, "position", F.upper(F.regexp_extract("part", r"^(\w+)", 1)).alias("beat"), F.trim(F.regexp_replace(body, r"\[.+?\]", "")).alias("said"), F.regexp_extract(body, r"\[(.+?)\]", 1).alias("visual"))
    words = F.when(F.col("said") == "", 0).otherwise(F.size(F.split("said", r"\s+")))
    lasts = F.greatest(F.lit(LEAST_BEAT), words / WORDS_A_SECOND) + F.when(F.col("beat") == "SNAP", HOLD).otherwise(0.0)
    before = F.coalesce(F.sum(F.col("_l") + PAUSE).over(W.partitionBy(key).orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    timed = rows.withColumn("_l", lasts).withColumn("_b", before)
    return timed.select(key, "position", "beat", "said", "visual", F.round("_b", 2).alias("begins"), F.round(F.col("_b") + F.col("_l"), 2).alias("ends"))


def segment_gaps(segments: DataFrame, suppliers: DataFrame, wanted: Column, top: int = 3) -> DataFrame:
    """(segment, gap, supply, closest): what a segment demands against what its ``top`` most alike suppliers offer.

    ``segments(segment, topics, audience, style, demand)`` and ``suppliers(name, topics, audiences, style, share)`` meet where
    they have a word of topic or audience in common: an equi-join on distinct words, not a comparison of all pairs.
    ``wanted`` is the style asked for. Ties among suppliers go by name; a segment without supplier has no supply.
    """
    words = lambda topics, audience: F.array_union(F.transform(sc.terms_of(topics), lambda w: F.concat(F.lit("t "), w)), F.transform(sc.terms_of(audience), lambda w: F.concat(F.lit("a "), w)))
    asked = segments.select("segment", F.col("style").alias("s"), F.explode(words(F.col("topics"), F.array("audience"))).alias("word"))
    offered = suppliers.select("name", F.explode(words(F.col("topics"), F.col("audiences"))).alias("word")).distinct()
    met = asked.select("segment", "word").join(offered, "word").select("segment", "name").distinct()
    near = lambda a, b: F.round(F.greatest(F.lit(0.0), st.similarity(a, b, sc.AXES)), 3)
    pairs = met.join(segments.select("segment", "style"), "segment").join(suppliers.select("name", F.col("style").alias("other"), "share"), "name").withColumn("alike", near(F.col("style"), F.col("other")))
    best = pairs.withColumn("place", F.row_number().over(W.partitionBy("segment").orderBy(F.desc("alike"), "name"))).where(F.col("place") <= top)
    supply = best.groupBy("segment").agg((F.sum(F.col("alike") * F.col("share")) / 30.0).alias("supply"), F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("closest"))
    joined = segments.join(supply, "segment", "left").withColumn("supply", F.coalesce("supply", F.lit(0.0)))
    gap = F.greatest(F.lit(0.0), F.col("demand") * (1.15 + near(F.col("style"), wanted) / 10.0) - F.col("supply"))
    return joined.select("segment", F.round(gap, 3).alias("gap"), F.round("supply", 3).alias("supply"), F.coalesce("closest", F.array().cast("array<string>")).alias("closest"))


def ranked_catalogue(catalogue: DataFrame, key: str, texts: Sequence[str], query: str, priority: str, weight: float = 2.0, boosts: Mapping[str, Mapping[str, float]] | None = None, k: int = 8) -> DataFrame:
    """The ``k`` entries of greatest score: ``weight`` per different word of the query they contain, and the ``boosts`` (word -> entry -> points) of words in it; ties by priority, then key, both descending."""
    import re

    asked = sorted({w for w in re.findall(r"[^\W\d_]{4,}", query.lower())})
    hay = F.lower(F.concat_ws(" ", *texts))
    score = F.lit(0.0)
    for w in asked:
        score = score + F.when(hay.contains(w), weight).otherwise(0.0)
    for w, points in (boosts or {}).items():
        if w.lower() in query.lower():
            for entry, more in points.items():
                score = score + F.when(F.col(key) == entry, more).otherwise(0.0)
    return catalogue.withColumn("score", score).orderBy(F.desc("score"), F.desc(priority), F.desc(key)).limit(k)


def arms_to_try(priors: DataFrame, attempts: DataFrame, key: str, prior: str, reward: str) -> DataFrame:
    """(key, score, n, explore): prior, what trying an arm has brought and how often it was tried; arms tried less than twice are to be explored."""
    tried = attempts.where(F.col(reward).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(reward).alias("r"))
    joined = priors.select(key, F.col(prior).cast("double").alias("p")).join(tried, key, "left").fillna(0, ["n"])
    score = F.col("p") + F.when(F.col("n") > 0, F.col("r") * 0.55 + F.least(F.lit(2.0), F.sqrt("n") * 0.75)).otherwise(0.0)
    return joined.select(key, F.round(score, 3).alias("score"), "n", (F.col("n") < 2).alias("explore"))


def positional_correlation(df: DataFrame, x: str, y: str, order: str, *groups: str) -> DataFrame:
    """(groups, n, r): correlation of places, ties in the given order instead of sharing a rank; 0 where a side is constant."""
    place = lambda c: F.row_number().over(W.partitionBy(*groups).orderBy(c, order))
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": place(x), "_y": place(y)})
    return ranks.pearson(rows, "_x", "_y", *groups)


def united(parts: Sequence[tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """Logs of one kind under one schema: each with its columns renamed, missing ones null."""
    out = None
    for df, names in parts:
        renamed = df.withColumnsRenamed(dict(names))
        out = renamed if out is None else out.unionByName(renamed, allowMissingColumns=True)
    return out


def unescaped(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``text`` freed of HTML entities, escaped twice too, and white space squeezed."""

    @F.pandas_udf("string")
    def plain(column: pd.Series) -> pd.Series:
        return column.map(lambda t: html.unescape(html.unescape(t)), na_action="ignore")

    c = F.col(text)
    return df.withColumn(text, tx.squeeze(F.when(c.contains("&"), plain(c)).otherwise(c)))


def dull_tail(setup: Column, templates: Sequence[str], index: Column) -> Column:
    """A template with the setup's last word of four letters or more in place of ``{w}``, 'matter' if there is none."""
    bare = F.transform(F.split(F.lower(setup), r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,!?"'()]+|[.,!?"'()]+$""", ""))
    nouns = F.filter(bare, lambda w: (F.length(w) > 3) & w.rlike(r"^\p{L}+$"))
    word = F.coalesce(F.get(nouns, F.size(nouns) - 1), F.lit("matter"))
    return F.replace(F.get(F.array(*map(F.lit, templates)), F.pmod(index, F.lit(len(templates))).cast("int")), F.lit("{w}"), word)


def arms_compared(df: DataFrame, arms: Mapping[str, Sequence[str]], target: str, split: str, penalty: float = 1.0) -> DataFrame:
    """(arm, n, r, rmse): ridge fits of each arm's columns on split 'train', tested on the same rows of 'test'.

    The rows are those with every arm's columns, so the arms are compared on equal rows. One pass gives all moments.
    """
    every = list(dict.fromkeys(c for columns in arms.values() for c in columns))
    rows = df.dropna(subset=[*every, target]).where(F.col(split).isin("train", "test"))
    held = {r[split]: studies._arrays(r, len(every)) for r in studies._moments(rows, every, target, split).collect()}  # two rows
    out = []
    for name, columns in arms.items():
        at = [every.index(c) for c in columns] + [len(every)]
        if "train" not in held or "test" not in held:
            out.append((name, 0, 0.0, None))
            continue
        (n, s, p), (m, t, q) = ((a[0], a[1][at], a[2][at][:, at]) for a in (held["train"], held["test"]))
        w, b = studies.solve(n, s, p, penalty)
        k = len(columns)
        mean = t / m
        c = q - m * mean[:, None] * mean[None, :]
        explained, both, total = float(w @ c[:k, :k] @ w), float(w @ c[:k, k]), float(c[k, k])
        error = max(0.0, total - 2 * both + explained + m * float(b + w @ mean[:k] - mean[k]) ** 2)
        out.append((name, m, both / (explained * total) ** 0.5 if explained > 1e-12 and total > 1e-12 else 0.0, (error / m) ** 0.5))
    return df.sparkSession.createDataFrame(out, "arm string, n long, r double, rmse double")


def shape_problems(df: DataFrame, columns: Sequence[str], key: str, expected_rows: int | None = None) -> DataFrame:
    """(problem, n) of a fetched table: columns it lacks, ids that are null or repeat, fewer rows than declared."""
    spark = df.sparkSession
    missing = [(f"missing:{c}", 1) for c in columns if c not in df.columns]
    out = spark.createDataFrame(missing, "problem string, n long")
    if key in df.columns:
        ids = df.agg(F.count_if(F.col(key).isNull()).alias("a"), F.count("*").alias("b"))
        out = out.union(ids.select(F.lit("null_id"), "a").where("a > 0")).union(validate.duplicates(df.where(F.col(key).isNotNull()), key).agg(F.sum("n").alias("n")).select(F.lit("repeated_id"), "n").where("n > 0"))
    if expected_rows is not None:
        out = out.union(df.agg((F.lit(expected_rows) - F.count("*")).alias("n")).select(F.lit("truncated"), "n").where("n > 0"))
    return out


#: The tables of a retrieval set.
RETRIEVAL_SET = ("documents", "queries", "qrels", "hard_negatives")


def write_retrieval_set(spark: SparkSession, target: str, tables: Mapping[str, DataFrame], note: str = "") -> None:
    """All tables of a retrieval set with their manifests, published in one step; an existing set is never overwritten."""
    if set(tables) != set(RETRIEVAL_SET):
        raise ValueError(f"a set has the tables {RETRIEVAL_SET}")
    sinks.publish(spark, target, {name: (lambda path, df=df: sinks.write_records(df, path, note)) for name, df in tables.items()})


def read_retrieval_set(spark: SparkSession, path: str, schemas: Mapping[str, object]) -> dict[str, DataFrame]:
    """The tables of a retrieval set; one that differs from its manifest raises."""
    out = {}
    for name in RETRIEVAL_SET:
        if wrong := sinks.verify_records(spark, f"{path}/{name}", schemas[name]):
            raise ValueError(f"{name}: {', '.join(wrong)}")
        out[name] = spark.read.schema(schemas[name]).json(f"{path}/{name}")
    return out
