"""Relational operators over text corpora: censuses, samples, duplicates, overlaps and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quipwright.functions import text as tx
from quipwright.operators.ranks import running
from quipwright.session import materialize, spread


def census(df: DataFrame, *dims: str) -> DataFrame:
    """(dim, value, n) for every dimension and (dim 'all') for the table, in one grouping-sets aggregate."""
    cols = [F.coalesce(F.col(d).cast("string"), F.lit("(null)")).alias(d) for d in dims]
    sets = [[d] for d in dims] + [[]]
    grouped = df.select(*cols).groupingSets(sets, *dims).agg(F.count("*").alias("n"))
    dim = F.coalesce(*(F.when(F.col(d).isNotNull(), d) for d in dims), F.lit("all"))
    return grouped.select(dim.alias("dim"), F.coalesce(*dims, F.lit("all")).alias("value"), "n")


def top_share(df: DataFrame, group: Column) -> DataFrame:
    """(top, n, share, groups) of the largest group (ties: the first by name)."""
    sizes = df.groupBy(group.alias("g")).agg(F.count("*").alias("n"))
    return sizes.agg(F.min_by("g", F.struct(-F.col("n"), F.col("g"))).alias("top"), F.max("n").alias("n"), (F.max("n") / F.sum("n")).alias("share"), F.count("*").alias("groups"))


def hash_sample(df: DataFrame, k: int, by: list[str], *order: Column | str) -> DataFrame:
    """The ``k`` rows of least order per group; the group limit runs before the shuffle, so a hot group sends k rows a task."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def round_robin(df: DataFrame, band: Column, k: int, *order: Column | str) -> DataFrame:
    """``k`` rows taken in turn from the bands, each in its order."""
    inside = W.partitionBy("band").orderBy(*order)
    few = df.withColumn("band", band).withColumn("turn", F.row_number().over(inside)).where(F.col("turn") <= k)
    return few.orderBy("turn", "band").limit(k)


def water_fill(available: list[int], budget: int) -> list[int]:
    """Shares of a budget, as equal as the amounts available allow; the remainder goes to the first."""
    got = [0] * len(available)
    open_ = sorted(range(len(available)), key=lambda i: (available[i], i))
    while open_ and budget > 0:
        level = budget // len(open_)
        if available[open_[0]] - got[open_[0]] <= level:
            i = open_.pop(0)
            budget -= available[i] - got[i]
            got[i] = available[i]
            continue
        for i in open_:
            got[i] += level
        for i in sorted(open_)[: budget - level * len(open_)]:
            got[i] += 1
        break
    return got


def latest_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the greatest by ``order``: an upsert expressed as an aggregate."""
    packed = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), packed).alias("_r"))
    return best.select(*keys, "_r.*")


def duplicate_profile(df: DataFrame, text: str, *groups: str) -> DataFrame:
    """(groups, rows, identical, varied): duplicate groups of normalised text, and how many hold one stored form or several."""
    forms = df.where(F.col(text).isNotNull()).groupBy(*groups, tx.norm_text(F.col(text)).alias("key")).agg(F.count("*").alias("n"), F.min(text).alias("a"), F.max(text).alias("b")).where("n > 1")
    same = F.col("a") == F.col("b")
    return forms.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(same).alias("identical"), F.count_if(~same).alias("varied"))


def unseen(df: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """Rows whose digest of the trimmed key no row of ``known`` has."""
    code = F.substring(F.sha2(F.trim(key), 256), 1, 16)
    return df.withColumn("_d", code).join(known.select(code.alias("_d")).distinct(), "_d", "left_anti").drop("_d")


def shingles(c: Column, size: int) -> Column:
    """Runs of ``size`` words; an empty array for a shorter text."""
    starts = lambda w: F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
    return tx.let(tx.words(c, "[a-z0-9]+"), lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, size), " ")))


def shingle_hashes(c: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words, without building the runs."""
    starts = lambda w: F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
    return tx.let(tx.words(c, "[a-z0-9]+"), lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, size))))


def overlap(df: DataFrame, reference: DataFrame, key: str, text: str, ref_text: str, size: int = 12) -> DataFrame:
    """(key, kind): rows whose normalised text the reference holds ('exact'), else that share a run of ``size`` words ('shingle').

    Hashes of runs travel first, the reference's made distinct; then the runs themselves of the rows that hit are
    compared with those of the reference, so two runs of one hash name no innocent row.
    """
    normal = lambda c: F.array_join(tx.words(F.col(c), "[a-z0-9]+"), " ")
    known = reference.select(F.sha2(normal(ref_text), 256).alias("h")).distinct()
    exact = df.select(key, F.sha2(normal(text), 256).alias("h"), normal(text).alias("_t")).where("_t <> ''").join(known, "h", "left_semi").select(key).distinct()
    rest = spread(df).join(exact, key, "left_anti")
    runs = spread(reference).select(F.explode(shingle_hashes(F.col(ref_text), size)).alias("x")).distinct()  # a run is 8 bytes however long
    near = rest.select(key, F.explode(F.array_distinct(shingle_hashes(F.col(text), size))).alias("x"))
    hits = materialize(near.join(runs, "x", "left_semi"), "hits")
    wanted = hits.select("x").distinct()
    both = lambda c: F.explode(F.arrays_zip(shingle_hashes(F.col(c), size).alias("x"), shingles(F.col(c), size).alias("t"))).alias("s")
    ours = rest.join(hits.select(key).distinct(), key, "left_semi").select(key, both(text))
    theirs = spread(reference).select(both(ref_text))
    theirs = theirs.select("s.x", "s.t").join(wanted, "x", "left_semi").select("t").distinct()
    shared = ours.select(key, "s.t").join(theirs, "t", "left_semi").select(key).distinct()
    return exact.select(key, F.lit("exact").alias("kind")).union(shared.select(key, F.lit("shingle").alias("kind")))


def word_counts(df: DataFrame, text: str, pattern: str = "[a-z']+") -> DataFrame:
    return df.select(F.explode(tx.words(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top_words(df: DataFrame, text: str, group: str, k: int) -> DataFrame:
    """(group, word, n, rank) of the ``k`` commonest content words per group, ties by word."""
    counts = df.select(group, F.explode(tx.content_words(F.col(text))).alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))
    order = W.partitionBy(group).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rarity(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mean_rarity, max_rarity): -ln((f + 1) / (N + 1)) over a row's words, f counted over all rows."""
    tokens = df.select(key, F.explode(tx.words(F.col(text))).alias("word"))
    per_row = tokens.groupBy(key, "word").agg(F.count("*").alias("c"))
    freq = per_row.groupBy("word").agg(F.sum("c").alias("f"))
    total = freq.agg(F.sum("f").alias("N"))
    value = -F.ln((F.col("f") + 1) / (F.col("N") + 1))
    scored = per_row.join(freq, "word").crossJoin(F.broadcast(total)).withColumn("v", value)  # total: one row
    return scored.groupBy(key).agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean_rarity"), F.max("v").alias("max_rarity"))


def having_all(df: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """Keys that occur with every wanted value: relational division."""
    hit = df.where(F.col(value).isin(*wanted)).select(key, value).distinct()
    return hit.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") == len(set(wanted))).select(key)


def rolling_median(df: DataFrame, value: str, order: list[str], width: int, least: int, *groups: str, out: str = "median") -> DataFrame:
    """Median of the last ``width`` rows, null before ``least`` of them."""
    frame = W.partitionBy(*groups).orderBy(*order).rowsBetween(-(width - 1), 0)
    held = F.array_sort(F.collect_list(F.col(value).cast("double")).over(frame))
    n = F.size("_w")
    middle = (F.get("_w", F.floor((n - 1) / 2).cast("int")) + F.get("_w", F.floor(n / 2).cast("int"))) / 2
    return df.withColumn("_w", held).withColumn(out, F.when(n >= least, middle)).drop("_w")


def novelty(df: DataFrame, words: str, order: str, width: int, out: str = "novelty") -> DataFrame:
    """1 - Jaccard of a row's word set with the union of the ``width`` rows before it; null before there are so many."""
    frame = W.orderBy(order).rowsBetween(-width, -1)
    past = df.withColumn("_lists", F.collect_list(words).over(frame))
    union = F.array_distinct(F.flatten("_lists"))
    both, either = F.size(F.array_intersect(words, union)), F.size(F.array_union(words, union))
    return past.withColumn(out, F.when(F.size("_lists") == width, 1 - both / F.greatest(either, F.lit(1)))).drop("_lists")


def gaps(df: DataFrame, group: str, time: str, key: str, seconds: float) -> DataFrame:
    """``df`` with ``burst``: number of the run of rows at most ``seconds`` apart within a group."""
    order = W.partitionBy(group).orderBy(time, key)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    apart = micros - F.lag(micros).over(order)
    start = F.when(apart.isNull() | (apart > seconds * 1e6), 1).otherwise(0)
    return df.withColumn("_s", start).withColumn("burst", F.sum("_s").over(order)).drop("_s")


def rotated(df: DataFrame, key: str, value: str, shift: int, k: int) -> DataFrame:
    """``k`` evenly spaced rows by key, each with the value of the row ``shift`` places on, around the end."""
    total = df.agg(F.count("*").alias("_n"))
    numbered = running(df.select(key, value), [F.col(key)], out="_r").crossJoin(F.broadcast(total))  # one row
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / k))
    even = materialize(numbered.where((F.col("_r") % step == 0) & (F.col("_r") < step * k)).withColumn("i", (F.col("_r") / step).cast("int")), "even")
    size = even.agg(F.count("*").alias("m"))
    spaced = even.crossJoin(F.broadcast(size))  # one row
    other = even.select(F.col("i").alias("j"), F.col(value).alias("control"))
    return spaced.withColumn("j", (F.col("i") + shift) % F.col("m")).join(other, "j").select(key, F.col(value), "control")


def split_leaks(df: DataFrame, group: Column, split: str) -> DataFrame:
    """(groups, leaking): groups of rows, and those whose rows lie in several splits."""
    each = df.groupBy(group.alias("g")).agg(F.count_distinct(split).alias("s"))
    return each.agg(F.count("*").alias("groups"), F.count_if(F.col("s") > 1).alias("leaking"))


def majority_share(df: DataFrame, label: Column, *groups: str) -> DataFrame:
    """Share of rows that the commonest value of their group would label right."""
    counts = df.groupBy(*groups, label.alias("_l")).agg(F.count("*").alias("c"))
    best = counts.groupBy(*groups).agg(F.max("c").alias("top"), F.sum("c").alias("n"))
    return best.agg(F.sum("n").alias("n"), (F.sum("top") / F.sum("n")).alias("majority"))


def staged_screens(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """One row: rows in, rows each stage drops after the ones before it, rows kept; a null condition drops."""
    ok = {name: F.coalesce(c, F.lit(False)) for name, c in stages.items()}
    cols, passed = [F.count("*").alias("rows_in")], F.lit(True)
    for name, c in ok.items():
        cols.append(F.count_if(passed & ~c).alias(f"dropped_{name}"))
        passed = passed & c
    return df.agg(*cols, F.count_if(passed).alias("rows_kept"))
