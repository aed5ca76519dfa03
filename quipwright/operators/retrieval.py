"""Vector search and the evaluation of retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quipwright.functions import text as tx, vectors as vx
from quipwright.session import materialize


#: Queries that go to the tasks at a time; more are worked off block by block.
QUERIES_AT_ONCE = 20_000
#: Anchors are a small table by nature and are broadcast.
MOST_ANCHORS = 10_000


def _blocks(queries: DataFrame, key: str, at_once: int) -> list[DataFrame]:
    """The queries in blocks by hash of their key, of about ``at_once`` each."""
    n = -(-queries.count() // at_once)
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def search(items: DataFrame, queries: DataFrame, key: str, vector: str, k: int, digits: int | None = None, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query, key, score, rank): the ``k`` nearest items of every query by cosine, ties by key, the query itself left out.

    The queries are a stated set and go to the tasks in blocks of ``at_once``; the items stay where they are, are
    multiplied with a block as matrices, and each batch sends on at most k rows per query and what ties with the
    last of them. ``digits`` rounds the scores before they are ranked. A null, zero or NaN vector and one of another
    length score 0.
    """
    types = dict(items.dtypes)
    schema = f"query {types[key]}, `{key}` {types[key]}, score double"
    held = materialize(queries.select(key, F.col(vector).cast("array<double>").alias("_v")).where(F.col(key).isNotNull()), "queries")
    found = None
    for block in _blocks(held, key, at_once):
        pdf = block.toPandas()  # at most about at_once rows
        ids, matrix = pdf[key].to_numpy(), _unit_rows(pdf["_v"])
        sent = items.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked, sides = sent.value
            for pdf in frames:
                keys = pdf[key].to_numpy()
                score = np.zeros((len(asked), len(keys)))
                for size, (rows, unit) in _unit_rows(pdf["_v"]).items():
                    if size in sides:
                        score[np.ix_(sides[size][0], rows)] = sides[size][1] @ unit.T
                if digits is not None:
                    score = np.round(score, digits) + 0.0
                score[asked[:, None] == keys[None, :]] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] if len(keys) > k else np.full(len(asked), -np.inf)
                q, i = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                yield pd.DataFrame({"query": asked[q], key: keys[i], "score": score[q, i]})

        if len(ids):
            part = items.select(key, F.col(vector).cast("array<double>").alias("_v")).where(F.col(key).isNotNull()).mapInPandas(run, schema)
            found = part if found is None else found.union(part)
    if found is None:
        return items.sparkSession.createDataFrame([], schema + ", rank int")
    order = W.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit_rows(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (places, unit vectors); null, empty, zero and not finite ones are left out."""
    out = {}
    sizes = np.array([0 if v is None else len(v) for v in vectors], dtype=np.int64)
    for size in set(sizes.tolist()) - {0}:
        rows = np.flatnonzero(sizes == size)
        matrix = np.array([np.asarray(vectors.iloc[r], dtype=float) for r in rows])
        norm = np.sqrt((matrix * matrix).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        out[size] = rows[good], matrix[good] / norm[good, None]
    return out


def centroids(items: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, vector): element-wise mean per label."""
    cells = items.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def nearest_anchor(items: DataFrame, anchors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, nearest, score, margin): the anchor of greatest cosine and its lead over the next; anchors are a small table."""
    named = anchors.select(F.col(label).alias("_l"), F.col(vector).alias("_a"))
    if named.limit(MOST_ANCHORS + 1).count() > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors; use search, which works in blocks")
    scored = items.select(key, vector).join(F.broadcast(named)).select(key, "_l", vx.cosine(vector, "_a").alias("score"))
    best = scored.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("_l").alias("l")))), 1, 2).alias("b"))
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    return best.select(key, first["l"].alias("nearest"), (-first["s"]).alias("score"), (second["s"] - first["s"]).alias("margin"))


def tfidf(texts: DataFrame, key: str, text: str, *groups: str) -> DataFrame:
    """(groups, key, token, w): (1 + ln tf) (ln((1 + N) / (1 + df)) + 1), each text of unit length; N and df per group."""
    tf = texts.select(*groups, key, F.explode(tx.words(F.col(text), "[a-z0-9]+")).alias("token")).groupBy(*groups, key, "token").agg(F.count("*").alias("tf"))
    n = texts.groupBy(*groups).agg(F.count("*").alias("N"))
    df = tf.groupBy(*groups, "token").agg(F.count("*").alias("df"))
    on = list(groups)
    raw = tf.join(df, [*on, "token"]).join(n, on) if on else tf.join(df, "token").crossJoin(F.broadcast(n))  # without groups one row
    weighed = raw.withColumn("v", (1 + F.ln("tf")) * (F.ln((1 + F.col("N")) / (1 + F.col("df"))) + 1))
    size = weighed.groupBy(*groups, key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    return weighed.join(size, [*on, key]).select(*groups, key, "token", (F.col("v") / F.col("size")).alias("w"))


def relevant_ranks(documents: DataFrame, queries: DataFrame, qrels: DataFrame, *groups: str, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(groups, query, rank): best rank of a relevant document among all documents of the query's group, by TF-IDF cosine, ties by document id.

    Documents and queries are (groups, id, text), qrels (query, document). The score of the relevant document is
    found by an equi-join of judged pairs alone. Then every document meets the queries of a block, which go to the
    tasks as posting lists with the score to beat, and only counts of documents ahead leave a task: no pair is
    listed, however common a token is.
    """
    on = list(groups)
    group = F.concat_ws("\x1f", *(F.col(g).cast("string") for g in on)) if on else F.lit("")
    every = documents.select(*groups, F.concat(F.lit("d"), "id").alias("key"), "text").union(queries.select(*groups, F.concat(F.lit("q"), "id").alias("key"), "text"))
    weights = materialize(tfidf(every, "key", "text", *groups).withColumn("_g", group), "weights")
    d = weights.where("key like 'd%'").select("_g", F.expr("substring(key, 2)").alias("document"), "token", F.col("w").alias("wd"))
    q = weights.where("key like 'q%'").select("_g", F.expr("substring(key, 2)").alias("query"), "token", F.col("w").alias("wq"))
    places = queries.select(*groups, group.alias("_g"), F.col("id").cast("string").alias("query")).distinct()
    judged = qrels.select(F.col("query").cast("string").alias("query"), F.col("document").cast("string").alias("document")).distinct().join(places.select("_g", "query"), "query")
    scored = judged.join(q, ["_g", "query"]).join(d, ["_g", "document", "token"]).groupBy("_g", "query", "document").agg(F.round(F.sum(F.col("wq") * F.col("wd")), 9).alias("score"))
    best = judged.join(scored, ["_g", "query", "document"], "left").fillna(0.0, ["score"]).groupBy("_g", "query").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("document").alias("d"))).alias("t"))
    lists = q.groupBy("_g", "query").agg(F.collect_list(F.struct("token", "wq")).alias("terms"))  # a text's own tokens
    asked = materialize(best.join(lists, ["_g", "query"], "left").select("_g", "query", (-F.col("t.s")).alias("score"), F.col("t.d").alias("document"), "terms"), "asked")
    ids = documents.select(group.alias("_g"), F.col("id").cast("string").alias("document")).distinct()
    texts = ids.join(d.groupBy("_g", "document").agg(F.collect_list(F.struct("token", "wd")).alias("terms")), ["_g", "document"], "left")
    texts = materialize(texts, "texts")
    counted = None
    for block in _blocks(asked, "query", at_once):
        rows = block.collect()  # at most about at_once texts
        part = texts.mapInPandas(_ahead(documents.sparkSession.sparkContext.broadcast(_postings(rows))), "_g string, query string, n long")
        counted = part if counted is None else counted.union(part)
    ahead = counted.groupBy("_g", "query").agg(F.sum("n").alias("n"))
    ranked = places.join(asked.select("_g", "query"), ["_g", "query"]).join(ahead, ["_g", "query"], "left")
    return ranked.select(*groups, "query", (F.coalesce("n", F.lit(0)) + 1).alias("rank"))


def _postings(rows: list) -> dict:
    """group -> (queries, scores to beat, documents to beat, token -> (places of queries, weights))."""
    out: dict = {}
    for r in rows:
        names, scores, docs, lists = out.setdefault(r["_g"], ([], [], [], {}))
        for t in r["terms"] or []:
            where, w = lists.setdefault(t["token"], ([], []))
            where.append(len(names))
            w.append(t["wq"])
        names.append(r["query"])
        scores.append(r["score"])
        docs.append(r["document"])
    return {g: (n, np.array(s), np.array(d, dtype=object), {t: (np.array(i), np.array(w)) for t, (i, w) in lists.items()}) for g, (n, s, d, lists) in out.items()}


def _ahead(sent):
    """Counts, per query of the block, of the task's documents that rank before its relevant one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {g: np.zeros(len(names), np.int64) for g, (names, *_) in sent.value.items()}
        seen: dict[str, list[str]] = {g: [] for g in counts}
        for pdf in frames:
            for g, document, terms in zip(pdf["_g"], pdf["document"], pdf["terms"]):
                if g not in counts:
                    continue
                _, beat, name, lists = sent.value[g]
                seen[g].append(document)
                score = np.zeros(len(beat))
                for t in terms if terms is not None else ():
                    if (hit := lists.get(t["token"])) is not None:
                        np.add.at(score, hit[0], t["wd"] * hit[1])
                some = np.flatnonzero(score)
                score = np.round(score[some], 9)
                some, score = some[score > 0], score[score > 0]
                before = score > beat[some]
                same = np.flatnonzero(score == beat[some])
                before[same] = name[some[same]] > document
                counts[g][some[before]] += 1
                # those that score something are no part of the count below, where the score to beat is 0
                low = some[beat[some] == 0]
                counts[g][low[name[low] > document]] -= 1
        for g, n in counts.items():
            names, beat, name, _ = sent.value[g]
            low = np.flatnonzero(beat == 0)
            if len(low) and seen[g]:
                n[low] += np.searchsorted(np.array(sorted(seen[g]), dtype=object), name[low])
            yield pd.DataFrame({"_g": g, "query": names, "n": n})

    return run


def ranking_metrics(ranks: DataFrame, *dims: str) -> DataFrame:
    """(dim, value, queries, mrr, recall_1, recall_5, recall_10, ndcg_10, median_rank) over all queries and per dimension."""
    names = [F.col(d).cast("string").alias(d) for d in dims]
    r = F.col("rank")
    grouped = ranks.select(*names, "rank").groupingSets([[d] for d in dims] + [[]], *dims).agg(
        F.count("*").alias("queries"), F.avg(1 / r).alias("mrr"), *(F.avg((r <= k).cast("double")).alias(f"recall_{k}") for k in (1, 5, 10)),
        F.avg(F.when(r <= 10, math.log(2) / F.ln(r + 1)).otherwise(0.0)).alias("ndcg_10"), F.median("rank").alias("median_rank"),
    )
    dim = F.coalesce(*(F.when(F.col(d).isNotNull(), d) for d in dims), F.lit("all"))
    return grouped.select(dim.alias("dim"), F.coalesce(*dims, F.lit("all")).alias("value"), "queries", "mrr", "recall_1", "recall_5", "recall_10", "ndcg_10", "median_rank")


def near_hashes(items: DataFrame, key: str, bits: str, most: int, bands: int = 8) -> DataFrame:
    """(a, b, distance), a < b: 64-bit hashes at most ``most`` bits apart.

    With more bands than differing bits one band must be equal (pigeonhole), so candidates meet in an
    equi-join on a band and every pair within the distance is found.
    """
    if most >= bands:
        raise ValueError("the distance must be below the number of bands")
    width = -(-64 // bands)
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("i"), F.call_function("shiftrightunsigned", F.col(bits), i * width).bitwiseAND((1 << width) - 1).alias("v"))))
    cut = items.select(F.col(key), F.col(bits), band.alias("band"))
    left, right = cut.select(F.col(key).alias("a"), F.col(bits).alias("x"), "band"), cut.select(F.col(key).alias("b"), F.col(bits).alias("y"), "band")
    distance = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return left.join(right, "band").where("a < b").withColumn("distance", distance).where(F.col("distance") <= most).select("a", "b", "distance").distinct()


def hard_negatives(documents: DataFrame, key: str, group: str, family: str, context: str) -> DataFrame:
    """(key, same_family, same_context): the first other document of the group with the same family, and with the same context but another family."""
    order = W.partitionBy(group, family).orderBy(key)
    first, second = F.nth_value(key, 1).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.nth_value(key, 2).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    same = documents.withColumn("same_family", F.when(first != F.col(key), first).otherwise(second))
    heads = documents.groupBy(group, context, family).agg(F.min(key).alias("m"))
    by = W.partitionBy(group, context).orderBy("m").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    two = heads.withColumn("m1", F.nth_value("m", 1).over(by)).withColumn("m2", F.nth_value("m", 2).over(by)).select(group, context, family, F.when(F.col("m1") != F.col("m"), F.col("m1")).otherwise(F.col("m2")).alias("same_context"))
    return same.join(two, [group, context, family], "left").select(key, "same_family", "same_context")
