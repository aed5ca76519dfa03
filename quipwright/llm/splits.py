"""Splits that keep related records together.

Rows that share an id, a setup or an author, directly or along a chain, form one component;
components are found by random-mate contraction and dealt out by cumulative weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from quipwright.session import materialize, release

#: Buckets of the distributed running sum; the bucket totals are the only thing summed in one task.
SUM_BUCKETS = 4096
#: Components above this share of all weight are placed one by one (at most 1 / HEAVY of them exist).
HEAVY = 0.005
MAX_ROUNDS = 200
#: The first, large rounds are unwound one by one; the later ones, a small part of all vertices, together.
UNWIND = 4
#: Edges few enough for one task to run all further rounds over: the long tail of the contraction, where a round costs more to start than to do.
TAIL = 10_000


def clean_key(column) -> F.Column:
    """Key for comparison: no outer white space of any kind, no letter case; blank means none."""
    bare = F.lower(F.regexp_replace(column.cast("string"), r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))
    return F.when(bare != "", bare)


def contract(edges: DataFrame, seed: int = 17) -> DataFrame:
    """Connected components of ``edges(u, v)`` by random-mate contraction -> (node, component).

    In each round every vertex draws a coin from a hash of itself and the round. A tails vertex
    with a heads neighbour collapses into the neighbour of least hash; the edges are rewritten,
    loops and repeats dropped, until none is left. The rounds' collapses are then unwound from the
    last to the first (the small late rounds at once, by path doubling; the last few thousand edges in one task), so each vertex gets the vertex its component ended in. Vertices without an
    edge are not in the result. A round is a partial aggregate and two equi-joins; a hub with a
    third of all edges is one row of the collapse table, its edges are split by the skew join.
    Null vertices and loops are ignored, an empty table gives an empty one.
    """
    spark = edges.sparkSession
    both = edges.select("u", "v").where("u <> v")
    live = materialize(both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    collapses: list[DataFrame] = []
    for round_ in range(MAX_ROUNDS):
        left_over = live.count()
        if left_over <= TAIL:
            if left_over:
                collapses.append(materialize(_tail(live, seed), "hop"))
            break
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed), F.lit(round_)), F.lit(2)) == 0
        ends = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mates = ends.where(~coin("u") & coin("v"))
        hop = mates.groupBy("u").agg(F.min_by("v", F.struct(F.xxhash64("v", F.lit(round_)), F.col("v"))).alias("into"))
        hop = materialize(hop, "hop")
        collapses.append(hop)
        left = hop.select("u", F.col("into").alias("iu"))
        right = hop.select(F.col("u").alias("v"), F.col("into").alias("iv"))
        moved = (
            live.join(left, "u", "left").join(right, "v", "left")
            .select(F.coalesce("iu", "u").alias("a"), F.coalesce("iv", "v").alias("b"))
            .where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        )
        moved = materialize(moved, "edges")
        release(live)
        live = moved
    else:
        raise RuntimeError(f"contraction did not end within {MAX_ROUNDS} rounds")
    release(live)
    if not collapses:
        return spark.createDataFrame([], "node string, component string")
    labels = _doubled(collapses[UNWIND:])
    for hop in reversed(collapses[:UNWIND]):
        step = hop.select(F.col("u").alias("node"), "into")
        if labels is None:
            labels = step.select("node", F.col("into").alias("component"))
            continue
        known = labels.select(F.col("node").alias("into"), "component")
        labels = materialize(
            labels.union(step.join(known, "into", "left").select("node", F.coalesce("component", "into").alias("component"))), "labels"
        )
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    labels = materialize(labels.union(roots), "labels")
    release(*collapses)
    return labels


def _tail(live: DataFrame, seed: int) -> DataFrame:
    """(u, into): the collapses of all further rounds over at most TAIL edges, composed, the rounds run inside one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        names, place = np.unique(np.concatenate([pdf["u"].to_numpy(object), pdf["v"].to_numpy(object)]), return_inverse=True)
        u, v = place[: len(pdf)], place[len(pdf) :]
        into, rng = np.arange(len(names)), np.random.default_rng(seed)
        while len(u):
            heads = rng.random(len(names)) < 0.5
            a, b = np.concatenate([u, v]), np.concatenate([v, u])
            mates = ~heads[a] & heads[b]
            hop = np.arange(len(names))
            hop[a[mates]] = b[mates]
            into, u, v = hop[into], hop[u], hop[v]
            u, v = u[u != v], v[u != v]
        moved = np.flatnonzero(into != np.arange(len(names)))
        yield pd.DataFrame({"u": names[moved], "into": names[into[moved]]})

    return live.select("u", "v").coalesce(1).mapInPandas(run, "u string, into string")


def _doubled(collapses: list[DataFrame]) -> DataFrame | None:
    """(node, component) of the collapses of many small rounds: a vertex collapses once, so they form a forest whose paths are halved by each join."""
    if not collapses:
        return None
    every = collapses[0]
    for hop in collapses[1:]:
        every = every.union(hop)
    labels = materialize(every.select(F.col("u").alias("node"), F.col("into").alias("component")), "labels")
    for _ in range((len(collapses) - 1).bit_length()):
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        labels = materialize(labels.join(far, "component", "left").select("node", F.coalesce("far", "component").alias("component")), "labels")
    return labels


def components(rows: DataFrame, id_col: str, keys: dict[str, F.Column], seed: int = 17) -> DataFrame:
    """``rows`` with a column ``component``: equal for rows linked by id or by any of ``keys``.

    ``keys`` maps a name to the cleaned key column. A row without id and keys is alone; such rows
    get a component of their own content. Each id first collapses into the least key that any of
    its rows carries, so that the graph holds keys, not rows.
    """
    nodes = [F.when(k.isNotNull(), F.concat(F.lit(f"{n}\x1f"), k)) for n, k in keys.items()]
    id_node = F.when(F.col(id_col).isNotNull(), F.concat(F.lit("=id\x1f"), F.col(id_col).cast("string")))
    work = rows.withColumns({f"_n{i}": n for i, n in enumerate(nodes)}).withColumn("_id", id_node)
    names = [f"_n{i}" for i in range(len(nodes))]
    first = F.coalesce(*names) if len(names) > 1 else F.col(names[0])
    facts = work.groupBy("_id", *names).count().drop("count")  # repeated rows carry no further links
    rep = facts.where("_id is not null").groupBy("_id").agg(F.min(first).alias("_rep"))
    linked = facts.join(rep, "_id", "left").select(*names, F.coalesce("_rep", first).alias("_rep"))
    edges = None
    for n in names:
        part = linked.where(f"{n} is not null and _rep is not null and {n} <> _rep").select(F.col("_rep").alias("u"), F.col(n).alias("v"))
        edges = part if edges is None else edges.union(part)
    labels = contract(edges.distinct(), seed)
    anchor = F.coalesce(first, F.col("_rep"), F.col("_id"), F.concat(F.lit("=row\x1f"), F.sha2(F.to_json(F.struct(*rows.columns)), 256)))
    anchored = work.join(rep, "_id", "left").withColumn("_anchor", anchor)
    known = labels.withColumnRenamed("node", "_anchor").withColumnRenamed("component", "_component")
    return (
        anchored.join(known, "_anchor", "left")
        .withColumn("component", F.coalesce("_component", "_anchor"))
        .drop(*names, "_id", "_rep", "_anchor", "_component")
    )


def running_sum(df: DataFrame, order_hash: str, weight: str) -> DataFrame:
    """``df`` with ``before``: the weight of all rows of smaller hash, without a global sort.

    Rows fall into SUM_BUCKETS ranges of the hash; only the bounded table of range totals is summed
    in one task, the rest runs inside each range.
    """
    bucket = F.shiftrightunsigned(F.col(order_hash), 52).cast("int")
    ranged = df.withColumn("_bucket", bucket)
    totals = ranged.groupBy("_bucket").agg(F.sum(weight).alias("_total"))
    offset = totals.select(
        "_bucket", F.coalesce(F.sum("_total").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_offset")
    )
    inner = W.partitionBy("_bucket").orderBy(order_hash, "component").rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(offset), "_bucket")  # at most SUM_BUCKETS rows
        .withColumn("before", F.col("_offset") + F.coalesce(F.sum(weight).over(inner), F.lit(0.0)))
        .drop("_bucket", "_offset")
    )


def assign_splits(parts: DataFrame, proportions: dict[str, float], seed: int = 17) -> DataFrame:
    """``parts(component, weight)`` -> (component, weight, split) near the given proportions.

    Components heavier than HEAVY of the total (a bounded number) go one by one, largest first, to
    the split that lacks most; the rest follow in hash order and are cut by cumulative weight at what
    each split still lacks. No component is divided, so a component of a third of all rows stays whole.
    """
    whole = sum(proportions.values())
    want = {k: v / whole for k, v in proportions.items() if v > 0}
    total = float(parts.agg(F.sum("weight")).first()[0] or 0)
    if not total:
        return parts.select("component", "weight", F.lit(None).cast("string").alias("split"))
    heavy = parts.where(F.col("weight") > HEAVY * total).orderBy(F.desc("weight"), "component").collect()  # < 1 / HEAVY rows
    lack = {k: v * total for k, v in want.items()}
    placed = {}
    for row in heavy:
        best = max(want, key=lambda k: (lack[k] / want[k], lack[k]))
        placed[row["component"]] = best
        lack[best] -= row["weight"]
    room = {k: max(v, 0.0) for k, v in lack.items()}
    rest = sum(room.values()) or 1.0
    light = parts.where(F.col("weight") <= HEAVY * total).withColumn("_h", F.xxhash64("component", F.lit(seed)))
    light_total = total - sum(r["weight"] for r in heavy)
    summed = running_sum(light, "_h", "weight").withColumn("_mid", (F.col("before") + F.col("weight") / 2) / F.lit(light_total or 1.0))
    pick, edge = F.lit(list(want)[-1]), 1.0
    for name in reversed(list(want)):
        edge -= room[name] / rest
        pick = pick if name == list(want)[-1] else F.when(F.col("_mid") < edge + room[name] / rest, name).otherwise(pick)
    result = summed.select("component", "weight", pick.alias("split"))
    if placed:
        rows = parts.sparkSession.createDataFrame([(r["component"], placed[r["component"]]) for r in heavy], "component string, split string")
        result = result.union(parts.join(rows, "component").select("component", "weight", "split"))
    return result


def solution_components(solution: DataFrame) -> DataFrame:
    """Rows of ``solution`` with cleaned ``use`` and their component."""
    author = clean_key(F.col("author_key"))
    keys = {"setup": clean_key(F.col("setup_key")), "author": F.when(author.startswith("au_"), author)}
    rows = solution.select("id", "setup_key", "author_key", "usage")
    return components(rows, "id", keys).withColumn("use", clean_key(F.col("usage")))


def torn_groups(solution: DataFrame) -> DataFrame:
    """(id): distinct ids whose component carries more than one usage.

    Null or blank usage is no usage; ids compare as stored; rows of null id link their keys but
    name no id. Empty tables give no rows.
    """
    rows = materialize(solution_components(solution).select("id", "component", "use"), "components")
    torn = rows.groupBy("component").agg(F.min("use").alias("a"), F.max("use").alias("b")).where("a <> b")
    return rows.where("id is not null").join(torn, "component", "left_semi").select("id").distinct()


def split_records(solution: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """(id, component, n_rows, split): one row per id, related ids in one split; n_rows is the component's."""
    rows = materialize(solution_components(solution).select("id", "component"), "components")
    sizes = rows.groupBy("component").agg(F.count("*").cast("double").alias("weight"))
    splits = assign_splits(materialize(sizes, "sizes"), proportions or {"train": 0.8, "validation": 0.1, "test": 0.1})
    ids = rows.where("id is not null").distinct()
    return ids.join(splits, "component").select("id", F.sha2("component", 256).alias("component"), F.col("weight").cast("long").alias("n_rows"), "split")
