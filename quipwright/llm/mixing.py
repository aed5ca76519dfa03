"""Mixing sources to target weights by certain whole copies and Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quipwright.llm.tokens import with_token_counts
from quipwright.session import materialize, spread

#: Ranks fall into this many bins per source; only the bin in which a source's budget ends is sorted.
BINS = 4096
#: Cells per octave of the histogram of weights from which the inclusion probabilities are fitted.
GRID = 16
#: The wanted mix is a small table given by hand; more rows than this are refused.
MAX_SOURCES = 10_000


def budgets(available: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens per source: its share of ``total``, at most max_repeats times what it has.

    What a source cannot give goes to the others in proportion to their shares, until all is placed or
    every source is at its cap. Without ``total`` it is what the sources of the mix hold once.
    """
    cap = {s: available.get(s, 0.0) * max(r, 0) for s, (_, r) in targets.items()}
    share = {s: max(w, 0.0) for s, (w, _) in targets.items()}
    left = sum(available.get(s, 0.0) for s in targets) if total is None else float(total)
    got = dict.fromkeys(targets, 0.0)
    open_ = {s for s in targets if share[s] > 0 and cap[s] > 0}
    while open_ and left > 1e-9:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if cap[s] - got[s] <= left * share[s] / weight}
        if not full:
            for s in open_:
                got[s] += left * share[s] / weight
            break
        for s in full:
            left -= cap[s] - got[s]
            got[s] = cap[s]
        open_ -= full
    return got


class Mix:
    """``documents(doc_id, text, source)`` mixed to ``targets(source, target_share, max_repeats)``.

    Every document of a source is used as often as its budget holds the source whole; these copies are
    certain. For the rest of the budget a Pareto sample of the source's documents is drawn, each once: the
    inclusion probability of a document is in proportion to its ``weight``, a column's name or expression,
    by default its tokens, and at most 1. Documents are ranked by u / (1 - u) over p / (1 - p), u drawn by
    hashing the id, and taken in that order until the budget is used (the document at the border where it
    brings the sum closer). No document is used oftener than its source needs, nor than max_repeats.
    Documents of no or negative weight have only certain copies. Documents without id, source or tokens are
    not used; rows of one id are one document. Targets named twice add their shares; a null share or repeat
    counts as 0. Sources without target are left out.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11, weight: str | F.Column = "n_tokens"):
        self.spark = documents.sparkSession
        self.seed = seed
        given = targets.where("source is not null").groupBy("source").agg(
            F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats")
        ).limit(MAX_SOURCES + 1).collect()
        if len(given) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources in the mix")
        self.targets = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in given}
        self.wanted = self.spark.createDataFrame([(s, w, r) for s, (w, r) in self.targets.items()], "source string, target_share double, max_repeats int")
        chosen = spread(documents.where("doc_id is not null")).join(F.broadcast(self.wanted.select("source")), "source")  # at most MAX_SOURCES rows
        own = weight if isinstance(weight, F.Column) or weight != "n_tokens" else F.lit(0.0)
        sized = with_token_counts(chosen.select("doc_id", "source", "text", (F.col(own) if isinstance(own, str) else own).cast("double").alias("w")))
        docs = sized.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"), F.max("w").alias("w")).where("n_tokens > 0")
        mass = F.col("n_tokens").cast("double") if isinstance(weight, str) and weight == "n_tokens" else F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0))
        self.docs = materialize(docs.withColumn("w", mass), "sized")
        held = self.docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
        self.available = {r["source"]: (int(r["t"]), int(r["n"])) for r in held}
        self.budget = budgets({s: float(t) for s, (t, _) in self.available.items()}, self.targets, total)
        # copies of the whole source, and the tokens that the sample must bring
        self.whole = {s: min(self.targets[s][1], int(self.budget[s] / t + 1e-9)) for s, (t, _) in self.available.items()}
        self.rest = {s: max(0.0, self.budget[s] - self.whole[s] * t) if self.whole[s] < self.targets[s][1] else 0.0 for s, (t, _) in self.available.items()}
        self.factor = self._factors()

    def _factors(self) -> dict[str, float]:
        """Per source the factor from weight to inclusion probability, so that the expected tokens of the sample are the rest of its budget.

        Weights too large for it are certain. From which on they are is found on a histogram of the weights by
        GRID-ths of an octave, so one pass does; the sample's size is exact whatever the histogram's grain.
        """
        octave = F.floor(F.log2("w") * GRID)
        cells = self.docs.where("w > 0").groupBy("source", octave.alias("cell")).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("w")).alias("tw"), F.max("w").alias("most"))
        plan = self.spark.createDataFrame([(s, r) for s, r in self.rest.items() if r > 0], "source string, rest double")
        above = W.partitionBy("source").orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)
        below = W.partitionBy("source").orderBy(F.desc("cell")).rowsBetween(0, W.unboundedFollowing)
        tried = cells.join(F.broadcast(plan), "source").withColumn(  # at most MAX_SOURCES rows
            "factor", (F.col("rest") - F.coalesce(F.sum("t").over(above), F.lit(0))) / F.sum("tw").over(below)
        )
        # the first cell from above, the cells before which are certain, in which none need be
        fits = tried.where("factor > 0 and factor * most <= 1").groupBy("source").agg(F.max_by("factor", "cell").alias("factor"))
        return {r["source"]: float(r["factor"]) for r in fits.collect()}

    def rows(self) -> DataFrame:
        """(doc_id, source, n_tokens, copies) of the documents used."""
        each = [(s, self.whole[s], float(self.rest[s]), float(self.factor.get(s, "inf"))) for s in self.available]
        plan = self.spark.createDataFrame(each, "source string, whole int, left double, factor double")
        base = self.docs.join(F.broadcast(plan), "source")  # at most MAX_SOURCES rows
        p = F.when((F.col("left") > 0) & (F.col("w") > 0), F.least(F.lit(1.0), F.col("factor") * F.col("w")))
        u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(self.seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        odds = (u / (1 - u)) * ((1 - F.col("p")) / F.col("p"))
        ranked = base.withColumn("p", p).withColumn("q", odds / (1 + odds)).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("q") * BINS)))
        ranked = materialize(ranked.select("doc_id", "source", "n_tokens", "whole", "left", "q", "bin"), "ranked")
        upto = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        bins = ranked.where("bin is not null").groupBy("source", "bin").agg(F.sum("n_tokens").alias("t"), F.max("left").alias("left")).withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0)))
        state = bins.select("source", "bin", "before", F.when(F.col("before") + F.col("t") <= F.col("left"), "in").when(F.col("before") < F.col("left"), "border").otherwise("out").alias("state"))
        placed = ranked.join(state, ["source", "bin"], "left")
        inside = W.partitionBy("source", "bin").orderBy("q", "doc_id").rowsBetween(W.unboundedPreceding, -1)
        border = placed.where("state = 'border'").withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        # the document that crosses the budget stays if it ends nearer to it than the sum without it
        border = border.withColumn("extra", (F.col("left") - F.col("at") > F.col("n_tokens") / 2).cast("int")).drop("at")
        other = placed.where("state is null or state <> 'border'").withColumn("extra", (F.coalesce("state", F.lit("out")) == "in").cast("int"))
        both = other.unionByName(border).withColumn("copies", F.col("whole") + F.col("extra"))
        return both.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")

    def report(self, rows: DataFrame | None = None) -> DataFrame:
        """(source, target_share, actual_share, tokens, documents, copies, held_tokens, max_repeats, short) for every source of the mix."""
        rows = materialize(rows if rows is not None else self.rows(), "mix")
        used = rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
        total = rows.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all_tokens"))
        held = self.spark.createDataFrame([(s, self.available.get(s, (0, 0))[0]) for s in self.targets], "source string, held_tokens long")
        joined = self.wanted.join(held, "source").join(used, "source", "left").fillna(0, ["tokens", "documents", "copies"]).crossJoin(total)  # one row
        actual = F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0))
        return joined.select("source", "target_share", actual.alias("actual_share"), "tokens", "documents", "copies", "held_tokens", "max_repeats", (actual < F.col("target_share") - 0.005).alias("short"))
