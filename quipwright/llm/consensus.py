"""Consensus from several annotators' labels by regularised minimax conditional entropy.

The label of item j by judge i is modelled as softmax over k of sigma_i(l, k) + tau_j(l, k) given
the true label l. The tilting parameters maximise the regularised dual by coordinate ascent on a
diagonal bound of its curvature, alternating with the posteriors of the labels. Item parameters
stay with the item's row in the executors. Votes are kept sparse, by item and judge, and pairs of judges
are formed only where they share an item and reach the driver only where they vote as one; besides these
the driver holds K x K numbers per judge, and sends them out, at most MAX_JUDGES of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quipwright.session import materialize

REACTIONS = ("laugh", "smile", "groan", "silence")
#: The stems by which spelling variants of the four reactions are told.
STEMS = {"laugh": "laugh", "smil": "smile", "groan": "groan", "silen": "silence"}
#: Judges whose parameters are sent to the tasks at most, 26 MB.
MAX_JUDGES = 200_000
#: Votes, and pairs of votes, that are worked on together in a task.
AT_ONCE, PAIRS_AT_ONCE = 200_000, 1_000_000
ITEM_RIDGE, JUDGE_RIDGE = 12.0, 0.5
OUTER, INNER = 10, 4
#: Two judges vote as one when, of the votes where one of them errs, the other makes the same error this
#: much more often than its own habits explain, and by so many standard deviations.
SAME_VOICE, SURE = 0.3, 5.0
#: Agreement beyond chance from which judges begin as one voice.
ALIKE = 0.7
#: Pairs of votes on common items below which two judges are not compared.
COMMON = 30


def clean_reaction(column) -> F.Column:
    letters = F.regexp_replace(F.lower(column), "[^a-z]", "")
    out = F.lit(None).cast("string")
    for stem, name in STEMS.items():
        out = F.when(letters.startswith(stem), name).otherwise(out)
    return out


def valid_votes(votes: DataFrame) -> DataFrame:
    """(item, judge_id, persona, reaction): one row per valid vote.

    A vote delivered again (same vote_id) counts once; votes without an id count once per distinct
    content. Failed votes (ok false), unreadable reactions and votes without an item are left out.
    A missing judge is one unnamed judge, so such votes count together as one voice at most.
    """
    cols = [F.col("vote_id"), F.col("item"), F.coalesce("judge_id", F.lit("")).alias("judge_id"), F.col("persona"), clean_reaction(F.col("reaction")).alias("reaction")]
    good = votes.where("item is not null and coalesce(ok, true)").select(*cols).where("reaction is not null")
    named = good.where("vote_id is not null").groupBy("vote_id").agg(F.min(F.struct("item", "judge_id", "persona", "reaction")).alias("v")).select("v.*")
    return named.unionByName(good.where("vote_id is null").drop("vote_id").distinct())


def vote_table(votes: DataFrame, judges: list[str]) -> DataFrame:
    """One row per item: parallel arrays of judge number, label number and count, at most judges x labels long."""
    number = votes.sparkSession.createDataFrame([(j, i) for i, j in enumerate(judges)], "judge_id string, j int")
    label = F.array_position(F.array(*map(F.lit, REACTIONS)), F.col("reaction")).cast("int") - 1
    counts = votes.groupBy("item", "judge_id", "reaction").agg(F.count("*").cast("double").alias("n")).join(F.broadcast(number), "judge_id")
    cells = F.sort_array(F.collect_list(F.struct("j", label.alias("k"), "n")))
    return counts.groupBy("item").agg(cells.alias("c")).select("item", F.col("c.j").alias("j"), F.col("c.k").alias("k"), F.col("c.n").alias("n"))


class _Votes:
    """A batch of items: a cell per item and judge with the counts of the labels given, cells of an item side by side."""

    def __init__(self, pdf: pd.DataFrame):
        per_item = pdf["j"].map(len).to_numpy(np.int64)
        row = np.repeat(np.arange(len(pdf)), per_item)
        judge, label, count = (np.concatenate([np.asarray(x, t) for x in pdf[c]]) if len(pdf) else np.empty(0, t) for c, t in (("j", np.int64), ("k", np.int64), ("n", float)))
        first = np.r_[True, (row[1:] != row[:-1]) | (judge[1:] != judge[:-1])] if len(row) else np.empty(0, bool)
        self.counts = np.zeros((int(first.sum()), len(REACTIONS)))
        self.counts[np.cumsum(first) - 1, label] = count
        self.item, self.judge = row[first], judge[first]
        self.start = np.searchsorted(self.item, np.arange(len(pdf) + 1))

    def by_item(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.start[:-1], axis=0)

    def as_voices(self, voice: np.ndarray) -> np.ndarray:
        """The counts where judges who vote as one share one vote per item; voice < 0 marks independent judges."""
        out = self.counts.copy()
        of = voice[self.judge]
        bound = np.flatnonzero(of >= 0)
        if len(bound):
            _, group = np.unique(self.item[bound] * len(voice) + of[bound], return_inverse=True)
            total = np.bincount(group, out[bound].sum(axis=1))
            out[bound] /= np.maximum(total[group], 1.0)[:, None]
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells (x, y) of one item in every order, a cell with itself included, some at a time."""
        size = np.diff(self.start)[self.item]  # per cell, the cells of its item
        upto = np.cumsum(size)
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            x = np.repeat(np.arange(at, end), size[at:end])
            y = self.start[self.item[x]] + np.arange(len(x)) - np.repeat(upto[at:end] - size[at:end] - (upto[at - 1] if at else 0), size[at:end])
            yield x, y
            at = end


def _log_likelihood(sigma: np.ndarray, tau: np.ndarray) -> np.ndarray:
    z = sigma + tau
    z -= z.max(axis=2, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=2, keepdims=True))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _posterior(votes: _Votes, counts: np.ndarray, sigma: np.ndarray | None, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Label posteriors and, per cell, the log likelihoods of its judge's labels, items' parameters fitted here."""
    share = votes.by_item(counts)
    if sigma is None:
        return share / np.maximum(share.sum(axis=1, keepdims=True), 1e-12), None
    own, seen = sigma[votes.judge], counts.sum(axis=1)
    tau = np.zeros((len(share), len(REACTIONS), len(REACTIONS)))
    for step in range(INNER):
        ll = _log_likelihood(own, tau[votes.item])
        q = _softmax(np.log(prior)[None] + votes.by_item(np.einsum("ck,clk->cl", counts, ll)))
        if step == INNER - 1:
            break
        mass = votes.by_item(seen[:, None, None] * np.exp(ll))
        gradient = q[:, :, None] * (share[:, None, :] - mass) - ITEM_RIDGE * tau
        tau += gradient / (q[:, :, None] * mass + ITEM_RIDGE)
    return q, ll


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, _Votes]]:
    for pdf in frames:
        upto = np.cumsum(pdf["j"].map(len).to_numpy(np.int64))
        at = 0
        while at < len(pdf):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
            part = pdf.iloc[at:end]
            yield part, _Votes(part)
            at = end


def _gathered(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``values`` by key."""
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    stacked = np.concatenate(values)
    return distinct, np.stack([np.bincount(place, stacked[:, i], minlength=len(distinct)) for i in range(stacked.shape[1])], axis=1)


def _sums(table: DataFrame, judges: int, sigma, prior, voice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all items: the judges' gradient and curvature (or counts without sigma) and the label mass."""
    labels = len(REACTIONS)
    cells = labels**2

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values = [], []
        for _, votes in _batches(frames):
            counts = votes.as_voices(voice)
            q, ll = _posterior(votes, counts, sigma, prior)
            mine = q[votes.item]
            hits = np.einsum("cl,ck->clk", mine, counts)
            expected = np.zeros_like(hits) if sigma is None else np.einsum("cl,c,clk->clk", mine, counts.sum(axis=1), np.exp(ll))
            both = np.concatenate([(hits - expected).reshape(-1, cells), expected.reshape(-1, cells)], axis=1)
            mass = np.zeros((1, 2 * cells))
            mass[0, :labels] = q.sum(axis=0)
            k, v = _gathered([votes.judge, np.array([-1])], [both, mass])
            keys.append(k)
            values.append(v)
        if keys:
            k, v = _gathered(keys, values)
            yield pd.DataFrame({"j": k, "x": list(v)})

    rows = table.mapInPandas(fold, "j long, x array<double>").groupBy("j").agg(*(F.sum(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(2 * cells)))
    g, h, mass = np.zeros((judges, labels, labels)), np.zeros((judges, labels, labels)), np.zeros(labels)
    for j, *x in rows.collect():  # a row per judge
        if j < 0:
            mass = np.array(x[:labels])
        else:
            g[j], h[j] = np.reshape(x[:cells], (labels, labels)), np.reshape(x[cells:], (labels, labels))
    return g, h, mass


def _paired(table: DataFrame, judges: int, names: list[str], measure) -> DataFrame:
    """(a, b, names): sums over all pairs of votes on an item, by the judges of the pair; ``measure(votes)`` gives a function of cells (x, y)."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values, held = [], [], 0
        for _, votes in _batches(frames):
            of = measure(votes)
            for x, y in votes.pairs():
                k, v = _gathered([votes.judge[x] * judges + votes.judge[y]], [of(x, y)])
                keys.append(k)
                values.append(v)
                held += len(k)
                if held > PAIRS_AT_ONCE:
                    k, v = _gathered(keys, values)
                    yield pd.DataFrame({"a": k // judges, "b": k % judges, **dict(zip(names, v.T))})
                    keys, values, held = [], [], 0
        if keys:
            k, v = _gathered(keys, values)
            yield pd.DataFrame({"a": k // judges, "b": k % judges, **dict(zip(names, v.T))})

    rows = table.mapInPandas(fold, "a long, b long, " + ", ".join(f"{n} double" for n in names))
    return rows.groupBy("a", "b").agg(*(F.sum(n).alias(n) for n in names))


def _shared_errors(table: DataFrame, judges: int, sigma, prior, voice) -> list[tuple[int, int]]:
    """(a, b), a <= b: judges who make the same error so much more often than their habits explain that they count as one voice.

    (a, a) is a judge whose repeated votes on an item depend on each other so.
    """
    base = np.exp(_log_likelihood(sigma, np.zeros((1, 1, 1))))

    def measure(votes: _Votes):
        n = votes.counts
        q, _ = _posterior(votes, votes.as_voices(voice), sigma, prior)
        w = q[votes.item]
        seen = n.sum(axis=1)
        missed = seen - (w * n).sum(axis=1)

        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            rate = base[votes.judge[y]]
            same = (n[x] * n[y]).sum(axis=1) - (w[x] * n[x] * n[y]).sum(axis=1)
            apart = np.einsum("pl,pk,plk->p", w[x], n[x], rate) - np.einsum("pl,pl,pll->p", w[x], n[x], rate)
            self_ = x == y  # a vote is no partner of itself
            return np.stack([same - self_ * missed[x], missed[x] * seen[y] - self_ * missed[x], apart * (seen[y] - self_)], axis=1)

        return of

    sums = _paired(table, judges, ["same", "either", "chance"], measure)
    more = F.col("same") - F.col("chance")
    strong = sums.where((more > SURE * F.sqrt(F.greatest("chance", F.lit(1.0)))) & (more / F.greatest("either", F.lit(1e-9)) > SAME_VOICE)).select("a", "b")
    both = strong.join(strong.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").where("a <= b")
    return sorted((r["a"], r["b"]) for r in both.collect())  # judges who vote as one


def _first_voices(table: DataFrame, votes: DataFrame, names: list[str]) -> np.ndarray:
    """Groups of judges who agree among themselves beyond their habits, as Cohen's kappa, and with nobody else; nothing is known of the labels yet.

    Good judges who agree also agree, less so, with mediocre ones; a choir has no such ties.
    """
    judges = len(names)
    number = {name: i for i, name in enumerate(names)}
    habit = np.zeros((judges, len(REACTIONS)))
    for r in votes.groupBy("judge_id", "reaction").count().collect():  # a row per judge and reaction
        habit[number[r["judge_id"]], REACTIONS.index(r["reaction"])] = r["count"]
    habit /= np.maximum(habit.sum(axis=1, keepdims=True), 1)
    habits = table.sparkSession.createDataFrame([(i, h.tolist()) for i, h in enumerate(habit)], "j long, h array<double>")

    def measure(votes: _Votes):
        n, seen = votes.counts, votes.counts.sum(axis=1)
        return lambda x, y: np.stack([(n[x] * n[y]).sum(axis=1), seen[x] * seen[y]], axis=1)

    met = _paired(table, judges, ["same", "pairs"], measure).where((F.col("a") < F.col("b")) & (F.col("pairs") >= COMMON))
    side = lambda c, out: F.broadcast(habits.select(F.col("j").alias(c), F.col("h").alias(out)))  # noqa: E731 - at most MAX_JUDGES rows
    chance = F.aggregate(F.zip_with("ha", "hb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    kappa = (F.col("same") / F.col("pairs") - chance) / F.greatest(1 - chance, F.lit(1e-9))
    known = materialize(met.join(side("a", "ha"), "a").join(side("b", "hb"), "b").select("a", "b", kappa.alias("kappa")), "alike")
    edges = [(r["a"], r["b"]) for r in known.where(F.col("kappa") > ALIKE).collect()]  # judges who agree nearly always
    voice = _group_voices(judges, edges)
    members = known.sparkSession.createDataFrame([(i,) for i in np.flatnonzero(voice >= 0).tolist()], "m long")
    near = known.join(F.broadcast(members), (F.col("a") == F.col("m")) | (F.col("b") == F.col("m")), "left_semi").collect()  # pairs of these judges
    for g in set(voice[voice >= 0].tolist()):
        who = voice == g
        inside = 2 * sum(r["kappa"] for r in near if who[r["a"]] and who[r["b"]]) / (who.sum() * (who.sum() - 1))
        if max((abs(r["kappa"]) for r in near if who[r["a"]] != who[r["b"]]), default=0.0) > inside / 2:
            voice[who] = -1
    return voice


def _group_voices(judges: int, edges: list[tuple[int, int]]) -> np.ndarray:
    """The least judge of everyone's union by ``edges``; a judge in no union is -1, or a voice of its own with an edge to itself."""
    root = list(range(judges))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    groups = np.array([find(x) for x in range(judges)], dtype=np.int64)
    bound = np.zeros(judges, bool)
    for a, b in edges:
        bound[a] = bound[b] = True
    return np.where(bound, groups, -1)


class Consensus:
    """The fitted model of a table of votes: ``labels()``, ``judges()`` and ``agreement()``."""

    def __init__(self, votes: DataFrame):
        self.votes = materialize(valid_votes(votes), "votes")
        self.names = [r[0] for r in self.votes.select("judge_id").distinct().orderBy("judge_id").limit(MAX_JUDGES + 1).collect()]
        if len(self.names) > MAX_JUDGES:
            raise ValueError(f"more than {MAX_JUDGES} judges; raise MAX_JUDGES if the tasks can hold their parameters")
        self.table = materialize(vote_table(self.votes, self.names), "items")
        self._fit()

    def _fit(self) -> None:
        judges, labels = len(self.names), len(REACTIONS)
        self.voice = np.full(judges, -1)
        self.sigma = np.zeros((judges, labels, labels))
        self.prior = np.full(labels, 1 / labels)
        if not judges:
            return
        # lest a choir pass for the truth; the fit then tells shared errors from being right together
        self.voice = _first_voices(self.table, self.votes, self.names)
        for _ in range(4):
            self._ascend(judges)
            voice = _group_voices(judges, _shared_errors(self.table, judges, self.sigma, self.prior, self.voice))
            if (voice == self.voice).all():
                break
            self.voice = voice

    def _ascend(self, judges: int) -> None:
        counts, _, mass = _sums(self.table, judges, None, self.prior, self.voice)
        self.sigma = np.log((counts + 0.5) / (counts + 0.5).sum(axis=2, keepdims=True))
        self.prior = (mass + 1) / (mass + 1).sum()
        for _ in range(OUTER):
            g, h, mass = _sums(self.table, judges, self.sigma, self.prior, self.voice)
            # bounded curvature makes the step an ascent; the factor speeds up the near-flat directions
            step = (g - JUDGE_RIDGE * 0.05 * self.sigma) / (h + JUDGE_RIDGE)
            self.sigma = self.sigma + np.clip(1.5 * step, -1.0, 1.0)
            self.prior = (mass + 1) / (mass + 1).sum()
            if np.abs(step).max() < 0.02:
                break

    def labels(self) -> DataFrame:
        """(item, reaction, confidence, n_votes): ties go to the reaction named first in REACTIONS."""
        sigma, prior, voice = self.sigma, self.prior, self.voice

        def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf, votes in _batches(frames):
                q, _ = _posterior(votes, votes.as_voices(voice), sigma, prior)
                cast = votes.by_item(votes.counts).sum(axis=1).astype("int64")
                yield pd.DataFrame({"item": pdf["item"].to_numpy(), "reaction": np.array(REACTIONS)[q.argmax(axis=1)], "confidence": q.max(axis=1), "n_votes": cast})

        return self.table.mapInPandas(judge, "item string, reaction string, confidence double, n_votes long")

    def judges(self) -> DataFrame:
        """(judge_id, reliability, accuracy, voice): reliability is the share of the label's entropy a vote removes."""
        spark = self.votes.sparkSession
        schema = "judge_id string, reliability double, accuracy double, voice string"
        rows = []
        for i, name in enumerate(self.names):
            p = np.exp(self.sigma[i] - self.sigma[i].max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            joint = self.prior[:, None] * p
            column = joint.sum(axis=0)
            info = float((joint * np.log(joint / (self.prior[:, None] * column[None]))).sum())
            entropy = float(-(self.prior * np.log(self.prior)).sum())
            rows.append((name, info / entropy, float((self.prior * np.diag(p)).sum()), self.names[self.voice[i]] if self.voice[i] >= 0 else name))
        return spark.createDataFrame(rows, schema)

    def agreement(self) -> DataFrame:
        """(n_items, n_votes, observed, expected, alpha): Krippendorff's nominal alpha over items with two votes or more."""
        counts = self.votes.groupBy("item", "reaction").agg(F.count("*").cast("double").alias("n"))
        total = counts.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
        pairable = counts.join(total.select("item", "m"), "item").groupBy("reaction").agg(F.sum("n").alias("n"))
        seen = total.agg(F.count("*").alias("n_items"), F.sum("m").alias("n_votes"), F.sum(F.col("same") / (F.col("m") - 1)).alias("agree"))
        chance = pairable.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("by_chance"))
        both = seen.crossJoin(chance)  # two single rows
        observed, expected = F.col("agree") / F.col("n_votes"), F.try_divide("by_chance", F.col("n_votes") * (F.col("n_votes") - 1))
        return both.select("n_items", F.col("n_votes").cast("long").alias("n_votes"), observed.alias("observed"), expected.alias("expected"), F.try_divide(observed - expected, 1 - expected).alias("alpha"))
