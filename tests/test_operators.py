import math
import random

import numpy as np
from hypothesis import given, settings, strategies as hs
from pyspark.sql import functions as F

from quipwright.functions import ratings as rt, rights, text as tx, vectors as vx
from quipwright.operators import corpus as op, models, ranks, ratings, resample, retrieval, validate
from quipwright.sources.generators import control_rows


def one(spark, column, *values):
    names = ["a", "b", "c"][: len(values)]
    return spark.createDataFrame([tuple(values)], names).select(column.alias("x")).first()["x"]


def test_edits_are_literal(spark):
    assert one(spark, tx.apply_edit(F.col("a"), F.col("b")), "pay <ten/> now", "$5 \\ x") == "pay $5 \\ x now"
    assert one(spark, tx.marked_word(F.col("a")), "pay <ten/> now") == "ten" and one(spark, tx.unmark(F.col("a")), "pay <ten/> now") == "pay ten now"


def test_min_chars_by_script(spark):
    assert one(spark, tx.screen(F.col("a")), "笑う話") and not one(spark, tx.screen(F.col("a")), "short") and not one(spark, tx.screen(F.col("a"), "бомба"), "Длинная БОМБА здесь")


def test_licences_deny_first(spark):
    cases = {"CC BY; do not redistribute": "research_only", "CC BY-NC 4.0": "noncommercial", "Public  domain": "redistributable", "": "unclassified"}
    for text, name in cases.items():
        assert one(spark, rights.licence_class(F.col("a")), text) == name


def test_water_fill():
    assert op.water_fill([5, 100, 100], 65) == [5, 30, 30] and op.water_fill([1, 1], 9) == [1, 1] and op.water_fill([9, 9, 9], 10) == [4, 3, 3] and op.water_fill([], 3) == []


@settings(max_examples=30, deadline=None)
@given(hs.lists(hs.integers(0, 50), max_size=8), hs.integers(0, 300))
def test_water_fill_spends_what_it_can(available, budget):
    got = op.water_fill(available, budget)
    assert sum(got) == min(budget, sum(available)) and all(0 <= g <= a for g, a in zip(got, available))


def brute_auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_auc_with_ties_and_extremes(spark):
    rng = random.Random(1)
    for rows in ([(rng.randrange(6) / 2, rng.random() < 0.4) for _ in range(200)], [(1.0, True), (1.0, False)], [(2.0, True)], [(3.0, True), (1.0, False)]):
        found = ranks.auc(spark.createDataFrame([(float(s), bool(y)) for s, y in rows], "s double, y boolean"), "s", "y").first()
        expected = brute_auc(rows)
        assert found["auc"] is None if expected is None else math.isclose(found["auc"], expected)


def test_spearman_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)] + [("b", float(i), float(-i)) for i in range(4)] + [("c", 1.0, 2.0)], "g string, x double, y double")
    assert {r["g"]: round(r["rho"], 9) for r in ranks.spearman(df, "x", "y", "g").collect()} == {"a": 0.0, "b": -1.0, "c": 0.0}


def test_adjusted_p(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    found = {r["p"]: round(r["q"], 9) for r in ranks.adjust_p(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect()}
    assert found == {0.005: 0.02, 0.01: 0.02, 0.03: 0.04, 0.04: 0.04}


def test_latest_wins_keeps_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", None, "z")], "k string, t int, v string")
    assert {(r["k"], r["v"]) for r in op.latest_wins(df, ["k"], F.col("t")).collect()} == {("a", "y"), ("b", "z")}


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([(i, 0 if i < 7 else 1) for i in range(10)], "i int, g int")
    assert [(r["turn"], r["band"]) for r in op.round_robin(df, F.col("g"), 4, "i").collect()] == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_rolling_median_even_and_odd(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 4, 2])], "i int, v double")
    assert [r["median"] for r in op.rolling_median(df, "v", ["i"], 3, 2).orderBy("i").collect()] == [None, 3.0, 4.0, 2.0]


def test_convergence_and_pairs(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", 3.0)], "dim string, s double")
    row = ratings.convergence(df, "dim", "s").first()
    assert (row["spread"], row["convergence"]) == (1.0, 0.8)
    pairs = spark.createDataFrame([(1, "c", 1.0), (1, "t", 3.0), (2, "c", 5.0), (3, "t", 1.0)], "b int, arm string, v double")
    assert [(r["b"], r["effect"]) for r in ratings.paired_effect(pairs, ["b"], "arm", "v", "c", "t").collect()] == [(1, 2.0)]


def test_elo_follows_the_order(spark):
    rows = [("g", i, "a", "b", w) for i, w in enumerate(["a", "b", "b", None])]
    schema = "g string, seq int, left_id string, right_id string, winner_id string"
    ra = rb = 1000.0
    for w in ("a", "b", "b", None):
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        gain = 24 * ({"a": 1.0, "b": 0.0, None: 0.5}[w] - e)
        ra, rb = ra + gain, rb - gain
    for order in (rows, rows[::-1]):
        found = {r["candidate"]: r["elo"] for r in ratings.elo(spark.createDataFrame(order, schema), "g").collect()}
        assert math.isclose(found["a"], ra) and math.isclose(found["b"], rb)


def test_hash_vectors_and_strict_cosine(spark):
    v = vx.hash_vector("the cat sat", 32)
    assert math.isclose(sum(x * x for x in v), 1.0) and vx.hash_vector("", 8) == [0.0] * 8
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert math.isclose(df.select(vx.cosine_strict("a", "b")).first()[0], math.sqrt(0.5))
    assert spark.createDataFrame([([1.0], [1.0, 1.0])], "a array<double>, b array<double>").select(vx.cosine("a", "b")).first()[0] == 0.0


def test_near_hashes_against_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(30)]
    rows = [(i, b ^ sum(1 << rng.randrange(63) for _ in range(i % 5))) for i, b in enumerate(base * 3)]
    found = {(r["a"], r["b"]): r["distance"] for r in retrieval.near_hashes(spark.createDataFrame(rows, "id int, h long"), "id", "h", 7).collect()}
    mask = (1 << 64) - 1
    assert found == {(i, j): d for i, x in rows for j, y in rows if i < j and (d := ((x ^ y) & mask).bit_count()) <= 7}


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    w, c = models.ridge(df, ["a", "b"], "y", 0.5)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    assert np.allclose(w, np.linalg.solve(xc.T @ xc + 0.5 * np.eye(2), xc.T @ yc)) and math.isclose(c, y.mean() - x.mean(axis=0) @ w)
    assert models.ridge(df.limit(0), ["a", "b"], "y") == ([0.0, 0.0], 0.0)


def test_resampling_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("a" if i % 2 else "b", i, float(i * 37 % 11)) for i in range(60)], "g string, i int, v double")
    for f in (lambda d: resample.bootstrap(d, ["g"], "v", "i", replicates=200), lambda d: resample.permutation(d, ["g"], "i", "v", "i", 100), lambda d: resample.sign_flip(d, ["g"], "v", "i", 100)):
        assert sorted(map(tuple, f(df.repartition(1)).collect())) == sorted(map(tuple, f(df.repartition(7)).collect()))
    row = resample.bootstrap(df, ["g"], "v", "i", replicates=200).first()
    assert row["low"] <= row["estimate"] <= row["high"]


def test_split_half_of_clear_votes(spark):
    df = spark.createDataFrame([("c", i, 5 * (10 - i), 5, 5 * i) for i in range(10)], "g string, i int, a int, b int, c int")
    assert resample.split_half(df, ["g"], ["a", "b", "c"], "i", 10).first()["reliability"] > 0.9


def test_problems_and_zones(spark):
    df = spark.createDataFrame([(1, "2026-01-01T00:00:00Z"), (None, "2026-01-01T00:00:00")], "n int, t string")
    assert [r["problems"] for r in validate.problems(df, {"n": F.col("n") > 0, "zone": validate.is_zoned_time(F.col("t"))}).collect()] == [[], ["n", "zone"]]


def test_control_rows_are_a_function_of_their_parameters(spark):
    rows = control_rows(spark, 20, 3, 2)
    assert rows.count() == 20 * 3 * 4 * 2 == rows.select("item_id").distinct().count()
    assert op.split_leaks(rows, F.col("family_id"), "split").first()["leaking"] == 0
    assert rows.exceptAll(control_rows(spark, 20, 3, 2)).count() == 0


def test_entropy_and_conflict(spark):
    assert one(spark, rt.entropy(F.col("a"), F.col("b"), F.col("c")), 1.0, 1.0, 1.0) > 0.999999 and one(spark, rt.entropy(F.col("a"), F.col("b")), 0.0, 0.0) == 0.0
    assert one(spark, rt.conflict(F.col("a"), F.col("b"), F.col("c")), 1.0, 1.0, 2.0) == 1.0
