import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as hs

from quipwright.llm import mixing, packing
from quipwright.llm.tokens import encoder, with_token_counts
from quipwright.session import tokenizer_dir


@settings(max_examples=100, deadline=None)
@given(hs.lists(hs.integers(0, 50), max_size=60))
def test_best_fit_is_valid(sizes):
    place, fill = packing.best_fit(np.array(sizes, np.int64), 50)
    for box, total in enumerate(fill):
        assert sum(s for s, p in zip(sizes, place) if p == box) == total <= 50
    assert sum(f <= 25 for f in fill) <= 1  # two half-empty containers would have been one


def docs(spark, sizes):
    return spark.createDataFrame([(i, n, "clash", 1) for i, n in sizes], "doc_id long, n_tokens long, box string, size int").repartition(8)


def check(rows, capacity, sizes):
    boxes, pieces = {}, {}
    for r in rows:
        boxes.setdefault(r["container_id"], []).append(r)
        pieces.setdefault(r["doc_id"], []).append(r)
    for group in boxes.values():
        assert sum(r["n_tokens"] for r in group) == group[0]["container_tokens"] <= capacity
    for i, n in dict(sizes).items():
        parts = sorted(pieces[i], key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in parts) == (n or 0)
        assert len(parts) == 1 or n > capacity and all(r["n_tokens"] == capacity for r in parts[:-1])
    return len(boxes)


def test_containers(spark):
    rng = random.Random(1)
    sizes = [(i, int(rng.lognormvariate(4.5, 1.2))) for i in range(4000)] + [(9000, 2500), (9001, 512), (9002, 0), (9003, None), (9004, 1024)]
    rows = packing.pack(docs(spark, sizes), 512).collect()
    boxes = check(rows, 512, sizes)
    assert boxes <= 1.02 * -(-sum(n or 0 for _, n in sizes) // 512)


def test_rounds_join_the_underfull(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)
    sizes = [(i, 100 + i % 60) for i in range(500)]
    boxes = check(packing.pack(docs(spark, sizes), 1000).collect(), 1000, sizes)
    assert boxes <= 1.12 * sum(n for _, n in sizes) / 1000


def test_many_open_containers_stay_full(spark):
    """200,000 open containers of uniform size: far more than one group holds."""
    from pyspark.sql import functions as F

    boxes = spark.range(200_000).select(F.concat(F.lit("0."), F.col("id")).alias("box"), (1 + F.pmod(F.xxhash64("id"), F.lit(2000))).alias("size"))
    ended = packing.join_boxes(boxes, 2048).groupBy("into").agg(F.max("into_size").alias("t"), F.count("*").alias("n")).agg(F.sum("t"), F.count("*"), F.sum("n")).first()
    total = boxes.groupBy().sum("size").first()[0]
    assert ended[0] == total and ended[2] == 200_000 and total / (ended[1] * 2048) >= 0.99


def test_repeated_and_null_ids_are_items(spark):
    rows = packing.pack(docs(spark, [(1, 30), (1, 30), (None, 30), (2**60 + 1, 30)]), 100).collect()
    assert len(rows) == 4 and {r["doc_id"] for r in rows} == {1, None, 2**60 + 1}


def test_empty_and_bad_capacity(spark):
    assert packing.pack(docs(spark, []), 10).count() == 0 and packing.packing_report(packing.pack(docs(spark, []), 10), 10).first()["containers"] == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), 0)


def test_token_counts(spark):
    texts = ["", None, "Hello world", "x" * 50000, "naïve 漢字 \U0001f600", "<|endoftext|>"]
    rows = with_token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    encode = encoder(tokenizer_dir()).encode_ordinary
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}


def test_budgets():
    assert mixing.budgets({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 1)}) == {"a": 100, "b": 100}
    assert mixing.budgets({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3), "c": (0.2, 9)}, 500) == {"a": 470, "b": 30, "c": 0}
    assert mixing.budgets({}, {"a": (1.0, 1)}) == {"a": 0.0}


def mix(spark, counts, targets, **more):
    rng = random.Random(2)
    rows = [(n * 10000 + i, " ".join(["word"] * rng.randrange(1, 40)), s, float(1 + i % 3), 0.5) for n, (s, k) in enumerate(counts.items()) for i in range(k)]
    rows += [(None, "no id", next(iter(counts), "a"), 1.0, 0.5), (99999999, None, next(iter(counts), "a"), 1.0, 0.5), (88888888, "no source", None, 1.0, 0.5)]
    documents = spark.createDataFrame(rows if counts else [], "doc_id long, text string, source string, w double, target_share double")
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.Mix(documents, wanted, **more)


def test_shares_and_repeats(spark):
    m = mix(spark, {"a": 800, "b": 300, "c": 12, "d": 50}, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.1, 4), (None, 0.1, 1)], total=9000)
    rows = m.rows().collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(1 <= r["copies"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] for r in rows)
    report = {r["source"]: r for r in m.report().collect()}
    assert report["c"]["tokens"] == 3 * report["c"]["held_tokens"] and report["c"]["short"] and report["gone"]["tokens"] == 0
    for s in "ab":
        assert abs(report[s]["tokens"] - m.budget[s]) <= 40
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9


def test_weights_change_the_odds(spark):
    m = mix(spark, {"a": 1500}, [("a", 1.0, 2)], total=12000, weight="w")
    used = {0: 0, 1: 0, 2: 0}
    for r in m.rows().collect():
        used[r["doc_id"] % 3] += r["copies"]
    assert used[0] < used[1] < used[2] and abs(m.report().first()["tokens"] - 12000) < 200


def test_inclusion_goes_by_tokens(spark):
    """By default the longer half of a source is drawn more often, each document at most once beyond the whole copies."""
    m = mix(spark, {"a": 1200}, [("a", 1.0, 3)], total=0.3 * 1200 * 20)
    rows = {r["doc_id"]: r for r in m.rows().collect()}
    held = {r["doc_id"]: r["n_tokens"] for r in m.docs.collect()}
    drawn = {half: sum(i in rows for i, n in held.items() if (n > 20) == half) / sum((n > 20) == half for n in held.values()) for half in (False, True)}
    assert drawn[True] > 1.8 * drawn[False] and all(r["copies"] == 1 for r in rows.values())
    assert abs(sum(r["n_tokens"] for r in rows.values()) - m.budget["a"]) <= 40
    # the probabilities add up to the budget
    expected = sum(min(1.0, m.factor["a"] * n) * n for n in held.values())
    assert abs(expected - m.budget["a"]) < 0.03 * m.budget["a"]


def test_the_same_rows_every_time(spark):
    a, b = (sorted(map(tuple, mix(spark, {"a": 200, "b": 100}, [("a", 0.5, 1), ("b", 0.5, 2)], total=2500).rows().collect())) for _ in range(2))
    assert a == b


def test_empty_mix(spark):
    assert mix(spark, {}, [("a", 1.0, 1)]).rows().count() == 0 and mix(spark, {"a": 3}, []).rows().count() == 0
