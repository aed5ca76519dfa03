import random

import pytest

from quipwright.llm import splits as sp

SCHEMA = "id string, is_genuine int, control_type string, setup_key string, author_key string, usage string, component string, u string"


@pytest.fixture(autouse=True, params=["rounds", "tail"])
def tail(request, monkeypatch):
    """Every test once with all rounds as joins and once with the small rest in one task."""
    monkeypatch.setattr(sp, "TAIL", 0 if request.param == "rounds" else 10_000)


def table(spark, rows):
    return spark.createDataFrame([(i, 1, None, s, a, u, "clash", "clash") for i, s, a, u in rows], SCHEMA)


def brute(rows):
    """component of every row, by union-find"""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    clean = lambda v: (v or "").strip().lower() or None
    names = []
    for n, (i, s, a, _) in enumerate(rows):
        own = ("i", i) if i is not None else ("r", n)
        names.append(own)
        for kind, v in (("s", clean(s)), ("a", clean(a) if (clean(a) or "").startswith("au_") else None)):
            if v:
                root[find(own)] = find((kind, v))
    return [find(x) for x in names]


def torn(rows):
    use = {}
    for c, (_, _, _, u) in zip(brute(rows), rows):
        if u and u.strip():
            use.setdefault(c, set()).add(u.strip().lower())
    return {i for c, (i, *_) in zip(brute(rows), rows) if i is not None and len(use.get(c, ())) > 1}


def test_chain_across_ids_setups_and_authors(spark):
    rows = [("1", "S", "au_x", "Public"), ("2", " s ", None, None), ("2", "t", "AU_Y ", None), ("3", None, "au_y", "private "), ("4", "z", "anon", "public"), ("5", "w", "anon", "private")]
    assert {r["id"] for r in sp.torn_groups(table(spark, rows)).collect()} == {"1", "2", "3"} == torn(rows)


def test_random_tables_against_union_find(spark):
    rng = random.Random(3)
    for n in (40, 300):
        pick = lambda kind, k: rng.choice([None, "", f"{kind}{rng.randrange(k)}", f" {kind.upper()}{rng.randrange(k)}"])
        rows = [(rng.choice([None, f"id{rng.randrange(n)}"]), pick("s", n), rng.choice(["anon", None, f"au_{rng.randrange(n)}"]), pick("u", 2)) for _ in range(n)]
        rows += rows[:5]
        assert {r["id"] for r in sp.torn_groups(table(spark, rows)).collect()} == torn(rows)


def test_a_hot_key_and_a_long_chain(spark):
    rows = [(f"h{i}", "hot", None, "public") for i in range(400)] + [(f"c{i}", f"k{i}", f"au_{i + 1}", None) for i in range(60)] + [(f"d{i}", f"k{i + 1}", f"au_{i + 1}", "public" if i else "private") for i in range(60)]
    assert {r["id"] for r in sp.torn_groups(table(spark, rows)).collect()} == torn(rows)


def test_splits_hold_components_and_proportions(spark):
    rows = [(f"i{i}", f"s{i // 3}", None, None) for i in range(3000)] + [(f"h{i}", "hot", None, None) for i in range(600)] + [(f"h{i}", "hot", None, None) for i in range(9)]
    out = sp.split_records(table(spark, rows), {"train": 0.7, "validation": 0.2, "test": 0.1}).collect()
    assert len(out) == len({r["id"] for r in out}) == 3600
    by = {}
    for r in out:
        by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    share = {s: sum(r["split"] == s for r in out) / 3600 for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["test"] - 0.1) < 0.03


def test_empty_table(spark):
    assert sp.torn_groups(table(spark, [])).count() == 0 and sp.split_records(table(spark, [])).count() == 0


def test_nulls_everywhere(spark):
    rows = [(None, None, None, None)] * 3 + [("1", None, None, None)]
    assert sp.torn_groups(table(spark, rows)).count() == 0
    assert [r["id"] for r in sp.split_records(table(spark, rows)).collect()] == ["1"]
