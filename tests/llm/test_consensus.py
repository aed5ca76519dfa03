import random

from quipwright.llm.consensus import Consensus, REACTIONS

SCHEMA = "vote_id long, item string, judge_id string, persona string, scores map<string,double>, reaction string, ok boolean, error string, j int, reaction_ string"


def table(spark, rows):
    return spark.createDataFrame([(v, i, j, None, None, r, ok, None, 1, "clash") for v, i, j, r, ok in rows], SCHEMA)


def simulate(n=250, seed=2):
    rng = random.Random(seed)
    good, bad = [f"good{i}" for i in range(4)], [f"coin{i}" for i in range(3)]
    rows, truth, vote = [], {}, 0
    for n_ in range(n):
        item, y = f"item{n_}", rng.choice(REACTIONS)
        truth[item] = y
        parrot = rng.choice(REACTIONS)
        for judge in rng.sample(good, 3) + rng.sample(bad, 2) + [f"parrot{i}" for i in range(4)] + ["contrary"]:
            if judge.startswith("good"):
                r = y if rng.random() < 0.8 else rng.choice(REACTIONS)
            elif judge.startswith("coin"):
                r = rng.choice(REACTIONS)
            elif judge == "contrary":
                r = REACTIONS[(REACTIONS.index(y) + 1) % 4] if rng.random() < 0.9 else y
            else:
                r = parrot if rng.random() < 0.95 else rng.choice(REACTIONS)
            rows.append((vote, item, judge, rng.choice([r, r.upper() + "!", f" {r} "]), True))
            vote += 1
    return rows, truth


def test_reliable_judges_outweigh_a_choir(spark):
    rows, truth = simulate()
    model = Consensus(table(spark, rows + rows[:50]))
    found = {r["item"]: r["reaction"] for r in model.labels().collect()}
    right = sum(found[i] == y for i, y in truth.items()) / len(truth)
    votes = {}
    for _, i, _, r, _ in rows:
        votes.setdefault(i, []).append(r.strip(" !").lower())
    majority = sum(max(REACTIONS, key=v.count) == truth[i] for i, v in votes.items()) / len(truth)
    assert right > 0.9 > majority
    judges = {r["judge_id"]: r for r in model.judges().collect()}
    assert len({judges[f"parrot{i}"]["voice"] for i in range(4)}) == 1 and judges["good0"]["voice"] == "good0"
    assert judges["contrary"]["reliability"] > judges["coin0"]["reliability"] and judges["contrary"]["accuracy"] < 0.3
    agreement = model.agreement().first()
    assert agreement["n_items"] == len(truth) and -1 <= agreement["alpha"] <= 1


def test_dirt(spark):
    rows = [(1, "a", "j", "Laughs", True), (1, "a", "j", "Laughs", True), (2, "a", "k", "", False), (3, "b", "j", None, True), (4, None, "j", "smile", True), (5, "c", None, "groan...", None), (None, "d", "j", "silent.", True), (6, "e", "j", "smile", False)]
    found = {r["item"]: (r["reaction"], r["n_votes"]) for r in Consensus(table(spark, rows)).labels().collect()}
    assert found == {"a": ("laugh", 1), "c": ("groan", 1), "d": ("silence", 1)}


def test_empty(spark):
    model = Consensus(table(spark, []))
    assert model.labels().count() == 0 and model.judges().count() == 0 and model.agreement().first()["n_items"] == 0


def test_ties_are_settled_alike(spark):
    rows = [(1, "a", "j", "silence", True), (2, "a", "k", "laugh", True)]
    results = {tuple(sorted((r["item"], r["reaction"]) for r in Consensus(table(spark, order)).labels().collect())) for order in (rows, rows[::-1])}
    assert len(results) == 1


def test_pairs_of_cells_in_pieces(monkeypatch):
    import pandas as pd

    from quipwright.llm import consensus as co

    monkeypatch.setattr(co, "PAIRS_AT_ONCE", 5)
    votes = co._Votes(pd.DataFrame({"j": [[0, 0, 2], [1], [0, 1, 2, 3]], "k": [[0, 1, 0], [2], [0, 1, 2, 3]], "n": [[1.0, 2.0, 1.0], [1.0], [1.0] * 4]}))
    assert votes.counts[0].tolist() == [1.0, 2.0, 0.0, 0.0] and votes.judge.tolist() == [0, 2, 1, 0, 1, 2, 3]
    got = sorted((int(a), int(b)) for x, y in votes.pairs() for a, b in zip(x, y))
    assert got == sorted((a, b) for a in range(7) for b in range(7) if votes.item[a] == votes.item[b])


def test_many_judges_with_few_votes(spark):
    rows = [(n, f"i{n % 40}", f"j{n}", "laugh" if n % 3 else "groan", True) for n in range(1600)]
    model = Consensus(table(spark, rows))
    assert {r["reaction"] for r in model.labels().collect()} == {"laugh"} and model.judges().count() == 1600
