import random

import numpy as np

from quipwright.llm import spans as sp

SCHEMA = "doc_id long, text string, m long, s string, at int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], SCHEMA)


def brute(rows, length=200):
    owner = {}
    for i, t in rows:
        for o in range(len(t or "") - length + 1):
            owner.setdefault(t[o : o + length], set()).add(i)
    out = {}
    for i, t in rows:
        hit = bytearray(len(t or ""))
        for o in range(len(t or "") - length + 1):
            if i is not None and len(owner[t[o : o + length]] - {None}) > 1:
                hit[o : o + length] = b"\1" * length
        if any(hit):
            out[i] = sum(hit)
    return out


def words(rng, n, alphabet="abcdefghij klmnopqrst"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_against_all_windows(spark):
    rng = random.Random(5)
    shared = [words(rng, n) for n in (199, 200, 201, 450, 1000)]
    rows = [(i, words(rng, rng.randrange(0, 900)) + (shared[i % 5] if i < 25 else "") + words(rng, rng.randrange(0, 300), "äöü 漢字𝐱")) for i in range(40)]
    rows += [(100, shared[3] * 2), (101, "z" * 1500), (102, "z" * 700), (103, "z" * 199), (104, ""), (105, rows[3][1]), (106, rows[3][1][50:260])]
    expected = brute(rows)
    found = {r["doc_id"] for r in sp.documents_with_shared_span(table(spark, rows)).collect()}
    assert found == set(expected)
    part = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in sp.shared_part(table(spark, rows)).collect()}
    assert part == {i: (len(t), expected.get(i, 0)) for i, t in rows}
    text = dict(rows)
    for r in sp.shared_spans(table(spark, rows)).collect():
        assert r["end"] - r["start"] >= 200 and any(text[r["doc_id"]][r["start"] : r["start"] + 200] in t for i, t in rows if i != r["doc_id"])


def test_repeats_inside_one_document_do_not_count(spark):
    rng = random.Random(6)
    run = words(rng, 300)
    assert sp.documents_with_shared_span(table(spark, [(1, run + "x" + run), (1, run), (2, words(rng, 900))])).count() == 0


def test_nothing_is_normalised(spark):
    rng = random.Random(7)
    run = words(rng, 260)
    assert sp.documents_with_shared_span(table(spark, [(1, run), (2, run.upper()), (3, run.replace(" ", "  "))])).count() == 0


def test_nulls_and_empty(spark):
    assert sp.documents_with_shared_span(table(spark, [(None, "a" * 300), (1, None), (2, "a" * 300)])).count() == 0
    assert sp.documents_with_shared_span(table(spark, [])).count() == 0 and sp.shared_part(table(spark, [])).count() == 0


def test_a_text_longer_than_a_piece():
    rng = np.random.default_rng(0)
    points = rng.integers(97, 123, (1 << 20) + 5000).astype(np.uint32)
    least, first, n = sp.super_kmers(points)
    assert first[0] == 0 and n.sum() == len(points) - 199 and (np.diff(first) == n[:-1]).all()
    tail = sp.super_kmers(points[(1 << 20) - 3000 :])[0]
    assert set(tail[1:].tolist()) <= set(least.tolist())


def test_a_full_filter_costs_no_result(spark, monkeypatch):
    monkeypatch.setattr(sp, "LEAST_BITS", 6)
    monkeypatch.setattr(sp, "MOST_BITS", 6)
    rng = random.Random(8)
    run = words(rng, 240)
    rows = [(i, words(rng, 700)) for i in range(30)] + [(90, run + words(rng, 50)), (91, words(rng, 80) + run)]
    assert {r["doc_id"] for r in sp.documents_with_shared_span(table(spark, rows)).collect()} == {90, 91}


def test_a_filter_reaches_the_driver_as_bytes(spark, monkeypatch):
    """Its bits are those of all keys, and the driver holds little more than them: not an object for every word of them."""
    import tracemalloc

    monkeypatch.setattr(sp, "PIECE_BITS", 12, raising=False)
    monkeypatch.setattr(sp, "PIECES", 512, raising=False)
    entries = spark.range(200_000).selectExpr("xxhash64(id) m")
    tracemalloc.start()
    found = sp._filter(entries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keys = np.array([r["m"] for r in entries.collect()], np.int64).view(np.uint64)
    bits = np.zeros(len(found) * 64, bool)
    bits[(keys & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    assert np.array_equal(np.packbits(bits, bitorder="little").view(np.uint64), found)
    assert len(found) == 1 << 17 and peak < 12e6
