import pytest
from pyspark.sql import functions as F

from quipwright.functions import scores as sc
from quipwright.operators import assembly as am, bundles
from quipwright.sources import generators


def test_graded_pairs(spark):
    rows = [(1, "The <old/> dog", "new", "blue", 1.0, 2.0), (2, "A <b/> c", "x", "y", 1.0, 1.0), (3, "no mark", "x", "y", 1.0, 2.0), (4, "A <b/> c", "x", "y", None, 2.0)]
    singles, pairs = am.graded_pairs(spark.createDataFrame(rows, "k int, t string, e1 string, e2 string, g1 double, g2 double"), "k", "t", ("e1", "e2"), ("g1", "g2"))
    assert {tuple(r) for r in pairs.collect()} == {(1, "b")} and singles.count() == 5
    assert {tuple(r) for r in singles.where("k = 1").collect()} == {(1, "a", "The", "new dog", 1.0), (1, "b", "The", "blue dog", 2.0)}


def test_screened_candidates(spark):
    rows = [(i, "dry", f"A setup of fair length {i}", "and a turn") for i in range(3)] + [(9, "dry", "A SETUP of fair length 1", "and a turn"), (10, "wet", "Another setup of length", "its turn"), (11, None, "Another setup of length", "its turn"), (12, "dry", "short", "x")]
    got = am.screened_candidates(spark.createDataFrame(rows, "i int, style string, s string, p string"), "s", "p", "style", 2, "i")
    assert sorted(r["i"] for r in got.collect()) == [0, 1, 2]


def test_timed_beats(spark):
    script = "HOOK: one two three four five [a door]\nBUILD: six\nSNAP: seven eight"
    rows = am.timed_beats(spark.createDataFrame([(1, script), (2, "nothing"), (3, None)], "k int, t string"), "k", "t").orderBy("position").collect()
    assert [(r["beat"], r["said"], r["visual"], r["begins"], r["ends"]) for r in rows] == [
        ("HOOK", "one two three four five", "a door", 0.0, 1.92), ("BUILD", "six", "", 2.32, 3.52), ("SNAP", "seven eight", "", 3.92, 5.92),
    ]


def test_segment_gaps(spark):
    style = F.create_map(F.lit("clean"), F.lit(8.0))
    segments = spark.createDataFrame([("s1", ["work/office"], "adults", 2.0), ("s2", ["cats"], "nobody", 1.0)], "segment string, topics array<string>, audience string, demand double").withColumn("style", style)
    suppliers = spark.createDataFrame([(f"n{i}", ["Office life"], ["x"], 1.0) for i in range(4)] + [("other", ["dogs"], ["Adults only"], 3.0)], "name string, topics array<string>, audiences array<string>, share double").withColumn("style", style)
    got = {r["segment"]: r for r in am.segment_gaps(segments, suppliers, style).collect()}
    assert got["s1"]["closest"] == ["n0", "n1", "n2"] and got["s1"]["supply"] == 1.0 and got["s1"]["gap"] == round(2 * 2.15 - 1, 3)
    assert got["s2"]["closest"] == [] and got["s2"]["gap"] == 2.15


def test_rankings(spark):
    catalogue = spark.createDataFrame([("a", "music and dance", 1), ("b", "music", 5), ("c", "cooking", 9)], "id string, t string, p int")
    assert [r["id"] for r in am.ranked_catalogue(catalogue, "id", ["t"], "music for a dance", "p").collect()] == ["a", "b", "c"]
    assert am.ranked_catalogue(catalogue, "id", ["t"], "cook", "p", boosts={"cook": {"b": 9.0}}, k=1).first()["id"] == "b"
    tried = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", None)], "id string, r double")
    got = {r["id"]: (r["score"], r["n"], r["explore"]) for r in am.arms_to_try(catalogue, tried, "id", "p", "r").collect()}
    assert got == {"a": (round(1 + 3 * 0.55 + 2**0.5 * 0.75, 3), 2, False), "b": (5.0, 0, True), "c": (9.0, 0, True)}
    r = am.positional_correlation(spark.createDataFrame([(1, 1.0, 3.0), (2, 1.0, 2.0), (3, 2.0, 1.0)], "o int, x double, y double"), "x", "y", "o").first()
    assert (r["n"], r["r"]) == (3, -1.0)


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(am.dull_tail(F.lit("Why did the Horse, run?"), ["the {w} left.", "a {w}."], F.lit(3))) == "a horse."
    assert one(am.dull_tail(F.lit("a b"), ["the {w}."], F.lit(0))) == "the matter."
    rows = am.unescaped(spark.createDataFrame([("a &amp;amp; b",), ("x  y",), (None,)], "t string"), "t").collect()
    assert [r["t"] for r in rows] == ["a & b", "x y", None]
    a, b = spark.createDataFrame([(1,)], "old int"), spark.createDataFrame([(2, "z")], "new int, more string")
    assert {tuple(r) for r in am.united([(a, {"old": "new"}), (b, {})]).collect()} == {(1, None), (2, "z")}


def test_shape_problems(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id int, t string")
    assert {tuple(r) for r in am.shape_problems(df, ["id", "x"], "id", 5).collect()} == {("missing:x", 1), ("null_id", 1), ("repeated_id", 2), ("truncated", 2)}
    assert am.shape_problems(df.limit(1), ["id"], "id", 1).count() == 0


def test_retrieval_set_round_trip(spark, tmp_path):
    controls = generators.control_rows(spark, 4, 2, 2)
    tables = {n: controls.select(F.col("item_id").alias("id"), "text") for n in am.RETRIEVAL_SET}
    schemas = {n: t.schema for n, t in tables.items()}
    am.write_retrieval_set(spark, str(tmp_path / "set"), tables)
    assert am.read_retrieval_set(spark, str(tmp_path / "set"), schemas)["qrels"].count() == controls.count()
    with pytest.raises(FileExistsError):
        am.write_retrieval_set(spark, str(tmp_path / "set"), tables)
    with pytest.raises(ValueError):
        am.write_retrieval_set(spark, str(tmp_path / "other"), {"documents": controls})


def test_generated_tables_are_valid(spark):
    rows = generators.multimodal_rows(spark, 20)
    assert rows.count() == 400 and rows.distinct().count() == 400 and rows.where("target not between 0.02 and 0.98").count() == 0
    wide = rows.select("split", "target", *(F.get(c, F.lit(i)).alias(f"{c}{i}") for c, n in (("text_only", 12), ("image_only", 8), ("fusion", 36)) for i in range(n)))
    arms = {c: [x for x in wide.columns if x.startswith(c)] for c in ("text_only", "image_only", "fusion")}
    got = {r["arm"]: r for r in am.arms_compared(wide, arms, "target", "split", 0.1).collect()}
    assert got["fusion"]["rmse"] < got["text_only"]["rmse"] < got["image_only"]["rmse"] and len({r["n"] for r in got.values()}) == 1
    assert bundles.study(*generators.study_tables(spark)).count() == 0


def test_retrieval_rows_of_controls(spark):
    rows = [("d1", "t", "p1", "k_c00", "surprising_resolved", 0, "s"), ("q0", "t", "p1", "k_c00", "expected_literal", 0, "s0"), ("q1", "t", "p1", "k_c00", "expected_literal", 1, "s1"), ("x", "t", "p2", "k_c00", "expected_literal", 0, "s"), ("y", "t", "p1", "k_c01", "surprising_resolved", 0, "s")]
    df = spark.createDataFrame([(*r, "f", "train") for r in rows], "item_id string, text string, premise_id string, configuration_id string, counterfactual_arm string, surface_variant int, setup string, template_family_id string, split string")
    documents, queries, qrels = bundles.retrieval_set(df)
    assert [r["document_id"] for r in documents.collect()] == ["d1"] and queries.first()["text"].startswith("s1 ") and qrels.first()["document_id"] == "d1"
    assert sc.AXES
