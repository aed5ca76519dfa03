import unicodedata

from hypothesis import given, settings, strategies as hs

from quipwright.llm import lookalike as la

TABLE = la.representatives(la.classes(la.alike_pairs()), {c: 1 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ- "})
R = la.Rewriter(TABLE)
SCHEMA = "record_id long, lane string, text string, form string, f string"


def pairs(spark, rows):
    return {tuple(r) for r in la.alike_pairs_of(spark.createDataFrame([(i, x, t, "clash", "clash") for i, x, t in rows], SCHEMA)).collect()}


def test_forms():
    same = ["file", "ﬁle", "ｆｉｌｅ", "f​ile", "fi­le", "fіle", "𝐟𝐢𝐥𝐞"]
    assert len({R(t) for t in same}) == 1
    assert R("café") == R("café") != R("cafe") and R("a b") == R("a b") == R("a　b") and R("a‑b") == R("a‐b") == R("a-b") != R("a—b")
    assert len({R(t) for t in ("Ab", "ab", "ab.", "a b", "a\nb", "äb", "a²b", "a2b")}) == 8


@settings(max_examples=200, deadline=None)
@given(hs.text(max_size=30))
def test_rewriting_again_changes_nothing(text):
    assert R(R(text)) == R(text)


@settings(max_examples=100, deadline=None)
@given(hs.text(max_size=20))
def test_composed_and_decomposed_are_one(text):
    assert R(unicodedata.normalize("NFD", text)) == R(unicodedata.normalize("NFC", text))


def test_pairs(spark):
    rows = [
        (1, "wikiquote", "A short saying"), (2, "wq_multilang", "A short saying"), (3, "wikiquote", "A shоrt saying"), (4, "wikiquote", "A ѕhort​ saying"), (5, "wikiquote", "a short saying"), (6, "gutenberg", "A ѕhort saying"),
        (7, "wikiquote", None), (8, "wikiquote", ""), (9, "wikiquote", " ​ "), (10, "wikiquote", " "), (None, "wikiquote", "A shоrt saying"), (3, "wikiquote", "A shоrt saying"), (11, "wikiquote", "Ein fröhlicher Satz"), (12, "wikiquote", "Ein fröhlicher Satz"),
    ]
    assert pairs(spark, rows) == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (11, 12)}


def test_very_long_and_empty(spark):
    long = "word " * 60000
    assert pairs(spark, [(1, "wikiquote", long), (2, "wikiquote", long.replace(" ", "\u00a0", 1))]) == {(1, 2)}
    assert pairs(spark, []) == set()


def test_classes_are_transitive_and_counted(spark):
    members = la.classes([("x", "y"), ("y", "z"), ("q", "r")])
    assert members["x"] == members["z"] != members["q"]
    assert la.representatives(members, {"x": 1, "z": 5, "r": 2}) == {"x": "z", "y": "z", "q": "r"}


def test_accents_over_twins_and_small_forms():
    greek, latin, apart = "\u03cc", "\u00f3", "\u03bf\u200b\u0301"
    assert R(greek) == R(latin) == R(apart) != R("o")
    assert R("a\ufe63b") == R("a\u2212b") == R("a-b") and R("a\ufe52") == R("a.")


def test_classes_against_pairs(spark):
    rows = [(1, "wikiquote", "file a"), (2, "wikiquote", "\ufb01le a"), (3, "wq_multilang", "file a"), (4, "wikiquote", "other"), (5, "wikiquote", None), (None, "wikiquote", "file a"), (6, "jokeapi", "file a"), (4, "wikiquote", "other")]
    frame = spark.createDataFrame([(i, x, t, "clash", "clash") for i, x, t in rows], SCHEMA)
    got = {r["record_id"]: (r["class_id"], r["class_size"], r["strings"], r["links"]) for r in la.alike_classes(frame).collect()}
    assert got == {1: (1, 3, 2, 1), 2: (1, 3, 2, 2), 3: (1, 3, 2, 1), 4: (4, 1, 1, 0)}
    assert la.alike_classes(frame.where("false")).count() == 0
