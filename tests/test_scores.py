import pytest
from pyspark.sql import functions as F

from quipwright.functions import scores as sc
from quipwright.operators import bundles, labels, providers, studies
from quipwright.sources import wikitext


def one(spark, column, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "i int"
    row = tuple(v for _, v in values.values()) or (1,)
    return spark.createDataFrame([row], names).select(column.alias("x")).first()["x"]


def test_tenths(spark):
    rows = spark.createDataFrame([(s,) for s in ("7.5", "6.5", "-3", "11", "x", None, "NaN", " 4 ")], "s string")
    assert [r[0] for r in rows.select(sc.tenths(F.col("s"))).collect()] == [8, 6, 0, 10, 0, 0, 0, 4]


def test_panel_record_with_older_names(spark):
    text = '{"candidate": " A ", "setup_clarity": 9, "timing": "bad", "bad_surprise_risk": 0, "risk_flags": ["a", " "], "rewrite": "B"}'
    r = one(spark, sc.panel_record(F.try_parse_json("t"), F.lit("none")), t=("string", text))
    assert (r["candidate"], r["comedic_structure"], r["timing"], r["truth_alignment"], r["risk_flags"], r["repaired_candidate"]) == ("A", 9, 0, 7, ["a"], "B")
    assert r["total"] == round((9 + 5 + 0 + 5 + 5 + 5 + 7) / 7, 2)
    assert one(spark, sc.panel_record(F.try_parse_json("t"), F.lit(" x ")), t=("string", "nothing"))["candidate"] == "x"


def test_replies(spark):
    cases = {
        '["a", "b", "A"]': ["a", "b"], 'Sure! {"jokes": ["x  y", "z"]} bye': ["x y", "z"], '{"candidates": "only"}': ["only"], "1. One\n2) Two\n   more\n- Three": ["One", "Two more", "Three"],
        "```\nline one\n\nline two\n```": ["line one", "line two"], "": [], None: [],
    }
    for text, expected in cases.items():
        assert one(spark, sc.candidates(F.col("t")), t=("string", text)) == expected, text
    assert one(spark, sc.candidates(F.col("t"), 1), t=("string", '["a", "b"]')) == ["a"]
    assert one(spark, sc.numbered_lines(F.col("t")), t=("string", 'x\n1. "One"\n 4) Four\n5. no')) == ["One", "Four"]
    assert one(spark, sc.first_object(F.col("t")).isNull(), t=("string", "[1]"))


def test_verdicts(spark):
    t = one(spark, sc.temporal_verdict(F.lit(2.0), F.lit(0.2)))
    assert (t["gap"], t["evergreen"], t["verdict"]) == (1.8, 0.0, "topical")
    p = one(spark, sc.partisan_verdict(F.lit(30.0), F.lit(10.0), F.lit(5.0), F.lit(25.0), F.lit(1.0)))
    assert p["flips"] and p["verdict"] == "weapon"
    assert one(spark, sc.partisan_verdict(F.lit(3.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(1.0)))["verdict"] == "bridge"


def test_axes(spark):
    axes = F.create_map(F.lit("cold_warm"), F.lit(0.4), F.lit("low_high"), F.lit(-0.5), F.lit("dry_wet"), F.lit(0.01))
    assert one(spark, sc.axes_address(axes)) == "low(-0.50) · warm(+0.40)"
    m = one(spark, sc.axes_match(axes, F.create_map(F.lit("cold_warm"), F.lit(-0.4))))
    assert m["widest"] == "cold_warm" and m["verdict"] == "off-vibe"


def test_cuts_and_slots(spark):
    assert tuple(one(spark, sc.share_cut(F.lit("a b  c d e")))) == ("a b", "c d e") and tuple(one(spark, sc.share_cut(F.lit("a")))) == ("a", "")
    assert tuple(one(spark, sc.edit_cut(F.lit("The <old/> man"), F.lit("new")))) == ("The", "new man", "old") and one(spark, sc.edit_cut(F.lit("<old/> man"), F.lit("new"))) is None
    assert one(spark, sc.masked(F.lit("Cat cats CAT"), ["cat"], "it")) == "it cats it"
    assert one(spark, sc.only_one_of(F.lit("In a Bar"), {"b": "bar", "c": "cafe"})) == "b" and one(spark, sc.only_one_of(F.lit("bar cafe"), {"b": "bar", "c": "cafe"})) is None
    slots = F.create_map(F.lit("who"), F.array(F.lit("a"), F.lit("b")), F.lit("what"), F.array(F.lit("x")))
    assert one(spark, sc.filled_slots(F.lit("{who} and {what}"), sc.chosen_slots(slots, F.lit(3)))) in ("a and x", "b and x")
    assert one(spark, sc.from_percentile(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), 0.75)) == 3.0
    assert one(spark, sc.topic_share(F.lit("Cooking the soup"), F.lit("soup of the day"))) == 0.5
    assert one(spark, sc.topics_meet(F.array(F.lit("art/music")), F.array(F.lit("Music now")))) is True


def test_channels(spark):
    reaction = F.array(F.struct(F.lit("laugh").alias("signal_type"), F.lit(0.5).alias("value"), F.lit("adults").alias("audience_segment"), F.lit("").alias("notes")))
    labels_ = F.array(F.lit("pun"))
    whole = sc.searchable([F.lit("text"), F.lit(""), F.lit(None).cast("string")], labels_, reaction)
    assert one(spark, whole) == "text pun laugh adults"
    out = one(spark, sc.channels(F.lit("s"), F.lit("p"), F.lit("c"), F.lit("a"), whole, labels_, reaction, F.create_map(F.lit("offense"), F.lit("none"))))
    assert out["structure"] == "s p pun" and out["audience"] == "a c pun" and out["reaction"].startswith("laugh 0.5 adults") and out["risk"].strip() == "none"


def test_limericks_and_forms(spark):
    rhyme = "There was an old man of the hunt\nWho went out each day in a punt\nHe fell in the lake\nWith a very large rake\nAnd was seldom seen back at the front"
    texts = [rhyme, rhyme.replace("punt", "boat"), "Knock knock. Who?", "A short one.", "Why so? Because.", "x" * 901, None, "Is it?", "\"Yo mama is so nicely dressed\"", "Yo mama is so fat"]
    got = [r["form"] for r in labels.label(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()]
    assert got == ["limerick", "one_liner", "knock_knock", "one_liner", "q_and_a", "shaggy_dog", "one_liner", "unknown", "yo_mama", "yo_mama"]


def test_lexicon_is_a_parameter(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("space\tRocket\nspace\tmoon\nsea\tship\n")
    lexicon = labels.read_lexicon(spark, str(tmp_path / "l.tsv"))
    assert lexicon == {"sea": ("ship",), "space": ("moon", "rocket")}
    r = labels.label(spark.createDataFrame([("The rocket, the moon and a ship",)], "t string"), "t", lexicon=lexicon).first()
    assert (r["domain"], r["hits"], r["all_domains"]) == ("space", 2, ["space", "sea"])
    with pytest.raises(ValueError):
        labels.read_lexicon(spark, str(tmp_path / "l.tsv"), most=1)


def test_wikitext_sayings():
    text = (
        "{{citation|citation=A stitch {{nowrap|in time}} saves nine|author=x}}\n* The ''early'' bird [[x|catches]] the worm<ref>no</ref>\n** deeper entry is not taken\n# Numbered saying of some length\n"
        "{{Quote|1=Named by a number, and long enough}}\n{{Ein person er ikkje ei øy}}\n{{Tema}}\n<p>Still waters run very deep</p>http://no.where.at/all<br>\n* kurz\n{{never closed"
    )
    found = list(wikitext.sayings(text))
    assert ("citation", "A stitch in time saves nine") in found and ("citation", "Named by a number, and long enough") in found
    assert ("list", "The early bird catches the worm") in found and ("list", "Numbered saying of some length") in found
    assert ("sentence", "Ein person er ikkje ei øy") in found and ("block", "Still waters run very deep") in found
    assert not any("deeper" in t or "kurz" in t for kind, t in found if kind != "block") and list(wikitext.sayings(None)) == []
    assert wikitext.arguments("a|b{{c|d}}|[[e|f]]") == ["a", "b{{c|d}}", "[[e|f]]"] and wikitext.is_saying("画蛇添足") and not wikitext.is_saying("abc")


def test_providers(spark):
    known = providers.Providers("length")
    known.register("length", lambda texts: [len(t) for t in texts])
    name, f = known.get("no such")
    assert name == "length"

    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [len(t) for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None), (4, "")], "k long, t string")
    frame, seen = providers.counted(providers.measure(rows, "k", "t", picky))
    got = {r["k"]: (r["value"], r["error"]) for r in frame.collect()}
    assert got == {1: (3.0, None), 2: (None, "ValueError: bad text"), 3: (None, "no text"), 4: (0.0, None)} and seen.get == {"calls": 4, "failed": 2}
    more = providers.extended(spark.createDataFrame([(1, 9.0)], "k long, value double"), rows, "k", "t", picky)
    assert {r["k"]: r["value"] for r in more.collect()} == {1: 9.0, 4: 0.0}
    flagged = spark.createDataFrame([(1, "t", True, "c"), (2, "u", None, "d")], "k int, t string, f boolean, c string")
    assert {tuple(r) for r in providers.jobs(flagged, "k", "t", "f", {"control": "c"}).collect()} == {(1, "original", "t"), (1, "control", "c"), (2, "original", "u")}
    best = providers.best_of(spark.createDataFrame([("a", 1, 2.0, True), ("a", 2, 3.0, False), ("a", 3, 2.0, True)], "g string, k int, s double, ok boolean"), "g", "s", "k", "ok")
    assert [(r["g"], r["k"]) for r in best.collect()] == [("a", 1)]


def problems(df):
    return {(r["record"], r["problem"]) for r in df.collect()}


def test_closed_records(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": 2}'), (2, '{"a": 1, "Email": 3}'), (3, "[]"), (4, None)], "k int, j string")
    assert problems(bundles.closed(rows, "k", "j", ["a", "b"])) == {
        ("2", "missing:b"), ("2", "unexpected:Email"), ("2", "forbidden:Email"), *((k, p) for k in "34" for p in ("not an object", "missing:a", "missing:b")),
    }


def test_study_and_multimodal(spark):
    digest = "a" * 64
    m = [("m1", "w", "p", "control", 5.0, 3.0, digest, True), ("m2", "w", "p", "assisted", 5.0, 3.0, digest, True), ("m3", "w", "q", "control", -1.0, 3.0, "x", False)]
    materials = spark.createDataFrame(m, "material_id string, writer_id string, premise_id string, condition string, minutes_to_draft double, voice_preservation_rating double, model_config_digest string, permission_confirmed boolean")
    responses = spark.createDataFrame([("r1", "m1", 4.0, True), ("r2", "m2", 4.0, True), ("r3", "zz", 99.0, False)], "response_id string, material_id string, rating double, consent_confirmed boolean").withColumn("recorded_at", F.current_timestamp())
    assert problems(bundles.study(materials, responses)) == {
        ("w q", "missing_arm"), ("m3", "minutes"), ("m3", "config_digest"), ("m3", "not_permitted"), ("m3", "unrated_material"), ("r3", "unknown_material"), ("r3", "rating"), ("r3", "not_consented"),
    }
    i = [("c1", "train", "s1", "a1", digest, "dhash-64-v1", "0" * 16), ("c2", "test", "s2", "a2", "b" * 64, "dhash-64-v1", "0" * 15 + "3"), ("c3", "test", "s1", "a3", "c" * 64, "other", "f" * 16)]
    images = spark.createDataFrame(i, "contest_id string, split string, canonical_scene_group_id string, rights_asset_id string, image_sha256 string, perceptual_hash_algorithm string, perceptual_hash string")
    right = lambda asset, kind, contest, sha, licence="CC0-1.0": (asset, kind, contest, sha, "owned", licence, True, True, True, "https://x", "p", digest)
    r = [right("a1", "image", "c1", digest), right("a2", "image", "c2", "b" * 64), right("a3", "image", "c3", "d" * 64, "UNKNOWN"), right("cap", "caption_cohort", None, None)]
    rights = spark.createDataFrame(r, "asset_id string, asset_type string, contest_id string, asset_sha256 string, rights_basis string, license_spdx string, redistribution_allowed boolean, research_allowed boolean, derivatives_allowed boolean, source_url string, evidence_path string, evidence_sha256 string")
    c = [("x1", "c1", "train", "Ha", "cap", 1.0, "human_observed", 0.1, 5), ("x2", "c1", "test", " ", "cap", 1.0, "human_observed", 0.1, 5), ("x3", "no", "train", "Ha", "zz", float("nan"), "model", -0.1, 0)]
    captions = spark.createDataFrame(c, "row_id string, contest_id string, split string, caption string, caption_rights_id string, target double, target_origin string, target_standard_error double, rating_count int")
    assert problems(bundles.multimodal(images, captions, rights, ["owned"])) == {
        ("s1", "scene_in_several_splits"), ("c3", "image_without_rights"), ("c1 c2", "near_duplicate_across_splits"), ("c3", "hash_algorithm"), ("a3", "no_licence"), ("x2", "caption_in_other_split"), ("x2", "no_caption"),
        ("x3", "unknown_contest"), ("x3", "no_rights"), ("x3", "target"), ("x3", "target_origin"), ("x3", "standard_error"), ("x3", "rating_count"),
    }


def test_transfer_by_moments_is_the_fit(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    g = np.array(["a", "b"])[np.arange(60) % 2]
    y = x @ [1.0, -2.0] + 0.5 + rng.normal(size=60) * 0.1
    rows = spark.createDataFrame([(str(k), float(a), float(b), float(c)) for k, (a, b), c in zip(g, x, y)], "g string, u double, v double, y double")
    got = {(r["train"], r["test"]): (r["r"], r["r2"]) for r in studies.transfer(rows, "g", ["u", "v"], "y", 0.0).collect()}
    w, *_ = np.linalg.lstsq(np.c_[x[g == "a"], np.ones(30)], y[g == "a"], rcond=None)
    p, t = np.c_[x[g == "b"], np.ones(30)] @ w, y[g == "b"]
    assert abs(got["a", "b"][0] - np.corrcoef(p, t)[0, 1]) < 1e-9 and abs(got["a", "b"][1] - (1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())) < 1e-9


def test_ratings_and_text_rows(spark):
    good = ("rating_1", "i1", "p", "rater_key_1", *[4] * 7, "v1", "2026-01-01T00:00:00Z", "human_observed")
    bad = ("rating_2", "i9", "q", "A@b.c", *[8] * 7, "", "2026-01-01T00:00:00", "model")
    marks = ", ".join(f"{c} int" for c in bundles.RATINGS)
    df = spark.createDataFrame([good, bad, ("rating_3", *good[1:])], f"rating_id string, item_id string, protocol_id string, rater_key string, {marks}, consent_version string, collected_at_utc string, data_origin string")
    got = problems(bundles.ratings(df, spark.createDataFrame([("i1",)], "item_id string"), "p"))
    assert got == {("rating_2", p) for p in (*(f"{c}_out_of_range" for c in bundles.RATINGS), "rater_not_pseudonymous", "wrong_protocol", "no_consent", "time_without_zone", "invalid_origin", "unknown_item")} | {("rating_1", "rated_twice")}
    text = ("candidate1", "some text", "p", "m", "v", "a" * 64, '{"Token": 1}', "2026-01-01T00:00:00+01:00", "model_generated_candidate", False, "quarantined")
    rows = spark.createDataFrame([text, (None, *text[1:6], "[]", "now", "x", True, "open")], "candidate_id string, text string, provider string, model_id string, model_version string, prompt_sha256 string, generation_parameters string, generated_at_utc string, data_origin string, human_authored boolean, release_status string")
    assert problems(bundles.model_rows(rows)) == {("candidate1", "secret_parameter"), *((None, p) for p in ("invalid_id", "parameters_not_an_object", "time_without_zone", "invalid_origin", "not_quarantined"))}
