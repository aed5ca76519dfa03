import os

import pytest

from quipwright.llm import moderation as mo

LABELS = "/root/testdata/sf0.001/content_labels.parquet"
CLEAN = ["The baker walks into a bar and orders a pie.", "My neighbour sings to the potatoes before breakfast.", "A lost tourist returns the ladder at midnight.", "Dad says the choir is late again.", "What do you call a clock that never broke?"]
BAD = {"abusive": ["You are a stupid idiot.", "Shut up, you worthless moron.", "Go to hell, you bastard."], "hateful": ["All immigrants are vermin.", "Foreigners are parasites.", "I hate refugees, every one of them."], "sexual": ["He came all over her tits.", "She sucked his cock.", "They watch porn and masturbate."]}
SAMPLE = [(t, "clean") for t in CLEAN * 4] + [(f"{CLEAN[i % 5]} {t}" if i else t, k) for k, ts in BAD.items() for i, t in enumerate(ts)]
MODEL = mo.Classifier().fit(SAMPLE)


def flagged(text):
    return MODEL.score(text)[0] >= mo.THRESHOLD


def test_disguises():
    for text in ("Shut up, you m0r0n.", "Shut up, you m-o-r-o-n.", "Shut up, you morrrron.", "Shut up, you mo​ron.", "SHUT UP, YOU MОRОN.", "Shut up, you m***n.", "Shut up, you m o r o n.", "Ｓｈｕｔ up, you ｍｏｒｏｎ."):
        assert flagged(text), text


def test_plain_joins_only_spaced_words():
    assert mo.plain("s-h-i-t s.h.i.t b l o w j o b and I am a man") == "shit shit blowjob and I am a man"
    assert mo.plain("well-known e-mails, a b") == "well-known emails, a b"


def test_whole_texts_are_read():
    assert flagged(" ".join(CLEAN) + " You are a stupid idiot. " + " ".join(CLEAN)) and not flagged(" ".join(CLEAN))


def test_naming_a_group_counts_for_nothing():
    for group in ("women", "muslims", "old people", "gay people", "islanders"):
        assert not flagged(f"{group.capitalize()} told the best jokes at the festival.")
        assert flagged(f"All {group} are vermin.")
    scores = [MODEL.score(f"All {g} are parasites.")[0] for g in mo.IDENTITIES["en"]]
    assert max(scores) - min(scores) < 0.1


def test_every_group_of_every_language_is_swapped():
    for language, terms in mo.IDENTITIES.items():
        copies = mo._swapped(f"{terms[0]} , {terms[1]}!")
        assert len(copies) == mo.COPIES and all(terms[0] not in c.split(" , ")[0] and terms[1] not in c.split(" , ")[1] for c in copies), language
    assert mo._swapped("Nobody here, womenfolk aside.") == []


def test_groups_named(spark):
    rows = [(1, "All women are vermin, women!", 0.9), (2, "Women sing.", 0.1), (3, "Ausländer und Frauen singen.", 0.1), (4, None, 0.0), (None, "Women.", 0.1)]
    frame = spark.createDataFrame(rows, "record_id long, text string, score double")
    got = {(r["language"], r["term"]): (r["n"], r["n_found"], r["rate"]) for r in mo.group_mentions(frame.drop("score"), frame.select("record_id", "score")).collect()}
    assert got == {("en", "women"): (2, 1, 0.5), ("de", "ausländer"): (1, 0, 0.0), ("de", "frauen"): (1, 0, 0.0)}


def test_other_languages():
    assert flagged("Du bist ein Arschloch.") and flagged("Tais-toi, espèce de connard.") and flagged("Eres un cabrón.") and not flagged("Der Bäcker singt.")


def test_records_and_rates(spark):
    rows = [(1, "a", "You are a stupid idiot."), (2, "a", CLEAN[0]), (3, None, None), (4, "b", ""), (None, "b", "All immigrants are vermin."), (2**60 + 1, "b", CLEAN[1])]
    records = spark.createDataFrame([(i, "icanhazdadjoke", s, t, 1.0, "x") for i, s, t in rows], "record_id long, lane string, source string, text string, score double, label string")
    scored = mo.score_records(records, MODEL)
    found = {r["record_id"]: r["label"] for r in scored.collect()}
    assert found == {1: "abusive", 2: "clean", 3: "clean", 4: "clean", None: "hateful", 2**60 + 1: "clean"}
    rates = {r["source"]: (r["n"], r["n_found"]) for r in mo.rates(scored).collect()}
    assert rates == {"a": (2, 1), None: (1, 0), "b": (3, 1)}
    assert mo.score_records(records.limit(0), MODEL).count() == 0


def test_very_long_texts():
    assert not flagged(CLEAN[1] * 2000) and MODEL.score("-".join("a" * 20000))[0] < 1.01 and MODEL.score("_" * 50000 + "*" * 50000)[0] < 1.01


@pytest.mark.skipif(not os.path.exists(LABELS), reason="no test tables")
def test_held_out_accuracy():
    import duckdb

    rows = sorted(duckdb.connect().execute(f"select text, label from '{LABELS}' where label is not null").fetchall())
    right = 0
    for fold in range(2):
        model = mo.Classifier().fit([r for i, r in enumerate(rows) if i % 2 != fold], rounds=3, steps=150)
        right += sum((model.score(t)[0] >= mo.THRESHOLD) == (y != "clean") for i, (t, y) in enumerate(rows) if i % 2 == fold)
    assert right / len(rows) > 0.97
