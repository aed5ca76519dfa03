import pytest

from quipwright.llm import languages as la

SAMPLES = {
    "en": ["The old baker never forgets the key of the house.", "Nobody told him that the weather was bad and the road was long.", "My aunt writes long letters to the moon every second Tuesday."],
    "de": ["Der alte Bäcker vergisst niemals den Schlüssel des Hauses.", "Niemand sagte ihm, dass das Wetter schlecht und der Weg lang war.", "Meine Tante schreibt jeden zweiten Dienstag lange Briefe an den Mond."],
    "ru": ["Старый пекарь никогда не забывает ключ от дома.", "Никто не сказал ему, что погода плохая, а дорога длинная.", "Моя тётя пишет длинные письма луне каждый второй вторник."],
}
MODELS = la.Models([(k, t) for k, ts in SAMPLES.items() for t in ts])
SCHEMA = "record_id long, lane string, text string, meta struct<language:string,page:string>, language string, segments int"


def kinds(text):
    return list(dict.fromkeys(x for _, _, x, _ in la.segment(MODELS, text)[0]))


def test_labels():
    for label, code in {"en": "en", "EN-GB": "en", "en_US": "en", "deu": "de", "ger": "de", "Deutsch": "de", "Français": "fr", "Русский": "ru", "Greek": "el", " sv-FI ": "sv"}.items():
        assert la.name_of(label) == code
    for label in (None, "", "??", "und", "xx", "unknown", "zh", "mul"):
        assert la.name_of(label) is None


def test_single_languages():
    for code, texts in SAMPLES.items():
        for t in texts:
            assert kinds(t) == [code] and kinds(t.upper()) == [code]
    assert kinds("The old baker writes letters to the moon. (déjà vu)") == ["en"] and kinds("The​ old bａker forgets the house, said Niemand Schlüssel.") == ["en"]
    assert kinds("Der alte Backer vergisst den Schlussel.") == ["de"]


def test_mixtures_and_segments():
    text = "The old baker never forgets the key. Meine Tante schreibt lange Briefe an den Mond."
    segments, confidence = la.segment(MODELS, text)
    assert [x for *_, x, _ in segments] == ["en", "de"] and confidence > 0.9
    assert text[segments[0][0] : segments[0][1]].endswith("key") and text[segments[1][0] :].startswith("Meine")
    assert set(kinds("The weather was bad and the road was long, а дорога длинная и погода плохая.")) == {"en", "ru"}


def table(spark, rows):
    return spark.createDataFrame([(i, lane, t, (label, None), "clash", 1) for i, lane, t, label in rows], SCHEMA)


def samples(spark):
    return spark.createDataFrame([(n, k, t) for n, (k, t) in enumerate([(k, t) for k, ts in SAMPLES.items() for t in ts] + [(None, "x"), ("en", None)])], "sample_id long, language string, text string")


def test_found(spark):
    en, de = SAMPLES["en"][0], SAMPLES["de"][1]
    rows = [
        (1, "wq_multilang", en, "English"), (2, "wq_multilang", en, "de"), (3, "wq_multilang", en, None), (4, "wq_multilang", f"{en} {de}", "en"), (5, "wikiquote", en, None), (6, "wq_multilang", None, None), (7, "wq_multilang", "  ", "en"),
        (8, "wq_multilang", "123 !!", None), (None, "wq_multilang", en, None), (2, "wq_multilang", en, "de"),
    ]
    found = {tuple(r) for r in la.mislabelled(table(spark, rows), samples(spark)).collect()}
    assert found == {(2, "en"), (3, "en"), (4, "en"), (4, "de")}
    segments = la.segments_of_lane(table(spark, rows), samples(spark)).where("record_id = 4").collect()
    assert len(segments) == 2 and {r["segment_language"] for r in segments} == {"en", "de"}


def test_empty_and_very_long(spark):
    assert la.mislabelled(table(spark, []), samples(spark)).count() == 0
    long = " ".join(SAMPLES["de"]) * 300
    assert {tuple(r) for r in la.mislabelled(table(spark, [(1, "wq_multilang", long, "en")]), samples(spark)).collect()} == {(1, "de")}


@pytest.mark.parametrize("text", ["", "...", "4711", "—"])
def test_no_words(text):
    assert la.segment(MODELS, text) == ([], 0.0)
