import json

import pytest
from pyspark.sql import functions as F

from quipwright.sources import readers as rd, sinks as sk

LINES = ['{"_meta": {"n": 3}}', '{"source": "s", "text": "First one", "language": "en"}', '{"source": "s", "joke": "Second one", "meta": {"language": "de"}}', '{"source": "s", "text": "  "}']


def corpus(tmp_path, *more):
    (tmp_path / "a.jsonl").write_text("\n".join([*LINES, *more]))
    return str(tmp_path)


def test_reading_with_three_rigours(spark, tmp_path):
    path = corpus(tmp_path)
    for rigour in ("permissive", "failfast", "closed"):
        assert {(r["text"], r["language"]) for r in rd.read_corpus(spark, path, rigour).collect()} == {("First one", "en"), ("Second one", "de")}


def test_bad_lines(spark, tmp_path):
    path = corpus(tmp_path, '{"text": "cut')
    assert rd.read_corpus(spark, path).count() == 2
    with pytest.raises(Exception):
        rd.read_corpus(spark, path, "failfast").collect()


def test_unknown_keys_are_refused_when_closed(spark, tmp_path):
    path = corpus(tmp_path, '{"text": "Third one", "odd": 1}')
    assert rd.read_corpus(spark, path, "failfast").count() == 3
    with pytest.raises(ValueError, match="odd"):
        rd.read_corpus(spark, path, "closed")


def test_vote_tables_by_file_name(spark, tmp_path):
    (tmp_path / "831_lil.csv").write_text("caption,votes,nf,sf,f\nA good one,10,5,3,2\nBad,x,1,1,1\n")
    rows = {r["text"]: r for r in rd.read_votes(spark, str(tmp_path)).collect()}
    assert rows["A good one"]["contest"] == "831" and rows["A good one"]["sampler"] == "lil" and rows["A good one"]["high"] == 2.0 and rows["Bad"]["votes"] is None


def test_arrays_prefer_score(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"body": "x", "score": 3}, {"body": "y", "rating": 2.5}]))
    assert [r["grade"] for r in rd.read_arrays(spark, str(tmp_path), "body string, score double, rating double").orderBy("body").collect()] == [3.0, 2.5]


def test_book_blocks(spark):
    text = "junk\n*** START OF THE BOOK ***\n\n" + '"' + "word " * 15 + 'end," he said.\n\nSHOUTED ' + "X " * 40 + "?\n\nshort?\n\n*** END OF THE BOOK"
    assert rd.book_blocks(spark.createDataFrame([(1, text)], "id int, body string"), "body").count() == 1


def test_wiki_quotes(spark):
    page = "* A [[link|quoted]] saying with ''style''{{ref|x}}.\n** author\n* A quoted saying with style.\n{{quote|Another longer saying here|Someone}}"
    spark.udtf.register("wiki_quotes", rd.WikiQuotes)
    rows = spark.createDataFrame([(page,)], "t string").createOrReplaceTempView("pages") or spark.sql("select q.* from pages, lateral wiki_quotes(t, 10, 400) q")
    assert [r["quote"] for r in rows.orderBy("position").collect()] == ["A quoted saying with style.", "Another longer saying here"]


def test_transcripts(spark):
    text = "WEBVTT\n\n1\n00:01 --> 00:02\nHello <i>there</i>\nHello there\n\n2\n00:02 --> 00:03\nmy friends.\nBye"
    rows = rd.transcripts(spark.createDataFrame([(1, text), (2, None), (3, "One\nTwo. Three\n" + "x" * 161 + "\nend")], "i int, t string"), "t").orderBy("i").collect()
    assert [r["statements"] for r in rows] == [["Hello there my friends.", "Bye"], [], ["One Two. Three " + "x" * 161, "end"]]


def test_feeds(spark):
    xml = "<rss><title>no</title><item><title>One</title></item><item a='1'>\n<title><![CDATA[ Two ]]></title></item></rss>"
    assert [r[0] for r in rd.feed_titles(spark.createDataFrame([(xml,)], "x string"), "x").collect()] == ["One", "Two"]


def test_sections(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "# X", "b", "# Y", "c"])], "doc int, i int, t string")
    heading = F.when(F.col("t").startswith("# "), F.substring("t", 3, 99))
    assert [r["section"] for r in rd.sections(lines, "doc", "i", heading).orderBy("i").collect()] == [None, "X", "X", "Y", "Y"]


def test_written_records_verify(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "a int, b string")
    path = str(tmp_path / "out")
    assert sk.write_records(df, path, "note")["rows"] == 3
    assert sk.verify_records(spark, path, df.schema) == []
    with pytest.raises(Exception):
        sk.write_records(df, path)
    assert sk.wide_digest(df.orderBy("a")).first() == sk.wide_digest(df.repartition(3)).first() != sk.wide_digest(df.distinct()).first()


def test_publish_is_all_or_nothing(spark, tmp_path):
    df, target = spark.range(3), str(tmp_path / "release")

    def fail(path):
        raise OSError("disk")

    with pytest.raises(OSError):
        sk.publish(spark, target, {"good": lambda p: sk.write_parquet(df, p), "bad": fail})
    assert not (tmp_path / "release").exists() and not (tmp_path / "release.staging").exists()
    sk.publish(spark, target, {"good": lambda p: sk.write_parquet(df, p)})
    assert spark.read.parquet(f"{target}/good").count() == 3


def test_compare_counts_repeats(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert {r["side"]: r["n"] for r in sk.compare(a, b).collect()} == {"left": 1, "right": 1}
