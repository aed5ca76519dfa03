import datetime
import json

from quipwright.operators.schema_drift import Drift, Registry, one_to_one

T0 = datetime.datetime(2026, 1, 1)
RAW, FILES = "file string, line_no int, line string, component int", "file string, lane string, feed string, created timestamp, note string"


def frames(spark, contents, extra=()):
    lines, files = [], []
    for i, (name, rows) in enumerate(contents):
        files.append((name, "x", "feed", T0 + datetime.timedelta(days=i), None))
        lines += [(name, n, r if isinstance(r, str) or r is None else json.dumps(r), 1) for n, r in enumerate(rows)]
    return spark.createDataFrame(lines + list(extra), RAW), spark.createDataFrame(files, FILES)


def drift(spark, contents, extra=()):
    return Drift(*frames(spark, contents, extra))


def found(d):
    return {(r["file"], r["field"], r["change"], r["new_field"]) for r in d.changes().collect()}


def rows(count, **make):
    return [{k: (v(i) if callable(v) else v) for k, v in make.items()} for i in range(count)]


def test_changes_of_every_kind(spark):
    a = rows(10, text=lambda i: f"Sentence number {i} of the first file is here.", kind=lambda i: "ab"[i % 2], n=lambda i: i * 7, meta=lambda i: {"era": "18%d0s" % (i % 3), "page": i + 100})
    b = rows(10, body=lambda i: f"Sentence number {i} of the second file is there.", kind=lambda i: "ab"[i % 2], n=lambda i: str(i), era=lambda i: "18%d0s" % (i % 3), fresh=True, meta=lambda i: {"leaf": i + 120})
    d = drift(spark, [("f1", a), ("f2", b)])
    assert found(d) == {
        ("f2", "text", "renamed", "body"), ("f2", "n", "retyped", None), ("f2", "meta.era", "renamed", "era"), ("f2", "meta.page", "renamed", "meta.leaf"), ("f2", "fresh", "added", None),
    }


def test_same_type_other_content_is_no_rename(spark):
    a = rows(12, style=lambda i: ["dry", "dark"][i % 2], x=1)
    b = rows(12, region=lambda i: ["north", "coast"][i % 2], x=1)
    assert found(drift(spark, [("f1", a), ("f2", b)])) == {("f2", "style", "removed", None), ("f2", "region", "added", None)}


def test_dirt_and_thresholds(spark):
    a = [{"_meta": {"n": 1}}, "", "   ", None, '{"a": 1, "b"', *rows(9, a=1), {"a": None, "stray": 2}, '  {"a": 3}  ']
    b = [*rows(8, a=2), {"a": 2, "late": 1}, {"a": 2, "late": None}]
    d = drift(spark, [("f1", a), ("f2", b)])
    assert {r["problem"]: r["n"] for r in d.lines.groupBy("problem").count().withColumnRenamed("count", "n").collect()} == {"header": 1, "blank": 3, "unreadable": 1, None: 21}
    assert found(d) == {("f2", "late", "added", None)}  # two of ten carry it, null included; one of eleven does not


def test_chained_renames_lead_to_one_table(spark):
    text = lambda i: f"A long enough sentence, number {i}, for a form."
    d = drift(spark, [("f1", rows(6, text=text, n="5")), ("f2", rows(6, joke=text, n=5)), ("f3", rows(6, body=text, n=5)), ("f4", [])])
    table = {(r["file"], r["line_no"]): r for r in d.table().collect()}
    assert len(table) == 18 and all(set(r["record"]) == {"body", "n"} and not r["uncast"] for r in table.values())
    assert [table[f, 0]["version"] for f in ("f1", "f2", "f3")] == [1, 2, 3] and table["f1", 0]["record"]["n"] == "5"


def test_values_that_do_not_cast_are_reported(spark):
    d = drift(spark, [("f1", rows(5, n="many")), ("f2", rows(5, n=3))])
    assert {tuple(r["uncast"]) for r in d.table().where("file = 'f1'").collect()} == {("n",)}


def test_empty_tables(spark):
    d = Drift(spark.createDataFrame([], RAW), spark.createDataFrame([], FILES))
    assert d.changes().count() == 0 and d.table().count() == 0 and d.versions().count() == 0


def test_lines_of_unknown_files_have_no_feed(spark):
    d = drift(spark, [("f1", rows(3, a=1))], [("lost", 1, '{"a": 1}', 1)])
    assert {r["feed"] for r in d.table().where("file = 'lost'").collect()} == {None}
    assert d.changes().count() == 0


def test_booleans_and_moves_need_like_content(spark):
    a = rows(10, nsfw=True, code=lambda i: "0007-%d" % (i + 40), x=1)
    b = rows(10, archived=False, x=1, meta=lambda i: {"code": f"A whole sentence about number {i} and what came of it."})
    assert found(drift(spark, [("f1", a), ("f2", b)])) == {
        ("f2", "nsfw", "removed", None), ("f2", "archived", "added", None), ("f2", "code", "removed", None), ("f2", "meta.code", "added", None),
    }
    c = rows(10, safe=lambda i: i % 3 == 0, x=1)
    d = rows(10, fit=lambda i: i % 3 == 0, x=1)
    assert found(drift(spark, [("f1", c), ("f2", d)])) == {("f2", "safe", "renamed", "fit")}


def test_chains_of_preferences_are_matched_to_the_end(spark):
    scored = [("f", 2, f"o{i}", f"n{j}", 1.0 - 0.1 * i - (0.05 if j == i else 0.0)) for i in range(8) for j in (i - 1, i) if j >= 0]
    got = one_to_one(spark.createDataFrame(scored, "feed string, at int, old string, new string, score double"))
    assert {(r["old"], r["new"]) for r in got.collect()} == {(f"o{i}", f"n{i}") for i in range(8)} and got.count() == 8


def test_many_renames_in_one_file(spark):
    forms = [lambda i, k=k: f"{k}{'-' * k}{i:0{k + 2}d}{'x' * k}" for k in range(7)]
    a = [{f"a{k}": f(i) for k, f in enumerate(forms)} for i in range(8)]
    b = [{f"b{k}": f(i + 3) for k, f in enumerate(forms)} for i in range(8)]
    assert {c for _, _, c, _ in found(drift(spark, [("f1", a), ("f2", b)]))} == {"renamed"}


def test_defaults_and_typed_columns(spark):
    a = rows(4, n="5", text="one")
    b = rows(4, n=7, ok=True, tags=["p", "q"], meta=lambda i: {"era": None if i else "1880s"}, text="two")
    d = Drift(*frames(spark, [("f1", a), ("f2", b)]), defaults={"ok": "false"})
    table = d.typed()
    assert dict(table.dtypes)["n"] == "double" and dict(table.dtypes)["ok"] == "boolean" and dict(table.dtypes)["tags"] == "array<string>"
    got = {(r["file"], r["line_no"]): r for r in table.collect()}
    assert got["f1", 0]["n"] == 5.0 and got["f1", 0]["ok"] is False and got["f1", 0]["meta__era"] is None and got["f1", 0]["tags"] is None
    assert got["f2", 1]["ok"] is True and got["f2", 1]["tags"] == ["p", "q"] and got["f2", 1]["meta__era"] is None and got["f2", 0]["meta__era"] == "1880s"
    assert all(set(r["record"]) == {"n", "ok", "tags", "meta.era", "text"} for r in d.table().collect())


def test_registry_by_parts_is_the_whole(spark, tmp_path):
    text = lambda i: f"A long enough sentence, number {i}, for a form."
    contents = [("f1", rows(6, text=text, n="5")), ("f2", rows(6, joke=text, n=5)), ("f3", rows(6, body=text, n=5)), ("f4", []), ("f5", rows(6, body=text, n=5, k=1))]
    raw, files = frames(spark, contents)
    whole = {tuple(r[c] for c in ("feed", "file", "field", "change", "new_field")) for r in Drift(raw, files).changes().collect()}
    for k, parts in enumerate(([["f1", "f2", "f3", "f4", "f5"]], [["f1"], ["f2", "f3"], ["f4", "f5"]], [["f5", "f2"], ["f1", "f3", "f4"]], [["f3"], ["f1"], ["f2"], ["f5"], ["f4"], []])):
        registry = Registry(spark, f"file://{tmp_path}/r{k}")
        for part in parts:
            registry.update(raw.where(raw["file"].isin([f for p in parts[: parts.index(part) + 1] for f in p])), files)
        assert {tuple(r[c] for c in ("feed", "file", "field", "change", "new_field")) for r in registry.changes().collect()} == whole
