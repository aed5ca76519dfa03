"""Schemas that drift between files: fingerprints, changes, migration rules and one consistent table.

Every file of a feed has a schema: its fields with the share of lines that carry them and their JSON
type. Where the fingerprints of consecutive schemas of a feed differ they are compared; what ends and
what begins with the same type and content is a rename. The changes are migration steps; chained rename,
default and cast rules lead each file's fields to the feed's latest names and types. A ``Registry`` keeps
the schemas of all files seen, so that new files are compared without reading the old ones again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quipwright.session import listing, materialize, touch

#: A file has a field when at least this share of its readable record lines carries it.
PRESENT = 0.2
#: Least similarity of content for a rename.
SAME_CONTENT = 0.35
#: The same for a field that moves in or out of meta and keeps its own name.
MOVED_CONTENT = 0.15
#: Least share of either value that two booleans must have in common.
SAME_BOOLEAN = 0.6
#: Most columns of the typed table; feeds with more keep the map.
MOST_COLUMNS = 2000
JSON_TYPES = ("string", "number", "boolean", "array", "object")


def read_lines(raw: DataFrame, files: DataFrame) -> DataFrame:
    """(feed, file, created, line_no, v, problem): one row per line; v is a Variant where the line is a record.

    problem is null for records, else 'header', 'blank', 'unreadable' or 'not an object'. Lines of
    files that ``files`` does not list keep a null feed. JSON with a repeated key is unreadable.
    """
    known = files.select("file", "feed", "created")
    line = F.col("line")
    v = F.try_parse_json(line)
    kind = F.schema_of_variant("v")
    problem = (
        F.when(line.isNull() | F.trim(F.regexp_replace(line, r"\s", " ")).eqNullSafe(""), "blank")
        .when(F.col("v").isNull() | ~F.rtrim(F.regexp_replace(line, r"\s", " ")).endswith("}"), "unreadable")
        .when(~kind.startswith("OBJECT"), "not an object")
        .when(F.expr("variant_get(v, '$._meta') is not null"), "header")
    )
    parsed = raw.select("file", "line_no", "line").join(known, "file", "left").withColumn("v", v)
    return parsed.withColumn("problem", problem).select("feed", "file", "created", "line_no", "v", "problem")


def _type_of(value: str) -> Column:
    t = F.expr(f"schema_of_variant({value})")
    return (
        F.when(t == "VOID", None).when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object")
        .when(t == "BOOLEAN", "boolean").when(t.startswith("STRING"), "string").otherwise("number")
    )


def explode_fields(lines: DataFrame) -> DataFrame:
    """(feed, file, created, line_no, field, type, value): one row per key, ``meta.key`` for keys inside an object meta.

    A meta that is no object is a field 'meta' itself. value is the text of a string, null for null, else its JSON.
    """
    records = lines.where("problem is null").select("feed", "file", "created", "line_no", "v")
    top = records.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("v").outer())).select(
        "feed", "file", "created", "line_no", "key", "value"
    )
    top = top.where("key is not null")
    is_meta = (F.col("key") == "meta") & F.expr("schema_of_variant(value)").startswith("OBJECT")
    plain = top.where(~is_meta & ~((F.col("key") == "meta") & F.expr("is_variant_null(value)"))).withColumnRenamed("key", "field")
    inner = top.where(is_meta).withColumnRenamed("key", "_key").withColumnRenamed("value", "_meta")
    nested = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_meta").outer())).where("key is not null").select(
        "feed", "file", "created", "line_no", F.concat(F.lit("meta."), F.col("key")).alias("field"), "value"
    )
    both = plain.select(*nested.columns).union(nested)
    text = F.when(F.expr("schema_of_variant(value)") == "STRING", F.expr("try_variant_get(value, '$', 'string')")).when(
        ~F.expr("is_variant_null(value)"), F.to_json("value")
    )
    return both.select("feed", "file", "created", "line_no", "field", _type_of("value").alias("type"), text.alias("value"))


def file_fields(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """(feed, file, created, n, field, carried, type): the fields each file has.

    A file without readable record lines has no schema and is passed over. type is that of most non-null
    values (ties: the order of JSON_TYPES), null where every value is null.
    """
    sizes = lines.where("problem is null and feed is not null").groupBy("feed", "file", "created").agg(F.count("*").alias("n"))
    by_type = fields.groupBy("file", "field").agg(
        F.count("*").alias("carried"), *(F.count_if(F.col("type") == t).alias(t) for t in JSON_TYPES)
    )
    most = F.greatest(*JSON_TYPES)
    kind = F.when(most > 0, F.coalesce(*(F.when(F.col(t) == most, t) for t in JSON_TYPES)))
    return (
        by_type.withColumn("type", kind).join(sizes, "file").where(F.col("carried") >= PRESENT * F.col("n"))
        .select("feed", "file", "created", "n", "field", "carried", "type")
    )


def numbered(kept: DataFrame) -> DataFrame:
    """``file_fields`` with ``at``, which numbers a feed's files by created; files of one moment follow by name, undated ones come last."""
    files = kept.select("feed", "file", "created").distinct()
    order = W.partitionBy("feed").orderBy(F.col("created").asc_nulls_last(), "file")
    return kept.join(files.withColumn("at", F.row_number().over(order)), ["feed", "file"]).drop(files["created"])


def fingerprints(schemas: DataFrame) -> DataFrame:
    """(feed, file, created, at, fingerprint, version): equal schemas share a fingerprint; version counts a feed's changes of it."""
    print_ = F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(":", "field", F.coalesce("type", F.lit("null")))))), 256)
    each = schemas.groupBy("feed", "file", "created", "at").agg(print_.alias("fingerprint"))
    order = W.partitionBy("feed").orderBy("at")
    changed = (~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(order))).cast("int")
    return each.withColumn("_c", changed).withColumn("version", F.sum("_c").over(order)).drop("_c")


def changed_files(prints: DataFrame) -> DataFrame:
    """(feed, at, file, old_file): the files whose fingerprint differs from that of the one before in their feed."""
    order = W.partitionBy("feed").orderBy("at")
    before = prints.withColumn("old_file", F.lag("file").over(order)).withColumn("_f", F.lag("fingerprint").over(order))
    return before.where("old_file is not null and fingerprint <> _f").select("feed", "at", "file", "old_file")


def _steps(schemas: DataFrame, changed: DataFrame) -> DataFrame:
    """Fields that each of the ``changed`` files adds, removes or retypes against the one before it in its feed."""
    now = schemas.select("file", "field", F.col("type").alias("new_type"), F.lit(True).alias("is")).join(changed, "file")
    was = schemas.select(F.col("file").alias("old_file"), "field", F.col("type").alias("old_type"), F.lit(True).alias("was")).join(changed, "old_file")
    pairs = now.join(was, ["feed", "at", "file", "old_file", "field"], "full")
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return pairs.withColumn("change", change).where("change is not null").drop("was", "is")


def _facets(values: DataFrame) -> DataFrame:
    """(at, file, field, kind, facet): what a value looks like, as itself ('v') and by its form ('s')."""
    elements = F.when(F.col("type") == "array", F.from_json("value", "array<string>")).otherwise(F.array("value"))
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace("x", r"\p{Lu}\p{Ll}*|\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"[0-9]+", "9")
    words = F.size(F.split("x", r"\s+"))
    size = F.log2(F.length("x") + 1.0)
    shape = F.when(words >= 5, F.lit("prose")).otherwise(form)
    number = F.concat(F.when(F.col("x").contains("."), "fraction ").otherwise("whole "), F.ceil(F.length(F.regexp_extract("x", r"^-?([0-9]*)", 1)) / 2.0).cast("string"))
    return values.select("file", "field", "type", F.explode(elements).alias("x")).where("x is not null").select(
        "file", "field", "type", F.col("x").alias("v"), F.when(F.col("type") == "number", number).otherwise(shape).alias("s"), size.alias("size")
    )


def _similarity(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``pairs(feed, at, old, new, type, old_file, file)`` with ``score``: likeness of content plus that of the name.

    Values that repeat are compared by the values themselves, values that do not by their form and
    length. All of it is counts joined on the value, so a long file costs no more than its rows.
    """
    wanted = pairs.select(F.col("old_file").alias("file"), F.col("old").alias("field")).union(pairs.select("file", F.col("new").alias("field"))).distinct()
    facets = materialize(_facets(values.where("type is not null").join(wanted, ["file", "field"])), "facets")
    total = facets.groupBy("file", "field").agg(F.count("*").alias("n"), F.avg("size").alias("size"))
    counts = {k: facets.groupBy("file", "field", k).agg(F.count("*").alias("c")).join(total, ["file", "field"]).withColumn("p", F.col("c") / F.col("n")) for k in "vs"}
    distinct = counts["v"].groupBy("file", "field").agg(F.count("*").alias("d"))
    stats = total.join(distinct, ["file", "field"])
    scored = pairs
    for k in "vs":
        a = counts[k].select(F.col("file").alias("old_file"), F.col("field").alias("old"), k, F.col("p").alias("pa"))
        b = counts[k].select("file", F.col("field").alias("new"), k, F.col("p").alias("pb"))
        shared = pairs.join(a, ["old_file", "old"]).join(b, ["file", "new", k]).groupBy("feed", "at", "old", "new").agg(F.sum(F.least("pa", "pb")).alias(f"o{k}"))
        scored = scored.join(shared, ["feed", "at", "old", "new"], "left").fillna(0.0, [f"o{k}"])
    left = stats.select(F.col("file").alias("old_file"), F.col("field").alias("old"), F.col("n").alias("na"), F.col("d").alias("da"), F.col("size").alias("sa"))
    right = stats.select("file", F.col("field").alias("new"), F.col("n").alias("nb"), F.col("d").alias("db"), F.col("size").alias("sb"))
    scored = scored.join(left, ["old_file", "old"], "left").join(right, ["file", "new"], "left")
    repeats = (F.col("da") <= 0.7 * F.col("na")) & (F.col("db") <= 0.7 * F.col("nb"))
    fresh = (F.col("da") > 0.7 * F.col("na")) & (F.col("db") > 0.7 * F.col("nb"))
    close = F.exp(-F.abs(F.col("sa") - F.col("sb")))
    content = (
        F.when((F.col("type") == "boolean") & (F.col("ov") >= SAME_BOOLEAN), F.col("ov"))
        .when(F.col("type") == "boolean", 0.0)
        .when(F.col("type") == "number", F.col("os") * close)
        .when(F.col("type").isin("array", "object"), F.greatest("ov", F.col("os") * close * F.when(fresh, 1.0).otherwise(0.3)))
        .when(repeats, F.col("ov"))
        .when(fresh, F.col("os") * close)
        .otherwise(F.greatest("ov", 0.4 * F.col("os") * close))
    )
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    near = 1 - F.levenshtein(last("old"), last("new")) / F.greatest(F.length(last("old")), F.length(last("new")))
    moved = last("old") == last("new")
    content = F.coalesce(content, F.lit(0.0))
    score = F.when(moved & (content >= MOVED_CONTENT), 2.0 + content).when(content >= SAME_CONTENT, content + 0.3 * F.greatest(near, F.lit(0.0)))
    return scored.withColumn("score", score)


def one_to_one(scored: DataFrame) -> DataFrame:
    """(feed, at, old, new): of ``scored(feed, at, old, new, score)`` the best pair of a file, then the best of what is left, until none is.

    Ties go by old, then new name. One group holds the possible pairs of one file's fields.
    """
    pair = "struct<old:string,new:string>"
    step = lambda taken, x: F.when(
        F.exists(taken, lambda t: (t["old"] == x["old"]) | (t["new"] == x["new"])), taken
    ).otherwise(F.concat(taken, F.array(F.struct(x["old"].alias("old"), x["new"].alias("new")))))
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worse"), F.col("old").alias("old"), F.col("new").alias("new"))))
    kept = scored.groupBy("feed", "at").agg(best.alias("best")).select("feed", "at", F.aggregate("best", F.array().cast(f"array<{pair}>"), step).alias("taken"))
    return kept.select("feed", "at", F.inline("taken"))


def changes(schemas: DataFrame, fields: DataFrame, changed: DataFrame) -> DataFrame:
    """(feed, at, file, field, change, new_field, old_type, new_type), a rename once under its old name.

    Only ``changed`` files are looked at; ``fields`` must hold them and the ones before them. Of the
    possible partners of an ended field the most alike is taken, one to one. Fields whose values are all
    null are renamed into none, as they have no content.
    """
    steps = materialize(_steps(schemas, changed), "steps")
    gone = steps.where("change = 'removed'").select("feed", "at", "file", "old_file", F.col("field").alias("old"), F.col("old_type").alias("type"))
    came = steps.where("change = 'added'").select("feed", "at", F.col("field").alias("new"), F.col("new_type").alias("type"))
    pairs = materialize(gone.where("type is not null").join(came, ["feed", "at", "type"]), "pairs")
    scored = materialize(_similarity(pairs, fields).where("score is not null").select("feed", "at", "old", "new", "score"), "scored")
    taken = materialize(one_to_one(scored), "renames")
    old = taken.select("feed", "at", F.col("old").alias("field"), F.col("new").alias("new_field"))
    new = taken.select("feed", "at", F.col("new").alias("field"), F.lit(True).alias("_into"))
    merged = steps.join(old, ["feed", "at", "field"], "left").join(new, ["feed", "at", "field"], "left")
    kept = merged.where("not (change = 'added' and _into is not null)")
    renamed = F.when((F.col("change") == "removed") & F.col("new_field").isNotNull(), "renamed").otherwise(F.col("change"))
    return kept.select(
        "feed", "at", "file", "field", renamed.alias("change"), F.when(F.col("change") == "removed", F.col("new_field")).alias("new_field"),
        "old_type", F.when(renamed == "renamed", F.col("old_type")).otherwise(F.col("new_type")).alias("new_type"),
    )


def migrations(schemas: DataFrame, steps: DataFrame) -> DataFrame:
    """(feed, at, field, target, target_type): the name and type each file's field has once all later steps are applied.

    Renames form chains of field lifetimes; the end of each chain is found by pointer doubling, so a
    chain of 2^k renames takes k joins.
    """
    began = steps.where("change = 'added'").select("feed", "at", "field").union(
        steps.where("change = 'renamed'").select("feed", "at", F.col("new_field").alias("field"))
    ).withColumn("_start", F.col("at"))
    life = W.partitionBy("feed", "field").orderBy("at")
    lives = schemas.join(began, ["feed", "at", "field"], "left").withColumn("start", F.coalesce(F.last("_start", ignorenulls=True).over(life), F.lit(1))).drop("_start")
    lives = materialize(lives, "lives")
    ends = lives.groupBy("feed", "field", "start").agg(F.max("at").alias("end"))
    hops = (
        steps.where("change = 'renamed'").select("feed", "field", (F.col("at") - 1).alias("end"), F.col("new_field").alias("to"), F.col("at").alias("to_start"))
        .join(ends, ["feed", "field", "end"]).select("feed", "field", "start", "to", "to_start")
    )
    hops = materialize(hops, "hops")
    for _ in range(40):
        further = hops.select("feed", F.col("field").alias("to"), F.col("start").alias("to_start"), F.col("to").alias("to2"), F.col("to_start").alias("to_start2"))
        joined = hops.join(further, ["feed", "to", "to_start"], "left")
        if not joined.where("to2 is not null").take(1):
            break
        hops = materialize(joined.select("feed", "field", "start", F.coalesce("to2", "to").alias("to"), F.coalesce("to_start2", "to_start").alias("to_start")), "hops")
    placed = lives.join(hops, ["feed", "field", "start"], "left").withColumn("target", F.coalesce("to", "field")).withColumn("t_start", F.coalesce("to_start", "start"))
    final = placed.groupBy("feed", "target", "t_start").agg(F.max_by("type", F.when(F.col("type").isNotNull(), F.col("at"))).alias("target_type"))
    return placed.join(final, ["feed", "target", "t_start"]).select("feed", "at", "file", "field", "target", "target_type")


def defaults_of(rules: DataFrame, given: Mapping[str, str] | None = None) -> DataFrame:
    """(feed, target, target_type, value): every final field of a feed with the text it has where a line has none, null if not given."""
    finals = rules.groupBy("feed", "target").agg(F.max_by("target_type", "at").alias("target_type"))
    if not given:
        return finals.withColumn("value", F.lit(None).cast("string"))
    return finals.withColumn("value", F.element_at(F.create_map(*[F.lit(x) for item in given.items() for x in item]), F.col("target")))


def unify(lines: DataFrame, fields: DataFrame, rules: DataFrame, prints: DataFrame, given: Mapping[str, str] | None = None) -> DataFrame:
    """(feed, file, line_no, version, problem, record, uncast): every line once, its fields under their final names.

    Rules apply in this order: rename along the chain, cast to the final type, default. record maps final
    names to text: numbers and booleans as written, arrays and objects as JSON. A value that does not read
    as the final type is kept out of record and named in uncast. Fields a file carries too rarely to have
    keep their names. Where two fields of a line end under one name, the first non-null by old name is
    taken. A final field of the feed that a record lacks gets its default (``given`` by final name, else
    null), so all records of a feed have its final fields. Lines that are no records come with their
    problem and no record.
    """
    ruled = fields.join(rules.select("file", "field", "target", "target_type"), ["file", "field"], "left")
    kind, text = F.col("target_type"), F.col("value")
    cast = (
        F.when(kind.isNull() | F.col("type").isNull() | (kind == F.col("type")) | (kind == "string"), text)
        .when(kind == "number", F.when(F.expr("try_cast(trim(value) as double)").isNotNull(), F.trim(text)))
        .when(kind == "boolean", F.when(F.lower(F.trim(text)).isin("true", "false"), F.lower(F.trim(text))))
        .when(kind == "array", F.to_json(F.array(text)))
    )
    cells = ruled.select("file", "line_no", F.coalesce("target", "field").alias("name"), "field", text.alias("old"), cast.alias("new"))
    first = cells.groupBy("file", "line_no", "name").agg(
        F.min_by("new", F.when(F.col("new").isNotNull(), F.col("field"))).alias("new"),
        F.max(F.col("old").isNotNull() & F.col("new").isNull()).alias("lost"),
    )
    rows = first.groupBy("file", "line_no").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "new")))).alias("record"),
        F.sort_array(F.collect_list(F.when(F.col("lost") & F.col("new").isNull(), F.col("name")))).alias("uncast"),
    )
    of_feed = defaults_of(rules, given).groupBy("feed").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("target", "value")))).alias("defaults"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    whole = F.map_zip_with(F.coalesce("record", empty), F.coalesce("defaults", empty), lambda _, mine, given: F.coalesce(mine, given))
    whole = F.map_from_entries(F.array_sort(F.map_entries(whole)))
    return (
        lines.select("feed", "file", "line_no", "problem").join(rows, ["file", "line_no"], "left").join(prints.select("file", "version"), "file", "left")
        .join(of_feed, "feed", "left").withColumn("record", F.when(F.col("problem").isNull(), whole))
        .select("feed", "file", "line_no", "version", "problem", "record", "uncast")
    )


def typed(unified: DataFrame, rules: DataFrame) -> DataFrame:
    """The unified table with a typed column per final field: string, double, boolean, array of texts, or JSON of an object.

    Column names are the final names with ``__`` for the dot. A name whose feeds end in different types is
    text. Values of other fields stay in ``rest``. The names are as many as the schemas have fields; above MOST_COLUMNS it raises.
    """
    ends = defaults_of(rules).groupBy("target").agg(F.collect_set("target_type").alias("types")).limit(MOST_COLUMNS + 1).collect()
    if len(ends) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} fields; use the map of the unified table")
    ends = sorted((r["target"], r["types"][0] if len(r["types"]) == 1 else "string") for r in ends)
    columns = []
    for name, kind in ends:
        value = F.col("record")[F.lit(name)]
        if kind == "number":
            value = F.expr("try_cast(record[{}] as double)".format("'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"))
        elif kind == "boolean":
            value = value == "true"
        elif kind == "array":
            value = F.from_json(value, "array<string>")
        columns.append(value.alias(name.replace(".", "__")))
    known = F.array(*[F.lit(n) for n, _ in ends]).cast("array<string>")
    rest = F.map_filter("record", lambda k, _: ~F.array_contains(known, k))
    return unified.select("feed", "file", "line_no", "version", "problem", *columns, rest.alias("rest"), "uncast")


class Drift:
    """Everything about a set of drifting files, computed once per stage: ``changes``, ``table``, ``typed``, ``versions``."""

    def __init__(self, raw: DataFrame, files: DataFrame, defaults: Mapping[str, str] | None = None):
        self.defaults = defaults
        self.lines = read_lines(raw, files)
        self.fields = materialize(explode_fields(self.lines), "fields")
        self.schemas = materialize(numbered(file_fields(self.lines, self.fields)), "schemas")
        self.prints = materialize(fingerprints(self.schemas), "prints")

    def changes(self) -> DataFrame:
        return changes(self.schemas, self.fields, changed_files(self.prints))

    def versions(self) -> DataFrame:
        return self.prints

    def rules(self) -> DataFrame:
        if not hasattr(self, "_rules"):
            self._rules = materialize(migrations(self.schemas, materialize(self.changes(), "changes")), "rules")
        return self._rules

    def table(self) -> DataFrame:
        return unify(self.lines, self.fields, self.rules(), self.prints, self.defaults)

    def typed(self) -> DataFrame:
        return typed(self.table(), self.rules())


class Registry:
    """The schemas of all files seen, kept under one folder: ``update`` with new files, get the changes they make.

    Each update appends the new files' fields and the changes it found; both count once the update's marker is
    written. A file that lands late is placed by its ``created``: it is compared with the one before it, and the one
    after it is compared again. Of two findings for one file the later holds. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _kept(self, name: str) -> DataFrame | None:
        done = listing(self.spark, f"{self.path}/done")
        if not done:
            return None
        return self.spark.read.parquet(*(f"{self.path}/{name}/{run}" for run in done))

    def schemas(self) -> DataFrame | None:
        return self._kept("fields")

    def changes(self) -> DataFrame:
        """(feed, file, field, change, new_field, old_type, new_type) of all files seen."""
        found, seen = self._kept("changes"), self._kept("compared")
        last = seen.groupBy("file").agg(F.max("run").alias("run"))
        return found.join(last, ["file", "run"], "left_semi").drop("run")

    def update(self, raw: DataFrame, files: DataFrame) -> DataFrame:
        """The changes of the new files of ``raw`` and of those that follow one; files seen before are read only where one of these follows them."""
        kept = self.schemas()
        fresh = raw if kept is None else raw.join(kept.select("file").distinct(), "file", "left_anti")
        lines = read_lines(fresh, files)
        fields = materialize(explode_fields(lines), "fields")
        new = materialize(file_fields(lines, fields), "new")
        schemas = new if kept is None else kept.drop("run").unionByName(new)
        schemas = materialize(numbered(schemas), "schemas")
        prints = materialize(fingerprints(schemas), "prints")
        order = W.partitionBy("feed").orderBy("at")
        arrived = prints.join(new.select("file", F.lit(True).alias("_new")).distinct(), "file", "left").withColumn("_after", F.lag("_new").over(order))
        due = materialize(arrived.where("_new or _after").select("file"), "due")
        changed = materialize(changed_files(prints).join(due, "file", "left_semi"), "changed")
        if kept is not None:
            again = changed.select("file").union(changed.select("old_file")).distinct().join(new.select("file"), "file", "left_anti")
            fields = fields.unionByName(explode_fields(read_lines(raw.join(again, "file", "left_semi"), files)))
        found = materialize(changes(schemas, fields, changed).drop("at"), "found")
        run = f"{len(listing(self.spark, f'{self.path}/done')):08d}-{uuid.uuid4().hex}"
        for name, rows in (("fields", new), ("changes", found), ("compared", due)):
            rows.withColumn("run", F.lit(run)).write.parquet(f"{self.path}/{name}/{run}")
        touch(self.spark, f"{self.path}/done/{run}")
        return found
