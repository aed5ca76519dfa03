"""Validation of whole bundles: closed records, studies, ratings, and images with captions and rights, each as a table of problems.

Every function returns rows (record, problem), none for a bundle without problems, so that a bundle of any size is
judged in a few aggregates and joins. ``summary`` counts them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quipwright.functions import text as tx
from quipwright.operators import corpus, retrieval, validate

HEX64, SPLITS = "^[0-9a-f]{64}$", ("train", "validation", "test")
# Fixed value: the form of a key that stands for a person.
PSEUDONYM = "^[a-z][a-z0-9_-]{7,127}$"
# Fields that name a person; fields that hold a secret; rights and licences.
IDENTITY = ("name", "full_name", "email", "phone", "address", "ip", "ip_address", "birth_date", "date_of_birth", "government_id", "username", "handle")
SECRETS = ("api_key", "authorization", "token", "access_token", "secret", "password")
NO_LICENCE = ("", "NOASSERTION", "NONE", "UNKNOWN", "UNLICENSED")
RIGHTS_FLAGS = ("redistribution_allowed", "research_allowed", "derivatives_allowed")
# The arms of a control and the texts it must have.
ARMS = ("expected_literal", "surprising_unresolved", "surprising_resolved", "resolved_overexplained")
CONTROL_TEXTS = ("text", "setup", "punchline", "expected_frame", "alternate_frame")
RATINGS = ("familiarity", "expectedness", "surprise", "resolution", "funniness", "offensiveness", "comprehensibility")


def listed(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(record, problem) for every rule a row breaks."""
    held = validate.problems(df, dict(rules)).select(F.col(key).cast("string").alias("record"), F.explode("problems").alias("problem"))
    return held


def repeated(df: DataFrame, key: str, problem: str) -> DataFrame:
    return validate.duplicates(df, key).select(F.col(key).cast("string").alias("record"), F.lit(problem).alias("problem"))


def closed(df: DataFrame, key: str, record: str, fields: Sequence[str], forbidden: Sequence[str] = IDENTITY) -> DataFrame:
    """(record, problem) of JSON records in ``record``: fields outside the schema, fields missing from it, and fields that may never occur."""
    names = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    known = F.array(*map(F.lit, fields)).cast("array<string>")
    say = lambda word, found: F.transform(F.array_sort(found), lambda x: F.concat(F.lit(f"{word}:"), x))
    every = F.concat(
        F.when(F.json_object_keys(record).isNull(), F.array(F.lit("not an object"))).otherwise(F.array().cast("array<string>")),
        say("missing", F.array_except(known, names)), say("unexpected", F.array_except(names, known)), say("forbidden", F.filter(names, lambda x: F.lower(F.trim(x)).isin(*forbidden))),
    )
    return df.select(F.col(key).cast("string").alias("record"), F.explode(every).alias("problem"))


def number_in(c: Column, low: float, high: float, whole: bool = False) -> Column:
    """Text or number that is finite and in range; a boolean is none."""
    value = c.try_cast("double")
    ok = ~F.isnan(value) & value.between(low, high) & ~F.lower(c.cast("string")).isin("true", "false")
    return ok & (value == F.floor(value)) if whole else ok


def text_in(c: Column, least: int, most: int) -> Column:
    return F.length(c).between(least, most) & (F.trim(c) != "")


def controls(df: DataFrame, licence: str, origin: str = "procedural", arms: Sequence[str] = ARMS) -> DataFrame:
    """Problems of generated controls: ids, arms, splits, origin, texts; ids and texts that repeat; premises in several splits."""
    rules = {
        "invalid_item_id": F.col("item_id").rlike("^oc_[0-9a-f]{24}$"), "invalid_arm": F.col("counterfactual_arm").isin(*arms), "invalid_split": F.col("split").isin(*SPLITS),
        "invalid_origin_or_license": (F.col("license_spdx") == licence) & (F.col("data_origin") == origin), "not_synthetic": F.col("synthetic") & ~F.col("human_authored") & ~F.col("human_rated"),
        "label_given": F.col("funniness_label").isNull(), **{f"invalid_{c}": F.trim(c) != "" for c in CONTROL_TEXTS},
    }
    normal = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1), " ")
    same = df.where("item_id is not null").groupBy(normal.alias("t")).agg(F.min("item_id").alias("record"), F.count("*").alias("n")).where("n > 1").select("record", F.lit("repeated_text").alias("problem"))
    torn = df.groupBy("premise_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.col("premise_id").alias("record"), F.lit("premise_in_several_splits").alias("problem"))
    return listed(df, "item_id", rules).union(repeated(df, "item_id", "repeated_id")).union(same).union(torn)


def ratings(df: DataFrame, items: DataFrame, protocol: str) -> DataFrame:
    """Problems of human ratings: marks of 1 to 7, pseudonymous raters, zoned times, known items, one rating of a rater per item."""
    rules = {
        **{f"{c}_out_of_range": number_in(F.col(c), 1, 7, whole=True) for c in RATINGS}, "rater_not_pseudonymous": F.col("rater_key").rlike(PSEUDONYM),
        "wrong_protocol": F.col("protocol_id") == protocol, "no_consent": F.length("consent_version") >= 2, "time_without_zone": validate.is_zoned_time(F.col("collected_at_utc")),
        "invalid_origin": F.col("data_origin") == "human_observed", "invalid_id": F.length("rating_id") >= 8,
    }
    unknown = validate.orphans(df, items, "item_id", "item_id").select(F.col("rating_id").cast("string").alias("record"), F.lit("unknown_item").alias("problem"))
    twice = df.groupBy("rater_key", "item_id").agg(F.count("*").alias("n"), F.min(F.col("rating_id").cast("string")).alias("record")).where("n > 1").select("record", F.lit("rated_twice").alias("problem"))
    return listed(df, "rating_id", rules).union(repeated(df, "rating_id", "repeated_id")).union(unknown).union(twice)


def contributions(df: DataFrame) -> DataFrame:
    """Problems of texts that people gave: who, that they may, length, language and time."""
    rules = {
        "invalid_id": F.length("contribution_id") >= 8, "contributor_not_pseudonymous": F.col("contributor_key").rlike(PSEUDONYM), "not_affirmed": F.col("authorship_attestation") & F.col("cc0_affirmation"),
        "invalid_origin": (F.col("data_origin") == "human_original") & F.col("human_authored"), "text_length": F.length("text").between(3, 20_000), "language": F.length("language").between(2, 35),
        "no_consent": F.length("consent_version") >= 2, "time_without_zone": validate.is_zoned_time(F.col("submitted_at_utc")),
    }
    return listed(df, "contribution_id", rules).union(repeated(df, "contribution_id", "repeated_id"))


def model_rows(df: DataFrame) -> DataFrame:
    """Problems of texts that models made: provenance, no secrets among the parameters (a JSON object), quarantine."""
    keys = F.json_object_keys("generation_parameters")
    rules = {
        "invalid_id": F.length("candidate_id") >= 8, "text_length": F.length("text").between(3, 20_000), **{f"{c}_required": F.trim(c) != "" for c in ("provider", "model_id", "model_version")},
        "prompt_digest": F.col("prompt_sha256").rlike(HEX64), "parameters_not_an_object": keys.isNotNull(), "secret_parameter": ~F.exists(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.lower(k).isin(*SECRETS)),
        "time_without_zone": validate.is_zoned_time(F.col("generated_at_utc")), "invalid_origin": (F.col("data_origin") == "model_generated_candidate") & ~F.col("human_authored"), "not_quarantined": F.col("release_status") == "quarantined",
    }
    return listed(df, "candidate_id", rules).union(repeated(df, "candidate_id", "repeated_id"))


def rights_of(rights: DataFrame, bases: Sequence[str]) -> DataFrame:
    """Problems of a ledger of rights: basis, licence, all three permissions, a link, evidence with its digest, one row per asset."""
    rules = {
        "no_asset": F.trim("asset_id") != "", "unknown_basis": F.col("rights_basis").isin(*bases), "no_licence": ~F.upper(F.trim("license_spdx")).isin(*NO_LICENCE), **{f"not_{f}": F.col(f) for f in RIGHTS_FLAGS},
        "no_source": F.col("source_url").rlike("^https?://"), "no_evidence": F.col("evidence_sha256").rlike(HEX64) & (F.trim("evidence_path") != ""),
    }
    return listed(rights, "asset_id", rules).union(repeated(rights, "asset_id", "repeated_asset"))


def multimodal(images: DataFrame, captions: DataFrame, rights: DataFrame, bases: Sequence[str], near: int = 4, algorithm: str = "dhash-64-v1") -> DataFrame:
    """Problems of images, captions and rights together: leaks between splits by scene, contest or look, and rows without their counterpart.

    Images of different scenes and splits at most ``near`` bits apart are found by equal bands of their hashes.
    """
    image_rules = {
        "no_contest": F.trim("contest_id") != "", "invalid_split": F.col("split").isin(*SPLITS), "no_scene": F.trim("canonical_scene_group_id") != "", "image_digest": F.col("image_sha256").rlike(HEX64),
        "hash_algorithm": F.col("perceptual_hash_algorithm") == algorithm, "perceptual_hash": F.col("perceptual_hash").rlike("^[0-9a-f]{16}$"),
    }
    named = lambda df, problem: df.select(F.col("record").cast("string").alias("record"), F.lit(problem).alias("problem"))
    torn = images.groupBy("canonical_scene_group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.col("canonical_scene_group_id").alias("record"))
    same = images.groupBy("image_sha256").agg(F.count_distinct("contest_id").alias("n")).where("n > 1").select(F.col("image_sha256").alias("record"))
    owned = rights.where("asset_type = 'image'").select(F.col("asset_id").alias("rights_asset_id"), "contest_id", F.col("asset_sha256").alias("image_sha256"))
    unowned = images.join(owned, ["rights_asset_id", "contest_id", "image_sha256"], "left_anti").select(F.col("contest_id").alias("record"))
    hashed = images.where(F.col("perceptual_hash").rlike("^[0-9a-f]{16}$"))
    high, low = (F.conv(F.substring("perceptual_hash", at, 8), 16, 10).cast("long") for at in (1, 9))
    bits = hashed.select("contest_id", "split", "canonical_scene_group_id", F.shiftleft(high, 32).bitwiseOR(low).alias("bits"))
    pairs = retrieval.near_hashes(bits, "contest_id", "bits", near, near + 1 if near >= 8 else 8)
    side = lambda x: bits.select(F.col("contest_id").alias(x), F.col("split").alias(f"s{x}"), F.col("canonical_scene_group_id").alias(f"g{x}"))
    leaks = pairs.join(side("a"), "a").join(side("b"), "b").where("sa <> sb and ga <> gb").select(F.concat_ws(" ", "a", "b").alias("record"))
    contests = images.select("contest_id", F.col("split").alias("_split")).distinct()
    cohort = rights.where("asset_type = 'caption_cohort'").select(F.col("asset_id").alias("caption_rights_id")).distinct()
    placed = captions.join(contests, "contest_id", "left").join(cohort.withColumn("_owned", F.lit(True)), "caption_rights_id", "left")
    caption_rules = {
        "unknown_contest": F.col("_split").isNotNull(), "caption_in_other_split": F.col("_split").isNull() | (F.col("split") == F.col("_split")), "target_origin": F.col("target_origin") == "human_observed", "no_rights": F.col("_owned"),
        "no_caption": F.trim("caption") != "", "rating_count": F.col("rating_count") >= 1, "target": ~F.isnan("target") & (F.abs("target") < 1e308), "standard_error": F.col("target_standard_error") >= 0,
    }
    parts = [
        listed(images, "contest_id", image_rules), repeated(images, "contest_id", "repeated_contest"), named(torn, "scene_in_several_splits"), named(same, "image_of_several_contests"), named(unowned, "image_without_rights"),
        named(leaks, "near_duplicate_across_splits"), listed(placed, "row_id", caption_rules), repeated(captions, "row_id", "repeated_row"), rights_of(rights, bases),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def study(materials: DataFrame, responses: DataFrame) -> DataFrame:
    """Problems of a paired study: each writer's premise in both arms once, permitted materials, consented responses of known materials, none unrated."""
    material_rules = {
        "condition": F.col("condition").isin("control", "assisted"), "minutes": number_in(F.col("minutes_to_draft"), 0, 1e6), "voice": number_in(F.col("voice_preservation_rating"), 0, 10), "config_digest": F.col("model_config_digest").rlike(HEX64),
        "not_permitted": F.col("permission_confirmed"),
    }
    arms = materials.groupBy("writer_id", "premise_id").agg(F.count_if(F.col("condition") == "control").alias("c"), F.count_if(F.col("condition") == "assisted").alias("a"))
    unpaired = arms.where("c <> 1 or a <> 1").select(F.concat_ws(" ", "writer_id", "premise_id").alias("record"), F.when((F.col("c") == 0) | (F.col("a") == 0), "missing_arm").otherwise("repeated_arm").alias("problem"))
    unknown = validate.orphans(responses, materials, "material_id", "material_id").select(F.col("response_id").cast("string").alias("record"), F.lit("unknown_material").alias("problem"))
    unrated = validate.orphans(materials, responses, "material_id", "material_id").select(F.col("material_id").cast("string").alias("record"), F.lit("unrated_material").alias("problem"))
    response_rules = {"rating": number_in(F.col("rating"), 0, 10), "not_consented": F.col("consent_confirmed"), "no_time": F.col("recorded_at").isNotNull()}
    return (
        listed(materials, "material_id", material_rules).union(repeated(materials, "material_id", "repeated_material")).union(unpaired)
        .union(listed(responses, "response_id", response_rules)).union(repeated(responses, "response_id", "repeated_response")).union(unknown).union(unrated)
    )


# What names a place or a person on the net; the share of arms that the shape of a text may tell.
LINKS, SHAPE_TELLS = r"(?i)https?://|@[a-z0-9_]|\b(?:facebook|instagram|tiktok|youtube|twitter|reddit)\b", 0.8


def audit(df: DataFrame, key: str, text: str, split: str, balanced: Sequence[str], isolated: Sequence[str], single: Sequence[str], labels: Sequence[str] = ()) -> DataFrame:
    """(check, ok, n): the audit of a release, each check with the number that decided it.

    Ids and normalised texts occur once; the values of each of ``balanced`` are equally frequent; no value of ``isolated``
    lies in several splits; each of ``single`` has one value; none of ``labels`` is given; no text has a link or handle;
    and the shape of a text does not tell its first balanced value (n: per 1,000 texts that it tells). A null is a value.
    """
    say = lambda name, ok, n, frame: frame.select(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    normal = F.coalesce(F.array_join(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), " "), F.lit(""))
    whole = df.agg(
        F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.count_if(F.col(text).rlike(LINKS)).alias("links"),
        *(F.count_distinct(value(c)).alias(f"one_{c}") for c in single), *(F.count(c).alias(f"given_{c}") for c in labels),
    )
    texts = df.groupBy(normal.alias("t")).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("n"))
    parts = [
        say("rows_present", F.col("n") > 0, F.col("n"), whole), say("unique_ids", F.col("n") == F.col("ids"), F.col("n") - F.col("ids"), whole), say("unique_texts", F.coalesce("n", F.lit(0)) == 0, F.col("n"), texts),
        say("no_links", F.col("links") == 0, F.col("links"), whole),
    ]
    for c in balanced:
        spread = df.groupBy(c).agg(F.count("*").alias("c")).agg((F.max("c") - F.min("c")).alias("n"))
        parts.append(say("balanced" if len(balanced) == 1 else f"balanced_{c}", F.col("n") == 0, F.col("n"), spread))
    for c in isolated:
        torn = df.groupBy(c).agg(F.count_distinct(split).alias("s")).agg(F.count_if(F.col("s") > 1).alias("n"))
        parts.append(say(f"{c}_isolation", F.col("n") == 0, F.col("n"), torn))
    parts += [say("one_licence" if c == "license" else f"one_{c}", F.col(f"one_{c}") == 1, F.col(f"one_{c}"), whole) for c in single]
    parts += [say(f"no_{c}", F.col(f"given_{c}") == 0, F.col(f"given_{c}"), whole) for c in labels]
    if balanced:
        told = corpus.majority_share(df.where(F.col(text).isNotNull()).select(balanced[0], tx.surface_signature(F.col(text)).alias("shape")), F.col(balanced[0]), "shape")
        parts.append(say("shape_tells", F.col("majority") < SHAPE_TELLS, F.round(F.col("majority") * 1000), told))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def summary(problems: DataFrame) -> DataFrame:
    """(problem, n, first): how often each occurs and the first record that has it."""
    return problems.groupBy("problem").agg(F.count("*").alias("n"), F.min("record").alias("first"))


def retrieval_set(controls_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, qrels) from controls: per premise the resolved text is what the literal setup asks for.

    Of a premise's first configuration (id ending in ``c00``) variant 0 of the resolved arm is the document, and variant 1
    of the literal arm, else variant 0, the query. A premise without both is left out.
    """
    rows = controls_.where(F.col("configuration_id").endswith("c00"))
    document = rows.where("counterfactual_arm = 'surprising_resolved' and surface_variant = 0").groupBy("premise_id").agg(F.min_by(F.struct("item_id", "text", "template_family_id", "split"), "item_id").alias("d"))
    query = rows.where("counterfactual_arm = 'expected_literal' and surface_variant in (0, 1)").groupBy("premise_id").agg(F.min_by(F.struct("setup", "template_family_id", "split"), F.struct(-F.col("surface_variant"), "item_id")).alias("q"))
    both = document.join(query, "premise_id").withColumn("query_id", F.concat(F.lit("query_"), F.substring(F.sha2("premise_id", 256), 1, 18)))
    documents = both.select(F.col("d.item_id").alias("document_id"), "d.text", "premise_id", "d.template_family_id", "d.split")
    queries = both.select("query_id", F.concat("q.setup", F.lit(" Find the reading that resolves it.")).alias("text"), "premise_id", "q.template_family_id", "q.split")
    return documents, queries, both.select("query_id", F.col("d.item_id").alias("document_id"), F.lit(2).alias("relevance"))
