"""Deterministic sources made of parameters alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ARMS = ("resolved", "unresolved", "literal", "shuffled")


def control_rows(spark: SparkSession, families: int = 30, configs: int = 10, variants: int = 2, seed: int = 7) -> DataFrame:
    """families x configs x arms x variants rows of (item_id, family_id, config_id, arm, variant, split, text).

    Ids hash the parameters; a family lies in one split (eight of ten train, one dev, one test).
    """
    n = families * configs * len(ARMS) * variants
    i = F.col("id")
    rows = spark.range(n).select(
        (i % variants).cast("int").alias("variant"), F.get(F.array(*map(F.lit, ARMS)), (F.floor(i / variants) % len(ARMS)).cast("int")).alias("arm"),
        (F.floor(i / (variants * len(ARMS))) % configs).cast("int").alias("config"), F.floor(i / (variants * len(ARMS) * configs)).cast("int").alias("family"),
    )
    code = lambda prefix, size, *parts: F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *parts), 256), 1, size))
    text = [F.col(c).cast("string") for c in ("family", "config")]
    fold = F.col("family") % 10
    return rows.select(
        code("qc_", 24, *text, F.col("arm"), F.col("variant").cast("string")).alias("item_id"), code("qf_", 12, text[0]).alias("family_id"), code("qk_", 12, *text).alias("config_id"),
        "arm", "variant", F.when(fold == 8, "dev").when(fold == 9, "test").otherwise("train").alias("split"),
        F.format_string("Family %d, case %d: the %s ending, told in way %d.", "family", "config", "arm", F.col("variant") + 1).alias("text"),
    )


# What a generated caption does, its base, and what its variant adds; how the two shapes of a scene lie.
STRATEGIES = {"literal": 0.28, "incongruous": 0.53, "compact_repair": 0.62, "overexplained": 0.39}
VARIANTS = (-0.045, 0.025, 0.055, -0.015, 0.035)
RELATIONS, SHAPES = ("above", "beside", "inside", "apart"), ("circle", "square", "triangle")


def multimodal_rows(spark: SparkSession, contests: int = 30) -> DataFrame:
    """contests x strategies x variants rows of (contest_id, strategy, variant, split, relation, shape, svg, caption, text_only, image_only, fusion, target).

    Everything is a function of the numbers: a scene with a drawing, a caption, features of text, image and both, and a
    target that depends on strategy, scene and their interaction, jittered by a hash.
    """
    names = list(STRATEGIES)
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    i = F.col("id")
    rows = spark.range(contests * len(names) * len(VARIANTS)).select(
        F.floor(i / (len(names) * len(VARIANTS))).cast("int").alias("c"), (F.floor(i / len(VARIANTS)) % len(names)).cast("int").alias("s"), (i % len(VARIANTS)).cast("int").alias("variant")
    )
    c, s, v = F.col("c"), F.col("s"), F.col("variant")
    r = c % len(RELATIONS)
    flag = lambda column, values: [(column == x).cast("double") for x in values]
    made = rows.withColumns({
        "contest_id": F.format_string("contest_%03d", c), "strategy": pick(names, s), "relation": pick(RELATIONS, r), "shape": pick(SHAPES, c % len(SHAPES)), "x": (c * 37 % 100).cast("double"),
        "split": F.when(c % 10 == 0, "test").when(c % 10 == 1, "validation").otherwise("train"),
    })
    made = made.withColumn("caption", F.format_string("A %s caption, told in way %d%s", F.col("strategy"), v + 1, F.when(v % 2 == 0, "!").otherwise("?")))
    made = made.withColumn("svg", F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="200" height="100"><title>%s</title><%s cx="%s"/></svg>', F.col("relation"), F.col("shape"), F.col("x").cast("string")))
    digest = F.sha2(F.concat_ws("|", "contest_id", "strategy", v.cast("string")), 256)
    noise = (F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65535.0 - 0.5) * 0.035
    joint = (((s + 2) * (r + 3)) % 9 - 4) * 0.038
    target = F.round(F.greatest(F.lit(0.02), F.least(F.lit(0.98), pick(list(STRATEGIES.values()), s) + joint + pick(VARIANTS, v) + noise)), 6)
    text = F.array(F.size(F.split("caption", " ")) / 20.0, F.col("caption").contains("?").cast("double"), F.col("caption").contains("!").cast("double"), *flag(F.col("strategy"), names), *flag(v, range(len(VARIANTS))))
    image = F.array(*flag(F.col("relation"), RELATIONS), *flag(F.col("shape"), SHAPES), F.col("x") / 100.0)
    both = F.array(*((F.col("strategy") == a).cast("double") * (F.col("relation") == b).cast("double") for a in names for b in RELATIONS))
    return made.select("contest_id", "strategy", "variant", "split", "relation", "shape", "svg", "caption", text.alias("text_only"), image.alias("image_only"), F.concat(text, image, both).alias("fusion"), target.alias("target"))


def study_tables(spark: SparkSession, writers: int = 6, premises: int = 2, audiences: int = 8) -> tuple[DataFrame, DataFrame]:
    """(materials, responses) of a paired study: every writer's premise in both conditions, every material rated by every audience."""
    i = F.col("id")
    digest = F.sha2(F.lit("config"), 256)
    arm = F.when(i % 2 == 0, "control").otherwise("assisted")
    materials = spark.range(writers * premises * 2).select(
        F.format_string("m_%04d", i).alias("material_id"), F.format_string("w_%02d", F.floor(i / (2 * premises))).alias("writer_id"), F.format_string("p_%02d_%02d", F.floor(i / (2 * premises)), F.floor(i / 2) % premises).alias("premise_id"),
        arm.alias("condition"), (10.0 + i % 5 - F.when(arm == "assisted", 2.0).otherwise(0.0)).alias("minutes_to_draft"), (5.0 + i % 3).alias("voice_preservation_rating"), digest.alias("model_config_digest"), F.lit(True).alias("permission_confirmed"),
    )
    rated = spark.range(writers * premises * 2 * audiences).select((F.floor(i / audiences)).alias("m"), (i % audiences).alias("a"))
    m, a = F.col("m"), F.col("a")
    responses = rated.select(
        F.format_string("r_%05d", m * audiences + a).alias("response_id"), F.format_string("m_%04d", m).alias("material_id"), F.format_string("a_%02d", a).alias("audience_id"), F.round(3.0 + (m * 7 + a * 3) % 5 + (m % 2) * 0.5, 2).alias("rating"),
        F.lit(True).alias("consent_confirmed"), F.timestamp_seconds(F.lit(1_780_000_000) + m * 60 + a).alias("recorded_at"),
    )
    return materials, responses
