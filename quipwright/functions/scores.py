"""Composite scores, gates and the reading of free replies, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from quipwright.functions import style as st, text as tx

# The parts of a panel's score that count for a candidate; the one that counts against it, its weight, and what a missing part is read as.
MERITS = ("comedic_structure", "audience_reaction_fit", "timing", "surprise", "cultural_context", "preference_fit", "truth_alignment")
RISK, RISK_WEIGHT = "bad_surprise_risk", 0.75
MISSING = {"truth_alignment": 7, "bad_surprise_risk": 3}
USUAL = 5
# Older names of parts.
ALIASES = {"comedic_structure": "setup_clarity", "cultural_context": "cultural_fit", "repair_strategy": "rewrite_suggestion", "repaired_candidate": "rewrite"}
# What a room's reactions weigh, for and against.
REACTION_WEIGHTS = {"laughter_seconds": 1.4, "applause_level": 1.0, "smile_level": 0.7, "groan_level": -1.2, "confusion_level": -1.4, "silence_seconds": -0.8}
# Words by which a description names an axis of style; the weight of a named axis; what is assumed where none is named.
STYLE_TERMS = {
    "observational": ("observational", "relatable", "everyday"), "storytelling": ("story", "storytelling", "narrative"), "wordplay": ("wordplay", "pun", "language"),
    "absurdist": ("absurd", "weird", "surreal", "alt"), "political": ("politic", "partisan", "ideology", "election"), "personal": ("personal", "family", "identity"),
    "affiliative": ("bridge", "warm", "bond", "affiliative", "not mean"), "aggressive": ("roast", "aggressive", "insult", "attack"), "self_deprecating": ("self-deprecating", "self deprecating", "self"),
    "clean": ("clean", "corporate", "family", "classroom"), "blue": ("blue", "dirty", "adult"), "crowdwork": ("crowdwork", "crowd work", "audience interaction"),
    "intellectual": ("smart", "intellectual", "technical", "science"), "local": ("local", "nyc", "city", "venue"), "dark": ("dark", "bleak", "morbid"),
}
NAMED_AXIS, ASSUMED = 8.0, {"observational": 5.0, "affiliative": 5.0, "clean": 5.0}
AXES = list(STYLE_TERMS)


def clamp(value: Column, low: float, high: float) -> Column:
    """``value`` within the bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def response_score(**parts: Column) -> Column:
    """What a room's reactions add up to, within -10 and 10; a missing or null reaction is none."""
    total = F.lit(0.0)
    for name, weight in REACTION_WEIGHTS.items():
        if name in parts:
            total = total + weight * F.coalesce(parts[name].cast("double"), F.lit(0.0))
    return F.round(clamp(total, -10.0, 10.0), 2)


def laughter_reward(seconds: Column, bursts: Column) -> Column:
    """0 to 1: three seconds are a full hit but for the bursts, each of which adds a little."""
    return F.round(F.least(F.lit(1.0), F.least(F.lit(1.0), seconds / 3.0) * 0.9 + F.least(F.lit(0.2), 0.02 * bursts)), 3)


def tenths(value: Column) -> Column:
    """A whole number from 0 to 10, halves to the even one; what is no number is 0."""
    number = value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), clamp(F.bround(number), 0.0, 10.0)), F.lit(0.0)).cast("int")


def panel_total(parts: Mapping[str, Column]) -> Column:
    """Mean of the merits less the weighted risk."""
    merit = sum((parts[m] for m in MERITS), F.lit(0.0)) / len(MERITS)
    return F.round(merit - RISK_WEIGHT * parts[RISK], 2)


def panel_record(record: Column, fallback: Column | None = None) -> Column:
    """struct of a panel's reply in ``record``, a Variant: texts trimmed, scores as ``tenths``, older names read too, missing scores as usual, and the total.

    A null record has every score as usual.
    """
    def part(name: str, kind: str) -> Column:
        own = F.try_variant_get(record, f"$.{name}", kind)
        return F.coalesce(own, F.try_variant_get(record, f"$.{ALIASES[name]}", kind)) if name in ALIASES else own

    scores = {m: tenths(F.coalesce(part(m, "string"), F.lit(str(MISSING.get(m, USUAL))))) for m in (*MERITS, RISK)}
    said = lambda name: F.trim(F.coalesce(part(name, "string"), F.lit("")))
    named = said("candidate")
    candidate = F.when(named != "", named).otherwise(F.trim(fallback) if fallback is not None else F.lit(""))
    flags = F.filter(F.coalesce(F.try_variant_get(record, "$.risk_flags", "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return F.struct(
        candidate.alias("candidate"), *(c.alias(m) for m, c in scores.items()), flags.alias("risk_flags"), said("why_it_works").alias("why_it_works"),
        said("repair_strategy").alias("repair_strategy"), said("repaired_candidate").alias("repaired_candidate"), panel_total(scores).alias("total"),
    )


def first_object(text: Column) -> Column:
    """The JSON object of a reply as a Variant: all of it, or from the first brace to the last; null if neither is an object."""
    bare = F.trim(text)
    whole, inner = F.try_parse_json(bare), F.try_parse_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def candidates(text: Column, limit: int = 5) -> Column:
    """array<string> of different candidates of a reply, at most ``limit``: of a JSON list or its object, else of its numbered or bulleted items, else its lines.

    White space is squeezed, quotes around a candidate dropped; candidates that differ in case alone are one. No text gives none.
    """
    bare = F.trim(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    listed = F.try_variant_get(F.try_parse_json(bare), "$", "array<string>")
    held = first_object(bare)
    lone = lambda v: F.when(v.isNotNull(), F.array(v))
    inside = F.coalesce(*(F.coalesce(F.try_variant_get(held, f"$.{k}", "array<string>"), lone(F.try_variant_get(held, f"$.{k}", "string"))) for k in ("jokes", "candidates")), none)
    from_json = F.coalesce(listed, F.filter(inside, lambda x: x.isNotNull()), none)
    mark = r"(?m)^\s*(?:\d{1,2}[.)]|[-*])\s+"
    items = F.when(bare.rlike(mark), F.slice(F.split(bare, mark), 2, 1_000_000)).otherwise(none)
    lines = F.transform(F.filter(F.split(bare, r"\r?\n"), lambda x: ~F.trim(x).isin("", "```", "```json")), lambda x: F.regexp_replace(F.trim(x), "^`+|`+$", ""))
    chosen = F.when(F.size(from_json) > 0, from_json).when(F.size(items) > 0, items).otherwise(lines)
    clean = F.filter(F.transform(chosen, lambda x: F.regexp_replace(tx.squeeze(x), '^"+|"+$', "")), lambda x: x != "")
    fold = lambda found, x: F.when(F.exists(found, lambda y: F.lower(y) == F.lower(x)), found).otherwise(F.concat(found, F.array(x)))
    return F.slice(F.aggregate(clean, none, fold), 1, max(1, limit))


def numbered_lines(text: Column) -> Column:
    """array<string> of the lines numbered 1 to 4, quotes around them dropped."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*[1-4][.)](.*)$"), 1)
    return F.transform(found, lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', ""))


def offramp_score(laugh: Column, attacker: Column, audience: Column, warmth_change: Column, flags: Column) -> Column:
    """A reply's laugh score damped by what collides with either side and by lost warmth; 0 with any flag."""
    benign = lambda c: F.greatest(F.lit(0.0), 1 - c / 10.0)
    return F.when(F.size(flags) > 0, 0.0).otherwise(F.round(laugh * benign(attacker) * benign(audience) * clamp(0.5 + warmth_change, 0.0, 1.0), 1))


def callback_score(recall: Column, collision: Column, blocked: Column) -> Column:
    """What quoting a source explains, damped by collision with the person quoted; 0 where blocked."""
    return F.when(F.coalesce(blocked, F.lit("")) != "", 0.0).otherwise(F.round(recall * F.greatest(F.lit(0.0), 1 - collision / 10.0), 3))


def temporal_verdict(with_fact: Column, without_fact: Column) -> Column:
    """struct(gap, evergreen, verdict): how much a text needs a fact beside it, from its resolution with and without."""
    gap = F.greatest(F.lit(0.0), F.round(with_fact - without_fact, 3))
    verdict = F.when((gap < 0.3) & (without_fact >= 0.5), "canonical").when(gap >= 0.8, "topical").otherwise("mixed")
    return F.struct(gap.alias("gap"), F.round(F.greatest(F.lit(0.0), without_fact - 0.5 * gap), 3).alias("evergreen"), verdict.alias("verdict"))


def partisan_verdict(left: Column, right: Column, mirror_left: Column, mirror_right: Column, worst_surprise: Column) -> Column:
    """struct(asymmetry, mirror_asymmetry, flips, verdict) of laugh scores for two personas, and those of the mirrored text (null without one)."""
    gap, mirror = F.round(F.abs(left - right), 1), F.round(F.abs(F.coalesce(mirror_left - mirror_right, F.lit(0.0))), 1)
    flips = mirror_left.isNotNull() & ((left > right) != (F.coalesce(mirror_left, F.lit(0.0)) > F.coalesce(mirror_right, F.lit(0.0)))) & (gap > 8.0) & (mirror > 8.0)
    verdict = F.when(flips | (gap > 12.0) & (worst_surprise >= 5.0), "weapon").when((gap <= 6.0) & (mirror <= 6.0), "bridge").otherwise("leans")
    return F.struct(gap.alias("asymmetry"), mirror.alias("mirror_asymmetry"), flips.alias("flips"), verdict.alias("verdict"))


def style_of(text: Column) -> Column:
    """map(axis -> weight) of the axes a description names; where it names none, a mild everyday style."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = {axis: F.lit(False) for axis in AXES}
    for axis, terms in STYLE_TERMS.items():
        for term in terms:
            named[axis] = named[axis] | low.contains(term)
    none = ~F.greatest(*(c.cast("int") for c in named.values())).cast("boolean")
    return F.create_map(*[x for axis, c in named.items() for x in (F.lit(axis), F.when(c, NAMED_AXIS).when(none, ASSUMED.get(axis, 0.0)).otherwise(0.0))])


def style_shift(current: Column, proposed: Column, lock_in: Column | float = 7.0, overlap: Column | float = 3.0, sensitivity: Column | float = 5.0) -> Column:
    """struct(distance, risk, level, failures) of a change of style: risk grows with the distance and the audience's attachment, and shrinks with common ground.

    failures names the jumps of four or more that an audience takes amiss, 'weak_bridge' if there is none.
    """
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    far = st.distance(current, proposed, AXES)
    risk = F.round(clamp(far * 0.9 + as_column(lock_in) * 0.45 + as_column(sensitivity) * 0.35 - as_column(overlap) * 0.55, 0.0, 10.0), 3)
    at = lambda s, axis: F.get(st.normalized(s, AXES), F.lit(AXES.index(axis)))
    jump = lambda axis: at(proposed, axis) - at(current, axis) >= 4
    failures = F.array_compact(F.array(
        F.when(jump("political"), "repositioning"), F.when(jump("aggressive"), "trust"), F.when(jump("blue") | jump("dark"), "threat"),
        F.when(jump("absurdist") & (at(current, "observational") >= 6), "recognition"),
    ))
    level = F.when(risk >= 7, "high").when(risk >= 4, "medium").otherwise("low")
    return F.struct(F.round(far, 3).alias("distance"), risk.alias("risk"), level.alias("level"), F.when(F.size(failures) > 0, failures).otherwise(F.array(F.lit("weak_bridge"))).alias("failures"))


def terms_of(topics: Column) -> Column:
    """array<string>: the different words of an array of topics, a slash parting words too."""
    return F.array_distinct(F.filter(F.flatten(F.transform(topics, lambda x: F.split(F.lower(x), r"[\s/]+"))), lambda w: w != ""))


def topics_meet(left: Column, right: Column) -> Column:
    return F.coalesce(F.arrays_overlap(terms_of(left), terms_of(right)), F.lit(False))


def topic_share(topic: Column, *texts: Column) -> Column:
    """Share of a topic's words of four letters or more that the texts contain; 0 without such words."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(topic), F.lit("([a-z]{4,})"), 1))
    hay = F.lower(F.concat_ws(" ", *texts))
    return F.coalesce(F.try_divide(F.size(F.filter(terms, lambda t: hay.contains(t))), F.size(terms)), F.lit(0.0))


def axes_address(axes: Column, least: float = 0.08, most: int = 4) -> Column:
    """The strongest poles of a map(first_second -> -1..1), such as ``warm(+0.40)``; 'neutral' if all are weak. Ties go by name."""
    def pole(e: Column) -> Column:
        names = F.split(e["key"], "_", 2)
        return F.format_string("%s(%+.2f)", F.when(e["value"] > 0, F.get(names, F.lit(1))).otherwise(F.get(names, F.lit(0))), e["value"])

    strong = F.filter(F.map_entries(axes), lambda e: F.abs(e["value"]) >= least)
    ranked = F.transform(F.array_sort(F.transform(strong, lambda e: F.struct((-F.abs(e["value"])).alias("a"), e["key"].alias("key"), e["value"].alias("value")))), pole)
    return F.when(F.size(ranked) == 0, "neutral").otherwise(F.array_join(F.slice(ranked, 1, most), " · "))


def axes_match(left: Column, right: Column) -> Column:
    """struct(distance, verdict, widest): Euclidean distance of two maps of axes, in-vibe below 0.45 and off-vibe from 0.9 on, and the axis of the widest gap (ties by name)."""
    gaps = F.map_entries(F.map_zip_with(left, right, lambda _, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)))))
    far = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, e: s + e["value"] * e["value"]))
    widest = F.get(F.array_sort(F.transform(gaps, lambda e: F.struct((-e["value"]).alias("g"), e["key"].alias("k")))), F.lit(0))["k"]
    return F.struct(F.round(far, 3).alias("distance"), F.when(far < 0.45, "in-vibe").when(far < 0.9, "stretch").otherwise("off-vibe").alias("verdict"), widest.alias("widest"))


def share_cut(text: Column, share: float = 0.4) -> Column:
    """struct(setup, punchline): the first ``share`` of the words, at least one, and the rest."""
    def cut(w: Column) -> Column:
        at = F.greatest(F.lit(1), F.floor(F.size(w) * share).cast("int"))
        return F.struct(F.array_join(F.slice(w, F.lit(1), at), " ").alias("setup"), F.array_join(F.slice(w, at + 1, F.greatest(F.lit(0), F.size(w) - at)), " ").alias("punchline"))

    return tx.let(F.split(tx.squeeze(text), " "), cut)


def edit_cut(text: Column, edit: Column) -> Column:
    """struct(setup, punchline, original): what stands before the marked word, and the edit with what follows; null without a mark or where a part is empty."""
    before, after = F.trim(F.regexp_extract(text, r"(?s)^(.*?)<([^/>]+)/>(.*)$", 1)), F.regexp_extract(text, r"(?s)^(.*?)<([^/>]+)/>(.*)$", 3)
    punchline = F.trim(F.concat(edit, after))
    return F.when(text.rlike(r"<([^/>]+)/>") & (before != "") & (punchline != ""), F.struct(before.alias("setup"), punchline.alias("punchline"), tx.marked_word(text).alias("original")))


def masked(text: Column, terms: Sequence[str], instead: str = "a related technical concept") -> Column:
    """Whole words out of ``terms`` replaced, in any case."""
    for term in terms:
        text = F.regexp_replace(text, rf"(?iu)\b{tx.quoted(term)}\b", instead)
    return text


def only_one_of(text: Column, names: Mapping[str, str]) -> Column:
    """The key whose phrase the text contains; null unless it is exactly one."""
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(low.contains(phrase.lower()), key) for key, phrase in names.items())))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def split_by_index(index: Column, validation: int = 8, test: int = 9) -> Column:
    """Split of a running number: of each ten one for validation, one for test."""
    return F.when(F.pmod(index, F.lit(10)) == validation, "validation").when(F.pmod(index, F.lit(10)) == test, "test").otherwise("train")


def joined(*parts: Column) -> Column:
    """Non-empty texts and the non-empty elements of arrays of texts, by blanks."""
    return F.concat_ws(" ", *(F.when(p != "", p) for p in parts))


def stable_id(source: Column, item: Column) -> Column:
    return F.concat_ws(":", F.coalesce(source, F.lit("")), F.coalesce(item, F.lit("")))


def searchable(fields: Sequence[Column], labels: Column, reactions: Column) -> Column:
    """The words an item is found by: its fields, labels, and of its reactions signal, segment and notes; empty ones left out."""
    spoken = F.flatten(F.transform(reactions, lambda r: F.array(r["signal_type"], r["audience_segment"], r["notes"])))
    return F.array_join(F.filter(F.concat(F.array(*fields), F.array(F.array_join(labels, " ")), spoken), lambda x: x.isNotNull() & (x != "")), " ")


def channels(setup: Column, punchline: Column, context: Column, audience: Column, whole: Column, labels: Column, reactions: Column, metadata: Column) -> Column:
    """map(channel -> text) of the five channels an item is embedded by."""
    tags = F.array_join(labels, " ")
    reaction = F.array_join(F.transform(reactions, lambda r: F.concat_ws(" ", r["signal_type"], r["value"].cast("string"), r["audience_segment"], r["notes"])), " ")
    risk = F.concat_ws(" ", *(F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in ("bad_surprise_notes", "risk_flags", "appropriateness", "offense", "confusion")))
    return F.create_map(
        F.lit("text"), whole, F.lit("structure"), F.concat_ws(" ", setup, punchline, tags), F.lit("audience"), F.concat_ws(" ", audience, context, tags), F.lit("reaction"), reaction, F.lit("risk"), risk
    )


def first_filled(meta: Column, keys: Sequence[str] = ("translation_en", "english", "gold", "joke_english", "english_translation")) -> Column:
    """The first of a map's values that is not empty, in the order of ``keys``."""
    return F.coalesce(*(F.when(F.try_element_at(meta, F.lit(k)) != "", F.try_element_at(meta, F.lit(k))) for k in keys))


def filled_slots(template: Column, slots: Column) -> Column:
    """A template with every ``{name}`` of a map replaced by its value."""
    return F.aggregate(F.map_entries(slots), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def chosen_slots(slots: Column, seed: Column) -> Column:
    """map(name -> value): of a map of arrays one value per name, by a hash of the seed and the name; empty arrays give none."""
    full = F.map_filter(slots, lambda _, v: F.size(v) > 0)
    return F.transform_values(full, lambda k, v: F.get(v, F.pmod(F.xxhash64(seed, k), F.size(v).cast("long")).cast("int")))


def unmarked(text: Column) -> Column:
    """A text without the marks of emphasis."""
    return F.trim(F.regexp_replace(text, r"[*_`]+", ""))


def from_percentile(values: Column, share: float) -> Column:
    """Value at a share of a sorted array, between two of them in proportion; null for an empty one."""
    at = (F.size(values) - 1) * F.lit(share)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(F.size(values) > 0, low + (high - low) * (at - F.floor(at)))


def trusted(licence: Column, markers: Sequence[str]) -> Column:
    """A licence that carries one of the marks of curated supply; none is not trusted."""
    low = F.lower(F.coalesce(licence, F.lit("")))
    out = F.lit(False)
    for m in markers:
        out = out | low.contains(m.lower())
    return out
