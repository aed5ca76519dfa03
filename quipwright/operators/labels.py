"""Rule labels: an ordered cascade of forms and a count of domain words, compiled to one expression each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quipwright.functions import text as tx

# Named forms with their patterns, in order of precedence; case does not count.
FORMS = {
    "knock_knock": r"\bknock[,!.\s]+knock\b",
    "light_bulb": r"how many .{1,40} (does|do) it take to (screw|change) .{0,20}bulb",
    "how_many_x": r"\bhow many .{1,40} (does|do) it take\b",
    "doctor_doctor": r"\bdoctor[,!\s]+doctor\b",
    "waiter": r"\bwaiter[,!\s]+(there'?s|there is)\b",
    "walks_into_bar": r"\bwalk(s|ed)? in(to)? a (bar|pub|cafe|café)\b",
    "yo_mama": r"\byo\s+(mama|mamma|momma|mom)\b|\byo(ur)?\s+(mama|mamma|momma|mom|mother)('s)?\s+(is\s+|was\s+)?(so\s+(?!\w+ly\b)|such\b|like\b)",
    "whats_the_difference": r"\bwhat'?s the difference between\b",
    "what_do_you_call": r"\bwhat do you call\b",
    "tom_swifty": r"""["'”]\s*,?\s*(said|replied)\s+\w+\s+\w+ly\s*[."']""",
    "wellerism": r"""["'”]\s*,?\s*(as|said)\s+the\s+\w+.{0,40}(said|when|as)\b""",
    "xiehouyu": r"[一-鿿].{0,30}(——|—{2}|--)",
    "radio_yerevan": r"(radio\s+yerevan|армянское радио|в принципе,? да)",
    "walk_into_group": r"\b(a|an|two|three)\s+\w+(\s*,\s*(a|an)\s+\w+)+\s*,?\s+and\s+(a|an)\s+\w+\b",
    "confucius_say": r"\bconfucius\s+say\b",
    "soviet_russia": r"\bin\s+soviet\s+russia\b",
    "chuck_norris": r"\bchuck\s+norris\b",
    "blonde_joke": r"\b(a|the|this)\s+blonde\b",
    "elephant_joke": r"\b(how (do|can) you (tell|fit|know).{0,30}\belephant|why do(es)? .{0,20}elephant)\b",
    "whats_worse_than": r"\bwhat'?s worse than\b",
    "how_is_x_like_y": r"\b(why|how) (is|are) (a|an|the)? ?\w+ like\b",
    "roses_are_red": r"\broses are red\b",
    "thats_what_she_said": r"\bthat'?s what she said\b",
    "take_my_wife": r"\btake my wife\b[\s.,—-]*please",
    "anti_joke": r"\b(anti[- ]?joke)\b|\bwhy did the chicken cross the road\?\s*to get to the other side\b",
    "shaggy_dog_marker": r"\b(long story short|to make a long story short)\b",
    "paraprosdokian": r"\b(until I|but that'?s not|then I realis|then I realiz)\w*\b.{0,40}$",
    "de_treffen_sich": r"\btreffen sich (zwei|drei)\b",
    "de_arzt": r"\bkommt ein (mann|patient) zum arzt\b",
    "de_beamten": r"\bbeamt(er|en)\b.{0,60}\b(witz|arbeit|schlaf)",
    "ru_shtirlitz": r"\bштирлиц\b",
    "ru_vovochka": r"\bвовочк[аиуе]\b",
    "ru_anekdot_open": r"^\s*(приходит|заходит|встречаются)\s+(мужик|два|три)\b",
    "fr_monsieur_madame": r"\bmonsieur et madame\b.{0,60}\b(ont un fils|ont une fille|comment)",
    "es_que_le_dice": r"¿?\s*qué le dice\b|\bva un \w+ y le dice\b",
    "pt_o_que_e": r"\bo que é,? o que é\b",
    "it_roster": r"\bci sono un(a)? \w+,? un(a)? \w+ e un(a)? \w+\b",
    "ja_dajare": r"(だじゃれ|ダジャレ|親父ギャグ|おやじギャグ)",
    "ko_ajae": r"(아재\s*개그|아재개그)",
    "he_pun_marker": r"\bבדיחה\b",
    "dialogue": r"""^\s*[-–—"']|\b(he|she|they) (said|asked|replied)\b.*["']""",
}
# How a question and a limerick open; lengths of a long tale and of a one-liner; forms that any short text falls into.
QUESTION = r"^\s*(why|what|when|where|who|how|which|did you hear|do you know)\b"
LIMERICK = r"^\s*there\s+(once\s+)?(was|were)\s+an?\b"
LONG_TALE, ONE_LINER, MOST_POINTS = 900, 240, 2
GENERIC = ("one_liner", "setup_punchline", "q_and_a", "dialogue")
#: A small lexicon of our own; a larger one is a parameter, see ``read_lexicon``.
DOMAINS = {
    "animal": ("dog", "cat", "horse", "cow", "duck", "goat", "mule", "parrot", "bee", "bull"),
    "food": ("soup", "pie", "cake", "bread", "cheese", "beer", "coffee", "potatoes", "dinner", "breakfast"),
    "law": ("lawyer", "judge", "court", "bailiff", "jury", "thief", "burglar", "police"),
    "medical": ("doctor", "nurse", "dentist", "patient", "hospital", "surgeon"),
    "music": ("piano", "violin", "choir", "guitar", "orchestra", "singer", "trumpet"),
    "school": ("teacher", "school", "student", "exam", "professor", "homework"),
    "stage": ("stage", "comedy", "magician", "applause", "rehearsal", "audience"),
    "travel": ("train", "bus", "ship", "sailor", "station", "pilot", "tourist", "pier"),
    "work": ("boss", "office", "salary", "clerk", "committee", "plumber", "waiter", "meeting"),
}


def _found(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?iuU){pattern}")


def is_limerick(raw: Column) -> Column:
    """A limerick's opening, and of its first five lines the first two and the next two rhyme, apart from each other.

    Lines are those of the text where it has line breaks, else its clauses; a line must hold a letter.
    """
    lettered = lambda parts: F.filter(F.transform(parts, F.trim), lambda u: u.rlike("[A-Za-z]"))
    units = F.when(raw.contains("\n"), lettered(F.split(raw, "\n"))).otherwise(lettered(F.split(raw, r"[\n;,.!?]+")))
    last = lambda u: F.coalesce(F.element_at(F.regexp_extract_all(u, F.lit(r"([A-Za-z][A-Za-z']*)"), 1), -1), F.lit(""))
    keys = F.transform(F.slice(units, 1, 5), lambda u: tx.end_rhyme(last(u)))
    at = lambda k, i: F.get(k, F.lit(i))
    rhymes = tx.let(keys, lambda k: (F.size(k) == 5) & ~F.exists(k, lambda x: x == "") & (at(k, 0) == at(k, 1)) & (at(k, 2) == at(k, 3)) & (at(k, 0) != at(k, 2)))
    return F.coalesce(F.when(_found(raw, LIMERICK), rhymes), F.lit(False))


def forms(text: Column, setup: Column | None = None, punchline: Column | None = None) -> tuple[Column, Column]:
    """(form, all forms): the first named form, and all that match.

    A limerick comes behind every named form but before 'dialogue'. What has no named form is a shaggy_dog when
    long, q_and_a when it opens with a question that does not end it (or has both parts), setup_punchline when it
    has both parts, one_liner when short and plain, else unknown. One pattern of all forms is tried first, as most
    texts have none. Null is read as empty.
    """
    raw = F.coalesce(text, F.lit(""))
    two = F.lit(False) if setup is None or punchline is None else F.coalesce((setup != "") & (punchline != ""), F.lit(False))

    def judge(t: Column) -> Column:
        any_ = "|".join(f"(?:{p})" for p in FORMS.values())
        named = F.array_compact(F.array(*(F.when(_found(t, p), n) for n, p in FORMS.items())))
        hits = F.when(_found(t, any_), named).otherwise(F.array().cast("array<string>"))

        def choose(h: Column) -> Column:
            first = F.get(h, F.lit(0))
            unnamed = (
                F.when(F.length(t) > LONG_TALE, "shaggy_dog")
                .when(_found(t, QUESTION) & (two | t.contains("?") & ~t.endswith("?")), "q_and_a").when(two, "setup_punchline")
                .when((F.length(t) <= ONE_LINER) & ~t.contains("?") & (F.regexp_count(t, F.lit(r"\.")) <= MOST_POINTS), "one_liner").otherwise("unknown")
            )
            rhymed = F.coalesce(first == "dialogue", F.lit(True)) & is_limerick(raw)
            form = F.when(rhymed, "limerick").otherwise(F.coalesce(first, unnamed))
            every = F.when(rhymed, F.concat(F.array(F.lit("limerick")), h)).when(first.isNotNull(), h).when(unnamed == "unknown", F.array().cast("array<string>")).otherwise(F.array(unnamed))
            return F.struct(form.alias("form"), every.alias("all"))

        return tx.let(hits, choose)

    found = tx.let(tx.squeeze(raw), judge)
    return found["form"], found["all"]


def domain_counts(text: Column, lexicon: Mapping[str, tuple[str, ...]] = DOMAINS) -> Column:
    """array<struct<c, d>> of the domains whose words occur, most hits first (c is negative), ties by name."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pattern = lambda words: r"\b(" + "|".join(tx.quoted(w) for w in words) + r")\b"
    counts = F.array(*(F.struct((-F.regexp_count(low, F.lit(pattern(w)))).alias("c"), F.lit(d).alias("d")) for d, w in lexicon.items()))
    return F.array_sort(F.filter(counts, lambda x: x["c"] < 0))


def read_lexicon(spark: SparkSession, path: str, most: int = 5000) -> dict[str, tuple[str, ...]]:
    """A lexicon from a file of lines ``domain<TAB>word``; at most ``most`` words, as they become part of the plan."""
    rows = spark.read.option("sep", "\t").schema("domain string, word string").csv(path).dropna().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words")
    out: dict[str, list[str]] = {}
    for r in sorted((r["domain"].strip(), r["word"].strip().lower()) for r in rows):
        out.setdefault(r[0], []).append(r[1])
    return {d: tuple(w) for d, w in out.items()}


def label(df: DataFrame, text: str, setup: str | None = None, punchline: str | None = None, lexicon: Mapping[str, tuple[str, ...]] = DOMAINS) -> DataFrame:
    """``df`` with form, all_forms, domain ('general' without a hit), all_domains and hits of the domain named."""
    part = lambda name: F.col(name) if name else None
    form, every = forms(F.col(text), part(setup), part(punchline))
    labelled = df.withColumns({"form": form, "all_forms": every, "_counts": domain_counts(F.col(text), lexicon)})
    best = F.get("_counts", F.lit(0))
    return labelled.withColumns({
        "domain": F.coalesce(best["d"], F.lit("general")), "all_domains": F.transform("_counts", lambda x: x["d"]), "hits": F.coalesce(-best["c"], F.lit(0)),
    }).drop("_counts")


def coverage(labelled: DataFrame, language: str, form: str = "form") -> DataFrame:
    """(language, n, labelled, share, specific, specific_share): how much has a form at all, and how much a form of its own; no language is 'unknown'."""
    has, own = F.col(form) != "unknown", ~F.col(form).isin("unknown", *GENERIC)
    return labelled.groupBy(F.coalesce(F.col(language), F.lit("unknown")).alias("language")).agg(
        F.count("*").alias("n"), F.count_if(has).alias("labelled"), F.round(F.avg(has.cast("double")), 3).alias("share"),
        F.count_if(own).alias("specific"), F.round(F.avg(own.cast("double")), 3).alias("specific_share"),
    )
