"""String expressions: keys, tokens, splits and edits. All are JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# English function words left out of content words.
STOPWORDS = (
    "a about after all also an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its just like me my no not of on once only or our out"
    " over said say she so some such than that the their them then there they this to until up us was we were what when which while who why will with would you your"
).split()
# Separators between setup and punchline in the order they are tried.
SEPARATORS = ("\n", ". ", "? ", "! ", " — ", " - ", ": ", "; ")
# English names of languages and the codes they stand for.
LANGUAGE_NAMES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "portuguese": "pt", "italian": "it", "dutch": "nl", "swedish": "sv", "hungarian": "hu", "polish": "pl", "russian": "ru", "greek": "el"}
#: Scripts written without spaces need fewer characters to say something.
DENSE_SCRIPTS = r"[぀-ヿ㐀-鿿가-힯]"


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it, also inside other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_text(c: Column) -> Column:
    """Duplicate key: straight quotes, single spaces, no case."""
    return F.lower(squeeze(F.translate(c, "’‘“”", "''\"\"")))


def norm_key(c: Column) -> Column:
    """Letters and digits only, no case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def words(c: Column, pattern: str = "[a-z']+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({pattern})"), 1)


def content_words(c: Column, least: int = 3) -> Column:
    """Words of at least ``least`` letters that are no function words, possessive endings dropped."""
    bare = F.transform(words(c), lambda w: F.regexp_replace(w, "'s$", ""))
    return F.filter(bare, lambda w: (F.length(w) >= least) & ~w.contains("'") & ~w.isin(STOPWORDS))


def digest(*parts: Column, length: int = 20) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length)


def surface_signature(c: Column) -> Column:
    """Coarse shape of a text: bins of words and characters, counts of three marks."""
    count = lambda mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    n = F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1))
    # fixed values: widths of the bins and the last one
    return F.struct(
        F.least(F.floor(n / 5), F.lit(20)).cast("int").alias("words"), F.least(F.floor(F.length(c) / 30), F.lit(20)).cast("int").alias("chars"),
        count(".").alias("points"), count(",").alias("commas"), count(":").alias("colons"),
    )


def syllables(word: Column) -> Column:
    """Vowel groups, less a silent final e, plus one for a final -le after a consonant; at least one, 0 for no letters."""
    bare = F.regexp_replace(F.lower(word), "^'+|'+$", "")
    groups = F.regexp_count(bare, F.lit("[aeiouy]+"))
    silent = (bare.endswith("e") & ~bare.rlike("(le|ee|ye)$") & (groups > 1)).cast("int")
    return F.when(bare == "", 0).otherwise(F.greatest(F.lit(1), groups - silent + bare.rlike("[^aeiouy]le$").cast("int")))


def min_chars(c: Column) -> Column:
    return F.when(c.rlike(DENSE_SCRIPTS), 3).otherwise(8)


def screen(c: Column, deny: str | None = None) -> Column:
    """Long enough for its script, and free of the denied pattern; null is out."""
    long_enough = F.coalesce(F.length(F.trim(c)) >= min_chars(c), F.lit(False))
    return long_enough if deny is None else long_enough & ~c.rlike(f"(?iu){deny}")


def split_pair(c: Column) -> Column:
    """struct(setup, punchline): cut at the last place of the first separator that leaves two words or more behind it, else at 70 % of the words.

    The setup keeps the mark of its separator. Null stays null.
    """

    def cut(text: Column) -> Column:
        parts = F.split(text, r"\s+")
        at = F.greatest(F.lit(1), F.floor(F.size(parts) * 0.7).cast("int"))
        out = F.struct(F.array_join(F.slice(parts, F.lit(1), at), " ").alias("setup"), F.array_join(F.slice(parts, at + 1, F.greatest(F.lit(0), F.size(parts) - at)), " ").alias("punchline"))
        for mark in reversed(SEPARATORS):
            tail = F.substring_index(text, mark, -1)
            size = F.length(text) - F.length(tail)
            setup = F.concat(text.substr(F.lit(1), size - len(mark)), F.lit(mark.strip()))
            out = F.when((size >= len(mark)) & F.trim(tail).rlike(r"\S\s+\S"), F.struct(setup.alias("setup"), F.trim(tail).alias("punchline"))).otherwise(out)
        return out

    return let(F.trim(c), cut)


def screen_pair(setup: Column, punchline: Column) -> Column:
    """Both parts of usable length, the second not contained in the first, neither removed nor a link; null is out."""
    both = F.concat_ws(" ", setup, punchline)
    ok = F.length(setup).between(8, 300) & F.length(punchline).between(2, 200) & ~setup.contains(punchline) & ~both.rlike(r"(?i)https?://|\[(removed|deleted)\]")
    return F.coalesce(ok, F.lit(False))


def marked_word(c: Column) -> Column:
    """The word between the marks of ``<word/>``."""
    return F.regexp_extract(c, "<([^/>]*)/>", 1)


def apply_edit(c: Column, edit: Column) -> Column:
    """The marked word replaced by ``edit``, taken literally."""
    quoted = F.regexp_replace(edit, r"([\\$])", r"\\$1")
    return F.regexp_replace(c, F.lit("<[^/>]*/>"), quoted)


def unmark(c: Column) -> Column:
    return F.regexp_replace(c, "<([^/>]*)/>", "$1")


def dose(c: Column, share: float) -> Column:
    """The first ``share`` of the words, at least one."""
    parts = F.split(F.trim(c), r"\s+")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(parts) * share).cast("int"))), " ")


def language_code(c: Column) -> Column:
    """English language names to codes; anything else lower-cased with dashes."""
    low = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, low), F.replace(low, F.lit("_"), F.lit("-")))


def pos_guess(word: Column) -> Column:
    """A rough part of speech by closed class, capital and ending."""
    low = F.lower(word)
    return (
        F.when(low.isin(STOPWORDS), "function").when(word.rlike("^[0-9]"), "number").when(word.rlike("^[A-Z]"), "name")
        .when(low.endswith("ly") & (F.length(low) > 4), "adverb").when(low.rlike("(ing|ed|ise|ize)$") & (F.length(low) > 4), "verb")
        .when(low.rlike("(ous|ful|ive|able|al|ish|less)$") & (F.length(low) > 4), "adjective").otherwise("noun")
    )


def rhyme_key(word: Column) -> Column:
    """The last vowel group and what follows it."""
    low = F.regexp_replace(F.lower(word), "[^a-z]", "")
    return F.regexp_extract(F.regexp_replace(low, "([^aeiouy])e$", "$1"), "([aeiouy]+[^aeiouy]*)$", 1)


def quoted(word: str) -> str:
    """A word as a pattern that matches it literally."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in word)


def end_rhyme(word: Column) -> Column:
    """Spelling of a word's end by which line ends are compared: the last vowels and what follows, else the last two letters; "on", "om" and "ov" read as with u."""
    low = F.regexp_replace(F.lower(word), "[^a-z]", "")
    tail = F.regexp_extract(low, "([aeiouy]+[^aeiouy]*)$", 1)
    key = F.when(tail != "", tail).otherwise(F.right(low, F.lit(2)))
    return F.regexp_replace(key, "^o([nmv])", "u$1")
