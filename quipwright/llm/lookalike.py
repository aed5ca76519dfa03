"""Visually identical text with different characters: one consistent form for every text.

Look-alike pairs over strings and code points are closed into classes by union-find; the member that
the corpus uses most stands for its class; an automaton of all other members rewrites texts greedily,
longest match first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quipwright.session import spread

# Letters of other scripts that are drawn like the Latin letter in front.
LATIN_TWINS = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ",
    "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ",
    "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уγ", "ə": "ә", "æ": "ӕ", "ë": "ё", "Ë": "Ё", "ï": "ї", "Ï": "Ї",
}
# Marks drawn alike.
MARK_TWINS = {"-": "‐‑⁃˗\u2012\u2212\u058a", ";": ";", "·": "·∙⋅", "!": "ǃ", ":": "꞉"}
#: Compatibility decompositions of these kinds change how a character looks; all other kinds do not.
VISIBLE = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
INVISIBLE_EXTRA = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}


def _spaces() -> Iterator[str]:
    return (chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Zs")


def _invisible() -> Iterator[str]:
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch) == "Cf" and not 0x600 <= c <= 0x8FF and c not in (0x110BD, 0x110CD) or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in INVISIBLE_EXTRA:
            yield ch


def _compatible() -> Iterator[tuple[str, str]]:
    """(character, what it is drawn as) by the character database: widths, presentation forms, ligatures, fonts."""
    for c in range(0x80, 0x110000):
        ch = chr(c)
        kind = unicodedata.decomposition(ch)
        if not kind or unicodedata.category(ch) == "Zs" or (kind[0] == "<" and kind.startswith(VISIBLE)):
            continue
        plain = unicodedata.normalize("NFKC", ch) if kind[0] == "<" else unicodedata.normalize("NFC", ch)
        if plain != ch and not any(unicodedata.category(x) == "Zs" for x in plain):
            yield ch, plain


def alike_pairs() -> list[tuple[str, str]]:
    """All known pairs of strings drawn alike, the second the plainer one. Invisible characters pair with ''."""
    pairs = [(ch, " ") for ch in _spaces() if ch != " "]
    pairs += [(ch, "") for ch in _invisible()]
    pairs += list(_compatible())
    for table in (LATIN_TWINS, MARK_TWINS):
        pairs += [(twin, plain) for plain, twins in table.items() for twin in twins]
    return pairs + list(_accented({twin: plain for plain, twins in LATIN_TWINS.items() for twin in twins}))


def _accented(plain: dict[str, str]) -> Iterator[tuple[str, str]]:
    """Letters with accents whose bare letter has a twin, with the twin under the same accents: a Greek and a Latin o with acute."""
    for c in range(0x80, 0x30000):
        bare, *marks = unicodedata.normalize("NFD", chr(c))
        if marks and bare in plain:
            yield unicodedata.normalize("NFC", chr(c)), unicodedata.normalize("NFC", plain[bare] + "".join(marks))


def classes(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Union-find over strings: each member -> a root of its class; the relation becomes transitive."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {x: find(x) for x in list(root)}


def representatives(members: dict[str, str], counts: dict[str, int]) -> dict[str, str]:
    """member -> the class member used most (ties: plain ASCII, then shorter, then smaller); the empty string always stands for its class."""
    best: dict[str, str] = {}
    rank = lambda x: (x != "", -counts.get(x, 0), not x.isascii(), len(x), x)
    for member, root in members.items():
        if root not in best or rank(member) < rank(best[root]):
            best[root] = member
    return {m: best[r] for m, r in members.items() if m and best[r] != m}


def member_counts(texts: DataFrame, members: Iterable[str], column: str = "text") -> DataFrame:
    """(member, n): how often each string of ``members`` occurs, counted over all texts; one row per member at most."""
    singles, several = {m for m in members if len(m) == 1}, sorted(m for m in members if len(m) > 1)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        automaton = _automaton(several)
        seen: Counter = Counter()
        for pdf in frames:
            for text in pdf[column]:
                if text:
                    seen.update(text)
                    if automaton is not None:
                        seen.update(key for _, key in automaton.iter(text))
        found = {k: n for k, n in seen.items() if len(k) > 1 or k in singles}
        yield pd.DataFrame({"member": list(found), "n": list(found.values())}).astype({"member": "str", "n": "int64"})

    return spread(texts.select(column)).mapInPandas(fold, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))


def _automaton(keys: Iterable[str]):
    """Multi-pattern automaton of the keys; None without keys."""
    out = ahocorasick.Automaton()
    for key in keys:
        out.add_word(key, key)
    if not len(out):
        return None
    out.make_automaton()
    return out


class Rewriter:
    """Greedy longest-match rewriting by a table of strings, with accents composed before and after."""

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.single = frozenset(k for k in table if len(k) == 1)
        self.several = _automaton(k for k in table if len(k) > 1)
        self._every = None

    def __getstate__(self) -> dict:
        return {"table": self.table}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["table"])

    @property
    def automaton(self):
        if self._every is None:
            self._every = _automaton(self.table)
        return self._every

    def _has_member(self, text: str) -> bool:
        """Most texts of a corpus hold no member; a search tells them without rewriting."""
        return not self.single.isdisjoint(text) or self.several is not None and next(self.several.iter(text), None) is not None

    def _greedy(self, text: str) -> str:
        out, at = [], 0
        for end, key in self.automaton.iter_long(text):
            start = end - len(key) + 1
            out += (text[at:start], self.table[key])
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def __call__(self, text: str | None) -> str | None:
        """The consistent form; null stays null. Rewriting a form again does not change it."""
        if not text:
            return text
        text = unicodedata.normalize("NFC", text)
        seen: set[str] = set()
        # composing may form another member, which is rewritten in turn, until nothing changes
        while self._has_member(text) and text not in seen:
            seen.add(text)
            text = unicodedata.normalize("NFC", self._greedy(text))
        return text


def build_rewriter(texts: DataFrame, column: str = "text") -> Rewriter:
    """The rewriter of a corpus: classes of alike strings with the corpus' most frequent members as their forms."""
    members = classes(alike_pairs())
    counts = {r["member"]: r["n"] for r in member_counts(texts, members, column).collect()}  # bounded by the relation's size
    return Rewriter(representatives(members, counts))


def canonical(texts: DataFrame, rewriter: Rewriter, column: str = "text", out: str = "form") -> DataFrame:
    """``texts`` with the consistent form of ``column``; null and empty texts keep their value."""
    shared = texts.sparkSession.sparkContext.broadcast(rewriter.table)  # a few thousand entries
    cache: list[Rewriter] = []

    @F.pandas_udf("string")
    def rewrite(column_: pd.Series) -> pd.Series:
        if not cache:
            cache.append(Rewriter(shared.value))
        return column_.map(cache[0], na_action="ignore")

    rows = spread(texts)
    if any(k.isascii() for k in rewriter.table):
        return rows.withColumn(out, rewrite(F.col(column)))
    # where ASCII stands for all its classes, plain ASCII texts are their own forms
    return rows.withColumn(out, F.when(F.col(column).rlike(r"[^\x00-\x7F]"), rewrite(F.col(column))).otherwise(F.col(column)))


def blank(column) -> F.Column:
    return column.isNull() | ~column.rlike(r"[^\s\p{Z}\p{Cf}]")


def alike_records(records: DataFrame) -> DataFrame:
    """(record_id, text, form) of the records of the two lanes whose text is not blank."""
    lanes = records.where("lane in ('wq_multilang', 'wikiquote')").select("record_id", "text").where(~blank(F.col("text")))
    return canonical(lanes, build_rewriter(lanes))


def alike_pairs_of(records: DataFrame) -> DataFrame:
    """(record_a, record_b), a < b: different strings with the same form.

    Only forms with two different strings are joined, and only rows of different strings meet, so
    identical copies make no pairs among themselves however many there are.
    """
    rows = alike_records(records).where("record_id is not null").select("record_id", F.sha2("form", 256).alias("f"), F.sha2("text", 256).alias("s"))
    mixed = rows.groupBy("f").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("f")
    few = rows.join(mixed, "f", "left_semi").select("record_id", "f", "s")
    a, b = few.select(F.col("record_id").alias("record_a"), "f", F.col("s").alias("sa")), few.select(F.col("record_id").alias("record_b"), "f", F.col("s").alias("sb"))
    return a.join(b, "f").where("record_a < record_b and sa <> sb").select("record_a", "record_b").distinct()


def alike_classes(records: DataFrame) -> DataFrame:
    """(record_id, class_id, class_size, strings, links) of the records of the two lanes whose text is not blank.

    class_id is the least record of the form, class_size its records, strings its different strings and links
    the records that a record is paired with: those of another string. Counts only, however large a class is.
    """
    rows = alike_records(records).where("record_id is not null").select("record_id", F.sha2("form", 256).alias("f"), F.sha2("text", 256).alias("s")).distinct()
    strings = rows.groupBy("f", "s").agg(F.count("*").alias("same"), F.min("record_id").alias("first"))
    forms = strings.groupBy("f").agg(F.min("first").alias("class_id"), F.sum("same").alias("class_size"), F.count("*").alias("strings"))
    counted = rows.join(strings.select("f", "s", "same"), ["f", "s"]).join(forms, "f")
    return counted.select("record_id", "class_id", "class_size", "strings", (F.col("class_size") - F.col("same")).alias("links"))
