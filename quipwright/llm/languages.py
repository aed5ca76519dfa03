"""Languages of documents and of the segments of mixed documents, with confidences.

Every language is a model of words by character n-grams, fitted to labelled sample sentences. A
document is a mixture: expectation-maximisation estimates the proportions of the languages over its
words, a penalised likelihood selects the set of languages, and the best path through the words
(changing language at a cost that is lower at punctuation) gives the segments.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from quipwright.llm.lookalike import LATIN_TWINS, blank
from quipwright.session import default_partitions, spread

ORDER = 4
#: At most this many labelled sentences, and labelled texts of the corpus, per language are used to fit the models.
MAX_SAMPLES, MAX_TEXTS = 5000, 400
#: Cost of one more language, of changing it inside a clause and at its end, in nats.
LANGUAGE_COST, SWITCH, SWITCH_AT_END = 10.0, 14.0, 2.5
#: Words a language needs in one segment, capitalised ones aside, to count as a language of the text.
LEAST_WORDS = 3
#: A capitalised word inside a sentence is probably a name and says little of the language.
NAME_WEIGHT = 0.1

# Usual names of the sample languages, besides their two-letter codes.
LABELS = {
    "en": "eng english anglais englisch ingles inglese",
    "de": "deu ger german deutsch allemand aleman tedesco",
    "fr": "fra fre french francais franzosisch frances",
    "es": "spa spanish espanol castellano castilian spanisch espagnol",
    "pt": "por portuguese portugues portugais portugiesisch brazilianportuguese",
    "it": "ita italian italiano italienisch italien",
    "nl": "nld dut dutch nederlands flemish vlaams niederlandisch",
    "sv": "swe swedish svenska schwedisch",
    "hu": "hun hungarian magyar ungarisch",
    "pl": "pol polish polski polnisch",
    "ru": "rus russian русский russisch russe",
    "el": "ell gre greek ελληνικα moderngreek griechisch",
}

# Phrases that are used in many languages and make no mixture.
SET_PHRASES = (
    "à la carte", "ad hoc", "alter ego", "bon appétit", "carpe diem", "c'est la vie", "comme ci comme ça", "de facto", "déjà vu", "dolce far niente",
    "enfant terrible", "et cetera", "faux pas", "femme fatale", "ha ha", "happy end", "hasta la vista", "je ne sais quoi", "joie de vivre", "la dolce vita",
    "laissez faire", "last but not least", "mamma mia", "mea culpa", "no comment", "noblesse oblige", "per se", "que sera sera", "savoir vivre",
    "status quo", "tour de force", "vice versa", "vis à vis", "voilà",
)
#: Remarks in brackets of at most so many words are asides, not clauses.
ASIDE_WORDS = 3
_ASIDE = re.compile(r"\(([^()]{1,60})\)|\[([^\[\]]{1,60})\]")
_PHRASE = re.compile("|".join(rf"\b{re.escape(p)}\b" for p in SET_PHRASES), re.IGNORECASE)
# a word: letters with combining marks, apostrophes inside
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f]|['’ʼ](?=[^\W\d_]))*")
_INVISIBLE = re.compile("[" + "".join(chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) == "Cf") + "]")
_BREAK, _STOP, _CLAUSE, _QUOTED = re.compile(r"[.!?\n/:;\"“”«»—–|(]"), re.compile(r"[.!?\n]"), re.compile(r"\s-\s|\)"), re.compile(r"[—–/|]\W*$|\s-\W*$")
_TO_LATIN = {twin: plain for plain, twins in LATIN_TWINS.items() for twin in twins}
_FROM_LATIN = {script: {} for script in ("CYRILLIC", "GREEK")}
for _twin, _plain in _TO_LATIN.items():
    for _script, _map in _FROM_LATIN.items():
        if unicodedata.name(_twin, "").startswith(_script):
            _map.setdefault(_plain, _twin)


def _bare(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name).lower() if c.isalpha() and not unicodedata.combining(c))


_CODES = {_bare(name): code for code, names in LABELS.items() for name in (code, *names.split())}


def name_of(label: str | None) -> str | None:
    """The two-letter code a label names, by any usual code or name with any region; None where it names none of LABELS."""
    if not label:
        return None
    return _CODES.get(_bare(re.split(r"[-_@(,;/]", label.strip())[0]).removesuffix("language"))


def plain_ascii(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _one_script(word: str) -> str:
    """A word of look-alike letters from several scripts in the script most of its letters are of."""
    if word.isascii():
        return word
    scripts = Counter(unicodedata.name(c, "?").split(" ")[0] for c in word if c.isalpha())
    if len(scripts) < 2:
        return word
    own = {s: sum(1 for c in word if unicodedata.name(c, "?").startswith(s) and c not in (_TO_LATIN if s != "LATIN" else _FROM_LATIN["CYRILLIC"])) for s in scripts}
    best = max(own, key=lambda s: (own[s], scripts[s]))
    table = _TO_LATIN if best == "LATIN" else _FROM_LATIN.get(best, {})
    return "".join(table.get(c, c) for c in word)


def words_of(text: str) -> list[tuple[str, int, int, bool, bool]]:
    """(word, start, end, is a name or an aside, ends a clause before it) of the text.

    Widths, the coding of accents and invisible characters are undone; positions refer to the text as
    stored. A capitalised word inside a sentence counts as a name, unless the text is all capitals.
    """
    if text.isascii() or unicodedata.is_normalized("NFKC", text) and not _INVISIBLE.search(text):
        flat, at = text, range(len(text))
    else:
        kept, at = [], []
        for i, c in enumerate(text):
            if c.isascii():
                kept.append(c)
                at.append(i)
            elif unicodedata.category(c) != "Cf":
                for d in unicodedata.normalize("NFKC", c):
                    kept.append(d)
                    at.append(i)
        flat = "".join(kept)
    asides = [m.span() for m in _ASIDE.finditer(flat) if len(_WORD.findall(m.group())) <= ASIDE_WORDS] + [m.span() for m in _PHRASE.finditer(flat)]
    shouting = sum(map(str.isupper, flat)) > 0.6 * max(1, sum(map(str.isalpha, flat)))
    out, last = [], 0
    for m in _WORD.finditer(flat):
        gap = flat[last : m.start()]
        sentence = not out or gap != " " and bool(_BREAK.search(gap))
        clause = sentence or gap != " " and ("," in gap or bool(_CLAUSE.search(gap)))
        word = unicodedata.normalize("NFC", m.group())
        # after a dash, a capital is that of whoever is quoted
        quoted = gap != " " and bool(_QUOTED.search(gap)) and not _STOP.search(gap)
        name = word[0].isupper() and (not sentence or quoted) and not shouting or any(a <= m.start() < b for a, b in asides)
        out.append((_one_script(word).lower(), at[m.start()], at[m.end() - 1] + 1, name, clause))
        last = m.end()
    return out


class Models:
    """Word models of the sample languages: P(word | language) from interpolated character n-grams."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({code for code, _ in samples})
        self.index = {code: i for i, code in enumerate(self.languages)}
        self.grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(len(self.languages))) for _ in range(ORDER + 1)]
        self.words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.languages)))
        # names are alike everywhere; a stripped spelling counts a little, as typing without accents is usual
        counts: dict[tuple[str, str], float] = defaultdict(float)
        for code, text in samples:
            for word, _, _, name, _ in words_of(text):
                counts[code, word] += NAME_WEIGHT if name else 1.0
        for (code, word), part in list(counts.items()):
            if (bare := plain_ascii(word)) != word:
                counts[code, bare] += 0.25 * part
        for (code, form), part in counts.items():
            i = self.index[code]
            self.words[form][i] += part
            padded = f"^{form}$"
            for n in range(1, ORDER + 1):
                for at in range(len(padded) - n + 1):
                    self.grams[n][padded[at : at + n]][i] += part
        self.grams = [dict(g) for g in self.grams]
        self.words = dict(self.words)
        self.total = np.maximum(sum(self.words.values(), np.zeros(len(self.languages))), 1.0) if self.words else np.ones(len(self.languages))
        self.letters = np.maximum(sum((v for v in self.grams[1].values()), np.zeros(len(self.languages))), 1.0)
        self.cache: dict[str, np.ndarray] = {}

    def score(self, word: str) -> np.ndarray:
        """log P(word | language) for every language, per word bounded so that no single word decides alone."""
        known = self.cache.get(word)
        if known is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            known = self.cache[word] = self._score(word)
        return known

    def _score(self, word: str) -> np.ndarray:
        zero = np.zeros(len(self.languages))
        padded = f"^{word}$"
        chars = zero.copy()
        for at in range(1, len(padded)):
            p = (self.grams[1].get(padded[at], zero) + 0.05) / (self.letters + 0.05 * 120)
            for n in range(2, ORDER + 1):
                if at - n + 1 < 0:
                    break
                context = self.grams[n - 1].get(padded[at - n + 1 : at], zero)
                p = (self.grams[n].get(padded[at - n + 1 : at + 1], zero) + 2.0 * p) / (context + 2.0)
            chars += np.log(p)
        seen = self.words.get(word, zero) / self.total
        score = np.log(0.6 * seen + 0.4 * np.exp(np.maximum(chars, -60)))
        return np.maximum(score, score.max() - 9.0)


def _path(scores: np.ndarray, ends: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Best sequence of languages for scored words and its log likelihood.

    The languages are two or three and the words a few dozen, for which plain numbers are faster than arrays.
    """
    rows, own = scores.tolist(), prior.tolist()
    each = range(len(own))
    best = [rows[0][i] + own[i] for i in each]
    back: list[list[int]] = []
    for row, end in zip(rows[1:], ends[1:].tolist()):
        # changing from a language costs its prior, so rare languages are entered for good reason only
        source = max(each, key=lambda i: best[i] + own[i])
        change = best[source] + own[source] - (SWITCH_AT_END if end else SWITCH)
        back.append([source if change > best[i] else i for i in each])
        best = [(change if change > best[i] else best[i]) + row[i] for i in each]
    at = max(each, key=best.__getitem__)
    path = [at]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1]), best[at]


def _proportions(scores: np.ndarray) -> np.ndarray:
    """Expectation-maximisation of a text's language proportions over its words."""
    p = np.full(scores.shape[1], 1 / scores.shape[1])
    like = np.exp(scores - scores.max(axis=1, keepdims=True))
    for _ in range(12):
        r = like * p
        r /= r.sum(axis=1, keepdims=True)
        new = (r.sum(axis=0) + 0.05) / (len(scores) + 0.05 * len(p))
        if np.abs(new - p).max() < 1e-3:
            break
        p = new
    return p


def segment(models: Models, text: str) -> tuple[list[tuple[int, int, str, float]], float]:
    """(start, end, language, confidence) of the segments of a text, and the confidence of their set. No words: no segments."""
    words = words_of(text)
    if not words:
        return [], 0.0
    raw = np.array([models.score(w) for w, *_ in words])
    weight = np.array([NAME_WEIGHT if name else 1.0 for _, _, _, name, _ in words])
    scores = (raw - raw.max(axis=1, keepdims=True)) * weight[:, None]
    ends = np.array([clause for *_, clause in words])
    single = scores.sum(axis=0)
    chosen = [int(single.argmax())]
    like = float(single.max())
    plain = np.array([not name for _, _, _, name, _ in words])

    def fit(langs: list[int]) -> tuple[np.ndarray, float]:
        prior = np.log(share[langs] / share[langs].sum())
        path, value = _path(scores[:, langs], ends, prior)
        path = np.array(langs)[path]
        # a language must hold LEAST_WORDS words of one segment; otherwise it is a borrowed word
        cuts = np.flatnonzero(np.diff(path)) + 1
        longest = defaultdict(int)
        for run in np.split(np.arange(len(path)), cuts):
            longest[path[run[0]]] = max(longest[path[run[0]]], int(plain[run].sum()))
        ok = all(longest[x] >= LEAST_WORDS for x in langs[1:]) and longest[langs[0]] > 0
        return path, value if ok else -math.inf

    path = np.full(len(words), chosen[0])
    # no mixture can gain more than the best language of every word would
    hopeless = float(-scores[:, chosen[0]].sum()) < LANGUAGE_COST
    share = None if hopeless else _proportions(scores)
    while not hopeless and len(chosen) < len(models.languages):
        # no path can be worth more than the better of the languages for every word less one change, so the others need no trial
        most = np.maximum(scores, scores[:, chosen].max(axis=1, keepdims=True)).sum(axis=0) - min(SWITCH, SWITCH_AT_END)
        trials = [(x, *fit([*chosen, x])) for x in np.flatnonzero(most - like >= LANGUAGE_COST).tolist() if x not in chosen]
        if not trials:
            break
        x, new_path, value = max(trials, key=lambda t: t[2])
        if value - like < LANGUAGE_COST:
            break
        chosen, path, like = [*chosen, x], new_path, value
    # a first language that the second explains away is given up
    chosen = [x for x in chosen if (path == x).any()]
    out = []
    cuts = np.flatnonzero(np.diff(path)) + 1
    for run in np.split(np.arange(len(path)), cuts):
        here = scores[run].sum(axis=0)
        here -= here.max()
        mine = float(np.exp(here[path[run[0]]]) / np.exp(here).sum())
        out.append((words[run[0]][1], words[run[-1]][2], models.languages[path[run[0]]], mine))
    total = np.exp(single - single.max())
    sure = float(total[chosen[0]] / total.sum()) if len(chosen) == 1 else 1.0 - math.exp(-max(0.0, like - float(single.max()) - LANGUAGE_COST) / 4)
    return out, sure


def _few(rows: DataFrame, most: int) -> list[tuple[str, str]]:
    """At most ``most`` rows (language, text) per language, those of least hash; the limit is applied before any shuffle."""
    some = W.partitionBy("language").orderBy(F.xxhash64("text"), "text")
    kept = rows.where("language is not null and text is not null").select("language", "text").distinct()
    kept = kept.withColumn("r", F.row_number().over(some)).where(F.col("r") <= most).drop("r")
    return sorted((r["language"], r["text"]) for r in kept.collect())  # bounded by most times the number of languages


def fit_models(samples: DataFrame, corpus: DataFrame | None = None) -> Models:
    """Models of ``samples(language, text)``; with ``corpus(label, text)`` refitted once with labelled texts of it.

    Of the corpus those texts count whose label names the one language that the first models see in
    them, at most MAX_TEXTS per language; their words are those the samples cannot hold.
    """
    given = _few(samples, MAX_SAMPLES)
    models = Models(given)
    if corpus is None or not given:
        return models
    # a few texts per spelling of a label are enough to choose from; the limit is applied before any shuffle
    by_label = W.partitionBy("label").orderBy(F.xxhash64("text"), "text")
    labelled = corpus.where("label is not null").select("label", "text").withColumn("r", F.row_number().over(by_label)).where(F.col("r") <= 3 * MAX_TEXTS)
    dealt = labelled.select(F.lit(0).alias("record_id"), "label", "text").repartition(default_partitions(corpus.sparkSession))
    seen = identify(dealt, models, label=F.col("label"), keep_text=True)
    sure = seen.where("size(segments) = 1 and confidence > 0.99 and named = segments[0].language").select(F.col("named").alias("language"), "text")
    return Models(given + _few(sure, MAX_TEXTS))


_SEGMENTS = "array<struct<start:int,end:int,language:string,confidence:double>>"


def identify(records: DataFrame, models: Models, id_col: str = "record_id", text_col: str = "text", label: F.Column | None = None, keep_text: bool = False) -> DataFrame:
    """(id, named, segments, confidence): the language the label names, and the segments of every text; null or blank texts have none, with confidence 0."""
    shared = records.sparkSession.sparkContext.broadcast(models)  # bounded by MAX_SAMPLES

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for pdf in frames:
            results = [segment(fitted, t) if t else ([], 0.0) for t in pdf["text"]]
            yield pd.DataFrame({
                "id": pdf["id"], "named": [name_of(x) for x in pdf["label"]],
                "segments": [[{"start": a, "end": b, "language": x, "confidence": c} for a, b, x, c in s] for s, _ in results],
                "confidence": [c for _, c in results], **({"text": pdf["text"]} if keep_text else {}),
            })

    label = label if label is not None else F.lit(None).cast("string")
    rows = records.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(text_col).alias("text"))
    return spread(rows).mapInPandas(run, f"id long, named string, segments {_SEGMENTS}, confidence double" + ", text string" * keep_text)


def _lane(records: DataFrame) -> DataFrame:
    return records.where("lane = 'wq_multilang' and record_id is not null").where(~blank(F.col("text"))).select("record_id", "text", F.col("meta.language").alias("label"))


def segments_of_lane(records: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_id, language, confidence, position, start, end, segment_language, segment_confidence) of every text of the lane.

    language is that of most code points of the record's segments (ties: the first in the alphabet).
    """
    lane = _lane(records)
    found = identify(lane, fit_models(samples, lane), label=F.col("label"))
    sizes = F.expr("transform(array_sort(array_distinct(segments.language)), l -> struct(aggregate(filter(segments, s -> s.language = l), 0, (a, s) -> a + s.end - s.start) as n, l as l))")
    main = F.expr("aggregate(sizes, cast(null as struct<n:int,l:string>), (a, s) -> case when a is null or s.n > a.n then s else a end).l")
    each = found.withColumn("sizes", sizes).withColumn("language", main).select(F.col("id").alias("record_id"), "language", "confidence", F.posexplode("segments").alias("position", "s"))
    return each.select("record_id", "language", "confidence", "position", "s.start", "s.end", F.col("s.language").alias("segment_language"), F.col("s.confidence").alias("segment_confidence"))


def mislabelled(records: DataFrame, samples: DataFrame) -> DataFrame:
    """(record_id, language): one row per language of a text whose label is missing, wrong or hides a mixture."""
    lane = _lane(records)
    found = identify(lane, fit_models(samples, lane), label=F.col("label"))
    languages = F.array_distinct(F.col("segments.language"))
    judged = found.select("id", "named", languages.alias("languages"))
    wrong = judged.where((F.size("languages") > 1) | (F.size("languages") == 1) & ~F.col("named").eqNullSafe(F.col("languages")[0]))
    return wrong.select(F.col("id").alias("record_id"), F.explode("languages").alias("language")).distinct()
