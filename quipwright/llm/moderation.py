"""Abusive, hateful and sexual content: a counterfactually regularised classifier of sentences.

A text is scored by its worst sentence or pair of neighbouring sentences. Features are words and word
pairs with spelling disguises undone, the categories of the lexicon, and pairs of categories. Training
is multinomial logistic regression on a bounded labelled sample; for every sentence that names a group
of people, copies with other groups in its place are made, and changes of the scores between copies
are penalised, so that naming a group counts for nothing by itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quipwright.llm.languages import _one_script
from quipwright.llm.lexicon import IDENTITIES, PHRASES, SEEDS, WORDS
from quipwright.session import spread

CLASSES = ("clean", "abusive", "hateful", "sexual")
#: Labelled texts used for training at most, those of least hash.
MAX_SAMPLE = 20_000
#: Ridge of the weights, weight of the counterfactual penalty, and copies per sentence.
RIDGE, COUNTERFACTUAL, COPIES = 0.002, 2.0, 6
#: Score from which a text is found; what nothing is known of scores about 0.13, so this asks for some evidence.
THRESHOLD = 0.3
#: Score of being clean for a unit of which nothing is known.
CLEAN = 3.0

_LEET = str.maketrans({"$": "s", "@": "a", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "!": "i", "€": "e", "+": "t"})
_TOKEN = re.compile(r"[^\W\d_][\w$@*#€+]*(?:[*#$@!€+][\w$@*#!€+]*)*|[$@€][\w$@*#!€+]+|\d+[^\W\d_][\w$@*#!]*|\d+")
# single characters spaced out by blanks, or short pieces parted by dots, dashes, underscores or points
_SPACED = re.compile(
    r"(?<![\w$@'’])[\w$@](?: [\w$@]){2,}(?![\w$@])"
    r"|(?<![\w$@])(?:[\w$@](?=[.\-_·]))(?:([.\-_·])[\w$@](?=\1|[\w$@]|\W|$)){1,}(?:\1?[\w$@]+)?"
)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”'’)]*\s+|\n+")


@lru_cache(maxsize=1 << 17)
def fold(word: str) -> str:
    """A word without accents and doubled letters."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).replace("ß", "ss").replace("ł", "l").replace("ς", "σ")
    return re.sub(r"(.)\1+", r"\1", bare)


_CATEGORY: dict[str, set[str]] = defaultdict(set)
for _name, _list in WORDS.items():
    for _word in _list.split():
        _CATEGORY[fold(_word)].add(_name)
_PHRASE = ahocorasick.Automaton()
for _name, _list in PHRASES.items():
    for _phrase in _list:
        _key = f" {' '.join(map(fold, _phrase.split()))} "
        _PHRASE.add_word(_key, (_name, *_PHRASE.get(_key, ())))
_PHRASE.make_automaton()
_BY_SHAPE: dict[tuple[str, str, int], list[str]] = defaultdict(list)
for _list in (WORDS["insult"], WORDS["slight"], WORDS["curse"], WORDS["beast"], WORDS["body"], WORDS["sex"]):
    for _word in _list.split():
        _BY_SHAPE[_word[0], _word[-1], len(_word)].append(_word)


def plain(text: str) -> str:
    """Text with widths, invisible characters and look-alike letters undone and spaced-out words joined."""
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    text = re.sub(r"[^\W\d_]+", lambda m: _one_script(m.group()), text) if not text.isascii() else text

    def join(m: re.Match) -> str:
        return re.sub(r"[ .\-_*·]", "", m.group())

    return _SPACED.sub(join, text)


@lru_cache(maxsize=1 << 17)
def _word(token: str) -> str:
    """The word a token stands for: digits and signs read as letters, stars filled by a word of that shape."""
    if token.isdigit():
        return "0"
    low = token.lower()
    if "*" in low or "#" in low:
        shape = _BY_SHAPE.get((low[0].translate(_LEET), low[-1].translate(_LEET), len(low)), []) if low[-1] not in "*#" else []
        fits = [w for w in shape if all(a in "*#" or a == b for a, b in zip(low, w))]
        return fits[0] if fits else low
    if not low.isalpha() and any(c.isalpha() for c in low):
        low = low.rstrip("!").translate(_LEET) if not re.fullmatch(r"[^\W\d_]+!*", low) else low.rstrip("!")
    return low


def tokens(sentence: str) -> list[tuple[str, bool]]:
    """(folded word, looks like a name) of a sentence already made plain."""
    out = []
    letters = [c for c in sentence if c.isalpha()]
    shouting = sum(c.isupper() for c in letters) > 0.6 * max(1, len(letters))
    for m in _TOKEN.finditer(sentence):
        word = fold(_word(m.group()))
        after = sentence[m.end() : m.end() + 1]
        first = not out
        known = bool(_CATEGORY.get(word))
        name = m.group()[0].isupper() and not shouting and not known and (not first or after == ",") and len(word) > 2
        out.append((word, name))
    return out


def units(text: str | None) -> list[str]:
    """Sentences of a text and pairs of neighbouring ones; a sentence cut short by a disguise stays with its neighbour in a pair."""
    parts = [p for p in _SENTENCE.split(plain(text or "")) if p and p.strip()]
    return parts + [f"{a} {b}" for a, b in zip(parts, parts[1:])]


def features(unit: str) -> list[str]:
    words = tokens(unit)
    flow = ["_p" if name else w for w, name in words]
    joined = f" {' '.join(w for w, _ in words)} "
    cats = set()
    for w, name in words:
        cats |= _CATEGORY.get(w, set())
        if name:
            cats.add("name")
    cats |= {name for _, names in _PHRASE.iter(joined) for name in names}
    out = {f"w {w}" for w in flow}
    # group names of every kind read alike in word pairs, and so do persons
    alike = ["_g" if "group" in _CATEGORY.get(w, ()) else "_p" if w == "_p" or "you" in _CATEGORY.get(w, ()) else w for w in flow]
    out |= {f"b {a} {b}" for a, b in zip(alike, alike[1:])}
    out |= {f"t {a} {b} {c}" for a, b, c in zip(alike, alike[1:], alike[2:])}
    kinds = sorted(cats)
    out |= {f"c {k}" for k in kinds}
    out |= {f"cc {a} {b}" for i, a in enumerate(kinds) for b in kinds[i + 1 :]}
    return sorted(out)


def _scale(feature: str) -> float:
    """How freely a feature may carry weight: categories generalise, word runs hardly do, a name alone says little."""
    if feature in ("c name", "w _p"):
        return 0.3
    return {"c": 1.6, "cc": 1.3, "w": 1.0, "b": 0.6, "t": 0.4}[feature.split(" ", 1)[0]]


_IDENTITY = {term: language for language, terms in IDENTITIES.items() for term in terms}
_NAMED = re.compile(r"(?<![^\W\d_])(?:" + "|".join(map(re.escape, sorted(_IDENTITY, key=len, reverse=True))) + r")(?![^\W\d_])", re.IGNORECASE)


def _swapped(sentence: str) -> list[str]:
    """Copies of a sentence with every group of people it names replaced by others of its language."""
    named = [m.group().lower() for m in _NAMED.finditer(sentence)]
    if not named:
        return []

    def copy(shift: int) -> str:
        def other(m: re.Match) -> str:
            terms = IDENTITIES[_IDENTITY[m.group().lower()]]
            return terms[(terms.index(m.group().lower()) + shift) % len(terms)]

        return _NAMED.sub(other, sentence)

    most = min(len(IDENTITIES[_IDENTITY[t]]) for t in named) - 1
    return [copy(shift) for shift in range(1, most + 1, max(1, most // COPIES))][:COPIES]


class Classifier:
    """P(class | unit); ``fit`` takes (text, label) pairs, ``score`` a text."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(CLASSES)))

    def _ids(self, unit: str, grow: bool) -> list[int]:
        if grow:
            return [self.index.setdefault(f, len(self.index)) for f in features(unit)]
        return [i for f in features(unit) if (i := self.index.get(f)) is not None]

    def fit(self, sample: list[tuple[str, str]], rounds: int = 4, steps: int = 250) -> Classifier:
        """Sentences of an offending text inherit its label only where they are the likeliest to carry it; the rest are clean."""
        bags = [(units(t), CLASSES.index(label)) for t, label in sample]
        bags += [([s.format(p=p, g=g)], CLASSES.index(label)) for label, seeds in SEEDS.items() for s in seeds for p, g in (("Alex", "foreigners"), ("you", "women"), ("Robin Miller", "old people"))]
        bags = [(u, y) for u, y in bags if u]
        x = [[self._ids(unit, True) for unit in u] for u, _ in bags]
        scale = np.array([_scale(f) for f in self.index])
        pairs = [(self._ids(u, True), self._ids(c, True)) for us, y in bags for u in us for c in _swapped(u)]
        scale = np.array([_scale(f) for f in self.index])
        target = [self._first_guess(u, y) for u, y in bags]
        self.weights = np.zeros((len(self.index), len(CLASSES)))
        for _ in range(rounds):
            self._descend(x, bags, target, pairs, scale, steps)
            target = []
            for ids, (us, y) in zip(x, bags):
                best = max(range(len(us)), key=lambda i: (self._proba(ids[i])[y] - 0.02 * len(us[i]) / 100)) if y else 0
                target.append(best)
        return self

    @staticmethod
    def _first_guess(us: list[str], y: int) -> int:
        if not y:
            return 0
        wanted = {1: {"insult", "off", "curse", "slight", "harm"}, 2: {"group", "beast"}, 3: {"sex", "body", "sexact"}}[y]
        rate = lambda u: len({f[2:] for f in features(u) if f.startswith("c ")} & wanted) / (1 + len(u) / 200)
        return max(range(len(us)), key=lambda i: rate(us[i]))

    def _descend(self, x, bags, target, pairs, scale, steps: int) -> None:
        rows, labels, weight = [], [], []
        for ids, (us, y), best in zip(x, bags, target):
            single = (len(us) + 1) // 2
            for i, features_ in enumerate(ids):
                holds = y and (i == best or i >= single and best in (i - single, i - single + 1))
                if y and not holds and best >= single and i in (best - single, best - single + 1):
                    continue  # half of the offending pair: unknown
                rows.append(features_)
                labels.append(y if holds else 0)
                weight.append(1.0 if not y or i == best else 0.3)
        first = len(rows)
        for a, b in pairs:
            rows += [a, b]
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.fromiter((c for r in rows for c in r), np.int64, len(row))
        size = np.sqrt(np.maximum([len(r) for r in rows], 1))
        value = scale[col] / size[row] * 3
        onehot = np.eye(len(CLASSES))[labels]
        balance = np.array(weight)
        balance[np.array(labels) > 0] *= 1.5
        w, m, v = self.weights, np.zeros_like(self.weights), np.zeros_like(self.weights)
        for step in range(1, steps + 1):
            z = np.stack([np.bincount(row, weights=value * w[col, k], minlength=len(rows)) for k in range(len(CLASSES))], axis=1)
            z[:, 0] += CLEAN
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = np.zeros_like(p)
            g[:first] = balance[:, None] * (p[:first] - onehot) / first
            if pairs:
                gap = z[first::2] - z[first + 1 :: 2]
                g[first::2] = COUNTERFACTUAL * gap / (len(pairs) * len(CLASSES))
                g[first + 1 :: 2] = -g[first::2]
            grad = np.stack([np.bincount(col, weights=value * g[row, k], minlength=len(w)) for k in range(len(CLASSES))], axis=1) + RIDGE * w / len(CLASSES) / 4
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.scale = w, scale

    def _proba(self, ids: list[int]) -> np.ndarray:
        n = np.sqrt(max(len(ids), 1))
        z = (self.scale[ids, None] * self.weights[ids]).sum(axis=0) / n * 3
        z[0] += CLEAN
        p = np.exp(z - z.max())
        return p / p.sum()

    def proba(self, unit: str) -> np.ndarray:
        found = features(unit)
        ids = [i for f in found if (i := self.index.get(f)) is not None]
        # unknown features keep their place in the norm, so that a long unknown text is not judged by one word
        n = np.sqrt(max(len(found), 1))
        z = (self.scale[ids, None] * self.weights[ids]).sum(axis=0) / n * 3
        z[0] += CLEAN
        p = np.exp(z - z.max())
        return p / p.sum()

    def score(self, text: str | None) -> tuple[float, str]:
        """(1 - P(clean) of the worst unit, its likeliest offending class); (0, clean) for a text without words."""
        worst, label = 0.0, "clean"
        for unit in units(text):
            p = self.proba(unit)
            if 1 - p[0] > worst:
                worst, label = float(1 - p[0]), CLASSES[1 + int(p[1:].argmax())]
        return worst, label if worst >= THRESHOLD else "clean"


def fit(labels: DataFrame) -> Classifier:
    """A classifier from ``labels(text, label)``: rows without text or with an unknown label are not used, repeated rows once."""
    known = labels.where(F.col("label").isin(*CLASSES) & F.col("text").isNotNull()).select("text", "label").distinct()
    rows = known.orderBy(F.xxhash64("text"), "text", "label").limit(MAX_SAMPLE).collect()
    return Classifier().fit(sorted((r["text"], r["label"]) for r in rows))


def score_records(records: DataFrame, model: Classifier) -> DataFrame:
    """(record_id, source, score, label) of ``records(record_id, source, text)``; null and blank texts score 0."""
    shared = records.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            results = [fitted.score(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([s for s, _ in results], pa.float64()), pa.array([x for _, x in results], pa.string())],
                names=["record_id", "source", "score", "label"],
            )

    rows = records.select(F.col("record_id").cast("long").alias("record_id"), "source", "text")
    return spread(rows).mapInArrow(run, "record_id long, source string, score double, label string")


def scored_lane(records: DataFrame, labels: DataFrame) -> DataFrame:
    return score_records(records.where("lane = 'icanhazdadjoke'"), fit(labels))


def rates(scored: DataFrame) -> DataFrame:
    """(source, n, n_found, rate, abusive, hateful, sexual): a null source is a source of its own."""
    found = F.col("score") >= THRESHOLD
    return scored.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(found).alias("n_found"), F.avg(found.cast("double")).alias("rate"),
        *(F.count_if(F.col("label") == c).alias(c) for c in CLASSES[1:]),
    )


def group_mentions(records: DataFrame, scored: DataFrame) -> DataFrame:
    """(language, term, n, n_found, rate): of the records that name a group, how many are found; the place to see false findings on mere mentions.

    A record counts once per term; records without id, and terms that no record names, have no row.
    """
    terms = records.sparkSession.createDataFrame(sorted((t, g) for t, g in _IDENTITY.items()), "term string, language string")
    pattern = r"(?<!\p{L})(" + "|".join(sorted(_IDENTITY, key=len, reverse=True)) + r")(?!\p{L})"
    named = records.where("record_id is not null").select("record_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 1))).alias("term"))
    found = (F.col("score") >= THRESHOLD).cast("int")
    best = scored.groupBy("record_id").agg(F.max(found).alias("found"))
    rows = named.distinct().join(best, "record_id").groupBy("term").agg(F.count("*").alias("n"), F.sum("found").alias("n_found"))
    return rows.join(F.broadcast(terms), "term").select("language", "term", "n", "n_found", (F.col("n_found") / F.col("n")).alias("rate"))  # as many rows as there are terms
