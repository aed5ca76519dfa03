"""Long exact spans shared between records, by super-k-mer partitioning.

A window of ``length`` code points is told by its minimiser, the least hash among its k-grams. Runs of
consecutive windows of one document with the same minimiser form a super-k-mer, cut alike wherever the
same text occurs. A window can only recur under the same minimiser, so the work is done in three steps:

1. the minimisers alone are counted by partial aggregation; those of a single document end here;
2. the texts are cut again, and only super-k-mers of shared minimisers travel, as (minimiser, digest of
   the string); one whose digest occurs in two documents is shared as a whole;
3. where one minimiser has several different strings, one copy of each string travels packed to the
   minimiser's bucket, is cut into its windows, and the windows are counted exactly.

Cutting is cheap next to moving, so it is done in every step; whole texts never travel. Steps 2 and 3 ask a
one-hash Bloom filter of bounded size before they send a row and an exact join afterwards: a full filter
costs traffic, never a result.

Nothing is normalised; positions are code points of the text as stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from quipwright.session import materialize, release, spread

LENGTH = 200
#: Length of the k-grams that serve as minimisers; longer ones are rarer by chance but cut more super-k-mers.
SEED = 96
#: A filter has so many bits per entry, rounded up to a power of two of at most MOST_BITS (32 MB); nothing else is broadcast.
BITS_PER_ENTRY, LEAST_BITS, MOST_BITS = 32, 16, 28
#: A filter is made in pieces of so many bits (as a power of two), and a task makes so many pieces: 1 MB.
PIECE_BITS, PIECES = 18, 32
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))


_known: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    kept = _known.get(int(base))
    if kept is None or len(kept) < n:
        kept = _known[int(base)] = _grow(base, 1 << max(16, (n - 1).bit_length()))
    return kept[:n]


def _grow(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + more] = out[:more] * (out[done - 1] * base)
        done += more
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones, in two passes over blocks of that width."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def super_kmers(points: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of the super-k-mers of one text of code points, in order."""
    if len(points) < length:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    # the whole row in pieces, so that memory does not grow with the text; pieces overlap by one window less one
    step, parts = 1 << 20, []
    for at in range(0, len(points) - length + 1, step):
        piece = points[at : at + step + length - 1].astype(np.uint64)
        # arithmetic modulo 2**64: sums of code points times powers give the hash of every k-gram by subtraction
        mixed = _mix(piece + np.uint64(1))
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(mixed * _powers(_PRIME, len(piece)), dtype=np.uint64, out=sums[1:])
        grams = (sums[seed:] - sums[:-seed]) * _powers(_INVERSE, len(piece) - seed + 1)
        parts.append(_sliding_min(_mix(grams), length - seed + 1))
    least = np.concatenate(parts)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[first], first, np.diff(np.append(first, len(least)))


def _pack(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _digest(points: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(points.tobytes())


def _long_enough(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    return spread(docs.where(F.col(id_col).isNotNull() & (F.length(text_col) >= length)).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")))


def minimisers(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, m): the distinct minimisers of each text of ``docs(doc, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, m = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                least = np.unique(super_kmers(_pack(text), length)[0])
                doc.append(np.full(len(least), key, np.int64))
                m.append(least.view(np.int64))
            if doc:
                yield pa.record_batch([pa.array(np.concatenate(doc)), pa.array(np.concatenate(m))], names=["doc", "m"])

    return docs.mapInArrow(run, "doc long, m long")


def _filter(entries: DataFrame, key: str = "m") -> np.ndarray:
    """Bit set of the low bits of ``key``, made in pieces by the tasks; the driver takes in the bytes of a task's pieces at a time, 2**(MOST_BITS - 3) in all."""
    wide = max(LEAST_BITS, min(MOST_BITS, (BITS_PER_ENTRY * entries.count()).bit_length()))
    piece = min(wide, PIECE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            low = np.unique(batch.column(0).to_numpy())
            at = low >> piece
            for k, bits in zip(np.unique(at).tolist(), np.split(low, np.flatnonzero(np.diff(at)) + 1)):
                bits &= (1 << piece) - 1
                np.bitwise_or.at(held.setdefault(k, np.zeros(1 << (piece - 3), np.uint8)), bits >> 3, np.uint8(1) << (bits & 7).astype(np.uint8))
        for k, bits in held.items():
            yield pa.record_batch([pa.array([k]), pa.array([bits.tobytes()])], names=["piece", "bits"])

    low = F.col(key).bitwiseAND((1 << wide) - 1)
    tasks = max(1, (1 << (wide - piece)) // PIECES)
    dealt = entries.select(low.alias("low")).repartitionById(tasks, F.pmod(F.shiftright("low", piece), F.lit(tasks)).cast("int"))
    out = np.zeros(1 << (wide - 3), np.uint8)
    for r in dealt.mapInArrow(run, "piece long, bits binary").toLocalIterator():
        at = r["piece"] << (piece - 3)
        out[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out.view(np.uint64)


def _known_to(keep: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & np.uint64(len(keep) * 64 - 1)
    return (keep[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def _owner_key(doc: np.ndarray, m: np.ndarray, s: list[bytes]) -> np.ndarray:
    """Hashes of (document, minimiser, digest) for a filter of strings and the documents they are taken from."""
    head = np.frombuffer(b"".join(x[:8] for x in s), np.uint64)
    return _mix(head ^ _mix(m.view(np.uint64) * _PRIME + doc.view(np.uint64)))


def owned_strings(docs: DataFrame, place: DataFrame, length: int = LENGTH) -> DataFrame:
    """(m, s, lo, hi, string): one copy of every super-k-mer of ``place(m, s, doc, lo, hi)``, cut from the document named there."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, m = (batch.column(i).to_numpy() for i in range(2))
            yield pa.record_batch([pa.array(_owner_key(doc, m, batch.column(2).to_pylist()).view(np.int64))], names=["k"])

    owners = materialize(place.select("doc", "m", "s").mapInArrow(keys, "k long"), "owners")
    sent = docs.sparkSession.sparkContext.broadcast((_filter(place, "doc"), _filter(place), _filter(owners, "k")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, minimiser, owner = sent.value
        for batch in batches:
            out: list[tuple] = []
            if batch.num_rows:
                batch = batch.filter(pa.array(_known_to(document, batch.column(0).to_numpy().view(np.uint64))))
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points = _pack(text)
                least, first, windows = super_kmers(points, length)
                hit = _known_to(minimiser, least)
                least, first, ends = least[hit], first[hit], (first + windows + length - 1)[hit].tolist()
                s = [_digest(points[a:b]) for a, b in zip(first.tolist(), ends)]
                if s:
                    for i in np.flatnonzero(_known_to(owner, _owner_key(np.full(len(s), key, np.int64), least, s))).tolist():
                        out.append((key, int(least[i : i + 1].view(np.int64)[0]), s[i], text[int(first[i]) : ends[i]]))
            columns = zip(*out) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc", "m", "s", "string"])

    cut_ = docs.mapInArrow(run, "doc long, m long, s binary, string string")
    return cut_.join(place, ["m", "s", "doc"]).dropDuplicates(["m", "s"]).select("m", "s", "lo", "hi", "string")


def cut(docs: DataFrame, keep: np.ndarray | None = None, length: int = LENGTH) -> DataFrame:
    """(doc, at, n, m, s): super-k-mers of ``docs(doc, text)``: first window, number of windows, minimiser, digest of the string.

    With ``keep`` only those whose minimiser the filter knows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            doc, at, n, m, s = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points = _pack(text)
                least, first, windows = super_kmers(points, length)
                if known is not None:
                    hit = _known_to(known, least)
                    least, first, windows = least[hit], first[hit], windows[hit]
                doc.append(np.full(len(first), key, np.int64))
                at.append(first.astype(np.int64))
                n.append(windows.astype(np.int64))
                m.append(least.view(np.int64))
                s += [_digest(points[a : a + w + length - 1]) for a, w in zip(first.tolist(), windows.tolist())]
            if doc:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (doc, at, n, m)] + [pa.array(s, pa.binary())], names=["doc", "at", "n", "m", "s"])

    return docs.mapInArrow(run, "doc long, at long, n long, m long, s binary")


def _windows(strings: DataFrame, length: int) -> DataFrame:
    """(m, s, lo, hi, off, w): every window of the given super-k-mers with its exact digest and its string's owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for m, s, lo, hi, text in zip(*cols):
                raw = _pack(text).tobytes()
                size = 4 * length
                n = (len(raw) - size) // 4 + 1
                for start in range(0, n, 65536):  # a long run of windows leaves in pieces
                    offs = range(start, min(n, start + 65536))
                    k = len(offs)
                    yield pa.record_batch(
                        [pa.array([m] * k), pa.array([s] * k, pa.binary()), pa.array([lo] * k), pa.array([hi] * k), pa.array(list(offs)), pa.array([xxhash.xxh3_128_digest(raw[4 * o : 4 * o + size]) for o in offs], pa.binary())],
                        names=["m", "s", "lo", "hi", "off", "w"],
                    )

    return strings.select("m", "s", "lo", "hi", "string").mapInArrow(run, "m long, s binary, lo long, hi long, off long, w binary")


def shared_super_kmers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(super-k-mers, shared): those of shared minimisers, and (m, s, a, b), ranges of windows a..b of a string that recur in another document.

    Partly shared strings have one row per maximal range; repeats inside a single document do not
    count. Aggregates combine before the shuffle, so a passage in a third of all documents is one row
    per task.
    """
    texts = _long_enough(docs, id_col, text_col, length)
    both = materialize(minimisers(texts, length).groupBy("m").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("m"), "minimisers")
    kmers = materialize(cut(texts, _filter(both), length).join(both, "m", "left_semi"), "superkmers")
    strings = materialize(kmers.groupBy("m", "s").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.max("n").alias("n")), "strings")
    kinds = strings.groupBy("m").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = strings.where("lo <> hi").select("m", "s", F.lit(0).cast("long").alias("a"), (F.col("n") - 1).alias("b"))
    unclear = materialize(strings.join(kinds.select("m"), "m", "left_semi"), "unclear")
    # one copy of every unclear string, cut from the document that owns its first occurrence; texts do not travel
    packed = owned_strings(texts, materialize(unclear.select("m", "s", F.col("lo").alias("doc"), "lo", "hi"), "place"), length)
    windows = _windows(packed, length)
    windows = materialize(windows, "windows")
    counts = windows.groupBy("m", "w").agg(F.min("lo").alias("wlo"), F.max("hi").alias("whi")).where("wlo <> whi").select("m", "w")
    hit = windows.where("lo = hi").join(counts, ["m", "w"], "left_semi").select("m", "s", "off")
    # consecutive offsets keep their distance to their rank
    rank = F.row_number().over(W.partitionBy("m", "s").orderBy("off"))
    part = hit.distinct().withColumn("island", F.col("off") - rank).groupBy("m", "s", "island").agg(F.min("off").alias("a"), F.max("off").alias("b")).drop("island")
    shared = materialize(whole.union(part), "shared")
    release(both, strings, unclear, windows)
    return kmers, shared


def documents_with_shared_span(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id): documents with a run of at least ``length`` code points that occurs in at least one other document.

    Null ids and texts and texts shorter than ``length`` have no span; rows repeated under one id are
    one document.
    """
    kmers, shared = shared_super_kmers(docs, length=length)
    return kmers.join(shared.select("m", "s").distinct(), ["m", "s"], "left_semi").select(F.col("doc").alias("doc_id")).distinct()


def shared_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, end): maximal spans of a document, as code points start..end-1, made of windows that recur elsewhere."""
    kmers, shared = shared_super_kmers(docs, length=length)
    pieces = kmers.join(shared, ["m", "s"]).select("doc", (F.col("at") + F.col("a")).alias("start"), (F.col("at") + F.col("b") + length).alias("end")).distinct()
    order = W.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = (F.coalesce(reach, F.lit(-1)) < F.col("start") + length - 1).cast("int")
    grouped = pieces.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(order))
    return grouped.groupBy("doc", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(F.col("doc").alias("doc_id"), "start", "end")


def shared_part(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): for every document the number and part of its code points that lie in shared spans."""
    spans = materialize(shared_spans(docs, length), "spans")
    order = W.partitionBy("doc_id").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))
    covered = spans.select("doc_id", fresh.alias("c")).groupBy("doc_id").agg(F.sum("c").alias("shared_chars"))
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"))
    return sizes.join(covered, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)).alias("share"))
