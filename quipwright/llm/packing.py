"""Filling containers of a fixed capacity by hierarchical residual packing.

Items are packed by best fit, largest first, within the batches they are read in. Containers that are
nearly full are done; the rest become items themselves and are packed again in fewer, larger groups,
round by round up a tree, until a round joins no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quipwright.llm.tokens import with_token_counts
from quipwright.session import materialize, spread

CAPACITY = 2048
#: A container this full is not opened again.
NEARLY_FULL = 0.99
#: Items packed together at most; the bound of memory and time of one step.
GROUP = 20_000
#: A round that leaves more than this part of its boxes joined nothing worth another of the same width.
STALLED = 0.999


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """(container of each item, contents of each container): best fit, largest items first, ties in the given order.

    Open containers hang on lists by the room they have left; which of those are not empty is a bit
    mask, so the fullest container that still fits is found by shifting.
    """
    place = np.empty(len(sizes), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            box = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, box = capacity, len(fill)
            fill.append(0)
        fill[box] += size
        place[item] = box
        by_room[room - size].append(box)
        mask |= 1 << (room - size)
    return place, fill


def _pack_groups(items: DataFrame, size: str, capacity: int, round_: int) -> DataFrame:
    """``items`` with ``box`` and ``box_size``: every group of at most GROUP consecutive rows of a partition packed on its own."""
    schema = items.withColumns({"box": F.lit("").cast("string"), "box_size": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, count = TaskContext.get().partitionId(), 0, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, count
            group = pa.Table.from_batches(held).combine_chunks()
            place, fill = best_fit(group.column(size).to_numpy(), capacity)
            boxes = pa.array([f"{round_}.{part}.{made + b}" for b in place.tolist()], pa.string())
            group = group.append_column("box", boxes).append_column("box_size", pa.array(np.array(fill, np.int64)[place]))
            made, held, count = made + len(fill), [], 0
            yield from group.to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                piece = batch.slice(at, GROUP)
                if count and count + piece.num_rows > GROUP:
                    yield from close()
                held.append(piece)
                count += piece.num_rows
        if count:
            yield from close()

    return items.mapInArrow(run, schema)


def split_oversized(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens): a document above the capacity becomes full pieces and a rest, any other one piece."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.lit(capacity))).cast("int")
    cut = docs.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut.select("doc_id", "piece", start.alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - start).alias("n_tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, n_tokens)`` -> (doc_id, piece, token_start, n_tokens, container_id, container_tokens).

    Every row comes out whole: only a document above the capacity has several pieces, all but the last
    of which fill a container alone. Documents of no tokens are items of size 0 and share a container
    with others. Rows with a null or repeated id are items like any other. An empty table gives none.
    Underfull containers meet in groups of GROUP, dealt anew each round; rounds go on while one of them joins
    any, and fewer are open each time, so the tree narrows to one group by itself.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    pieces = split_oversized(docs.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("long")), capacity)
    items = materialize(_pack_groups(pieces, "n_tokens", capacity, 0), "items")
    open_boxes = items.where(F.col("box_size") < NEARLY_FULL * capacity).groupBy("box").agg(F.max("box_size").alias("size"))
    open_boxes = materialize(open_boxes, "open")
    moves = join_boxes(open_boxes, capacity)
    if moves is not None:
        items = items.join(moves, "box", "left").withColumns({"box": F.coalesce("into", "box"), "box_size": F.coalesce("into_size", "box_size")})
    return items.select("doc_id", "piece", "token_start", "n_tokens", F.col("box").alias("container_id"), F.col("box_size").alias("container_tokens"))


def join_boxes(open_boxes: DataFrame, capacity: int) -> DataFrame | None:
    """(box, into, into_size): where each of ``open_boxes(box, size)`` ends when they are packed as items, round by round; None if there is no round."""
    moves = None  # composed so far
    round_, stalled = 0, 0
    while (n := open_boxes.count()) > 1:
        round_ += 1
        parts = -(-n // GROUP)
        # boxes are dealt by hash, so every task gets all sizes, and as many tasks work as there are groups of boxes
        grouped = open_boxes.repartition(parts, F.xxhash64("box", F.lit(round_)))
        packed = materialize(_merge(grouped, capacity, round_), "round")
        moves = packed if moves is None else materialize(
            moves.join(packed.select(F.col("box").alias("into"), F.col("into").alias("next"), F.col("into_size").alias("next_size")), "into", "left").select(
                "box", F.coalesce("next", "into").alias("into"), F.coalesce("next_size", "into_size").alias("into_size")
            ),
            "moves",
        )
        after = packed.where(F.col("into_size") < NEARLY_FULL * capacity).groupBy("into").agg(F.max("into_size").alias("size"))
        open_boxes = materialize(after.select(F.col("into").alias("box"), "size"), "open")
        stalled = stalled + 1 if packed.select("into").distinct().count() > STALLED * n else 0
        if stalled and (parts == 1 or stalled > 1):
            break
    return moves


def _merge(boxes: DataFrame, capacity: int, round_: int) -> DataFrame:
    packed = _pack_groups(boxes.select(F.col("box").alias("old"), "size"), "size", capacity, round_)
    return packed.select(F.col("old").alias("box"), F.col("box").alias("into"), F.col("box_size").alias("into_size"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return pack(with_token_counts(spread(documents.select("doc_id", "text"))), capacity)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, least_containers, fill): what was used against the least that could do."""
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    total = boxes.agg(F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"))
    return total.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.try_divide(F.col("tokens"), F.col("containers") * capacity).alias("fill"))
