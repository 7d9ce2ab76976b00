"""Best-fit packing by patterns of lengths.

Only the histogram of piece lengths, at most one count a length, is needed to decide a packing, so the
decision has a bounded size for any number of documents. Patterns are the ways in which two or three
pieces fill a sequence exactly. Non-negative least squares fits how often to use each, so that together
they use up the histogram. The counts are rounded down; what is left is packed by taking the longest
piece and completing it exactly by one or two others, or else by best fit. The result is a list of runs
(pattern, first sequence, repeats); a document finds its place from its length and its number among the
pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, read_texts
from .tokens import character_classes, rows_of, text_batches, worker_encoder

ROUNDS = 300


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """All pairs and triples of present lengths (counts[length] > 0) that fill a sequence: at most capacity^2 / 12 or so."""
    have = np.flatnonzero(counts)
    have = have[have < capacity]
    pairs = [(int(a), int(capacity - a)) for a in have if a >= capacity - a and counts[capacity - a]]
    a, b = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
    c = capacity - a - b
    ok = (a >= b) & (b >= c) & (c > 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = counts[c] > 0
    return pairs + list(zip(a[ok].tolist(), b[ok].tolist(), c[ok].tolist(), strict=True))


def fit(counts: np.ndarray, offered: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative least squares: repeats x with A x near counts, by multiplicative updates."""
    if not offered:
        return np.zeros(0)
    of = np.concatenate([np.full(len(p), i) for i, p in enumerate(offered)])
    at = np.concatenate([np.array(p) for p in offered])
    want = np.bincount(of, counts[at], len(offered))
    x = np.bincount(of, counts[at], len(offered)) / np.bincount(of)
    for _ in range(ROUNDS):
        made = np.bincount(at, x[of], len(counts))
        x *= want / np.maximum(np.bincount(of, made[at], len(offered)), 1e-12)
    return x


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs (pattern, repeats) that use every piece of the histogram exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    runs: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], times: int) -> int:
        need = Counter(pattern)
        times = min(times, *(int(left[k]) // m for k, m in need.items()))
        if times > 0:
            runs.append((pattern, times))
            for k, m in need.items():
                left[k] -= m * times
        return times

    if left[capacity]:
        use((capacity,), int(left[capacity]))
    offered = patterns(left, capacity)
    fitted = fit(left.astype(float), offered)
    for i in np.argsort(-fitted, kind="stable"):
        if fitted[i] < 1:
            break
        use(offered[i], int(fitted[i]))
    present = [int(x) for x in np.flatnonzero(left)]
    while present:
        longest = present[-1]
        room, chosen = capacity - longest, [longest]
        free = lambda k: int(left[k]) - chosen.count(k)
        while room > 0:
            if room <= capacity and free(room) > 0:
                chosen.append(room)
                break
            two = next((b for b in reversed(present[: bisect_right(present, room)]) if 2 * b >= room > b and (free(b) > 0) and (free(room - b) > (b == room - b))), 0)
            if two:
                chosen += [two, room - two]
                break
            fits = next((b for b in reversed(present[: bisect_right(present, room)]) if free(b) > 0), 0)
            if not fits:
                break
            chosen.append(fits)
            room -= fits
        use(tuple(chosen), 1 << 62)
        present = [k for k in present if left[k]]
    return runs


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, splitter: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document's ids: one a document, or more for those longer than ``capacity``.

    All pieces of a cut document but the first have ``capacity`` ids.
    """
    rows = read_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = docs.sparkSession.sparkContext.broadcast(character_classes())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, splitter, classes.value)
        end, width = encoder.one(end_id), encoder.dtype.itemsize
        for batch in batches:
            out: list[tuple] = []
            for run in text_batches(rows_of(batch)):
                for (doc_id, _), packed in zip(run, encoder.encode([t for _, t in run]), strict=True):
                    ids = packed + end
                    n, start, piece = len(ids) // width, 0, 0
                    while start < n:
                        size = min(n, capacity) if start or n % capacity == 0 else n % capacity if n > capacity else n
                        out.append((doc_id, piece, start, size, zlib.crc32(encoder.wide(ids[start * width : (start + size) * width]))))
                        start, piece = start + size, piece + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, splitter: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Pack all of ``docs(doc_id, text)`` into sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. Null texts count as empty
    and hold the end id alone; a null id stays null; repeated rows are packed as often as they occur.
    Other columns are not read. An empty table gives an empty result. The pieces, a few numbers each,
    are written to the shared folder once, so encoding runs once; the driver sees the histogram only.
    """
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, tokenizer, splitter, end_id, capacity), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = Counter(), 0
    for pattern, times in plan(counts, capacity):
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((used[length], used[length] + times, sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    # The ranks of a length are cut into as many equal steps as it has runs, so that a step meets few of
    # them. The tables are bounded by the capacity alone, whatever the number of documents.
    steps = {length: -(-used[length] // len(of)) for length, of in runs.items()}
    segments = [(length, s, *run) for length, of in runs.items() for run in of for s in range(run[0] // steps[length], (run[1] - 1) // steps[length] + 1)]
    names = ["s_length", "s_step", "s_from", "s_to", "s_first", "s_offset"]
    columns = [pa.array(c, pa.int64()) for c in zip(*segments, strict=True)] if segments else [pa.array([], pa.int64())] * len(names)
    table = spark.createDataFrame(pa.Table.from_arrays(columns, names=names))
    widths = spark.createDataFrame(list(steps.items()), "w_length long, width long")
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank").join(F.broadcast(widths), F.col("length") == F.col("w_length"))
    ranked = ranked.withColumn("step", F.floor(F.col("rank") / F.col("width")))
    same = (F.col("length") == F.col("s_length")) & (F.col("step") == F.col("s_step"))
    placed = ranked.join(F.broadcast(table), same & (F.col("rank") >= F.col("s_from")) & (F.col("rank") < F.col("s_to")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("s_first") + F.col("rank") - F.col("s_from")).alias("sequence_id"), F.col("s_offset").alias("offset"))
