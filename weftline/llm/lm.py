"""Language-model scores by online logistic context mixing.

A text is coded as its words, lower-cased, each ended by a space, and a last empty word. A byte is coded as
a path of binary decisions in a prefix code chosen by the two bytes before it. For every decision four
hashed contexts each predict the bit: the last two bytes and the last four bytes of the word, the whole word
so far, and the running bytes (at a word's beginning those of the word before, later the last six). Every
context holds how often the bit was 0 and 1 in the training texts. A mixer adds the log-odds with weights
that a gate chooses (which contexts have been seen, and how far the code has come), an adaptive map refines
the sum, and both go on learning along the text that is scored.

Counts, weights and map are fitted to all training texts. What a decision sees of the text ends with the
word before, so the counts of words, and of word beginnings after the ends of words, are all that fitting
needs: every pass over them is a pass over every decision of every training text. An occurrence that is
itself counted is taken out of the counts that predict it.

Long stretches that the corpus holds elsewhere are told by chunks: texts are cut where two neighbouring
words hash to a mark, and the chunk that comes next is predicted as a whole by how often the corpus has it
after the chunk before; that prediction is mixed with the bits' one by its success in the text so far. The
tables of words and chunks grow with the corpus and stay distributed; the hashed tables grow with the number
of distinct words up to 2^22 slots.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, read_texts
from .tokens import release_memory

SPACE = 0x20
#: hashed contexts; with the bias, the inputs of the mixer
CONTEXTS = 4
WIDTH = CONTEXTS + 1
#: bytes of a word that the running context sees together with the end of the word before
ACROSS = 3
#: sets of weights; classes and steps of the map; what a seen running context adds to the gate
GATES, CLASSES, STEPS, SEEN = 24, 8, 33, 4
#: log-odds are kept in sixteenths; counts start with so much of each bit
LEVELS, SMOOTH = 16.0, 0.4
#: slots of a table, as a power of two; slots in a piece that is sent
LEAST_BITS, MOST_BITS, PIECE = 16, 22, 1 << 16
#: pairs of bytes with a code of their own
MOST_PAIRS = 1024
#: passes of Newton's method over all training texts
ROUNDS = 2
#: tokens between two corrections of a text's weights; how fast weights and map follow a text
SEGMENT, RATE, MAP_RATE = 16, 0.0005, 0.02
#: bytes of texts handled together: held at a time, while words are cut, and while decisions are mixed
POOL_BYTES, WORDS_BYTES, BATCH_BYTES = 8_000_000, 250_000, 400_000
#: bits of hash that mark the beginning of a chunk: one word in 32
CHUNK_BITS = 5
#: the commonest words, at most so many, are looked up in a broadcast; the others by a join
MOST_COMMON = 1 << 20
LOG2_10 = float(np.log2(10))

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_VALUE = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _RNG.integers(0, 1 << 63, (2, 4096), dtype=np.uint64) * _U(2) + _U(1)
_ODD = _RNG.integers(0, 1 << 31, 16, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def stream_of(text: str | None) -> bytes:
    """The coded bytes of a text: A-Z lower-cased, cut at ASCII white space, a space after every word and one for the end."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return b" ".join([*words, b"", b""]) if words else b" "


def _summed(data: np.ndarray, place: np.ndarray, lane: int) -> np.ndarray:
    """Running sums of a random number for every byte and place; the first is zero."""
    far = place.max(initial=0) >= 4096
    value = _VALUE[lane].take(data)
    value *= _PLACE[lane].take(place & 4095 if far else place)
    if far:
        value ^= (place >> 12).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return total


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(31)) * _U(0xBF58476D1CE4E5B9)
    return h ^ h >> _U(29)


class Tokens:
    """The tokens of some streams: where each begins and ends (at its space), and how many each stream has."""

    def __init__(self, streams: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(streams), np.uint8)
        self.end = np.flatnonzero(self.data == SPACE)
        self.start = np.concatenate([[0], self.end[:-1] + 1])
        limit = np.cumsum(np.fromiter(map(len, streams), np.int64, len(streams)))
        self.many = np.diff(np.searchsorted(self.end, limit), prepend=0)
        self.first = np.cumsum(self.many) - self.many

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each token."""
        width = self.end - self.start
        place = np.arange(len(self.data)) - np.repeat(self.start, width + 1)
        long = width.astype(np.uint64) * _U(0x9FB21C651E98DF25)
        first, second = (_finished(total[self.end] - total[self.start] + long) for total in (_summed(self.data, place, lane) for lane in range(2)))
        return first, second

    def tails(self) -> np.ndarray:
        """The last two bytes before the space before each token; spaces at a text's beginning."""
        padded = np.concatenate([np.full(3, SPACE, np.uint8), self.data])
        tail = padded[self.start].astype(np.uint32) << np.uint32(8) | padded[self.start + 1]
        tail[self.first] = SPACE << 8 | SPACE
        return tail

    def beginnings(self) -> np.ndarray:
        """The first ACROSS bytes of each token and its space, as a number; zeros after the space."""
        padded = np.concatenate([self.data, np.zeros(ACROSS, np.uint8)])
        out = np.zeros(len(self.start), np.int64)
        for k in range(ACROSS):
            out = out << 8 | np.where(self.start + k <= self.end, padded[self.start + k], 0)
        return out

    def words(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some tokens with their spaces, one after the other, and the length of each."""
        size = self.end[which] - self.start[which] + 1
        return self.data[ranges(self.start[which], size)], size


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of hashes: a member of each class, the class of every row, and the classes' sizes."""
    order = np.argsort(h1, kind="stable")
    if ((h1[order][1:] == h1[order][:-1]) & (h2[order][1:] != h2[order][:-1])).any():
        order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return order[at], which, np.diff(np.concatenate([at, [len(order)]]))


def located(h1: np.ndarray, h2: np.ndarray, in1: np.ndarray, in2: np.ndarray) -> np.ndarray:
    """The place of each pair of hashes among pairs that are in order; -1 for those that are not there."""
    if not len(in1):
        return np.full(len(h1), -1, np.int64)
    at = np.searchsorted(in1, h1)
    last = len(in1) - 1
    while True:  # words that share the first hash stand together, in order of the second
        here = np.minimum(at, last)
        on = np.flatnonzero((in1[here] == h1) & (in2[here] < h2) & (at <= last))
        if not len(on):
            return np.where((at <= last) & (in1[here] == h1) & (in2[here] == h2), here, -1)
        at[on] += 1


Code = tuple[np.ndarray, np.ndarray, np.ndarray]


def make_code(trigrams: np.ndarray, counts: np.ndarray) -> Code:
    """A prefix code of bytes for each of the commonest pairs of bytes before, or else for the byte before.

    ``trigrams`` are three bytes as one number, with their counts. Returned are the code of every pair of
    bytes, and for every code and byte the length and the bits of its path after a leading one. The code
    decides what the binary decisions are, and not what they cost.
    """
    first = np.zeros((256, 256))
    np.add.at(first, (trigrams >> 8 & 255, trigrams & 255), counts)
    pairs, which = np.unique(trigrams >> 8, return_inverse=True)
    many = np.bincount(which, counts, len(pairs))
    picked = pairs[np.lexsort((pairs, -many))[:MOST_PAIRS]]
    tree = np.tile(np.arange(256, dtype=np.int64), 256)
    tree[picked] = 256 + np.arange(len(picked))
    rows = np.concatenate([first, np.zeros((len(picked), 256))])
    own = tree[trigrams >> 8] >= 256
    np.add.at(rows, (tree[trigrams[own] >> 8], trigrams[own] & 255), counts[own])
    every = first.sum(axis=0) + 1e-3
    length, path = np.zeros(rows.shape, np.int64), np.zeros(rows.shape, np.uint32)
    for t, row in enumerate(rows):
        weight = row + 0.02 * max(row.sum(), 1) * every / every.sum()
        length[t], path[t] = prefix_code(np.maximum(weight / weight.sum(), 2.0**-18))
    return tree, length, path


def prefix_code(weight: np.ndarray) -> tuple[list[int], list[int]]:
    """Huffman's code of 256 weights: lengths, and the bits of each path after a leading one."""
    heap = [(w, i) for i, w in enumerate(weight.tolist())]
    heapq.heapify(heap)
    up = [(0, 0)] * 511
    for new in range(256, 511):
        (n0, a), (n1, b) = heapq.heappop(heap), heapq.heappop(heap)
        up[a], up[b] = (new, 0), (new, 1)
        heapq.heappush(heap, (n0 + n1, new))
    path, size = [1] * 511, [0] * 511
    for at in range(509, -1, -1):
        parent, bit = up[at]
        path[at], size[at] = path[parent] << 1 | bit, size[parent] + 1
    return size[:256], path[:256]


def _hashed(context: np.ndarray, node: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = context + node
    h ^= h >> np.uint32(15)
    h *= _ODD[salt]
    h ^= h >> np.uint32(13)
    h *= _ODD[salt + 1]
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def _back(data: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The byte of the same word k bytes before each byte, a space where there is none."""
    out = np.full(len(data), SPACE, data.dtype)
    out[k:] = data[: max(len(data) - k, 0)]
    out[place < k] = SPACE
    return out


class Spelling:
    """The decisions that spell some words, each word with its space, one word after the other.

    ``bit`` and ``level`` (decisions of the byte before this one, 2 at most) say what is decided; ``slots``
    has a slot of each table. A running context that looks across words is left open: ``across`` says
    where, and ``running`` finishes it with the end of the word before.
    """

    def __init__(self, data: np.ndarray, size: np.ndarray, code: Code, bits: list[int]) -> None:
        self.bits = bits
        start = np.cumsum(size) - size
        place = np.arange(len(data)) - np.repeat(start, size)
        wide = data.astype(np.uint32)

        b1, b2, b3, b4, b5, b6 = (_back(wide, place, k) for k in range(1, 7))
        two = b2 << np.uint32(8) | b1
        four = b4 << np.uint32(24) | b3 << np.uint32(16) | two
        six = four ^ (b6 << np.uint32(8) | b5) * _ODD[0]
        total = _summed(data, place, 0)
        prefix = total[:-1] - np.repeat(total[start], size)
        prefix = (prefix >> _U(32)).astype(np.uint32) ^ prefix.astype(np.uint32)
        trees, lengths, paths = code
        tree = trees[two]
        symbol = tree * 256 + data
        length, path = lengths.ravel()[symbol], paths.ravel()[symbol]
        salt = tree.astype(np.uint32) * _ODD[1]
        self.many = np.add.reduceat(length, start) if len(start) else length[:0]  # decisions of each word
        self.begin = np.cumsum(self.many) - self.many
        after = np.cumsum(length)
        left = np.repeat(after, length)
        left -= np.arange(len(left))
        self.level = np.minimum(np.repeat(length, length) - left, 2).astype(np.uint8)
        left = left.astype(np.uint32)
        path = np.repeat(path, length)
        node = path >> left
        self.bit = (path >> (left - np.uint32(1)) & np.uint32(1)).astype(np.uint8)
        node *= _ODD[2]
        self.across = np.repeat(place < ACROSS, length)
        spread = [np.repeat(c * _ODD[3 + k] + salt, length) for k, c in enumerate((two, four, prefix, np.where(place < ACROSS, prefix, six)))]
        self.slots = [_hashed(c, node, 8, b) for c, b in zip(spread[:3], bits, strict=False)]
        self.open = spread[3] + node
        self.slots.append(_hashed(self.open, np.uint32(0), 10, bits[3]))

    def running(self, at: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The slot of the running context of decisions ``at``, after words that end in ``tail``."""
        return _hashed(self.open[at], tail * _ODD[7], 10, self.bits[3])


def begun(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of up to ACROSS bytes, their lengths, and the tails before them, of numbers ``tail, bytes``."""
    letters = np.stack([grams >> 8 * (ACROSS - 1 - k) & 255 for k in range(ACROSS)], axis=1).astype(np.uint8)
    held = letters > 0
    held[:, 0] = True
    return letters[held], held.sum(axis=1), (grams >> 8 * ACROSS).astype(np.uint32)


def table_bits(distinct_words: int) -> list[int]:
    """Sizes of the tables: they grow with the vocabulary."""
    wide = int(np.clip(np.ceil(np.log2(max(distinct_words, 1) * 8)), LEAST_BITS, MOST_BITS))
    return [min(wide, 18), wide, wide, wide]


Tables = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Model:
    """What is fitted: the code, the log-odds of every slot, the weights of every gate and the map.

    ``tables`` holds for every context the log-odds of all slots, and those with one 0 or one 1 taken out.
    """

    code: Code
    bits: list[int]
    tables: Tables
    weights: np.ndarray
    refined: np.ndarray


def look_up(tables: Tables, k: int, slot: np.ndarray, bit: np.ndarray, own: bool) -> np.ndarray:
    """The log-odds of slots of context k; for texts learned from (``own``) without the occurrence itself."""
    if not own:
        return tables[k][0].take(slot)
    at = slot * 2
    at += bit
    return tables[k][1].take(at)


def log_odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(LEVELS * np.log((n1 + SMOOTH) / (n0 + SMOOTH))), -127, 127).astype(np.int8)


def as_inputs(logits: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixer's inputs for rows of int8 log-odds, and their gates (the map's class is the gate modulo CLASSES)."""
    x = np.empty((len(logits), WIDTH), np.float32)
    np.multiply(logits, np.float32(1 / LEVELS), out=x[:, :CONTEXTS])
    x[:, CONTEXTS] = 0.25
    seen = (logits != 0).view(np.uint8)
    return x, (seen[:, 1] + 2 * seen[:, 2] + SEEN * seen[:, 3] + CLASSES * level).astype(np.int64)


def start_weights() -> np.ndarray:
    return np.tile(np.array([0.2, 0.3, 0.4, 0.3, 0.0], np.float32), (GATES, 1))


def step_of(sums: np.ndarray) -> np.ndarray:
    """The step of the map that a sum of log-odds falls on."""
    return (sums * 2 + (STEPS // 2 + 0.5)).clip(0, STEPS - 0.5).astype(np.uint8)


def refine(sums: np.ndarray, gate: np.ndarray, refined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log-odds moved by the map, and the steps that they fell on."""
    sums = sums.clip(-12, 12)
    step = step_of(sums)
    return sums + refined.take((gate & (CLASSES - 1)) * STEPS + step), step


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of several ranges."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


# ------------------------------------------------------------ fitting

ROWS_AT_ONCE = 2_500


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _parts(batches: Iterator[pa.RecordBatch], code: Code, bits: list[int]) -> Iterator[tuple[Spelling, np.ndarray, np.ndarray, list[np.ndarray], bool]]:
    """Spellings of rows (word, gram, c): how often each decision was made, which of them count, their slots, and whether of words.

    A word's row counts for the contexts within words; of the running context it has what does not look
    across words. A gram's row has the rest of that, and all inputs at a word's beginning.
    """
    for batch in _gathered(batches, 4 * ROWS_AT_ONCE):
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(i, ROWS_AT_ONCE)
            n = part.column(2).to_numpy(zero_copy_only=False)
            grams = part.column(1).to_numpy(zero_copy_only=False)
            is_word = np.array(part.column(0).is_valid())
            if is_word.any():
                words = part.column(0).filter(pa.array(is_word)).to_pylist()
                data = np.frombuffer(b" ".join([*words, b""]), np.uint8)
                s = Spelling(data, np.fromiter(map(len, words), np.int64, len(words)) + 1, code, bits)
                yield s, np.repeat(n[is_word], s.many), ~s.across, s.slots, True
            if not is_word.all():
                data, size, tail = begun(grams[~is_word].astype(np.int64))
                s = Spelling(data, size, code, bits)
                at = np.arange(len(s.bit))
                yield s, np.repeat(n[~is_word], s.many), s.across, [*s.slots[:3], s.running(at, np.repeat(tail, s.many))], False


def fit_tables(counts: DataFrame, code: Code, bits: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The log-odds of every slot of every table, from whole-number counts over all training texts.

    Each task sums its rows into whole tables, whose size is fixed, and sends the pieces that are not
    empty; pieces are added up by their place. What reaches the driver is one set of tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        tables = [np.zeros(2 << b, np.int64) for b in bits]
        for s, n, count, slots, words in _parts(batches, code, bits):
            # Words count for the contexts within words, at all places; grams for the running one alone.
            for k, table in enumerate(tables):
                if k < 3 and not words:
                    continue
                at, many = (slots[k] * 2 + s.bit, n) if k < 3 else (slots[k][count] * 2 + s.bit[count], n[count])
                spots, which = np.unique(at, return_inverse=True)
                table[spots] += np.bincount(which, many).astype(np.int64)
        for k, table in enumerate(tables):
            for piece in range(len(table) // (2 * PIECE)):
                both = table[2 * PIECE * piece : 2 * PIECE * (piece + 1)]
                if both.any():
                    data = pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece], pa.int32()), pa.array([data], pa.binary())], names=["t", "piece", "data"])

    size = 16 * PIECE

    def add(group):
        import pandas as pd

        total = np.zeros(2 * PIECE, np.int64)
        for data in group["data"]:
            total += np.ascontiguousarray(np.frombuffer(pa.decompress(data, size, "zstd"), np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]
        n0, n1 = total[::2], total[1::2]
        odds = np.stack([log_odds(n0, n1), log_odds(np.maximum(n0 - 1, 0), n1), log_odds(n0, np.maximum(n1 - 1, 0))])
        return pd.DataFrame({"t": group["t"].iloc[:1].values, "piece": group["piece"].iloc[:1].values, "data": [pa.compress(odds.tobytes(), "zstd", asbytes=True)]})

    schema = "t int, piece int, data binary"
    pieces = counts.select("word", "gram", "c").mapInArrow(run, schema).groupBy("t", "piece").applyInPandas(add, schema)
    tables = [(np.zeros(1 << b, np.int8), np.zeros(2 << b, np.int8)) for b in bits]
    for r in pieces.toLocalIterator():
        odds = np.frombuffer(pa.decompress(r["data"], 3 * PIECE, "zstd"), np.int8).reshape(3, PIECE)
        plain, without = tables[r["t"]]
        plain[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = odds[0]
        without[2 * r["piece"] * PIECE : 2 * (r["piece"] + 1) * PIECE] = odds[1:].T.ravel()
    return tables


def fit_mixer(counts: DataFrame, model: Model, rounds: int = ROUNDS) -> None:
    """Fit weights and map by Newton's method: every round is a pass over all decisions of all training texts.

    Each decision is predicted without its own occurrence. A round moves the weights of every gate; the
    last one fits the map. Sums that reach the driver are of fixed size.
    """
    spark = counts.sparkSession
    size = WIDTH + WIDTH * WIDTH
    shared = spark.sparkContext.broadcast((model.code, model.bits, model.tables))
    for last in [False] * rounds + [True]:
        weights = model.weights

        def run(batches: Iterator[pa.RecordBatch], weights=weights, last=last) -> Iterator[pa.RecordBatch]:
            code, bits, tables = shared.value
            total = np.zeros(GATES * size + 2 * CLASSES * STEPS)
            for s, n, count, slots, words in _parts(batches, code, bits):
                at = np.flatnonzero(count)
                bit, many = s.bit[at], n[at].astype(np.float64)
                logits = np.stack([look_up(tables, k, slots[k][at], bit, True) for k in range(CONTEXTS)], axis=1)
                x, gate = as_inputs(logits, s.level[at])
                sums = np.einsum("ij,ij->i", x, weights.take(gate, axis=0)).clip(-12, 12)
                p = 1 / (1 + np.exp(-sums.astype(np.float64)))
                err, var = many * (bit - p), many * p * (1 - p)
                if last:
                    cell = (gate & (CLASSES - 1)) * STEPS + step_of(sums)
                    total[GATES * size :] += np.concatenate([np.bincount(cell, err, CLASSES * STEPS), np.bincount(cell, var, CLASSES * STEPS)])
                    continue
                order = np.argsort(gate.astype(np.uint8), kind="stable")
                edge = np.searchsorted(gate[order], np.arange(GATES + 1))
                xs = x[order].astype(np.float64)
                err, var = err[order], var[order]
                for g in range(GATES):
                    a, b = edge[g], edge[g + 1]
                    if b > a:
                        of = total[g * size : (g + 1) * size]
                        of[:WIDTH] += err[a:b] @ xs[a:b]
                        of[WIDTH:] += ((xs[a:b] * var[a:b, None]).T @ xs[a:b]).ravel()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "v"])

        rows = counts.select("word", "gram", "c").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(GATES * size + 2 * CLASSES * STEPS)
        for r in rows:
            total[r["k"]] = r["v"]
        if last:
            err, var = total[GATES * size :].reshape(2, CLASSES, STEPS)
            model.refined = np.round((err / (var + 5)).clip(-2, 2), 5).astype(np.float32)
            continue
        moved = model.weights.astype(np.float64)
        for g in range(GATES):
            of = total[g * size : (g + 1) * size]
            step = np.linalg.solve(of[WIDTH:].reshape(WIDTH, WIDTH) + 20 * np.eye(WIDTH), of[:WIDTH])
            moved[g] += step.clip(-1, 1)
        model.weights = np.round(moved, 5).astype(np.float32)
    shared.destroy()


# ------------------------------------------------------------ counting


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], np.ndarray]]:
    """Rows (doc_id, text, learn) in pools of about POOL_BYTES: ids, streams, and which are learned from."""
    ids, streams, learn, size = [], [], [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for doc_id, text, own in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                ids.append(doc_id)
                streams.append(stream_of(text))
                learn.append(own)
                size += len(streams[-1])
                if size >= POOL_BYTES:
                    yield ids, streams, np.array(learn, bool)
                    ids, streams, learn, size = [], [], [], 0
    if ids:
        yield ids, streams, np.array(learn, bool)


def _runs(streams: list[bytes], which: np.ndarray, most: int) -> Iterator[list[int]]:
    """Streams numbered in ``which``, in runs of about ``most`` bytes."""
    run, size = [], 0
    for i in which.tolist():
        if run and size + len(streams[i]) > most:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(streams[i])
    if run:
        yield run


def count_words(rows: DataFrame) -> DataFrame:
    """(word, gram, c): how often each word, and each word's beginning after the end of a word, is in texts to learn from.

    A row holds a word (the end being empty) or a gram. Tasks send each of their distinct words once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, streams, learn in _rows_of(batches):
            held: list[tuple] = []
            grams: list[tuple[np.ndarray, np.ndarray]] = []
            for part in _runs(streams, np.flatnonzero(learn), WORDS_BYTES):
                t = Tokens([streams[i] for i in part])
                h1, h2 = t.hashes()
                first, _, n = distinct(h1, h2)
                held.append((h1[first], h2[first], n, *t.words(first)))
                grams.append(np.unique(t.tails().astype(np.int64) << 8 * ACROSS | t.beginnings(), return_counts=True))
            if not held:
                continue
            h1, h2, n, data, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            first, which, _ = distinct(h1, h2)
            n = np.bincount(which, n, len(first)).astype(np.int64)
            start = np.cumsum(size) - size
            size = size[first] - 1  # without the space
            at = ranges(start[first], size)
            words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data[at].tobytes())])
            key, c = (np.concatenate(x) for x in zip(*grams, strict=True))
            key, which = np.unique(key, return_inverse=True)
            c = np.bincount(which, c, len(key)).astype(np.int64)
            for k in range(0, len(words), 50_000):
                part = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([part, pa.nulls(len(part), pa.int64()), pa.array(n[k : k + 50_000])], names=["word", "gram", "c"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.binary()), pa.array(key), pa.array(c)], names=["word", "gram", "c"])

    found = rows.mapInArrow(run, "word binary, gram long, c long")
    return found.groupBy("word", "gram").agg(F.sum("c").alias("c"))


def trigram_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of a byte with the two before it in its word, over all training texts; the commonest shape the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            if not words:
                continue
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            data = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)
            place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
            key, which = np.unique(_back(data, place, 2) << 16 | _back(data, place, 1) << 8 | data, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(which, np.repeat(n, size)).astype(np.int64))], names=["k", "n"])

    table = counts.filter("word is not null").select("word", "c").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(1 << 17).toArrow()
    return table.column("k").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)


# ------------------------------------------------------------ scoring


#: what is kept of a decision, and of one whose running context is open
_TOLD = np.dtype([("sum", "<f4"), ("key", "<u4")])
_OPEN = np.dtype([("hash", "<u4"), ("gate", "<u4"), ("unseen", "<f4"), ("seen", "<f4")])


class Pool:
    """The distinct words of some streams, with what the contexts within words say of their decisions.

    ``word`` is the number of every token's word, stream after stream.
    """

    def __init__(self, streams: list[bytes], model: Model, own: bool) -> None:
        held, numbers, n = [], [], 0
        for part in _runs(streams, np.arange(len(streams)), WORDS_BYTES):
            t = Tokens([streams[i] for i in part])
            h1, h2 = t.hashes()
            first, which, _ = distinct(h1, h2)
            held.append((h1[first], h2[first], *t.words(first)))
            numbers.append(which + n)
            n += len(first)
        h1, h2, data, size = (np.concatenate(x) for x in zip(*held, strict=True))
        first, which, _ = distinct(h1, h2)
        self.word = which[np.concatenate(numbers)]
        self.h1, self.h2 = h1[first], h2[first]
        start = np.cumsum(size) - size
        size, at = size[first], start[first]
        self.data = data[ranges(at, size)]
        self.size, self.start = size, np.cumsum(size) - size
        parts, refined = [], model.refined.ravel()
        for a in range(0, len(size), ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, len(size))
            s = Spelling(self.data[self.start[a] : self.start[b - 1] + size[b - 1]], size[a:b], model.code, model.bits)
            logits = np.stack([look_up(model.tables, k, s.slots[k], s.bit, own) for k in range(CONTEXTS)], axis=1)
            open_ = np.flatnonzero(s.across)
            logits[open_, CONTEXTS - 1] = 0
            x, gate = as_inputs(logits, s.level)
            sums, step = refine(np.einsum("ij,ij->i", x, model.weights.take(gate, axis=0)), gate, refined)
            # Where the running context is still open: the sum of the other inputs if it is unseen, and if it is seen.
            x, gate = x[open_], gate[open_]
            told = np.empty(len(sums), _TOLD)
            told["sum"], told["key"] = sums, step * np.uint8(2) + s.bit
            held_open = np.empty(len(open_), _OPEN)
            held_open["hash"], held_open["gate"] = s.open[open_], gate << 1 | s.bit[open_]
            held_open["unseen"] = np.einsum("ij,ij->i", x, model.weights.take(gate, axis=0))
            held_open["seen"] = np.einsum("ij,ij->i", x, model.weights.take(gate + SEEN, axis=0))
            parts.append((told, s.many, held_open, np.add.reduceat(s.across.astype(np.int64), s.begin)))
        told, self.many, open_, self.many_open = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.told, self.open = told.view(np.uint64), open_.view(np.complex128)  # taken as one number each
        self.begin, self.begin_open = np.cumsum(self.many) - self.many, np.cumsum(self.many_open) - self.many_open

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        return [self.data[a : a + n - 1].tobytes() for a, n in zip(self.start[which].tolist(), self.size[which].tolist(), strict=True)]


def mix(t: Tokens, word: np.ndarray, pool: Pool, model: Model, own: bool) -> np.ndarray:
    """What every token of some texts costs, in nats.

    Each text has a last mixer and a map of its own, which start as the corpus' and are corrected after
    every SEGMENT tokens by what was predicted wrongly: how far to trust the sum, and how to bend it on
    each step. All texts go on together.
    """
    docs = np.repeat(np.arange(len(t.many)), t.many)
    turn = (np.arange(len(word)) - t.first[docs]) // SEGMENT
    order = np.argsort(turn.astype(np.uint16) if turn.max(initial=0) < 1 << 16 else turn, kind="stable")
    cost = np.empty(len(word))
    trust, bends = np.ones(len(t.many), np.float32), np.zeros((len(t.many), STEPS), np.float32)
    salt, refined, weight = t.tails() * _ODD[7], model.refined.ravel(), model.weights[:, CONTEXTS - 1] * np.float32(1 / LEVELS)
    limit = np.cumsum(np.bincount(turn))
    many = pool.many[word[order]]
    after = np.cumsum(many)
    first = done = turn_ = 0
    while first < len(order):
        # The decisions of some segments of all texts, about 200,000.
        past = turn_ + 1
        while past < len(limit) and after[limit[past] - 1] - done <= 200_000:
            past += 1
        last = int(limit[past - 1])
        tokens = order[first:last]
        which, size = word[tokens], many[first:last]
        ends = np.cumsum(size)
        told = pool.told.take(ranges(pool.begin[which], size)).view(_TOLD)
        sums, key = np.ascontiguousarray(told["sum"]), told["key"].astype(np.uint8)
        # The running context of word beginnings, now that the word before is known.
        n = pool.many_open[which]
        open_ = pool.open.take(ranges(pool.begin_open[which], n)).view(_OPEN)
        bit, gate = (open_["gate"] & 1).astype(np.uint8), (open_["gate"] >> 1).astype(np.int64)
        odds = look_up(model.tables, CONTEXTS - 1, _hashed(open_["hash"], np.repeat(salt[tokens], n), 10, model.bits[-1]), bit, own)
        held = odds != 0
        gate += held * SEEN
        moved, step = refine(np.where(held, open_["seen"] + weight.take(gate) * odds, open_["unseen"]), gate, refined)
        at = ranges(ends - size, n)
        sums[at], key[at] = moved, step << np.uint8(1) | bit
        sign = (key & 1) * np.float32(2) - 1
        sums *= sign  # for the bit that was
        key >>= 1
        # Segments: where each begins, whose it is, and which of them are of one turn.
        new = np.flatnonzero(np.concatenate([[True], (np.diff(docs[tokens]) != 0) | (np.diff(turn[tokens]) != 0)]))
        whose, starts = docs[tokens[new]], (ends - size)[new]
        runs = np.diff(starts, append=len(sums))
        edge = np.searchsorted(new, limit[turn_:past] - first)
        loss = np.empty(len(sums), np.float32)
        i = a = 0
        for j in edge.tolist():
            here, length = whose[i:j], runs[i:j]
            b = int(starts[j]) if j < len(starts) else len(sums)
            z, turned = sums[a:b], sign[a:b]
            cell = np.repeat(np.arange(0, len(here) * STEPS, STEPS), length)
            cell += key[a:b]
            p = np.repeat(trust[here], length)
            p *= z
            p += turned * bends[here].ravel().take(cell)
            np.negative(p, out=p)
            np.exp(p, out=p)
            p += 1
            np.log(p, out=loss[a:b])
            np.divide(-1, p, out=p)
            p += 1  # by so much the prediction was short of the bit
            z *= p
            trust[here] += RATE * np.add.reduceat(z, starts[i:j] - a)
            p *= turned
            bends[here] += MAP_RATE * np.bincount(cell, p, len(here) * STEPS).reshape(-1, STEPS)
            i, a = j, b
        cost[tokens] = np.add.reduceat(loss, ends - size, dtype=np.float64)
        first, done, turn_ = last, int(after[last - 1]), past
    return cost


def chunks_of(t: Tokens, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin among the tokens, of words with hashes ``h``, and a hash of each chunk."""
    before = np.concatenate([h[:1], h[:-1]])
    new = _finished(h + before * _U(0x94D049BB133111EB)) >> _U(64 - CHUNK_BITS) == 0
    new[t.first] = True
    begin = np.flatnonzero(new)
    place = np.arange(len(h)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(h)]])))
    return begin, np.add.reduceat(_finished(h ^ (place + 1).astype(np.uint64) * _U(0xD1342543DE82EF95)), begin)


SCORED = (
    "part int, row long, doc_id long, own boolean, n long, known long, base double, cost double, bytes long, "
    "word binary, m int, before long, chunk long, own_before int, own_both int"
)
_FIELDS = {"part": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "own": pa.bool_(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64(), "cost": pa.float64(), "bytes": pa.int64(), "word": pa.binary(), "m": pa.int32(), "before": pa.int64(), "chunk": pa.int64(), "own_before": pa.int32(), "own_both": pa.int32()}


def _batch(size: int, /, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(size, k) for c, k in _FIELDS.items()], names=list(_FIELDS))


def _within(docs: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each row's text holds the row's key."""
    _, which, n = distinct(_finished(key + docs.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), key)
    return n[which].astype(np.int32)


def score_texts(rows: DataFrame, model: Model, common: tuple[np.ndarray, np.ndarray, np.ndarray], weight: float) -> DataFrame:
    """What the bits of every text cost, in parts: texts (0), rarer words of texts (1) and chunks of texts (2).

    ``common`` has the hashes and counts of the commonest words; ``weight`` is the denominator of the base.
    Memory: a pool of texts of about POOL_BYTES (or one longer text), the model and the common words.
    """
    shared = rows.sparkSession.sparkContext.broadcast(((model.code, model.bits, model.tables, model.weights, model.refined), common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release_memory()
        fitted, (c1, c2, cn) = shared.value
        model_ = Model(*fitted)
        made = TaskContext.get().partitionId() << 40
        for ids, streams, learn in _rows_of(batches):
            size = np.fromiter(map(len, streams), np.int64, len(streams))
            for own in (False, True):
                which = np.flatnonzero(learn == own)
                if not len(which):
                    continue
                which = which[np.argsort(size[which], kind="stable")]
                mine = [streams[i] for i in which.tolist()]
                pool = Pool(mine, model_, own)
                at = located(pool.h1, pool.h2, c1, c2)
                found = at >= 0
                c = np.where(found, cn[at], 0) if len(cn) else np.zeros(len(at), np.int64)
                base = np.where(found, np.log10((c + 1) / weight), 0.0)
                done, first = 0, 0
                for part in _runs(mine, np.arange(len(mine)), BATCH_BYTES):
                    t = Tokens([mine[i] for i in part])
                    word = pool.word[first : first + len(t.start)]
                    first += len(word)
                    cost = mix(t, word, pool, model_, own)
                    docs = np.repeat(np.arange(len(part)), t.many)
                    row = made + np.arange(len(part))
                    made += len(part)
                    here = which[done : done + len(part)]
                    done += len(part)
                    sums = lambda v, docs=docs, part=part: np.bincount(docs, v, len(part))
                    yield _batch(len(part), part=np.zeros(len(part), np.int32), row=row, doc_id=[ids[i] for i in here.tolist()], own=np.full(len(part), own), n=t.many, known=sums(c[word] > 0).astype(np.int64), base=sums(base[word]), cost=sums(cost), bytes=size[here])
                    rare = np.flatnonzero(~found[word])
                    if len(rare):
                        key, m = np.unique(docs[rare] * len(pool.size) + word[rare], return_counts=True)
                        yield _batch(len(key), part=np.ones(len(key), np.int32), row=row[key // len(pool.size)], word=pool.bytes_of(key % len(pool.size)), m=m.astype(np.int32))
                    begin, chunk = chunks_of(t, pool.h1[word])
                    of = docs[begin]
                    later = np.flatnonzero(of[1:] == of[:-1]) + 1
                    if len(later):
                        before, after, of = chunk[later - 1], chunk[later], of[later]
                        both = _finished(before * _U(0xBF58476D1CE4E5B9) + after)
                        place = later - np.searchsorted(docs[begin], of)
                        yield _batch(len(later), part=np.full(len(later), 2, np.int32), row=row[of], own=np.full(len(later), own), n=place, cost=np.add.reduceat(cost, begin)[later], before=before.view(np.int64), chunk=after.view(np.int64), own_before=_within(of, before), own_both=_within(of, both))

    return rows.mapInArrow(run, SCORED)


#: keys with more rows than this, and than one in HOT_SHARE of all, are joined by a broadcast: at most HOT_SHARE of them
HOT_ROWS, HOT_SHARE = 1000, 10_000


def _joined(rows: DataFrame, table: DataFrame, key: list[str], n: str, limit: int, how: str) -> DataFrame:
    """``rows`` joined with ``table``, which has a row a key and the key's number of rows, ``n``.

    Keys with many rows are broadcast, so that no task gets all rows of one.
    """
    hot = F.broadcast(table.filter(F.col(n) > limit))
    usual = rows.join(hot.select(*key), key, "left_anti").join(table.filter(F.col(n) <= limit), key, how)
    return usual.unionByName(rows.join(hot, key).select(*usual.columns))


def chunk_gains(scored: DataFrame) -> DataFrame:
    """(row, gain): the nats that texts save by the prediction of whole chunks; only of texts with a known chunk.

    A chunk that the corpus has elsewhere (a text's own are taken out) predicts the next one by its followers
    there. The prediction's share in the mixture follows its success in the text so far.
    """
    own = lambda c: F.when(F.col("own"), F.col(c)).otherwise(0).alias(c)
    chunks = scored.filter("part = 2").select("row", "n", "cost", "before", "chunk", own("own_before"), own("own_both"), "own")
    limit = max(HOT_ROWS, chunks.count() // HOT_SHARE)
    pairs = materialise(chunks.filter("own").groupBy("before", "chunk").agg(F.count(F.lit(1)).alias("both")), "lm-pairs")
    firsts = materialise(pairs.groupBy("before").agg(F.sum("both").alias("every")), "lm-chunks")
    known = _joined(chunks.drop("own"), firsts, ["before"], "every", limit, "inner").filter("every > own_before")
    told = _joined(known, pairs, ["before", "chunk"], "both", limit, "left")
    share = (F.coalesce("both", F.lit(0)) - F.col("own_both")) / (F.col("every") - F.col("own_before"))
    lists = told.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "cost", share.alias("share")))).alias("chunks"))

    def follow(state, c):
        lean = (state["hits"] + 0.5) / (state["tries"] + 1)
        gain = F.when(c["share"] > 0, F.log(lean * c["share"] + (1 - lean) * F.exp(-c["cost"])) + c["cost"]).otherwise(F.log(1 - lean))
        return F.struct((state["hits"] + F.when(c["share"] > 0, 1.0).otherwise(0.0)).alias("hits"), (state["tries"] + 1).alias("tries"), (state["gain"] + gain).alias("gain"))

    start = F.struct(F.lit(0.0).alias("hits"), F.lit(0.0).alias("tries"), F.lit(0.0).alias("gain"))
    return lists.select("row", F.aggregate("chunks", start, follow, lambda s: s["gain"]).alias("gain"))


def commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and counts of the commonest words, at most ``most``, in order of the hashes: all words counted often enough.

    Tasks hash the words: the driver gets three numbers of each, and neither the words nor what hashing them takes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 4 * ROWS_AT_ONCE):
            if batch.num_rows:
                h1, h2 = Tokens([b" ".join([*batch.column(0).to_pylist(), b""])]).hashes()
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(1)], names=["h1", "h2", "c"])

    words = counts.filter("word is not null")
    level = F.floor(F.log2("c") * 8)
    levels = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, None
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = words.filter(level >= least).select("word", "c").mapInArrow(run, "h1 long, h2 long, c long").toArrow()
    h1, h2, n = (c.to_numpy() for c in table.columns)
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    order = np.lexsort((h2, h1))
    return h1[order], h2[order], n[order]


def fit(counts: DataFrame, distinct_words: int) -> Model:
    """The model of ``counts(word, gram, c)``."""
    bits = table_bits(distinct_words)
    code = make_code(*trigram_counts(counts))
    model = Model(code, bits, fit_tables(counts, code, bits), start_weights(), np.zeros((CLASSES, STEPS), np.float32))
    fit_mixer(counts, model)
    return model


def score_documents(docs: DataFrame, learnable: Column, most_common: int = MOST_COMMON) -> DataFrame:
    """Score every text of ``docs(doc_id, text)``, learning from the rows that ``learnable`` admits.

    Returns doc_id, held_out (not learned from), n_tokens (words and the end), n_known, train_tokens,
    base_score (unigrams with add-one counts), score (log10 of the model's probability of the text's tokens)
    and bits_per_byte (over words, spaces and the end). Null and empty texts are one token, the end; a null
    id stays null; repeated rows are answered (and learned) each. With nothing to learn from, counts are
    zero throughout. Other columns are not read. At most ``most_common`` words are broadcast.
    """
    rows = read_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learnable, F.lit(False)).alias("learn"))
    counts = materialise(count_words(rows), "lm-counts")
    totals = counts.filter("word is not null").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("every"), F.count(F.lit(1)).alias("distinct")).first()
    every, different = int(totals["every"]), int(totals["distinct"])
    weight = float(every + different + 1)
    scored = materialise(score_texts(rows, fit(counts, different), commonest(counts, most_common), weight), "lm-scored")
    told = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(weight))
    rarer = scored.filter("part = 1").select("row", "word", "m").join(counts.filter("word is not null").select("word", "c"), "word", "left")
    rarer = rarer.groupBy("row").agg(F.sum(F.col("m") * told).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("rare_known"))
    found = scored.filter("part = 0").select("row", "doc_id", "own", "n", "known", "base", "cost", "bytes").join(rarer, "row", "left").join(chunk_gains(scored), "row", "left")
    score = (F.coalesce("gain", F.lit(0.0)) - F.col("cost")) / float(np.log(10))
    return found.select(
        "doc_id",
        (~F.col("own")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(every).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score * LOG2_10 / F.col("bytes")).alias("bits_per_byte"),
    )
