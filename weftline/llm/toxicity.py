"""Toxicity by noisy-channel deobfuscation.

A token that looks disguised (letters mixed with digits or symbols, a letter three times or more, single
letters set apart) is read as a lattice: every character may stand for some letters, a separator for
nothing or for the end of a word, a run for one or two letters, a masking sign for any letter. A Viterbi
search under a character trigram model of the corpus chooses the reading. The restored words are then
scored by a decision list: words and word beginnings that a bounded sample of labelled rows ties to the
label, each with the precision it showed there; the evidence of a text's words adds up as if each told by
itself.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, materialise, read_texts
from .tokens import rows_of, text_batches

#: labelled rows in the fitted sample, features in the fitted list
SAMPLE_ROWS, MOST_FEATURES = 20_000, 20_000
#: least log-likelihood ratio of a feature over the sample and over the texts that no feature before it
#: holds, its least precision, and the lengths of word beginnings
LEAST_G2, LEAST_LEFT, LEAST_PRECISION, BEGINNINGS = 15.0, 6.0, 0.5, (4, 5, 6)
#: from this ratio on, one toxic text that nothing else explains is enough
SURE_G2 = 40.0
MOST_KEPT = 400_000
#: characters of a token read at a time: a longer one is read in stretches that overlap by a word's length
STRETCH, OVERLAP = 512, 32

# What a character may stand for. Costs are nats.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_ ,~^'`/\\"
MASKS = "*#"
SWAP_COST, DROP_COST, RUN_COST, SPLIT_COST = 1.0, 0.3, 0.5, 1.0
#: a sign for a letter, and one for nothing
MASK_COST, MASK_DROP_COST = 1.0, 2.0
#: between single letters set apart: a mark that may end a word
GAP = "\x1f"

CLASSES = 64
_CLASS = {chr(97 + i): 1 + i for i in range(26)} | {chr(0xDF + i): 27 + i for i in range(33)}


def letter_class(c: str) -> int:
    """1 to 59 for a-z and U+00DF to U+00FF, 60 for any other letter, 0 for anything else."""
    return _CLASS.get(c) or (60 if c.isalpha() else 0)


def class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x3000):
        table[i] = letter_class(chr(i))
    table[0x3000:] = 60
    return table


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams (classes of letters, 0 around words) over all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = class_table(), np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in text_batches((None, t) for (t,) in rows_of(batch)):
                joined = "  ".join(t for _, t in part if t).lower()
                c = table[np.frombuffer(f"  {joined}  ".encode("utf-32-le", "replace"), "<u4")].astype(np.int32)
                total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    rows = read_texts(docs).select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**3, np.int64)
    out[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return out


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log-probabilities [a, b, c] of class c after a, b; counts backed off to b and to none."""
    n3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    n1 = n3.sum(axis=(0, 1)) + 0.5
    p1 = n1 / n1.sum()
    n2 = n3.sum(axis=0)
    p2 = (n2 + 5 * p1) / (n2.sum(axis=1, keepdims=True) + 5)
    p3 = (n3 + 5 * p2) / (n3.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a token: for each run of one character, the letters it may be and what that costs.

    A space among the letters ends a word. A run of masking signs is read sign by sign, each being any
    letter or nothing.
    """
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m.group(1), len(m.group())
        if c == GAP:
            out.append([("", 0.0), (" ", SPLIT_COST)])
            continue
        if c in MASKS:
            out += [[(chr(97 + i), MASK_COST) for i in range(26)] + [("", MASK_DROP_COST)]] * n
            continue
        known = letter_class(c)
        letters = c if known else STANDS_FOR.get(c, "")
        swap = 0.0 if known else SWAP_COST
        ways = [(x, swap + (RUN_COST if n > 1 else 0)) for x in letters]
        if letters and n > 1:
            ways += [(x * 2, swap + (RUN_COST if n > 2 else 0)) for x in letters]
        if c in SEPARATORS:
            ways += [("", DROP_COST), (" ", SPLIT_COST)]
        out.append(ways or [("", DROP_COST)])
    return out


def restore(token: str, costs: np.ndarray) -> str:
    """The cheapest reading of a lower-case token, by a Viterbi search over the last two letters; a space ends a word."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for ways in readings(token):
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, read) in states.items():
            for letters, paid in ways:
                x, y, total = a, b, cost + paid
                for letter in letters:
                    k = letter_class(letter)
                    total += float(costs[x, y, k])
                    x, y = (y, k) if k else (0, 0)
                old = after.get((x, y))
                if old is None or (total, read + letters) < old:
                    after[x, y] = (total, read + letters)
        states = after
    return min((cost + float(costs[a, b, 0]), read) for (a, b), (cost, read) in states.items())[1]


def restored_words(token: str, costs: np.ndarray) -> list[str]:
    """The words of the cheapest reading of a token of any length."""
    if len(token) <= STRETCH:
        return restore(token, costs).split()
    words = [w for at in range(0, len(token) - OVERLAP, STRETCH - OVERLAP) for w in restore(token[at : at + STRETCH], costs).split()]
    return list(dict.fromkeys(words))


_WORDS = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?[\\]^_`{|}~¿¡«»“”„…–—"
_PLAIN_EDGES = "".join(c for c in _EDGES if c not in STANDS_FOR)
_CLOSING = "".join(c for c in _EDGES if c not in "$@")
_PARTS = re.compile("[" + re.escape(SEPARATORS) + "]+")
_APART = re.compile(b"\x01{3,}")


def token_words(token: str, costs: np.ndarray) -> list[str]:
    """The words that a lower-case token holds, restored where it looks disguised.

    Punctuation at the ends is taken off first. A token with separators is read as a whole and part by part.
    """
    core = token.strip(_EDGES)
    # A symbol with a letter's look may begin the word, or end it where it is one of the usual two.
    whole = token.lstrip(_PLAIN_EDGES).rstrip(_CLOSING)
    disguised = restored_words(whole, costs) if len(core) < len(whole) and any(map(str.isalpha, core)) else []
    if core.isalpha():
        return [core, *restored_words(core, costs), *disguised] if _TRIPLE.search(core) else [core, *disguised]
    words = _WORDS.findall(core)
    if not words:
        return words
    parts = [x for x in _PARTS.split(core) if x and not x.isalpha() and any(map(str.isalpha, x))]
    return [*words, *restored_words(core, costs), *disguised, *(w for x in parts if x != core for w in restored_words(x, costs))]


def text_tokens(text: str) -> set[str]:
    """The distinct lower-case tokens of a whole text, with runs of single characters joined as well.

    Between the joined characters a mark is left where a word may end; a long run is cut into stretches
    that overlap.
    """
    tokens = text.lower().split()
    single = bytes(map((1).__eq__, map(len, tokens)))
    found = set(tokens)
    for m in _APART.finditer(single):
        for at in range(m.start(), max(m.end() - OVERLAP, m.start() + 1), STRETCH // 2 - OVERLAP):
            found.add(GAP.join(tokens[at : min(at + STRETCH // 2, m.end())]))
    return found


def features(word: str) -> list[str]:
    """The word itself, and its beginnings marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, costs: np.ndarray) -> tuple[dict[str, float], float]:
    """The decision list (feature -> precision) and the score of a text that holds none of it.

    ``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` are joined on SAMPLE_ROWS rows of labels that
    ``learnable`` admits, those with the least id hashes. Without a labelled row the list is empty.
    """
    spark = docs.sparkSession
    sample = labels.filter(learnable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = least_hashed(sample, "doc_id", [], SAMPLE_ROWS)
    shared = spark.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[str]] = {}
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in rows_of(batch):
                held: set[str] = set()
                for token in text_tokens(text or ""):
                    if (got := seen.get(token)) is None:
                        got = seen[token] = [f for w in set(token_words(token, shared.value)) for f in features(w)]
                    held.update(got)
                counts[int(label > 0)].update(held)
                counts[int(label > 0)][""] += 1
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in counts)], names=["f", "clean", "toxic"])

    # The sample is bounded, so it is broadcast and the texts stay where they are.
    picked = materialise(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxicity")
    found = picked.mapInArrow(run, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = found.filter("f = '' or toxic >= 3").orderBy(F.desc(F.expr("f = ''")), F.desc(F.expr("toxic * toxic / (toxic + clean + 1)")), "f").limit(MOST_FEATURES + 1).collect()
    every = next((r for r in rows if r["f"] == ""), None)
    if every is None or not every["toxic"]:
        return {}, 0.0
    base = every["toxic"] / (every["toxic"] + every["clean"])
    counts_of = {r["f"]: (r["toxic"], r["clean"]) for r in rows if r["f"] and g2(r["toxic"], r["clean"], base) >= LEAST_G2}
    wanted = spark.sparkContext.broadcast(frozenset(counts_of))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[str]] = {}
        for batch in batches:
            out = []
            for text, _ in rows_of(batch):
                held: set[str] = set()
                for token in text_tokens(text or ""):
                    if (got := seen.get(token)) is None:
                        got = seen[token] = [f for w in set(token_words(token, shared.value)) for f in features(w) if f in wanted.value]
                    held.update(got)
                out.append(sorted(held))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), batch.column(1).cast(pa.int64())], names=["held", "toxic"])

    texts = [(r["held"], r["toxic"] > 0) for r in picked.mapInArrow(hold, "held array<string>, toxic long").filter(F.size("held") > 0).collect()]
    return choose(texts, counts_of, base), base / 10


def g2(toxic: int, clean: int, base: float) -> float:
    """Log-likelihood ratio of a feature's counts against the base rate; 0 if it is no likelier than that."""
    share = toxic / (toxic + clean) if toxic else 0.0
    if share <= base:
        return 0.0
    return 2 * (toxic * math.log(share / base) + (clean * math.log((1 - share) / (1 - base)) if clean else 0.0))


def choose(texts: list[tuple[list[str], bool]], counts: dict[str, tuple[int, int]], base: float) -> dict[str, float]:
    """Take the most telling feature, set the texts that hold it aside, and go on with the others.

    A word that only came along with a telling one, as in copies of one text, has nothing left to tell.
    """
    where: dict[str, list[int]] = {}
    left: dict[str, list[int]] = {}
    for i, (held, toxic) in enumerate(texts):
        for f in held:
            where.setdefault(f, []).append(i)
            left.setdefault(f, [0, 0])[0 if toxic else 1] += 1
    done = [False] * len(texts)
    queue = [(-g2(*n, base), f.endswith("-"), -len(f), f) for f, n in left.items()]  # of equals a whole word, then the longer
    heapq.heapify(queue)
    listed: dict[str, float] = {}
    while queue:
        worth, *rest, f = heapq.heappop(queue)
        now = -g2(*left[f], base)
        toxic, clean = counts[f]
        sure = g2(toxic, clean, base) >= SURE_G2 and toxic >= 9 * clean and left[f][0] > 0 and not left[f][1]
        if now > -LEAST_LEFT and not sure:
            continue
        if now != worth:
            heapq.heappush(queue, (now, *rest, f))
            continue
        if (precision := (toxic - 0.5) / (toxic + clean + 0.5)) < LEAST_PRECISION:
            continue
        listed[f] = precision
        for i in where[f]:
            if not done[i]:
                done[i] = True
                for other in texts[i][0]:
                    left[other][0 if texts[i][1] else 1] -= 1
    return listed


def score(docs: DataFrame, costs: np.ndarray, listed: dict[str, float], otherwise: float) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs(doc_id, text)``.

    Every distinct listed feature that a text's tokens show best tells by itself: the score is the chance
    that one of them at least is right, or ``otherwise``. Null and empty texts hold nothing of the list.
    Nothing is shuffled. What is broadcast is bounded: the trigram costs and at most MOST_FEATURES features.
    """
    shared = docs.sparkSession.sparkContext.broadcast((costs, listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs_, list_ = shared.value
        seen: dict[str, str] = {}
        for batch in batches:
            scores = []
            for text in (t for i in range(0, batch.num_rows, 256) for t in batch.column(1).slice(i, 256).to_pylist()):
                held = set()
                for token in text_tokens(text or ""):
                    if (best := seen.get(token)) is None:
                        if len(seen) > MOST_KEPT:
                            seen.clear()
                        told = [(list_[f], f) for w in token_words(token, costs_) for f in features(w) if f in list_]
                        best = seen[token] = max(told)[1] if told else ""
                    if best:
                        held.add(best)
                scores.append(max(otherwise, 1 - math.prod(1 - list_[f] for f in held)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
