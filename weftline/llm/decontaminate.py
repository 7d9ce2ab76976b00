"""Benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders, so a question and its copies with other
figures have one template. Every window of eight template tokens is hashed, in items and in documents, and
the hashes are joined: a document and an item that share one are a candidate pair. Items whose windows
cannot tell (too short, or mostly numbers, names and units) join by a hash of their first literal values.

A candidate pair is then judged by itself. Windows that match on one diagonal (document place less item
place) form a passage. Where no diagonal alone is enough, the item is aligned with the stretch around its
windows, so that inserted or deleted words do not hide a copy. Within a passage the slots must be
consistent: each value of the item stands for one value in the document and back, as renaming does and
chance does not. Items with one template and one pattern of equal values cannot be told apart by a copy
with other figures; they are one class, and its least item id stands for all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, read_texts
from .tokens import release_memory, rows_of, text_batches

WINDOW = 8
#: a passage counts from so many consecutive tokens, or from this share of its item's tokens
LEAST_TOKENS, LEAST_SHARE = 13, 0.8
#: of a window's tokens at least so many must be words and not placeholders
LEAST_WORDS = 4
#: share of a passage's slots that must agree with one renaming of values
LEAST_CONSISTENT = 0.8
#: tokens that may be inserted or deleted between two parts of a copy
EDITS = 4
#: items of fewer tokens are found only where they are a whole text: one or two words stand anywhere
LEAST_INSIDE = 4
#: distinct words and neighbouring pairs of words of a benchmark that are sent to tasks as a filter; with more
#: of them every text is cut into windows
MOST_PAIRS = 2_000_000
MOST_KEPT = 400_000

NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"

# Words that are read as units.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres centimeter centimeters kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros mph kmh kph percent degrees".split()
)
# Number words.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million half".split()
)

_TOKEN = re.compile(r"[0-9]+(?:[.,:/][0-9]+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")
_SENTENCE_END = re.compile(r"[.!?:;\n\"“”«»()\[\]|*#>-]\s*$")


def template(text: str, named: bool = True) -> tuple[list[str], list[str]]:
    """The tokens of a text with placeholders put in, and the lower-case values that they replaced.

    A capitalised word inside a sentence is a name, if names are asked for. A unit counts as one right
    after a number only. Punctuation and case are left out.
    """
    found = [(m.group(), m.start()) for m in _TOKEN.finditer(text)]
    capital = [w[0].isupper() for w, _ in found]
    tokens, values = [], []
    for i, (word, at) in enumerate(found):
        low = word.lower()
        values.append(low)
        if word[0].isdigit() or low in NUMBERS:
            tokens.append(NUMBER)
        elif low in UNITS and tokens and tokens[-1] == NUMBER:
            tokens.append(UNIT)
        elif named and capital[i] and len(word) > 1 and at and not _SENTENCE_END.search(text[max(0, at - 3) : at]):
            tokens.append(NAME)
        else:
            tokens.append(low)
    return tokens, values


class ItemIndex:
    """Template windows of benchmark items, by hash; the values in their slots are kept beside them.

    An item that holds names is there twice, with its names as slots and as words, for documents whose
    case tells nothing about names.
    """

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {NUMBER: 1, NAME: 2, UNIT: 3}
        self.items = []
        self.exact: dict[tuple[str, ...], dict[int, dict[tuple[str, ...], list[int]]]] = {}
        self.least = WINDOW
        for i, text in items:
            forms = [template(text or "", True), template(text or "", False)]
            self.items += [(i, *form) for form in (forms if forms[0] != forms[1] else forms[:1])]
        hashes, where = [], []
        for n, (_, tokens, _) in enumerate(self.items):
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens], np.int64)
            held = self.windows(ids)
            self._add_exact(n, held)
            for at, h in enumerate(held):
                if h:
                    hashes.append(h)
                    where.append((n, at))
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        self.hashes = np.array(hashes, np.uint64)[order]
        self.where = np.array(where, np.int64).reshape(-1, 2)[order]
        self.slots = {t for _, tokens, _ in self.items for t in tokens} & {NUMBER, NAME, UNIT}

    def _add_exact(self, n: int, held: np.ndarray) -> None:
        """Keep the literal values of an item that no copy of it could be told by from its windows."""
        item, tokens, values = self.items[n]
        covered = np.zeros(len(tokens) + 1, bool)
        for at in np.flatnonzero(held).tolist():
            covered[at : at + WINDOW] = True
        places = np.flatnonzero(covered).tolist()
        if values and _longest_run(places) < LEAST_TOKENS and len(places) < LEAST_SHARE * len(tokens):
            same = self.exact.setdefault(tuple(values[:LEAST_INSIDE]), {}).setdefault(len(values), {}).setdefault(tuple(values), [])
            if item not in same:
                same.append(item)
            self.least = min(self.least, len(values))

    @staticmethod
    def windows(ids: np.ndarray) -> np.ndarray:
        """A hash for every window of ids; 0 where an id is unknown or too few are words."""
        n = len(ids) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        words = np.concatenate([[0], np.cumsum(ids > 3)])
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        ok = (unknown[WINDOW:] == unknown[:-WINDOW]) & (words[WINDOW:] - words[:-WINDOW] >= LEAST_WORDS)
        return np.where(ok, np.maximum(h, np.uint64(1)), np.uint64(0))

    def passages(self, text: str) -> list[tuple[int, int, float, float]]:
        """(item, matched tokens, share of the item, share of consistent slots) of each item found in a text.

        Of several passages of one item the longest is told.
        """
        best: dict[int, tuple[int, int, float, float]] = {}
        forms = [template(text, True)]
        if NAME in self.slots or NAME in forms[0][0]:
            forms.append(template(text, False))
        for tokens, values in forms:
            self._match(tokens, values, best)
        if self.exact:
            self._match_exact(forms[0][1], best)
        return sorted(best.values())

    def _match(self, tokens: list[str], values: list[str], best: dict[int, tuple[int, int, float, float]]) -> None:
        ids = np.array([self.vocabulary.get(t, 0) for t in tokens], np.int64)
        h = self.windows(ids)
        left = np.searchsorted(self.hashes, h, side="left")
        right = np.searchsorted(self.hashes, h, side="right")
        hit = np.flatnonzero((h > 0) & (right > left))
        runs: dict[tuple[int, int], list[int]] = {}
        near: dict[int, list[int]] = {}
        for at in hit.tolist():
            for n, place in self.where[left[at] : right[at]].tolist():
                runs.setdefault((n, at - place), []).append(at)
        for (n, shift), ats in runs.items():
            item, item_tokens, item_values = self.items[n]
            covered = np.zeros(len(tokens) + 1, bool)
            for at in ats:
                covered[at : at + WINDOW] = True
            places = np.flatnonzero(covered).tolist()
            longest = _longest_run(places)
            share = len(places) / max(len(item_tokens), 1)
            pairs = [(item_values[p - shift], values[p], item_tokens[p - shift]) for p in places if item_tokens[p - shift] in (NUMBER, NAME, UNIT)]
            agree = consistent(pairs)
            told = (item, len(places), min(share, 1.0), agree)
            if (longest >= LEAST_TOKENS or share >= LEAST_SHARE) and agree >= LEAST_CONSISTENT and (item not in best or best[item][1:] < told[1:]):
                best[item] = told
            elif longest < LEAST_TOKENS and share < LEAST_SHARE:
                near.setdefault(n, []).append(shift)
        for n, shifts in near.items():
            if self.items[n][0] not in best:
                self._align(n, sorted(shifts), tokens, values, best)

    def _align(self, n: int, shifts: list[int], tokens: list[str], values: list[str], best: dict[int, tuple[int, int, float, float]]) -> None:
        """Align an item with the stretches of a text around its diagonals, over inserted and deleted tokens.

        It is found if its parts, in order, make up the share of it that counts, or if parts of a window
        or more, at most EDITS tokens apart, have the tokens that count.
        """
        item, item_tokens, item_values = self.items[n]
        end = None
        for shift in shifts:
            if end is not None and shift <= end:
                continue
            end = shift + EDITS
            low, high = max(0, shift - EDITS), min(len(tokens), end + len(item_tokens) + EDITS)
            parts = [b for b in SequenceMatcher(None, item_tokens, tokens[low:high], autojunk=False).get_matching_blocks() if b.size > 1]
            longest = run = 0
            before = None
            for b in (b for b in parts if b.size >= WINDOW):
                close = before is not None and b.a - before.a - before.size <= EDITS and b.b - before.b - before.size <= EDITS
                run, before = b.size + (run if close else 0), b
                longest = max(longest, run)
            places = [(b.a + k, low + b.b + k) for b in parts for k in range(b.size)]
            share = len(places) / len(item_tokens)
            agree = consistent([(item_values[i], values[p], item_tokens[i]) for i, p in places if item_tokens[i] in (NUMBER, NAME, UNIT)])
            told = (item, len(places), share, agree)
            if (longest >= LEAST_TOKENS or share >= LEAST_SHARE) and agree >= LEAST_CONSISTENT and (item not in best or best[item][1:] < told[1:]):
                best[item] = told

    def _match_exact(self, values: list[str], best: dict[int, tuple[int, int, float, float]]) -> None:
        """Items kept by their literal values: anywhere in a text, those under LEAST_INSIDE tokens as the whole text."""
        whole = tuple(values)
        found = dict.fromkeys(self.exact.get(whole, {}).get(len(whole), {}).get(whole, ()), len(whole))
        for at, start in enumerate(zip(*[values[k:] for k in range(LEAST_INSIDE)], strict=False)):
            for size, same in self.exact.get(start, {}).items():
                found.update(dict.fromkeys(same.get(tuple(values[at : at + size]), ()), size))
        for item, size in found.items():
            if item not in best:
                best[item] = (item, size, 1.0, 1.0)


#: a part of a text without a token
BLANK = -(1 << 40)


def numbered_words(words: list[str]) -> dict[str, int]:
    """Numbers from 1 for the placeholders and the words."""
    return {w: i + 1 for i, w in enumerate([NUMBER, NAME, UNIT, *sorted(set(words) - {NUMBER, NAME, UNIT})])}


class Neighbours:
    """A filter of texts: which words of a benchmark stand next to each other in it.

    ``words`` are the benchmark's template tokens; ``pairs`` the sorted pairs of the numbers of neighbours,
    ``least`` the fewest tokens by which an item can be found.
    """

    def __init__(self, words: list[str], pairs: np.ndarray, least: int) -> None:
        self.vocabulary = numbered_words(words)
        self.slots = {NUMBER, NAME, UNIT} & set(words)
        self.pairs, self.least = pairs, least
        self.seen: dict[str, int] = {}

    def may_match(self, text: str) -> bool:
        """Whether the text has a run of tokens as long as a window, or as the shortest item kept by its values, in which any two neighbours are neighbours in an item.

        Most texts are told off by this, from what is remembered of their white-space separated parts.
        """
        parts = text.split() if NAME in self.slots else text.lower().split()
        get = self.seen.get
        got = list(map(get, parts))
        if None in got:
            if len(self.seen) > MOST_KEPT:
                self.seen.clear()
            for part in set(parts):
                if part not in self.seen:
                    self.seen[part] = self._part(part)
            got = list(map(get, parts))
        part = np.array(got, np.int64)
        if not len(part):
            return False
        size = np.where(part > 0, 1, np.maximum(-part, 0))
        size[part == BLANK] = 0
        known = (part[:-1] > 0) & (part[1:] > 0)
        pair = part[:-1] << 32 | part[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        apart = known & (self.pairs[at] != pair) if len(self.pairs) else known
        gone = part == 0
        # Runs end before a part that cannot follow the one before it, and at parts no window can hold.
        ends = np.flatnonzero(np.concatenate([[True], apart | gone[1:] | gone[:-1], [True]]))
        total = np.concatenate([[0], np.cumsum(size)])
        return bool(np.diff(total[ends]).max() >= self.least)

    def _part(self, part: str) -> int:
        """The number of the word that a part of a text is; less its tokens if it is more than a word or
        may stand in a slot; 0 if no window can hold it.

        A number may stand in a slot where items have slots, a capitalised word where they have names.
        """
        words = _TOKEN.findall(part)
        if not words:
            return BLANK
        if self.slots and any(w[0].isdigit() or w.lower() in NUMBERS or w.lower() in UNITS or NAME in self.slots and w[0].isupper() for w in words):
            return -len(words)
        known = [self.vocabulary.get(w.lower(), 0) for w in words]
        return known[0] if len(words) == 1 else -len(words) if any(known) else 0


def _longest_run(places: list[int]) -> int:
    longest = run = 0
    for i, p in enumerate(places):
        run = run + 1 if i and p == places[i - 1] + 1 else 1
        longest = max(longest, run)
    return longest


def consistent(pairs: list[tuple[str, str, str]]) -> float:
    """The share of slots explained by the commonest renaming of each value of each type; 1 without slots."""
    if not pairs:
        return 1.0
    there: dict[tuple[str, str], dict[str, int]] = {}
    back: dict[tuple[str, str], dict[str, int]] = {}
    for a, b, kind in pairs:
        of = there.setdefault((kind, a), {})
        of[b] = of.get(b, 0) + 1
        of = back.setdefault((kind, b), {})
        of[a] = of.get(a, 0) + 1
    return min(sum(max(of.values()) for of in side.values()) for side in (there, back)) / len(pairs)


_SPLIT = np.uint64(0x9E3779B97F4A7C15)


def _hash_of(word: str) -> int:
    """63 bits of a word that are the same on every machine."""
    data = word.encode("utf-8", "replace")
    return (zlib.crc32(data) << 31 ^ zlib.crc32(data, 0x5EED)) & (1 << 63) - 1


class Hasher:
    """Hashes of what items and texts are joined by; words already hashed are remembered."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.seen.get
        got = list(map(get, words))
        if None in got:
            if len(self.seen) > MOST_KEPT:
                self.seen.clear()
            for w in set(words):
                if w not in self.seen:
                    self.seen[w] = _hash_of(w)
            got = list(map(self.seen.get, words))
        return np.array(got, np.uint64)

    def windows(self, tokens: list[str]) -> np.ndarray:
        """A hash of every window of template tokens with enough words in it; 0 for the others."""
        n = len(tokens) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        ids, h = self.numbers(tokens), np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                h = (h ^ ids[k : k + n]) * _SPLIT
                h ^= h >> np.uint64(29)
        words = np.concatenate([[0], np.cumsum([t not in (NUMBER, NAME, UNIT) for t in tokens])])
        return np.where(words[WINDOW:] - words[:-WINDOW] >= LEAST_WORDS, np.maximum(h, np.uint64(1)), np.uint64(0))

    def literal(self, values: list[str]) -> int:
        """A hash of literal values in a row."""
        h = np.uint64(len(values))
        with np.errstate(over="ignore"):
            for x in self.numbers(values):
                h = (h ^ x) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(31)
        return int(max(h, np.uint64(1)))

    def literals(self, values: list[str]) -> np.ndarray:
        """Hashes of every LEAST_INSIDE literal values in a row, and of a whole text of fewer."""
        if len(values) < LEAST_INSIDE:
            return np.array([self.literal(values)] if values else [], np.uint64)
        ids, n = self.numbers(values), len(values) - LEAST_INSIDE + 1
        h = np.full(n, LEAST_INSIDE, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(LEAST_INSIDE):
                h = (h ^ ids[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(31)
        return np.maximum(h, np.uint64(1))

    def of_item(self, text: str) -> list[int]:
        """What an item is joined by: the windows of its forms, or its first values where no window can tell it."""
        index = ItemIndex([(0, text)])
        out = {int(h) for _, tokens, _ in index.items for h in self.windows(tokens) if h}
        return sorted(out | {self.literal(list(start)) for start in index.exact})

    def of_text(self, text: str, named: bool, literal: bool) -> np.ndarray:
        """The distinct hashes of a text that items may share."""
        forms = [template(text, True)]
        if named or NAME in forms[0][0]:
            forms.append(template(text, False))
        parts = [self.windows(tokens) for tokens, _ in forms]
        if literal:
            parts.append(self.literals(forms[0][1]))
        out = np.unique(np.concatenate(parts))
        return out[out > 0]


def pattern_of(text: str, named: bool = True) -> str:
    """The template of an item with its values numbered by first occurrence: what a renaming leaves alone."""
    first: dict[tuple[str, str], int] = {}
    out = []
    for token, value in zip(*template(text, named), strict=True):
        out.append(f"{token}{first.setdefault((token, value), len(first))}" if token in (NUMBER, NAME, UNIT) else token)
    return " ".join(out)


ITEMS = "item_id long, text string, pattern string, hashes array<long>, words array<string>, pairs array<string>, least int, literal boolean"


def prepared_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, items, hashes, ...) a row for each class of items of ``benchmark(item_id, text)``.

    Items with the same templates, with names as slots and as words, and the same pattern of equal values
    are a class, told by its least item id and that item's text; ``items`` counts them. An item that only its literal values can tell is a
    class with its equals alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            rows = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index = ItemIndex([(item, text)])
                if not index.items[0][1]:
                    continue
                pairs = {f"{a} {b}" for _, tokens, _ in index.items for a, b in zip(tokens, tokens[1:], strict=False)}
                words = {t for _, tokens, _ in index.items for t in tokens}
                pattern = "\x04".join(index.items[0][2]) if index.exact else "\x05".join([pattern_of(text), pattern_of(text, False)])
                rows.append((item, text, pattern, [h - (1 << 64) if h >> 63 else h for h in hasher.of_item(text)], sorted(words), sorted(pairs), index.least, bool(index.exact)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 8, kinds, strict=True)], names=["item_id", "text", "pattern", "hashes", "words", "pairs", "least", "literal"])

    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, ITEMS)
    first = F.min(F.struct("item_id", "text", "hashes", "words", "pairs", "least", "literal")).alias("first")
    return materialise(items.groupBy(F.sha2("pattern", 256).alias("pattern")).agg(first, F.countDistinct("item_id").alias("items")).select("first.*", "items"), "items")


def _neighbours(items: DataFrame) -> tuple[list[str], np.ndarray, int] | None:
    """The arguments of Neighbours for all items, or None where they are too many to send."""
    pairs = items.select(F.explode("pairs").alias("p")).distinct().limit(MOST_PAIRS + 1).toArrow().column("p").to_pylist()
    words = items.select(F.explode("words").alias("w")).distinct().limit(MOST_PAIRS + 1).toArrow().column("w").to_pylist()
    if max(len(pairs), len(words)) > MOST_PAIRS:
        return None
    number = numbered_words(words)
    codes = [number[a] << 32 | number[b] for a, b in (p.split(" ") for p in pairs)]
    least = items.agg(F.min("least")).first()[0]
    return words, np.unique(np.array(codes, np.int64)), least if least is not None else WINDOW


_TEXT_KEY = ("__wl_h1", "__wl_h2")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with two 64-bit hashes by which texts are told apart."""
    return docs.withColumn(_TEXT_KEY[0], F.xxhash64("text")).withColumn(_TEXT_KEY[1], F.xxhash64(F.lit(1), "text"))


def _small(df: DataFrame) -> DataFrame:
    """A table to be broadcast if it is small enough for that."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def leaking_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(__wl_h1, __wl_h2, item_id, items, tokens, share, consistent): the texts of ``docs`` that hold an item, each once.

    A scan cuts texts into windows, passing over those without a run of words that stand next to each
    other in the benchmark; the windows of distinct texts are joined with those of items; pairs that share
    one are judged.
    """
    spark = docs.sparkSession
    items = prepared_items(benchmark)
    told = spark.sparkContext.broadcast((_neighbours(items), bool(items.filter("literal").limit(1).count())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        near, literal = told.value
        neighbours, hasher = Neighbours(*near) if near is not None else None, Hasher()
        named = neighbours is None or NAME in neighbours.slots
        for batch in batches:
            for part in text_batches(((i, t) for i, (t,) in enumerate(rows_of(batch.select([0])))), most=2048):
                out = [(i, hasher.of_text(t, named, literal)) for i, t in part if t and (neighbours is None or neighbours.may_match(t))]
                out = [(i, h) for i, h in out if len(h)]
                if out:
                    held = batch.take(pa.array([i for i, _ in out], pa.int64()))
                    hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(h) for _, h in out)]), pa.int32()), pa.array(np.concatenate([h for _, h in out]).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*held.columns, hashes], names=["text", *_TEXT_KEY, "hashes"])

    key = list(_TEXT_KEY)
    texts = _keyed(read_texts(docs).filter("text is not null and text != ''").select("text")).mapInArrow(cut, "text string, __wl_h1 long, __wl_h2 long, hashes array<long>")
    texts = materialise(texts.dropDuplicates(key), "windows")
    of_items = items.select("item_id", F.explode("hashes").alias("h"))
    pairs = texts.select(*key, F.explode("hashes").alias("h")).join(_small(of_items), "h").select(*key, "item_id").distinct()
    pairs = pairs.join(texts.select(*key, "text"), key).join(_small(items.select("item_id", F.col("text").alias("item"), "items")), "item_id")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, ItemIndex] = {}
        for batch in batches:
            rows = []
            for h1, h2, text, item, of, many in rows_of(batch):
                if item not in held:
                    if len(held) > 20_000:
                        held.clear()
                    held[item] = ItemIndex([(item, of)])
                rows += [(h1, h2, item, many, *p[1:]) for p in held[item].passages(text)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*key, "item_id", "items", "tokens", "share", "consistent"])

    return materialise(pairs.select(*key, "text", "item_id", "item", "items").mapInArrow(judge, "__wl_h1 long, __wl_h2 long, item_id long, items long, tokens int, share double, consistent double"), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, tokens, share, consistent, items) of every benchmark item found in ``docs(doc_id, text)``.

    ``item_id`` stands for the ``items`` items of its class (one template, one pattern of equal values).
    Null and empty texts hold nothing, and items under LEAST_INSIDE tokens are found as whole texts only.
    Items with a null id or text are left out; a null doc_id stays null; repeated rows are answered each.
    Other columns are not read.
    """
    found = leaking_texts(docs, benchmark)
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    return rows.join(_small(found), list(_TEXT_KEY)).select("doc_id", "item_id", "tokens", "share", "consistent", "items")


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of ``docs`` for the rows in which no benchmark item is found.

    Every row is judged by its own text, whatever its id. The table must not have columns __wl_h1, __wl_h2.
    """
    found = leaking_texts(docs, benchmark).select(*_TEXT_KEY).distinct()
    return _keyed(docs).join(_small(found), list(_TEXT_KEY), "left_anti").select(*docs.columns)
