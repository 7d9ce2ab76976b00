"""Token ids of whole texts by the tokenizers library, with each distinct chunk encoded once per worker.

A chunk is a stretch between two places where the tokenizer surely starts a new pre-token, so the ids of
a text are the ids of its chunks in order. Chunks are found, hashed and put together again with numpy
over many texts at a time; only chunks not seen before go through the tokenizer. A hash finds the
remembered chunk, and every character is compared with it: a text with a chunk that is another one of the
same hash is encoded uncut.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

#: chunks remembered; beyond so many the memory is emptied and filled anew
MOST_KEPT = 500_000
#: slots of the hash table of remembered chunks, as a power of two: over twice MOST_KEPT
SLOT_BITS = 20
#: characters handled at a time
STRETCH = 400_000

SPACE, NEWLINE, LETTER, NUMBER, SYMBOL, OTHER_SPACE = range(6)
_BASE, _SEED = 0x9E3779B97F4A7C15 | 1, 20240607


def character_classes() -> np.ndarray:
    """The class of every code point: white space, letter, number or symbol."""
    table = np.full(0x110000, SYMBOL, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[[i for i in range(0x3001) if chr(i).isspace() and not 0x1C <= i <= 0x1F]] = OTHER_SPACE  # as Unicode has it
    table[0x20], table[0x0A] = SPACE, NEWLINE
    return table


class Chunks:
    """Cuts of many texts at once: where chunks start and end in the joined code points, and their texts."""

    def __init__(self, classes: np.ndarray, splitter: str) -> None:
        self.classes, self.splitter = classes, splitter
        rng = np.random.default_rng(_SEED)
        self.value = rng.integers(1, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(1, _BASE, np.uint64))
            self.inverse = np.cumprod(np.full(1, pow(_BASE, -1, 1 << 64), np.uint64))
        self._grow(STRETCH + 1)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power = np.cumprod(np.full(n, _BASE, np.uint64))
                self.inverse = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))

    def whole(self, text: str) -> bool:
        """Whether a text must be encoded uncut.

        Where single spaces and newlines matter, any other white space and any run of it is left to
        the tokenizer. Where white space only separates, two letters change their number or form with
        their neighbours when lower-cased.
        """
        return "İ" in text if self.splitter == "words" else self.splitter == "none"

    def prepare(self, text: str) -> str:
        if self.splitter == "words":
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" not in text:
                text = text.lower()
        return text

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Joined text, chunk starts and ends, the text each chunk is of, hashes, and texts not to be cut."""
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.classes[code]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(size)])
        first = np.zeros(len(code) + 1, bool)
        first[begin] = True
        first = first[:-1]
        before = np.concatenate([[OTHER_SPACE], kind[:-1]]).astype(np.uint8)
        blank = (kind == SPACE) | (kind == NEWLINE) | (kind == OTHER_SPACE)
        apart = kind != before
        # An apostrophe and the letters after it are one chunk: contractions are known as such.
        apart[1:] &= ~((code[:-1] == 0x27) & (kind[1:] == LETTER))
        if self.splitter == "words":
            start = np.flatnonzero((first | apart) & ~blank)
            after = np.flatnonzero(first | apart | blank)
            end = np.concatenate([after, [len(code)]])[np.searchsorted(after, start, side="right")]
            bad = np.zeros(len(texts), bool)
        else:
            start = np.flatnonzero(first | (kind == SPACE) | (kind == NEWLINE) | (before == NEWLINE) | (apart & (before != SPACE)))
            end = np.concatenate([start[1:], [len(code)]])
            blank_before = np.concatenate([[False], blank[:-1]]) & ~first
            wrong = (blank & blank_before) | (kind == OTHER_SPACE)
            bad = np.zeros(len(texts), bool)
            bad[np.searchsorted(begin, np.flatnonzero(wrong), side="right") - 1] = True
        owner = np.searchsorted(begin, start, side="right") - 1
        self._grow(len(code) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[code] * self.power[: len(code)])])
            hashed = (total[end] - total[start]) * self.inverse[start]
            hashed ^= hashed >> np.uint64(29)
            mark = (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) ^ code[start].astype(np.uint64) << np.uint64(21) ^ code[end - 1].astype(np.uint64) if len(start) else hashed
            hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + mark
            hashed ^= hashed >> np.uint64(32)
            hashed = np.maximum(hashed * np.uint64(0x9E3779B97F4A7C15), np.uint64(1))
        return joined, start, end, owner, hashed, bad


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each of several ranges."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _appended(held: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """An array with more behind its used part, grown by half where it must be, and how much is used then."""
    if used + len(more) > len(held):
        grown = np.zeros((used + len(more)) * 3 // 2, held.dtype)
        grown[:used] = held[:used]
        held = grown
    held[used : used + len(more)] = more
    return held, used + len(more)


class ChunkEncoder:
    """Encodes texts to packed little-endian ids of two bytes (four for vocabularies over 65,536).

    ``splitter`` says which cuts are safe: ``words`` for tokenizers that lower-case, drop white space and
    take runs of letters, single numbers and runs of other characters; ``spaces`` for byte-level ones
    that take the same runs with a single space before them; ``none`` for any other (never cut).
    With ``added`` the strings of added tokens are matched in texts, as the tokenizer does by itself:
    texts that hold one are encoded uncut. Without it they are ordinary text.
    """

    def __init__(self, path: str, splitter: str, classes: np.ndarray, added: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        kept = self.tokenizer.get_added_tokens_decoder().values() if added else ()
        self.added = [t.content for t in kept if not t.normalized]
        self.added_after = [t.content for t in kept if t.normalized]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.chunks = Chunks(classes, splitter)
        self._forget()

    def _forget(self) -> None:
        self.known = 0
        self.slot_hash, self.slot_entry = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.begin, self.size, self.first, self.length = (np.zeros(1024, np.uint32) for _ in range(4))
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.codes, self.spelled = np.zeros(1 << 16, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash; -1 for one not seen before."""
        out = np.full(len(hashes), -1, np.int64)
        left, at = np.arange(len(hashes)), (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(left):
            held = self.slot_hash[at]
            hit = held == hashes[left]
            out[left[hit]] = self.slot_entry[at[hit]]
            on = ~hit & (held != 0)
            left, at = left[on], at[on] + 1 & (1 << SLOT_BITS) - 1
        return out

    def _place(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Put distinct new hashes into free slots."""
        at = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(hashes):
            free = self.slot_hash[at] == 0
            self.slot_hash[at[free]] = hashes[free]  # of several for one slot the last stays
            won = self.slot_hash[at] == hashes
            self.slot_entry[at[won]] = entries[won]
            hashes, entries, at = hashes[~won], entries[~won], at[~won] + 1 & (1 << SLOT_BITS) - 1

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, texts: list[str], codes: np.ndarray, length: np.ndarray) -> None:
        """Remember chunks: their ids, and their code points, which ``codes`` holds one after the other."""
        got = self._ids(texts)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((x for ids in got for x in ids), self.dtype, int(sizes.sum()))
        n, m = self.known, self.known + len(got)
        while len(self.begin) < m:
            self.begin, self.size, self.first, self.length = (np.concatenate([x, x]) for x in (self.begin, self.size, self.first, self.length))
        self.begin[n:m] = self.used + np.cumsum(sizes) - sizes
        self.size[n:m] = sizes
        self.first[n:m] = self.spelled + np.cumsum(length) - length
        self.length[n:m] = length
        self.pool, self.used = _appended(self.pool, self.used, flat)
        self.codes, self.spelled = _appended(self.codes, self.spelled, codes)
        self._place(hashes, np.arange(n, m))
        self.known = m

    def holds_added(self, text: str) -> bool:
        """Whether a text holds an added token's string, before or, where the token asks for it, after normalisation."""
        if any(x in text for x in self.added):
            return True
        if not self.added_after:
            return False
        normalise = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        norm = normalise(text)
        return any(normalise(x) in norm for x in self.added_after)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; a null text counts as empty."""
        out = [b""] * len(texts)
        cut, uncut = [], []
        for i, text in enumerate(texts):
            if text:
                (uncut if self.chunks.whole(text) or self.holds_added(text) else cut).append(i)
        run: list[int] = []
        n = 0
        for i in [*cut, None]:
            if i is None or n + len(texts[i]) > STRETCH and run:
                uncut += self._stretch(texts, run, out)
                run, n = [], 0
            if i is not None:
                run.append(i)
                n += len(texts[i])
        for i, ids in zip(uncut, self._ids([texts[i] for i in uncut]), strict=True):
            out[i] = np.array(ids, self.dtype).tobytes()
        return out

    def _stretch(self, texts: list, run: list[int], out: list[bytes]) -> list[int]:
        """Encode the texts numbered in ``run``; returns those that must be encoded uncut."""
        if not run:
            return []
        joined, start, end, owner, hashed, bad = self.chunks.cut([self.chunks.prepare(texts[i]) for i in run])
        if not len(start):
            return [i for i, b in zip(run, bad, strict=True) if b]
        if self.known > MOST_KEPT:
            self._forget()
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        length = end - start
        distinct, where, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        found = self._find(distinct)
        new = np.flatnonzero(found < 0)
        if len(new):
            at = where[new]
            self._learn(distinct[new], [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], code[ranges(start[at], length[at])], length[at])
            found[new] = np.arange(self.known - len(new), self.known)
        entry = found[inverse]
        # What is not the remembered chunk, though its hash is the same.
        other = self.length[entry] != length
        if other.any():
            bad[owner[other]] = True
        ours = code if int(length.sum()) == len(code) else code[ranges(start, length)]
        at = np.repeat(self.first[entry].astype(np.int64) - (np.cumsum(length) - length), length)
        at += np.arange(len(at))
        differ = np.flatnonzero(self.codes.take(at, mode="clip") != ours)
        if len(differ):
            bad[owner[np.searchsorted(np.cumsum(length), differ, side="right")]] = True
        size = self.size[entry].astype(np.int64)
        ends = np.cumsum(size)
        flat = self.pool[np.repeat(self.begin[entry].astype(np.int64) - (ends - size), size) + np.arange(ends[-1])].tobytes()
        limit = np.concatenate([[0], np.cumsum(np.bincount(owner, size, len(run)).astype(np.int64))]) * self.dtype.itemsize
        for k, i in enumerate(run):
            out[i] = flat[limit[k] : limit[k + 1]]
        return [i for i, b in zip(run, bad, strict=True) if b]

    def wide(self, ids: bytes) -> bytes:
        """The same ids, four little-endian bytes each."""
        return ids if self.dtype.itemsize == 4 else np.frombuffer(ids, self.dtype).astype("<u4").tobytes()

    def one(self, token: int) -> bytes:
        return np.array([token], dtype=self.dtype).tobytes()


def worker_encoder(path: str, splitter: str, classes: np.ndarray) -> ChunkEncoder:
    """The encoder of this worker process, kept for its next tasks."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_by_worker", {})
    if (path, splitter) not in kept:
        kept.clear()
        kept[path, splitter] = ChunkEncoder(path, splitter, classes, added=True)
    return kept[path, splitter]


def release_memory() -> None:
    """Give back what earlier tasks of this worker process left: encoders, and freed memory that the process still holds."""
    import ctypes
    import gc

    import pyarrow as pa
    import tokenizers

    tokenizers.__dict__.get("_kept_by_worker", {}).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def rows_of(batch, rows: int = 256):
    """The rows of an Arrow batch as tuples, a few at a time, so that no whole batch is held in Python."""
    for at in range(0, batch.num_rows, rows):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)


def text_batches(values, most: int = 512, size: int = 8_000_000):
    """Cut rows (key, text) into runs of bounded count and text length."""
    run, n = [], 0
    for row in values:
        run.append(row)
        n += len(row[1] or "")
        if len(run) >= most or n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run
