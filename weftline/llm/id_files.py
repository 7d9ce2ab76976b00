"""Token-id shards with a minimal perfect hash index.

A shard is two files. ``shard-N.ids`` holds the raw ids of consecutive documents, nothing else.
``shard-N.idx`` holds the index: a hash without collisions maps a document key to a slot, and the
slot holds a 32-bit fingerprint of the key and the key's offset and length among the ids. A lookup
costs a few hashes whatever the size; a key that was never stored fails the fingerprint (but for one
in 2^32). A key is (doc_id, occurrence): repeated ids are told apart by their place.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_texts
from .tokens import character_classes, rows_of, text_batches, worker_encoder

_U = np.uint64
MAGIC = b"WLIDX001"
LEVELS = 48


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def key_hash(ids: np.ndarray, occurrence: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of (doc_id, occurrence) under a seed."""
    s = _U((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        return _mix(_mix(ids.astype(np.int64).view(_U) + s) ^ _mix(occurrence.astype(_U) * _U(0xD6E8FEB86659FD93) + s))


class PerfectHash:
    """Levels of bit arrays: a key sits at the first level where no other remaining key shares its bit.

    A slot is the number of set bits before the key's bit over all levels, so n keys fill slots 0 to
    n - 1. Keys that collide on every level (practically none) are kept in a list after them.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.rest = sizes, bits, rest  # bits: packed; rest: rows (id, occurrence)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = np.unpackbits(bits, bitorder="little") if len(bits) else np.zeros(0, np.uint8)
        self.flags = words.astype(bool)
        self.before = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])

    @classmethod
    def build(cls, ids: np.ndarray, occurrence: np.ndarray) -> PerfectHash:
        left, sizes, parts = np.arange(len(ids)), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-len(left) * 3 // 2 // 8) * 8)
            at = (key_hash(ids[left], occurrence[left], level) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        rest = np.stack([ids[left], occurrence[left]], axis=1).astype(np.int64)
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint8), rest)

    def slots(self, ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not stored any slot, or -1."""
        out = np.full(len(ids), -1, np.int64)
        left = np.arange(len(ids))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (key_hash(ids[left], occurrence[left], level) % _U(size)).astype(np.int64)
            hit = self.flags[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        for i in left if len(self.rest) else []:
            same = np.flatnonzero((self.rest == (ids[i], occurrence[i])).all(axis=1))
            if len(same):
                out[i] = self.before[-1] + same[0]
        return out


def pack_index(ids: np.ndarray, occurrence: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """The bytes of an index file; keys are listed in document order after the slots."""
    mph = PerfectHash.build(ids, occurrence)
    slot = mph.slots(ids, occurrence)
    table = np.zeros(len(ids), dtype=[("print", "<u4"), ("offset", "<u8"), ("length", "<u8")])
    table["print"][slot] = (key_hash(ids, occurrence, 1 << 20) >> _U(32)).astype("<u4")
    table["offset"][slot], table["length"][slot] = offsets, lengths
    head = json.dumps({"docs": len(ids), "ids": int(lengths.sum()), "width": width, "levels": mph.sizes, "rest": len(mph.rest)}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, mph.bits.tobytes(), mph.rest.astype("<i8").tobytes(), table.tobytes(), ids.astype("<i8").tobytes(), occurrence.astype("<u4").tobytes()])


class ShardReader:
    """Keyed access to one shard, given the bytes of its two files."""

    def __init__(self, index: bytes, payload: bytes) -> None:
        if index[:8] != MAGIC:
            raise ValueError("not an index file")
        n = int.from_bytes(index[8:12], "little")
        head, at = json.loads(index[12 : 12 + n]), 12 + n

        def take(dtype, count):
            nonlocal at
            got = np.frombuffer(index, dtype, count, at)
            at += got.nbytes
            return got

        docs = head["docs"]
        bits, rest = take("u1", sum(head["levels"]) // 8), take("<i8", 2 * head["rest"]).reshape(-1, 2)
        self.mph = PerfectHash(head["levels"], bits, rest)
        self.table = take(np.dtype([("print", "<u4"), ("offset", "<u8"), ("length", "<u8")]), docs)
        self.ids, self.occurrence, self.width = take("<i8", docs), take("<u4", docs), head["width"]
        self.payload = np.frombuffer(payload, f"<u{self.width}")
        if len(self.payload) != head["ids"]:
            raise ValueError("the payload is not as long as its index says")

    def locate(self, ids: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is stored, and its offset and length among the shard's ids."""
        slot = self.mph.slots(ids, occurrence)
        found = slot >= 0
        if not len(self.table):
            return found & False, slot * 0, slot * 0
        row = self.table[np.maximum(slot, 0)]
        found &= row["print"] == (key_hash(ids, occurrence, 1 << 20) >> _U(32)).astype("<u4")
        return found, row["offset"].astype(np.int64), row["length"].astype(np.int64)

    def get(self, doc_id: int, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one document, or None if it is not here."""
        found, offset, length = self.locate(np.array([doc_id]), np.array([occurrence]))
        return self.payload[offset[0] : offset[0] + length[0]] if found[0] else None


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class _Replaced:
    """A file written under a name of this attempt and then renamed: a repeated task replaces it as a whole."""

    def __init__(self, uri: str, attempt: int) -> None:
        self.store, self.path = _filesystem(uri)
        self.draft = f"{self.path}.{attempt}"
        self.out = self.store.open_output_stream(self.draft)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.draft, self.path)


def _get(uri: str) -> bytes:
    store, path = _filesystem(uri)
    with store.open_input_stream(path) as f:
        return f.read()


WRITTEN = "shard int, docs long, ids long"


def write_id_files(docs: DataFrame, path: str, tokenizer: str, splitter: str, end_id: int, docs_per_shard: int = 8192, bytes_per_shard: int = 64_000_000) -> DataFrame:
    """Encode every text of ``docs(doc_id, text)`` and write the ids as shards in ascending doc_id order.

    Shards are ranges of doc_id of about ``docs_per_shard`` documents, or fewer so that they hold about
    ``bytes_per_shard`` of text, one task each; ids are written as they come. Null texts count
    as empty, null ids come first (stored as the least long), ties are ordered by text. ``path`` must be
    a folder that driver and executors share. Returns one row a shard: shard, docs, ids.
    """
    spark = docs.sparkSession
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-size["docs"] // docs_per_shard), -(-size["bytes"] // bytes_per_shard))
    store, local = _filesystem(path)
    store.create_dir(local, recursive=True)
    rows = read_texts(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    classes = spark.sparkContext.broadcast(character_classes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = worker_encoder(tokenizer, splitter, classes.value)
        end, width = encoder.one(end_id), encoder.dtype.itemsize
        name = f"{path}/shard-{task.partitionId():06d}"
        ids, lengths, payload = [], [], _Replaced(f"{name}.ids", task.taskAttemptId())
        for batch in batches:
            for run in text_batches(rows_of(batch)):
                for (doc_id, _), packed in zip(run, encoder.encode([t for _, t in run]), strict=True):
                    ids.append(doc_id)
                    lengths.append(len(packed) // width + 1)
                    payload.out.write(packed)
                    payload.out.write(end)
        shard, key, length = task.partitionId(), np.array(ids, np.int64), np.array(lengths, np.int64)
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        place = np.arange(len(key))
        occurrence = place - np.maximum.accumulate(np.where(first, place, 0)) if len(key) else place
        offsets = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(key) else length
        payload.close()
        index = _Replaced(f"{name}.idx", task.taskAttemptId())
        index.out.write(pack_index(key, occurrence, offsets, length, width))
        index.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "docs": pa.array([len(key)], pa.int64()), "ids": pa.array([int(length.sum())], pa.int64())})

    return materialise(rows.mapInArrow(write, WRITTEN), "shards")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_id_files(spark: SparkSession, path: str, written: DataFrame) -> DataFrame:
    """Look every stored document up by its key and describe what the files hold.

    Returns doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as four
    little-endian bytes each). One task reads whole shards; only the list of shards is summed in one.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = written.select("shard", before.alias("base")).repartition(max(1, written.count()), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{path}/shard-{shard:06d}"
                reader = ShardReader(_get(f"{name}.idx"), _get(f"{name}.ids"))
                found, offset, length = reader.locate(reader.ids, reader.occurrence)
                if not found.all():
                    raise ValueError(f"{name}: a stored key is not found")
                crc = [zlib.crc32(reader.payload[a : a + n].astype("<u4").tobytes()) for a, n in zip(offset.tolist(), length.tolist(), strict=True)]
                null = pa.array(reader.ids == -(1 << 63))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.compute.if_else(null, pa.scalar(None, pa.int64()), pa.array(reader.ids, pa.int64())),
                    "start": pa.array(offset + base, pa.int64()),
                    "n_tokens": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                })

    import pyarrow.compute  # noqa: F401  makes pa.compute available to the function above

    return shards.mapInArrow(read, READ)
