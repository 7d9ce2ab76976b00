"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams (n = 1, 2, 3 blended) that occur in both,
over the root of the product of their own numbers: presence, not frequency. An n-gram is told by a hash of
its letters, all other characters being one; any letter of any script counts. A bounded sample of labelled
rows gives Nyström landmarks and one-versus-rest kernel ridge regressors on the landmark features. As
kernels against landmarks are presence rows times the landmarks' presence matrix, everything after the
rows folds into one matrix of n-grams by languages, and a batch of texts is scored by one product.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, materialise, read_texts
from .tokens import release_memory

#: bounds of the fitted sample: labelled rows a language, landmarks a language
SAMPLE_TEXTS, LANDMARKS = 400, 48
RIDGE = 1e-3
#: hashed n-grams
CODE_BITS = 21
SHORT = 60
SHARPNESS = 4.0
UNKNOWN = "und"
BATCH = 64
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def letter_values() -> np.ndarray:
    """A number for every letter among the code points; 0 for all other characters."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    h = (points + np.uint32(1)) * _MULTIPLIERS[0]
    h ^= h >> np.uint32(15)
    h *= _MULTIPLIERS[1]
    return np.where(letters, np.maximum(h, np.uint32(1)), np.uint32(0))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint32(16)) * _MULTIPLIERS[2]
    return (h >> np.uint32(32 - CODE_BITS)).astype(np.int32)


def codes_of(text: str, values: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of the whole text, repeats included."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    one = np.concatenate([np.zeros(1, np.uint32), values[points], np.zeros(1, np.uint32)])
    two = one[:-1] * _MULTIPLIERS[0] + one[1:] + np.uint32(2)
    three = two[:-1] * _MULTIPLIERS[1] + one[2:] + np.uint32(3)
    return _mixed(np.concatenate([one, two, three]))


@dataclass
class LanguageModel:
    languages: list[str]
    values: np.ndarray  # of every code point
    column: np.ndarray  # n-gram code -> column of the presence row, -1 if no landmark has it
    weights: np.ndarray  # columns by languages


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def short_of(text: str) -> str:
    """A short stretch from within a text, so that short texts are learned as well."""
    return text[len(text) // 3 : len(text) // 3 + SHORT]


def fit(texts: list[str], langs: list[str]) -> LanguageModel:
    """The model of labelled texts; with no text it knows no language and predicts ``und``."""
    values = letter_values()
    return fit_grams([np.unique(codes_of(t, values)) for t in texts], [np.unique(codes_of(short_of(t), values)) for t in texts], langs, values)


def fit_grams(long: list[np.ndarray], short: list[np.ndarray], langs: list[str], values: np.ndarray) -> LanguageModel:
    """Fit landmarks, ridge regressors and the folded weights to the n-grams of texts, each also counted by a short stretch of it."""
    languages = sorted(set(langs))
    model = LanguageModel(languages, values, np.full(1 << CODE_BITS, -1, np.int32), np.zeros((0, len(languages)), np.float32))
    if not long:
        return model
    grams = [*long, *short]
    number = {x: i for i, x in enumerate(languages)}
    label = np.array([number[x] for x in [*langs, *langs]])
    marks: list[int] = []
    for k in range(len(languages)):
        mine = np.flatnonzero(label[: len(long)] == k)
        marks += [*mine[: LANDMARKS * 3 // 4], *(mine[-(LANDMARKS // 4) :] + len(long))]
    vocabulary = np.unique(np.concatenate([grams[i] for i in marks]))
    model.column[vocabulary] = np.arange(len(vocabulary))

    def presence(rows: list[int]) -> np.ndarray:
        out = np.zeros((len(rows), len(vocabulary)), np.float32)
        for r, i in enumerate(rows):
            at = model.column[grams[i]]
            out[r, at[at >= 0]] = 1 / np.sqrt(len(grams[i]))
        return out

    land = presence(marks)
    value, vector = np.linalg.eigh((land @ land.T).astype(np.float64))
    root = vector @ np.diag(np.where(value > 1e-6 * value.max(), 1 / np.sqrt(np.maximum(value, 1e-12)), 0)) @ vector.T
    feature = np.concatenate([presence(list(range(i, min(i + 256, len(grams))))) @ land.T for i in range(0, len(grams), 256)]) @ root
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1 / np.maximum(np.bincount(label, minlength=len(languages)), 1)[label]  # languages weigh the same
    weighted = feature * share[:, None]
    solved = np.linalg.solve(weighted.T @ feature + RIDGE * np.eye(len(marks)), weighted.T @ target)
    model.weights = (land.T @ (root @ solved)).astype(np.float32)
    return model


def training_sample(docs: DataFrame, learnable: Column) -> DataFrame:
    """(lang, rank, text): at most SAMPLE_TEXTS labelled rows a language, those with the least id hashes, texts whole.

    The counts a language set how small a hash must be to be looked at, so that the ranking sees a
    few times the sample and not all rows.
    """
    rows = docs.filter(learnable & F.col("lang").isNotNull()).select("doc_id", "lang", "text", F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long").alias("__wl_h"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__wl_n"))
    counts = counts.select(F.col("lang").alias("__wl_lang"), (F.least(F.lit(1.0), F.lit(6.0 * SAMPLE_TEXTS) / F.col("__wl_n")) * 0xFFFFFFFF).alias("__wl_most"))
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    near = rows.filter(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).join(counts, (F.col("lang") == F.col("__wl_lang")) & (F.col("__wl_h") <= F.col("__wl_most")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("__wl_h", "doc_id", "text"))
    return near.select("lang", "text", rank.alias("rank")).filter(F.col("rank") <= SAMPLE_TEXTS)


def train(docs: DataFrame, learnable: Column) -> LanguageModel:
    """Fit on the rows of ``docs(doc_id, text, lang)`` that the condition ``learnable`` admits.

    Tasks reduce the sampled texts to their distinct n-grams; those reach the driver, and no text.
    """
    values = letter_values()
    shared = docs.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                texts = part.column(2).to_pylist()
                grams = [[np.unique(codes_of(x, shared.value)) for x in (t, short_of(t))] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([g[k] for g in grams], pa.list_(pa.int32())) for k in range(2))], names=["lang", "rank", "long", "short"])

    got = materialise(training_sample(docs, learnable).select("lang", "rank", "text").mapInArrow(run, "lang string, rank int, long array<int>, short array<int>"), "languages").orderBy("lang", "rank").toArrow()
    grams = [[np.array(x, np.int32) for x in got.column(c).to_numpy()] for c in ("long", "short")]
    return fit_grams(*grams, got.column("lang").to_pylist(), values)


class Scorer:
    """Applies a model to batches of whole texts."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.mark = np.zeros(1 << CODE_BITS, np.int32)
        self.rows = np.zeros((BATCH, len(model.weights)), np.float32)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The language of each text, its share among all (0 to 1), and the share of its distinct n-grams that a landmark has."""
        m = self.model
        names, scores, known_share = [], [], []
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            known = [bool(t) and has_letter(t) and len(m.weights) > 0 for t in part]
            self.rows[: len(part)] = 0
            size, held = np.ones(len(part)), np.zeros(len(part))
            for i, t in enumerate(part):
                if known[i]:
                    codes = codes_of(t, m.values)
                    place = np.arange(len(codes), dtype=np.int32)
                    self.mark[codes] = place
                    first = self.mark[codes] == place
                    size[i] = np.count_nonzero(first)
                    column = m.column[codes]
                    held[i] = np.count_nonzero(first & (column >= 0))
                    self.rows[i, column[column >= 0]] = 1
            raw = (self.rows[: len(part)] @ m.weights) / np.sqrt(size)[:, None] if len(m.weights) else np.zeros((len(part), 1))
            shown = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
            shown /= shown.sum(axis=1, keepdims=True)
            best = raw.argmax(axis=1)
            for i, ok in enumerate(known):
                names.append(m.languages[best[i]] if ok else UNKNOWN)
                scores.append(float(shown[i, best[i]]) if ok else 0.0)
                known_share.append(float(held[i] / size[i]))
        return names, scores, known_share


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_known")) -> DataFrame:
    """Add the language, its share and how much of the text is known to ``docs``; columns of these names are replaced.

    A null text or one without a letter gets ``und``, 0 and 0. Every row is kept; nothing is shuffled.
    The model, of a size bounded by the n-gram hashes and the landmarks, is broadcast.
    """
    docs = read_texts(docs).drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.values, model.column, model.weights))
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        scorer = Scorer(LanguageModel(*shared.value))
        for batch in batches:
            told: list[list] = [[], [], []]
            for i in range(0, batch.num_rows, BATCH):
                for held, got in zip(told, scorer.score(batch.column(at).slice(i, BATCH).to_pylist()), strict=True):
                    held += got
            added = [pa.array(x, k) for x, k in zip(told, (pa.string(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, *names])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(names, kinds, strict=True))]))
