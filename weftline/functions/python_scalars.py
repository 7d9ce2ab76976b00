"""Functions that need a state machine over characters: pandas UDFs, one Arrow batch at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_words_rank(words: list[str], wanted: list[str]) -> int | None:
    """10 times the first matched word plus the words skipped in between, if ``wanted`` are beginnings of words in order."""
    start, at, gaps = None, 0, 0
    for w in wanted:
        begin = at
        while at < len(words) and not words[at].startswith(w):
            at += 1
        if at == len(words):
            return None
        if start is None:
            start = at
        else:
            gaps += at - begin
        at += 1
    return None if start is None else start * 10 + gaps


@F.pandas_udf(T.IntegerType())
def ordered_word_match_rank(words: pd.Series, wanted: pd.Series) -> pd.Series:
    """``ordered_words_rank`` of two array columns; null where the words don't match."""
    return pd.Series([ordered_words_rank(list(a), list(b)) if a is not None and b is not None else None for a, b in zip(words, wanted, strict=True)], dtype="Int32")


def top_level_split(text: str, separator: str = ",") -> list[str]:
    """Pieces between separators that stand outside all brackets and quotes, trimmed."""
    out, depth, quote, begin = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        elif c == separator and depth <= 0:
            out.append(text[begin:i].strip())
            begin = i + 1
    last = text[begin:].strip()
    return [*out, last] if last or out else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_arguments(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else top_level_split(t))


def parameter_signature(text: str) -> str:
    """A parameter list in brackets without default values, spaces squeezed."""
    inner = text.strip()
    if inner.startswith("(") and inner.endswith(")"):
        inner = inner[1:-1]
    kept = []
    for p in top_level_split(inner):
        depth, cut = 0, len(p)
        for i, c in enumerate(p):
            depth += (c in "([{<") - (c in ")]}>")
            if c == "=" and depth == 0:
                cut = i
                break
        kept.append(" ".join(p[:cut].split()))
    return "(" + ", ".join(kept) + ")"


@F.pandas_udf(T.StringType())
def normalize_parameter_signature(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else parameter_signature(t))


def matching_bracket(text: str, at: int) -> int:
    """The place of the bracket that closes the one at ``at``; -1 without one."""
    pairs = {"(": ")", "{": "}", "[": "]", "<": ">"}
    close, depth = pairs.get(text[at : at + 1]), 0
    for i in range(at, len(text) if close else 0):
        depth += (text[i] == text[at]) - (text[i] == close)
        if depth == 0:
            return i
    return -1
