"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier
cues. A local parser grows each anchor into a span and validates it. The parsers for e-mail, ip, card
and phone give exactly the leftmost non-overlapping matches of their patterns (in the docstrings), as
each kind's matches are decided by the characters around its anchors alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_texts
from .tokens import release_memory

BASE_KINDS = ("email", "ip", "card", "phone")
#: found beside the base kinds: web addresses, account or identity numbers after a cue, and secrets
MORE_KINDS = ("url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "acct", "iban", "ssn", "passport", "routing", "customer id", "member id")

#: words that a secret follows, and the beginning of access keys that tell themselves
SECRET_CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "private_key")
KEY_CUES = ("akia", "asia")

Span = tuple[int, int]

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"[\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"']*[^\s<>\"'.,;:!?)\]]")
_ACCOUNT = re.compile(r"(?:\s?(?:number|no|nr|id|code)\b)?[\s.:#=-]{1,4}([A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[ -][A-Za-z0-9]*[0-9][A-Za-z0-9]*)*)")


_SECRET = re.compile(r"\w*[\"']?\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9_+/=.~!@#$%^&*-]{8,})")
_KEY = re.compile(r"[0-9A-Z]{16}(?![0-9A-Za-z])")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str, ats: list[int]) -> list[Span]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` from the places of the at-signs."""
    out, free = [], 0
    for at in ats:
        if at < free:
            continue
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        if begin == at:
            continue
        if m := _DOMAIN.match(text, at + 1):
            out.append((begin, m.end()))
            free = m.end()
    return out


def addresses(text: str, digits: list[int]) -> list[Span]:
    """``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of at most 255.

    A run of dotted numbers is consumed four parts at a time from its start; a match that fails is
    dropped with the characters that it took.
    """
    out, free = [], 0
    for at in digits:
        if at < free:
            continue
        m = _QUADS.match(text, at)
        free = m.end()
        if m.end() - at < 7:
            continue
        parts, begin = m.group().split("."), at
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((begin, end))
            begin = end + 1
    return out


def cards(text: str, digits: list[int]) -> list[Span]:
    """``[0-9]([\\x20-]?[0-9])+`` of 16 to 19 digits that pass Luhn's check."""
    out, free = [], 0
    for at in digits:
        if at < free:
            continue
        if not (m := _CHAIN.match(text, at)):
            continue
        free = m.end()
        if free - at >= 16:
            plain = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(plain) <= 19 and _luhn(plain):
                out.append((at, free))
    return out


def phones(text: str, pluses: list[int]) -> list[Span]:
    """``\\+[0-9][\\x20().0-9-]+[0-9]`` of 8 to 15 digits; no plus sign is part of another match."""
    out = []
    for at in pluses:
        if text[at + 1 : at + 2] in _DIGITS and (m := _PHONE.match(text, at + 2)):
            if 8 <= sum(c in _DIGITS for c in text[at + 1 : m.end()]) <= 15:
                out.append((at, m.end()))
    return out


_DIGITS = frozenset("0123456789")


def urls(text: str, schemes: list[tuple[int, int]]) -> list[Span]:
    """A scheme and what follows it up to white space, a bracket or quote, less closing punctuation."""
    out, free = [], 0
    for begin, end in schemes:
        if begin >= free and (m := _URL.match(text, end)):
            out.append((begin, m.end()))
            free = m.end()
    return out


def accounts(text: str, cues: list[tuple[int, int]]) -> list[Span]:
    """The identifier that follows a cue as a word of its own: 6 to 34 letters and digits, 5 digits or more."""
    out, free = [], 0
    for begin, end in cues:
        if begin < free or begin and text[begin - 1].isalnum() or not (m := _ACCOUNT.match(text, end)):
            continue
        plain = [c for c in m.group(1) if c not in " -"]
        if 6 <= len(plain) <= 34 and sum(c in _DIGITS for c in plain) >= 5:
            out.append((m.start(1), m.end(1)))
            free = m.end(1)
    return out


def secrets(text: str, cues: list[tuple[int, int]], keys: list[tuple[int, int]]) -> list[Span]:
    """What is assigned to a word like ``password``, of 8 characters with a digit or more, and access keys by their form."""
    out = []
    for _, end in cues:
        if (m := _SECRET.match(text, end)) and any(c in _DIGITS for c in m.group(1)):
            out.append((m.start(1), m.end(1)))
    for begin, end in keys:
        if text[begin:end].isupper() and not (begin and text[begin - 1].isalnum()) and (m := _KEY.match(text, end)):
            out.append((begin, m.end()))
    kept, free = [], 0
    for begin, end in sorted(out):
        if begin >= free:
            kept.append((begin, end))
            free = end
    return kept


_UPPER_TO_LOWER = {i: i + 32 for i in range(65, 91)}


def lowered(text: str) -> str:
    """The text in lower case, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_UPPER_TO_LOWER)


class AnchorFinder:
    """The automaton and the parsers behind it. Cues are looked for without case."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for c in "0123456789":
            self.automaton.add_word(c, ("digit", 1))
        self.automaton.add_word("@", ("at", 1))
        self.automaton.add_word("+", ("plus", 1))
        for kind, words in (("scheme", SCHEMES), ("cue", CUES), ("secret", SECRET_CUES), ("key", KEY_CUES)):
            for word in words:
                self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> dict[str, list[Span]]:
        """Spans by kind, each list in order of its starts; ends are exclusive."""
        at, plus, digit = [], [], []
        words: dict[str, list[Span]] = {"scheme": [], "cue": [], "secret": [], "key": []}
        for end, (kind, n) in self.automaton.iter(lowered(text)):
            if kind == "digit":
                digit.append(end)
            elif kind == "at":
                at.append(end)
            elif kind == "plus":
                plus.append(end)
            else:
                words[kind].append((end - n + 1, end + 1))
        return {
            "email": emails(text, at) if at else [],
            "ip": addresses(text, digit) if digit else [],
            "card": cards(text, digit) if digit else [],
            "phone": phones(text, plus) if plus else [],
            "url": urls(text, words["scheme"]) if words["scheme"] else [],
            "account": accounts(text, words["cue"]) if words["cue"] else [],
            "secret": secrets(text, words["secret"], words["key"]) if words["secret"] or words["key"] else [],
        }


def listed(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by kind as listed, then start, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_all long"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Find personal data in every text of ``docs(doc_id, text)``.

    Returns doc_id, counts of the base kinds, a digest of the base spans, all spans as text, in code
    points, and how many they are. Null texts count as empty; a null id stays null; repeated rows are answered each. Other
    columns are not read. A pass over the rows as they lie; nothing is shuffled.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = AnchorFinder()
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans, every = [], [], []
            for text in (t for i in range(0, batch.num_rows, 256) for t in batch.column(1).slice(i, 256).to_pylist()):
                found = finder.spans(text or "")
                every.append(sum(map(len, found.values())))
                for column, kind in zip(counts, BASE_KINDS, strict=True):
                    column.append(len(found[kind]))
                digests.append(hashlib.sha256(listed(found, BASE_KINDS).encode()).hexdigest())
                spans.append(listed(found, BASE_KINDS + MORE_KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(every, pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_all"],
            )

    return read_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, FOUND)


def masked(text: str, found: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are joined."""
    spans = sorted((a, b, k) for k, rows in found.items() for a, b in rows)
    out, at = [], 0
    for begin, end, kind in spans:
        if begin >= at:
            out += [text[at:begin], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with the personal data in ``text`` masked.

    ``n_chars``, where it exists, follows the new text. Null and empty texts stay as they are.
    """
    columns = docs.columns
    at = columns.index("text")
    counted = columns.index("n_chars") if "n_chars" in columns else None

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        finder = AnchorFinder()
        for batch in batches:
            texts = [t and masked(t, finder.spans(t)) for i in range(0, batch.num_rows, 256) for t in batch.column(at).slice(i, 256).to_pylist()]
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, pa.string())
            if counted is not None:
                lengths = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                arrays[counted] = lengths.cast(batch.column(counted).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return read_texts(docs).mapInArrow(mask, docs.schema)
