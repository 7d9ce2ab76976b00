"""Binary packages: names, imports and exports of asset files, read by a worker from ``binaryFile`` rows.

The tables are found through the header. A file that is no package, or is cut short, gives a row with
``error`` and empty tables; its printable strings can still be had by ``text.ascii_strings``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the file format: its tag, and the versions at which fields were added.
TAG = 0x9E2A83C1
HASHED_NAMES, WIDE_SIZES, TEMPLATES, LOCALISED, GATHERED = 504, 511, 517, 516, 459
SOFT_PATHS = 1008

PACKAGE = "path string, names array<string>, imports array<string>, functions array<string>, parent_class string, error string"


class Cursor:
    """Little-endian reads from a place that moves on."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, layout: str) -> tuple:
        got = struct.unpack_from("<" + layout, self.data, self.at)
        self.at += struct.calcsize("<" + layout)
        return got

    def text(self) -> str:
        """A length and as many bytes, or for negative lengths two-byte units, with a closing zero."""
        (n,) = self.take("i")
        width = 1 if n >= 0 else 2
        raw = self.data[self.at : self.at + abs(n) * width]
        if len(raw) < abs(n) * width:
            raise ValueError("a text ends beyond the file")
        self.at += len(raw)
        return raw.decode("latin-1" if width == 1 else "utf-16-le", "replace").rstrip("\0")


def header(c: Cursor) -> dict[str, int]:
    """Versions and the places and sizes of the tables."""
    tag, legacy = c.take("Ii")
    if tag != TAG:
        raise ValueError("not a package")
    if legacy != -4:
        c.take("i")
    (ue4,) = c.take("i")
    ue5 = c.take("i")[0] if legacy <= -8 else 0
    c.take("i")
    (custom,) = c.take("i")
    c.at += 20 * custom
    c.take("i")
    c.text()
    flags, names, names_at = c.take("Iii")
    if ue5 >= SOFT_PATHS:
        c.take("ii")
    if ue4 >= LOCALISED and not flags & 0x80000000:
        c.text()
    if ue4 >= GATHERED:
        c.take("ii")
    exports, exports_at, imports, imports_at = c.take("iiii")
    return {"ue4": ue4, "ue5": ue5, "names": names, "names_at": names_at, "imports": imports, "imports_at": imports_at, "exports": exports, "exports_at": exports_at}


def export_size(h: dict[str, int]) -> int:
    """Bytes of an export entry: its fixed head, then flags, identifiers and dependency numbers by version."""
    head = 12 + (4 if h["ue4"] >= TEMPLATES else 0) + 12 + (16 if h["ue4"] >= WIDE_SIZES else 8)
    tail = 12 + (0 if h["ue5"] >= 1005 else 16) + (4 if h["ue5"] >= 1006 else 0) + 4
    return head + tail + (4 if h["ue4"] >= 365 else 0) + (4 if h["ue4"] >= 485 else 0) + (4 if h["ue5"] >= 1003 else 0) + (20 if h["ue4"] >= 507 else 0)


def parse_package(data: bytes, asset_name: str = "") -> dict:
    """Names, imported object paths, imported functions and the parent class of one package."""
    c = Cursor(data)
    h = header(c)
    c.at = h["names_at"]
    names = []
    for _ in range(h["names"]):
        names.append(c.text())
        if h["ue4"] >= HASHED_NAMES:
            c.take("I")
    name = lambda i: names[i] if 0 <= i < len(names) else "None"
    imports = []
    c.at = h["imports_at"]
    for _ in range(max(h["imports"], 0)):
        _, kind, outer, own, _ = c.take("qqiqq")
        if h["ue5"] > 0:
            c.take("I")
        imports.append((name(kind & 0x7FFFFFFF), outer, name(own & 0x7FFFFFFF)))
    exports = []
    for k in range(max(h["exports"], 0)):
        c.at = h["exports_at"] + k * export_size(h)
        kind, above = c.take("ii")
        if h["ue4"] >= TEMPLATES:
            c.take("i")
        outer, own = c.take("iq")
        exports.append((kind, above, outer, name(own & 0x7FFFFFFF)))

    def path(index: int, depth: int = 0) -> str:
        """The names from the outermost object down; negative numbers are imports, positive ones exports."""
        rows, at = (imports, -index - 1) if index < 0 else (exports, index - 1)
        if index == 0 or at >= len(rows) or depth > 32:
            return "None"
        outer, own = rows[at][-2], rows[at][-1]
        return own if outer == 0 else f"{path(outer, depth + 1)}.{own}"

    found = [(kind, path(-i - 1)) for i, (kind, _, _) in enumerate(imports)]
    found = [(kind, p) for kind, p in found if p.startswith("/")]
    parents = [path(above) for _, above, _, own in exports if above and own in (asset_name, asset_name + "_C")]
    parents += [p for kind, _, outer, _ in exports if outer == 0 and kind < 0 and (p := path(kind)).startswith("/Script/") and "BlueprintGeneratedClass" not in p]
    return {
        "names": names,
        "imports": sorted({p for kind, p in found if kind != "Function"}),
        "functions": sorted({p for kind, p in found if kind == "Function"}),
        "parent_class": next((p for p in parents if p != "None"), None),
    }


def packages(files: DataFrame) -> DataFrame:
    """One row a file of ``files(path, content)``; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    rows.append({"path": path, **parse_package(bytes(content or b""), stem), "error": None})
                except (ValueError, struct.error, RecursionError) as e:
                    rows.append({"path": path, "names": [], "imports": [], "functions": [], "parent_class": None, "error": str(e)})
            yield pd.DataFrame(rows, columns=["path", "names", "imports", "functions", "parent_class", "error"])

    return files.select("path", "content").mapInPandas(run, PACKAGE)
