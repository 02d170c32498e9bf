"""Secret scans: known key formats, and windows of high Shannon entropy in candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import for_each_text

# Fixed patterns of the known formats; ASCII mode keeps other alphabets from matching by case folding.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of 24 and more: as all runs, of which the shorter ones are dropped.
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words without which ASSIGN cannot match, in lower case.
HINTS = ("passw", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PART = re.compile(r"[^/=]+")
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class Scan:
    """``classes``: pattern of a whole candidate, and the bits a character that a window of it must reach; of digits alone none can be told from a number.

    A candidate belongs to the first class that it matches. ``allowed``: candidates that match one
    of these, or their parts between ``/`` and ``=`` that do, are left alone: letters only or without a digit, dates and versions, universally
    unique ids, runs of one character, and placeholder words.
    """

    window: int = 20
    classes: tuple[tuple[str, float], ...] = ((r"[0-9a-fA-F]+", 3.0), (r"[A-Za-z0-9]+", 3.5), (r"[A-Za-z0-9+/_=-]+", 3.6))
    allowed: tuple[str, ...] = (
        r"[^0-9]+", r"[0-9_/=+-]+", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(.)\1+", r"(?i).*(example|sample|placeholder|changeme|xxxx).*",
        r"[a-z]+([-_/][a-z]+)*[-_/]?[0-9]{1,4}", r"[/_=+-]*([a-zA-Z]+[/_=+-]+)+[a-zA-Z0-9]{0,12}",
    )


def windows_of_entropy(run: str, width: int, least: float) -> list[tuple[int, int]]:
    """Stretches of ``run`` covered by windows whose Shannon entropy reaches ``least`` bits a character.

    With c_x the counts in the window, the entropy is log2(w) - sum(c_x log2 c_x) / w; moving the
    window by one changes two counts, so the sum is kept up to date in constant time.
    """
    weigh = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, out = 0.0, []
    most = width * (math.log2(width) - least) + 1e-9
    for end, char in enumerate(run, 1):
        c = counts.get(char, 0)
        total += weigh[c + 1] - weigh[c]
        counts[char] = c + 1
        if end > width:
            gone = run[end - width - 1]
            c = counts[gone]
            total += weigh[c - 1] - weigh[c]
            counts[gone] = c - 1
        if end >= width and total <= most:
            if out and out[-1][1] >= end - width:
                out[-1] = (out[-1][0], end)
            else:
                out.append((end - width, end))
    return out


def without(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What spans leave of ``start`` to ``end``; spans are sorted and do not overlap."""
    for low, high in taken[max(0, bisect_left(taken, (start,)) - 1) :]:
        if low >= end:
            break
        if low > start:
            yield start, low
        start = max(start, high)
    if start < end:
        yield start, end


def united(spans: list) -> list[tuple[int, int]]:
    """Spans (start, kind, end), sorted by start, as stretches that do not overlap."""
    out: list[tuple[int, int]] = []
    for start, _, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def grown(run: str, stretches: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches up to the ``/`` or ``=`` around them, so that no end of a key is left; closing ``=`` belong to it."""
    last = 0
    for start, end in stretches:
        start += len(run[start:end]) - len(run[start:end].lstrip("/="))
        start = max(last, run.rfind("/", 0, start) + 1, run.rfind("=", 0, start) + 1)
        end = start + len(run[start:end].rstrip("/="))
        end = min((p for p in (run.find("/", end), run.find("=", end)) if p >= 0), default=len(run))
        end = len(run) if not run[end:].strip("=") else end
        if start < end:
            yield start, end
            last = end


class Scanner:
    """Finds the spans (start, end, kind) of one text, in code points."""

    def __init__(self, scan: Scan = Scan()):
        self.scan = scan
        self.classes = [(re.compile(p), bits) for p, bits in scan.classes]
        self.allowed = [re.compile(p) for p in scan.allowed]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        lower = text.lower()
        if any(h in lower for h in HINTS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]

    def scanned(self, run: str, at: int = 0) -> Iterator[tuple[int, str]]:
        """Places and strings of what the allow-list leaves of a run.

        Where a pattern that matches the run also matches some of its parts between ``/`` and ``=``, those parts alone go.
        """
        pattern = next((p for p in self.allowed if p.fullmatch(run)), None)
        if pattern is None:
            yield at, run
            return
        parts = list(PART.finditer(run))
        plain = [m.span() for m in parts if pattern.fullmatch(m[0])]
        if not plain:
            return
        for start, end in zip([0, *(e for _, e in plain)], [*(s for s, _ in plain), len(run)]):
            piece = run[start:end].rstrip("/=")
            left = piece.lstrip("/=")
            if len(left) >= self.scan.window:
                yield from self.scanned(left, at + start + len(piece) - len(left))

    def entropic(self, text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """Keys in what known formats leave of the candidate strings; only that is looked at, so their own entropy marks nothing beside them."""
        for m in CANDIDATE.finditer(text):
            for start, end in without(*m.span(), taken):
                if end - start < self.scan.window:
                    continue
                for at, run in self.scanned(text[start:end], start):
                    bits = next((b for p, b in self.classes if p.fullmatch(run)), None)
                    if bits is not None:
                        yield from ((at + a, 3, at + b) for a, b in grown(run, windows_of_entropy(run, self.scan.window, bits)))

    def spans(self, text: str | None) -> tuple[list, list]:
        """The base spans and all spans, by start, then kind; entropic ones overlap nothing."""
        if not text:
            return [], []
        base = sorted(self.base(text))
        return base, sorted([*base, *self.entropic(text, united(base))])

    def redacted(self, text: str | None, mark: str = "<secret>") -> str | None:
        """``text`` with every union of overlapping spans replaced by ``mark``."""
        _, spans = self.spans(text)
        if not spans:
            return text
        out, at = [], 0
        for start, end in united(spans):
            out += [text[at:start], mark]
            at = end
        return "".join(out) + text[at:]


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def scan_documents(docs: DataFrame, scan: Scan = Scan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by known format, digest of the known spans, and all spans.

    Spans are in code points, end exclusive. A null text counts as empty: no spans, empty string.
    Repeated rows give equal rows; texts of any length are scanned whole; an empty table gives no
    rows; columns other than ``key`` and ``text`` are not read.
    """
    fields = "n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string"

    def start():
        scanner = Scanner(scan)

        def one(value: str | None) -> tuple:
            base, every = scanner.spans(value)
            kinds = [s[1] for s in every]
            return *[kinds.count(k) for k in range(4)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)

        return one

    return for_each_text(docs, key, text, fields, start)


def redact_documents(docs: DataFrame, scan: Scan = Scan(), text: str = "text", length: str = "n_chars", mark: str = "<secret>") -> DataFrame:
    """All rows and columns, secrets in ``text`` replaced by ``mark`` and ``length``, where it exists, counted anew for changed texts.

    Null and empty texts stay as they are; whole texts are scanned, however long; repeated rows change alike; an empty table stays empty.
    """
    columns = docs.columns
    at, count_at = columns.index(text), columns.index(length) if length in columns else -1

    def rewrite(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = Scanner(scan)
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [scanner.redacted(t, mark) for t in old]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, batch.schema.field(at).type)
            if count_at >= 0:
                counts = [n if a == b else len(b) for a, b, n in zip(old, new, batch.column(count_at).to_pylist())]
                arrays[count_at] = pa.array(counts, batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(rewrite, docs.schema)
