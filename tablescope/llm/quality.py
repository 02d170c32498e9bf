"""Quality rules: how much of a document is covered by repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import for_each_text

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Odd multiplier of the rolling hash modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """A document stays if the characters inside repeated n-grams and lines stay within these shares of its word characters."""

    ngrams: tuple[tuple[int, float], ...] = ((5, 0.40), (7, 0.36), (10, 0.30))
    lines: float = 0.30
    least_words: int = 50
    most_repeat_percent: int = 50


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` word hashes: sum of word[i + j] * BASE**(n - 1 - j) modulo 2**64."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        out *= BASE
        out += words[j : len(words) - n + 1 + j]
    return out


def repeated(values: np.ndarray) -> np.ndarray:
    """True at every position whose value occurs twice or more."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """True at every word that lies in a window of ``n`` words marked in ``starts``."""
    edges = np.zeros(length + 1, np.int32)
    edges[: len(starts)] += starts
    edges[n : n + len(starts)] -= starts
    return np.cumsum(edges[:length]) > 0


def measure(text: str | None, limits: Limits = Limits()) -> tuple:
    """Counts and verdict for one text; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    n_dup_lines = line_chars = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                n_dup_lines += 1
                line_chars += len(line) - sum(map(line.count, SPACES))
            seen.add(line)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n_words)
    chars = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n_words)
    n_repeat_words = int(covered(repeated(rolling(hashes, 3)), 3, n_words).sum()) if n_words else 0
    shares = []
    kept = line_chars <= limits.lines * word_chars
    for n, most in limits.ngrams:
        inside = int(chars[covered(repeated(rolling(hashes, n)), n, n_words)].sum()) if n_words >= n else 0
        shares.append(inside / word_chars if word_chars else 0.0)
        kept = kept and inside <= most * word_chars
    base_failed = n_words < limits.least_words or 100 * n_repeat_words > limits.most_repeat_percent * n_words
    return n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, shares, base_failed, kept and not base_failed


def measures(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts, the share of characters in repeated lines and n-grams, and the verdict.

    A null text counts as empty: no words, so it fails. Repeated rows are judged alike, texts of
    any length are read whole (one text in memory at a time besides its Arrow batch), an empty
    table gives no rows, and columns other than ``key`` and ``text`` are not read. Words are told
    apart by 64-bit hashes.
    """
    fields = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, dup_line_chars bigint,"
        " ngram_shares array<double>, base_failed boolean, kept boolean"
    )
    return for_each_text(docs, key, text, fields, lambda: lambda t: measure(t, limits))


def keep_good(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """The documents that pass, whole rows with all their columns, whatever their names; no shuffle.

    A null text has no words, so it fails like an empty one; whole texts are measured, however long; repeated rows
    are judged alike; an empty table stays empty.
    """
    schema, columns = docs.schema, docs.columns
    at = columns.index(text)

    def choose(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good = [bool(measure(t, limits)[-1]) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(choose, schema)
