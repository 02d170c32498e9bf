"""SentencePiece encoding with seeded merge-dropout, and decoding, for merge-type (BPE) models.

A text is encoded as SentencePiece does it: characters are symbols, the agenda holds neighbouring
symbols whose union is a piece, and the best piece, then the leftmost, is merged first. Here each
candidate is skipped for good when a keyed hash of it falls below the rate, so one text has as
many segmentations as there are keys, and one key has one. All of them decode to the same text.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

META = "▁"
#: Where a chunk may begin: no piece holds a letter before META, or a line feed with another character (checked on loading).
CHUNK = re.compile(r"\n|[ ]*[^ \n]+|[ ]+")
#: Chunks up to this length go through the agenda side by side in arrays; longer ones use a heap. Both give the same ids.
SIDE_BY_SIDE = 64
SLOT_BITS = 20
A1, A2, A3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
WORD = (1 << 64) - 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Model:
    """Pieces of a model file, as tables for merging and for decoding."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
        self.size = processor.get_piece_size()
        pieces, self.bytes_of, self.byte_id = {}, [], {}
        for i in range(self.size):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
                self.bytes_of.append(b"")
            else:
                pieces[piece] = i
                self.bytes_of.append(piece.replace(META, " ").encode())
        if len(self.byte_id) != 256 or any(re.search(f"[^{META}]{META}|.\n|\n.", p, re.S) for p in pieces):
            raise ValueError("a merge-type model with byte fallback and pieces within words is needed")
        # A character that is no piece is its code point beyond the pieces; META in a text is no space.
        self.char = np.arange(0x110000, dtype=np.int32) + self.size
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.char[ord(" ")] = self.char[ord(META)]
        self.char[ord(META)] = ord(META) + self.size
        # Ranks are by score, the best first; ``none`` is the rank of no piece.
        self.by_rank = np.array(sorted(pieces.values(), key=lambda i: (-processor.get_score(i), i)), np.int32)
        self.none = len(self.by_rank)
        rank = {i: r for r, i in enumerate(self.by_rank.tolist())}
        symbol = lambda s: pieces.get(s, ord(s) + self.size if len(s) == 1 else None)
        pairs = {}
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank[i]
        self.pairs = pairs
        # The same as a table with linear probing, for look-ups of whole arrays.
        self.slots = np.full(1 << SLOT_BITS, -1, np.int64)
        self.slot_ranks = np.full(1 << SLOT_BITS, self.none, np.int32)
        for key, value in pairs.items():
            at = (key * int(A1) & WORD) >> (64 - SLOT_BITS)
            while self.slots[at] != -1:
                at = (at + 1) % (1 << SLOT_BITS)
            self.slots[at], self.slot_ranks[at] = key, value

    def union(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that two symbols make, or ``none``."""
        keys = left.astype(np.int64) << 32 | right
        at = (keys.view(np.uint64) * A1 >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        held = self.slots[at]
        out = self.slot_ranks[at]
        out[held != keys] = self.none
        open_ = np.nonzero((held != keys) & (held != -1))
        while len(open_[0]):
            at[open_] = (at[open_] + 1) % (1 << SLOT_BITS)
            held, wanted = self.slots[at[open_]], keys[open_]
            hit = tuple(axis[held == wanted] for axis in open_)
            out[hit] = self.slot_ranks[at[hit]]
            open_ = tuple(axis[(held != wanted) & (held != -1)] for axis in open_)
        return out

    def spelled(self, symbols: np.ndarray) -> np.ndarray:
        """Characters that are no piece become the pieces of their bytes."""
        out: list[int] = []
        for s in symbols.tolist():
            out += [s] if s < self.size else [self.byte_id[b] for b in chr(s - self.size).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int64)


class Dropout:
    """Encoder and decoder; ``rate`` of the candidates are skipped, by ``seed``."""

    def __init__(self, rate: float = 0.1, seed: int = 0, path: str | None = None):
        self.model = Model(path)
        self.limit = np.uint64(min(int(rate * 2.0**64), WORD))
        self.always = rate >= 1
        self.seed = np.uint64(seed & WORD)

    def skips(self, key, start, middle, end, rank) -> np.ndarray:
        """Whether candidates are skipped: by the text's key and the chunk's place in it, the three borders in the chunk and the piece's rank."""
        spot = (start.astype(np.uint64) * A1 + middle.astype(np.uint64)) * A2 + end.astype(np.uint64) * A3
        return (_mixed(_mixed(spot ^ self.seed) + key + rank.astype(np.uint64) * A1) < self.limit) | self.always

    def agenda(self, chunk: str, key: int) -> np.ndarray:
        """Symbols of one chunk by a heap of candidates, in n log n steps."""
        model, n = self.model, len(chunk)
        symbols = model.char[np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        after, before, starts = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(n + 1))
        alive, heap = [True] * n, []
        key_word = np.uint64(key & WORD)

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                rank = model.pairs.get(symbols[i] << 32 | symbols[j])
                if rank is not None and not self.skips(key_word, *(np.array([x], np.int64) for x in (starts[i], starts[j], starts[after[j]], rank)))[0]:
                    heapq.heappush(heap, (rank, i, j, after[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, j, end = heapq.heappop(heap)
            if not alive[i] or after[i] != j or not alive[j] or after[j] != end:
                continue
            symbols[i], alive[j], after[i] = int(model.by_rank[rank]), False, end
            if end < n:
                before[end] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([s for s, a in zip(symbols, alive) if a], np.int64)

    def side_by_side(self, chunks: list[str], keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Chunks of one length: (their numbers, rows of symbols), one merge in every unfinished chunk at a time."""
        model, n = self.model, len(chunks[0])
        symbols = model.char[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(len(chunks), n)
        if n == 1:
            return [(np.arange(len(chunks)), symbols)]
        rows, done = np.arange(len(chunks)), []
        edges = np.broadcast_to(np.arange(n + 1, dtype=np.uint8), (len(chunks), n + 1))

        def candidates(left, right, start, middle, end, key):
            rank = model.union(left, right)
            rank[self.skips(key, start, middle, end, rank)] = model.none
            return rank

        ranks = candidates(symbols[:, :-1], symbols[:, 1:], edges[:, :-2], edges[:, 1:-1], edges[:, 2:], keys[:, None])
        while True:
            best = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), best]
            live = least < model.none
            if not live.all():
                done.append((rows[~live], symbols[~live]))
                rows, symbols, edges, ranks, best, least, keys = (x[live] for x in (rows, symbols, edges, ranks, best, least, keys))
            if not len(rows):
                return done
            all_rows, width = np.arange(len(rows)), symbols.shape[1]
            # The right one of the two symbols, its left border and the candidate between them go.
            stay = np.ones((len(rows), width + 1), bool)
            stay[all_rows, best + 1] = False
            symbols = symbols[stay[:, :width]].reshape(len(rows), width - 1)
            symbols[all_rows, best] = model.by_rank[least]
            edges = edges[stay].reshape(len(rows), width)
            if width == 2:
                return [*done, (rows, symbols)]
            ranks = ranks[stay[:, 1:width]].reshape(len(rows), width - 2)
            for shift in (-1, 0):
                at = best + shift
                ok = (at >= 0) & (at < width - 2)
                r, c = all_rows[ok], at[ok]
                ranks[r, c] = candidates(symbols[r, c], symbols[r, c + 1], edges[r, c], edges[r, c + 1], edges[r, c + 2], keys[ok])

    def encode(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text under its key; none for null or empty. Every chunk is drawn anew, by its place in the text."""
        split = [CHUNK.findall(" " + t) if t else [] for t in texts]
        members = list(chain.from_iterable(split))
        sizes = [len(chunks) for chunks in split]
        lengths = np.fromiter(map(len, members), np.int64, len(members))
        words = np.repeat(np.array([k & WORD for k in keys], np.uint64), sizes) + np.fromiter(chain.from_iterable(map(range, sizes)), np.uint64, len(members)) * A2
        made: list[bytes] = [b""] * len(members)
        for i in np.nonzero(lengths > SIDE_BY_SIDE)[0].tolist():
            made[i] = self.model.spelled(self.agenda(members[i], int(words[i]))).astype("<u4").tobytes()
        for length in range(1, min(SIDE_BY_SIDE, int(lengths.max(initial=0))) + 1):
            at = np.nonzero(lengths == length)[0]
            for rows, symbols in self.side_by_side([members[i] for i in at.tolist()], words[at]) if len(at) else []:
                odd = (symbols >= self.model.size).any(1)
                data, width = symbols.astype("<u4").tobytes(), 4 * symbols.shape[1]
                for i, start in zip(at[rows].tolist(), range(0, len(data), width)):
                    made[i] = data[start : start + width]
                for row in np.nonzero(odd)[0].tolist():
                    made[at[rows[row]]] = self.model.spelled(symbols[row]).astype("<u4").tobytes()
        ends = np.cumsum(sizes).tolist()
        return [np.frombuffer(b"".join(made[end - size : end]), "<u4") for end, size in zip(ends, sizes)]

    def decode(self, ids: np.ndarray) -> str:
        """The text: bytes of the pieces without the space put before the first."""
        return b"".join(map(self.model.bytes_of.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def encode_documents(
    docs: DataFrame, rate: float = 0.1, seed: int = 0, path: str | None = None, keep_ids: bool = True, key: str = "doc_id", text: str = "text", at_once: int = 1_000_000
) -> DataFrame:
    """One row per document: key, ``n_ids``, ``ids_crc32`` of the little-endian 32-bit ids, ``lossless``, and with ``keep_ids`` ``ids``.

    The segmentation depends on the seed, the key and the text alone, so a task run again writes
    the same. ``lossless`` says that decoding gave the text back. A null text has no ids (null
    with ``keep_ids``), an empty one an empty list; rows with equal keys and texts are encoded
    alike; an empty table gives no rows; other columns are not read. Texts are encoded together
    up to ``at_once`` characters, a longer one alone.
    """
    key_type = docs.schema[key].dataType
    schema = f"`{key}` {key_type.simpleString()}, n_ids bigint, ids_crc32 bigint, lossless boolean" + ", ids array<int>" * keep_ids

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = Dropout(rate, seed, path)
        names = [key, "n_ids", "ids_crc32", "lossless", *["ids"] * keep_ids]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())][: 3 + keep_ids]

        def give(part, texts):
            rows = []
            for value, ids in zip(texts, coder.encode(texts, part.column(2).to_pylist())):
                rows.append((len(ids), zlib.crc32(ids.tobytes()), coder.decode(ids) == (value or ""), *[None if value is None else ids.astype(np.int32)] * keep_ids))
            return pa.RecordBatch.from_arrays([part.column(0).cast(to_arrow_type(key_type)), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=names)

        for batch in batches:
            texts, start, chars = batch.column(1).to_pylist(), 0, 0
            for i, value in enumerate(texts):
                if chars + len(value or "") > at_once and i > start:
                    yield give(batch.slice(start, i - start), texts[start:i])
                    start, chars = i, 0
                chars += len(value or "")
            if len(texts) > start:
                yield give(batch.slice(start), texts[start:])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.col(key)).alias("_seed")).mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and ``text`` of rows with ids; null for null."""
    key_type = encoded.schema[key].dataType

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = Dropout(0.0, 0, path)
        for batch in batches:
            texts = [None if v is None else coder.decode(np.array(v, np.int64)) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to_arrow_type(key_type)), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(work, f"`{key}` {key_type.simpleString()}, text string")
