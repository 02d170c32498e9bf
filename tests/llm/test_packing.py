import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablescope.llm import packing, queries, tokens

FOLDER = "/root/testdata/sf0.01"


def check_layout(rows, capacity):
    """Every sequence is filled from 0 without gaps up to ``capacity`` at most."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_whole_table_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    tokenizer.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_best_fit_packing"](spark, FOLDER).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    ids = dict(zip(docs, tokenizer.encode_batch(list(docs.values()), add_special_tokens=False)))
    for key, parts in by_doc.items():
        every = np.array([*ids[key].ids, 0], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(math.ceil(len(every) / 2048)))
        at = 0
        for p in parts:
            assert p.start == at and p.ids_crc32 == zlib.crc32(every[at : at + p.length].tobytes())
            assert p.length == 2048 or p.piece == 0
            at += p.length
        assert at == len(every)
    total = sum(r.length for r in rows)
    assert check_layout(rows, 2048) <= 1.01 * total / 2048 + 1


def best_fit_decreasing(lengths, capacity):
    import bisect

    gaps, bins = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i < len(gaps):
            gap = gaps.pop(i) - x
        else:
            gap, bins = capacity - x, bins + 1
        bisect.insort(gaps, gap)
    return bins


@pytest.mark.parametrize("kind", ["uniform", "small", "equal", "thirds", "one"])
def test_bins_are_near_sequential_best_fit(spark, kind):
    rng = random.Random(4)
    lengths = {"uniform": [rng.randrange(1, 101) for _ in range(600)], "small": [rng.randrange(1, 6) for _ in range(600)], "equal": [25] * 300, "thirds": [34] * 90, "one": [100]}[kind]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid bigint, length bigint")
    rows = packing.best_fit(items, 100).collect()
    assert sorted(r.uid for r in rows) == list(range(len(lengths)))
    fill = {}
    for r in rows:
        fill[r.bin] = fill.get(r.bin, 0) + lengths[r.uid]
    assert max(fill.values()) <= 100
    assert len(fill) <= 1.05 * best_fit_decreasing(lengths, 100) + 1


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "null key"), (4, "word " * 9000), (5, "<|endoftext|> é 😀")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, length int, uid int")
    got = packing.pack_documents(docs, 2048, keep_ids=True).collect()
    check_layout(got, 2048)
    assert sorted((r.doc_id, r.length) for r in got if r.doc_id in (1, 2)) == [(1, 1), (2, 1)]
    encoder = tokens.Encoder()
    for key, text in rows:
        ids = [i for r in sorted((r for r in got if r.doc_id == key), key=lambda r: (r.piece, r.start)) for i in r.ids]
        want = [*encoder.encode(text).tolist(), 0]
        assert ids == want * (2 if key == 3 else 1)
    assert packing.pack_documents(docs.where(F.lit(False))).collect() == []


def test_ids_of_added_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokens.default_path()), tokens.Encoder()
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> é\n", "x<|endoftext|", " <|endoftext|>  y <|ENDOFTEXT|>", "plain"):
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert encoder.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
