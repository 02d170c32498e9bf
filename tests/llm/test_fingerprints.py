import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescope.llm import fingerprints as fp


def brute(rows):
    """Rows (doc_id, text): key -> (n, edited sha256, text, edited, next text)."""
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        prints = [fp.fingerprint(fp.Prefixes(t)) for t in (text, edited, after)]
        head = next((i for i, (x, y) in enumerate(zip(text, after)) if x != y), min(n, len(after)))
        x, y = text[head:][::-1], after[head:][::-1]
        tail = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        out.append((key, n, hashlib.sha256(edited.encode()).hexdigest(), *prints[:2], fp.likeness(prints[0], prints[1]), fp.likeness(prints[0], prints[2]), head, tail))
    return sorted(out, key=str)


ROWS = [
    (5, "abcdefgh"), (9, None), (7, "ñandú 😀 tú"), (1, ""), (3, "abcdefgh"), (2, "x"), (11, "word " * 3000), (12, "word " * 2999 + "end"),
    (None, "without a key"), (20, "same"), (20, "same"), (20, "other"),
]


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_matches_brute_force(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame([(k, t, "x", 1) for k, t in ROWS], "doc_id bigint, text string, _pid string, fingerprint int")
        got = fp.fingerprint_documents(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted([tuple(r) for r in got], key=str) == brute(ROWS)
    by_key = {r.doc_id: r for r in got}
    assert by_key[12].near_next > 0.8 and by_key[5].near_edited >= 0.4
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = fp.fingerprint_documents(docs).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)
    assert np.mean([r.near_edited for r in got]) > 0.4 > np.mean([r.near_next for r in got])


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")
    row = fp.fingerprint_documents(one).collect()[0]
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
    assert fp.fingerprint_documents(one.limit(0)).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab😀", max_size=40), st.text(alphabet="ab😀", max_size=40), st.integers(0, 40), st.integers(0, 40))
def test_spans_and_extensions(x, y, i, j):
    a, b = fp.Prefixes(x), fp.Prefixes(y)
    i, j = min(i, len(x)), min(j, len(y))
    length = 0
    while i + length < len(x) and j + length < len(y) and x[i + length] == y[j + length]:
        length += 1
    assert fp.common_extension(a, i, b, j) == length
    for n in range(min(len(x) - i, len(y) - j) + 1):
        assert fp.equal_spans(a, i, b, j, n) == (x[i : i + n] == y[j : j + n])
    head, tail = i, j
    assert fp.fingerprint(fp.Joined(a, head, b, tail)) == fp.fingerprint(fp.Prefixes(x[:head] + y[:tail]))
    assert (fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) == 1.0) == (x == y)


def test_edits_inside_and_at_both_ends_leave_a_copy_alike():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10)))
    words = [word() for _ in range(1200)]
    like = lambda x, y: fp.likeness(*(fp.fingerprint(fp.Prefixes(" ".join(t))) for t in (x, y)))
    assert like(words, ["Other", *words[1:-1], "end"]) > 0.9
    changed = list(words)
    for i in rng.sample(range(len(words)), 15):
        changed[i] = word()
    assert like(words, changed) > 0.6
    assert like(words, words[600:] + words[:600]) > 0.9
    assert like(words, [word() for _ in range(1200)]) < 0.1
    assert like(["aaaa"], ["aaaaa"]) < 1.0 and len(fp.fingerprint(fp.Prefixes("ab" * 5000))) < 5000


def plain_likeness(x, y):
    """Common code points in pieces by a multiset of the pieces' texts."""
    from collections import Counter

    if x == y:
        return 1.0
    held = []
    for t in (x, y):
        count = Counter()
        for start, end in zip(*fp.pieces(fp.Prefixes(t))):
            count[t[start:end]] += int(end - start)
        held.append(count)
    return sum(min(n, held[1][p]) for p, n in held[0].items()) / max(len(x), len(y))


def test_likeness_counts_or_estimates_common_pieces():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 10)))
    for size, slack in ((100, 1e-9), (4000, 0.2)):
        for share in (0.1, 0.5, 0.9):
            words = [word() for _ in range(size)]
            cut = int(size * share)
            x, y = " ".join(["start", *words, "stop"]), " ".join([*[word() for _ in range(size - cut)], *words[:cut]])
            assert abs(fp.likeness(fp.fingerprint(fp.Prefixes(x)), fp.fingerprint(fp.Prefixes(y))) - plain_likeness(x, y)) <= slack


def test_fingerprints_are_bounded():
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1_000_000))
    assert len(fp.fingerprint(fp.Prefixes(text))) < 2000 and len(fp.fingerprint(fp.Prefixes("ab" * 500_000))) < 2000
