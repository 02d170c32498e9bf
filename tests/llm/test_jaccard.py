import random
import re

import numpy as np
import pytest

from tablescope.llm import jaccard
from tablescope.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, words, percent):
    """Rows (key, text) -> sorted (key, set size, component)."""
    sets = [shingle_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return sorted(((key, len(sets[i]), least.get(root(i))) for i, (key, _) in enumerate(rows)), key=str)


def corpus(seed, n=260):
    """Texts of all sizes, with chains of small changes, a star of near copies around one text, copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(n // 4):
        texts.append(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 200, 400])) + (passage if rng.random() < 0.3 else []))
    base = rng.choices(vocabulary, k=150)
    texts.append(base)
    while len(texts) < n:
        words = list(base if rng.random() < 0.4 else rng.choice(texts))
        for _ in range(rng.randrange(0, max(2, len(words) // 25))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(words[rng.randrange(0, 3) :] or words)
    rows = [(i * 3, " ".join(t) if i % 2 else "\n".join(t).upper()) for i, t in enumerate(texts)]
    return rows + [(None, "null key " * 3), (None, rows[0][1]), (1, None), (2, ""), (4, " \t\n"), (5, "x " * 3000), (8, "x " * 2000), (9, rows[3][1])]


@pytest.mark.parametrize("words,percent,block", [(3, 90, 512), (5, 80, 512), (3, 80, 8), (2, 95, 512)])
def test_groups_match_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(words * 1000 + percent)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, n int, root int")
    found, links = jaccard.groups(docs, jaccard.Join(words, percent))
    assert sorted([(r.key, r.n, r.component) for r in found.collect()], key=str) == brute(rows, words, percent)
    assert links.count() > 0


def test_parts_never_miss_a_linked_pair():
    rng = np.random.default_rng(5)
    for join in (jaccard.Join(3, 90), jaccard.Join(5, 80), jaccard.Join(5, 80, 2.0)):
        for _ in range(300):
            a = int(rng.integers(1, 700))
            lost = int(rng.integers(0, a // 5 + 1))
            new = int(rng.integers(0, a // 5 + 1))
            x = np.unique(rng.integers(0, 2**64, a, np.uint64))
            y = np.unique(np.concatenate([x[lost:], rng.integers(0, 2**64, new, np.uint64)]))
            common = len(np.intersect1d(x, y))
            if common and 100 * common >= join.percent * (len(x) + len(y) - common):
                assert set(join.signatures(x)) & set(join.signatures(y))
                bits = [np.frombuffer(jaccard.bitmap(s), np.uint64) for s in (x, y)]
                assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(x) + len(y) - 2 * common


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text, "a"), (3, text + " end", "b"), (3, text + " end", "b"), (9, text, "c"), (9, text, "c"), (5, None, "d"), (6, "", "e"), (None, text, "f"), (1, "quite another text", "g")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, content string")
    assert sorted(map(tuple, jaccard.keep_one(docs).collect()), key=str) == sorted([(3, text + " end", "b"), (5, None, "d"), (6, "", "e"), (1, "quite another text", "g")], key=str)
    assert jaccard.keep_one(docs.limit(0)).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(160, 159), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 161)}}


def test_every_link_is_counted(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(base[:i] + ["new", *base[i + 1 :]]) for i in rng.sample(range(120), 12)]
    rows = list(enumerate([*near, near[0], near[0], *(" ".join(rng.choices(base, k=90)) for _ in range(20)), "", None, "one"]))
    join = jaccard.Join(3, 90)
    sets = [shingle_set(t, 3) for _, t in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)
    want = [(k, sum(linked(a, b) for j, b in enumerate(sets) if j != k)) for (k, _), a in zip(rows, sets)]
    found, links = jaccard.link_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), join)
    assert sorted((r.key, r.n_links) for r in found.collect()) == want and max(n for _, n in want) == 13
    assert links.distinct().count() == links.count() == 66


@pytest.mark.parametrize("bits", [16, 28])
def test_the_filter_lets_all_its_words_pass(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
    rng = np.random.default_rng(7)
    words = rng.integers(-(2**63), 2**63, 20_000)
    found = jaccard._filter(spark.createDataFrame([(int(w),) for w in words], "word bigint"))
    assert found.may_hold(words).all() and found.size <= bits
    passed = found.may_hold(rng.integers(-(2**63), 2**63, 20_000)).mean()
    assert passed < 0.1 if bits == 28 else passed < 0.4
    assert not jaccard._filter(spark.createDataFrame([], "word bigint")).may_hold(words).any()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, n int")
    for work in (jaccard.groups, jaccard.link_counts):
        rows, links = work(docs)
        assert rows.collect() == [] and links.collect() == []


def test_wide_bitmaps_bound_the_difference_of_long_sets():
    rng = np.random.default_rng(11)
    join = jaccard.Join(5, 80)
    for size in (1, 300, 2047, 2049, 9000):
        for share in (0.5, 0.7, 0.95):
            x = np.unique(rng.integers(0, 2**64, size, np.uint64))
            y = np.unique(np.concatenate([x[: int(len(x) * share)], rng.integers(0, 2**64, int(size * (1.1 - share)), np.uint64)]))
            common = len(np.intersect1d(x, y))
            apart = jaccard.wide_apart(*(np.frombuffer(jaccard.wide_bitmap(s), np.uint64) for s in (x, y)))
            assert apart <= len(x) + len(y) - 2 * common
            assert (apart <= join.differ(len(x), len(y))) == (100 * common >= 80 * (len(x) + len(y) - common)) or size < 2000


def test_long_sets_that_share_a_passage_send_no_arrays(spark, monkeypatch):
    seen = {}
    keep = jaccard.written

    def watched(df, name, *rest, **more):
        out = keep(df, name, *rest, **more)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "written", watched)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(2600)]
    texts = [passage + [f"w{rng.randrange(10**6)}" for _ in range(2400)] for _ in range(6)]
    texts.append([*texts[0][:4990], "end"])
    found, _ = jaccard.groups(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string"), jaccard.Join(5, 80))
    assert {r.key: r.component for r in found.collect()} == {**{i: i for i in range(6)}, 6: 0}
    # The one linked pair sends its two arrays; all others end at their bitmaps.
    assert seen["bounded"] > 1 and seen["arrays"] == 2 and seen["linked"] == 1
