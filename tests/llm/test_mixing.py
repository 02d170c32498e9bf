import random
import re
from collections import Counter, defaultdict

from tablescope.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, target string, key string"


def targets(rows, weights=(1, 2, 3), repeats=3):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {s: 0 for s in names if not size[s]}, sum(size.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * size[s]]
        if not over:
            return size, fixed | share
        fixed |= {s: repeats * size[s] for s in over}


def run(spark, rows, mix=mixing.Mix()):
    docs = spark.createDataFrame([(k, t, s, "x", "y", "z") for k, t, s in rows], SCHEMA).repartition(3)
    mixed = mixing.mix_blocks(docs, mix)
    return mixed.withColumn("taken", mixing.taken(mixed)).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()


def corpus(seed):
    rng = random.Random(seed)
    names = ["a", "b", "é", "Z", None, "hot", "tiny", ""]
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 200))), rng.choices(names, [3, 3, 1, 1, 1, 20, 0.1, 1])[0]) for i in range(300)]
    return rows + [(900, None, "hot"), (901, "", "no words"), (902, "one", "tiny"), (903, "w " * 30_000, "long one"), (904, " \n\t", None)]


def test_targets_and_limits(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        size, target = targets(rows)
        by_source = defaultdict(int)
        for r in run(spark, rows):
            assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
            assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.parts)
            assert all(0 <= p["first"] and 0 < p.words and p["first"] + p.words <= r.size and 0 <= p.shard < 8 for p in r.parts)
            by_source[r.source] += r.taken
        assert all(abs(by_source[s] - target[s]) <= 32 for s in target)
        assert abs(sum(target.values()) - sum(size.values())) < 1e-3


def test_quotas_are_the_highest_quotients(spark):
    rows = corpus(3)
    mix = mixing.Mix(block=50, shards=4)
    sources = mixing.quotas(mixing.targets(mixing.sizes(spark.createDataFrame([(k, t, s, "x", "y", "z") for k, t, s in rows], SCHEMA), mix, "doc_id", "text", "source"), mix), mix).collect()
    parts = defaultdict(Counter)
    for r in run(spark, rows, mix):
        for p in r.parts:
            parts[r.source][p.seat] = p.shard
    for s in sources:
        # Seats of quotient t / (2k - 1) at or above half a block, t in blocks.
        t = s.target * s.blocks / s.source_size if s.source_size else 0
        assert s.seats == sum(1 for k in range(1, 3 * s.blocks + 2) if t / (2 * k - 1) >= 0.5)
        assert sum(s.quota) == s.seats and (not s.quota or max(s.quota) - min(s.quota) <= 1)
        assert sorted(parts[s.source]) == list(range(s.seats))
        assert [sum(1 for x in parts[s.source].values() if x == j) for j in range(4)] == list(s.quota)


def test_reruns_copies_and_empty_tables(spark):
    rows = corpus(4)
    show = lambda found: sorted((r.doc_id, r.size, r.taken) for r in found)
    assert show(run(spark, rows)) == show(run(spark, rows[::-1]))
    assert show(run(spark, rows)) != show(run(spark, rows, mixing.Mix(seed=5)))
    assert run(spark, []) == []
    twice = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", "s"), (None, None, None)]
    mixed = mixing.mix_blocks(spark.createDataFrame(twice, "doc_id bigint, text string, source string"))
    assert sorted((r.doc_id or 0, r.size) for r in mixed.collect()) == [(0, 0), (0, 1), (1, 3), (1, 3)]
    assert mixed.select(mixing.taken(mixed).alias("t")).agg({"t": "sum"}).first()[0] == 7
