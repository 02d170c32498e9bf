import zlib

import pytest

from tablescope.llm import queries, shards


def brute(rows, n):
    """Rows (doc_id, text) -> (doc_id, size, crc, shard, slot)."""
    data = lambda t: (t or "").encode()
    order = sorted(((k is not None, k, len(data(t)) + 1, zlib.crc32(data(t))) for k, t in rows))
    total, before, slots, out = sum(r[2] for r in order), 0, {}, []
    for _, key, size, crc in order:
        shard = (2 * before + size) * n // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((key, size, crc, shard, slots[shard]))
        before += size
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 3, 8])
def test_small(spark, n):
    rows = [(i * 7 % 50, "é" * (i % 11)) for i in range(50)] + [(None, None), (60, ""), (61, "long " * 5000), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id bigint, text string, shard int, _part int")
    got = shards.shard_by_bytes(docs, n)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, n)
    assert shards.shard_by_bytes(docs.limit(0), n).collect() == []


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = queries.QUERIES["op3_byte_shards"](spark, folder).collect()
    assert sorted([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got], key=str) == brute(rows, 8)
    sums = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sums) - min(sums) <= 2 * max(r.size for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_plan_is_native_and_has_no_cross_join(spark):
    plan = queries.QUERIES["op3_byte_shards"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))
