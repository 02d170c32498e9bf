import math
import random

import test_jaccard
import test_line_templates
import test_quality
from test_packing import check_layout

import corpus_pipeline
from tablescope.llm import entropy, line_templates, tokens
from tablescope.llm.common import written


def fixture_rows():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tur", "esh") for b in ("no", "rel", "sid", "va", "pim", "qu", "zo")]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=rng.randrange(6, 14))) for _ in range(n))
    rows = [[i, text(rng.randrange(6, 20))] for i in range(60)]
    for i in range(60, 90):
        copy = rows[rng.randrange(20)][1]
        rows.append([i, copy if i % 2 else copy.replace("kano", "esh", 1)])
    for i in range(0, 60, 4):
        rows[i][1] += f"\nPosted on 2024-01-{i:02d} by user{i}"
    for i in range(1, 60, 7):
        rows[i][1] += '\ntoken = "' + f"{i:02x}" * 16 + '" in use'
    rows += [[100, None], [101, ""], [102, "short text"], [103, "spam spam spam " * 40], [104, rows[3][1]], [105, text(900)]]
    return [(k, t, "en", "src0", 0 if t is None else len(t)) for k, t in rows]


def test_stages_match_brute_force(spark):
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "nowhere"), "stage")
        kept[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns and all(r.text is None or len(r.text) == r.n_chars for r in kept[name])
    want = {k: t for k, t, *_ in rows if test_quality.brute(t)[6]}
    assert {r.doc_id: r.text for r in kept["quality rules"]} == want and 103 not in want and len(want) > 60
    lines = test_line_templates.brute(list(want.items()), line_templates.Tree())
    want = {k: lines[k, t] for k, t in want.items()}
    assert {r.doc_id: r.text for r in kept["line dedup"]} == want
    groups = test_jaccard.brute(list(want.items()), 5, 80)
    want = {k: want[k] for k, n, component in groups if not n or component == k}
    assert {r.doc_id: r.text for r in kept["n-gram Jaccard join"]} == want and len(want) < len(groups)
    scanner = entropy.Scanner()
    want = {k: scanner.redacted(t) for k, t in want.items()}
    assert {r.doc_id: r.text for r in kept["secret scans"]} == want and any("<secret>" in t for t in want.values())
    packed, encoder = kept["best-fit packing"], tokens.Encoder()
    sizes = {k: len(encoder.encode(t)) + 1 for k, t in want.items()}
    for key, size in sizes.items():
        assert sum(r.length for r in packed if r.doc_id == key) == size
    assert {r.doc_id for r in packed} == sizes.keys()
    assert check_layout(packed, 2048) <= math.ceil(sum(sizes.values()) / 2048) + 1


def test_run_is_the_stages_in_order(spark):
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(packed.columns) and packed.count() > 100


def test_empty_tables_null_keys_and_repeated_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_crc32 string"
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), "nowhere").collect() == []
    rng = random.Random(2)
    good = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(80)) + "."
    rows = [(None, good, "en", "s", len(good), "x"), (None, None, None, None, None, "y"), (7, good + " end", "en", "s", len(good) + 4, "z"), (7, good + " end", "en", "s", len(good) + 4, "z")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "nowhere"), "stage")
        if name == "n-gram Jaccard join":
            assert [(r.doc_id, r.text) for r in docs.collect()] == [(7, good + " end")]
    assert [(r.doc_id, r.piece) for r in docs.collect()] == [(7, 0)]


def test_texts_travel_in_small_batches(spark, tmp_path, monkeypatch):
    texts = [("x" * 100_000,) for _ in range(200)]
    spark.createDataFrame(texts, "text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", lambda spark, docs, folder: docs.mapInArrow(sizes, "size bigint"))])
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    found = [r["size"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(found) >= 200 * 100_000 and max(found) < 6 << 20 and spark.conf.get(name) == before


def test_stages_called_one_by_one_get_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text", "'en' AS lang", "'s' AS source", "100000L AS n_chars").coalesce(1)

    def sizes(docs, *_):
        def work(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["size"])

        return docs.mapInArrow(work, "size bigint")

    monkeypatch.setattr(corpus_pipeline.quality, "keep_good", sizes)
    monkeypatch.setattr(corpus_pipeline.entropy, "redact_documents", sizes)
    monkeypatch.setattr(corpus_pipeline.packing, "pack_documents", sizes)
    before = spark.conf.get(name)
    try:
        for stage in (corpus_pipeline.quality_rules, corpus_pipeline.secret_scans, corpus_pipeline.best_fit_packing):
            spark.conf.set(name, before)
            found = [r["size"] for r in stage(spark, docs, "nowhere").collect()]
            assert sum(found) >= 200 * 100_000 and max(found) < 6 << 20
    finally:
        spark.conf.set(name, before)
