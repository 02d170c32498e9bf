import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tablescope.llm import language, queries

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op9_string_kernel_language"](spark, FOLDER).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_hard_rows(spark):
    train = [(i, ("the cat and the dog " * 5, "el gato y el perro " * 5)[i % 2], ("en", "es")[i % 2]) for i in range(40)]
    hard = [(100, None, "en"), (101, "", "en"), (102, "12 !? \n", None), (None, "the cat", "zz"), (103, "el perro " * 20000, None), (104, "the dog", None), (104, "the dog", None)]
    docs = spark.createDataFrame([(*r, "extra") for r in train + hard], "doc_id bigint, text string, lang string, _key string")
    got = {}
    for r in language.identify(docs, F.coalesce(F.col("doc_id") < 100, F.lit(False))).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got[100] == got[101] == got[102] == [("und", 0.0)]
    assert got[103][0][0] == "es" and got[None][0][0] == "en" and len(got[104]) == 2 and got[104][0] == got[104][1]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in language.identify(docs, F.lit(True)).collect()] == [(1, "und", 0.0)]
    assert language.identify(docs.limit(0), F.lit(True)).collect() == []


def test_against_plain_kernel_ridge():
    """Kernel by sets, Nystroem features and weighted ridge regression written out, with hashes that do not collide here."""
    rng = random.Random(3)
    settings = language.Settings(per_label=20, landmarks=24)
    alphabets = {"en": "abcdefgh ", "el": "αβγδεζη ", "ja": "日本語東京都 "}
    train = [("".join(rng.choices(letters, k=rng.randrange(20, 200))), label) for label, letters in alphabets.items() for _ in range(20)]
    tests = ["".join(rng.choices(alphabets[l] + alphabets["en"], k=60)) for l in "en el ja".split() for _ in range(8)]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    k = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    sets, labels = [grams(t) for t, _ in train], [l for _, l in train]
    names = sorted(alphabets)
    turns = [[i for i, l in enumerate(labels) if l == m] for m in names]
    marks = [t[r] for r in range(20) for t in turns][:24]
    values, vectors = np.linalg.eigh(np.array([[k(sets[i], sets[j]) for j in marks] for i in marks]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.array([[k(s, sets[j]) for j in marks] for s in sets]) @ root
    y = np.array([[1.0 if l == m else -1.0 for m in names] for l in labels])
    bias = y.mean(0)
    weights = np.linalg.solve(z.T @ z + settings.ridge * len(sets) * np.eye(z.shape[1]), z.T @ (y - bias))
    want = np.array([[k(grams(t), sets[j]) for j in marks] for t in tests]) @ root @ weights + bias
    model = language.Model([np.flatnonzero(language.presence(t, settings)) for t, _ in train], labels, settings)
    assert np.abs(model.margins(tests) - want).max() < 0.02
    assert [names[i] for i in want.argmax(1)] == model.predict(tests)[0]


def test_long_texts_of_large_alphabets_stay_apart():
    rng = random.Random(4)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(30_000))
    assert language.presence(text, language.Settings()).mean() < 0.35
