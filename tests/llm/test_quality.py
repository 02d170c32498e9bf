import random
import re
from collections import Counter

from tablescope.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    repeat = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_repeat, n = len(repeat), len(words)
    shares = []
    chars = sum(map(len, words))
    for size, _ in quality.Limits().ngrams:
        grams = [tuple(words[i : i + size]) for i in range(n - size + 1)]
        count = Counter(grams)
        inside = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(size)}
        shares.append(sum(len(words[i]) for i in inside) / chars if chars else 0.0)
    failed = n < 50 or 100 * n_repeat > 50 * n
    dup = sum(sum(map(len, WORD.findall(x))) for i, x in enumerate(lines) if x in lines[:i])
    kept = not failed and dup <= 0.30 * chars and all(s <= m for s, (_, m) in zip(shares, quality.Limits().ngrams))
    return n, chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n_repeat, failed, kept, shares


def check(text):
    got, want = quality.measure(text), brute(text)
    assert (*got[:5], got[7], got[8], got[6]) == want


def test_small_texts():
    rng = random.Random(1)
    for text in [None, "", " \n\t", "one", "a b\na b\n\na b", "é ü x \x1f y", "#*$%&|<>" * 3, "x " * 5000, "same line of words here\n" * 40]:
        check(text)
    for _ in range(200):
        check("".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "\x0b", "|"]) for _ in range(rng.randrange(300))))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op2_quality_rules"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.ngram_shares) == brute(texts[r.doc_id])


def test_rows_that_pass_keep_every_column(spark):
    good = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, 5), (2, "short", 6), (None, good, None), (3, None, 7), (1, good, 5)], "doc_id bigint, text string, n_words int")
    assert sorted(map(tuple, quality.keep_good(docs).collect()), key=str) == sorted([(1, good, 5), (1, good, 5), (None, good, None)], key=str)
    assert quality.keep_good(docs.limit(0)).collect() == [] and quality.measures(docs.limit(0)).collect() == []
    assert [r.doc_id for r in quality.measures(docs.where("doc_id IS NULL OR doc_id > 1")).collect()].count(None) == 1
