import random
import re
from collections import Counter, defaultdict

import pytest

from tablescope.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n string, a string, route string"


def brute(rows, least, inside=80, top=2000):
    pieces = defaultdict(list)
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        pieces["und" if lang is None else lang] += [re.findall(r"[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", text)]
    out = []
    for lang, found in pieces.items():
        f = Counter(tuple(p[i : i + k]) for p in found for k in range(1, 5) for i in range(len(p) - k + 1))
        n = sum(map(len, found))
        often = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        scored = []
        for g, a in often.items():
            if any(len(h) > len(g) and 100 * c >= inside * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, c in often.items()):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def run(spark, rows, **kwargs):
    docs = spark.createDataFrame([(i, t, l, "x", "y", "z", "r") for i, (t, l) in enumerate(rows)], SCHEMA).repartition(5)
    got = collocations.phrases(docs, collocations.Phrases(**kwargs))
    return sorted(map(tuple, got.collect()))


def corpus(seed, size=300):
    rng = random.Random(seed)
    words = ["of", "the", "New", "york", "new", "été", "ÉTÉ", "\x01", "a\x01b", "日本", "x", "y", "rare" + "1"]
    fixed = ["all rights reserved by us", "new york city", "of the", "ha ha ha ha ha ha", "of the people"]
    rows = []
    for i in range(size):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 5))) + f" id{rng.randint(0, 500)}" for _ in range(rng.randint(0, 12))]
        rows.append((rng.choice([" ", "\t", "  "]).join(parts).replace("z", ".") + rng.choice(["", ".", "\n", " , "]), rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), (" . ,\t", "fr"), rows[0], rows[0], ("of the people . " * 20_000 + "of " * 3000, "long")]


@pytest.mark.parametrize("seed,least,bits", [(1, 30, 24), (2, 5, 16), (3, 2, 17), (4, 300, 20)])
def test_against_brute_force(spark, seed, least, bits):
    rows = corpus(seed)
    assert run(spark, rows, least=least, sketch_bits=bits) == brute(rows, least)


def test_small_sketch_and_parts_change_nothing(spark, monkeypatch):
    rows = corpus(6, 80)
    monkeypatch.setattr(collocations, "AT_ONCE", 100)
    monkeypatch.setattr(collocations, "CHUNK", 64)
    assert run(spark, rows, least=4, sketch_bits=8, top=7, inside=50) == brute(rows, 4, 50, 7)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("one two", "en")]) == []


def test_paths_stand_for_their_nodes(spark):
    docs = spark.createDataFrame([("en", "all rights reserved here")] * 40 + [("en", "all wrong")] * 3 + [("en", f"a{i} b{i}") for i in range(3000)], "lang string, text string")
    rules = collocations.Phrases(least=30)
    rows = collocations._flows(collocations._edges(docs, rules), rules).where("size > 1").collect()
    # One edge leaves the nodes "all rights" and "all rights reserved", so one row stands for all three.
    assert [tuple(r) for r in rows if r.phrase.startswith("all")] == [("en", "all rights reserved here", 4, 2, 40)]
