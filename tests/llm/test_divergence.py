import random
import re
from collections import Counter, defaultdict

import numpy as np

from tablescope.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n string, value string"


def brute(rows, least=3, top=200):
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        has, count, sources = Counter(), defaultdict(Counter), sorted({s for l, s, _ in docs if l == lang})
        for l, s, terms in docs:
            if l == lang:
                has.update(set(terms))
                count[s].update(terms)
        kept = [t for t, n in has.items() if n >= least]
        whole = Counter({t: sum(count[s][t] for s in sources) for t in kept})

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        for s in sources:
            pairs = [(sum(f(p(count[s], t), p(count[o], t)) for t in kept), o) for o in sources if o != s]
            terms = [(f(p(count[s], t), p(whole, t)), t) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, found, most in (("pair", pairs, 10**9), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def run(spark, rows, **kwargs):
    docs = spark.createDataFrame([(i, t, l, s, "x", "y", "z") for i, (t, l, s) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(map(tuple, divergence.divergences(docs, divergence.Audit(**kwargs)).collect()))


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = ["ab", "Ba", "été", "ÉTÉ", "x", "y", "zz", "q", "日本", "the", "The"]
    weights = [1, 2, 3, 1, 1, 1, 1, 1, 1, 30, 9]
    rows = [(" ".join(rng.choices(words, weights, k=rng.randint(0, 30))).replace(" ", rng.choice([" ", "_1", "\n", "\x7f"])), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(120)]
    rows += [(None, "en", "only nulls"), ("", "xx", "alone"), ("a b c", "yy", "p"), ("d", "yy", "q"), rows[0], rows[0], ("the " * 50_000, "en", "a")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, documents=1, top=2) == brute(rows, 1, 2)


def test_blocks_parts_and_empty_tables(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(rng.choices("abcdefghij", k=8)), "en", f"s{rng.randint(0, 12)}") for _ in range(60)]
    assert run(spark, []) == []
    import tablescope.llm.divergence as module

    monkeypatch.setattr(module, "ROWS", 10)
    monkeypatch.setattr(module, "CELLS", 20)
    monkeypatch.setattr(module, "AT_ONCE", 30)
    monkeypatch.setattr(module, "KEPT", 20)
    assert run(spark, rows, top=3) == brute(rows, top=3)


def test_shares_beyond_64_bits():
    count, words, terms = 10**13, 4 * 10**13, 10**8
    assert divergence.share(np.array([count]), np.array([words]), np.array([terms]))[0] == 1 + 10**9 * (count + 1) // (words + terms)
