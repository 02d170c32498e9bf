import random
import zlib

import numpy as np
import pytest

from tablescope.llm import merge_dropout as md
from tablescope.llm import queries

TEXTS = ["", "a", " ", "  two  spaces ", "line\nbreaks\n\n\tand tabs\r\n", "Eauouon. é ê ñ ü ß", "▁literal▁ ▁", "😀 中文 \x00 \x7f", "<s> <unk> <0x0A>", "x" * 300, "   " * 60, "the " * 2000, "internationalisation " * 3 + "zzz"]


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=md.default_path())


def random_texts(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(["th", "er", "in", " ", " ", "\n", "a", "é", "中", "😀", "qu", "Z", "9", ".", "▁", "ation"]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_without_dropout_it_is_sentencepiece(processor):
    coder = md.Dropout(0.0)
    for text in TEXTS + random_texts(400):
        ids = coder.encode([text], [1])[0].tolist()
        if md.META not in text:
            assert ids == processor.encode(text), repr(text)
        assert coder.decode(np.array(ids, np.int64)) == text
        assert processor.decode(ids) == text or md.META in text


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_arrays_and_heap_agree_and_decode(rate, processor, monkeypatch):
    coder = md.Dropout(rate, 5)
    texts = TEXTS + random_texts(150)
    keys = list(range(-5, len(texts) - 5))
    fast = coder.encode(texts, keys)
    monkeypatch.setattr(md, "SIDE_BY_SIDE", 0)
    slow = coder.encode(texts, keys)
    for text, a, b in zip(texts, fast, slow):
        assert a.tolist() == b.tolist(), repr(text)
        assert coder.decode(a) == text
        assert processor.decode(a.tolist()) == text or md.META in text


def test_seeds_and_keys_vary_the_segmentation():
    text = "international communication of the organisation " * 20
    one, two = md.Dropout(0.2, 1), md.Dropout(0.2, 2)
    a, b, c = one.encode([text], [1])[0], one.encode([text], [2])[0], two.encode([text], [1])[0]
    plain = md.Dropout(0.0).encode([text], [1])[0]
    assert a.tolist() != b.tolist() and a.tolist() != c.tolist() and len(a) > len(plain)
    assert a.tolist() == one.encode([text], [1])[0].tolist()


def brute(text, key, rate, seed):
    """The agenda by plain search: best piece, then leftmost, skipped candidates never."""
    coder = md.Dropout(rate, seed)
    ids = []
    for place, chunk in enumerate(md.CHUNK.findall(" " + text) if text else []):
        word = np.uint64((key + place * int(md.A2)) & md.WORD)
        symbols = [(int(coder.model.char[ord(c)]), i, i + 1) for i, c in enumerate(chunk)]
        while True:
            found = []
            for i, (x, y) in enumerate(zip(symbols, symbols[1:])):
                rank = coder.model.pairs.get(x[0] << 32 | y[0])
                if rank is not None and not coder.skips(word, *(np.array([v]) for v in (x[1], y[1], y[2], rank)))[0]:
                    found.append((rank, i, int(coder.model.by_rank[rank])))
            if not found:
                break
            _, i, piece = min(found)
            symbols[i : i + 2] = [(piece, symbols[i][1], symbols[i + 1][2])]
        ids += coder.model.spelled(np.array([s[0] for s in symbols], np.int64)).tolist()
    return ids


def test_against_plain_search():
    for number, text in enumerate(random_texts(25, 8)):
        assert md.Dropout(0.3, 9).encode([text], [number])[0].tolist() == brute(text, number, 0.3, 9)


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null key"), (100, None), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, ids string, _seed int")
    got = md.encode_documents(docs, 0.2, 3, at_once=50)
    assert all(r.lossless and r.n_ids == len(r.ids or []) for r in got.collect())
    assert sorted(map(tuple, md.decode_documents(got).collect()), key=str) == sorted(rows, key=str)
    assert md.encode_documents(docs.limit(0)).collect() == []


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op6_merge_dropout"](spark, folder).collect()}
    keys = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    coder = md.Dropout(0.1, 20240101)
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and all(r.lossless for r in got.values())
    for r in rows[:40]:
        ids = coder.encode([r.text], [keys[r.doc_id]])[0]
        assert (got[r.doc_id].n_ids, got[r.doc_id].ids_crc32, got[r.doc_id].ids) == (len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
    frame = queries.QUERIES["op6_merge_dropout"](spark, folder)
    assert {r.doc_id: r.text for r in md.decode_documents(frame).collect()} == {r.doc_id: r.text for r in rows}


def test_words_that_begin_alike_are_drawn_apart():
    coder, alike = md.Dropout(0.3, 4), 0
    for key in range(300):
        pieces = [coder.model.bytes_of[i] for i in coder.encode(["international internationally"], [key])[0].tolist()]
        at = next(i for i, p in enumerate(pieces) if i and p.startswith(b" "))
        first, second = b"|".join(pieces[:at]), b"|".join(pieces[at:])
        alike += second.startswith(first)
    assert alike < 75


@pytest.mark.parametrize("word", ["international", "x" * 30 + "communication" * 4])
def test_repeats_of_a_word_are_drawn_anew(word):
    coder = md.Dropout(0.3, 4)
    ids = coder.encode([f"{word} " * 200], [7])[0]
    words, at = set(), 0
    text = coder.decode(ids)
    assert text == f"{word} " * 200
    pieces = [coder.model.bytes_of[i] for i in ids.tolist()]
    for i, piece in enumerate(pieces):
        if i and piece.startswith(b" "):
            words.add(tuple(pieces[at:i]))
            at = i
    assert len(words) > 20
    assert ids.tolist() == coder.encode(["other words", f"{word} " * 200], [1, 7])[1].tolist()
