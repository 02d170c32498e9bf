import random
import re
from collections import defaultdict

import pytest

from tablescope.llm import line_templates, queries

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, tree):
    """Rows (key, text): -> {(key, text): kept text}."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    lines = []
    for key, text in docs:
        for i, raw in enumerate(text.split("\n") if text is not None else []):
            plain = tuple(TOKEN.findall(raw))
            tokens = tuple("<*>" if re.search("[0-9]", t) else t for t in plain)
            words = [t for t in tokens if t != "<*>"]
            if tokens:
                lines.append(((key, text), i, (len(tokens), tokens[: tree.depth]), tokens, plain if 2 * len(words) < len(tokens) else None))
    reach, shapes = defaultdict(set), defaultdict(set)
    for doc, _, leaf, tokens, equal in lines:
        reach[leaf].add(doc)
        if equal is None:
            shapes[leaf, tokens].add(doc)
    support = defaultdict(int)
    for (leaf, tokens), found in shapes.items():
        for at, token in enumerate(tokens):
            support[leaf, at, token] += len(found)
    templates = defaultdict(list)
    for doc, i, leaf, tokens, equal in lines:
        if len(reach[leaf]) < tree.documents:
            continue
        if equal is not None:
            templates[leaf, equal].append((doc, i))
            continue
        enough = lambda at, t: support[leaf, at, t] >= tree.documents and 100 * support[leaf, at, t] >= tree.share * len(reach[leaf])  # noqa: B023, E731
        held = [(at, t) for at, t in enumerate(tokens) if at >= tree.depth and t != "<*>" and enough(at, t)]
        lead, words = (sum(t != "<*>" for t in x) for x in (tokens[: tree.depth], tokens))
        if (lead + len(held)) * 100 >= words * tree.percent:
            templates[leaf, "template", tuple(held)].append((doc, i))
    gone = defaultdict(set)
    for found in templates.values():
        members = {d for d, _ in found}
        if len(members) >= tree.documents:
            first = next(d for d in docs if d in members)
            for d, i in found:
                if d != first:
                    gone[d].add(i)
    return {d: None if d[1] is None else "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone[d]) for d in docs}


@pytest.mark.parametrize("tree", [line_templates.Tree(), line_templates.Tree(2, 2, 60, 30)])
def test_small(spark, tree):
    rng = random.Random(6)
    shared = ["Posted on 2024-01-0{} by user{}", "Copyright (c) {} Some Company , all rights reserved", "Menu", "you may call us on {} at any time {}", "\tTabbed   line {}\r", "{} 7.5 99 201{}", "row {} 1 2", "<*> 1 x", "made by {1} in {0} today"]
    rows = []
    for key in range(60):
        body = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 8))]
        body += [rng.choice(shared).format(rng.randrange(9), rng.choice("xyz")) for _ in range(rng.randrange(3))]
        rng.shuffle(body)
        rows.append((key, "\n".join(body)))
    rows += [(None, "Menu\nown words here"), (70, None), (71, ""), (72, "\n\n \t\n"), (73, "Menu\n" * 3000 + "x" * 50000), (5, "Menu"), (5, "Menu"), (74, rows[3][1])]
    docs = spark.createDataFrame([(k, t, 0 if t is None else len(t), 9, "z") for k, t in rows], "doc_id bigint, text string, n_chars int, n_dropped int, leaf string")
    want = brute(rows, tree)
    got = line_templates.drop_recurring_lines(docs, tree).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(k), str(want[k, t])) for k, t in rows)
    assert all(r.text is None or r.n_chars == len(r.text) for r in got) and got[0].n_dropped == 9
    counted = line_templates.drop_recurring_lines(docs, tree, counts=True).collect()
    assert sum(r.n_dropped for r in counted) > 0 and len(counted) == len(rows)
    assert line_templates.drop_recurring_lines(docs.limit(0), tree).collect() == []


def test_plan_is_native(spark):
    plan = queries.QUERIES["op1_line_templates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_lines_mostly_of_fields_go_only_where_equal(spark):
    rows = [(i, f"{i} {i}.5 9{i} 20{i:02d}\n7 8 9 10\n{i}%\nrow {i} 2 3\nPosted on day{i} by us") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {i: t if i == 0 else "\n".join(t.split("\n")[k] for k in (0, 2, 3)) for i, t in rows}
    assert {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs).collect()} == want


def test_variable_words_stay_variable_in_large_corpora(spark):
    names = ["Ann", "Bob", "Cid", "Dee", "Eve", "Fay", "Gus", "Hal", "Ida", "Jon", "Kim", "Lou"]
    for size in (12, 600):
        own = lambda i: "note " + "".join(chr(97 + int(c)) for c in str(i))
        rows = [(i, f"{own(i)}\nWritten for you here by the great {names[i % 12]}") for i in range(size)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        kept = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(docs).collect()}
        assert kept == {i: t if i == 0 else t.split("\n")[0] for i, t in rows}
