"""The filter audit against counting each order on its own; the decision diagram; odd rows."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest

from codeloom.llm import filter_audit

LETTERS = "ABCDE"
DOC = "doc_id long, text string, lang string"
LABEL = "doc_id long, quality int, toxic int"


def mask_by_hand(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
             bool(re.search("[#$%&*|]", text)))
    return sum(f << i for i, f in enumerate(fails))


def audit_by_hand(docs, labels):
    """Rows of the audit of (id, text, lang) by walking every document through every order."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    known = []
    for i, text, lang in docs:
        copy = i is not None and i > smallest[text or ""]
        known.append((lang or "", mask_by_hand(text or "") + 16 * copy, i in good, i in toxic))
    out = {}
    for part in {k[0] for k in known}:
        mine = [k[1:] for k in known if k[0] == part]
        shapley = Counter()
        for order in itertools.permutations(LETTERS):
            left, gone = list(mine), []
            for step, letter in enumerate(order, 1):
                bit = 1 << LETTERS.index(letter)
                removed = [d for d in left if d[0] & bit]
                left = [d for d in left if not d[0] & bit]
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(1 for d in gone if d[0] & bit), sum(1 for d in mine if d[0] == bit),
                    sum(d[1] for d in removed), sum(d[2] for d in removed)]
                gone += removed
                shapley[letter] += len(removed)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {key: tuple(row) for key, row in out.items()}


def run(spark, docs, labels):
    found = filter_audit.audit_filters(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)).collect()
    rows = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found}
    assert len(rows) == len(found)
    return rows


def documents(n: int, seed: int):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        words = [rng.choice("ab") + str(rng.randrange(rng.choice([60, 4000]))) for _ in range(rng.choice([5, 98, 100, 130, 400]))]
        if rng.random() < 0.3:
            words = [w.upper() + "XYZ" for w in words]
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), rng.choice("#$%&*|"))
        docs.append((i, rng.choice([" ", "\n", "\t\x0b", "  "]).join(words), rng.choice(["en", "de", None, ""])))
        if rng.random() < 0.3:
            docs.append((1000 + i, docs[rng.randrange(len(docs))][1], rng.choice(["en", "de"])))
    return docs


def test_random_documents(spark):
    docs = documents(60, 1)
    labels = [(i, i % 3 and 1, i % 5 == 0 and 1 or 0) for i, _, _ in docs[::2]]
    assert run(spark, docs, labels) == audit_by_hand(docs, labels)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    docs = [(None, None, None), (None, "", "en"), (5, "", None), (5, "", "en"), (4, None, "en"), (7, long, "en"), (8, long, "en"),
            (8, long, "en"), (9, "# one", ""), (-3, "# one", "x"), (None, "# one", "x"), (10, "  " * 60, "x")]
    labels = [(None, 1, 1), (8, 1, None), (8, 0, 1), (5, None, None), (77, 1, 1), (-3, 1, 0)]
    assert run(spark, docs, labels) == audit_by_hand(docs, labels)


@pytest.mark.parametrize("docs", [[], [(1, "a", "en")]])
def test_few_rows(spark, docs):
    assert run(spark, docs, []) == audit_by_hand(docs, [])


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one # two", "en", 3, "p", "d", 1, 1)], DOC + ", mask int, part string, digest string, n int, First int")
    labels = spark.createDataFrame([(1, 1, 1, 9, "x")], LABEL + ", spread int, good string")
    found = filter_audit.audit_filters(docs, labels).collect()
    assert len(found) == 600 and {r.part for r in found} == {"en"}
    assert {(r.good_lost, r.toxic_lost) for r in found if r.removed} == {(1, 1)}


def test_other_names_and_filters(spark):
    docs = spark.createDataFrame([("a", "xx", 1), ("b", "xx", 1), ("c", "yyy", 2)], "key string, body string, shard int")
    labels = spark.createDataFrame([("b", 1, 0)], "key string, quality int, toxic int")
    found = filter_audit.audit_filters(
        docs, labels, "key", "body", "shard", {"L": lambda text: text.contains("y")}, "C").collect()
    assert {(r.part, r.filter_order, r.step, r.kept, r.removed, r.good_lost) for r in found} == {
        ("1", "LC", 1, 2, 0, 0), ("1", "LC", 2, 1, 1, 1), ("1", "CL", 1, 1, 1, 1), ("1", "CL", 2, 1, 0, 0),
        ("2", "LC", 1, 0, 1, 0), ("2", "LC", 2, 0, 0, 0), ("2", "CL", 1, 1, 0, 0), ("2", "CL", 2, 0, 1, 0)}


def test_swaps_reach_every_order():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for at in filter_audit.level_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))


def test_swapped_diagram_equals_one_built_in_that_order():
    rng = random.Random(4)
    counts = {mask: (rng.randrange(1, 5), rng.randrange(3)) for mask in rng.sample(range(32), 14)}
    diagram = filter_audit.Diagram(LETTERS, counts, 2)
    whole = diagram.weight[diagram.root]
    for at in filter_audit.level_swaps(5):
        diagram.swap(at)
        order = "".join(diagram.order)
        moved = {sum(1 << order.index(x) for i, x in enumerate(LETTERS) if mask >> i & 1): c for mask, c in counts.items()}
        fresh = filter_audit.Diagram(order, moved, 2)
        assert list(diagram.steps()) == list(fresh.steps())
        assert [len(level) for level in diagram.levels] == [len(level) for level in fresh.levels]
        assert diagram.weight[diagram.root] == whole


def test_equal_nodes_are_one():
    everywhere = filter_audit.Diagram(LETTERS, {mask: (1,) for mask in range(32)}, 1)
    assert [len(level) for level in everywhere.levels] == [1] * 5
