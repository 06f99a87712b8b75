"""Dual-tree search against scoring every pair in Python's integers; odd rows; pruning."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import lexical_search

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def terms_by_hand(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked_by_hand(docs, items, best=20):
    read = [(i, Counter(w), len(w)) for i, w in ((i, terms_by_hand(t)) for i, t in docs) if w]
    total = sum(n for _, _, n in read)
    holding = Counter(t for _, c, _ in read for t in c)
    texts = {}
    for i, t in items:
        texts[i] = max(texts.get(i, ""), t or "")
    out = set()
    for item, text in texts.items():
        scores = []
        for i, c, n in read:
            m = 100 - 25 + 25 * n * len(read) // total
            score = sum(math.floor(1000 * math.log((2 * len(read) + 2) / (2 * holding[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                        for t in terms_by_hand(text) if c[t])
            scores.append((-score, i is None, i))
        out |= {(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scores)[:best], 1) if score < 0}
    return out


def run(spark, docs, items, **options):
    found = lexical_search.ranked_documents(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM), **options).collect()
    assert len(set(map(tuple, found))) == len(found)
    return {tuple(r) for r in found}


def corpus(n_docs: int, n_items: int, seed: int):
    """Documents of three vocabularies with words of very different frequency; items are passages of some of them."""
    rng = random.Random(seed)
    words = [[rng.choice("aeiouäß")[0] + "".join(rng.choices(f"bcdfgh{k}É", k=rng.randint(1, 4))) for _ in range(300)] for k in range(3)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = []
    for i in range(n_docs):
        text = rng.choices(words[i % 3], weights, k=rng.choice([0, 3, 30, 300]))
        docs.append((i, rng.choice([" ", ", ", "\x00-"]).join(w.upper() if rng.random() < 0.2 else w for w in text)))
    items = []
    for i in range(n_items):
        text = docs[rng.randrange(n_docs)][1].split(" ")
        at = rng.randrange(len(text))
        items.append((i, " ".join(text[at:at + 25] + rng.choices(words[i % 3], k=5))))
    return docs, items


@pytest.mark.parametrize("options", [{}, {"best": 3}, {"items_at_once": 4}])
def test_equals_scoring_every_pair(spark, options):
    docs, items = corpus(400, 18, 1)
    got = run(spark, docs, items, **options)
    assert got == ranked_by_hand(docs, items, options.get("best", 20)) and got


def test_ties_and_repeated_rows(spark):
    docs = [(i % 40, "same words here") for i in range(80)] + [(99, "other"), (100, "words Words")]
    items = [(1, "words"), (1, "words"), (2, "SAME here here"), (3, "absent")]
    found = lexical_search.ranked_documents(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    want = {(r.item_id, r.rank): (r.doc_id, r.score) for r in found}
    assert len(want) == len(found) == 40
    assert [want[2, r][0] for r in range(1, 21)] == [i // 2 for i in range(20)]
    assert want[1, 1][0] == 100 and [want[1, r][0] for r in range(2, 21)] == [i // 2 for i in range(19)]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(120_000))
    docs = [(None, "lone term"), (None, None), (1, ""), (2, None), (3, " .,\x7f "), (4, long), (5, "term \U0001f600 É é"), (6, " term")]
    items = [(None, "term"), (7, None), (8, ""), (9, "\U0001f600 w17 É w17 W17"), (10, long), (11, " term")]
    assert run(spark, docs, items) == ranked_by_hand(docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, ".")])])
def test_nothing_to_find(spark, docs, items):
    assert run(spark, docs, items) == set()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 3, 4, "x", 5)], DOC + ", score int, rank int, terms string, item_id int")
    items = spark.createDataFrame([(7, "a", 1, "y")], ITEM + ", doc_id int, n string")
    found = lexical_search.ranked_documents(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r)[:3] for r in found.collect()] == [(7, 1, 1)]


def vectors(docs, number):
    counted = [Counter(terms_by_hand(t)) for _, t in docs]
    columns = [[number[t.encode()] for t in c if t.encode() in number] for c in counted]
    times = [[n for t, n in c.items() if t.encode() in number] for c in counted]
    return (np.array([i for i, _ in docs]), np.array([sum(c.values()) for c in counted]), np.r_[0, np.cumsum(list(map(len, columns)))],
            np.array(sum(columns, []), "i8"), np.array(sum(times, []), "i8"))


def search_of(docs, items):
    docs = [d for d in docs if terms_by_hand(d[1])]
    texts = [lexical_search.terms(t.encode()) for _, t in items]
    number = {t: i for i, t in enumerate(sorted({t for w in texts for t in w}))}
    ids, lengths, starts, columns, times = vectors(docs, number)
    built = lexical_search.build_items([i for i, _ in items], texts, number, Counter(columns.tolist()), len(docs), int(lengths.sum()))
    search = lexical_search.Search(built)
    search.add(ids, lengths, starts, columns, times)
    return search, len(docs) * len(items)


def test_bounds_hold_and_prune():
    docs, items = corpus(4000, 30, 2)
    items = [i for i in items if terms_by_hand(i[1])]
    search, pairs = search_of(docs, items)
    assert search.scored < pairs / 3
    tree = search.items.tree
    for level in tree.levels:
        assert len(level) == len(np.flatnonzero(np.diff(level.starts)))
    assert len(tree.levels[-1]) == 1
    # A node holds the largest value of each term below it.
    for level in range(1, len(tree.levels)):
        for node in range(len(tree.levels[level])):
            most: dict[int, int] = {}
            below = tree.levels[level - 1]
            for child in tree.below(level, np.array([node])):
                for k in range(below.starts[child], below.starts[child + 1]):
                    most[int(below.columns[k])] = max(most.get(int(below.columns[k]), 0), int(below.values[k]))
            a, b = tree.levels[level].starts[node:node + 2]
            assert dict(zip(tree.levels[level].columns[a:b].tolist(), tree.levels[level].values[a:b].tolist())) == most


def test_terms_of_other_scripts_match_the_pattern():
    rng = random.Random(5)
    alphabet = [chr(c) for c in (*range(0, 256), 0x2003, 0x3042, 0xFFFF, 0x1F600)]
    for _ in range(200):
        text = "".join(rng.choices(alphabet, k=rng.randrange(40)))
        assert [t.decode() for t in lexical_search.terms(text.encode())] == terms_by_hand(text)


def test_batches_join_into_chunks_of_bounded_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "_CHUNK", 5)
    monkeypatch.setattr(lexical_search, "_CHUNK_ENTRIES", 8)
    rng = random.Random(6)
    batches, want = [], []
    for size in (1, 7, 3, 12, 1):
        lists = [list(range(rng.choice([0, 1, 3, 20]))) for _ in range(size)]
        ids = list(range(len(want), len(want) + size))
        want += list(zip(ids, lists))
        column = pa.array(lists, pa.list_(pa.int32()))
        batches.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ids, pa.int64()), column, column], ["id", "n", "terms", "times"]))
    got = []
    for ids, lengths, starts, columns, times in lexical_search._chunks(batches):
        assert len(ids) <= 5 and (starts[-1] <= 8 or len(ids) == 1)
        assert (columns == times).all() and (ids == lengths).all()
        got += [(int(i), columns[a:b].tolist()) for i, a, b in zip(ids, starts, starts[1:])]
    assert got == want
