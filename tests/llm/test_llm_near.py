"""SimHash components, fingerprints and embeddings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import embedding_dedup, fingerprints, simhash_dedup
from codeloom.llm.common import Scratch, components, join_unique

DOCS = "doc_id long, text string, lang string"
WORDS = [f"w{i}" for i in range(400)]


def copies(seed: int, groups: int, size: int, length: int, edits: int) -> list[str]:
    """Groups of texts that differ in a few words."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        words = rng.choices(WORDS, k=length)
        for _ in range(size):
            changed = list(words)
            for _ in range(rng.randint(0, edits)):
                changed[rng.randrange(length)] = rng.choice(WORDS)
            out.append(" ".join(changed))
    return out


def group(n: int, linked) -> list[int]:
    """Smallest number reachable, for items 0 … n-1 and a matrix of links."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(linked)):
        a, b = find(int(i)), find(int(j))
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash_by_hand(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def texts():
    odd = [None, "", " \n\t", "one", "One", "two words", "Ünï cÖde WORDS here Now", "a b c d", "A  B\tC\nD", "nbsp in it", "x " * 40_000]
    return odd + copies(1, 40, 5, 60, 3) + copies(2, 1, 150, 120, 4)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i + 100, t, "en") for i, t in enumerate(texts)], DOCS).repartition(5)


def test_every_pair_within_the_radius_shares_a_bucket():
    rng = random.Random(3)
    for radius in (1, 2, 3, 4, 5):
        tables = simhash_dedup.masks(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(300):
            differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(m & differ == 0 for m in tables)


@pytest.mark.parametrize("pairs_up_to", [1, 32, 10_000])
def test_components_are_those_of_all_pairs(spark, docs, texts, pairs_up_to, monkeypatch):
    monkeypatch.setattr(simhash_dedup.near_links, "__defaults__", (simhash_dedup.RADIUS, pairs_up_to))
    prints = np.array([simhash_by_hand(t) for t in texts], dtype="u8")
    linked = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    want = {i + 100: (f"{int(prints[i]):016x}", r + 100) for i, r in enumerate(group(len(texts), linked))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.simhash_components(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 100  # there are groups to find


@pytest.mark.parametrize("radius", [2, 3, 5])
def test_meeting_points_link_no_more_and_no_less(spark, radius):
    rng = random.Random(radius)
    points = {0}
    while len(points) < 120:
        base = rng.choice(sorted(points))
        points.add(base ^ sum(1 << b for b in rng.sample(range(24), rng.randint(1, radius + 2))))
    points = sorted(points)
    array = np.array(points, dtype="u8")
    want = group(len(points), np.bitwise_count(array[:, None] ^ array[None, :]) <= radius)
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    links = simhash_dedup.near_links(df, Scratch(spark, "t"), radius, 2)
    found = {r.node: r.root for r in components(links, Scratch(spark, "t")).collect()}
    assert [found.get(p, p) for p in points] == [points[r] for r in want]


def test_one_of_each_group_stays(spark, docs, texts):
    wide = docs.withColumns({"FP": F.lit(1), "component_id": F.lit("x")})
    twice = wide.unionByName(wide.filter("doc_id % 10 = 0"))
    kept = simhash_dedup.keep_first(twice)
    assert kept.columns == wide.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert set(got.values()) == {1}
    assert set(got) == {r.component_id for r in simhash_dedup.simhash_components(docs).collect()}


def test_null_ids_and_no_rows(spark):
    rows = [(None, "a b c d e f", None), (7, "a b c d e f", "en"), (None, "other words entirely are here now", None), (None, "other words entirely are here now", "de")]
    df = spark.createDataFrame(rows, DOCS)
    got = Counter((r.doc_id, r.component_id) for r in simhash_dedup.simhash_components(df).collect())
    assert got == {(7, 7): 1, (None, 7): 1, (None, None): 2}
    assert sorted(r.text for r in simhash_dedup.keep_first(df).collect()) == ["a b c d e f", "other words entirely are here now"]
    assert simhash_dedup.simhash_components(df.limit(0)).count() == simhash_dedup.keep_first(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, i) for i in range(1001, 1300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(5000, 5000)], "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}


def test_hot_keys_join_like_any_other(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(6000)] + [(-1, "none"), (-2, None)], "i long, k string")
    one = spark.createDataFrame([("hot", 4000, 1.0)] + [(f"k{i}", 1, 2.0) for i in range(0, 6000, 3)], "k string, n long, v double")
    got = join_unique(rows, one, "k", "n").select("i", "k", "v").collect()
    assert sorted(r.i for r in got) == list(range(6000)) and all(r.v == (1.0 if r.k == "hot" else 2.0) for r in got)
    assert join_unique(rows, one.limit(0), "k", "n").count() == 0


def test_dense_buckets_are_spread_before_they_grow(spark):
    """Fingerprints of one bucket are dealt to as many tasks as there are cores, though they are few bytes."""
    rng = random.Random(4)
    df = spark.createDataFrame([(i,) for i in {sum(1 << b for b in rng.sample(range(24), 3)) for _ in range(300)}], "fp long")
    plan = simhash_dedup.near_links(df, Scratch(spark, "t"), 4, 2)._jdf.queryExecution().toString()
    cores = spark.sparkContext.defaultParallelism
    assert f"hashpartitioning(fp#" in plan and f", {cores}), REPARTITION_BY_NUM" in plan


# Fingerprints


def fingerprint_by_hand(text: str | None) -> int:
    """Every word and pair of words hashed byte by byte in Python's integers; weighted votes bit by bit."""
    mask = (1 << 64) - 1

    def stir(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    base = 0x9E3779B97F4A7C15
    words = []
    for word in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split():
        words.append(stir(sum((byte + 1) * pow(base, i, 1 << 64) for i, byte in enumerate(word)) & mask))
    runs = [words[i:i + 2] for i in range(len(words) - 1)] or ([words] if words else [])
    counts = Counter()
    for run in runs:
        h = 0
        for word in run:
            h = (h * base + word) & mask
        counts[stir(h)] += 1
    weight = {h: float(np.float32(1 + np.log(n))) for h, n in counts.items()}
    total = sum(weight.values())
    return sum(1 << b for b in range(64) if counts and 2 * sum(w for h, w in weight.items() if h >> b & 1) > total)


def test_fingerprints_by_hand(texts):
    short = [t for t in texts if len(t or "") < 3000] + ["tab\tand\nline", "a a a a b", "\u00a0 x", "É é"]
    for text in short:
        got, want = fingerprints.fingerprint(text), fingerprint_by_hand(text)
        assert (got ^ want).bit_count() <= 1, text  # sums of single-precision weights may tie differently
    assert sum(fingerprints.fingerprint(t) == fingerprint_by_hand(t) for t in short) >= len(short) - 2


def test_fingerprints_of_edited_texts(spark, docs, texts):
    rows = docs.unionByName(spark.createDataFrame([(None, "no id at all here", None), (50, "dup one", "en"), (50, "dup one", "en")], DOCS))
    got = fingerprints.fingerprint_documents(rows).collect()
    order = [texts[i] for i in range(len(texts) - 1, -1, -1)] + ["dup one", "dup one", "no id at all here"]
    want = Counter()
    for i, text in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)] or ""
        new = text[:len(text) - len(text) // 3] + after[:len(text) // 3]
        want[(len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprints.fingerprint(text), fingerprints.fingerprint(new), fingerprints.fingerprint(after))] += 1
    assert Counter((r.n_chars, r.edited_sha256, r.fp % 2**64, r.edited_fp % 2**64, r.next_fp % 2**64) for r in got) == want
    one = fingerprints.fingerprint_documents(rows.filter("doc_id = 104")).collect()
    assert len(one) == 1 and one[0].fp == one[0].next_fp
    assert fingerprints.fingerprint_documents(rows.limit(0)).count() == 0


def test_likeness_tells_edits_from_other_texts():
    a, b = copies(5, 1, 1, 300, 0)[0], copies(6, 1, 1, 300, 0)[0]
    assert fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(fingerprints.edited(a, b))) > 0.62
    assert fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) < 0.62
    assert fingerprints.fingerprint(a) == fingerprints.fingerprint(a.upper()) and fingerprints.fingerprint(" ") == 0


def test_words_hash_alike_wherever_they_stand():
    whole = fingerprints.term_hashes("alpha beta gamma alpha beta", 2)
    assert whole[0] == whole[3] and len(set(whole.tolist())) == 3
    assert fingerprints.term_hashes("alpha", 2)[0] == fingerprints.term_hashes("  Alpha\n", 2)[0]


@pytest.mark.parametrize("radius, blocks", [(3, 5), (2, 4)])
def test_radius_search_finds_all(spark, texts, radius, blocks):
    prints = [fingerprints.fingerprint(t) for t in texts]
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    array = np.array(prints, dtype="u8")
    counts = (np.bitwise_count(array[:, None] ^ array[None, :]) <= radius).sum(axis=1)
    want = {p: int(c) for p, c in zip(prints, counts)}
    assert {r.fp % 2**64: r.n_within for r in fingerprints.within_radius(df, radius, blocks).collect()} == want


# Embeddings


def vectors(seed=4, n=400, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base[:120] + 0.25 * rng.standard_normal((120, dim))
    hub = base[0] + 0.1 * rng.standard_normal((150, dim))
    rows = [v.astype("f4").tolist() for v in np.concatenate([base, near, hub])]
    rows += [rows[1], rows[1], [2 * x for x in rows[2]], None, [0.0] * dim, [], [float("nan")] + rows[3][1:], [None, *rows[3][1:]], [float("inf"), *rows[3][1:]], rows[3][:5]]
    return rows


@pytest.mark.parametrize("block", [32, 1024])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(i + 10, v, i % 3) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    units = [embedding_dedup.unit_vector(v) for v in rows]
    cos = np.array([[a @ b if a is not None and b is not None and len(a) == len(b) else -1 for b in units] for a in units])
    linked = cos >= 0.9
    np.fill_diagonal(linked, False)
    want = linked.sum(axis=1)
    n_links = np.array([got[i + 10].n_links for i in range(len(rows))])
    assert (n_links <= want).all() and n_links.sum() >= 0.97 * want.sum()
    roots = group(len(rows), linked)
    assert np.mean([got[i + 10].component_id == r + 10 for i, r in enumerate(roots)]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert [got[i + 10].n_links for i in range(len(rows) - 7, len(rows) - 1)] == [0] * 6


def test_embeddings_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, key string, n long"
    df = spark.createDataFrame([(None, [1.0, 0.0], "a", 1), (4, [1.0, 0.0], "b", 2), (5, None, None, None), (None, None, "c", 3), (4, [1e200, 0.0], "d", 4)], schema)
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == {(None, 2, 4, False): 1, (4, 2, 4, True): 2, (5, 0, 5, True): 1, (None, 0, None, False): 1}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.filter("embedding is null")).count() == 2


def test_far_pivots_only():
    sample = np.eye(5)[[0, 0, 1, 2, 1, 3]]
    assert len(embedding_dedup.choose_pivots(sample, 10)) == 4
    near = embedding_dedup.nearest_pivots(np.array([[0.9, 0.1, 0, 0, 0], [0, 0, 0, 1, 0.0]]), np.eye(5)[:4], 2)
    assert near.tolist() == [[0, 1], [3, 0]]


def pairs_of_cosine(cosine: float, n: int, dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = unit(rng.standard_normal((n, dim))), rng.standard_normal((n, dim))
    return a, cosine * a + (1 - cosine**2) ** 0.5 * unit(b - (a * b).sum(axis=1, keepdims=True) * a)


@pytest.mark.parametrize("pivots", [64, 1131, 8192])
def test_similar_vectors_share_pivots_however_many_there_are(pivots):
    a, b = pairs_of_cosine(0.9, 1500, 64, pivots)
    points, _ = pairs_of_cosine(0.9, pivots, 64, 1)
    near = [embedding_dedup.nearest_pivots(v, points, embedding_dedup.NEAREST) for v in (a, b)]
    same = near[0][:, :, None] == near[1][:, None, :]
    lists = embedding_dedup.number_of_lists(pivots)
    meet = same[:, :lists, :lists].any(axis=(1, 2)) & (same.sum(axis=(1, 2)) >= embedding_dedup.SHARED)
    assert np.mean(meet) > 0.995


def test_rounding_changes_a_cosine_by_no_more_than_the_bound():
    for cosine in (0.5, 0.9, 0.9999):
        for dim in (2, 64, 700):
            a, b = pairs_of_cosine(cosine, 400, dim, dim)
            one, two = embedding_dedup.rounded(a), embedding_dedup.rounded(b)
            about = (one[0].astype("f4") * two[0].astype("f4")).sum(axis=1) * one[1] * two[1]
            slack = one[2] * (1 + two[2]) + two[2] * (1 + one[2])
            assert (np.abs(about - (a * b).sum(axis=1)) <= slack + 4e-6).all() and slack.max() < 0.1


def entries_of(units: np.ndarray, near: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(units), embedding_dedup._entry(units.shape[1], near.shape[1]))
    out["near"], out["n"] = near, n
    out["code"], out["scale"], out["off"] = embedding_dedup.rounded(units)
    return out


def test_a_dense_group_hands_on_a_row_per_vector():
    """All pairs of 700 vectors link: every one is counted, none is a row."""
    rng = np.random.default_rng(1)
    units = np.ones((700, 64)) + 0.05 * rng.standard_normal((700, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    ids, n, every = np.arange(100, 800), rng.integers(1, 4, 700), np.arange(700)
    links, left_open = embedding_dedup.link_group(ids, entries_of(units, np.tile(np.arange(4), (700, 1)), n), every, every, 0, 3, 2, 0.9)
    assert len(left_open) == 0 and links[:, 0].tolist() == ids.tolist() and set(links[:, 1]) == {100}
    assert (links[:, 2] == n.sum() - n).all()


def test_pairs_count_once_and_open_ones_are_handed_on():
    a, b = pairs_of_cosine(0.9, 50, 64, 3)
    near = np.array([[5, 2, 9, 7]] * 50 + [[2, 7, 5, 1]] * 50)
    both = entries_of(np.concatenate([a, b]), near, np.ones(100, "i8"))
    ids = np.arange(100)
    pairs = lambda pivot, lists, shared: embedding_dedup.link_group(ids, both, np.arange(50), np.arange(50, 100), pivot, lists, shared, 0.9)[1].tolist()
    # Within rounding of the threshold all are open; the first list the two share is that of pivot 2.
    assert pairs(2, 3, 3) == [[i, 50 + i] for i in range(50)]
    assert pairs(5, 3, 3) == [] and pairs(2, 3, 4) == [] and pairs(7, 4, 3) == []


def test_entries_are_small_and_few():
    """Bytes of an entry against the 256 of 64 floats, and copies of each vector in all lists together."""
    assert embedding_dedup._entry(64, embedding_dedup.NEAREST).itemsize == 108
    for n, copies in ((50_000, 8), (1_280_000, 10), (4_200_000, 20), (67_000_000, 66)):
        pivots = embedding_dedup.number_of_pivots(n)
        lists = embedding_dedup.number_of_lists(pivots)
        assert lists * -(-n * lists // pivots // embedding_dedup.BLOCK) <= copies, n


@pytest.mark.parametrize("pivots", [1131, 8192])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_with_many_pivots_are_those_of_all_pairs(spark, monkeypatch, pivots, kind):
    monkeypatch.setattr(embedding_dedup, "number_of_pivots", lambda n: pivots)
    a, b = pairs_of_cosine(0.901, 600, 64, 7)
    others, _ = pairs_of_cosine(0.9, pivots, 64, 8)
    rows = np.concatenate([a, b, others]).astype("f4")
    df = spark.createDataFrame(enumerate(rows.tolist()), f"vec_id long, embedding array<{kind}>").repartition(3)
    units = np.stack([embedding_dedup.unit_vector(v) for v in rows.tolist()])
    linked = units @ units.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    n_links = np.array([got[i] for i in range(len(rows))])
    assert (n_links <= linked.sum(axis=1)).all() and n_links.sum() >= 0.99 * linked.sum() > 1000
