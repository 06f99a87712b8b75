"""Mixing, packing, token counts: brute force, exact round trips, odd rows."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter, defaultdict
from math import exp

import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from codeloom.llm import mixing, packing, token_trees
from codeloom.llm.tokens import default_path, encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} {i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    rows = [
        (1, "The house by the river.", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, "b", 0), (None, "no id here", "en", None, 1),
        (4, LONG, "en", "b", 1), (5, "same text twice", "en", "c", 1), (5, "same text twice", "en", "c", 1), (6, "same text twice", "en", "c", 1),
        (7, " \n\t ", "en", "", 1), (None, None, None, None, None), (8, "naïve 日本語 😀  text\n\nends here ", "fr", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def encode():
    return encoder(default_path())


def test_ids_are_those_of_the_tokenizer_file(encode):
    texts = ["", " ", "  a", "a \n b", "x <|endoftext|> y", "a  b", "\n\n a", "don't  can't　 z", "a​ b", "1 2 3 '' 's a's", "a \u0085b", "日本語" * 50, "x" * 3000, LONG[:5000]]
    assert encode.by_rank is not None
    plain = Tokenizer.from_file(default_path())
    for text in texts:
        assert encode.ids(text) == plain.encode(text, add_special_tokens=False).ids
    assert encode.ids("foo <|endoftext|> bar") != encode.by_rank.encode_ordinary("foo <|endoftext|> bar")


# Mixing


def count_by_hand(mean: float, unit: float) -> int:
    k, p, below = 0, exp(-mean), exp(-mean)
    while unit >= below:
        k += 1
        p = p * mean / k
        below += p
    return k


def test_counts_are_the_inverse_of_the_distribution(spark):
    ids = spark.range(2000).withColumn("mean", F.col("id") % 8 / 2.0)
    got = ids.select("mean", mixing.hashed_unit(F.lit(17), F.lit("count"), F.col("id"), F.lit(1)).alias("u"), mixing.poisson_count(F.col("mean"), 17, F.col("id")).alias("n"))
    rows = got.collect()
    assert all(r.n == (count_by_hand(r["mean"], r.u) if r["mean"] else 0) for r in rows)
    assert len({r.u for r in rows}) == 2000


def test_large_means_are_drawn_in_parts(spark):
    n = [r.n for r in spark.range(400).select(mixing.poisson_count(F.lit(1000.0), 3, F.col("id")).alias("n")).collect()]
    assert 980 < sum(n) / 400 < 1020 and 600 < sum((x - 1000) ** 2 for x in n) / 400 < 1500


def test_sources_reach_their_weights(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 7 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    mixed = mixing.mix_sources(docs, {"hot": 1, "b": 2, "c": 5})
    sizes = {r.source: r.s for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("s")).collect()}
    total = sum(sizes.values())
    assert abs(sizes["hot"] / total - 1 / 8) < 0.02 and abs(sizes["c"] / total - 5 / 8) < 0.03
    assert abs(total / 24000 - 1) < 0.05
    copies = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m"), F.max("n_copies").alias("c")).collect()
    assert all(r.n == r.m == r.c for r in copies)
    parts = [[r.mix_key for r in p] for p in mixed.rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts)


def test_mixing_is_the_same_in_every_run(spark, odd):
    mix = lambda: Counter(tuple(r) for r in mixing.mix_sources(odd).drop("text").collect())
    assert mix() == mix()


def test_mixing_odd_rows(spark, odd):
    rates = {r.source: r.rate for r in mixing.source_rates(odd).collect()}
    assert set(rates) == {"a", "b", "c", "", None} and all(r > 0 for r in rates.values())
    got = mixing.mix_sources(odd.withColumns({"COPY": F.lit(9), "rate": F.lit("x"), "_rate": F.lit(1)}))
    assert [c for c in got.columns if c.lower() in ("copy", "rate", "_rate")] == ["_rate", "rate", "copy"]
    per = Counter(r.doc_id for r in got.collect())
    assert per[5] == 2 * next((r.n_copies for r in got.filter("doc_id = 5").collect()), 0)
    assert mixing.mix_sources(odd.limit(0)).count() == 0
    assert mixing.mix_sources(odd, {"": 1.0}).filter("coalesce(source, '') <> ''").count() == 0


# Packing


def check_packing(rows, docs, encode, window):
    """Every id of every document in exactly one piece, sequences without gaps, lengths full or powers of two."""
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end == window or end < window and end & (end - 1) == 0
    want = Counter()
    for id_, text in docs:
        want[id_] += len(encode.ids(text or "")) + 1
    assert Counter({k: sum(p[1] for p in v) for k, v in pieces.items()}) == want
    for id_, text in docs:
        ids = encode.ids(text or "") + [1]
        if sum(d[0] == id_ for d in docs) == 1:
            at = 0
            for start, length, crc, total in sorted(pieces[id_]):
                assert start == at and total == len(ids) and crc == zlib.crc32(array("I", ids[start:start + length]).tobytes())
                at += length
            assert at == len(ids)


@pytest.mark.parametrize("window, parts", [(2048, 3), (64, 5), (64, 40)])
def test_packing_round_trip(spark, odd, encode, window, parts):
    rows = packing.pack(odd.repartition(parts), window=window, open_windows=4).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()], encode, window)


def test_packing_keeps_rests_whole_where_they_fit(spark):
    packer = packing.Packer(10, 2, 0)
    for id_, n in (("a", 6), ("b", 7), ("c", 3), ("d", 4), ("e", 25)):
        packer.add(id_, 0, bytes(4 * n), n)
    packer.close()
    by = defaultdict(list)
    for row in packer.rows:
        by[row[0]].append((row[1], row[2], row[5]))
    assert by["b"][0][2] == by["c"][0][2] and by["a"][0][2] == by["d"][0][2]  # 7 + 3 and 6 + 4 fit exactly
    assert [x[:2] for x in by["e"]] == [(0, 10), (10, 10), (20, 4), (24, 1)]  # the last window is cut into 4 and 1


def test_packing_nothing_and_other_ids(spark, odd):
    assert packing.pack(odd.limit(0)).count() == 0
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert packing.pack(named).filter("doc_id = 'd4'").count() > 10


# Token counts


def test_counts_follow_edits(spark, odd, encode):
    edits = "array(named_struct('start', 3, 'length', 5, 'text', 'X y '), null, named_struct('start', 0, 'length', 0, 'text', cast(null as string)), " \
            "named_struct('start', 40, 'length', 100000, 'text', '  end'), named_struct('start', cast(null as int), 'length', 1, 'text', 'no'))"
    trees = token_trees.build_trees(odd, leaf=16)
    assert all(r.n_tokens == len(encode.ids(r.text or "")) for r in trees.collect())
    rows = token_trees.apply_edits(trees.withColumn("edits", F.expr(edits)), leaf=16).collect()
    want = []
    for r in odd.collect():
        t = r.text or ""
        t = t[:3] + "X y " + t[8:]
        t = t[:40] + "  end" + t[40 + 100000:]
        want.append((r.doc_id, t, len(encode.ids(t)), len(encode.ids(r.text or ""))))
    assert Counter(want) == Counter((r.doc_id, r.text, r.n_tokens, r.n_tokens_before) for r in rows)
    long = next(r for r in rows if r.doc_id == 4)
    assert long.encoded_chars < len(LONG)
    again = token_trees.apply_edits(spark.createDataFrame(rows).withColumn("edits", F.expr(edits)), leaf=16)
    assert all(r.n_tokens == len(encode.ids(r.text)) for r in again.collect())


def test_only_the_region_is_encoded(encode):
    seen = []
    tree = token_trees.TokenTree.of(encode.ids, LONG)
    tree.encode = lambda x: seen.append(x) or encode.ids(x)
    tree.replace(100_000, 3, " changed")
    changed = LONG[:100_000] + " changed" + LONG[100_003:]
    assert tree.text == changed and tree.tokens[1] == len(encode.ids(changed)) and sum(map(len, seen)) < 3000


def test_random_edits(encode):
    import random

    rng, letters = random.Random(1), ["a", " ", "  ", "\n", "'s", "é", "1", "don't", " b", ".", "日", "  ", ""]
    for _ in range(150):
        text = "".join(rng.choices(letters, k=rng.choice([0, 1, 20, 300])))
        tree = token_trees.TokenTree.of(encode.ids, text, rng.choice([4, 16]))
        for _ in range(6):
            start, length, new = rng.randint(0, len(text) + 1), rng.choice([0, 1, 3, 50]), "".join(rng.choices(letters, k=rng.choice([0, 1, 40])))
            tree.replace(start, length, new)
            start = min(start, len(text))
            text = text[:start] + new + text[start + length:]
            assert tree.text == text and tree.tokens[1] == len(encode.ids(text)) and tree.chars[1] == len(text)


def test_no_documents_no_trees(spark, odd):
    assert token_trees.apply_edits(token_trees.build_trees(odd.limit(0)).withColumn("edits", F.expr("array(named_struct('start', 1, 'length', 1, 'text', 'a'))"))).count() == 0
