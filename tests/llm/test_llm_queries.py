"""The registered queries over the smallest provided tables, against their SQL or brute force."""

from __future__ import annotations

import hashlib
import html
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from codeloom.llm import fingerprints
from codeloom.llm.common import table
from codeloom.llm.queries import ORACLES, QUERIES
from codeloom.llm.tokens import default_path, encoder
from test_llm_documents import check_packing
from test_llm_near import group, simhash_by_hand

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()}


def run(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(map(tuple, df.select(columns).collect())) == Counter(cursor.fetchall())


def test_op4(spark, texts):
    check_packing(run(spark, "op4_best_fit_packing"), list(texts.items()), encoder(default_path()), 2048)


def test_op5(spark):
    want = {}
    for r in table(spark, FOLDER, "pages").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?p>|</?h1>", article)]
        text = "\n".join(p for p in parts if p)
        want[r.page_id] = (r.url, text, len(text))
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in run(spark, "op5_main_text")} == want


def test_op7(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op7_toxicity_scores")}
    assert set(got) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())


def test_op8(spark, texts):
    encode = encoder(default_path()).ids
    got = {r.doc_id: r for r in run(spark, "op8_edited_token_counts")}
    assert set(got) == set(texts)
    for i, before in texts.items():
        n, text = len(before), before
        for start, length, new in ((n // 4, 25, f" changed at {i}"), (n // 2, 0, before[:40]), (n * 3 // 4, min(n // 8, 300), ""), (n, 0, "\n\nEnd.  ")):
            start = min(start, len(text))
            text = text[:start] + new + text[start + length:]
        r = got[i]
        assert (r.n_tokens_before, r.n_tokens, r.n_chars) == (len(encode(before)), len(encode(text)), len(text))
        assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op9(spark, texts):
    order = sorted(texts, reverse=True)
    prints = {i: fingerprints.fingerprint(texts[i]) for i in order}
    array = np.array([prints[i] for i in order], dtype="u8")
    within = dict(zip(order, (np.bitwise_count(array[:, None] ^ array[None, :]) <= fingerprints.RADIUS).sum(axis=1)))
    got = {r.doc_id: r for r in run(spark, "op9_simhash_fingerprints")}
    assert set(got) == set(texts)
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        new = fingerprints.edited(texts[i], texts[after])
        r, fp, new_fp = got[i], prints[i], fingerprints.fingerprint(new)
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint, r.n_within) == (f"{fp:016x}", f"{new_fp:016x}", within[i])
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(fp, new_fp), fingerprints.likeness(fp, prints[after]))


def test_op10(spark, texts):
    ids = sorted(texts)
    prints = np.array([simhash_by_hand(texts[i]) for i in ids], dtype="u8")
    roots = group(len(ids), np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    want = {i: (f"{int(p):016x}", ids[r]) for i, p, r in zip(ids, prints, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op10_simhash_components")} == want
