"""Tiered search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from floorflow.llm import lexical

DOCS = "doc_id long, text string, lang string, score long, rid long, item long"
ITEMS = "item_id long, text string, doc_id long, rank int"


def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def _brute(items, docs, top=10):
    tf = [Counter(_terms(r[1])) for r in docs]
    n = [sum(c.values()) for c in tf]
    count, length = sum(k > 0 for k in n), sum(n)
    df = Counter(t for c in tf for t in c)
    wanted = {}
    for item, text, *_ in items:
        wanted.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in wanted.items():
        found = []
        for r, c, k in zip(docs, tf, n):
            m = 10 + 90 * k * count // max(length, 1)
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t]
            )
            if score > 0:
                found.append((-score, r[0] is None, r[0] or 0, r[0]))
        found.sort(key=lambda x: x[:3])
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(found[:top])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    common, rare = [f"w{k}" for k in range(40)], [f"r{k}é" for k in range(3000)]
    text = [" ".join(rng.choices(common, k=rng.randrange(1, 60)) + rng.choices(rare, k=rng.randrange(4))) for _ in range(900)]
    docs = [(k, t.upper() if k % 5 == 0 else t, None, None, None, None) for k, t in enumerate(text)]
    docs += [(2000 + k, "w1 w2 w3 copies of one text", "x", 1, 1, 1) for k in range(60)]  # ties far beyond the tenth
    docs += [(None, "w1 w2", None, None, None, None), (3000, None, None, None, None, None), (3001, "", None, None, None, None), (3002, "-- __ ", None, None, None, None)]
    docs += [(3003, "w5 " * 300_000 + "lonely", None, None, None, None), docs[5], docs[5], docs[6]]
    items = [(k, " ".join(rng.choices(common, k=6) + rng.choices(rare, k=rng.randrange(3))), None, None) for k in range(60)]
    items += [(100, None, 1, 1), (101, "", 1, 1), (102, "unknown words", 1, 1), (103, "copies, OF one", 1, 1), (104, "lonely", 1, 1)]
    items += [(None, "w1 W1 w2", None, None), (105, "w3", None, None), (105, "w4 w3", None, None), (106, "?!", 1, 1), (107, text[3] * 50, 1, 1)]
    return items, docs


def test_search_matches_brute_force(spark, tables):
    items, docs = tables
    got = lexical.search(spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute(items, docs)


def test_items_in_turns(spark, tables, monkeypatch):
    items, docs = tables
    monkeypatch.setattr(lexical, "CELLS", 300)
    monkeypatch.setattr(lexical, "INDEX_BYTES", 9000)
    got = lexical.search(spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs[:400], DOCS), top=3, shares=(0.05,))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute(items, docs[:400], 3)


def test_items_fall_through_only_without_proof(spark, tables):
    items, docs = tables
    vocabulary = {w: k for k, w in enumerate(sorted({t.encode() for _, x, *_ in items for t in _terms(x)}))}
    index = lexical.Index(spark.createDataFrame(docs, DOCS), vocabulary)
    rare = [np.array([k]) for w, k in vocabulary.items() if w[:1] == b"r"]
    _, asked = index.search(rare)
    assert asked == [len(rare)]  # all postings of a rare term are in the first tier
    _, asked = index.search([np.arange(len(vocabulary))] + rare)
    assert asked[0] == len(rare) + 1 and asked[-1] == 1


def test_sums_of_long_documents_go_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(200, n, replace=False)).astype(np.int32) for n in (0, 3, 190, 1, 0, 60, 7, 150)]
    tids = np.concatenate(rows)
    batch = pa.RecordBatch.from_arrays([lexical._lists(tids, np.array([len(r) for r in rows]))], names=["tids"])
    value = rng.integers(0, 10**6, len(tids))
    weight = rng.integers(0, 9000, 200)
    items = lexical._Items([np.sort(rng.choice(200, 40, replace=False)) for _ in range(5)], weight)
    dense = np.zeros((200, 5), np.int64)
    dense[items.place >= 0] = items.table
    want, at = {}, 0
    for k, r in enumerate(rows):
        want[k] = (dense[r] * value[at : at + len(r), None]).sum(axis=0)
        at += len(r)
    for most in (1, 20, 50, 400, 10**6):
        monkeypatch.setattr(lexical, "PRODUCTS", most)
        got = {int(k): s for found, sums in items.sums(batch, value) for k, s in zip(found, sums)}
        assert all((got.get(k, 0) == w).all() for k, w in want.items())


def test_empty_tables(spark, tables):
    items, docs = (spark.createDataFrame(t, s) for t, s in zip(tables, (ITEMS, DOCS)))
    none_items, none_docs = (spark.createDataFrame([], s) for s in (ITEMS, DOCS))
    for i, d in ((items, none_docs), (none_items, docs), (none_items, none_docs), (items, docs.where("doc_id in (3000, 3001, 3002)"))):
        got = lexical.search(i, d)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []
