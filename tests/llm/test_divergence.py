"""The audit against sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from floorflow.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long"


def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)


def _brute(rows, top=200):
    n, df, groups, out = defaultdict(Counter), defaultdict(Counter), set(), []
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        n[lang, source].update(_terms(text))
        df[lang].update(set(_terms(text)))
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= 3]

        def p(counts, total):
            return {t: 1 + (10**9 * (counts[t] + 1)) // (total + len(kept)) for t in kept}

        own = {s: p(n[lang, s], sum(n[lang, s][t] for t in kept)) for x, s in groups if x == lang}
        whole = sum((n[lang, s] for x, s in groups if x == lang), Counter())
        q = p(whole, sum(whole[t] for t in kept))
        mine = own[source]
        found = [("pair", s, sum((mine[t] - o[t]) ** 2 // o[t] for t in kept)) for s, o in own.items() if s != source]
        terms = [("term", t, (mine[t] - q[t]) ** 2 // q[t]) for t in kept if n[lang, source][t] and mine[t] > q[t]]
        for rows_, most in ((found, len(found)), (terms, top)):
            rows_.sort(key=lambda r: (-r[2], r[1].encode()))
            out += [(lang, source, *r, k + 1) for k, r in enumerate(rows_[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = [rng.choice("abcäßñ日") + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 5))) for _ in range(900)]
    out = []
    for k in range(500):
        source = rng.choice(["hot", "hot", None, "", "s1", "s2", "s3"])
        lang = rng.choice(["en", "en", "en", "de", None])
        favourite = vocabulary[(sum(map(ord, source or "")) % 7) * 50 :][:60] if source else vocabulary
        text = " ".join(rng.choice([*favourite, *vocabulary[:30]]) for _ in range(rng.randrange(80)))
        out.append((k, text.upper() if k % 9 == 0 else text, lang, source, "clash", 1))
    out += [(900, None, "en", "only null", None, None), (901, "", "en", "only empty", None, None), (902, "12 34 -- []", "en", "signs", None, None)]
    out += [(903, "word Word wORD", "fr", "a", None, None), (904, "word", "fr", "b", None, None)]  # nothing is kept
    out += [(905, "long " * 200_000 + "x" * 100_000, "en", "long", None, None), (None, "a9b Å", "en", "s1", None, None)]
    return out + [out[0]] * 5 + [out[7]]


@pytest.mark.parametrize("top", [200, 3])
def test_audit_matches_brute_force(spark, rows, top):
    tables = divergence.Audit(spark.createDataFrame(rows, SCHEMA))
    got = [(r.lang, r.source, part, r.item, r.value, r.rank) for part, d in (("pair", tables.pairs()), ("term", tables.terms(top))) for r in d.collect()]
    assert sorted(got) == _brute(rows, top)


def test_search_goes_on_where_ties_reach_the_last_place(spark, monkeypatch):
    # each document's word makes a bucket of its own count, all but one shared evenly by two sources
    rows = [(k, f"{chr(97 + i)}{chr(97 + j)} " * (1 + i), "en", f"s{k % 3 % 2}", None, None) for i in range(20) for j in range(3) for k in range(4)]
    monkeypatch.setattr(divergence, "GROWTH", 2)
    tables = divergence.Audit(spark.createDataFrame(rows, SCHEMA))
    got = [(r.lang, r.source, "term", r.item, r.value, r.rank) for r in tables.terms(1).collect()]
    assert sorted(got) == [r for r in _brute(rows, 1) if r[2] == "term"]


def test_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_of_postings_over_batches(monkeypatch):
    rng = random.Random(4)
    rows = sorted({(rng.choice("ab"), f"t{rng.randrange(30)}", rng.randrange(12)): rng.randrange(1, 10**9) for _ in range(600)}.items())
    p0 = [rng.randrange(1, 10**6) for _ in range(12)]
    want = Counter()
    for (la, ta, ga), pa_ in rows:
        for (lb, tb, gb), pb in rows:
            if (la, ta) == (lb, tb) and ga != gb:
                x, y = p0[ga], p0[gb]
                want[ga, gb] += (pa_ - pb) ** 2 // pb - (pa_ - y) ** 2 // y - (x - pb) ** 2 // pb + (x - y) ** 2 // y
    batch = pa.RecordBatch.from_pydict({
        "lang": [r[0][0] for r in rows], "term": [r[0][1] for r in rows], "gid": [r[0][2] for r in rows],
        "p": [r[1] for r in rows], "p0": [p0[r[0][2]] for r in rows],
    })
    monkeypatch.setattr(divergence, "HELD_ROWS", 50)
    monkeypatch.setattr(divergence, "STEP_PAIRS", 40)
    got = Counter()
    for out in divergence._both(batch.slice(k, 7) for k in range(0, len(rows), 7)):
        for a, b, mend in zip(*(c.to_pylist() for c in out.columns)):
            got[a, b] += mend
    assert got == want and np.all([a != b for a, b in got])
