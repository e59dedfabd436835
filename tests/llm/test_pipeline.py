"""The corpus pipeline: each stage by itself, and run() against brute force."""

import random

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the ing and ou th er", "de": "sch ung ich ein der zu", "fr": "eau oui les que eux ant"}


def _prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=3)) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def table():
    rng = random.Random(9)
    rows = []
    for k in range(90):
        lang = ["en", "de", "fr"][k % 3]
        rows.append((k, _prose(rng, lang, 50 + k % 40), lang, f"s{k % 5}", None))
    rows[40] = (40, rows[4][1] + " more words", "en", "s0", None)  # a near copy
    rows[41] = (41, rows[5][1], "fr", "s1", None)  # an exact one
    passage = _prose(rng, "en", 70)
    for k in (10, 50, 70):
        rows[k] = (k, f"{rows[k][1]} {passage} {_prose(rng, rows[k][2], 20)}", *rows[k][2:])
    odd = [(200, None, "en", "s1", None), (201, "", None, None, None), (202, "12 34 !!", "de", "s2", 8), rows[7], rows[7], (203, _prose(rng, "en", 4000), "en", "s4", 1)]
    return rows + odd + [(3, _prose(rng, "de", 60), "de", "s3", None), (None, _prose(rng, "fr", 60), "fr", "s0", None)]


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).selectExpr("*", "1L AS tid", "'c' AS chosen", "2 AS stays")


def _rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", range(4))
def test_stages_return_the_columns_and_take_empty_tables(spark, docs, k):
    stage = cp.STAGES[k][1]
    assert stage(spark, docs, "").columns == docs.columns
    assert stage(spark, docs.limit(0), "").count() == 0


def test_language_keeps_all_that_has_one(spark, docs, table):
    want = sorted(((r[0], r[1]) for r in table if r[0] not in (200, 201, 202)), key=str)
    assert _rows(cp.identify_language(spark, docs, "")) == want


def test_near_copies_leave_one_of_each(spark, docs, table):
    rows, seen = [], set()
    for r in table:
        if r[0] in (40, 41) or (r[0] == 7 and r in seen):
            continue
        seen.add(r)
        rows.append((r[0], r[1]))
    assert _rows(cp.drop_near_copies(spark, docs, "")) == sorted(rows, key=str)


def test_mix_keeps_whole_documents_within_the_budget(spark, docs, table):
    kept = _rows(cp.mix_sources(spark, docs, ""))
    whole = sorted(((r[0], r[1]) for r in table), key=str)
    assert set(kept) <= set(whole) and {(200, None), (201, "")} <= set(kept) and any(r[0] is None for r in kept)
    words = lambda rows: sum(len((t or "").split()) for _, t in rows)
    assert 0.85 * words(whole) <= words(kept) <= words(whole)


def test_run_equals_the_stages_by_hand(spark, tmp_path, table):
    from floorflow.llm import packing
    from floorflow.llm.queries import tokenizer_path

    plain = [r for r in table if r[0] is not None]
    spark.createDataFrame(plain, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path)).toPandas()
    tool = packing.tokens_of(tokenizer_path()).tokenizer
    count = lambda t: len(tool.encode(t or "", add_special_tokens=False).ids) + 1
    text = {}
    for r in plain:
        text.setdefault(r[0], set()).add(count(r[1]))
    assert not set(got.doc_id) & {200, 201, 202, 40, 41}
    assert got[got.doc_id == 7].start.tolist().count(0) <= 1
    cut = got[got.doc_id.isin([50, 70])].drop_duplicates("doc_id")
    assert all(r.doc_tokens < min(text[r.doc_id]) for r in cut.itertuples())
    rest = got[~got.doc_id.isin([50, 70])]
    assert all(r.doc_tokens in text[r.doc_id] for r in rest.itertuples())
    assert got.groupby("sequence_id").length.sum().max() <= 4096
