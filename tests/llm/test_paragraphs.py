"""Recall of the paragraph bands on short lines with a word changed at an end."""

import random

import pytest

from floorflow.llm import substring_dedup


@pytest.mark.parametrize("words", [20, 22, 26, 29, 35])
def test_short_paragraphs_with_an_end_word_changed_are_found(spark, words):
    rng = random.Random(words)
    line = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for k in range(100):
        same = line(words)
        other = same[:-1] + ["changed"] if k % 2 else ["changed"] + same[1:]
        for j, passage in enumerate((same, other)):
            docs.append((1000 * j + k, "\n".join(" ".join(x) for x in (line(15), passage, line(12)))))
    found = substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    hit = {(r.first, r.doc_id) for r in found if r.start == 15 and r.n == words}
    assert len(hit & {(k, 1000 + k) for k in range(100)}) >= 98
    assert all(r.doc_id == r["first"] + 1000 for r in found)


@pytest.mark.parametrize("words", [20, 24, 29, 34])
def test_equal_short_paragraphs_are_found_wherever_they_stand(spark, words):
    rng = random.Random(words)
    line = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for k in range(50):
        same = line(words)
        for j in range(2):
            docs.append((1000 * j + k, "\n".join(" ".join(x) for x in (line(15), same, line(12)))))
    found = substring_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.first, r.doc_id, r.start, r.n) for r in found} == {(k, 1000 + k, 15, words) for k in range(50)}
