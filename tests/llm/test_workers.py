"""What Python workers do and hold: one of them a task, and steps of bounded memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from floorflow.llm import packing, queries, substring_dedup
from floorflow.llm.queries import tokenizer_path


def test_repeats_are_cut_by_one_worker_of_a_task(spark):
    """The filter on what is left reads the cut texts and doesn't cut them again."""
    rng = random.Random(5)
    line = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    passage = line(60)
    rows = [(1, f"{line(9)} é\n{passage}", 0), (2, f"ü\n{passage}\n{line(9)}", 0), (3, passage, 0), (4, line(60), 0), (5, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    kept = substring_dedup.remove_repeats(docs)
    assert str(kept._jdf.queryExecution().optimizedPlan()).count("EvalPython") == 1
    got = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    cut = rows[1][1].replace(passage, "")
    assert got == {1: rows[0][1:], 2: (cut, len(cut)), 4: rows[3][1:], 5: rows[4][1:]}


def test_tokenizing_steps_are_small():
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(300)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([0] * 1000), pa.array(texts)], names=["doc_id", "part", "text"])
    tool = packing.tokens_of(tokenizer_path())
    whole = tool.encode(texts)
    tool.parts = {"": b""}
    run = packing._tokenize(tokenizer_path(), packing.END)([batch])
    tracemalloc.start()
    try:
        steps = [len(b) for b in run]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(steps) == 1000 and most < 67_000_000, most
    again = [x for b in packing._tokenize(tokenizer_path(), packing.END)([batch]) for x in b.column(2).to_pylist()]
    assert [x[:-2] for x in again] == whole


def test_ids_are_gathered_without_numbers_for_each_token():
    """What a step holds besides Arrow's own arrays grows with its words, not with several numbers a token."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) + rng.choice(["", "", "!", "é-x"]) for _ in range(500)]
    texts = pa.array([None, "", *(" ".join(rng.choices(words, k=300)) for _ in range(400)), " "])
    tool = packing.tokens_of(tokenizer_path())
    tool.encode_array(texts, packing.END)
    tracemalloc.start()
    try:
        got = tool.encode_array(texts, packing.END)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got.validate(full=True)
    for text, ids in zip(texts.to_pylist(), got.to_pylist()):
        want = tool.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, tool.width).tolist() == [*want, packing.END]
    assert most < 3_000_000, most
    assert tool.encode_array(texts).to_pylist() == [x[:-2] for x in got.to_pylist()]
    assert tool.encode_array(texts.slice(0, 2)).to_pylist() == [b"", b""]
    assert len(tool.encode_array(texts.slice(0, 0), packing.END)) == 0


def test_passages_are_looked_for_in_small_batches(spark, tmp_path, monkeypatch):
    """op1's tasks get 1,000 texts at once, as the pipeline's do, in a session that sets no number."""
    own = substring_dedup._digested

    def watched(line_words):
        def run(batches):
            def held():
                for batch in batches:
                    assert batch.num_rows <= 1000, batch.num_rows
                    yield batch

            yield from own(line_words)(held())

        return run

    monkeypatch.setattr(substring_dedup, "_digested", watched)
    rng = random.Random(7)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    texts = {0: passage, 2999: f"x y\n{passage}"}
    rows = [(k, texts.get(k, f"text {k}")) for k in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        got = [tuple(r) for r in queries.op1_substring_dedup(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set(name, before)
    assert got == [(2999, 0, 2, 60)]
