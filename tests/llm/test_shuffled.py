"""What op1 shuffles: as much whether or not its sides are small, and words of wanted rows only."""

import random

import pytest

from floorflow.llm import common, substring_dedup


def _docs(spark, n):
    rng = random.Random(n)
    line = lambda k: " ".join(f"w{rng.randrange(10**7)}" for _ in range(k))
    docs = []
    for k in range(n):
        passage = line(40)
        docs += [(10 * k + j, f"{line(300)} {passage} {line(100)}") for j in range(2)]
        docs += [(10 * k + j, line(400)) for j in range(2, 6)]
    return spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)


def _shuffled(spark, run):
    """What ``run`` gives and the bytes of shuffle files written meanwhile."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = sc.statusStore().stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    before = written()
    out = run()
    return out, sum(v for k, v in written().items() if k not in before)


def test_what_grows_is_shuffled_alike_at_every_size(spark, monkeypatch):
    """Whether or not what repeats fits a broadcast, the same bytes move."""
    n, moved = 200, []
    digested = substring_dedup._keyed(_docs(spark, n)).mapInArrow(
        substring_dedup._digested(substring_dedup.LINE_WORDS), substring_dedup._DIGESTED
    )
    cuts = common.materialize(digested, "test-cuts")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for bound in (common.BROADCAST_BYTES, 9_000):
            monkeypatch.setattr(common.small, "__defaults__", (bound,))
            found, size = _shuffled(
                spark, lambda: {(r.doc_id, r["first"]) for r in substring_dedup._short_hits(cuts).collect()}
            )
            assert found == {(10 * k + 1, 10 * k) for k in range(n)}
            moved.append(size)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved[1] < 5**0.15 * moved[0]


@pytest.mark.parametrize("rows", [3, 40_000])
def test_words_are_read_of_the_wanted_rows_only(spark, rows):
    cuts = common.materialize(
        spark.range(0, rows, 1, 3).selectExpr(
            "id as doc_id", "id * 7 as tid", "monotonically_increasing_id() as row", "cast(string(id) as binary) as words"
        ),
        "test-cuts",
    )
    for wanted in ("doc_id % 3 = 1", "doc_id in (0, 2)", "true", "false"):
        named = common.materialize(cuts.where(wanted).select("row"), "test-wanted")
        got = [tuple(r) for r in substring_dedup._words_of(cuts, named).orderBy("doc_id").collect()]
        assert got == [tuple(r) for r in cuts.where(wanted).orderBy("doc_id").collect()]
