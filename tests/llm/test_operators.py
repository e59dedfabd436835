"""The training-data operators against brute force on small tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from floorflow.llm import anomaly, chat, language, lm, mixing, near_dedup, packing, quality, rules, search, substring_dedup
from floorflow.llm.components import components
from floorflow.llm.minhash import loose_edges, tight_edges

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cid string, component string"


def _words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base = _words(rng, 120)
    texts = [" ".join(_words(rng, 60)) for _ in range(25)]
    for k in range(25):  # a chain of edited copies
        edited = list(base)
        for _ in range(k % 5):
            edited[rng.randrange(120)] = "x%d" % rng.randrange(9999)
        texts.append(" ".join(edited))
    texts += ["Same text here with six words", "same TEXT here with six words"] * 3
    texts += [None, "", " \n\t ", "one", "One", "12 345", "word " * 3000, " ".join(_words(rng, 9000))]
    passage = " ".join(_words(rng, 70))
    for k in range(4):
        texts.append(" ".join(_words(rng, 30)) + " " + passage + " " + " ".join(_words(rng, 30 + k)))
    out = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 7 else None, None, "clash", "clash") for i, t in enumerate(texts)]
    return out + [out[3], out[30]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _brute_components(rows):
    sets = {i: _set(t) for i, t, *_ in rows}
    head = {i: i for i in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    head[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def test_near_duplicates_match_brute_force(docs, rows):
    want, sets = _brute_components(rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_an_empty_table(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_clusters_beyond_a_block_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = []
    for k in range(60):
        own = base.copy()
        own[rng.choice(len(own), 2 + k // 3, replace=False)] = rng.integers(0, 2**63, 2 + k // 3, dtype=np.uint64)
        sets.append(np.unique(own))
    table = spark.createDataFrame([(1, k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "cluster long, cid long, shingles binary")

    def parts(pairs):
        head = list(range(60))
        for a, b in pairs:
            x, y = head[a], head[b]
            head = [min(x, y) if h in (x, y) else h for h in head]
        return head

    pairs = [
        (a, b)
        for a in range(60)
        for b in range(a)
        if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 75 * (len(sets[a]) + len(sets[b]) - n)
    ]
    got = [(r.u, r.v) for r in tight_edges(table, block_rows=7).collect()]
    assert parts(got) == parts(pairs)


def test_substring_dedup_finds_the_passage_and_leaves_the_rest(docs, rows, empty):
    spans = substring_dedup.repeated_spans(docs).collect()
    hit = {r.doc_id for r in spans}
    planted = [i for i, *_ in rows[-6:-2]]
    assert set(planted[1:]) <= hit and planted[0] not in hit
    assert not hit & set(range(25))
    kept = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert all(kept[i] == t for i, t, *_ in rows[:25])
    assert len(kept[planted[1]]) < len(dict((r[0], r[1]) for r in rows)[planted[1]])
    assert substring_dedup.remove_repeats(docs).columns == docs.columns
    assert substring_dedup.repeated_spans(empty).count() == 0


def test_packing_is_an_exact_round_trip(docs, rows, empty):
    from floorflow.llm.queries import tokenizer_path

    path = tokenizer_path()
    got = packing.pack(docs.dropDuplicates(["doc_id"]), path).toPandas()
    tool = packing.tokens_of(path).tokenizer
    for i, text in {r[0]: r[1] for r in rows}.items():
        ids = np.array(tool.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own.itertuples())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 4096
    assert 4096 * got.sequence_id.nunique() - got.length.sum() < 4096
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "İstanbul don't 'S l'été", "½ Ⅷ x́y \x1c a\x1cb   c", "word$$$ 12.5%"])
def test_word_tokens_equal_whole_texts(text):
    from floorflow.llm.queries import tokenizer_path

    tool = packing.tokens_of(tokenizer_path())
    assert np.frombuffer(tool.encode([text])[0], tool.width).tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids


def test_mixing_spends_the_budget(docs, empty):
    got = mixing.mix_sources(docs, mixing.WEIGHTS, fraction=0.5, max_epochs=2).toPandas()
    total = docs.select(mixing.word_count(docs.text).alias("n")).toPandas().n.sum()
    assert abs(got.take_tokens.sum() - total // 2) <= 1
    assert got.epoch.max() <= 2
    assert mixing.mix_sources(empty, mixing.WEIGHTS).count() == 0


def test_language(docs, spark, empty):
    rng = random.Random(5)
    syllables = {"aa": "ka lo mi tu", "bb": "ßer üng sch pf"}
    rows = [
        (k, " ".join("".join(rng.choices(syllables[n].split(), k=3)) for _ in range(30)), n)
        for k, n in enumerate(["aa", "bb"] * 30)
    ] + [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identified(frame).collect()}
    assert all(got[k].lang_pred == n for k, _, n in rows[:60])
    assert all(got[k].lang_pred == "und" and got[k].rejected for k in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identified(docs).count() == docs.count()
    assert language.identified(empty).count() == 0


def test_rule_counts_by_hand():
    text = "a b c d e f g h\na b c d e f g h\nx # y\n\n"
    counts, _ = rules.statistics(text.encode())
    assert counts == [19, 19, 1, 1, 16]


def test_quality_operators(docs, spark, empty):
    labels = spark.createDataFrame([(i, int(i < 40), 0) for i in range(70)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    ranked = quality.ranked(docs, labels).collect()
    assert len(ranked) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in ranked)
    assert {r.score for r in quality.ranked(docs, none).collect()} == {0.5}
    verdicts = anomaly.quality_rules(docs, labels).collect()
    assert all(not (r.base_failed and r.kept) for r in verdicts) and len(verdicts) == docs.count()
    assert all(r.kept != r.base_failed for r in anomaly.quality_rules(docs, none).collect())
    assert quality.ranked(empty, labels).count() == 0 and anomaly.quality_rules(empty, labels).count() == 0


def test_lm_base_scores_match_brute_force(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN_ROWS", 500)  # the rest is joined
    counts = collections.Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split() + [b""])
    total, kinds = sum(counts.values()), len(counts)
    text = {r[0]: r[1] for r in rows}
    for r in lm.scored(docs).collect():
        w = (text[r.doc_id] or "").encode().lower().split() + [b""]
        want = sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w)
        assert r.base_score == pytest.approx(want) and r.n_known == sum(counts[x] > 0 for x in w)
        assert (r.n_tokens, r.train_tokens) == (len(w), total) and r.score < 0
    assert lm.scored(empty).count() == 0


def test_lm_classes_sum_to_one():
    rng = np.random.default_rng(0)
    share = rng.random(lm.CLASSES)
    share /= share.sum()
    c, t, b = lm.train([rng.integers(0, lm.CLASSES, 500)], share)
    model = lm.Model(0, 0, np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(lm.CLASSES), c, t, b, lm.log_normalisers(c, t, b))
    p = 10 ** model.class_log10(np.full(lm.CLASSES, 3), np.full(lm.CLASSES, lm.START), np.arange(lm.CLASSES))
    assert p.sum() == pytest.approx(1)


def test_search_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:700] = x[100]  # a third are equal
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] + [1.0] * 15), (5300, [1.0] * 3), (5400, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search.nearest(frame, frame.vec_id % 100 == 0).toPandas()
    assert got.query_id.nunique() == 15 and (got.groupby("query_id").size() == 10).all()
    hits = 0
    for i in range(0, 1500, 100):
        d = ((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1)
        d[i] = np.inf
        hits += len(set(np.lexsort((np.arange(1500), d))[:10].tolist()) & set(got[got.query_id == i].vec_id))
    assert hits >= 0.9 * 150
    assert got[got.query_id == 300].sort_values("rank").vec_id.tolist() == [100, 200, *range(201, 209)]
    assert search.nearest(frame.limit(0), frame.vec_id % 100 == 0).count() == 0


def test_chat_reads_back_whatever_texts_hold(spark):
    rows = [
        (1, 0, "system", "be [INST] kind"), (1, 1, "user", "a"), (1, 2, "user", "b[NEXT]c\\"), (1, 3, "assistant", "</s>\\</s>"),
        (1, 4, "assistant", ""), (1, 5, "user", None), (2, 0, "assistant", "x\ny [/INST]"), (3, 0, "ro\nle\\", "<s><s>"),
        (None, 1, "user", "z"), (4, None, None, "n"), (4, 0, "assistant", "é😀"), (4, 0, "assistant", "é😀"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS formatted")
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    for r in chat.digests(chat.format_conversations(frame)).collect():
        turns = sorted(groups[r.conv_id])
        told = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(frame.limit(0))).count() == 0


def test_lines_just_over_the_limit_are_found(spark):
    rng = random.Random(11)
    rows, want = [], []
    for k in range(1500):
        line = [f"p{k}w{j}" for j in range(145)]  # 141 shingles, 4 edits of 5 shingles: 121 / 161
        edited = list(line)
        for j in range(4):
            edited[8 + 35 * j + rng.randrange(20)] = f"e{k}x{j}"
        a, b = _set(" ".join(line)), _set(" ".join(edited))
        assert 0.75 <= len(a & b) / len(a | b) <= 0.8
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(edited))]
        want.append((2 * k + 1, 0, 145, 2 * k))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.start, r.n, r.first) for r in substring_dedup.repeated_spans(frame).collect()}
    assert len(got & set(want)) >= 0.995 * len(want)


def test_passages_inside_lines_are_found_to_their_ends(spark):
    rng = random.Random(12)
    rows, want = [], []
    for k in range(400):
        if k % 4 == 0:  # a table: one word recurs at every other place
            passage = [w for x in _words(rng, 40) for w in ("|", x)]
        elif k % 4 == 1:  # few words recur
            passage = ["|", "-", f"p{k}"] * 17
        else:
            passage = _words(rng, 51 if k % 4 == 2 else 35)
        texts = [[*_words(rng, 30 + rng.randrange(40)), *passage, *_words(rng, 30 + rng.randrange(40))] for _ in range(2)]
        gap = "\n" if k % 8 == 2 else " "  # short lines or a long one
        rows += [(2 * k + j, gap.join(" ".join(t[i : i + 9]) for i in range(0, len(t), 9))) for j, t in enumerate(texts)]
        old, new = texts
        a, b = (next(i for i in range(len(t)) if t[i : i + len(passage)] == passage) for t in texts)
        n = len(passage)
        while old[a - 1] == new[b - 1]:
            a, b, n = a - 1, b - 1, n + 1
        while old[a + n] == new[b + n]:
            n += 1
        want.append((2 * k + 1, b, n, 2 * k))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.start, r.n, r.first) for r in substring_dedup.repeated_spans(frame).collect()]
    assert sorted(got) == want


def test_lm_matrices_are_fitted_on_all_training_documents(spark, monkeypatch):
    rng = random.Random(13)
    texts = [" ".join(_words(rng, 5 + i % 4)) for i in range(2500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fitted, real = [], lm.train_counts
    monkeypatch.setattr(lm, "train_counts", lambda key, times, share: (fitted.append((key, times)), real(key, times, share))[1])
    model, _ = lm.fit(frame, frame.doc_id >= 0)
    key, times = fitted[0]
    assert times.sum() == model.tokens == sum(len(t.split()) + 1 for t in texts)
    assert (np.diff(key) > 0).all()
    first = key // lm.CLASSES == lm.START * (lm.CLASSES + 1) + lm.START
    assert times[first].sum() == len(texts)


def test_hot_buckets_lose_no_link(spark):
    rng = np.random.default_rng(21)
    sigs = []
    for _ in range(100):  # pairs of equal signatures that share a bucket and nothing else
        own = bytes(rng.integers(0, 256, 200, dtype=np.uint8))
        sigs += [own, own]
    names = rng.permutation(200).tolist()
    table = spark.createDataFrame([(c, bytearray(s)) for c, s in zip(names, sigs)], "cid long, sig binary")
    entries = table.selectExpr("1L AS g", "cid").unionByName(table.selectExpr("1L AS g", "cid"))
    want = {frozenset(names[2 * k : 2 * k + 2]) for k in range(100)}
    for bucket_rows in (4000, 20, 7):
        got = loose_edges(entries, table.unionByName(table), bucket_rows).collect()
        assert {frozenset((r.u, r.v)) for r in got} == want


ODD = [
    (3, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "q w e r t y u i o p"), (5, "q w e r t y u i o p"),
    (None, "z1 z2 z3 z4 z5 z6 z7"), (None, "z1 z2 z3 z4 z5 z6 z7"), (None, "Q W e r t y u i o p"), (None, None), (8, None), (9, ""),
]


def test_near_copies_are_told_by_id_and_text(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'x' AS tid", "1 AS n", "'y' AS `class`", "2L AS doc")
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(frame).collect()), key=str)
    assert kept == sorted(
        [(3, "a b c d e f g h"), (5, "q w e r t y u i o p"), (None, "z1 z2 z3 z4 z5 z6 z7"), (None, None), (8, None), (9, "")], key=str
    )
    assert near_dedup.drop_near_duplicates(frame).columns == frame.columns


def test_a_class_without_ids_is_linked(spark):
    words = [f"w{k}" for k in range(100)]
    edited = list(words)
    edited[50] = "other"
    frame = spark.createDataFrame([(7, " ".join(words)), (None, " ".join(edited))], "doc_id long, text string")
    assert [r.doc_id for r in near_dedup.drop_near_duplicates(frame).collect()] == [7]


def test_repeats_with_clashing_columns_and_ids(spark):
    rng = random.Random(31)
    passage = " ".join(_words(rng, 60))
    lead = [" ".join(_words(rng, 40)) for _ in range(4)]
    rows = [(1, f"{lead[0]} {passage}"), (2, f"{lead[1]} {passage}"), (2, lead[2]), (2, f"{lead[1]} {passage}"), (None, f"{lead[3]} {passage}"), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7L AS tid", "'s' AS spans", "0 AS span_doc", "'k' AS span_tid")
    got = sorted(((r.doc_id, r.text, r.tid, r.spans) for r in substring_dedup.remove_repeats(frame).collect()), key=str)
    want = [(1, rows[0][1]), (2, f"{lead[1]} "), (2, f"{lead[1]} "), (2, lead[2]), (None, rows[4][1]), (4, None)]
    assert [(g[0], (g[1] or "").strip()) for g in got] == [(w[0], (w[1] or "").strip()) for w in sorted(want, key=str)]
    assert all(g[2:] == (7, "s") for g in got)


def test_conflicting_labels_and_null_ids(docs, spark):
    labels = spark.createDataFrame(
        [(i, int(i < 40)) for i in range(70)] + [(0, 0), (None, 1), (1, 5), (2, None)] * 3, "doc_id long, quality int"
    )
    a, b = (sorted(map(tuple, anomaly.quality_rules(docs, x).collect()), key=str) for x in (labels, labels.orderBy(labels.quality.desc())))
    assert a == b
    nulls = docs.withColumn("doc_id", docs.doc_id.cast("string").cast("long") * None)
    assert anomaly.quality_rules(nulls, labels).count() == docs.count() == quality.ranked(nulls, labels).count()
    assert lm.scored(nulls).count() == docs.count() == language.identified(nulls).count()


def test_most_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(k * 7919 % 10007 - 5000, 1 + 1000 // (k + 1)) for k in range(10000)], "h long, n long")
    top = lm._most_frequent(counts, 500).toPandas()
    assert 300 <= len(top) <= 700 and top.n.max() == 1001


def test_lm_scores_match_the_formula(docs, rows):
    """score is the sum of P(class | two classes) and of the word's share of
    its class, over every token."""
    model, counts = lm.fit(docs, lm.crc_mod("doc_id", 7) != 2)
    n = {r.h: r.n for r in counts.collect()}
    text = {r[0]: (r[1] or "") for r in rows}
    for r in lm.score(docs, model, counts).collect():
        if r.doc_id % 5:
            continue
        w = text[r.doc_id].encode().lower().split() + [b""]
        h = np.array([lm.word_hash(x) for x in w], np.uint64)
        cls = model.look_up(h, np.array([lm.tail_class(x) for x in w]))[1].tolist()
        past, want = [lm.START, lm.START], 0.0
        for c, x in zip(cls, h.view(np.int64).tolist()):
            want += float(model.class_log10(np.array([past[-1]]), np.array([past[-2]]), np.array([c]))[0])
            if c >= lm.HEAD:
                want += math.log10(n.get(x, 0) + 1) - model.log_tail[c]
            past.append(c)
        assert r.score == pytest.approx(want)


def test_forest_paths_match_walks(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(400, 5)), rng.normal(6, 1, size=(8, 5))])
    forest = anomaly.Forest(x)
    score = forest.score(x)
    for i in (0, 17, 403):
        total = 0.0
        for t in range(anomaly.TREES):
            node = 0
            for _ in range(anomaly.DEPTH):
                node = 2 * node + 1 + int(x[i, forest.feature[t, node]] > forest.cut[t, node])
            total += forest.path[t, node - (2**anomaly.DEPTH - 1)]
        assert score[i] == pytest.approx(2 ** (-total / anomaly.TREES / forest.unit))
    assert score[400:].min() > np.quantile(score[:400], 0.99)


def test_rule_counts_match_brute_force(docs, spark):
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(70)], "doc_id long, quality int")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in anomaly.quality_rules(docs, labels).collect():
        t = text[r.doc_id]
        w = t.split()
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines, seen, dup = [x for x in t.split("\n") if x.split()], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_ranking_parts_labels(spark):
    rng = random.Random(40)
    good = [" ".join(_words(rng, 80)) + "." for _ in range(60)]
    bad = ["$$ | # " + " ".join(rng.choice("abc") for _ in range(60)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate([x for p in zip(good, bad) for x in p])), "doc_id long, text string")
    labels = frame.selectExpr("doc_id", "CAST(1 - doc_id % 2 AS INT) AS quality", "0 AS toxic")
    got = quality.ranked(frame, labels).collect()
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got)  # ties: equal texts get equal scores
    assert {r.held_out for r in got} == {True, False}


def test_language_matches_brute_force(docs):
    model = language.fit(docs, language.crc_mod("doc_id", 5) != 0)
    for r in language.identify(docs, model).collect()[:40]:
        t = next(x.text for x in docs.where(docs.doc_id == r.doc_id).limit(1).collect()) or ""
        counts, letters = language.gram_counts([t])
        if not letters[0]:
            assert r.lang_pred == "und" and r.rejected
            continue
        v = language.unit_vectors(counts, model.idf)[0]
        cosine = [max(float(v @ c) for c, o in zip(model.centroids, model.owner) if o == k) for k in range(len(model.languages))]
        assert r.lang_pred == model.languages[int(np.argmax(cosine))] and r.cosine == pytest.approx(max(cosine), abs=1e-5)


def test_packing_takes_the_cheapest_sequence_with_room():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 900, 200)
    pieces = packing.assign(lengths, 1000)
    count = -(-int(lengths.sum()) // 1000)
    cost, room = [0.0] * count, [1000] * count
    for doc, start, n, sequence, offset in pieces:
        if n == lengths[doc]:
            fits = [cost[k] for k in range(count) if room[k] >= n]
            assert cost[sequence] == min(fits)
        assert offset == 1000 - room[sequence]
        cost[sequence] += n + n * n / 1000
        room[sequence] -= n
    assert min(room) >= 0 and sum(room) < 1000
    whole = [p for p in pieces if p[1] == 0]
    assert [lengths[p[0]] for p in whole] == sorted(lengths, reverse=True)


def test_packing_deals_copies_and_empty_texts_out(spark):
    from floorflow.llm.queries import tokenizer_path

    frame = spark.range(3000).selectExpr("1L AS doc_id", "'' AS text", "id AS part")
    got = packing.pack(frame, tokenizer_path(), group_chars=16_000).toPandas()
    assert len(got) == 3000 and got.groupby(got.sequence_id.to_numpy() >> 32).size().max() < 1000


def test_lm_tasks_look_a_word_up_once_for_many_tokens(monkeypatch):
    """Words are hashed and looked up once for a chunk of texts, and triples of
    all of a task's chunks come out added up."""
    import pyarrow as pa

    texts = [b"a b C\x1c \xff\xc3\x84.\t", b"", b" \n ", b"A b b"] * 500
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    words = [w for t in texts for w in t.lower().split() + [b""]]
    hashed, asked, real, look_up = [], [], lm.word_hash, lm.Model.look_up
    monkeypatch.setattr(lm, "word_hash", lambda w: (hashed.append(w), real(w))[1])
    monkeypatch.setattr(lm.Model, "look_up", lambda m, h, t: (asked.extend(h.tolist()), look_up(m, h, t))[1])
    counted = pa.Table.from_batches(lm._count(iter([batch]))).to_pydict()
    want = collections.Counter(words)
    assert dict(zip(counted["h"], counted["n"])) == {int(np.uint64(real(w)).astype(np.int64)): n for w, n in want.items()}
    assert dict(zip(counted["h"], counted["tail"])) == {int(np.uint64(real(w)).astype(np.int64)): lm.tail_class(w) for w in want}
    z, share = np.zeros, np.full(lm.CLASSES, 1 / lm.CLASSES)
    c, t, b = z((2, lm.CLASSES + 1, lm.DIMS)), z((lm.CLASSES, lm.DIMS)), np.log(share)
    model = lm.Model(0, 0, z(0, np.uint64), z(0, np.int64), z(0, np.int64), z(lm.CLASSES), c, t, b, lm.log_normalisers(c, t, b))
    found = pa.Table.from_batches(lm._triple_counts(model)(iter([batch, batch]))).to_pydict()
    assert sum(found["n"]) == 2 * len(words) and len(set(found["key"])) == len(found["key"])
    rows = pa.Table.from_batches(lm._score(model)(iter([batch]))).to_pylist()
    for r, x in zip(rows, texts):
        own = collections.Counter(x.lower().split() + [b""])
        assert r["n_tokens"] == own.total() and r["score0"] == pytest.approx(-own.total() * math.log10(lm.CLASSES))
        assert dict(zip(r["h"], r["times"])) == {int(np.uint64(real(w)).astype(np.int64)): n for w, n in own.items()}
    assert len(asked) == 3 * len(want) and len(hashed) == 4 * len(want)


@pytest.mark.parametrize("large", [False, True])
def test_lm_tokens_are_what_bytes_split_into(large):
    import pyarrow as pa

    rng, kind = random.Random(5), pa.large_binary() if large else pa.binary()
    for _ in range(300):
        alphabet = bytes(rng.sample(range(256), 4)) + b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0aA.,"
        texts = [bytes(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(rng.randrange(1, 9))]
        t = lm.Tokens.of(pa.array([b"left out", *texts], kind).slice(1))
        words = [x.lower().split() + [b""] for x in texts]
        assert t.sizes.tolist() == list(map(len, words))
        assert t.hash[t.word].tolist() == [lm.word_hash(w) for own in words for w in own]
        assert t.tail[t.word].tolist() == [lm.tail_class(w) for own in words for w in own]
