import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from docquarry.llm import lm_score as lm
from docquarry.llm import subwords
from docquarry.llm.common import LOWER, WORD, fold_of


def brute_base(rows):
    words = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    counts = Counter(w for (d, _), ws in zip(rows, words) if fold_of(d, 5) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(len(ws), sum(counts[w] > 0 for w in ws), n, math.fsum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws in words]


def model(seed=3):
    r = np.random.default_rng(seed)
    weights = lm.fresh_weights(seed)
    weights["u"] *= 10
    classes = np.concatenate([np.arange(lm.CLASSES), r.integers(0, lm.CLASSES, lm.VOCAB - lm.CLASSES)])
    pairs = r.integers(0, 5, (lm.VOCAB, lm.CLASSES + 1))
    return weights, classes, *lm.make_tables(pairs, classes)


def test_each_subword_is_scored_once():
    for n in (0, 1, 22, 23, 24, 25, 47, 48, 49, 500):
        ids = np.arange(n)
        x, y, seen = lm.padded(ids)
        assert y[seen].tolist() == [*range(n), lm.MARK]
        assert x[:, lm.CONTEXT :][seen].tolist() == [lm.MARK, *range(n)]
        whole = [lm.MARK] * (lm.CONTEXT + 1) + list(range(n))
        assert all(row[: min(len(row), len(whole) - 24 * i)].tolist() == whole[24 * i : 24 * i + lm.WINDOW] for i, row in enumerate(x))


def test_probabilities_sum_to_one_and_look_back_only():
    m = lm.Model(*model())
    r = np.random.default_rng(5)
    x = lm.padded(r.integers(0, 2000, 20))[0][:1]
    at, total = 10, 0.0
    for i in range(0, lm.VOCAB, 600):
        every = np.arange(i, min(i + 600, lm.VOCAB))
        y = np.zeros((len(every), lm.STRIDE), np.int64)
        y[:, at] = every
        total += np.exp(m.window_scores(np.repeat(x, len(every), 0), y)[:, at].astype(float)).sum()
    assert abs(total - 1) < 1e-3
    other = x.copy()
    other[:, lm.CONTEXT + at + 1 :] = 7
    y = np.full((1, lm.STRIDE), 3)
    assert np.allclose(m.window_scores(x, y)[:, : at + 1], m.window_scores(other, y)[:, : at + 1], atol=1e-5)
    other = x.copy()
    other[:, 3] = 7
    assert not np.allclose(m.window_scores(x, y), m.window_scores(other, y), atol=1e-6)


def test_training_and_scoring_agree():
    w, classes, table, share = model()
    r = np.random.default_rng(9)
    x, y, seen = lm.padded(r.integers(0, 300, 60))
    loss, _, _ = lm.train_step(w, table, x, classes[y], seen)
    got = lm.Model(w, classes, table, share).window_scores(x, y) - share[y]
    assert abs(-(got * seen).sum() / seen.sum() - loss) < 1e-4


def test_gradient_equals_differences():
    w, classes, table, _ = model()
    w = {n: a.astype(np.float64) for n, a in w.items()}
    r = np.random.default_rng(6)
    x, y, seen = r.integers(0, 50, (3, lm.WINDOW)), r.integers(0, lm.CLASSES, (3, lm.STRIDE)), r.random((3, lm.STRIDE)) < 0.8
    table = table.astype(np.float64)
    _, g, rows = lm.train_step(w, table, x, y, seen)
    for name, spot in (("q", (1, 2)), ("k", (3, 1)), ("v", (0, 5)), ("u", (2, 7)), ("e", (int(x[0, 12]), 4)), ("e", (int(x[1, 2]), 3))):
        low, high = ({n: a.copy() for n, a in w.items()} for _ in range(2))
        low[name][spot] -= 1e-4
        high[name][spot] += 1e-4
        rise = (lm.train_step(high, table, x, y, seen)[0] - lm.train_step(low, table, x, y, seen)[0]) / 2e-4
        mine = g[name][np.searchsorted(rows, spot[0]), spot[1]] if name == "e" else g[name][spot]
        assert abs(rise - mine) < 1e-4 * max(1, abs(rise))


def test_base_equals_brute_force_and_training_helps(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: w for (d, _), w in zip(rows, brute_base(rows))}
    for head in (10**6, 300):  # all words at hand, or most of them joined
        got = lm.score_documents(docs, head=head, rounds=1 if head > 300 else 0).collect()
        for g in got:
            n, known, total, base = want[g.doc_id]
            assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (n, known, total, fold_of(g.doc_id, 5) == 1)
            assert abs(g.base_score - base) < 1e-6 * abs(base)
        held = sum(g.score for g in got if g.held_out)
        if head > 300:
            trained = held
    assert trained > held  # of held-out texts, with attention and without its training
    encode = subwords.shared().encode
    assert {g.doc_id: g.n_subwords for g in got} == {d: len(encode(t)) + 1 for d, t in rows}


def test_weights_do_not_hang_on_partitions_and_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 3000").select("doc_id", "text")
    few, many, untrained = ({g.doc_id: g for g in lm.score_documents(docs.repartition(n), rounds=k).collect()} for n, k in ((4, lm.ROUNDS), (32, lm.ROUNDS), (4, 0)))
    assert all(abs(few[d].score - many[d].score) <= 1e-9 * abs(few[d].score) for d in few)
    held = [d for d, g in few.items() if g.held_out]
    per = lambda got: sum(got[d].score for d in held) / sum(got[d].n_subwords for d in held)
    assert per(few) > per(untrained) + 0.05  # log10 a subword


def test_held_out_texts_gain_over_the_table_alone(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 3000").select("doc_id", "text")
    got = lm.score_documents(docs).filter("held_out").collect()
    fresh = lm.fresh_weights
    monkeypatch.setattr(lm, "fresh_weights", lambda: {n: a * (n != "u") for n, a in fresh().items()})
    alone = lm.score_documents(docs, rounds=0).filter("held_out").collect()
    n = sum(g.n_subwords for g in got)
    assert sum(g.score for g in got) / n > sum(g.score for g in alone) / n + 0.05


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (None, "a b"), (2, "x " * 20_000), (6, "The THE the"), (6, "The THE the")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, score int")
    got = lm.score_documents(docs).collect()
    assert sorted((g.doc_id is None, g.n_tokens, round(g.base_score, 6)) for g in got) == sorted((d is None, n, round(b, 6)) for (d, _), (n, _, _, b) in zip(rows, brute_base(rows)))
    assert all(g.score < 0 and math.isfinite(g.score) for g in got)
    assert lm.score_documents(docs.limit(0)).count() == 0
    r = random.Random(1)
    held = [d for d in range(100) if fold_of(d, 5) == 1][:3]
    only = spark.createDataFrame([(d, f"w{r.random()}") for d in held], "doc_id long, text string")
    assert {g.train_tokens for g in lm.score_documents(only).collect()} == {0}


def test_every_window_of_the_training_texts_is_trained_on(spark, monkeypatch):
    encode, r = subwords.shared().encode, random.Random(4)
    kept = [d for d in range(60) if fold_of(d, 5) != 1]
    rows = [(d, " ".join(r.choice(("river", "stone", "lamp", "cloud")) + str(r.randrange(10**6)) for _ in range(150))) for d in kept]
    seen, train = [], lm._train_round
    monkeypatch.setattr(lm, "_train_round", lambda texts, weights, *how: seen.append((weights, train(texts, weights, *how))) or seen[-1][1])
    assert lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    ids = sorted({i for _, t in rows for i in encode(t)})
    before, after = seen[0][0]["e"], seen[-1][1]["e"]
    assert len(ids) > 300 and (before[ids] != after[ids]).any(1).all()


def test_words_are_those_of_the_pattern_and_are_counted_once_a_task():
    texts = ["", " ", "a", " A\tb\x0bB\x0c\r\n", "x\x1cy\x85z\xa0w É é", "  two  two ", "ẞ q\x00r", "\x1f"] * 3
    words, n = lm.words_of(pa.array(texts))
    want = [WORD.findall(t.translate(LOWER)) for t in texts]
    assert n.tolist() == list(map(len, want)) and words.to_pylist() == [w for ws in want for w in ws]
    counts = lm.WordCounts()
    for i in range(0, len(texts), 5):
        counts.add(pa.array(texts[i : i + 5]))
    every = Counter(w for ws in want for w in ws) + Counter({lm.END: len(texts)})
    got = dict(zip(*(a.tolist() for a in counts.taken())))
    assert got == {int(lm.word_hashes(pa.array([w]))[0]): c for w, c in every.items()}
    assert [len(a) for a in counts.taken()] == [0, 0]  # nothing is handed on twice
