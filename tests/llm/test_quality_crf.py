import itertools
import random

import numpy as np

from docquarry.llm import quality_crf as q


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    for n in (1, 2, 5):
        s, t = r.normal(size=n) * 2, r.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(s[i] * y[i] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
            total, good = total + p, good + p * np.array(y)
        assert np.allclose(q.marginals(s, t), good / total)


def test_gradient_equals_differences():
    r = np.random.default_rng(2)
    x, mask = r.normal(size=(3, 4, q.WIDTH)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    x *= mask[:, :, None]
    y, w, t = np.array([1.0, 0.0, 1.0]), r.normal(size=q.WIDTH) * 0.1, r.normal(size=(2, 2))

    def likelihood(w, t):
        total = 0.0
        for d in range(3):
            n = mask[d].sum()
            s = x[d, :n] @ w
            z = np.logaddexp.reduce([sum(s[i] * p[i] for i in range(n)) + sum(t[p[i], p[i + 1]] for i in range(n - 1)) for p in itertools.product((0, 1), repeat=int(n))])
            own = int(y[d])
            total += (s.sum() * own + t[own, own] * (n - 1) - z) / np.sqrt(n)
        return total / 3

    gw, gt = q._gradient(x, mask, y, w, t)
    for k in (0, 5, q.WIDTH - 1):
        e = np.zeros(q.WIDTH)
        e[k] = 1e-5
        assert abs((likelihood(w + e, t) - likelihood(w - e, t)) / 2e-5 - gw[k]) < 1e-6
    for a, b in itertools.product((0, 1), repeat=2):
        e = np.zeros((2, 2))
        e[a, b] = 1e-5
        assert abs((likelihood(w, t + e) - likelihood(w, t - e)) / 2e-5 - gt[a, b]) < 1e-6


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = q.classify(docs, labels, sample=1500).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.98
    assert (held[held.quality == 0].predicted == 0).mean() > 0.93
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_only_the_text_and_the_training_fold_count(spark):
    r = random.Random(1)
    rows = [(i, "\n".join(" ".join(r.choice(("ok", "fine", "good")) for _ in range(9)) if i % 2 else "BUY!! NOW!! $$$ ###" for _ in range(5)), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(300)], "doc_id long, quality int, toxic int")
    one = {g.doc_id: g.score for g in q.classify(docs, labels).collect()}
    from docquarry.llm.common import fold_of

    turned = labels.collect()
    turned = spark.createDataFrame([(x.doc_id, 1 - x.quality if fold_of(x.doc_id, 3) == 1 else x.quality, None) for x in turned], labels.schema)
    two = {g.doc_id: g.score for g in q.classify(docs.repartition(7), turned).collect()}
    assert one == two
    assert all((one[i] >= 0.5) == (i % 2 == 1) for i in one)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "a\n\nb", 1), (2, "word " * 30_000, 1), (2, "x\n" * 3000, 1)], "doc_id long, text string, held_out int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = q.classify(docs, none).collect()
    assert len(got) == 5 and {g.score for g in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, quality int")
    assert {g.score for g in q.classify(docs, one).collect()} <= {0.5, 1.0}
    assert q.classify(docs.limit(0), one).count() == 0


def test_lines_far_into_a_text_are_learnt(spark):
    head = "the same plain line begins every text here.\n" * 160
    rows = [(i, head + ("it goes on well and ends like this.\n" if i % 2 else "BUY!! NOW!! $$$ ###\n") * 60) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = q.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert all(g.predicted == g.doc_id % 2 for g in got)


def test_line_features_cover_all_words():
    line = " ".join(["of"] + ["elephant"] * 6) + " "
    own = q.line_features(line * 100 + " ".join(f"word{i}" for i in range(100)))[0][0]
    assert abs(own[q.OWN.index("short_words")] - 100 / 800) < 1e-12
    assert abs(own[q.OWN.index("top_word")] - 600 / 800) < 1e-12


def test_ties_and_repeated_rows(spark):
    rows = [(i % 40, "a plain line of words.\n" * (1 + i % 3) if i % 2 else "BUY!! NOW!! $$$ ###\n" * (1 + i % 3)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(7, 0)], "doc_id long, quality int")
    got = q.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 120
    by_text = {}
    for g in got:
        by_text.setdefault((g.doc_id % 2, g.score), 0)
    assert len(by_text) <= 6 and all((g.score >= 0.5) == (g.doc_id % 2 == 1) for g in got)


def test_features_do_not_hang_on_the_hash_seed():
    import os
    import subprocess
    import sys

    code = "from docquarry.llm.quality_crf import line_features as f; print(f('a b a cc dd ee a b b\\nsame same other')[0].tolist())"
    told = {subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": os.getcwd()}).stdout for seed in ("0", "1", "2")}
    assert len(told) == 1
