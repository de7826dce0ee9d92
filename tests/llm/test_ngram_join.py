import itertools
import random
from fractions import Fraction

import pytest

from docquarry.llm import graph, ngram_join as nj
from docquarry.llm.common import LOWER, WORD


def brute(rows, n, t):
    """(n_shingles, component) by doc_id, all pairs compared."""
    sets = {}
    for d, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.setdefault(d, []).append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = {d: d for d in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, xs), (b, ys) in itertools.combinations([(d, s) for d, s in sets.items() if d is not None], 2):
        for x, y in itertools.product(xs, ys):
            if x and y and len(x & y) >= t * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in parent}, {d: sorted(map(len, s)) for d, s in sets.items()}


def corpus(seed, size=160):
    r = random.Random(seed)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([0, 1, 2, 3, 4, 5, 12, 30, 80]))] for _ in range(20)]
    rows = []
    for d in range(size):
        words = list(r.choice(base)) if r.random() < 0.8 else [f"v{r.randint(0, 4000)}" for _ in range(r.randint(0, 40))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            if words:
                words[r.randrange(len(words))] = f"x{r.randint(0, 50)}"
        if r.random() < 0.2:
            words = words + r.choice(base)
        rows.append((d, r.choice([" ", "\n", "\t "]).join(words).upper() if r.random() < 0.3 else " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "n", "t"), [(1, 4, Fraction(85, 100)), (2, 5, Fraction(8, 10)), (3, 1, Fraction(1, 2)), (4, 4, Fraction(1))])
def test_equals_all_pairs(spark, seed, n, t):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, x, 7, "clash") for d, x in rows], "doc_id long, text string, n int, digest string")
    want, sizes = brute(rows, n, t)
    got = nj.link_documents(df, n, t).collect()
    assert {g.doc_id: g.component_id for g in got} == want
    assert {g.doc_id: [g.n_shingles] for g in got} == sizes
    kept = {r.doc_id for r in nj.keep_one(df, n, t).collect()}
    assert kept == set(want.values())


def test_a_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(300):
        words = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 6])):
            words[r.randrange(150)] = f"x{r.randint(0, 10**6)}"
        rows.append((d, " ".join(words)))
    want, _ = brute(rows, 4, Fraction(85, 100))
    got = nj.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {g.doc_id: g.component_id for g in got.collect()} == want


def test_odd_rows(spark):
    rows = [(5, "a b c d e f"), (3, "A B C D E F"), (None, "a b c d e f"), (7, None), (8, ""), (9, " \n"), (3, "A B C D E F"), (10, "a b"), (11, "A  B"), (12, "word " * 30_000)]
    got = nj.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=str)
    assert found == sorted([(5, 3, 3), (3, 3, 3), (3, 3, 3), (None, 3, None), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10), (12, 1, 12)], key=str)
    assert nj.link_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
