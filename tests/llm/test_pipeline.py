import itertools
import math
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from docquarry.llm import quality_rules, subwords
from docquarry.llm.common import LOWER, WORD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = after.collect()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(rows, docs.schema)
        out.append(rows)
    return out


def test_quality_stage(steps):
    import zstandard

    z = zstandard.ZstdCompressor(level=quality_rules.LEVEL)

    def good(text):
        n, *_, repeated = quality_rules.base_measures(text)
        return n >= 50 and 100 * repeated <= 50 * n and quality_rules.compression_verdict(text.encode(), z)[3] is None

    assert sorted(r.doc_id for r in steps[1]) == sorted(r.doc_id for r in steps[0] if good(r.text))


def test_line_stage(spark, steps):
    """Equal to the brute-force version of line dedup, by whole lines and sentences of lines."""
    from test_line_dedup import brute, hash_of

    hash_of.update({r.t: r.h for r in spark.createDataFrame([(r.text,) for r in steps[1]], "t string").select("t", F.xxhash64("t").alias("h")).collect()})
    want = {k: t for k, t in brute([(r.doc_id, r.text) for r in steps[1]]).items() if WORD.search(t)}
    assert {r.doc_id: r.text for r in steps[2]} == {d: t for (d, _), t in want.items()}
    assert all(r.n_chars == len(r.text) for r in steps[2])
    assert any(t != old for (_, old), t in want.items())


def test_near_duplicate_stage(steps):
    sets = {}
    for r in steps[2]:
        w = WORD.findall(r.text.translate(LOWER))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    assert sorted(r.doc_id for r in steps[3]) == sorted({root(d) for d in sets})


def test_decontamination_stage(spark, steps):
    toks = lambda x: [w for w in re.split(r"[\W_]+", x.lower()) if w]
    items = [toks(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        a = toks(text)
        for b in items:
            w = min(13, len(b))
            for shift in range(-len(b), len(a)):
                same = [0 <= shift + k < len(a) and a[shift + k] == b[k] for k in range(len(b))]
                if sum(same) >= 9 and max(sum(same[k : k + w]) for k in range(len(b) - w + 1)) >= math.ceil(0.8 * w - 1e-9):
                    return True
        return False

    kept = {r.doc_id for r in steps[4]}
    gone = [r for r in steps[3] if r.doc_id not in kept]
    assert all(leaks(r.text) for r in gone)
    verbatim = [r for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(v.text in r.text for v in verbatim for r in steps[4])


def test_packing_stage(steps):
    encode = subwords.shared().encode
    want = {r.doc_id: len(encode(r.text)) + 1 for r in steps[4]}
    got = {}
    for p in steps[5]:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
        assert p.offset + p.length <= 1024
    assert got == want


def test_run_equals_the_chain(spark, steps):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in got) == sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in steps[5])


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_every_stage(spark):
    import random

    r = random.Random(3)
    prose = lambda n: ". ".join(" ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(10)) for _ in range(n // 10))
    clean, shared, long = prose(120), prose(80), prose(60_000)
    rows = [(1, clean), (1, clean), (2, None), (3, ""), (None, prose(100)), (None, None), (4, shared), (5, prose(90) + ".\n" + shared), (6, long), (7, clean + " x"), (None, shared + ".\n" + prose(70))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, "a", 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone string, _place int, _lines_removed int")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        if name == "packing":
            break
        assert after.columns == columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
    kept = docs.collect()
    assert sorted((g.doc_id is None, g.doc_id or 0) for g in kept) == [(False, 1), (False, 1), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0), (True, 0)]  # of 7 its last sentence
    texts = {g.doc_id: g.text for g in kept}
    assert texts[6] == long and shared not in texts[5] and not any(shared in g.text for g in kept if g.doc_id is None)
    assert all(g._gone == "a" and g._place == 1 and g._lines_removed == 2 and g.n_chars == len(g.text) for g in kept)
    pieces = after.collect()
    assert sum(g.length for g in pieces) == sum(len(subwords.shared().encode(g.text)) + 1 for g in kept)
