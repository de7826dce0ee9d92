import itertools
import math
import random
import re
import time

from docquarry.llm import decontamination as dc


def toks(x):
    return [w for w in re.split(r"[\W_]+", (x or "").lower()) if w]


def brute(docs, items):
    found = set()
    for d, text in docs:
        a = toks(text)
        for i, item in items:
            b = toks(item)
            if d is None or len(b) < 9:
                continue
            w = min(13, len(b))
            for shift in range(-len(b), len(a)):
                same = [0 <= shift + k < len(a) and a[shift + k] == b[k] for k in range(len(b))]
                if sum(same) >= 7 and max(sum(same[k : k + w]) for k in range(len(b) - w + 1)) >= math.ceil(0.8 * w - 1e-9):
                    found.add((d, i))
    return found


def test_masks_guarantee_a_hit():
    spots = [{p + o for o in m} for m in dc.MASKS for p in range(dc.WINDOW - dc.SPAN + 1)]
    for bad in itertools.combinations(range(dc.WINDOW), 2):
        assert any(not s & set(bad) for s in spots)


def test_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 5, 9, 11, 13, 20, 45])))) for i in range(30)] + [(30, None)]
    docs = []
    for d in range(80):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        piece = toks(r.choice(items)[1])
        a = r.randint(0, len(piece) // 2)
        piece = piece[a : a + r.randint(8, 40)]
        for _ in range(r.randint(0, 5)):
            if piece:
                piece[r.randrange(len(piece))] = "x"
        at = r.randint(0, len(words))
        docs.append((d, ", ".join(words[:at] + piece + words[at:]).upper()))
    docs += [(3, docs[3][1]), (None, items[12][1]), (900, None), (901, ""), (902, "w1 " * 300)]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in dc.find_overlaps(d, b).collect()}
    want = brute(docs, items)
    assert got == want
    assert any(True for _ in got)
    kept = {x.doc_id for x in dc.drop_contaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}
    assert dc.find_overlaps(d.limit(0), b).count() == 0 and dc.find_overlaps(d, b.limit(0)).count() == 0


def test_work_is_linear_in_a_text(spark):
    items = spark.createDataFrame([(1, "w1 " * 20)], "item_id long, text string")

    def took(n):
        docs = spark.createDataFrame([(1, "w1 " * n)], "doc_id long, text string")
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            assert [tuple(g) for g in dc.find_overlaps(docs, items).select("n_shifts", "item_tokens", "longest_agreeing").collect()] == [(n + 21 - 2 * 11, 20, 13)]
            best = min(best, time.perf_counter() - began)
        return best

    took(1000)
    assert took(64_000) < 2.5 * took(32_000)


def test_verbatim_items_are_all_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(x.doc_id, x.item_id) for x in dc.find_overlaps(docs, items).collect()}
    texts = docs.select("doc_id", "text").collect()
    inside = {(d, i) for i, t in items.collect() for d, x in texts if t in x}
    assert inside <= got
    assert len({d for d, _ in got}) < 0.1 * len(texts)


def test_short_items_equal_brute_force(spark):
    for n in range(1, 13):
        differ = n - math.ceil(0.8 * n - 1e-9)
        masks = dc.short_masks(n, differ)
        assert all(any(not set(m) & set(bad) for m in masks) for bad in itertools.combinations(range(n), differ))
    r = random.Random(7)
    items = [(i, " ".join(f"v{r.randrange(60)}" for _ in range(i % 16 + 1))) for i in range(48)] + [(48, "人工智能的历史"), (49, "")]
    docs = [(900, "关于。人工智能的历史。结束"), (901, ""), (902, None)]
    for d in range(300):
        piece = toks(items[d % 48][1])
        for _ in range(r.randint(0, 3)):
            piece[r.randrange(len(piece))] = "x"
        words = [f"v{r.randrange(60)}" for _ in range(r.randint(0, 20))]
        at = r.choice([0, len(words), r.randint(0, len(words))])
        docs.append((d, " ".join(words[:at] + piece + words[at:])))
    want = set()
    for d, text in docs:
        a = toks(text)
        for i, item in items:
            b, w = toks(item), min(13, len(toks(item)))
            for shift in range(-len(b), len(a)) if b else ():
                same = [0 <= shift + k < len(a) and a[shift + k] == b[k] for k in range(len(b))]
                if max(sum(same[k : k + w]) for k in range(len(b) - w + 1)) >= math.ceil(0.8 * w - 1e-9):
                    want.add((d, i))
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in dc.find_overlaps(*tables, shortest=1).collect()} == want
    assert (900, 48) in want
