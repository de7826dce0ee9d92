import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docquarry.llm import packing, subwords

TEXTS = ["", None, "a", "The the  three\n\n words \t\n here.", "x" * 3000, "Çéoi été! ", "漢字 and ０９ <|endoftext|>", " ", "\x1c\x1d a\x85b　 c  ", "word " * 4000]


def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_tokenizers():
    t, mine, r = exact(), subwords.shared(), random.Random(3)
    made = ["".join(r.choice(" \n\tabTHEé,.!%1'\xa0\x1c漢") for _ in range(r.randint(0, 60))) for _ in range(500)]
    added = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "a <|endoftext| > <|endoftext|", "<|ENDOFTEXT|>"]
    for text in [x for x in TEXTS if x] + made + added:
        assert mine.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert len(mine.encode(added[0])) == 4


def test_ids_of_test_documents(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    mine = subwords.shared()
    assert [mine.encode(x) for x in texts] == [e.ids for e in exact().encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(20))
def test_histogram_is_packed_whole(seed):
    r = random.Random(seed)
    length = r.choice([8, 64, 1024])
    counts = {r.randint(1, length): r.randint(1, r.choice([3, 1000, 10**6])) for _ in range(r.randint(1, 300))}
    patterns, got = packing.pack_histogram(counts, length), {}
    for n, parts in patterns:
        assert sum(a * b for a, b in parts) <= length
        for a, b in parts:
            got[a] = got.get(a, 0) + n * b
    assert got == counts
    assert len(patterns) <= 2 * length + 2


def shortest_first(lengths, length):
    """Brute force: one piece at a time."""
    packs = []
    for x in sorted(lengths, reverse=True):
        free = [p for p in packs if p + x <= length]
        if free:
            packs[packs.index(min(free))] += x
        else:
            packs.append(x)
    return sorted(packs)


def test_same_packs_as_one_at_a_time():
    r = random.Random(5)
    for _ in range(50):
        lengths = [r.randint(1, 64) for _ in range(r.randint(1, 200))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        mine = sorted(sum(a * b for a, b in parts) for n, parts in packing.pack_histogram(counts, 64) for _ in range(n))
        assert mine == shortest_first(lengths, 64)


def test_pieces_lie_gapless_and_once(spark):
    r, t = random.Random(1), exact()
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(100 + i, "the of " * r.randint(0, 900)) for i in range(60)] + [(7, "again"), (7, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, x, 1, "clash") for i, x in rows], "doc_id long, text string, length int, offset string")
    packed = packing.pack(packing.cut_into_pieces(df, ids=True).cache(), buckets=7)
    got = packed.collect()
    sequences = {}
    for g in got:
        assert g.ids_crc32 == zlib.crc32(np.array(g.ids, "<u4").tobytes()) and g.length == len(g.ids)
        sequences.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    texts = {}
    for i, x in rows:
        texts.setdefault(i, []).append(t.encode(x or "", add_special_tokens=False).ids + [0])
    for i, wanted in texts.items():
        own = [g for g in got if g.doc_id == i]
        assert sum(g.length for g in own) == sum(map(len, wanted))
        if len(wanted) == 1:
            assert [x for g in sorted(own, key=lambda g: g.start) for x in g.ids] == wanted[0]
            assert {g.doc_tokens for g in own} == {len(wanted[0])}
    whole = packing.sequences(packed).collect()
    assert len(whole) == len(sequences)
    for w in whole:
        used = sum(w.lengths)
        assert len(w.ids) == (used if used & (used - 1) == 0 else 1024)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.cut_into_pieces(df)).count() == 0
