import random
import re
from collections import Counter

import zstandard

from docquarry.llm import quality_rules as qr
from docquarry.llm.common import WORD


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_measures_equal_brute_force(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "b ", "é ", "\n", "#", "|", "the cat sat ", "\t", "\x0b", " x", "  ", "\xa0", "\x1c"]) for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += [t for (t,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in texts:
        assert qr.base_measures(t) == brute(t), t


def test_verdicts(spark):
    r = random.Random(2)
    prose = " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 9))) for _ in range(400))
    noise = " ".join("".join(chr(r.randint(33, 126)) for _ in range(12)) for _ in range(1500))
    loop = " ".join(f"{i:09d}" for i in range(3000))
    rows = [(1, prose), (2, noise), (3, loop), (4, "short text"), (5, None), (6, ""), (7, "same words here " * 100), (None, prose), (1, prose)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, kept int")
    got = sorted(qr.judge_quality(df).collect(), key=lambda g: (g.doc_id is None, g.doc_id or 0))
    assert [(g.doc_id, g.base_failed, g.kept, g.reason) for g in got] == [
        (1, False, True, None), (1, False, True, None), (2, False, False, "incompressible"), (3, False, False, "repetitive"), (4, True, False, "base"), (5, True, False, "base"), (6, True, False, "base"), (7, True, False, "base"), (None, False, True, None),
    ]
    assert sorted(str(r.doc_id) for r in qr.keep_good(df).collect()) == ["1", "1", "None"]
    assert qr.keep_good(df).columns == df.columns
    assert qr.judge_quality(df.limit(0)).count() == 0


def test_chunks_are_judged_too():
    z = zstandard.ZstdCompressor(level=qr.LEVEL)
    r = random.Random(3)
    noise = bytes(r.randint(33, 126) for _ in range(qr.CHUNK_BYTES))
    prose = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(6)) for _ in range(3000)).encode()[: qr.CHUNK_BYTES]
    assert qr.compression_verdict(prose * 1, z)[3] is None
    ratio, n, outside, reason = qr.compression_verdict(noise + b"a" * qr.CHUNK_BYTES * 2 + noise, z)
    assert (n, outside, reason) == (4, 2, None) or reason
    assert qr.compression_verdict(b"ab" * 5 * qr.CHUNK_BYTES + noise * 0 + prose, z)[3]


def test_the_last_chunk_is_judged():
    z = zstandard.ZstdCompressor(level=qr.LEVEL)
    r = random.Random(4)
    prose = " ".join("".join(r.choice("etaoinshrdlu") for _ in range(6)) for _ in range(3000)).encode()
    noise = bytes(r.randrange(256) for _ in range(qr.CHUNK_BYTES - 1))
    assert qr.compression_verdict(prose[: qr.CHUNK_BYTES] + prose[5000:7000], z)[1:] == (2, 0, None)
    assert qr.compression_verdict(prose[: qr.CHUNK_BYTES] + noise, z)[1:3] == (2, 1)
    assert qr.compression_verdict(prose[: qr.CHUNK_BYTES] + b"a" * 3000, z)[1:3] == (2, 1)
    assert qr.compression_verdict(noise * 2 + prose[:4000], z)[3]
    assert qr.compression_verdict(prose[:900], z)[1:] == (1, 0, None)
    assert qr.compression_verdict(noise[:900], z)[1:] == (1, 1, "incompressible")


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = qr.judge_quality(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").toPandas()
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.mean() > 0.999
