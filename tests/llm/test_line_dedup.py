import random

from docquarry.llm import line_dedup as ld


def words(r, n):
    return " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 99999)}" for _ in range(n))


def removed_lines(rows, got):
    """Per row the removed line numbers."""
    return [{i for s in g for i in range(s[0], s[1])} for g in got]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, _ord string")
    return ld.dedup_lines(df, **how).collect()


def test_planted_passages_stay_once(spark):
    r = random.Random(7)
    passages = [words(r, r.randint(51, 90)) for _ in range(5)] + ["\n".join(words(r, r.randint(5, 20)) for _ in range(8)) for _ in range(5)]
    rows = []
    for d in range(120):
        parts = [words(r, r.randint(1, 60)) for _ in range(r.randint(1, 8))]
        for p in r.sample(passages, r.randint(0, 3)):
            parts.insert(r.randint(0, len(parts)), p)
        rows.append((d, "\n".join(parts), "x"))
    got = {g.doc_id: g for g in run(spark, rows)}
    for p in passages:
        assert sum(p in t for _, t, _ in rows) > 1
        assert [d for d, t, _ in rows if p in got[d].text] == [min(d for d, t, _ in rows if p in t)]
    for d, t, _ in rows:
        if not any(p in t for p in passages):
            assert got[d].text == t and got[d]._lines_removed == []


def test_every_deleted_line_has_an_earlier_copy_and_shared_runs_are_hit(spark):
    r = random.Random(3)
    lines = [words(r, r.randint(0, 25)) for _ in range(12)]
    rows = [(d, "\n".join(r.choice(lines) if r.random() < 0.85 else words(r, 9) for _ in range(r.randint(0, 30))), "x") for d in range(60)]
    got = {g.doc_id: {i for s in g._lines_removed for i in range(s.start, s.end)} for g in run(spark, rows)}
    split = {d: t.split("\n") for d, t, _ in rows}
    order = [(d, i) for d in sorted(split) for i in range(len(split[d]))]
    first = {}
    for d, i in order:
        if i in got[d]:
            assert split[d][i] in first
        first.setdefault(split[d][i], (d, i))
    for d in split:  # a run of RUN_WORDS that an earlier document has is hit
        for c in range(d):
            for i in range(len(split[d])):
                for j in range(len(split[c])):
                    k = 0
                    while i + k < len(split[d]) and j + k < len(split[c]) and split[d][i + k] == split[c][j + k]:
                        k += 1
                    if sum(len(x.split()) for x in split[d][i : i + k]) >= ld.RUN_WORDS:
                        assert any(i + x in got[d] for x in range(k)), (d, c, i, j, k)


def test_repeats_inside_a_document(spark):
    r = random.Random(1)
    a, b = words(r, 60), words(r, 55)
    got = run(spark, [(1, "\n".join([a, b, "short", a, "end"]), "x"), (2, "\n".join(["same words here"] * 100), "x")])
    got = {g.doc_id: g.text for g in got}
    assert got[1] == "\n".join([a, b, "short", "end"])
    assert 0 < got[2].count("\n") < 40


def test_odd_rows(spark):
    r = random.Random(2)
    a = words(r, 70)
    rows = [(1, a, "x"), (1, a, "x"), (None, a + "\nmine", "x"), (2, None, "x"), (3, "", "x"), (4, " " + a + "\t", "x"), (0, a * 50, "x")]
    got = sorted(run(spark, rows), key=lambda g: (g.doc_id is None, g.doc_id or 0))
    assert [(g.doc_id, g.text) for g in got] == [(0, a * 50), (1, a), (1, a), (2, None), (3, ""), (4, ""), (None, "mine")]
    assert run(spark, rows[:0]) == []


def brute(rows):
    """Texts by (id, text): every run of RUN_WORDS words or more held against all earlier ones."""
    import re

    split = {(10**18 if d is None else d, t or ""): re.split(r"(?<=\n)|(?<=[.!?] )", t or "") for d, t in rows}
    keys = sorted(split, key=lambda k: (k[0], hash_of[k[1]]))
    earlier, out = {}, {}
    for key in keys:
        parts = split[key]
        own = [i for i, p in enumerate(parts) if p.split()]
        gone, mine = set(), []
        for a in range(len(own)):
            held = 0
            for b in range(a, len(own)):
                held += len(parts[own[b]].split())
                run = tuple(parts[i].strip() for i in own[a : b + 1])
                if held >= ld.RUN_WORDS:
                    if run in earlier or any(r == run and last < a for r, last in mine):
                        gone |= set(range(own[a], (own + [len(parts)])[b + 1]))
                    mine.append((run, b))
        earlier |= dict.fromkeys(r for r, _ in mine)
        kept = []
        for i, p in enumerate(parts):
            if i not in gone:
                kept.append(p)
            elif i + 1 not in gone and p.endswith("\n"):
                start = i
                while start - 1 in gone:
                    start -= 1
                if start and not parts[start - 1].endswith("\n"):
                    kept.append("\n")
        out[key] = "".join(kept)
    return out


hash_of = {}


def held_against_brute(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    hash_of.update({r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()})
    want = brute(rows)
    before = df.withColumn("_lines_removed", F.col("text"))  # a clashing name passes through, and brings the old text along
    got = ld.dedup_lines(before).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g.text or "") == want[10**18 if g.doc_id is None else g.doc_id, g._lines_removed or ""], (g.doc_id, g._lines_removed)
    return want


def test_equals_brute_force(spark):
    r = random.Random(21)
    p, q = words(r, 60), words(r, 30)
    held_against_brute(spark, [(1, p), (2, p + "\n" + q), (3, p + "\n" + q), (4, q), (5, q + "\n" + p), (6, q + "\n\n" + p)])
    for seed in range(4):
        r = random.Random(seed)
        lines = ["", " "] + [words(r, r.choice([3, 8, 8, 20, 35, 60])) + r.choice(["", ".", "!"]) for _ in range(14)]
        runs = [[r.choice(lines) for _ in range(r.randint(2, 9))] for _ in range(6)]
        rows = [(None if r.random() < 0.05 else d, None) for d in range(3)]
        for d in range(60):
            parts = []
            for _ in range(r.randint(0, 7)):
                parts += r.choice(runs) if r.random() < 0.5 else [r.choice(lines) if r.random() < 0.6 else words(r, 9) + "."]
            text = "".join(x + r.choice(["\n", "\n", " "]) for x in parts)
            rows.append((None if r.random() < 0.05 else d, text))
        rows += rows[5:9]
        want = held_against_brute(spark, rows)
        assert sum(t != k[1] for k, t in want.items()) > 10


def test_test_documents_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 6000").collect()]
    want = held_against_brute(spark, rows)
    assert any(t != k[1] for k, t in want.items())


def test_recall_by_length_of_line(spark):
    r = random.Random(5)
    found = {}
    for n in (8, 15, 30, 49, 50, 80):  # passages of over 50 words in lines, or in sentences of one line, of n words
        for joint in ("\n", " "):
            passages = [joint.join(words(r, n) + "." for _ in range(-(-55 // n))) for _ in range(20)]
            rows = [(10 * i + k, f"{words(r, 30)}.{joint}{p}{joint}{words(r, 30)}.") for i, p in enumerate(passages) for k in range(2)]
            got = {g.doc_id: g.text for g in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
            found[n, joint] = sum(p in got[10 * i] and p not in got[10 * i + 1] for i, p in enumerate(passages)) / len(passages)
    print(found)
    assert set(found.values()) == {1.0}
