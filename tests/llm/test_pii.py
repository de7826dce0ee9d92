import hashlib
import random
import re

from docquarry.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_equals_the_plain_patterns():
    r = random.Random(2)
    for i in range(20000):
        pieces = ["a@b.c", "x.y@", "@", ".", "1.2.3.4", "0001.2.3", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", " ", "-", "7", "+", "é", "4539-1488-0343-6467", "a", "9.9"]
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(text) == brute(text), text


def test_base_on_test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(spark.createDataFrame(rows))).collect()}
    for doc_id, text in rows:
        want = brute(text)
        assert got[doc_id].base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert got[doc_id].spans == pii.joined(want)
        assert got[doc_id].n_email == sum(k == "email" for k, *_ in want)


def test_disguises_map_back_to_the_source():
    for text, kind, value in [
        ("write to jane.doe [at] example [dot] org now", "email", "jane.doe [at] example [dot] org"),
        ("write to jane(at)example(dot)org.", "email", "jane(at)example(dot)org"),
        ("mail jane at example dot com please", "email", "jane at example dot com"),
        ("mail jane at mail dot example dot com", "email", "jane at mail dot example dot com"),
        ("mail jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("mail ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ ok", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("ip １０.0.0.１", "ip", "１０.0.0.１"),
        ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
        ("ruf null eins fünf fünf zwei drei vier acht neun an", "phone", "null eins fünf fünf zwei drei vier acht neun"),
        ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("a​b@exam​ple.com", "email", "a​b@exam​ple.com"),
        ("hans @ example.org", "email", "hans @ example.org"),
        ("write jane dot doe at mail dot example dot org now", "email", "jane dot doe at mail dot example dot org"),
        ("card 4l11 1111 1111 1lll end", "card", "4l11 1111 1111 1lll"),
        ("from 1O.0.0.100 on", "ip", "1O.0.0.100"),
        ("phone +1 555 O1O 2345.", "phone", "+1 555 O1O 2345"),
        ("call five five five 0199 two three four five", "phone", "five five five 0199 two three four five"),
    ]:
        spans = [s for s in pii.find_spans(text) if s[3]]
        assert [(k, text[a:b]) for k, a, b, _ in spans] == [(kind, value)], (text, spans)


def test_clean_texts_stay_clean():
    for text in ["we met at noon and the dot on the map", "one two three go", "un deux trois", "look at this. It is at home dot", "Привет, мир", "", "1 2 3 4 5 6 7 8 9 10 11 12", "columns 1 2 3 4 5 6 7 8 о", "IlIlOOIl look", "at (at) all [dot]"]:
        assert pii.find_spans(text) == []


def test_long_texts_are_linear():
    for text in ("a" * 200_000 + "@", "1." * 100_000, "1" * 200_000, "+" * 100_000, "@a" * 100_000, "one " * 50_000, "a at b dot " * 20_000, "a dot " * 30_000 + " dot at ", "1O" * 60_000, "1 O " * 40_000, "[at]" * 50_000):
        pii.find_spans(text)


def test_redaction_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "a@b.org, +1 555 123 4567", 1), (2, None, 2), (2, "", 3), (None, "10.0.0.1", 4), (1, "a@b.org, +1 555 123 4567", 1)], "doc_id long, text string, spans int")
    got = pii.find_pii(df).collect()
    assert len(got) == 5
    assert sorted((g.redacted for g in got)) == ["", "", "<email>, <phone>", "<email>, <phone>", "<ip>"]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_disguises_beside_a_plain_match_are_added():
    for kind, value, base in [
        ("email", "jоhn@example.com", "hn@example.com"),
        ("email", "jane[dot]doe@example.com", "doe@example.com"),
        ("email", "jane dot doe@example.com", "doe@example.com"),
        ("email", "john@example.cоm", "john@example.c"),
        ("email", "john@mail.example[dot]com", "john@mail.example"),
        ("phone", "+1 555 123 456O", "+1 555 123 456"),
    ]:
        text = f"so {value} ok"
        spans = pii.find_spans(text)
        assert {(k, text[a:b], d) for k, a, b, d in spans} == {(kind, base, False), (kind, value, True)}, (text, spans)
        assert pii.redact(text, spans) == f"so <{kind}> ok"


def test_prose_beside_a_plain_match_is_not_added():
    for text in ["call +1 555 123 4567 I am in", "at this point john@example.com wrote", "john@example.com point taken", "почтаjohn@example.com"]:
        assert [s for s in pii.find_spans(text) if s[3]] == [], text


def test_no_bound_on_length():
    long = "jane dot doe" + "".join(f" dot p{i}" for i in range(40)) + " at a" + "".join(f" dot d{i}" for i in range(40)) + " dot org"
    spelled = "plus " + " ".join(["one five"] * 5)
    for value, kind in ((long, "email"), ("jane dot doe dot x dot y dot z dot q dot r at a dot org", "email"), ("x" * 200 + " at " + "y" * 200 + " dot org", "email"), (spelled, "phone")):
        assert [(k, a, b) for k, a, b, _ in pii.find_spans(f"so {value}, ok")] == [(kind, 3, 3 + len(value))], value
    text = "one " * 300 + "4l11 " * 200  # too long for a number, and no reason to crash
    assert pii.find_spans(text) == []


def disguised(r):
    """(kind, a random disguise of a random identifier)."""
    words = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    word = lambda: "".join(r.choice("bdfghjkmnrstuvwz") for _ in range(r.randint(3, 8)))
    spell = lambda digits: " ".join(words[int(d)] for d in digits)
    kind = r.choice(["email", "email", "ip", "phone", "card"])
    if kind == "email":
        local, labels = [word() for _ in range(r.randint(1, 6))], [word() for _ in range(r.randint(1, 6))] + [r.choice(["org", "com", "net"])]
        how = r.randrange(4)
        if how == 0:
            return kind, " dot ".join(local) + " at " + " dot ".join(labels)
        if how == 1:
            at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [ at ] ", " [ dot ] "), ("{at}", "{dot}")])
            return kind, dot.join(local) + at + dot.join(labels)
        plain = ".".join(local) + "@" + ".".join(labels)
        if how == 2:
            return kind, "".join(chr(ord(c) + 0xFEE0) for c in plain)
        look = {"o": "о", "m": "ⅿ", "s": "ѕ"}
        plain = "o" + plain + "o"
        return kind, plain.replace("o", look["o"]).replace("s", look["s"])
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        how = r.randrange(4)
        if how == 0:
            return kind, " dot ".join(map(spell, parts))
        if how == 1:
            return kind, " dot ".join(parts)
        zero = 0x660 if how == 2 else 0xFF10
        return kind, "".join(chr(zero + int(c)) if c.isdigit() else c for c in ".".join(parts))
    n = r.randint(9, 13) if kind == "phone" else 16
    digits = "".join(str(r.randint(0, 9)) for _ in range(n))
    if kind == "card":
        digits = next(x for x in (digits[:-1] + str(d) for d in range(10)) if pii.luhn(x))
    if r.random() < 0.5:
        return kind, ("plus " if kind == "phone" else "") + spell(digits)
    zero = r.choice([0x660, 0x966, 0xFF10, 0x1D7CE])
    return kind, ("+" if kind == "phone" else "") + "".join(chr(zero + int(c)) for c in digits)


def test_random_disguises_are_found_whole():
    r = random.Random(11)
    found = {}
    for _ in range(4000):
        kind, value = disguised(r)
        text = f"xx: {value}; yy"
        hit = any(k == kind and (a, b) == (4, 4 + len(value)) for k, a, b, _ in pii.find_spans(text))
        n, m = found.get(kind, (0, 0))
        found[kind] = n + hit, m + 1
        if not hit:
            print(kind, value, pii.find_spans(text))
    assert {k: n / m for k, (n, m) in found.items()} == {k: 1.0 for k in found}
