"""Personal data: exact identifiers, and disguised ones by offset-preserving deobfuscation.

Base spans come from the plain patterns. Then transducers rewrite the text,
each carrying for every output character the source range it stands for:

1. characters: invisible ones vanish, full-width and mathematical forms and
   Cyrillic and Greek look-alikes become the Latin letters they resemble, digits
   of other scripts become 0 to 9;
2. spelled digits ("five five five", "null eins", "cero uno", "zéro un") in
   runs of seven or more, three of them words, become digits, a "plus" before
   them "+"; letters O and l or I within a long number become 0 and 1; four
   groups of digits, spelled or not, with "dot" between them become an address;
3. "[at]", "(dot)", "{arroba}", and " at " where " dot " follows in the same
   address, become "@" and ".".

Identifiers found in the rewritten text that rest on a rewrite are mapped back
to source offsets (code points, end exclusive). Base spans always stay; a
disguised span is added unless a span of its kind contains it. Where it grows a
base span, three things are prose, no disguise: a group of letters alone at its
end ("+1 555 123 4567 I"), a Cyrillic or Greek word that runs on beyond it, and
"point", "punkt" or "punto" beside an address that is whole without them.

Cases: a null text counts as empty; an empty text has no spans; each input row
gives one output row; extra columns are ignored; all scans are linear in the
length of the text, whatever it holds.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import common

KINDS = ("email", "ip", "card", "phone")
MIN_SPELLED = 7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Around each "@": the run of local characters before it, cut at the last match, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def ips(text: str):
    """Maximal dotted runs hold a match in each four parts from the left."""
    for run in _DOTTED.finditer(text):
        parts = [(m.start(), m.end()) for m in _NUMBER.finditer(text, run.start(), run.end())]
        for i in range(0, len(parts) - 3, 4):
            if all(b - a < 4 and int(text[a:b]) <= 255 or not text[a:b].lstrip("0")[3:] and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in parts[i : i + 4]):
                yield parts[i][0], parts[i + 3][1]


def cards(text: str):
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(len, _NUMBER.findall(m[0]))) <= 15:
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    return [(kind, a, b) for kind in KINDS for a, b in FINDERS[kind](text)]


# Letters that look like Latin ones.
_CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјԁԛԝһ", "ABEKMHOPCTYXSIJaeopcyxsijdqwh"))
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικχ", "ABEZHIKMNOPTYXavopuikx"))
# Characters without width.
_INVISIBLE = dict.fromkeys("­​‌‍⁠﻿", "")
# Digit words in English, German, Spanish and French.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_LOOKALIKES = _CYRILLIC | _GREEK | _INVISIBLE
_FORMS = "！-～\U0001d400-\U0001d7ff①-⑳Ⓐ-ⓩ⁰-⁹₀-₉"
_ODD = re.compile(f"[{''.join(_LOOKALIKES)}{_FORMS}]")
_DIGIT = re.compile(r"(?![0-9])\d")
_ODD_OR_DIGIT = re.compile(f"{_ODD.pattern}|{_DIGIT.pattern}")
_WORDS = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:plus\W{{1,3}})?(?:(?:{_WORDS}|[0-9]{{1,4}})[ \t,.\-]{{1,3}}){{{MIN_SPELLED - 1},}}(?:{_WORDS}|[0-9]{{1,4}})(?!\w)")
_SPELLED_HINT = re.compile(rf"(?i)(?<!\w)(?:{_WORDS})[ \t,.\-]{{1,3}}(?:{_WORDS})[ \t,.\-]{{1,3}}(?:{_WORDS}|[0-9])(?!\w)")
_DIGIT_TOKEN = re.compile(rf"(?i)plus|{_WORDS}|[0-9]+")
_IP_TOKEN = re.compile(rf"(?i)dot|punkt|punto|point|{_WORDS}|[0-9]+")
MIN_WORDS = 3
_LETTERED = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[ .()\-]{0,2}[0-9OoIl]){4,}(?![A-Za-z0-9])")
_LETTERS = str.maketrans("OoIl", "0011")
LEAST_DIGITS = 0.7
_AT, _DOT = r"(?:at|arroba|arobase|ät|klammeraffe|@)", r"(?:dot|punkt|punto|point|\.)"
_BRACKET_AT = re.compile(rf"(?i)[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}{_AT}[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}")
_BRACKET_DOT = re.compile(rf"(?i)[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}{_DOT}[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}")
_SPACED_AT = re.compile(r"(?i)[ \t]{1,3}(?:at|arroba|arobase|ät)[ \t]{1,3}|[ \t]{0,3}@[ \t]{0,3}")
_SPACED_DOMAIN = re.compile(r"(?i)[A-Za-z0-9-]+((?:(?:[ \t]{1,3}(?:dot|punkt|punto|point)[ \t]{1,3}|\.)[A-Za-z0-9-]+)+)")
_DOT_BEFORE = re.compile(r"(?i)[ \t]{1,3}(?:dot|punkt|punto|point)[ \t]{1,3}$")
_GROUP = rf"(?:(?:{_WORDS}|[0-9]{{1,3}})[ \t\-]{{1,2}}){{0,2}}(?:{_WORDS}|[0-9]{{1,3}})"
_SPELLED_IP = re.compile(rf"(?i)(?<!\w){_GROUP}(?:[ \t]{{1,3}}(?:dot|punkt|punto|point)[ \t]{{1,3}}{_GROUP}){{3}}(?!\w)")
_SPACED_DOT = re.compile(r"(?i)[ \t]{1,3}(?:dot|punkt|punto|point)[ \t]{1,3}")
_DOT_WORD = re.compile(r"(?i)[ \t](?:dot|punkt|punto|point)[ \t]| @|@ ")
_LONE_LETTERS = re.compile(r"^[OoIl]+[ .()\-]+[0-9]|[0-9][ .()\-]+[OoIl]+$")
_ONE_WORD = re.compile("[\u0370-\u052f]{2}")
_TLD = re.compile(r"\.[A-Za-z]{2,24}$")


class Rewritten:
    """A text with the source range [from_, to) of each of its characters."""

    def __init__(self, text: str):
        self.text, self.from_, self.to = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Non-overlapping (start, end, new text) in ascending order; the new characters stand for the whole replaced range."""
        parts, a, b, at = [], [], [], 0
        for start, end, new in edits:
            parts += self.text[at:start], new
            a += self.from_[at:start]
            b += self.to[at:start]
            if end > start:
                a += [self.from_[start]] * len(new)
                b += [self.to[end - 1]] * len(new)
            at = end
        self.text = "".join(parts) + self.text[at:]
        self.from_, self.to = a + self.from_[at:], b + self.to[at:]


def _plain(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    return str(unicodedata.decimal(c)) if c.isdecimal() else unicodedata.normalize("NFKC", c)


def _characters(r: Rewritten) -> None:
    r.replace([(m.start(), m.end(), _plain(m[0])) for m in _ODD_OR_DIGIT.finditer(r.text)])


def _spelled_ips(r: Rewritten) -> None:
    edits = []
    for run in _SPELLED_IP.finditer(r.text):
        at = run.start()
        for t in _IP_TOKEN.finditer(r.text, run.start(), run.end()):
            if t.start() > at:
                edits.append((at, t.start(), ""))
            word = t[0].lower()
            if not word.isdigit():
                edits.append((t.start(), t.end(), _DIGIT_WORDS.get(word, ".")))
            at = t.end()
    r.replace(edits)


def _spelled_runs(text: str):
    """Matches of spelled numbers with words enough."""
    return [m for m in _SPELLED.finditer(text) if sum(t[0][0].isalpha() for t in _DIGIT_TOKEN.finditer(m[0])) >= MIN_WORDS]


def _digits(r: Rewritten) -> None:
    edits = []
    for run in _spelled_runs(r.text):
        at = run.start()
        for t in _DIGIT_TOKEN.finditer(r.text, run.start(), run.end()):
            if t.start() > at:
                edits.append((at, t.start(), ""))
            word = t[0].lower()
            if not word.isdigit():
                edits.append((t.start(), t.end(), "+" if word == "plus" else _DIGIT_WORDS[word]))
            at = t.end()
    r.replace(edits)
    edits = []
    for run in _lettered_runs(r.text):
        edits += [(run.start() + i, run.start() + i + 1, c.translate(_LETTERS)) for i, c in enumerate(run[0]) if c in "OoIl"]
    r.replace(edits)


def _lettered_runs(text: str):
    """Long numbers in which a few digits are letters that look like them."""
    found = [m for m in _LETTERED.finditer(text) if any(c in "OoIl" for c in m[0])]
    return [m for m in found if sum(c.isdigit() for c in m[0]) >= LEAST_DIGITS * sum(c.isalnum() for c in m[0])]


def _signs(r: Rewritten) -> None:
    for pattern, new in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
        r.replace([(m.start(), m.end(), new) for m in pattern.finditer(r.text)])
    if _DOT_WORD.search(r.text):
        edits, done = [], 0
        for m in _SPACED_AT.finditer(r.text):
            domain = _SPACED_DOMAIN.match(r.text, m.end()) if m.start() >= done else None
            if not domain:
                continue
            before, at = [], _run_start(r.text, m.start(), done)
            if at == m.start():
                continue
            while dot := _DOT_BEFORE.search(r.text, max(done, at - 12), at):
                start = _run_start(r.text, dot.start(), done)
                if start == dot.start():
                    break
                before.append(dot)
                at = start
            before, after = before[::-1], list(_SPACED_DOT.finditer(r.text, domain.start(1), domain.end(1)))
            if m[0] == "@" and "." in _SPACED_DOT.sub("", domain[1]):  # a whole address already
                before, after = ([d for d in part if d[0].strip().lower() == "dot"] for part in (before, after))
            if after or "@" in m[0]:
                edits += [*((d.start(), d.end(), ".") for d in before), (m.start(), m.end(), "@"), *((d.start(), d.end(), ".") for d in after)]
                done = domain.end()
        r.replace(edits)


def _run_start(text: str, end: int, least: int) -> int:
    """Where the run of local characters that ends before ``end`` begins."""
    while end > least and text[end - 1] in _LOCAL_CHARS:
        end -= 1
    return end


def disguised_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that show only after rewriting, at their source offsets."""
    odd, spelled = not text.isascii() and (_ODD.search(text) or _DIGIT.search(text)), _SPELLED_HINT.search(text)
    signs = _BRACKET_AT.search(text) or _BRACKET_DOT.search(text) or _DOT_WORD.search(text)
    lettered = _lettered_runs(text)
    if not (odd or spelled or signs or lettered):
        return []
    r = Rewritten(text)
    if odd:
        _characters(r)
    if _DOT_WORD.search(r.text):
        _spelled_ips(r)
    spelled_at: set[int] = set()
    if spelled or odd or lettered:
        spelled_at = {r.from_[m.start()] for m in _spelled_runs(r.text)}
        _digits(r)
    _signs(r)
    found = []
    candidates = [(kind, a, b) for kind in KINDS for a, b in FINDERS[kind](r.text)]
    for m in _NUMBER.finditer(r.text):  # a spelled run without "plus"
        if 8 <= m.end() - m.start() <= 15 and r.from_[m.start()] in spelled_at:
            candidates.append(("phone", m.start(), m.end()))
    taken = list(base)
    for kind, a, b in candidates:
        start, end = r.from_[a], r.to[b - 1]
        if text[start:end] == r.text[a:b] or kind == "email" and not _TLD.search(r.text[a:b]):
            continue
        if any(k == kind and x <= start and end <= y for k, x, y in taken):
            continue
        if any(k == kind and start < y and x < end for k, x, y in base) and (_LONE_LETTERS.search(text[start:end]) or any(_ONE_WORD.fullmatch(text, at - 1, at + 1) for at in (start, end) if at)):
            continue
        taken.append((kind, start, end))
        found.append((kind, start, end))
    return found


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised), by kind as listed, then start."""
    base = base_spans(text)
    every = [(*s, False) for s in base] + [(*s, True) for s in disguised_spans(text, base)]
    return sorted(every, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in spans)


def redact(text: str, spans) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge under the first kind."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += text[at:start], f"<{kind}>"
        at = max(at, end)
    return "".join(out) + text[at:]


SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,disguised:boolean,value:string>>, redacted string"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_()), ("value", pa.string())])


def find_pii(documents: DataFrame, redacted: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``SCHEMA``: the spans of each row's text and, unless switched off, the text without them."""
    common.small_batches(documents.sparkSession)

    def find(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [find_spans(t) for t in texts]
            values = [[{"kind": k, "start": a, "end": b, "disguised": d, "value": t[a:b]} for k, a, b, d in s] for t, s in zip(texts, spans)]
            clean = [redact(t, s) if redacted else None for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(_SPAN)), pa.array(clean, pa.string())], names=["doc_id", "spans", "redacted"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text")).mapInArrow(find, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: ~s["disguised"])

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    found = found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("_text"), F.size("spans").cast("long").alias("n_spans"))
    return found.withColumnRenamed("_text", "spans")


def query(spark, sf_dir) -> DataFrame:
    return digest(find_pii(common.table(spark, sf_dir, "documents"), redacted=False))
