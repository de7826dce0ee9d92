"""Secrets: certain patterns, and multipart credentials linked within scopes, in built-in Spark SQL only.

Base spans come from three patterns and always stay. Besides, weak candidates
of three roles are gathered: access identifiers (client_id=..., user: ...),
secrets (client_secret=..., long mixed tokens) and endpoints (urls, host=...).
Each role's intervals are joined with the others' inside a scope, a block
between blank lines, however far apart they stand in it. An
identifier needs a secret and a secret an identifier, where base spans count as
partners (access as identifier, assign and hex as secret); an endpoint needs both. Weak candidates
without their complement are not reported, nor are those that touch a base span.

A text's intervals are arrays in its own row, so the join needs no shuffle and
meets nothing but intervals of one text; it runs only where two roles occur. It
is a merge: intervals are sorted once and passed forwards and backwards, so no
interval is held against all others. Spark gives no match positions: they are
running sums of the lengths of the pieces between matches and of the matches.

Cases: a null text counts as empty; an empty text has no spans; each input row
gives one output row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import common

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"(?i:password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # of 20 characters or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
WEAK_ID = rf"(?i:client_?id|access_?key(?:_?id)?|key_?id|account(?:_?(?:id|name))?|user(?:_?name)?|login){_VALUE}[A-Za-z0-9._@-]{{3,}}"
WEAK_SECRET = rf"(?i:client_?secret|secret_?(?:access_?)?key|private_?key|passphrase|pass|pwd|auth){_VALUE}[A-Za-z0-9+/_.=!@#$%^&*-]{{6,}}|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{{28,}}={{0,2}}(?![A-Za-z0-9+/_=-])"
ENDPOINT = rf"""(?i:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[^\x00-\x20"'<>]{{3,}}|(?i:host(?:_?name)?|endpoint|server|base_?url){_VALUE}[A-Za-z0-9][A-Za-z0-9.:/_-]{{2,}}"""
SCOPE_END = r"\n[\x20\t\r]*\n"

_SPAN = "array<struct<start:int,end:int,long:int>>"
SCHEMA_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,weak:boolean>>"


def _matches(df: DataFrame, name: str, pattern: str, when: Column, length_group: int = 0) -> DataFrame:
    """Adds the array ``name`` of (start, end, long) of the pattern's matches in ``_text``; long: length of a group."""
    found, none = f"_{name}_m", F.array().cast(_SPAN)
    df = df.withColumn(found, F.when(when, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    lengths = lambda strings: F.transform(strings, lambda x: F.length(x))
    own, between = lengths(F.col(found)), lengths(F.split("_text", pattern, -1))
    group = lengths(F.regexp_extract_all("_text", F.lit(pattern), F.lit(length_group))) if length_group else own

    def spans(m: Column, p: Column, g: Column) -> Column:
        ends = common.running(F.zip_with(m, F.slice(p, F.lit(1), F.size(m)), lambda x, y: x + y), F.lit(0), lambda at, n: at + n)
        return F.zip_with(ends, F.zip_with(m, g, lambda x, y: F.struct(x.alias("m"), y.alias("g"))), lambda e, x: F.struct((e - x["m"]).alias("start"), e.alias("end"), x["g"].alias("long")))

    walk = common.let(own, lambda m: common.let(between, lambda p: common.let(group, lambda g: spans(m, p, g))))
    return df.withColumn(name, F.when(F.size(found) > 0, walk).otherwise(none)).drop(found)


FAR = 1 << 30


def _linked(roles: dict[str, Column], scopes: Column) -> Column:
    """The weak spans (start, rank, kind, end, weak) that touch no base span and have their complement in their scope.

    All spans and scope ends are sorted once; a pass forwards carries what ended
    so far in the scope, one backwards what is still to start.
    """
    event = lambda at, order, rank, kind, end: F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
    # at one place scope ends stand first, then base spans
    every = [F.transform(scopes, lambda e: event(e["end"], 0, -1, "", e["end"]))]
    of = lambda rank, kind: F.transform(roles[kind], lambda s: event(s["start"], 1 + (rank > 2), rank, kind, s["end"]))
    every += [of(rank, kind) for rank, kind in enumerate(KINDS)]
    is_base, is_id, is_secret = (lambda e: e["order"] == 1), (lambda e: e["kind"].isin("id", "access")), (lambda e: e["kind"].isin("secret", "assign", "hex"))

    def forwards(a: Column, e: Column) -> Column:
        fresh = e["order"] == 0
        kept = lambda name: F.when(fresh, F.lit(FAR)).otherwise(a[name])
        return F.struct(
            F.when(is_base(e), F.greatest(a["base"], e["end"])).otherwise(a["base"]).alias("base"),
            F.when(is_id(e), F.least(a["id"], e["end"])).otherwise(kept("id")).alias("id"),
            F.when(is_secret(e), F.least(a["secret"], e["end"])).otherwise(kept("secret")).alias("secret"),
        )

    def backwards(a: Column, e: Column) -> Column:
        fresh = e["order"] == 0
        kept = lambda name: F.when(fresh, F.lit(-1)).otherwise(a[name])
        return F.struct(
            F.when(is_base(e), e["at"]).otherwise(a["base"]).alias("base"),
            F.when(is_id(e), F.greatest(a["id"], e["at"])).otherwise(kept("id")).alias("id"),
            F.when(is_secret(e), F.greatest(a["secret"], e["at"])).otherwise(kept("secret")).alias("secret"),
        )

    begin = lambda base, other: F.struct(F.lit(base).alias("base"), F.lit(other).alias("id"), F.lit(other).alias("secret"))

    def chosen(events: Column, f: Column, b: Column) -> Column:
        both = F.zip_with(events, F.zip_with(f, b, lambda x, y: F.struct(x.alias("f"), y.alias("b"))), lambda e, s: F.struct(e.alias("e"), s["f"].alias("f"), s["b"].alias("b")))

        def stays(x: Column) -> Column:
            e = x["e"]
            clear = (x["f"]["base"] <= e["at"]) & (x["b"]["base"] >= e["end"])
            near = lambda role: (x["f"][role] <= e["at"]) | (x["b"][role] >= e["end"])
            needed = F.when(e["kind"] == "id", near("secret")).when(e["kind"] == "secret", near("id")).otherwise(near("id") & near("secret"))
            return (e["order"] == 2) & clear & needed

        tagged = lambda x: F.struct(x["e"]["at"].alias("start"), x["e"]["rank"].alias("rank"), x["e"]["kind"].alias("kind"), x["e"]["end"].alias("end"), F.lit(True).alias("weak"))
        return F.transform(F.filter(both, stays), tagged)

    passes = lambda ev: common.let(common.running(ev, begin(-1, FAR), forwards), lambda f: common.let(F.reverse(common.running(F.reverse(ev), begin(FAR, -1), backwards)), lambda b: chosen(ev, f, b)))
    return common.let(F.array_sort(F.concat(*every)), passes)


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (``SCHEMA_SPANS``, by start, then kind as listed) for each input row."""
    df = documents.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("_text"))
    signed = F.contains("_text", F.lit("=")) | F.contains("_text", F.lit(":"))
    df = _matches(df, "assign", ASSIGN, signed, 1)
    df = _matches(df, "access", ACCESS, F.contains("_text", F.lit("AKIA")))
    df = _matches(df, "hex", HEX, F.lit(True))
    df = df.withColumn("assign", F.filter("assign", lambda s: s["long"] >= 6))
    df = _matches(df, "id", WEAK_ID, signed)
    ids = (F.size("id") > 0) | (F.size("access") > 0)
    df = _matches(df, "secret", WEAK_SECRET, ids)
    both = ids & ((F.size("secret") > 0) | (F.size("assign") > 0) | (F.size("hex") > 0))
    df = _matches(df, "endpoint", ENDPOINT, both)
    df = _matches(df, "scope", SCOPE_END, both)
    weak = F.when(both, _linked({k: F.col(k) for k in KINDS}, F.col("scope"))).otherwise(F.array().cast(SCHEMA_SPANS))

    def tagged(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(False).alias("weak")))

    return df.select("doc_id", F.array_sort(F.concat(*(tagged(i, k) for i, k in enumerate(KINDS[:3])), weak)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: ~s["weak"])
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def query(spark, sf_dir) -> DataFrame:
    return digest(find_secrets(common.table(spark, sf_dir, "documents")))
