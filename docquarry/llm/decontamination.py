"""Benchmark decontamination by spaced-seed hashing, in built-in Spark SQL only.

Text and benchmark become lower-case runs of letters and digits. A mask names
the offsets of a span that are hashed; the tokens between may differ. Of the
two masks (six of nine tokens each) at least one matches somewhere in any
thirteen aligned tokens of which eleven agree, so every such overlap has a
seed hit. Shorter items have masks of their own length, so many that
whatever may differ by ``similarity`` one is left whole; items of up to four
tokens must agree in all of them. Hits fix an item, a document and a shift between them; around each
shift the tokens are compared, and the overlap counts if some window of
``window`` tokens agrees in at least ``similarity`` of them.

Only the benchmark side of the joins is broadcast, after its rows are counted;
beyond ``BROADCAST_ROWS`` the joins shuffle, on the salted seed and on the
document. A row's work is linear in its text and in the item tokens compared.

Cases: null texts match nothing; an item of fewer than ``window`` tokens must
agree in its whole length by ``similarity``; items of fewer than ``shortest``
tokens are left out (the queries leave out none but empty ones); rows
without id are not reported; rows that repeat an id are one document; extra
columns are ignored; an empty side gives no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import common

#: Offsets that count; weight 6, span 9.
MASKS = ((0, 1, 3, 6, 7, 8), (0, 1, 4, 5, 6, 8))
SPAN = 9
WINDOW = 13
SIMILARITY = 0.8
BROADCAST_ROWS = 2_000_000
SALTS = 16
GATHERED = 4096


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _seeds(df: DataFrame, key: str) -> DataFrame:
    """(key, seed, at): hashes of each mask at each position of ``t``."""
    places = F.when(F.size("t") >= SPAN, F.sequence(F.lit(0), F.size("t") - SPAN))

    def hashes(number: int, mask: tuple[int, ...]) -> Column:
        return F.transform(places, lambda i: F.xxhash64(*(F.get("t", i + o) for o in mask), F.lit(number)))

    # The outer form adds no filter on the array: pushed below, such a filter would split the text once for each token.
    own = df.select(key, (F.size("t") - (SPAN - 1)).alias("_n"), F.concat(*(hashes(i, m) for i, m in enumerate(MASKS))).alias("_h"))
    return own.select(key, "_n", F.posexplode_outer("_h").alias("_pos", "seed")).select(key, "seed", (F.col("_pos") % F.col("_n")).alias("at"))


def short_masks(width: int, differ: int) -> list[tuple[int, ...]]:
    """Offsets to hash, so that whichever ``differ`` of ``width`` tokens differ, one mask holds none of them."""
    parts = min(width, differ + 2 if 0 < differ < 3 else differ + 1)
    blocks = [range(i * width // parts, (i + 1) * width // parts) for i in range(parts)]
    return [tuple(o for b in kept for o in b) for kept in itertools.combinations(blocks, parts - differ)]


def _short_seeds(df: DataFrame, key: str, own_width: Column | None, widths: list[tuple[int, int]]) -> DataFrame:
    """(key, seed, at) of the masks of each (width, tokens that may differ), from as far outside ``t`` as may differ; ``own_width`` picks one width a row."""
    n, none = F.size("t"), F.array().cast("array<struct<seed:bigint,at:int>>")
    every = []
    for width, differ in widths:
        fits = n >= width - differ
        places = F.sequence(F.lit(-differ), n - width + differ)
        for number, mask in enumerate(short_masks(width, differ)):
            made = F.transform(places, lambda i: F.struct(F.xxhash64(*(F.get("t", i + o) for o in mask), F.lit(width), F.lit(number)).alias("seed"), i.alias("at")))
            every.append(F.when(fits if own_width is None else fits & (own_width == width), made).otherwise(none))
    return df.select(key, F.explode_outer(F.concat(*every)).alias("_s")).select(key, "_s.seed", "_s.at")


def find_overlaps(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, shortest: int = SPAN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shifts, best_agreeing, item_tokens, longest_agreeing) for each verified pair.

    best_agreeing: most agreeing tokens of the item under one shift;
    longest_agreeing: most agreeing tokens in one window.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).filter("doc_id is not null")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), tokens(F.col(item_text_col)).alias("t")).filter("item_id is not null")
    items = common.cut(items.filter(F.size("t") >= max(1, shortest)), "items")
    own_width = F.least(F.lit(window), F.size("t"))
    widths = sorted(r[0] for r in items.filter(F.size("t") < WINDOW).select(own_width).distinct().collect())  # twelve at most
    widths = [(w, w - math.ceil(w * math.nextafter(similarity, 0))) for w in widths]
    wanted, met = _seeds(items, "item_id"), docs.select("doc_id", tokens(F.col("_text")).alias("t"))
    seeds = _seeds(met, "doc_id")
    if widths:
        wanted = wanted.unionByName(_short_seeds(items.filter(F.size("t") < WINDOW), "item_id", own_width, widths))
        seeds = seeds.unionByName(_short_seeds(met, "doc_id", None, widths))
    wanted = common.cut(wanted.withColumnRenamed("at", "item_at"), "seeds")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        hits = seeds.join(F.broadcast(wanted), "seed")
    else:  # a common seed is dealt over SALTS tasks
        salted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = seeds.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "_salt"])
    hits = hits.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()

    # the shifts of a document are gathered, so that its text, read again, is tokenised once for GATHERED items
    pairs = hits.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts"))
    pairs = common.cut(pairs.join(F.broadcast(items) if few else items, "item_id"), "pairs")
    held = pairs.agg(F.coalesce(F.sum(F.size("t") + F.size("shifts")), F.lit(0))).first()[0]
    lists = pairs.groupBy("doc_id", F.pmod(F.xxhash64("item_id"), F.lit(1 + items.count() // GATHERED)).alias("_part")).agg(F.collect_list(F.struct("item_id", "t", "shifts")).alias("_items"))
    lists = lists.drop("_part")
    found = docs.join(F.broadcast(lists) if held <= BROADCAST_ROWS else lists, "doc_id").select("doc_id", verified(tokens(F.col("_text")), F.col("_items"), window, similarity).alias("_found"))
    found = found.select("doc_id", F.explode_outer("_found").alias("f")).select("doc_id", "f.*")
    found = found.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("good.shift")))).cast("long").alias("n_shifts"),
        F.max(F.array_max("good.agreeing")).alias("best_agreeing"), F.max("item_tokens").alias("item_tokens"), F.max(F.array_max("good.longest")).alias("longest_agreeing"),
    )
    return found.filter("n_shifts > 0")


def verified(text: Column, items: Column, window: int, similarity: float) -> Column:
    """[(item_id, item_tokens, good: [(shift, agreeing, longest)])] of the text's tokens against items (item_id, t, shifts); the work is linear in the items' tokens."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def one(d: Column, item: Column) -> Column:
        width = F.least(F.lit(window), F.size(item["t"]))
        needed = F.ceil(width * F.lit(math.nextafter(similarity, 0)))

        def compared(shift: Column) -> Column:
            agree = F.transform(item["t"], lambda token, i: F.coalesce(F.when(shift + i >= 0, (F.get(d, shift + i) == token).cast("int")), F.lit(0)))
            most = lambda a: F.array_max(F.transform(F.sequence(F.lit(1), F.size(a) - width + 1), lambda i: total(F.slice(a, i, width))))
            return common.let(agree, lambda a: F.struct(shift.alias("shift"), total(a).alias("agreeing"), most(a).alias("longest")))

        good = F.filter(F.transform(item["shifts"], compared), lambda x: x["longest"] >= needed)
        return F.struct(item["item_id"].alias("item_id"), F.size(item["t"]).alias("item_tokens"), good.alias("good"))

    return common.let(text, lambda d: F.transform(items, lambda item: one(d, item)))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The input rows, unchanged, without the documents that overlap with an item."""
    gone = common.cut(find_overlaps(documents, benchmark, id_col=id_col, **how).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return documents.join(F.broadcast(gone) if few else gone, documents[id_col] == gone["_gone"], "left_anti")


def query(spark, sf_dir) -> DataFrame:
    return find_overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), shortest=1)
