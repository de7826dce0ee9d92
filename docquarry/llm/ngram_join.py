"""Exact Jaccard self-join of word n-gram sets by rare-first prefix filtering, and its components.

Two sets whose Jaccard similarity reaches t share an element among the first
``n - ceil(t n) + 1`` of either, in any common order; with rare elements first,
few other sets share one. The order here is by counted occurrences of an
element's hash slot over all documents (a count-min row of fixed width, so its
size is bounded whatever the corpus), then by the hash.

Plan:
1. one pass over the texts: set digest, size and a parity signature of each
   document, and the slot counts. Documents with the same set are one node.
2. a second pass emits the prefix elements of each distinct set; elements in
   the prefixes of two or more sets survive. Elements of slots far above the mean
   are dealt by element and salt; groups are counted and joined back from there
   on, never gathered.
3. star round: within an element's group each set may meet only the group's
   pivot, the set with the fewest rarer elements before it, and meets the
   ``PIVOTS`` it shares most with. In a group of near copies that links nearly
   all of them, in about as many pairs as members.
4. exact round: what still lies in different components is joined pair by pair
   on the element, under the length, positional and suffix filters, and without
   the pairs of the first round; in an element's group each set meets only those
   outside the group's largest component. So no link between components is lost,
   while pairs inside a component that is already linked are never made.
5. each candidate pair is verified once, on the whole sets.

Filters of a pair: length, t max <= min; positional, the elements from the
shared one on must still suffice; suffix, the Hamming distance of two 128-bit
parity signatures (elements hashed into 128 classes) is at most the size of the
symmetric difference, so a larger one rules the pair out.

Cases: null texts count as empty; empty sets link with nothing and are their
own component; a row without id takes part in nothing and has a null component;
rows that repeat an id are one document; texts of one set are linked without
pairs; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm import common, graph

SLOT_BITS = 20
CACHE = 300_000
#: Pivots that a set meets in the star round, those it shares most prefix elements with; the exact round takes up the rest.
PIVOTS = 2
BROADCAST_IDS = 1_000_000
#: Occurrences of a slot over the mean from which its elements are dealt by salt.
HOT_SLOT, SALTS = 8, 16
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


class Shingler:
    """Distinct n-gram hashes of a text, ascending."""

    def __init__(self, n: int):
        import xxhash

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= CACHE:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        self.n, self.words, self.hash, self.digest_of = n, Words(), xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest

    def set_of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.n:
            return np.array([self.hash(b"\0" + b" ".join(words))], np.uint64)
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        m = len(w) - self.n + 1
        h = w[:m] * _MIX[0]
        for i in range(1, self.n):
            h ^= h >> np.uint64(29)
            h = (h + w[i : i + m]) * _MIX[i % len(_MIX)]
        h ^= h >> np.uint64(32)
        return np.unique(h)

    def digest(self, s: np.ndarray) -> bytes:
        return self.digest_of(s.tobytes())


def signature(s: np.ndarray) -> tuple[int, int]:
    """Parities of 128 hash classes, as two signed 64-bit numbers."""
    odd = np.bincount(((s * _MIX[4]) >> np.uint64(57)).astype(np.intp), minlength=128) & 1
    return tuple(np.packbits(odd.astype(np.uint8)).view(">i8").tolist())


def slot(s: np.ndarray) -> np.ndarray:
    return ((s * _MIX[5]) >> np.uint64(64 - SLOT_BITS)).astype(np.intp)


def least_overlap(n, t: Fraction):
    """ceil(t n)"""
    return -(-n * t.numerator // t.denominator)


def _sets(texts: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(table of doc_id, digest, n, s1, s2; slot counts) in one pass."""
    schema = "doc_id long, digest binary, n long, s1 long, s2 long, block int, packed binary"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def scan(batches):
        shingler, counts, seen = Shingler(n), np.zeros(1 << SLOT_BITS, np.int32), set()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingler.set_of(text)
                if not len(s):
                    out.append((doc_id, None, 0, None, None, None, None))
                    continue
                digest = shingler.digest(s)
                if digest not in seen:  # copies within a task count once; all of them would do as well
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen.add(digest)
                    np.add.at(counts, slot(s), 1)
                out.append((doc_id, digest, len(s), *signature(s), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)
        blocks = list(common.blocks_of(counts))
        nothing = [pa.nulls(len(blocks), t) for t in types[:5]]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=names)

    both = common.cut(texts.mapInArrow(scan, schema), "sets")

    blocks = both.filter("block is not null").select("block", F.spark_partition_id().cast("long").alias("part"), "packed")
    counts = common.add_up(blocks, 1 << SLOT_BITS, np.int32)  # the driver gets 8 MB at most
    return both.filter("block is null").drop("block", "packed"), counts


def _prefixes(texts: DataFrame, n: int, t: Fraction, counts: np.ndarray) -> DataFrame:
    """(element, digest, pos, salt) of the rare-first prefix of each distinct set; salt is above 0 for elements of slots far above the mean, which are dealt over SALTS tasks."""
    hot = HOT_SLOT * max(1.0, float(counts.mean()))
    order = texts.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 31) - 1).astype(np.int32))

    def scan(batches):
        shingler, seen, rank = Shingler(n), set(), order.value
        for batch in batches:
            elements, positions, digests, sizes, salts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingler.set_of(text)
                if not len(s) or (digest := shingler.digest(s)) in seen:
                    continue
                if len(seen) >= CACHE:
                    seen.clear()
                seen.add(digest)
                p = len(s) - least_overlap(len(s), t) + 1
                ranks = rank[slot(s)]
                first = np.argsort(ranks, kind="stable")[:p]
                elements.append(s[first])
                positions.append(np.arange(p, dtype=np.int32))
                salts.append(np.where(ranks[first] > hot, 1 + digest[0] % SALTS, 0).astype(np.int32))
                digests.append(digest)
                sizes.append(p)
            if elements:
                own = pa.array(digests, pa.binary()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(elements).view(np.int64)), own, pa.array(np.concatenate(positions)), pa.array(np.concatenate(salts))], names=["element", "digest", "pos", "salt"])

    return texts.mapInArrow(scan, "element long, digest binary, pos int, salt int")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of elements with two sets or more; of salted elements all, as their groups are not whole here."""
    group = Window.partitionBy("element", "salt")
    rows = rows.withColumn("_low", F.min("digest").over(group)).withColumn("_high", F.max("digest").over(group))
    return rows.filter("salt > 0 or _low <> _high").drop("_low", "_high", "salt")


def _overlap(t: Fraction) -> Column:
    """Fewest shared elements with which sets of ``x_n`` and ``y_n`` elements reach t."""
    p, q = t.numerator, t.denominator
    return F.expr(f"({p}L * (x_n + y_n) + {p + q - 1}L) div {p + q}L")


def _may_link(t: Fraction) -> Column:
    """Length and positional filters of a pair, from x_n, x_pos, y_n, y_pos."""
    length = F.least("x_n", "y_n") * t.denominator >= F.greatest("x_n", "y_n") * t.numerator
    return length & (F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= _overlap(t))


def _near(t: Fraction) -> Column:
    """Suffix filter of a pair, from x_n, y_n and the parity signatures."""
    differ = F.bit_count(F.col("x_s1").bitwiseXOR(F.col("y_s1"))) + F.bit_count(F.col("x_s2").bitwiseXOR(F.col("y_s2")))
    return differ <= F.col("x_n") + F.col("y_n") - 2 * _overlap(t)


def _side(df: DataFrame, side: str, *keep: str) -> DataFrame:
    """Columns but ``keep`` renamed with the side's name before them."""
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(f"{side}_{c}") for c in df.columns))


def _restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df where key is in ids; ids go to all executors only if counted as few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def _verify(pairs: DataFrame, sets: DataFrame, texts: DataFrame, n: int, t: Fraction) -> DataFrame:
    """(a, b) of the pairs of nodes whose whole sets reach t. Fewest different nodes should stand in b."""
    needed = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
    needed = common.cut(sets.select("nid", "digest", "rep").join(needed, "nid", "left_semi"), "needed")

    def scan(batches):
        shingler = Shingler(n)
        for batch in batches:
            made = [s for text in batch.column(1).to_pylist() if len(s := shingler.set_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([shingler.digest(s) for s in made], pa.binary()), pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], names=["digest", "elements"])

    ids = needed.select(F.col("rep").alias("doc_id")).distinct()
    whole = common.cut(_restrict(texts, ids, "doc_id").mapInArrow(scan, "digest binary, elements array<long>"), "whole")
    names = needed.select("digest", "nid")
    few = names.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    whole = whole.join(F.broadcast(names) if few else names, "digest").drop("digest")
    of = lambda side: _restrict(whole, pairs.select(F.col(side).alias("nid")).distinct(), "nid").select(F.col("nid").alias(side), F.col("elements").alias(f"of_{side}"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    hot = common.bounded(pairs.groupBy("b").count().filter(F.col("count") > common.HOT).select("b", F.lit(SALTS).alias("_salts")), BROADCAST_IDS)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = pairs.join(hot, "b", "left").withColumn("_salt", F.pmod(F.xxhash64("a"), salts).cast("int")).drop("_salts")
    copies = of("b").join(hot, "b", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    joined = dealt.join(of("a"), "a").join(copies, ["b", "_salt"]).select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b") - shared).alias("either"))
    return common.cut(joined.filter(F.col("shared") * t.denominator >= F.col("either") * t.numerator).select("a", "b").distinct(), "links")


def _stars(rows: DataFrame, signed: DataFrame, t: Fraction) -> DataFrame:
    """(x, y, together, x_n, y_n, signatures): sets and the pivots of their elements' groups, with the number of such groups.

    Groups of ordinary size go through a window; a hot element's pivot is found
    by an aggregate and goes to its rows where they lie.
    """
    own, element = F.struct("pos", "n", "nid"), "element"
    hot = rows.groupBy(element).count().filter(F.col("count") > common.HOT).select(element)
    hot = common.cut(hot, "hot")
    few = hot.limit(common.HOT_KEYS + 1).count() <= common.HOT_KEYS
    sent = F.broadcast(hot) if few else hot
    side = lambda df: df.select(F.col("nid").alias("x"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), F.col("y.nid").alias("y"), F.col("y.n").alias("y_n"), F.col("y.pos").alias("y_pos"), "y_s1", "y_s2").filter("x <> y").filter(_may_link(t))
    none = F.lit(None).cast("long")
    cold = rows.join(sent, element, "left_anti").withColumn("y", F.min(own).over(Window.partitionBy(element))).withColumns({"y_s1": none, "y_s2": none})
    pivots = rows.join(sent, element, "left_semi").groupBy(element).agg(F.min(own).alias("y"))
    pivots = pivots.join(signed.select(F.col("nid").alias("_nid"), F.col("s1").alias("y_s1"), F.col("s2").alias("y_s2")), F.col("y.nid") == F.col("_nid")).drop("_nid")
    met = side(cold).unionByName(side(rows.join(F.broadcast(pivots) if few else pivots, element)))
    met = common.cut(met.groupBy("x", "y").agg(F.count("*").alias("together"), *(F.max(c).alias(c) for c in ("x_n", "y_n", "y_s1", "y_s2"))), "met")
    met = met.join(_side(signed, "x").withColumnRenamed("x_nid", "x"), "x")
    return met.filter("y_s1 is not null").unionByName(met.filter("y_s1 is null").drop("y_s1", "y_s2").join(_side(signed, "y").withColumnRenamed("y_nid", "y"), "y"))


def link_documents(documents: DataFrame, n: int = 4, similarity: Fraction = Fraction(85, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) for each input row."""
    common.small_batches(documents.sparkSession)
    t = Fraction(similarity)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    members, counts = _sets(texts, n)
    usable = texts.filter("doc_id is not null")
    sets = members.filter("digest is not null and doc_id is not null").groupBy("digest")
    sets = sets.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    sets = common.cut(sets.withColumn("nid", F.monotonically_increasing_id()), "nodes")  # written, so the numbers stay

    # elements in the prefixes of two sets or more; sizes and signatures join late, to keep shuffled rows narrow
    rows = _shared(_prefixes(usable, n, t, counts))
    rows = common.cut(rows.join(sets.select("digest", "nid", F.col("n").cast("int").alias("n")), "digest").select("element", "nid", "pos", "n").distinct(), "prefixes")
    signed = sets.select("nid", "s1", "s2")
    stars = _stars(rows, signed, t).filter(_near(t))
    nearest = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("together"), "y"))
    stars = common.cut(stars.withColumn("_nearest", nearest).filter(f"_nearest <= {PIVOTS}").select(F.col("x").alias("a"), F.col("y").alias("b")), "stars")
    links = _verify(stars, sets, usable, n, t)
    labels = graph.components(links)

    # in an element's group every set meets those outside the group's largest component only
    rows = common.cut(rows.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid")), "rooted")
    roots = rows.groupBy("element", "root").agg(F.count("*").alias("k"))
    mixed = roots.groupBy("element").agg(F.sum("k").alias("n"), F.sum("k").alias("m"), F.max(F.struct("k", "root")).alias("most"), F.count("*").alias("roots")).filter("roots > 1")
    mixed = common.cut(mixed.select("element", "n", "m", F.col("most.root").alias("big")), "mixed")
    few = mixed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(mixed.drop("n")), "element") if few else common.join_back(rows, mixed, "element")
    rows = common.cut(rows.join(signed, "nid"), "apart")
    salts = F.when(F.col("m") > common.HOT, F.lit(SALTS)).otherwise(F.lit(1))
    one = _side(rows.withColumn("salt", F.pmod(F.xxhash64("nid"), salts).cast("int")).drop("m"), "x", "element", "salt", "big")
    other = _side(rows.filter("root <> big").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("m", "big"), "y", "element", "salt")
    once = (F.col("x_root") == F.col("big")) | (F.struct("x_n", "x_nid") > F.struct("y_n", "y_nid"))
    rest = one.join(other, ["element", "salt"]).filter((F.col("x_root") != F.col("y_root")) & once & _may_link(t) & _near(t))
    rest = rest.select(F.col("x_nid").alias("a"), F.col("y_nid").alias("b")).distinct()
    met = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = common.cut(rest.join(met, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_verify(rest, sets, usable, n, t))
        labels = graph.components(links)

    nodes = sets.select("digest", "nid", "rep", "copies").join(labels.withColumnRenamed("node", "nid"), "nid", "left")
    linked = nodes.filter("root is not null")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = linked.join(smallest, "root").select("digest", "component_id").unionByName(nodes.filter("root is null and copies > 1").select("digest", F.col("rep").alias("component_id")))
    named = common.cut(named, "named")
    few = named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    out = members.join(F.broadcast(named) if few else named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, n: int = 5, similarity: Fraction = Fraction(80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, unchanged, but of each component only the document with the smallest id."""
    gone = link_documents(documents, n, similarity, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = common.cut(gone, "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return documents.join(F.broadcast(gone) if few else gone, documents[id_col] == gone["_gone"], "left_anti")


def query(spark, sf_dir) -> DataFrame:
    return link_documents(common.table(spark, sf_dir, "documents"))


ORACLE = """
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
                        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) end) as s
  from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
edges as (select a, b from links union select b, a from links),
reach as (select a as doc_id, b as other from edges union select r.doc_id, e.b from reach r join edges e on r.other = e.a)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id))::bigint as component_id
from documents d left join sizes s using (doc_id) left join (select doc_id, min(other) as low from reach group by 1) m using (doc_id)
"""
