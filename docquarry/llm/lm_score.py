"""Language-model scores: a word unigram base, and causal self-attention over subword ids.

The attention model predicts the class of the next subword, then the subword
within its class:

    log p(next) = log softmax(T[last] + o U)[class] + log p(next | class)

T is the smoothed log-frequency of each class after each subword and
p(. | class) the smoothed share in the class, both counted over every training
text; classes are clusters of subwords that follow alike subwords. o is the
output of one causal attention head with distance bias over the window. Its
embeddings and projections and U are trained in numpy by Adam, on executors.
Training texts are dealt into shards by a hash of id and text, and shards into
``ROUNDS`` rounds, so each window is trained on once. Each shard of a round
starts from the same weights and goes through its texts in order of a hash;
then the shards' changes are averaged, a subword's embedding by how often each
shard met it and the rest by windows, and the next round starts there. Their
number follows from the count of subwords, so the weights do not depend on how
the input is split. What is gathered grows with the corpus, while what comes to
the driver is one table of counts and one set of weights.

A text is scored in windows of ``WINDOW`` positions that overlap by
``CONTEXT``; each scores what stands after its first ``CONTEXT`` positions, so
every subword, the closing one included, is scored once, with that many
positions of context at least (marks stand before the text's beginning).

The base needs the counts of all words. The most frequent (at most ``HEAD``,
by a count threshold) are broadcast as hash and count; the other words of each
text join their counts by hash.

Cases: null texts count as empty; an empty text is its end token alone; without
training texts N is 0 and V is 0; each input row gives one output row, repeated
rows included; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import common, subwords

HELD_OUT = (5, 1)
HEAD = 1 << 19
COUNTED = 64 << 20  # bytes of words counted at once
ROWS = 50_000  # rows of counts handed on at once
SLICE = 100_000  # different words hashed at once

VOCAB = subwords.SIZE
MARK = VOCAB - 1  # stands before the first and after the last subword
MARKS = np.array([MARK], np.uint16)
CLASSES = 48
BUCKETS = 32
WINDOW, CONTEXT = 32, 8
STRIDE = WINDOW - CONTEXT
WIDTH, KEY = 16, 8
HEADS = 2 * KEY + WIDTH  # query, key and value of a position together
SLOPE = 0.15
#: Parts of the shards that are trained on one after the other.
ROUNDS = 4
#: Subwords of a shard; shards grow where a round would have more than MOST_SHARDS.
SHARD, MOST_SHARDS = 1 << 21, 1 << 14
BATCH, RATE = 64, 0.01
TALLY = 1_000_000
CHUNK = 128  # windows scored at once


# ---- words -----------------------------------------------------------------

END = b"\n"  # the end token among words; no word holds white space


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, made in slices as each word is a Python object meanwhile."""
    import xxhash

    out = np.empty(len(words), np.uint64)
    for i in range(0, len(words), SLICE):
        part = words.slice(i, SLICE).cast(pa.binary()).to_numpy(zero_copy_only=False)
        out[i : i + SLICE] = np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part))
    return (out ^ np.uint64(1 << 63)).view(np.int64)


END_HASH = word_hashes(pa.array([END]))[0]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, A-Z lower-cased, and their number in each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(words, "")  # white space at the beginning or end leaves an empty piece
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), np.diff(before[np.concatenate([[0], ends]).astype(np.int64)])


class WordCounts:
    """Counts of words; gathered and counted together, as each count row that leaves must be added up later."""

    def __init__(self):
        self.parts, self.held, self.ends = [], 0, 0

    def add(self, texts: pa.Array) -> None:
        words, _ = words_of(texts)
        self.parts.append(words)
        self.held += words.nbytes
        self.ends += len(texts)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of what was added since the last call, the end tokens included."""
        found = pc.value_counts(pa.chunked_array([*self.parts, pa.array([], pa.string())]))
        words, n = word_hashes(found.field("values")), found.field("counts").to_numpy(zero_copy_only=False)
        if self.ends:
            words, n = np.append(words, END_HASH), np.append(n, self.ends)
        self.__init__()
        return words, n


class BaseScorer:
    """Sums log10((c + 0.5) / z) over words whose count is at hand, and lists the hashes of the others."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, z: float):
        self.hashes, self.logs = hashes, np.log10((counts + 0.5) / z)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """The logs of the hashes, 0 where the count is not at hand (no logarithm of a share is 0)."""
        if not len(self.hashes):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.logs[at], 0.0)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """For each text, the end token included: tokens, those at hand, their sum, hashes of those that must join."""
        words, n = words_of(texts)
        coded = words.dictionary_encode()  # each different word is hashed and looked up once
        hashes = np.append(word_hashes(coded.dictionary), END_HASH)
        each = np.insert(coded.indices.to_numpy(), np.cumsum(n), len(hashes) - 1)
        logs, owner, n = self._look_up(hashes)[each], np.repeat(np.arange(len(n)), n + 1), n + 1
        at = np.flatnonzero(logs == 0.0)
        rare = np.bincount(owner[at], minlength=len(n))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)]), pa.int32()), pa.array(hashes[each[at]]))
        return n, n - rare, np.bincount(owner, logs, len(n)), lists


# ---- the model -------------------------------------------------------------

def buckets_of(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - int(math.log2(BUCKETS)))


def make_classes(follows: np.ndarray, k: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """The class of each subword, from its counts (VOCAB x BUCKETS) after each bucket of subwords.

    The k/2 most frequent stand alone; the rest are clustered by the direction
    of their smoothed profiles, with the most frequent as first centres.
    """
    total = follows.sum(1)
    order = np.argsort(-total, kind="stable")
    alone = k // 2
    out = np.zeros(VOCAB, np.int64)
    out[order[:alone]] = np.arange(alone)
    rest = order[alone:]
    prior = (follows.sum(0) + 1.0) / (total.sum() + BUCKETS)
    profile = np.sqrt((follows[rest] + 5 * prior) / (total[rest, None] + 5))
    profile -= np.sqrt(prior)
    profile = (profile / (np.linalg.norm(profile, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
    heavy = min(len(rest), 6000)
    centres = profile[: k - alone].copy()
    weight = np.sqrt(total[rest[:heavy]] + 1.0)[:, None]
    for _ in range(rounds):
        near = (profile[:heavy] @ centres.T).argmax(1)
        for c in range(k - alone):
            if (near == c).any():
                m = (profile[:heavy] * weight)[near == c].sum(0)
                centres[c] = m / (np.linalg.norm(m) + 1e-9)
    out[rest] = alone + (profile @ centres.T).argmax(1)
    return out


def make_tables(pairs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, log share of each subword in its class) from counts of (subword, next class) and of the subwords themselves.

    ``pairs`` is VOCAB x (CLASSES + 1); its last column counts the subword as a target.
    """
    nexts, targets = pairs[:, :CLASSES].astype(np.float64), pairs[:, CLASSES].astype(np.float64)
    overall = (nexts.sum(0) + 0.5) / (nexts.sum() + 0.5 * CLASSES)
    by_class = np.zeros((CLASSES, CLASSES))
    np.add.at(by_class, classes, nexts)
    by_class = (by_class + 10 * overall) / (by_class.sum(1, keepdims=True) + 10)
    t = np.log((nexts + 20 * by_class[classes]) / (nexts.sum(1, keepdims=True) + 20))
    smooth = targets + 0.1
    share = np.log(smooth / np.bincount(classes, smooth, CLASSES)[classes])
    return t.astype(np.float32), share.astype(np.float32)


def fresh_weights(seed: int = 1) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    shape = {"e": (VOCAB, WIDTH), "q": (WIDTH, KEY), "k": (WIDTH, KEY), "v": (WIDTH, WIDTH), "u": (WIDTH, CLASSES)}
    scale = {"e": 0.5, "q": 0.3, "k": 0.3, "v": 0.3, "u": 0.03}
    return {n: (r.standard_normal(s) * scale[n]).astype(np.float32) for n, s in shape.items()}


def distance_bias() -> np.ndarray:
    """STRIDE x WINDOW: the slope times the distance of each key from a scored position; none from the right."""
    gap = np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
    return np.where(gap < 0, -1e9, -SLOPE * gap).astype(np.float32)


DECAY = np.exp(distance_bias())


def train_step(w: dict, table: np.ndarray, x: np.ndarray, y: np.ndarray, seen: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """(loss, gradients, rows) for windows of ids x, next classes y and the mask of real targets.

    The gradient of "e" is that of the given rows only.
    """
    kind, ids, n = w["e"].dtype, x.ravel(), len(x)
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # radix sort
    ordered = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    flat = lambda a: a.reshape(-1, a.shape[-1])
    e = w["e"].take(ids, 0, mode="clip")
    # queries, keys, values and a one side by side: one product makes all, and the attention's norm comes with its output
    w_all = np.hstack([w["q"] * kind.type(1 / math.sqrt(KEY)), w["k"], w["v"]])
    every = np.empty((n, WINDOW, HEADS + 1), kind)
    every[:, :, :HEADS] = (e @ w_all).reshape(n, WINDOW, HEADS)
    every[:, :, HEADS] = 1
    turned = np.ascontiguousarray(every[:, :, KEY:].transpose(0, 2, 1))
    q, k = every[:, CONTEXT:, :KEY], every[:, :, KEY : 2 * KEY]
    p = q @ turned[:, :KEY]
    np.clip(p, -30, 30, out=p)
    np.exp(p, out=p)
    p *= DECAY  # distance bias and causal mask at once; each row is still to be divided by its norm
    o = flat(p @ every[:, :, 2 * KEY :])
    norm = o[:, WIDTH:].copy()
    o = o[:, :WIDTH] / norm
    z = table.take(x[:, CONTEXT:].ravel(), 0, mode="clip")
    z += o @ w["u"]
    np.exp(z, out=z)
    mass = seen.ravel() / kind.type(max(1, seen.sum()))
    at, total = (np.arange(len(z)), y.ravel()), z @ np.ones(CLASSES, kind)
    own = z[at]
    loss = -float(np.log(own / total) @ mass)
    z[at] = own - total  # times the scale, z is now the gradient of the scores
    scale = (mass / total)[:, None]
    do = np.empty((n, STRIDE, WIDTH + 1), kind)
    back = flat(do)
    np.multiply(z @ w["u"].T, scale / norm, out=back[:, :WIDTH])
    np.negative(np.einsum("ij,ij->i", o, back[:, :WIDTH]), out=back[:, WIDTH])
    ds = do @ turned[:, KEY:]
    ds *= p
    d = np.empty((n, WINDOW, HEADS), kind)
    d[:, :CONTEXT, :KEY] = 0
    d[:, CONTEXT:, :KEY] = ds @ k
    d[:, :, KEY : 2 * KEY] = ds.transpose(0, 2, 1) @ q
    d[:, :, 2 * KEY :] = p.transpose(0, 2, 1) @ do[:, :, :WIDTH]
    d = flat(d)
    de = np.add.reduceat(np.ascontiguousarray((d @ w_all.T).take(order, 0).T), starts, 1).T
    g = e.T @ d
    o *= scale
    return loss, {"e": de, "q": g[:, :KEY] * kind.type(1 / math.sqrt(KEY)), "k": g[:, KEY : 2 * KEY], "v": g[:, 2 * KEY :], "u": o.T @ z}, ordered[starts]


def windows_in(n: int) -> int:
    """Windows over n subwords and the closing mark."""
    return n // STRIDE + 1


def padded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, real targets) by window; each target stands in exactly one."""
    m = windows_in(len(ids))
    full = np.full(m * STRIDE + CONTEXT + 1, MARK, np.int64)
    full[CONTEXT + 1 : CONTEXT + 1 + len(ids)] = ids
    inputs = np.lib.stride_tricks.sliding_window_view(full, WINDOW)[::STRIDE]
    return inputs, full[CONTEXT + 1 :].reshape(m, STRIDE), (np.arange(m * STRIDE) <= len(ids)).reshape(m, STRIDE)


class Model:
    """log10 probability of id sequences, many windows at a time."""

    def __init__(self, weights: dict, classes: np.ndarray, table: np.ndarray, share: np.ndarray):
        e = weights["e"]
        self.q = (e @ weights["q"]) * np.float32(1 / math.sqrt(KEY))
        # keys, values and a one side by side: one look-up a position, and the attention's norm comes with its output
        self.kv = np.hstack([e @ weights["k"], e @ weights["v"], np.ones((VOCAB, 1), np.float32)])
        self.u, self.table, self.share, self.classes = weights["u"], table, share, classes
        self.ones = np.ones(CLASSES, np.float32)
        # no product of a query and a key is beyond the product of the longest two
        self.clipped = not np.linalg.norm(self.q, axis=1).max() * np.linalg.norm(self.kv[:, :KEY], axis=1).max() < 30

    def window_scores(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural-log probability of each target given its window so far (batched, masked)."""
        late = x[:, CONTEXT:].ravel()
        kv = self.kv.take(x.ravel(), 0, mode="clip").reshape(len(x), WINDOW, -1)
        s = self.q.take(late, 0, mode="clip").reshape(len(x), STRIDE, KEY) @ kv[:, :, :KEY].transpose(0, 2, 1)
        if self.clipped:
            np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= DECAY
        o = (s @ kv[:, :, KEY:]).reshape(-1, WIDTH + 1)
        z = self.table.take(late, 0, mode="clip")
        z += (o[:, :WIDTH] / o[:, WIDTH:]) @ self.u
        target, y_flat = self.classes.take(y), y.ravel()
        own = z[np.arange(len(z)), target.ravel()]
        np.exp(z, out=z)
        return (own - np.log(z @ self.ones) + self.share.take(y_flat)).reshape(y.shape)

    def score_many(self, texts_ids: list[np.ndarray]) -> list[float]:
        """log10 probability of each sequence, windows of all of them batched."""
        parts = [padded(ids) for ids in texts_ids]
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        x, y, seen = (np.concatenate([p[i] for p in parts]) for i in range(3))
        total = np.zeros(len(parts))
        for i in range(0, len(x), CHUNK):
            got = np.where(seen[i : i + CHUNK], self.window_scores(x[i : i + CHUNK], y[i : i + CHUNK]), 0)
            total += np.bincount(owner[i : i + CHUNK], got.sum(1, dtype=np.float64), len(parts))
        return (total / math.log(10)).tolist()


# ---- passes ----------------------------------------------------------------

class Tally:
    """Counts of numbers below ``size``; arrays are gathered and counted together."""

    def __init__(self, size: int):
        self.total, self.parts, self.waiting = np.zeros(size, np.int32), [], 0

    def add(self, numbers: np.ndarray) -> None:
        self.parts.append(numbers)
        self.waiting += len(numbers)
        if self.waiting > TALLY:
            self.flush()

    def flush(self) -> np.ndarray:
        if self.parts:
            self.total += np.bincount(np.concatenate(self.parts), minlength=len(self.total)).astype(np.int32)
            self.parts, self.waiting = [], 0
        return self.total


def _read(documents: DataFrame, paths) -> DataFrame:
    """Rows of texts (rid, doc_id, held_out, text, ids), of word counts (word, n) and of follow counts (block, packed)."""

    def scan(batches):
        encode = subwords.shared(paths).encode
        words, follows = WordCounts(), Tally(VOCAB * BUCKETS)
        nothing = pa.nulls

        def counts():
            keys, times = words.taken()
            n = len(keys)
            for i in range(0, max(n, 1), ROWS):
                m = min(ROWS, n - i)
                yield pa.RecordBatch.from_arrays([nothing(m, pa.int64()), nothing(m, pa.bool_()), nothing(m, pa.string()), nothing(m, pa.binary()), pa.array(keys[i : i + m]), pa.array(times[i : i + m], pa.int64()), nothing(m, pa.int32()), nothing(m, pa.binary())], names=names)

        for batch in batches:
            out, row = [], []
            held_out = batch.column("held_out")
            words.add(batch.column("text").filter(pc.invert(held_out)))
            for text, held in zip(batch.column("text").to_pylist(), held_out.to_pylist()):
                ids = np.array(encode(text), np.uint16)
                out.append(ids.tobytes())
                if not held:
                    row += MARKS, ids
            if row:
                both = np.concatenate([*row, MARKS]).astype(np.int64)
                follows.add((both[1:] * BUCKETS + buckets_of(both[:-1])).astype(np.int32))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("text"), pa.array(out, pa.binary()), nothing(n, pa.int64()), nothing(n, pa.int64()), nothing(n, pa.int32()), nothing(n, pa.binary())], names=names)
            if words.held > COUNTED:  # bounded; the counts are added up later
                yield from counts()
        yield from counts()
        blocks = list(common.blocks_of(follows.flush()))
        n = len(blocks)
        yield pa.RecordBatch.from_arrays([nothing(n, pa.int64()), nothing(n, pa.bool_()), nothing(n, pa.string()), nothing(n, pa.binary()), nothing(n, pa.int64()), nothing(n, pa.int64()), pa.array([b for b, _ in blocks], pa.int32()), pa.array([p for _, p in blocks], pa.binary())], names=names)

    names = ["doc_id", "held_out", "text", "ids", "word", "n", "block", "packed"]
    schema = "doc_id long, held_out boolean, text string, ids binary, word long, n long, block int, packed binary"
    made = documents.mapInArrow(scan, schema).withColumn("rid", F.monotonically_increasing_id())
    return common.cut(made, "read", "zstd")  # written, so the row numbers stay


def _count_pairs(texts: DataFrame, classes: np.ndarray) -> np.ndarray:
    cls = texts.sparkSession.sparkContext.broadcast(classes)

    def scan(batches):
        own, pairs, seen = cls.value, Tally(VOCAB * (CLASSES + 1)), Tally(VOCAB)
        for batch in batches:
            row = [x for raw in batch.column(0).to_pylist() for x in (MARKS, np.frombuffer(raw, np.uint16))]
            if row:  # a mark ends one text and begins the next
                both = np.concatenate([*row, MARKS]).astype(np.int64)
                pairs.add((both[:-1] * (CLASSES + 1) + own[both[1:]]).astype(np.int32))
                seen.add(both[1:].astype(np.int32))
        total = pairs.flush()
        total[CLASSES :: CLASSES + 1] = seen.flush()
        blocks = list(common.blocks_of(total))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([p for _, p in blocks], pa.binary())], names=["block", "packed"])

    rows = texts.filter("not held_out").select("ids").mapInArrow(scan, "block int, packed binary").withColumn("part", F.spark_partition_id().cast("long"))
    total = common.add_up(rows, VOCAB * (CLASSES + 1), np.int32).reshape(VOCAB, CLASSES + 1)
    cls.destroy()
    return total


NAMES = ("e", "q", "k", "v", "u")
SMALL = NAMES[1:]


class Trainer:
    """Adam over the windows of one shard, from given weights."""

    def __init__(self, weights: dict, classes: np.ndarray, table: np.ndarray):
        self.start, self.classes, self.table = weights, classes, table
        # the small weights are views of one array, updated at once
        flat, self.w, at = np.concatenate([weights[n].ravel() for n in SMALL]), {"e": weights["e"].copy()}, 0
        for n in SMALL:
            self.w[n] = flat[at : at + weights[n].size].reshape(weights[n].shape)
            at += weights[n].size
        self.flat, self.m, self.v = flat, np.zeros_like(flat), np.zeros_like(flat)
        self.rows = np.zeros((VOCAB, 2 * WIDTH), np.float32)  # both moments of "e"
        self.met, self.done, self.windows, self.pool, self.waiting = np.zeros(VOCAB, np.float32), 0, 0, [], 0

    def add(self, ids: np.ndarray) -> None:
        """Full steps only; what is left waits for the next text."""
        self.pool.append(padded(ids))
        self.waiting += len(self.pool[-1][0])
        self.windows += len(self.pool[-1][0])
        if self.waiting >= BATCH:
            x, y, seen = (np.concatenate([c[i] for c in self.pool]) for i in range(3))
            full = self.waiting - self.waiting % BATCH
            for i in range(0, full, BATCH):
                self._learn(x[i : i + BATCH], y[i : i + BATCH], seen[i : i + BATCH])
            self.pool, self.waiting = [(x[full:], y[full:], seen[full:])], self.waiting - full

    def _learn(self, x, y, seen) -> None:
        _, g, rows = train_step(self.w, self.table, x, self.classes[y], seen)
        self.done += 1
        self.met[rows] += 1
        small = np.concatenate([g[n].ravel() for n in SMALL])
        self.m += 0.1 * (small - self.m)
        self.v += 0.01 * (small * small - self.v)
        self.flat -= RATE / (1 - 0.9**self.done) * self.m / (np.sqrt(self.v / (1 - 0.99**self.done)) + 1e-6)
        k, both = self.met[rows][:, None], self.rows.take(rows, 0, mode="clip")  # a row of "e" counts the steps that met it
        m, v = both[:, :WIDTH], both[:, WIDTH:]
        m += 0.1 * (g["e"] - m)
        v += 0.01 * (g["e"] * g["e"] - v)
        self.rows[rows] = both
        self.w["e"][rows] -= (RATE / (1 - 0.9**k)) * m / (np.sqrt(v) / np.sqrt(1 - 0.99**k) + 1e-6)

    def changes(self) -> np.ndarray:
        """Changes of "e" times the steps that met a row, of the rest times windows; then these counts."""
        if self.waiting:
            self._learn(*(np.concatenate([c[i] for c in self.pool]) for i in range(3)))
            self.pool, self.waiting = [], 0
        by = {n: self.met[:, None] if n == "e" else np.float32(self.windows) for n in NAMES}
        return np.concatenate([((self.w[n] - self.start[n]) * by[n]).ravel() for n in NAMES] + [self.met, np.float32([self.windows])])


def _averaged(weights: dict, total: np.ndarray) -> dict:
    """The weights moved by the mean of the changes that ``total`` sums up."""
    out, at = {}, 0
    met, windows = np.maximum(total[-VOCAB - 1 : -1], 1)[:, None], max(1.0, total[-1])
    for n in NAMES:
        change = total[at : at + weights[n].size].reshape(weights[n].shape)
        out[n] = (weights[n] + change / (met if n == "e" else windows)).astype(np.float32)
        at += weights[n].size
    return out


def _train_round(texts: DataFrame, weights: dict, classes: np.ndarray, table: np.ndarray, shards: int, part: int, parts: int) -> dict:
    """The weights after the ``shards`` shards of part ``part`` of the training texts."""
    sent = texts.sparkSession.sparkContext.broadcast((weights, classes, table))

    def scan(batches):
        start, shard, trainer = sent.value, None, None

        def ended():
            blocks = list(common.blocks_of(trainer.changes()))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([shard] * len(blocks), pa.int64()), pa.array([p for _, p in blocks], pa.binary())], names=["block", "part", "packed"])

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != shard:
                    if trainer:
                        yield ended()
                    shard, trainer = own, Trainer(*start)
                trainer.add(np.frombuffer(raw, np.uint16))
        if trainer:
            yield ended()

    # equal rows are alike in place of each other; rows without id have nothing but their number to deal them by
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("rid")), "ids")
    dealt = texts.filter("not held_out").select("doc_id", "ids", key.alias("_key")).filter(F.pmod("_key", F.lit(parts)) == part)
    dealt = dealt.withColumn("_shard", F.pmod(F.shiftright("_key", 20), F.lit(shards)))
    dealt = dealt.repartition(shards, "_shard").sortWithinPartitions("_shard", "_key", "doc_id").select("_shard", "ids")
    size = sum(weights[n].size for n in NAMES) + VOCAB + 1
    total = common.add_up(dealt.mapInArrow(scan, "block int, part long, packed binary"), size, np.float32)
    sent.destroy()
    return _averaged(weights, total)


def _head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes and counts of all words above the least threshold that leaves at most ``most``."""
    step = F.when(F.col("n") <= 64, F.col("n")).otherwise((64 + F.floor(8 * F.log2(F.col("n") / 64))).cast("long"))
    sizes = counts.groupBy(step.alias("step")).count().collect()  # a few hundred rows whatever the corpus
    kept, least = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["step"]):
        if kept + r["count"] > most:
            break
        kept, least = kept + r["count"], r["step"]
    got = counts.filter(step >= least).select("word", "n").toArrow()
    words, n = got.column("word").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(words)
    return words[order], n[order]


def score_documents(documents: DataFrame, head: int = HEAD, rounds: int = ROUNDS, paths=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords for each input row."""
    spark = documents.sparkSession
    common.small_batches(spark, 256, "4m")
    parts, out = HELD_OUT
    own_id = F.col(id_col).cast("long")
    docs = documents.select(own_id.alias("doc_id"), (common.fold(own_id, parts) == out).alias("held_out"), common.text_of(text_col).alias("text"))
    read = _read(docs, paths or subwords.vocabulary_paths())
    texts = read.filter("held_out is not null").select("rid", "doc_id", "held_out", "text", "ids")

    counts = common.cut(read.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    z = total + 0.5 * (distinct + 1)
    hashes, numbers = _head(counts, head)

    follows = common.add_up(read.filter("block is not null").withColumn("part", F.spark_partition_id().cast("long")), VOCAB * BUCKETS, np.int32).reshape(VOCAB, BUCKETS)
    classes = make_classes(follows)
    table, share = make_tables(_count_pairs(texts, classes), classes)
    weights, shards = fresh_weights(), min(MOST_SHARDS, 1 + int(follows.sum()) // (max(1, rounds) * SHARD))
    for part in range(rounds):
        weights = _train_round(texts, weights, classes, table, shards, part, rounds)

    sent = spark.sparkContext.broadcast((weights, classes, table, share, hashes, numbers))

    def scan(batches):
        w, c, t, s, h, n = sent.value
        model, base = Model(w, c, t, s), BaseScorer(h, n, z)
        for batch in batches:
            ids = [np.frombuffer(b, np.uint16).astype(np.int64) for b in batch.column(4).to_pylist()]
            scores = model.score_many(ids) if ids else []
            if not batch.num_rows:
                continue
            tokens, known, sums, rare = base(batch.column(3))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array(tokens), pa.array(known), pa.array(sums), rare, pa.array(scores, pa.float64()), pa.array([len(i) + 1 for i in ids], pa.int64()),
            ], names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "rare", "score", "n_subwords"])

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<long>, score double, n_subwords long"
    scored = common.cut(texts.mapInArrow(scan, schema), "scored")
    sent.destroy()
    rare = scored.select("rid", F.explode("rare").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("times"))
    rare = rare.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(z))).alias("rest"))
    joined = scored.drop("rare").join(rare, "rid", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score", "n_subwords",
    )


def query(spark, sf_dir) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))
