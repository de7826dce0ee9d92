"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line gets a good and a bad score from its own features and those of its
neighbours, and the chain joins them; forward-backward gives each line's
probability of being good, and their mean, weighted by the lines' lengths, goes
through a fitted logistic curve to the score of the text.

The field is trained in numpy on the driver, on at most ``SAMPLE`` labelled
documents (those with the least hash of their id), always with all their lines;
where these together exceed ``LINES``, on fewer documents, and one that exceeds
it alone is not in the sample. All lines of a document carry its label, as the
labels know no better, so the chain learns that neighbours agree and carries a
verdict on from telling lines to plain ones. Scoring covers
every line of every text. Nothing but the text enters a score.

Cases: null and empty texts are one empty line; without labels of both classes
every score is the share of good labels, 0.5 without any; null labels are
skipped, several labels of one id count singly, contradicting ones too; equal
texts get equal scores; each input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import common

SAMPLE = 4000
LINES = 300_000
PADDED = 1.5  # most lines of a document to the fewest, in one block of training
ROUNDS = 250
RIDGE = 1e-3
HELD_OUT = (3, 1)

_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
OWN = ("words", "word_length", "upper", "symbols", "pipes", "marks", "digits", "distinct", "seen_before", "sentence_end", "one_word", "empty", "short_words", "top_word", "wide", "commas")


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features of OWN, lengths in bytes)."""
    rows, lengths, seen = [], [], set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        n, size = len(words), len(line)
        lengths.append(size)
        if not n:
            rows.append((0.0,) * 11 + (1.0,) + (0.0,) * 4)
            continue
        letters = max(1, size - n + 1)
        again = line in seen
        seen.add(line)
        different = Counter(words)
        symbols = size - len(line.translate(None, _SYMBOLS))
        repeated = max(different.values()) / n
        rows.append((
            math.log1p(n), min(20.0, letters / n) / 10, (size - len(line.translate(None, _UPPER))) / letters, min(1.0, 4 * symbols / letters),
            min(1.0, 2 * line.count(b"|") / n), min(1.0, line.count(b"!") / n), (size - len(line.translate(None, _DIGITS))) / letters, len(different) / n, float(again),
            float(words[-1][-1:] in b".!?"), float(n == 1), 0.0, sum(len(w) < 4 for w in words) / n,
            repeated, float(max(map(len, words)) > 40), min(1.0, line.count(b",") / n * 4),
        ))
    return np.array(rows, np.float64), np.array(lengths, np.float64)


def design(own: np.ndarray) -> np.ndarray:
    """Bias, the line's features, those of the line before and after, and the ends of the text."""
    n, k = own.shape
    x = np.zeros((n, 3 * k + 3))
    x[:, 0] = 1
    x[:, 1 : k + 1] = own
    x[1:, k + 1 : 2 * k + 1] = own[:-1]
    x[:-1, 2 * k + 1 : 3 * k + 1] = own[1:]
    x[0, -2] = x[-1, -1] = 1
    return x


WIDTH = 3 * len(OWN) + 3


def marginals(scores: np.ndarray, transitions: np.ndarray) -> list[float]:
    """P(good) of each line, by forward-backward on the good-minus-bad ``scores`` (bad counts 0)."""
    (t00, t01), (t10, t11) = np.exp(transitions - transitions.max()).tolist()
    e = np.exp(np.clip(scores, -60, 60)).tolist()
    n = len(e)
    bad, good = [0.0] * n, [0.0] * n
    a, b = 1.0, e[0]
    for i in range(n):
        if i:
            a, b = bad[i - 1] * t00 + good[i - 1] * t10, (bad[i - 1] * t01 + good[i - 1] * t11) * e[i]
        s = a + b
        bad[i], good[i] = a / s, b / s
    a = b = 1.0
    out = [0.0] * n
    for i in range(n - 1, -1, -1):
        g = good[i] * b
        out[i] = g / (g + bad[i] * a)
        x, y = a, b * e[i]
        a, b = t00 * x + t01 * y, t10 * x + t11 * y
        s = a + b
        a, b = a / s, b / s
    return out


def _gradient(x, mask, labels, w, t):
    """Gradient of the mean log-likelihood of constant label sequences, over padded documents."""
    n, steps = mask.shape
    scores = np.zeros((n, steps, 2))
    scores[:, :, 1] = x @ w
    alpha = np.zeros((n, steps, 2))
    alpha[:, 0] = scores[:, 0]
    for i in range(1, steps):
        step = np.logaddexp(alpha[:, i - 1, :1] + t[0], alpha[:, i - 1, 1:] + t[1]) + scores[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    beta = np.zeros((n, steps, 2))
    for i in range(steps - 2, -1, -1):
        after = scores[:, i + 1] + beta[:, i + 1]
        step = np.logaddexp(t[:, 0] + after[:, :1], t[:, 1] + after[:, 1:])
        beta[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(alpha + beta - z[:, None, None])[:, :, 1] * mask
    weight = 1.0 / np.sqrt(mask.sum(1))[:, None]  # a long text counts for more, but not for each line
    gw = np.einsum("ntk,nt->k", x, (labels[:, None] * mask - p) * weight)
    gt = np.zeros((2, 2))
    both = mask[:, 1:] * weight
    for a in (0, 1):
        for b in (0, 1):
            pair = np.exp(alpha[:, :-1, a] + t[a, b] + scores[:, 1:, b] + beta[:, 1:, b] - z[:, None])
            gt[a, b] = ((labels[:, None] == a) * (a == b) * both - pair * both).sum()
    return gw / n, gt / n


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS) -> dict:
    """The model from (own features, lengths, label) of each sampled document; ``rate`` alone if one class is missing."""
    labels = np.array([y for *_, y in samples], float)
    rate = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return {"rate": rate}
    order = np.argsort([len(o) for o, *_ in samples], kind="stable")
    blocks = []  # of documents of like length, to pad little
    parts, sizes = [], [len(o) for o, *_ in samples]
    for part in np.array_split(order, max(1, min(12, len(order) // 50))):
        first = 0
        for i in range(1, len(part) + 1):
            if i == len(part) or sizes[part[i]] > PADDED * sizes[part[first]] + 8:
                parts.append(part[first:i])
                first = i
    for part in parts:
        steps = max(len(samples[i][0]) for i in part)
        x, mask = np.zeros((len(part), steps, WIDTH)), np.zeros((len(part), steps), bool)
        for row, i in enumerate(part):
            d = design(samples[i][0])
            x[row, : len(d)], mask[row, : len(d)] = d, True
        blocks.append((x, mask, labels[part]))
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for k in range(1, rounds + 1):
        g = np.zeros_like(theta)
        for x, mask, y in blocks:
            gw, gt = _gradient(x, mask, y, theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
            g += np.concatenate([gw, gt.ravel()]) * len(y) / len(labels)
        g -= RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = {"rate": rate, "w": theta[:WIDTH], "t": theta[WIDTH:].reshape(2, 2), "curve": (1.0, 0.0)}
    raw = np.array([logit(raw_score(o, n, model)) for o, n, _ in samples])
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps for the logistic curve, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        h = p * (1 - p)
        g = np.array([((labels - p) * raw).sum() - 0.1 * (a - 1), (labels - p).sum() - 0.1 * b])
        hess = np.array([[(h * raw * raw).sum() + 0.1, (h * raw).sum()], [(h * raw).sum(), h.sum() + 0.1]])
        da, db = np.linalg.solve(hess, g)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    model["curve"] = (max(a, 1e-3), b)
    return model


def logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def raw_score(own: np.ndarray, lengths: np.ndarray, model: dict) -> float:
    """Length-weighted mean of the lines' P(good)."""
    p = np.array(marginals(design(own) @ model["w"], model["t"]))
    weights = lengths + 1.0
    return float((p * weights).sum() / weights.sum())


def score_text(text: str, model: dict) -> float:
    if "w" not in model:
        return model["rate"]
    a, b = model["curve"]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * logit(raw_score(*line_features(text), model)) + b))))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model learnt from labels (doc_id, quality) outside the held-out fold."""
    parts, out = HELD_OUT
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    chosen = usable.filter(common.fold(F.col("doc_id"), parts) != out).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def features(batches):
        for batch in batches:
            made = [line_features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([o.tobytes() for o, _ in made], pa.binary()), pa.array([n.tobytes() for _, n in made], pa.binary()), batch.column(2), batch.column(0),
            ], names=["own", "lengths", "quality", "doc_id"])

    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = texts.select("doc_id", "quality", (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("n"), F.xxhash64("doc_id").alias("h"))
    taken, lines = set(), 0
    for r in sorted(sizes.groupBy("h", "doc_id", "quality").agg(F.sum("n").alias("n")).collect()):
        if r.n > LINES:
            continue
        if lines + r.n > LINES:
            break
        lines += r.n
        taken.add(r.doc_id)
    texts = texts.filter(F.col("doc_id").isin(taken))
    got = texts.mapInArrow(features, "own binary, lengths binary, quality int, doc_id long").collect()
    got.sort(key=lambda r: (r.doc_id, r.quality, r.own))  # the sum of gradients is the same whatever the tasks' order
    return train([(np.frombuffer(r.own).reshape(-1, len(OWN)), np.frombuffer(r.lengths), r.quality) for r in got])


def score_documents(documents: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each input row."""
    parts, out = HELD_OUT

    def scan(batches):
        for batch in batches:
            scores = [score_text(t, model) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    return texts.withColumn("held_out", common.fold(F.col("doc_id"), parts) == out).mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    common.small_batches(documents.sparkSession)
    return score_documents(documents, fit(documents, labels, sample))


def query(spark, sf_dir) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
