"""Quality of documents by co-training of a text view and a metadata view.

The text view sees the content only (shares of character classes, word and line shape, hashed trigrams); the metadata
view sees source, language and stated length only. Both are logistic regressions in numpy, first fitted on labelled
documents. In each round each view labels the documents of an unlabelled pool that it is surest of, in the proportions of
the labels, and hands them to the other view. Then each view's output is calibrated on labelled documents that neither
has learned from, and the two are combined as independent evidence on the same prior.

Learning uses bounded samples (LABELLED and POOL documents); every document is scored whole, once. Labels of a document
that disagree count as their mean, rounded down. Without a label all scores are 0.5; with labels of one class only the
views have nothing to separate and scores are the smoothed share of that class. Null text is empty, and null metadata is
a value of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B

#: Bounds of the samples, rounds of co-training, share of the pool that a view hands over in a round, hashed features.
LABELLED, POOL, ROUNDS, SHARE, GRAMS, SOURCES = 3000, 3000, 4, 0.05, 512, 128
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n\r\t", b".,;:!?'\"()-", range(128, 256)), 1):
    _KIND[list(_chars)] = _k
SHAPE = 16


def text_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row per text: shape features, then hashed trigram shares. Long texts are counted in parts."""
    out = np.zeros((len(at) - 1, SHAPE + GRAMS), np.float32)
    for i in range(len(at) - 1):
        n, kinds, grams, words, distinct, capitals = at[i + 1] - at[i], np.zeros(8), np.zeros(GRAMS), 0, 0, 0
        for lo in range(at[i], at[i + 1], B.CHUNK):
            part = data[lo : min(at[i + 1], lo + B.CHUNK)]
            kind = _KIND[part]
            kinds += np.bincount(kind, minlength=8)
            c = part.astype(np.uint32)
            if len(c) > 2:
                grams += np.bincount(((c[:-2] | c[1:-1] << np.uint32(8) | c[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(23), minlength=GRAMS)
            inner = (kind == 1) | (kind == 2) | (kind == 3) | (kind == 7)
            words += int((inner[1:] & ~inner[:-1]).sum() + inner[:1].sum())
            capitals += int(((kind[1:] == 2) & (kind[:-1] == 2)).sum())
            h, _ = B.words(part, np.array([0, len(part)]))
            distinct += len(np.unique(h)) / max(len(h), 1) * len(part)
        m = max(n, 1)
        out[i, :8] = kinds / m * 4
        out[i, 8:14] = np.log1p(n) / 5, np.log1p(words) / 5, min(kinds[[1, 2, 3, 7]].sum() / max(words, 1), 20) / 5, capitals / m * 4, distinct / m * 2, kinds[5] / m * 20
        out[i, SHAPE:] = np.sqrt(grams / m) * 2
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(source), SOURCES + 32 + 4), np.float32)
    for i, (s, v, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, crc32(repr(s).encode()) % SOURCES] = 1
        out[i, SOURCES + crc32(repr(v).encode()) % 32] = 1
        x = np.log1p(max(n, 0)) / 5 if n is not None else -1
        out[i, SOURCES + 32 :] = x, x * x, abs(x - 1.4), n is None
    return out


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1e-2, rounds: int = 300) -> np.ndarray:
    """Logistic regression with balanced classes, by accelerated gradient descent; bias last."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = w * np.where(y == 1, 0.5 / max((w * y).sum(), 1e-9), 0.5 / max((w * (1 - y)).sum(), 1e-9))
    rate = 1 / (0.25 * (w[:, None] * x * x).sum() + penalty)
    b, z = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 0
    for i in range(rounds):
        g = x.T @ (w * (1 / (1 + np.exp(-(x @ z))) - y)) + ridge * z
        new = z - rate * g
        b, z = new, new + i / (i + 3) * (new - b)
    return b


def _margin(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ b[:-1] + b[-1]


class Model:
    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray]):
        self.prior = (y.sum() + 0.5) / (len(y) + 1)
        self.b = self.scale = None
        if len(np.unique(y)) < 2:
            return
        held = np.arange(len(y)) % 4 == 3
        if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
            held[:] = False
        use = ~held
        xs, ys, ws = ([v[use] for v in views], [y[use].astype(float)] * 2, [np.ones(use.sum())] * 2)
        left = np.ones(len(pool[0]), bool)
        self.b = [_fit(x, t, w) for x, t, w in zip(xs, ys, ws, strict=True)]
        for _ in range(ROUNDS):
            give = max(1, int(SHARE * len(left)))
            for mine, other in ((0, 1), (1, 0)):
                m = np.where(left, _margin(self.b[mine], pool[mine]), 0)
                order = np.argsort(m, kind="stable")
                low, high = order[: max(1, round(give * (1 - self.prior)))], order[::-1][: max(1, round(give * self.prior))]
                low, high = low[m[low] < -1], high[m[high] > 1]
                new = np.concatenate([low, high])
                left[new] = False
                xs[other] = np.concatenate([xs[other], pool[other][new]])
                ys[other] = np.concatenate([ys[other], np.repeat([0.0, 1.0], [len(low), len(high)])])
                ws[other] = np.concatenate([ws[other], np.full(len(new), 0.5)])
            self.b = [_fit(x, t, w) for x, t, w in zip(xs, ys, ws, strict=True)]
        test = held if held.any() else use
        self.scale = [self._platt(_margin(b, v[test]), y[test]) for b, v in zip(self.b, views, strict=True)]

    @staticmethod
    def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope (not negative) and offset of a logistic calibration with smoothed targets, by Newton's method."""
        up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
        t, a, c = np.where(y == 1, up, down), 1.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
            d, q = p - t, p * (1 - p) + 1e-9
            h = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-3]])
            step = np.linalg.solve(h, [(d * m).sum() + 1e-3 * (a - 1), d.sum()])
            a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
        return max(a, 0.0), c if a > 0 else float(np.log(t.mean() / (1 - t.mean())))

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view, and of both together."""
        n, base = len(text), np.log(self.prior / (1 - self.prior))
        if self.b is None:
            return (np.full(n, self.prior),) * 3
        logit = [np.clip(a * _margin(b, x) + c, -30, 30) for (a, c), b, x in zip(self.scale, self.b, (text, meta), strict=True)]
        p = lambda v: 1 / (1 + np.exp(-v))
        return p(logit[0]), p(logit[1]), p(np.clip(logit[0] + logit[1] - base, -30, 30))


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    get = lambda c: b.column(b.schema.get_field_index(c))
    return text_features(*B.texts(get("text"))), meta_features(get("source").to_pylist(), get("lang").to_pylist(), get("n_chars").to_pylist())


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t, m = _views(b)
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("y")), b.column(b.schema.get_field_index("doc_id")), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], ["y", "doc_id", "t", "m"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs (doc_id, text, source, lang, n_chars), labels (doc_id, quality 0/1) -> a model; None without a label."""
    y = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.floor(F.avg("quality")).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in y.where("y in (0, 1)").groupBy("y").count().collect()}
    n = sum(counts.values())
    if not n:
        return None
    key = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # at most about LABELLED rows, so the broadcast is bounded; the rarer class fills up to half of them
    share = F.coalesce(*(F.when(F.col("y") == k, F.lit(min(1.0, max(LABELLED / n, LABELLED / 2 / v) if v < n / 2 else LABELLED / 2 / v))) for k, v in sorted(counts.items())))
    some = y.where("y in (0, 1)").where(key < share)
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars")
    marked = rows.join(F.broadcast(some), "doc_id")
    total = max(docs.count(), 1)
    pool = rows.where(key >= F.lit(1 - min(1.0, POOL / total))).withColumn("y", F.lit(-1))
    taken = pool.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").select(marked.columns).union(marked)
    got = taken.mapInArrow(_featured, "y int, doc_id long, t binary, m binary").collect()  # at most about LABELLED + POOL rows
    got.sort(key=lambda r: (-1 if r[1] is None else crc32(str(r[1]).encode()), r[0], r[2]))
    wide = [np.frombuffer(r[2], np.float32) for r in got], [np.frombuffer(r[3], np.float32) for r in got]
    kind = np.array([r[0] for r in got], int)
    if not (kind >= 0).any():
        return None
    t, m = np.array(wide[0]), np.array(wide[1])
    return Model((t[kind >= 0], m[kind >= 0]), kind[kind >= 0], (t[kind < 0], m[kind < 0]))


_SCORES = "doc_id long, text_score double, meta_score double, score double, kept boolean"


def score(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """doc_id, calibrated scores of the views and of both, kept (score >= least); one row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, m = _views(b)
            s = shared.value.score(t, m) if shared.value else (np.full(b.num_rows, 0.5),) * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, s), pa.array(s[2] >= least)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")).mapInArrow(rows, _SCORES)
