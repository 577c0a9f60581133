"""Language of whole texts by hierarchical discrimination: the family first, then linear machines one against one within it.

Features are hashed byte trigrams and tetragrams of the letters (ASCII lowered, everything else than letters and bytes
of multi-byte characters a space), as shares of the text. A linear support vector machine separates the families (one
against the rest), and for every two languages of a family another one votes. All are trained in numpy on the
driver by dual coordinate descent, on a bounded sample of labelled texts; predictions are weight sums, made in one pass.

Only text and the labelled language of training rows are ever used. A text without a letter (or null) is `und` with
score 0; without any labelled text everything is `und`. Text is never cut. Ties go to the first language in code point
order. The score is a logistic of the weakest margin on the way to the language, so between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B

#: Labelled texts per language that are learned from at most, hashed features, passes of the training, regularisation.
SAMPLE, BITS, PASSES, COST = 300, 13, 30, 50.0
#: Score below which the pipeline's stage takes a text for one of no known language.
ACCEPTED = 0.2
#: Scale of the features, which are shares of a text's letters.
UNIT = 20.0
#: Families of languages by code. A language that isn't listed is its own family.
FAMILIES = {"romance": "ca es fr gl it la oc pt ro", "germanic": "af da de en fy is lb nl nn no nb sv yi", "slavic": "be bg bs cs hr mk pl ru sk sl sr uk", "uralic": "et fi hu", "turkic": "az kk ky tr tt uz", "indic": "bn gu hi mr ne pa ur", "sinitic": "wuu yue zh", "semitic": "ar he mt"}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number of the trigram and the tetragram at each byte; 0 where it holds only non-letters."""
    c = np.zeros(len(data) + 3, np.uint32)
    c[: len(data)] = _LETTER[data]
    n = len(data)
    three = c[:n] + (c[1 : n + 1] << np.uint32(8)) + (c[2 : n + 2] << np.uint32(16))
    four = three + (c[3 : n + 3] << np.uint32(24))
    shift = np.uint32(32 - BITS)
    t = (three * np.uint32(2654435761)) >> shift
    q = ((four ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> shift
    t[c[:n] == 0] = 0
    q[c[:n] == 0] = 0
    return t, q


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 << BITS
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            x = np.zeros(size, np.float32)
            data, at = B.texts(pa.array([text.as_py()], pa.string()))
            for i in range(0, len(data), B.CHUNK):
                for g in _grams(data[i : i + B.CHUNK]):
                    x += np.bincount(g, minlength=size)
            x[0] = 0
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([x.tobytes()])], ["lang", "x"])


def _svm(x: np.ndarray, use: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Weights and bias (last) of a linear L2-loss machine on the rows `use` of x, by dual coordinate descent. x isn't copied."""
    rng = np.random.default_rng(seed)
    w, bias, a = np.zeros(x.shape[1]), 0.0, np.zeros(len(use))
    q = np.array([float(x[i] @ x[i]) for i in use]) + 1 + 0.5 / COST
    for _ in range(PASSES):
        for k in rng.permutation(len(use)):
            row = x[use[k]]
            g = y[k] * (row @ w + bias) - 1 + a[k] * 0.5 / COST
            new = max(0.0, a[k] - g / q[k])
            if new != a[k]:
                step = (new - a[k]) * y[k]
                w += step * row
                bias += step
                a[k] = new
    return np.append(w, bias)


class Model:
    """Languages, families and the machines' weights; small, and of a size that doesn't grow with the corpus."""

    def __init__(self, langs: list[str], x: np.ndarray):
        labels = np.array(langs)
        self.langs = sorted(set(langs))
        self.families = sorted({_FAMILY.get(v, v) for v in self.langs})
        family = np.array([_FAMILY.get(v, v) for v in langs])
        x *= (UNIT / np.maximum(x.sum(1) / 2, 1))[:, None]  # in place: the sample is the driver's largest table
        self.pairs = [(a, b) for a, b in combinations(self.langs, 2) if _FAMILY.get(a, a) == _FAMILY.get(b, b)]
        rows = []
        if len(self.families) > 1:
            rows = [_svm(x, np.arange(len(x)), np.where(family == f, 1.0, -1.0), k) for k, f in enumerate(self.families)]
        for k, (a, b) in enumerate(self.pairs):
            mine = np.flatnonzero((labels == a) | (labels == b))
            rows.append(_svm(x, mine, np.where(labels[mine] == a, 1.0, -1.0), 100 + k))
        self.w = np.array(rows, np.float32) if rows else np.zeros((0, x.shape[1] + 1), np.float32)

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score by rows of margins, in the order of the machines."""
        n, k = len(margins), len(self.families) if len(self.families) > 1 else 0
        fam = margins[:, :k].argmax(1) if k else np.zeros(n, int)
        weakest = margins[:, :k].max(1) if k else np.full(n, 2.0)
        votes = np.zeros((n, len(self.langs)))
        for j, (a, b) in enumerate(self.pairs):
            m = margins[:, k + j]
            votes[:, self.langs.index(a)] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, self.langs.index(b)] += (m < 0) - 1e-3 * np.tanh(m)
        of = np.array([self.families.index(_FAMILY.get(v, v)) for v in self.langs])
        votes[of[None, :] != fam[:, None]] = -9
        best = votes.argmax(1)
        for j, (a, b) in enumerate(self.pairs):
            at = (best == self.langs.index(a)) | (best == self.langs.index(b))
            weakest = np.where(at, np.minimum(weakest, np.abs(margins[:, k + j])), weakest)
        return [self.langs[i] for i in best], 1 / (1 + np.exp(-4 * np.clip(weakest, -9, 9).astype(float)))


def train(docs: DataFrame, training: Column) -> Model | None:
    """A model of the languages of rows where `training` holds; None without any. At most SAMPLE texts a language are collected, as vectors."""
    rows = docs.where(training & F.col("lang").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 1.25 * SAMPLE / n))) for k, n in sorted(counts.items())))
    key = F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    x, langs = np.zeros((SAMPLE * len(counts), 1 << BITS), np.float32), []
    for lang, v in rows.where(key < share).select("lang", "text").mapInArrow(_vectors, "lang string, x binary").toLocalIterator():
        if langs.count(lang) < SAMPLE:
            x[len(langs)] = np.frombuffer(v, np.float32)
            langs.append(lang)
    return Model(langs, x[: len(langs)]) if langs else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score; other columns stay (columns of those two names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at_text = kept.index("text")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = np.ascontiguousarray(m.w[:, :-1]) if m else np.zeros((0, 1 << BITS), np.float32)
        w = w.copy()
        w[:, 0] = 0
        for b in batches:
            data, at = B.texts(b.column(at_text))
            n = len(at) - 1
            sums, norm, letters = np.zeros((n, len(w))), np.zeros(n), np.zeros(n, bool)
            for i, j in B.chunks(at):
                lo, hi = at[i], at[j]
                for s in range(lo, hi, 2 * B.CHUNK):  # one long text in parts
                    part = data[s : min(hi, s + 2 * B.CHUNK)]
                    where = np.clip(at[i : j + 1] - s, 0, len(part))
                    part = np.insert(part, np.repeat(where[1:-1], 3), 32)  # no gram reaches into the next text
                    where = where + 3 * np.minimum(np.arange(j - i + 1), max(j - i - 1, 0))
                    for g in _grams(part):
                        total = np.zeros(len(part) + 1)
                        for k in range(len(w)):
                            np.cumsum(w[k][g], out=total[1:], dtype=np.float64)
                            sums[i:j, k] += np.diff(total[where])
                    letter = np.zeros(len(part) + 1, np.int64)
                    np.cumsum(_LETTER[part] > 0, out=letter[1:])
                    found = np.diff(letter[where])
                    norm[i:j] += found
                    letters[i:j] |= found > 0
            for i in np.flatnonzero(letters):  # bytes of characters that aren't letters
                if not (_LETTER[data[at[i] : at[i + 1]]] - 1 < 127).any():
                    letters[i] = any(map(str.isalpha, bytes(data[at[i] : at[i + 1]]).decode("utf-8", "ignore")))
            if m is None:
                pred, score = ["und"] * n, np.zeros(n)
            else:
                pred, score = m.decide(sums / np.maximum(norm, 1)[:, None] * UNIT + m.w[:, -1])
                pred = [p if ok else "und" for p, ok in zip(pred, letters, strict=True)]
                score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*kept).mapInArrow(predicted, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document isn't learned from: crc32 of its id as text leaves 2 modulo 4. A null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def reject_unknown(docs: DataFrame) -> DataFrame:
    """The rows whose text is in a known language; a null lang becomes the predicted one, other columns stay.

    Rejected are texts without a letter, and texts that no family's machine accepts (score below ACCEPTED). Without any
    labelled text there is no model, and only texts without a letter go.
    """
    model = train(docs, ~held_out(F.col("doc_id")))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= ACCEPTED))
    return found.select(*(F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns))
