"""Importance resampling of documents towards a target corpus by hashed n-grams, over bucket-partitioned inverted postings.

Map tasks turn texts into postings (bucket, document, count), laid out by bucket in blocks of BLOCK postings. Blocks are
shuffled to their bucket, where the counts of both corpora meet and give the bucket's gain; a bucket's blocks are dealt over
SALTS tasks, so one that every document has isn't read by one task. The gain times the counts are the documents' contributions, which are combined in their
task and reduced by document. Ranks come from a range sort and the sizes of its parts, never from one ordered task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytes_np as B
from .scratch import Scratch

#: Postings of a block at most, tasks over which a bucket's blocks are dealt, bytes of a feature up to which features are hashed together.
BLOCK, SALTS, TOGETHER = 1024, 32, 64
#: The pseudo-bucket that carries every document's number of words.
WORDS = -1
_POSTINGS = "bucket int, salt int, n long, docs array<bigint>, counts array<int>"


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def crc32s(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[begin:end] for each pair; short ones together, a byte of all at a time, longest first."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    out = np.full(len(size), 0xFFFFFFFF, np.uint32)
    b, s = begin[order], size[order]
    first = int(np.searchsorted(-s, -TOGETHER))  # before it: those longer than TOGETHER
    live = np.searchsorted(-s, -np.arange(int(s[first]) if first < len(s) else 0), "left")  # how many are longer than k
    c = out.copy()
    for k, n in enumerate(live.tolist()):
        x = c[first:n]
        c[first:n] = _CRC[(x ^ data[b[first:n] + k]) & 255] ^ (x >> 8)
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(first):
        c[i] = zlib.crc32(data[b[i] : b[i] + s[i]])
    out[order] = c
    return out


def features(data: np.ndarray, at: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts that end in a byte outside words, with n + 1 offsets -> (bucket, text number) of every feature, words by text."""
    low = _LOW[data]
    inside = _INSIDE[low]
    last = np.zeros(len(low), bool)
    last[1:] = inside[:-1] & ~inside[1:]
    low[last] = 32
    kept = inside | last  # every word and one space behind it
    flat = low[kept]
    end = np.flatnonzero(flat == 32)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    of = np.searchsorted(at, np.flatnonzero(last), "right") - 1
    found, owner = [], []
    for n in range(1, most + 1):
        ok = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1]) if len(of) >= n else of[:0]
        found.append(crc32s(flat, begin[ok], end[ok + n - 1]) % np.uint32(buckets))
        owner.append(of[ok])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner), np.bincount(of, minlength=len(at) - 1)


def _blocks(bucket: np.ndarray, ids: pa.Array, row: np.ndarray, count: np.ndarray, salt: int) -> pa.RecordBatch:
    """Postings ordered by bucket -> rows of _POSTINGS."""
    n = len(bucket)
    new = np.ones(n, bool)
    new[1:] = bucket[1:] != bucket[:-1]
    start = np.flatnonzero(new)
    within = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    cut = np.flatnonzero(within % BLOCK == 0)
    offsets = pa.array(np.append(cut, n).astype(np.int32))
    sums = np.add.reduceat(count, cut) if n else count
    salts = (cut // BLOCK + bucket[cut] + salt) % SALTS
    columns = [pa.array(bucket[cut].astype(np.int32)), pa.array(salts.astype(np.int32)), pa.array(sums.astype(np.int64)), pa.ListArray.from_arrays(offsets, ids.take(pa.array(row))), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "salt", "n", "docs", "counts"])


def _postings(most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            data, at = B.texts(pc.binary_join_element_wise(b.column(1).fill_null(""), "\n", ""))
            keys, counts, words = [], [], []
            for i, j in B.chunks(at):
                f, of, w = features(data[at[i] : at[j]], at[i : j + 1] - at[i], most, buckets)
                k, c = np.unique(f * (j - i) + of, return_counts=True)
                keys.append(k // (j - i) * len(ids) + k % (j - i) + i)
                counts.append(c)
                words.append(w)
            if not words:
                continue
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            salt = zlib.crc32(str(ids[0]).encode())
            out = _blocks(key // len(ids), ids, key % len(ids), count, salt)
            if out.num_rows:
                yield out
            yield _blocks(np.full(len(ids), WORDS), ids, np.arange(len(ids)), np.concatenate(words), salt)

    return run


def _ranked(scored: DataFrame, percent: int, least: int, scratch: Scratch) -> DataFrame:
    """(.., n_words, score) -> the same with rank: 1, 2, .. for the drawn documents."""
    fit = scored.where(F.col("n_words") >= least)
    draw = fit.count() * percent // 100
    placed = fit.repartitionByRange(F.desc("score"), F.asc_nulls_last("doc_id")).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = scratch.save(placed.withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    # a row for each part of the sort, as many as shuffle partitions
    parts = F.broadcast(parts.select(F.col("part").alias("p"), before.alias("before")))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = placed.join(parts, part == F.col("p")).select(*scored.columns, F.when(rank <= draw, rank).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, text) and target (text) -> doc_id, n_features, weight, score, rank (long), one row for each doc_id.

    Features are the runs of 1 to `most` words of a lower-cased (A-Z) text, hashed to `buckets`. A document's weight sums its features' gains, score adds
    its Gumbel noise, and of the documents with `least` words or more the `percent` with the highest scores get a rank; ties go
    to the smaller doc_id. Null texts have no features. Rows that repeat a doc_id are one document with the features of all of them, and so are
    all rows with a null doc_id, which rank behind equals; the text between two rows makes no feature. An empty table, or an empty target, gives what the formulas give.
    """
    scratch = Scratch(docs.sparkSession)
    laid = lambda d, key: d.select(key.alias("doc_id"), "text").mapInArrow(_postings(most, buckets), _POSTINGS)
    blocks = scratch.save(laid(docs, F.col("doc_id").cast("long")), "postings")
    real = F.col("bucket") != WORDS
    s = blocks.where(real).groupBy("bucket").agg(F.sum("n").alias("s"))
    t = laid(target, F.lit(None).cast("long")).where(real).groupBy("bucket").agg(F.sum("n").alias("t"))
    both = scratch.save(s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")), "buckets")
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0.0)), F.coalesce(F.sum("t"), F.lit(0.0))).first()
    gain = F.floor(F.lit(1000.0) * F.log((F.col("t") + 1.0) * F.lit(total[0] + buckets) / ((F.col("s") + 1.0) * F.lit(total[1] + buckets))))
    # each task gets the counts of its buckets; there are at most `buckets` of them
    met = both.where("s > 0").select("bucket", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), gain.alias("gain"))
    gained = blocks.where(real).join(met.hint("shuffle_hash"), ["bucket", "salt"]).select("gain", F.explode(F.arrays_zip("docs", "counts")).alias("x"))
    parts = gained.select(F.col("x.docs").alias("doc_id"), (F.col("gain") * F.col("x.counts")).alias("weight"), F.col("x.counts").cast("long").alias("n_features"), F.lit(0).cast("long").alias("n_words"))
    words = blocks.where(~real).select(F.explode(F.arrays_zip("docs", "counts")).alias("x"))
    parts = parts.unionByName(words.select(F.col("x.docs").alias("doc_id"), F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("n_features"), F.col("x.counts").cast("long").alias("n_words")))
    scored = parts.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("weight", "n_features", "n_words")))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = scratch.save(scored.withColumn("score", F.col("weight") + noise), "scored")
    out = _ranked(scored, percent, least, scratch)
    scratch.drop(blocks, both)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
