"""Packing of documents into fixed windows by lexical retrieval.

Every document's ids end with one separator. Whole windows of a document become sequences of their own; what remains
(less than a window) is packed with what remains of lexically close documents. Remainders are range-sorted by their rarest
words (those that another document has as well, under document frequencies of the whole corpus), so documents that share
rare words are neighbours at any corpus size, and cut into shards of a bounded number of documents; rows that repeat
wholly are spread by a hash among their equals. Each shard has a BM25 inverted index of hashed words. The longest unused
remainder is a window's seed; its QUERY rarest words query the index, and unused neighbours fill the window greedily in
the order of their scores. The last neighbour is cut to fit at a multiple of UNIT ids; what is left of it remains in the
pool. So a window is short of UNIT ids at most, but for the last one of a shard. A word's count in a document weighs at
most as 255, where BM25 is saturated to half a percent.

Texts are tokenised once, whole, by a fast encoder of the same vocabulary; a text that it refuses (a very long run of
white space) goes to the vocabulary's own library. A remainder's checksums at multiples of UNIT are kept, from which any
piece's checksum follows, so ids are never shuffled. Null texts count as empty: one piece that holds the separator. Rows
that repeat a doc_id are packed as documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B
from .scratch import Scratch

#: Documents of a shard, shards of a partition, words of a sort key, ids between two places where a remainder may be cut, words of a query, neighbours looked at by a window.
SHARD, SHARDS, KEYS, UNIT, QUERY, NEIGHBOURS = 2048, 4, 3, 32, 24, 96
#: Hashed words (so the table of document frequencies has a fixed size), and BM25's parameters.
TERMS, K1, LENGTH = 1 << 16, 1.2, 0.75


def encoder(ranks_path: str, pattern: str, specials: dict[str, int], exact_path: str):
    """Text -> ids (uint32 array)."""
    fast = _fast(ranks_path, pattern, tuple(sorted(specials.items())))

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except (ValueError, RuntimeError):
            return np.array(_exact(exact_path).encode(text, add_special_tokens=False).ids, "<u4")

    return encode


@lru_cache(1)
def _fast(ranks_path: str, pattern: str, specials: tuple):
    """One for all tasks of a worker: building it takes 0.1 s and 30 MB."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))


@lru_cache(1)
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Fixed value: the reflected polynomial of CRC-32.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's, reflected."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


@lru_cache(4096)
def _zeros(n: int) -> int:
    """x ** (8 n): the effect of n zero bytes on a checksum."""
    out, power, n = 1 << 31, 1 << 30, 8 * n
    while n:
        if n & 1:
            out = _times(power, out)
        power, n = _times(power, power), n >> 1
    return out


def crc_after(whole: int, before: int, n: int) -> int:
    """The checksum of the last n bytes of data with checksum `whole`, where the rest has checksum `before`."""
    return whole ^ _times(_zeros(n), before)


_TOKENS = "doc_id long, doc_tokens long, full_crc array<long>, crc array<long>, terms binary, counts binary, n_words long"


def _tokenised(ranks_path: str, pattern: str, specials: dict[str, int], exact_path: str, separator: int, window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern, specials, exact_path)
        end = np.array([separator], "<u4")
        for b in batches:
            tokens, full, crc = [], [], []
            for t in b.column(1):
                t = t.as_py()
                ids = np.append(enc(t), end) if t else end
                tokens.append(len(ids))
                data, wide = memoryview(ids.tobytes()), 4 * window
                cut = len(ids) // window * wide
                full.append([zlib.crc32(data[i : i + wide]) for i in range(0, cut, wide)])
                sums, c = [], 0
                for i in range(cut, len(data), 4 * UNIT):
                    c = zlib.crc32(data[i : i + 4 * UNIT], c)
                    sums.append(c)
                crc.append(sums)
            data, at = B.texts(b.column(1))
            terms, counts, n_words = [], [], []
            for i, j in B.chunks(at):
                h, w = B.words(data[at[i] : at[j]], at[i : j + 1] - at[i])
                n = np.diff(w)
                key, c = np.unique((np.repeat(np.arange(j - i), n) << 16) + (h >> np.uint64(48)).astype(np.int64), return_counts=True)
                edge = np.searchsorted(key >> 16, np.arange(j - i + 1))
                term, c = (key & 0xFFFF).astype("<u2"), np.minimum(c, 255).astype(np.uint8)
                terms += [term[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
                counts += [c[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
                n_words += n.tolist()
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64()), pa.array(full, longs), pa.array(crc, longs), pa.array(terms, pa.binary()), pa.array(counts, pa.binary()), pa.array(n_words, pa.int64())], ["doc_id", "doc_tokens", "full_crc", "crc", "terms", "counts", "n_words"])

    return rows


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TERMS, np.int64)
    for b in batches:
        total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u2"), minlength=TERMS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(idf, average: float, window: int):
    def pack(table: pa.Table, sequence: int) -> pa.RecordBatch:
        table = table.sort_by([("doc_tokens", "ascending"), ("doc_id", "ascending"), ("n_words", "ascending")])
        ids, tokens = table["doc_id"].to_pylist(), table["doc_tokens"].to_numpy()
        full, crc = table["full_crc"].to_pylist(), table["crc"].to_pylist()
        n = len(ids)
        rare = idf.value
        terms = [np.frombuffer(x, "<u2") for x in table["terms"].to_pylist()]
        sizes = np.array([len(x) for x in terms])
        term = np.concatenate(terms).astype(np.int64)
        tf = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8).astype(np.float32)
        doc = np.repeat(np.arange(n), sizes)
        length = table["n_words"].to_numpy() / max(average, 1e-9)
        weight = rare[term] * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH + LENGTH * length[doc].astype(np.float32)))
        order = np.argsort(term, kind="stable")
        term, doc, weight = term[order], doc[order], weight[order]
        posting = np.searchsorted(term, np.arange(TERMS + 1))

        out = []
        for i in range(n):
            for k, c in enumerate(full[i]):
                out.append((ids[i], k * window, window, c, int(tokens[i]), sequence, 0))
                sequence += 1
        first = tokens // window * window
        begin, left = np.zeros(n, np.int64), tokens - first  # what is unused of each remainder

        def take(i: int, size: int, offset: int) -> None:
            b = int(begin[i])
            e = b + size
            whole = crc[i][(e - 1) // UNIT]
            c = crc_after(whole, crc[i][b // UNIT - 1], 4 * size) if b else whole
            out.append((ids[i], int(first[i]) + b, size, c, int(tokens[i]), sequence, offset))
            begin[i], left[i] = e, left[i] - size

        seeds = np.argsort(-left, kind="stable")
        at = 0
        while at < n:
            seed = seeds[at]
            if not left[seed]:
                at += 1
                continue
            room = window - int(left[seed])
            take(seed, int(left[seed]), 0)
            if room:
                own = terms[seed]
                query = own[np.argsort(-rare[own], kind="stable")[:QUERY]]
                score = np.zeros(n, np.float32)
                for t in query:
                    x, y = posting[t], posting[int(t) + 1]
                    score[doc[x:y]] += weight[x:y]
                unused = np.flatnonzero(left)
                near = unused[np.argsort(-score[unused], kind="stable")]
                cut = None
                for i in near[:NEIGHBOURS]:
                    if left[i] <= room:
                        size = int(left[i])
                        take(i, size, window - room)
                        room -= size
                        if room == 0:
                            break
                    elif cut is None:
                        cut = i
                # beyond the neighbours, the largest remainders that still fit
                while room and cut is None:
                    unused = np.flatnonzero(left)
                    if not len(unused):
                        break
                    fits = unused[left[unused] <= room]
                    if not len(fits):
                        cut = unused[0]
                        break
                    i = fits[np.argmax(left[fits])]
                    size = int(left[i])
                    take(i, size, window - room)
                    room -= size
                if cut is not None and room >= UNIT:
                    take(cut, room // UNIT * UNIT, window - room)
                    room %= UNIT
                if 0 < room:
                    fits = near[(left[near] > 0) & (left[near] <= room)]
                    for i in fits[:4]:
                        if left[i] <= room:
                            size = int(left[i])
                            take(i, size, window - room)
                            room -= size
            sequence += 1
        names = [c.split()[0] for c in _PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sorted partition in shards of SHARD documents; sequences are numbered on within the partition's own range."""
        from pyspark import TaskContext

        held, count, sequence = [], 0, TaskContext.get().partitionId() << 40
        for b in batches:
            while b.num_rows:
                part = b.slice(0, SHARD - count)
                b = b.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == SHARD:
                    yield (done := pack(pa.Table.from_batches(held), sequence))
                    held, count, sequence = [], 0, int(done.column(5)[-1].as_py()) + 1
        if held:
            yield pack(pa.Table.from_batches(held), sequence)

    return shards


def _keyed(shared):
    """Rows with terms first -> the same with `key`: their rarest terms that another document has, as places in the order of rarity."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for b in batches:
            keys = np.full((b.num_rows, KEYS), TERMS, np.int32)
            for i, t in enumerate(b.column(0).to_pylist()):
                own = np.sort(place[np.frombuffer(t, "<u2")])[:KEYS]
                keys[i, : len(own)] = own
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(k) for k in keys.T)], [*b.schema.names, *(f"k{i}" for i in range(KEYS))])

    return rows


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, specials: dict[str, int], exact_path: str, separator: int = 1, window: int = 2048) -> DataFrame:
    """(doc_id, text) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    tokens = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenised(ranks_path, pattern, specials, exact_path, separator, window), _TOKENS)
    tokens = scratch.save(tokens, "tokens")
    n, words = tokens.agg(F.count("*"), F.sum("n_words")).first()
    df = np.zeros(TERMS)
    for t, c in tokens.select("terms").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # TERMS rows at most
        df[t] = c
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32))
    place = np.empty(TERMS, np.int32)
    place[np.lexsort((np.arange(TERMS), np.where(df > 1, df, np.inf)))] = np.arange(TERMS)
    place[df < 2] = TERMS
    first = tokens.select("terms", *(c for c in tokens.columns if c != "terms"))
    keys = ", ".join(f"k{k} int" for k in range(KEYS))
    keyed = first.mapInArrow(_keyed(spark.sparkContext.broadcast(place)), f"terms binary, {_TOKENS.replace('terms binary, ', '')}, {keys}").withColumn("tie", F.xxhash64("doc_id", "doc_tokens", "crc"))
    order = [*(f"k{k}" for k in range(KEYS)), "tie"]
    dealt = keyed.repartitionByRange(max(1, -(-n // (SHARD * SHARDS))), *order).sortWithinPartitions(*order).drop(*order)
    return dealt.mapInArrow(_packed(idf, (words or 0) / max(n, 1), window), _PIECES)
