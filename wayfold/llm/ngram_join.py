"""Self join of documents on the Jaccard similarity of their 5-word shingle sets, by universe partition and pigeonhole.

The universe of shingle hashes is partitioned into segments. Sets r and s with 100 * |r & s| >= t * |r | s| differ in at
most H = (100 - t) * (|r| + |s|) // (100 + t) elements, so of any H + 1 segments one holds the same subset of both.
Each set therefore indexes, in one global order of segments, its first H + 1 non-empty segments' subsets, where H is
taken for its largest possible partner: in that stretch of the shorter index at most H segments can differ, and a
non-empty one that doesn't is indexed by both.

Allocation by cost: shingles that a sample finds in several documents form segments of their own, last in the order,
as their subsets are expensive (many sets share them). A cold segment counts 1 (its exact subset is indexed); a hot one
of two shingles or more counts 2: its subset and the subset's one-deletion neighbourhood are indexed, so that one
difference in it is survived and fewer hot segments are needed. The sample only sets the order, never the result.

Segments by size band: below 512 shingles each shingle is a segment. There only a set's own shingles can differ in its
segments: n - o of them, where o is the least intersection, so the larger set of a pair indexes n / 4 segments and the
smaller one need only share one of its first n / 7 (rows say so: a bucket without such a row holds no pair). Bands
above grow fourfold, with half as many cold segments as the band's largest set has shingles. (A set with so uneven a hash that its non-empty segments don't reach
H + 1 would miss its guarantee; for the smallest such band that is beyond seven standard deviations, and the hot
segments still count double.) A set also indexes itself in the band below if a partner may lie there.

Candidates whose sizes, or whose bitmaps, already exclude the similarity are left out: a set's bitmap has about four bits
a shingle, and a bit that one set has and the other lacks stands for a shingle of only one of them, so that bound on the
difference is exact too. Bitmaps of different sizes are folded onto the smaller. The rest are verified exactly, on texts read again. Sets of one bucket are first held against the bucket's smallest
id, linear in the bucket; only what this leaves in different components is then compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes_np as B
from .graph import components
from .scratch import Scratch

#: Documents whose shingles are counted to find hot ones (bound on the sample), and entries of the table of hot hashes.
SAMPLE, HOT_BITS, HOT_LIMIT = 4096, 22, 65_536
#: Bits of a set's bitmap, by which a candidate's difference is bounded: a power of two, four for each shingle, between these.
BITS_LEAST, BITS_MOST = 512, 1 << 18
#: Slots of candidates' ids, broadcast to drop other texts before a shuffle (bound on the rows broadcast).
SLOTS = 1 << 20
#: Buckets of up to this many sets are compared pair by pair at once; of up to so many by a join once leads have been
#: compared; larger ones block against block, in blocks of so many sets.
SMALL, JOINED, BLOCK = 3, 64, 512


def _edges() -> list[int]:
    return [1, *(512 * 4**i for i in range(15))]


def _bitmaps(x: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each set's bitmap; hashes come set by set."""
    wide = np.clip(1 << np.ceil(np.log2(np.maximum(4 * n, 1))).astype(np.int64), BITS_LEAST, BITS_MOST)
    at, begin = np.repeat(np.cumsum(wide) - wide, n), np.cumsum(wide) - wide
    flags = np.zeros(int(wide.sum()), np.uint8)
    flags[at + (x % np.repeat(wide, n).astype(np.uint64)).astype(np.int64)] = 1
    packed = np.packbits(flags, bitorder="little").tobytes()
    return [packed[a // 8 : (a + w) // 8] for a, w in zip(begin.tolist(), wide.tolist(), strict=True)]


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps on so many 64-bit words, no more than they have."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), 1)


def _stacked(bitmaps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = B.texts(b.column(1))
        out, bits = [], []
        for i, j in B.chunks(at):
            x, _, n = B.shingles(*B.words(data[at[i] : at[j]], at[i : j + 1] - at[i]))
            out.append((n, B.sums(x, n), B.sums(B.mix(x + np.uint64(77)), n)))
            bits += _bitmaps(x, n)
        if out:
            n, p, q = (np.concatenate(v) for v in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(p.view(np.int64)), pa.array(q.view(np.int64)), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "p", "q", "bits"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = B.texts(b.column(0))
        for i, j in B.chunks(at):
            x, _, _ = B.shingles(*B.words(data[at[i] : at[j]], at[i : j + 1] - at[i]))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], ["h"])


def signatures(x: np.ndarray, of: np.ndarray, n: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, whether it may be the smaller set's) rows of the sets given as (hash, set number) sorted by both, with sizes n."""
    edges = np.array(_edges())
    band = np.searchsorted(edges, np.maximum(n, 1), "right") - 1
    most = (100 - percent) * (n + 100 * n // percent) // (100 + percent)
    low = edges[band] - 1
    down = (band > 0) & (percent * n <= 100 * low)
    less = (100 - percent) * (n + low) // (100 + percent)
    # single shingles: what can differ of a set as the larger one, whose partner has n * percent / 100 at least, and as the smaller one
    overlap = lambda r: -(-percent * (n + r) // (100 + percent))
    larger, smaller = n - overlap(-(-percent * n // 100)), n - overlap(n)
    heat = hot[(x >> np.uint64(64 - HOT_BITS)).astype(np.int64)]
    sigs, sets, small = [], [], []
    for key in np.unique(np.concatenate([band, band[down] - 1])):
        role = np.where(band == key, most + 1, np.where(down & (band == key + 1), less + 1, 0))
        if key == 0:
            role = np.where(role > 0, larger + 1, 0)
        role[n == 0] = 0
        mine = role[of] > 0
        if not mine.any():
            continue
        y, o, w = x[mine], of[mine], heat[mine]
        r = B.mix(y ^ np.uint64(0xA5A5 + 2 * int(key)))
        m = int(edges[key + 1]) // 2
        seg = (r >> np.uint64(1)).astype(np.int64) if key == 0 else (r % np.uint64(m)).astype(np.int64)
        seg = np.where(w, seg | (1 << 63) - (1 << 62), seg >> 1) if key == 0 else seg + m * w
        order = np.lexsort((seg, o))
        seg, o, w, value = seg[order], o[order], w[order], r[order]
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (o[1:] != o[:-1])
        first = np.flatnonzero(new)
        of_seg = np.cumsum(new) - 1
        size = np.diff(np.append(first, len(seg)))
        subset = np.add.reduceat(value, first)
        so, ss, sw = o[first], seg[first], w[first]
        weight = np.where(sw & (size > 1), 2, 1)
        run = np.cumsum(weight) - weight
        begin = np.searchsorted(so, so)
        keep = run - run[begin] < role[so]
        tag = B.mix(ss.astype(np.uint64) + np.uint64((int(key) + 1) << 56))
        sigs.append(B.mix(subset[keep] + tag[keep]))
        sets.append(so[keep])
        rank = (run - run[begin])[keep]
        small.append((rank <= smaller[so[keep]]) & (band[so[keep]] == 0) if key == 0 else np.ones(len(rank), bool))
        fewer = (keep & sw & (size > 1))[of_seg]
        if fewer.any():
            g = of_seg[fewer]
            sigs.append(B.mix(subset[g] - value[fewer] + tag[g]))
            sets.append(o[fewer])
            small.append(np.ones(len(g), bool))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(sigs), np.concatenate(sets), np.concatenate(small)


def _index(hot, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = hot.value, set()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, at = B.texts(b.column(1))
            for i, j in B.chunks(at):
                x, of, n = B.shingles(*B.words(data[at[i] : at[j]], at[i : j + 1] - at[i]))
                # a copy of a set that this task has indexed adds nothing: copies are found by their whole sets
                own = B.mix(B.sums(x, n) + n.astype(np.uint64))
                fresh = np.zeros(len(n), bool)
                for k, v in enumerate(own.tolist()):
                    if n[k] and v not in seen:
                        seen.add(v)
                        fresh[k] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                use = fresh[of]
                sig, of_sig, small = signatures(x[use], of[use], np.where(fresh, n, 0), table, percent)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[i:j][of_sig]), pa.array((~small).astype(np.int8))], ["sig", "id", "large"])

    return rows


_FOUND = "kind int, sig long, a long, b long, n long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, large, id) -> pairs (kind 0, n: number of shared buckets) and the sets of larger buckets (kind 1, n: large)."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    held, big = tuple(np.zeros(0, np.int64) for _ in range(3)), None

    def flush():
        a, b = (np.concatenate(v) for v in zip(*pairs, strict=True))
        pairs.clear()
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        zero = np.zeros(len(at), np.int64)
        return out(zero.astype(np.int32), zero, a[at], b[at], np.diff(np.append(at, len(a))))

    def out(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "sig", "a", "b", "n"])

    def members(sig, ids, large):
        return out(np.ones(len(sig), np.int32), sig, ids, ids, large)

    def runs(sig, ids, large, last):
        """Handles whole runs; returns the rows of the last one, which may go on, unless it is large."""
        nonlocal big
        if big is not None:
            n = int(np.searchsorted(sig, big[0], "right"))
            if n and big[1] is not None:
                pairs.append((np.full(n, big[1]), ids[:n]))
                yield members(sig[:n], ids[:n], large[:n])
            sig, ids, large = sig[n:], ids[n:], large[n:]
            if len(sig):
                big = None
        if not len(sig):
            return sig, ids, large
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(np.append(first, len(sig)))
        rest = sig[:0], ids[:0], large[:0]
        if not last:
            if size[-1] > SMALL:
                big = (sig[-1], None if large[first[-1]] else ids[first[-1]])
            else:
                rest = sig[first[-1] :], ids[first[-1] :], large[first[-1] :]
                sig, ids, large, first, size = sig[: first[-1]], ids[: first[-1]], large[: first[-1]], first[:-1], size[:-1]
        if len(sig):
            run = np.repeat(np.arange(len(first)), size)
            holds = (large[first] == 0)[run]  # only then is there a pair at all
            lead = ids[first][run]
            other = holds & (np.arange(len(sig)) != first[run])
            pairs.append((lead[other], ids[other]))
            for gap in range(1, SMALL - 1):
                for i in range(1, SMALL - gap):
                    at = first[(size <= SMALL) & (size > i + gap)] + i
                    at = at[large[at] == 0]
                    pairs.append((ids[at], ids[at + gap]))
            many = (size[run] > SMALL) & holds
            if many.any():
                yield members(sig[many], ids[many], large[many])
        return rest

    for b in batches:
        rows = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
        new = np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) if len(rows[0]) else np.zeros(0, bool)
        held = yield from runs(*(r[new] for r in rows), False)
        if sum(len(p[0]) for p in pairs) > 400_000:
            yield flush()
    yield from runs(*held, True)
    if pairs and sum(len(p[0]) for p in pairs):
        yield flush()


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with bitmaps a, b and n shingles together can differ in so little. Bitmaps broadcast against each other."""
    differ = np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)
    return (100 + percent) * differ <= (100 - percent) * n


def _possible(percent: int):
    """Pairs with sizes and bitmaps -> those whose difference can be small enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(5).to_pylist(), b.column(6).to_pylist()
            n = b.column(3).to_numpy() + b.column(4).to_numpy()
            ok = np.zeros(b.num_rows, bool)
            kinds = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
            for kind in np.unique(kinds, axis=0):
                words = int(kind.min()) // 8
                at = np.flatnonzero((kinds == kind).all(1))
                for part in np.array_split(at, -(-len(at) * int(kind.max()) // (1 << 24))):
                    sides = (_folded(_stacked([x[i] for i in part]), words) for x in (left, right))
                    ok[part] = _near(*sides, n[part], percent)
            yield b.select([0, 1, 2]).filter(pa.array(ok))

    return rows


def _crossing(percent: int):
    """Two blocks of a bucket -> the pairs of different components whose bitmaps leave the similarity possible."""

    def rows(f: pa.Table) -> pa.Table:
        i, j = f["i"][0].as_py(), f["j"][0].as_py()
        block, size, ids, root, large = (f[c].to_numpy() for c in ("block", "size", "id", "root", "large"))
        bits = f["bits"].combine_chunks()
        width = np.array([len(x.as_buffer()) for x in bits], np.int64)
        out = [np.zeros((2, 0), np.int64)]
        for u in np.unique(width):
            for v in (x for x in np.unique(width) if u <= 2 * x and x <= 2 * u):  # sizes further apart exclude each other
                left, right = np.flatnonzero((block == i) & (width == u)), np.flatnonzero((block == j) & (width == v))
                if not len(left) or not len(right):
                    continue
                words = int(min(u, v)) // 8
                a, b = (_folded(_stacked(bits.take(pa.array(x)).to_pylist()), words) for x in (left, right))
                step = max(1, (1 << 22) // (len(right) * words))
                for lo in range(0, len(left), step):
                    l = left[lo : lo + step]
                    ok = (root[l][:, None] != root[right]) & ((large[l][:, None] == 0) | (large[right] == 0))
                    ok &= _near(a[lo : lo + step][:, None], b[None], size[l][:, None] + size[right], percent)
                    x, y = np.nonzero(ok)
                    out.append(np.sort(np.stack([ids[l[x]], ids[right[y]]]), 0))
        a, b = np.unique(np.concatenate(out, 1), axis=1)
        return pa.table({"a": a, "b": b})

    return rows


def _verified(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [B.texts(b.column(2)), B.texts(b.column(3))]
            ok = np.zeros(b.num_rows, bool)
            for i, j in B.chunks(sides[0][1] + sides[1][1]):
                x, of, n = zip(*(B.shingles(*B.words(d[at[i] : at[j]], at[i : j + 1] - at[i])) for d, at in sides), strict=True)
                h, o = np.concatenate(x), np.concatenate(of)
                order = np.lexsort((h, o))
                h, o = h[order], o[order]
                same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
                both = np.bincount(o[1:][same], minlength=j - i)
                ok[i:j] = (100 * both >= percent * (n[0] + n[1] - both)) & (both > 0)
            yield b.select([0, 1]).filter(pa.array(ok))

    return rows


def _check(pairs: DataFrame, docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Those of the distinct pairs (a, b) whose texts reach the similarity.

    Only candidates' texts are shuffled: others are dropped at the scan by the slots of their ids, SLOTS of them at most.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int").alias("slot")
    taken = pairs.select(slot("a")).union(pairs.select(slot("b"))).distinct()
    texts = docs.where("doc_id is not null").select("doc_id", "text", slot("doc_id")).join(F.broadcast(taken), "slot", "left_semi")
    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return scratch.save(two.select("a", "b", "text_a", "text_b").mapInArrow(_verified(percent), "a long, b long"), "verified")


def ngram_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, text) -> one row per row: doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the smallest
    doc_id that links reach. Null or blank texts have an empty set and link with nothing. Rows that repeat a doc_id are
    parts of one document: they share a component. A null doc_id has no component (null). An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    profile = scratch.save(docs.mapInArrow(_profile, "doc_id long, n_shingles long, p long, q long, bits binary"), "profile")
    some = profile.where("doc_id is not null and n_shingles > 0")
    classes = scratch.save(some.groupBy("n_shingles", "p", "q").agg(F.min("doc_id").alias("rep")), "classes")
    joined = some.join(classes, ["n_shingles", "p", "q"])
    of = scratch.save(joined.select("doc_id", "rep"), "reps")
    bitmaps = scratch.save(joined.where("doc_id = rep").select("rep", F.col("n_shingles").alias("size"), "bits"), "bits")

    def possible(candidates: DataFrame) -> DataFrame:
        """Of (a, b, n) those that size and bitmaps leave."""
        for c in ("a", "b"):
            candidates = candidates.join(bitmaps.select(F.col("rep").alias(c), F.col("size").alias(f"size_{c}")), c)
        near = candidates.where(F.lit(percent) * F.greatest("size_a", "size_b") <= 100 * F.least("size_a", "size_b"))
        for c in ("a", "b"):
            near = near.join(bitmaps.select(F.col("rep").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")), [c, f"size_{c}"])
        return near.select("a", "b", "n", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(_possible(percent), "a long, b long, n long")

    every = max(1, some.count() // SAMPLE)
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(every)) == 0).select("text")
    counted = picked.mapInArrow(_sampled, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(HOT_LIMIT)
    table = np.zeros(1 << HOT_BITS, bool)
    found = np.array([r[0] for r in counted.select("h").collect()], np.int64).view(np.uint64)
    table[(found >> np.uint64(64 - HOT_BITS)).astype(np.int64)] = True
    hot = spark.sparkContext.broadcast(table)

    rows = docs.where("doc_id is not null").mapInArrow(_index(hot, percent), "sig long, id long, large byte")
    runs = scratch.save(rows.repartition("sig").sortWithinPartitions("sig", "large", "id").mapInArrow(_runs, _FOUND), "runs")
    mapped = runs.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    for c in ("a", "b"):
        mapped = mapped.join(of.groupBy("doc_id").agg(F.min("rep").alias("rep")).withColumnRenamed("doc_id", c), c).drop(c).withColumnRenamed("rep", c)
    mapped = mapped.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"))
    pairs = scratch.save(possible(mapped), "pairs")

    # rows that share a doc_id are one document
    shared = of.join(of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    links = scratch.save(_check(pairs.select("a", "b"), docs, percent, scratch).union(shared), "links1")
    roots = components(links, scratch)

    many = runs.where("kind = 1").select("sig", F.col("a").alias("doc_id"), F.col("n").alias("large")).join(of, "doc_id").groupBy("sig", F.col("rep").alias("id")).agg(F.min("large").alias("large"))
    many = many.join(bitmaps.groupBy(F.col("rep").alias("id")).agg(F.min("size").alias("size_lo"), F.max("size").alias("size_hi")), "id")
    fits = f"{percent} * l.size_lo <= 100 * r.size_hi and {percent} * r.size_lo <= 100 * l.size_hi"

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of buckets that still hold several components."""
        rows = rows.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        some = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig")
        return scratch.save(rows.join(some, "sig"), "mixed")

    def ends(found: DataFrame) -> DataFrame:
        found = scratch.save(found.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct(), "crossed")
        return possible(found.withColumn("n", F.lit(1).cast("long"))).select("a", "b")

    def verified(found: DataFrame) -> DataFrame:
        """Links among candidates that weren't compared before."""
        return _check(scratch.save(found.distinct().join(pairs, ["a", "b"], "left_anti"), "left"), docs, percent, scratch)

    # a second, random lead of each bucket, so that what remains is only what few others are close to
    many = mixed(many)
    lead = many.where("large = 0").groupBy("sig").agg(F.min_by(F.struct("id", "root", "size_lo", "size_hi"), F.xxhash64("sig", "id")).alias("l")).select("sig", "l.*")
    links = scratch.save(links.union(verified(ends(many.alias("r").join(lead.alias("l"), F.expr(f"l.sig = r.sig and l.root <> r.root and {fits}"))))), "links2")
    roots = components(links, scratch)
    many = mixed(many)
    counts = scratch.save(many.groupBy("sig").agg(F.count("*").alias("m")), "counts")
    sized = many.join(counts, "sig")
    few = sized.where(F.col("m") <= JOINED)
    small = ends(few.alias("l").join(few.alias("r"), F.expr(f"l.sig = r.sig and l.root < r.root and (l.large = 0 or r.large = 0) and {fits}")))
    blocks = F.ceil(F.col("m") / F.lit(float(BLOCK))).cast("int")
    dealt = sized.where(F.col("m") > JOINED).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("sig", "id", "root", "large", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.join(bitmaps.withColumnRenamed("rep", "id"), "id").groupBy("sig", "i", "j").applyInArrow(_crossing(percent), "a long, b long")
    more = verified(small.union(dealt))
    roots = components(links.union(more), scratch)
    scratch.drop(runs, pairs, bitmaps, classes)
    whole = profile.join(of.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    return whole.select("doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"))
