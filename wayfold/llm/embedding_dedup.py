"""Near-duplicate vectors within a label, by sorted projection passes.

Each pass hashes every vector to a row of bits (signs of seeded random projections) and sorts the vectors of all labels
by (label, bits) over range partitions. Each vector is compared exactly with the WINDOW next ones; windows go on over
partition borders. Pairs with a cosine of at least the threshold, in double precision, are links; a task hands on a
spanning forest of the links it finds, and passes are united by distributed union-find. How many passes there are follows first
from the largest label's size, so that a pair at the threshold is found with probability RECALL where bits are evenly
spread: longer sorted runs need more leading bits to agree. In a dense clump of loosely similar vectors a bit tells less. So
the recall is measured: SAMPLE vectors are compared with all vectors, exactly, and while less than RECALL of their
links lie in one component, as many passes more are run as the measured chance of a pass asks for (MOST in all at most; then the recall is what it is).

Windows bound what one pass compares. For groups with more members than a window holds, the pairs inside each component
are then compared whole, block against block, so that links are counted exactly however large the component is: blocks
go to tasks by key, no pair is emitted, only counts by vector. Equal vectors are one class throughout; a class of
copies costs one comparison and its links are counted from the class's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch

#: Neighbours that a vector is compared with in a pass, probability that a pair at the threshold is found, bits of a key, members of a block.
WINDOW, RECALL, BITS, BLOCK = 48, 0.97, 48, 512
#: Vectors whose links are all looked up to measure the recall (bound on what is broadcast), and most passes.
SAMPLE, MOST = 512, 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def passes(n: int, threshold: float) -> int:
    """Passes after which a pair at the threshold is found with probability RECALL among n vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    once = agree ** max(0.0, math.log2(max(n, 1) / WINDOW))
    return 2 if once > 0.999 else max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - once)))


def _list(v) -> np.ndarray:
    return np.asarray(v, np.float64)


def _keyed(turn: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [_list(v.as_py()) for v in b.column(2)]
            keys = np.zeros(len(x), np.int64)
            for d in {len(v) for v in x}:
                at = np.flatnonzero([len(v) == d for v in x])
                plane = np.random.default_rng([turn, d]).standard_normal((d, BITS))
                keys[at] = ((np.array([x[i] for i in at]) @ plane) > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys)], ["vec_id", "label", "embedding", "key"])

    return rows


def _close(ids: np.ndarray, labels: np.ndarray, rows: list, threshold: float, cross: int | None = None) -> tuple[list, list]:
    """Verified pairs among rows in sorted order, at most WINDOW apart; with `cross` only those that reach over that position."""
    out_a, out_b = [], []
    dims = np.array([len(v) for v in rows])
    width = int(dims.max(initial=1))
    x = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        x[i, : len(v)] = v
    for gap in range(1, min(WINDOW, len(rows) - 1) + 1):
        ok = (labels[gap:] == labels[:-gap]) & (dims[gap:] == dims[:-gap])
        if cross is not None:
            at = np.arange(len(rows) - gap)
            ok &= (at < cross) & (at + gap >= cross)
        i = np.flatnonzero(ok)
        i = i[np.einsum("ij,ij->i", x[i], x[i + gap]) >= threshold]
        out_a.append(ids[i])
        out_b.append(ids[i + gap])
    return out_a, out_b


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By row: the first row of its component under the pairs."""
    root = np.arange(n)
    while True:
        least, new = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


_PAIRS = "edge int, side int, at long, a long, b long, label int, embedding array<double>"


def _windows(threshold: float):
    """Sorted partition -> what links its rows, one row for each (to the first of its component, not all pairs), and its first and last WINDOW rows (edge: the border's number)."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held, seen = TaskContext.get().partitionId(), None, 0

        def border(f: pd.DataFrame, edge: int, side: int, start: int) -> pd.DataFrame:
            return pd.DataFrame({"edge": edge, "side": side, "at": np.arange(start, start + len(f)), "a": f.vec_id.to_numpy(), "b": 0, "label": f.label.to_numpy(), "embedding": f.embedding.to_numpy()})

        for f in frames:
            if seen < WINDOW:
                yield border(f.iloc[: WINDOW - seen], part, 1, seen)
            fresh = len(f)
            both = f if held is None else pd.concat([held, f], ignore_index=True)
            old = len(both) - fresh
            vectors = [_list(v) for v in both.embedding]
            a, b = [], []
            for lo in range(0, len(both), 4096):  # pieces that overlap by a window
                hi = min(len(both), lo + 4096 + WINDOW)
                p, q = _close(np.arange(lo, hi), both.label.to_numpy()[lo:hi], vectors[lo:hi], threshold)
                for u, v in zip(p, q, strict=True):
                    ok = (u < lo + 4096) & (v >= old)
                    a.append(u[ok])
                    b.append(v[ok])
            if a:
                ids, root = both.vec_id.to_numpy(), _joined(len(both), np.concatenate(a), np.concatenate(b))
                i = np.flatnonzero(root != np.arange(len(both)))
                yield pd.DataFrame({"edge": -1, "side": 0, "at": 0, "a": ids[i], "b": ids[root[i]], "label": None, "embedding": None}).astype({"label": "Int32"})
            held, seen = both.iloc[-WINDOW:], seen + fresh
        if held is not None:
            yield border(held, part + 1, 0, 0)

    return rows


def _borders(threshold: float):
    def rows(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["side", "at"], ignore_index=True)
        if not len(f):
            return pd.DataFrame({"a": [], "b": []})
        a, b = _close(f.a.to_numpy(), f.label.to_numpy(), [_list(v) for v in f.embedding], threshold, int((f.side == 0).sum()))
        return pd.DataFrame({"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else []})

    return rows


def _counts(threshold: float):
    """Links by member between (or within) two blocks of a component; a class's weight is its number of vectors."""

    def rows(f: pd.DataFrame) -> pd.DataFrame:
        i, j = int(f.i.iloc[0]), int(f.j.iloc[0])
        f = f.sort_values("id", ignore_index=True)
        left, right = f[f.block == i], f[f.block == j]
        total = {}
        for d in {len(v) for v in f.embedding}:
            l, r = left[left.embedding.map(len) == d], right[right.embedding.map(len) == d]
            if not len(l) or not len(r):
                continue
            near = np.stack(l.embedding.map(_list).to_list()) @ np.stack(r.embedding.map(_list).to_list()).T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
            else:
                for k, v in zip(r.id, l.weight.to_numpy() @ near, strict=True):
                    total[k] = total.get(k, 0) + int(v)
            for k, v in zip(l.id, near @ r.weight.to_numpy(), strict=True):
                total[k] = total.get(k, 0) + int(v)
        return pd.DataFrame({"id": list(total), "n": list(total.values())}).astype({"id": "int64", "n": "int64"})

    return rows


def _measured(sample: list[tuple], threshold: float):
    """Rows (vec_id, label, root, embedding) -> how many links with sampled vectors they have, and how many of these lie in one component."""
    ids, labels, roots = (np.array([s[k] for s in sample], np.int64) for k in range(3))
    by_size = {d: np.flatnonzero([len(s[3]) == d for s in sample]) for d in {len(s[3]) for s in sample}}
    units = {d: np.array([sample[i][3] for i in at]) for d, at in by_size.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = found = 0
        for b in batches:
            own, label, root = (np.array(b.column(k).to_pylist(), np.int64) for k in range(3))
            x = [_list(v.as_py()) for v in b.column(3)]
            for d, at in by_size.items():
                mine = np.flatnonzero([len(v) == d for v in x])
                if len(mine):
                    near = (np.array([x[i] for i in mine]) @ units[d].T >= threshold) & (label[mine][:, None] == labels[at]) & (own[mine][:, None] != ids[at])
                    links += int(near.sum())
                    found += int((near & (root[mine][:, None] == roots[at])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([found])], ["links", "found"])

    return rows


def more_passes(done: int, links: int, found: int) -> int:
    """Passes to run after so many, of which a share `found` of all links came out."""
    if not links or found >= RECALL * links or done >= MOST:
        return 0
    once = 1 - (1 - found / links) ** (1 / done)
    wanted = MOST if once <= 0 else math.ceil(math.log(1 - RECALL) / math.log(1 - once))
    return min(max(wanted - done, 1), MOST - done, 2 * done)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept, one row for each row.

    Only vectors of equal, non-null labels link. Vectors that are null, empty, zero, or hold a null or non-finite
    component link with nothing (n_links 0, component of their own), as do vectors of different length with one
    another. Repeated rows of an id are rows of their own but share the id's component. An empty table gives none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("embedding", lambda e: e != 0), F.lit(False))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e * e))
    largest = F.array_max(F.transform("embedding", lambda e: F.abs(e)))  # scaled first, so that no square overflows or vanishes
    unit = v.where(sound).withColumn("embedding", F.transform("embedding", lambda e: e / largest)).withColumn("embedding", F.transform("embedding", lambda e: e / length))
    unit = unit.withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.lit(1), "embedding"))
    ids = scratch.save(unit.select("vec_id", "label", "h", "g"), "vectors")
    classes = scratch.save(ids.groupBy("label", "h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "classes")
    of = scratch.save(ids.join(classes, ["label", "h", "g"]).select("vec_id", "rep", "size", "label"), "of")
    reps = scratch.save(unit.join(classes.select(F.col("rep").alias("vec_id"), "label", "h", "g", "size"), ["vec_id", "label", "h", "g"]).dropDuplicates(["vec_id", "label"]).select("vec_id", "label", "embedding", "size"), "reps")
    largest_label = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    same_id = of.select(F.col("vec_id").alias("a"), F.col("rep").alias("b")).where("a <> b").join(of.select(F.col("rep").alias("a")).distinct(), "a")
    links, done, wanted = same_id, 0, passes(largest_label, threshold)
    every = max(1, reps.count() // SAMPLE)
    while wanted:
        for turn in range(done, done + wanted):
            keyed = reps.select("vec_id", "label", "embedding").mapInArrow(_keyed(turn), "vec_id long, label int, embedding array<double>, key long")
            order = keyed.repartitionByRange("label", "key", "vec_id").sortWithinPartitions("label", "key", "vec_id")
            pairs = scratch.save(order.drop("key").mapInPandas(_windows(threshold), _PAIRS), "pass")
            over = pairs.where("edge > 0").groupBy("edge").applyInPandas(_borders(threshold), "a long, b long")
            links = links.union(pairs.where("edge = -1").select("a", "b").union(over))
        done += wanted
        roots = components(links, scratch)
        rooted = reps.join(roots.withColumnRenamed("id", "vec_id"), "vec_id", "left").select("vec_id", "label", F.coalesce("root", "vec_id").alias("root"), "embedding")
        sample = [tuple(r) for r in rooted.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(every)) == 0).limit(SAMPLE).collect()]
        m = rooted.mapInArrow(_measured(sample, threshold), "links long, found long").agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0))).first() if sample else (0, 0)
        wanted = more_passes(done, *m)

    # links inside components, block against block
    members = scratch.save(reps.join(roots, reps.vec_id == roots.id).select("id", "root", "label", "embedding", F.col("size").alias("weight")), "members")
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    many = members.groupBy("root").agg(F.count("*").alias("n")).select("root", blocks.alias("blocks"))
    dealt = members.join(scratch.save(many, "sizes"), "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "weight", "embedding")
    counts = dealt.groupBy("root", "label", "i", "j").applyInPandas(_counts(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))

    whole = of.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    whole = whole.select("vec_id", "label", (F.coalesce("n", F.lit(0).cast("long")) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    rest = v.where(~sound).select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.union(rest).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
