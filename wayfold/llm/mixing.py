"""Mixing of sources to target weights, in DataFrame operations only.

Documents get a hash-random key. Keys are ranged into buckets within each source; buckets' word sums and their prefix
sums say which buckets lie wholly below a source's budget. Only the bucket that holds the cut is ordered document by
document. A budget above the source's size takes whole epochs first. No step puts a source's documents into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: Documents of a source that share a key bucket, on average, and hex digits of the key that a bucket has at most.
PER_BUCKET, DIGITS = 256, 10


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, source_size), a row per source -> the same with target.

    Sources in code point order, null last, weigh `weights`, repeating. Together they share `share` times all sizes by
    weight; a target stops at `most` times its source's size and the excess is shared by weight among the others.
    Sources stop in ascending order of room per weight, so the level is found by one running sum over sources.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("room", F.col("source_size") * F.lit(most))
    up = W.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source whose room is above the level leaves it to all that follow
    s = s.withColumn("rank", F.row_number().over(up))
    s = s.withColumn("open", F.min(F.when(F.col("room") > F.col("level") * F.col("w"), F.struct("rank", "level"))).over(whole)["level"])
    return s.select("source", "n", "source_size", F.least("room", F.coalesce(F.col("open") * F.col("w"), F.col("room"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, source) -> doc_id, size, source_size, target, taken, and source if kept, one row for each row.

    size counts words (null text: 0). taken is the words that the mix takes of the document: its size for each epoch,
    and in the last epoch only what the source's budget (its target, rounded) still holds, so that a source's taken
    words are its budget exactly. Keys are the id's MD5 and ties in them fall by id and size; reruns agree. Documents
    of size 0 take nothing. A null source is a source of its own. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), "source", words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))
    d = scratch.save(d, "sizes")
    t = targets(d.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights)
    t = t.withColumn("budget", F.round("target").cast("long")).withColumn("epochs", F.coalesce(F.expr("try_divide(budget, source_size)").cast("long"), F.lit(0).cast("long")))
    t = t.withColumn("cut", F.col("budget") - F.col("epochs") * F.col("source_size"))
    digits = F.least(F.lit(DIGITS), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n") / F.lit(float(PER_BUCKET)))))).cast("int")
    t = scratch.save(t.withColumn("digits", digits), "targets")
    keyed = d.join(t, d.source.eqNullSafe(t.source)).drop(t.source).withColumn("bucket", F.expr("substring(key, 1, digits)"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    # prefix sums over buckets in two levels: by leading digits, then within them
    sums = sums.withColumn("lead", F.substring("bucket", 1, 2))
    leads = sums.groupBy("source", "lead").agg(F.sum("in_bucket").alias("in_lead"))
    so_far = lambda c, *by: W.partitionBy(*by).orderBy(c).rowsBetween(W.unboundedPreceding, -1)
    leads = leads.withColumn("lead_before", F.coalesce(F.sum("in_lead").over(so_far("lead", "source")), F.lit(0).cast("long"))).drop("in_lead")
    l2 = leads.withColumnRenamed("source", "s2").withColumnRenamed("lead", "lead2")
    sums = sums.join(l2, sums.source.eqNullSafe(F.col("s2")) & (F.col("lead") == F.col("lead2")))
    sums = sums.withColumn("before", F.col("lead_before") + F.coalesce(F.sum("in_bucket").over(so_far("bucket", "source", "lead")), F.lit(0).cast("long")))
    cuts = t.select(F.col("source").alias("s3"), F.col("cut").alias("at"))
    held = sums.join(cuts, sums.source.eqNullSafe(F.col("s3"))).where("before < at and at < before + in_bucket").groupBy("source").agg(F.max("bucket").alias("cut_bucket"), F.max("before").alias("cut_before"))
    # sources cut between two buckets: the last bucket that lies wholly below
    below = sums.join(cuts, sums.source.eqNullSafe(F.col("s3"))).where("before + in_bucket <= at").groupBy("source").agg(F.max("bucket").alias("last_whole"))
    plan = t.join(held.withColumnRenamed("source", "s4"), t.source.eqNullSafe(F.col("s4")), "left").join(below.withColumnRenamed("source", "s5"), t.source.eqNullSafe(F.col("s5")), "left").drop("s4", "s5")
    plan = scratch.save(plan, "plan")
    p = plan.withColumnRenamed("source", "s6")
    rows = d.join(p, d.source.eqNullSafe(F.col("s6"))).drop("s6").withColumn("bucket", F.expr("substring(key, 1, digits)"))
    base = F.col("epochs") * F.col("size")
    inside = rows.where("bucket = cut_bucket")
    w = W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("cut_before") + F.coalesce(F.sum("size").over(w), F.lit(0).cast("long"))).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("cut") - F.col("start"))))
    others = rows.where("cut_bucket is null or bucket <> cut_bucket").withColumn("part", F.when(F.col("bucket") <= F.col("last_whole"), F.col("size")).otherwise(F.lit(0)))
    pick = ["doc_id", *keep, "size", "source_size", "target", (base + F.col("part")).cast("long").alias("taken")]
    return inside.select(*pick).union(others.select(*pick))
