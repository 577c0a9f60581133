"""Exact dedup of whole texts by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run of digests. Runs have numbers of `rounds` digits to the base FAN; in round r those whose
numbers differ only in digit r exchange what they hold: each takes the digests whose own digit r is its. A round merges
equal digests of the exchanged runs (FAN ways at once, already combined on the sender's side), keeps the staying
identifier and the count, and is written sorted by digest. After the last round every run holds one range of digests,
whole; no run ever holds more than its share, and a text that fills a third of all rows is one row of each run.

Verification: a digest is merged only together with the text's length and a second digest of another kind, so texts
that shared a SHA-256 alone would stay apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Runs that are merged at once: a power of 16, as a digest's hex digits deal them out.
FAN = 16
#: A group counts as large from this share of all rows on; there are at most as many large groups, which bounds their broadcast.
LARGE = 1000
_KEY = ["sha", "md", "n"]


def _lane(run: str, done: int, rounds: int):
    """A run's number after so many rounds: the first digits are the digest's, the others still the run's own."""
    own = F.lpad(F.conv(F.col(run).cast("string"), 10, 16), rounds, "0")
    return F.concat(F.substring(F.hex("sha"), 1, done), F.substring(own, done + 1, rounds - done))


def merged_digests(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, sha, md, n, run) -> (sha, md, n, keep_id, size), one row for each text; keep_id is the largest doc_id, null if all are."""
    runs = rows.agg(F.max("run")).first()[0]
    if runs is None:
        return rows.select(*_KEY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"))
    rounds = max(1, math.ceil(math.log(runs + 1, FAN)))
    held = rows.select(*_KEY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"), "run")
    for r in range(1, rounds + 1):
        held = held.withColumn("lane", _lane("run", r, rounds))
        merged = held.groupBy("lane", *_KEY).agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("size"))
        after = scratch.save(merged.withColumn("run", F.conv("lane", 16, 10).cast("long")).drop("lane").sortWithinPartitions("run", "sha"), "runs")
        if r > 1:
            scratch.drop(held_table)
        held = held_table = after
    return held.drop("run")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, keep_id, group_size (long), kept, text_sha256 (lowercase hex of the UTF-8 text), one row for each row.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with the largest doc_id stays. A
    null doc_id loses to any other; where all are null, keep_id is null and all rows stay, as do rows that repeat the
    staying id. An empty table gives an empty result; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(text, 256)).alias("sha"), F.unhex(F.md5(text)).alias("md"), F.octet_length(text).alias("n"), F.spark_partition_id().cast("long").alias("run"))
    rows = scratch.save(rows, "digests")
    groups = merged_digests(rows, scratch).where("size > 1")
    total = rows.count()
    large = F.col("size") * LARGE >= total
    found = [F.col("keep_id").alias("g_keep"), F.col("size").alias("g_size")]
    most = F.broadcast(groups.where(large).select(*_KEY, *found))
    rest = groups.where(~large).select(*_KEY, *found)
    ids = rows.select("doc_id", *_KEY)
    both = ids.join(most, _KEY).unionByName(ids.join(most, _KEY, "left_anti").join(rest, _KEY, "left"))
    keep = F.when(F.col("g_size").isNull(), F.col("doc_id")).otherwise(F.col("g_keep"))
    return both.select("doc_id", keep.alias("keep_id"), F.coalesce("g_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
