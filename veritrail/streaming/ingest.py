"""Streams of turns and facts.

Tables that streams write are kept in buckets of a key's hash. A commit writes new files for the
buckets it touches and then one small manifest that names the current files of every bucket; what
is not in the newest manifest was never written, so readers never see half a commit and a lost
driver repeats it. Merging is by the rows' own order, so a batch that is replayed, also by a query
with a new checkpoint, leaves the table as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from veritrail.operators import reconcile
from veritrail.operators.shared import stage

#: Buckets of a table, and commits whose files are kept for readers that are still at them.
BUCKETS = 64
KEPT = 3


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, pattern = _fs(spark, f"{path}/manifest-*")
    return sorted(int(s.getPath().getName().split("-")[1]) for s in fs.globStatus(pattern) or [])


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, str]:
    """Bucket to folder, as commit ``number`` left them."""
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest-{number}").collect()))  # a line


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as the newest commit left it; None before the first one."""
    numbers = _manifests(spark, path)
    if not numbers:
        return None
    return spark.read.option("mergeSchema", True).parquet(*(f"{path}/{d}" for d in sorted(set(_manifest(spark, path, numbers[-1]).values()))))


def _commit(spark: SparkSession, path: str, fresh: DataFrame, touched: DataFrame, key: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int) -> None:
    """Replace the buckets of ``touched`` keys by ``merge`` of what they hold and ``fresh``."""
    fs, _ = _fs(spark, path)
    numbers = _manifests(spark, path)
    number = (numbers[-1] if numbers else 0) + 1
    held = _manifest(spark, path, numbers[-1]) if numbers else {}
    mine = [r[0] for r in touched.select(_bucket(key, buckets)).distinct().collect()]  # at most the number of buckets
    if not mine:
        return
    folders = [f"{path}/{held[str(b)]}" for b in mine if str(b) in held]
    old = spark.read.option("mergeSchema", True).parquet(*folders) if folders else None
    merged = merge(old, fresh).withColumn("_b", _bucket(key, buckets))
    # a folder that an unfinished commit left behind is not in any manifest
    fs.delete(_fs(spark, f"{path}/data-{number}")[1], True)
    merged.repartition("_b").write.partitionBy("_b").parquet(f"{path}/data-{number}")
    there = {s.getPath().getName() for s in fs.listStatus(_fs(spark, f"{path}/data-{number}")[1])}
    # a bucket that holds no row any more has no folder
    now = {b: d for b, d in held.items() if int(b) not in set(mine)} | {str(b): f"data-{number}/_b={b}" for b in mine if f"_b={b}" in there}
    out = fs.create(_fs(spark, f"{path}/.manifest-{number}")[1], True)
    out.write(bytearray(json.dumps(now), "utf-8"))
    out.close()
    fs.delete(_fs(spark, f"{path}/manifest-{number}")[1], False)
    if not fs.rename(_fs(spark, f"{path}/.manifest-{number}")[1], _fs(spark, f"{path}/manifest-{number}")[1]):
        raise OSError(f"{path}/manifest-{number} could not be written")
    _expire(spark, path)


def _expire(spark: SparkSession, path: str) -> None:
    """Drop manifests but for the newest ones, and the files that none of these names."""
    fs, _ = _fs(spark, path)
    numbers = _manifests(spark, path)
    for n in numbers[:-KEPT]:
        fs.delete(_fs(spark, f"{path}/manifest-{n}")[1], False)
    used = {d for n in numbers[-KEPT:] for d in _manifest(spark, path, n).values()}
    for s in fs.globStatus(_fs(spark, f"{path}/data-*/_b=*")[1]) or []:
        name = f"{s.getPath().getParent().getName()}/{s.getPath().getName()}"
        if name not in used:
            fs.delete(s.getPath(), True)


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the greatest ``order``; of several the one with the greatest hash, so any order of arrival gives the same.

    Rows with a null key are left out; a null ``order`` is older than any other.
    """
    rank = F.struct(F.col(order).isNotNull(), F.col(order), F.xxhash64(*rows.columns))
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*rows.columns), rank).alias("_r")).select("_r.*")


def upsert_sink(spark: SparkSession, path: str, key: str, order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps in ``path`` the newest row of every ``key`` by ``order``."""

    def merge(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
        return newest(fresh if old is None else old.unionByName(fresh, allowMissingColumns=True), key, order)

    def write(batch: DataFrame, number: int) -> None:
        fresh = newest(batch, key, order)
        _commit(spark, path, fresh, fresh, key, merge, buckets)

    return write


def reconciling_sink(spark: SparkSession, facts_path: str, edges_path: str, predicates: DataFrame, order: str = "ing", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps facts and the edges between their claims.

    Only the slots that a batch touches are reconciled again, from all their facts, so a fact that
    comes late ends where it would be had it come in time; their former edges are replaced.
    """
    facts = upsert_sink(spark, facts_path, "fact_id", order, buckets)

    def merge_for(touched: DataFrame) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
        return lambda old, fresh: fresh if old is None else old.join(touched, "slot", "left_anti").unionByName(fresh)

    def write(batch: DataFrame, number: int) -> None:
        facts(batch, number)
        held = latest(spark, facts_path)
        if held is None:
            return
        claims = stage(reconcile.distinct_claims(batch, predicates, existing=held), "claims")
        slot = F.concat_ws("|", *reconcile.SLOT)
        found = reconcile.claim_edges(claims).join(claims.select(F.col("fact_id").alias("src"), slot.alias("slot")), "src").select("slot", "rel", "src", "dst")
        touched = stage(claims.select(slot.alias("slot")).distinct(), "touched")
        _commit(spark, edges_path, stage(found, "edges"), touched, "slot", merge_for(touched), buckets)

    return write


def session_activity(turns: DataFrame, gap: str = "30 minutes", lateness: str = "7 days") -> DataFrame:
    """Bursts of turns per corpus by event time: corpus, start, end, turns.

    ``turns`` is a stream with turn_id, corpus and ts (seconds). A turn delivered twice within
    ``lateness`` counts once; what comes later than that is left out.
    """
    timed = turns.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["turn_id"])
    return timed.groupBy("corpus", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("turns")).select("corpus", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def start_upserts(facts: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Run ``upsert_sink`` over a stream until its input is used up."""
    spark = facts.sparkSession
    return facts.writeStream.foreachBatch(upsert_sink(spark, path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
