"""Continuous periods and gaps of overlapping intervals per entity.

Method: rows are globally range-sorted by entity and start; every partition reduces its rows to
local islands; one summary per partition (first entity, last entity, running maximum end) is
combined by prefix; the islands are then rescanned with the carried state, which labels those
that continue an island begun in an earlier partition. One entity may spread over any number of
partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from veritrail.operators.shared import OPEN_END, in_range_order, stage


def key_changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from the row before it; nulls equal each other."""
    changed = np.zeros(len(pdf), dtype=bool)
    if len(pdf):
        changed[0] = True
    for key in keys:
        codes, _ = pd.factorize(pdf[key], use_na_sentinel=True)
        changed[1:] |= codes[1:] != codes[:-1]
    return changed


def _local_islands(keys: list[str]):
    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for pdf in batches:
            pdf = pdf.assign(_prev=np.int64(-1), _has_prev=False)
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            fresh = key_changes(pdf, keys)
            group = np.cumsum(fresh)
            reach = pdf["_e"].groupby(group).cummax().to_numpy()
            before = np.concatenate([[0], reach[:-1]])
            starts = fresh | (pdf["_s"].to_numpy() > before)
            at = np.flatnonzero(starts)
            last = np.concatenate([at[1:] - 1, [len(pdf) - 1]])
            out = pdf.iloc[at].copy()
            out["_e"] = reach[last]
            inner = ~fresh[at]
            out["_prev"] = np.where(inner, before[at], out["_prev"].to_numpy())
            out["_has_prev"] = inner | out["_has_prev"].to_numpy()
            out["_part"] = np.int32(part)
            held = out.iloc[-1:].drop(columns="_part")
            yield out.iloc[:-1]
        if held is not None:
            yield held.assign(_part=np.int32(part))

    return scan


def carry_forward(rows: list, keys: list[str]) -> list[tuple]:
    """Prefix-combine partition summaries: (part, keys..., carried end, label of the open island).

    ``rows``: one per partition, ordered, with ``first`` and ``last`` = (keys..., _s, _e).
    """
    out, held = [], None
    for row in rows:
        first, last = tuple(row["first"][k] for k in keys), tuple(row["last"][k] for k in keys)
        carried = held if held and held[0] == first else None
        if carried:
            out.append((row["_part"], *first, carried[1], carried[2]))
        start, end = row["last"]["_s"], row["last"]["_e"]
        if carried and last == first:
            held = (last, max(carried[1], end), carried[2] if start <= carried[1] else start)
        else:
            held = (last, end, start)
    return out


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Maximal covered periods and the gaps between them, per ``keys``.

    ``end`` null or 0 means open; a set end not after the start makes the row void; a null start
    gives no period. Touching intervals are joined. Null keys form an entity of their own.
    Returns keys, kind (``period`` or ``gap``), start_s, end_s (0 if open). Other columns of
    ``df`` are ignored, whatever their names. An empty table gives no rows.
    """
    spark = df.sparkSession
    ends = F.when(F.coalesce(F.col(end), F.lit(0)) == 0, F.lit(OPEN_END)).otherwise(F.col(end)).cast("long")
    rows = (
        df.select(*keys, F.col(start).cast("long").alias("_s"), ends.alias("_e"))
        .filter(F.col("_s").isNotNull() & (F.col("_e") > F.col("_s")))
        .groupBy(*keys, "_s")
        .agg(F.max("_e").alias("_e"))
    )
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField(n, t) for n, t in (("_s", T.LongType()), ("_e", T.LongType()), ("_prev", T.LongType()), ("_has_prev", T.BooleanType()), ("_part", T.IntegerType()))]
    )
    islands = stage(in_range_order(rows, *keys, "_s").mapInPandas(_local_islands(keys), schema), "islands")
    bounds = islands.groupBy("_part").agg(F.min(F.struct(*keys, "_s")).alias("first"), F.max(F.struct(*keys, "_s", "_e")).alias("last"))
    carried = carry_forward(sorted(bounds.collect(), key=lambda r: r["_part"]), keys)  # a row per partition
    carry_schema = T.StructType([T.StructField("_part", T.IntegerType())] + [T.StructField(f"_k{i}", rows.schema[k].dataType) for i, k in enumerate(keys)] + [T.StructField("_c", T.LongType()), T.StructField("_label", T.LongType())])
    carry = F.broadcast(spark.createDataFrame(carried, carry_schema))
    mine = F.lit(True)
    for i, k in enumerate(keys):
        mine = mine & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    mine = F.coalesce(F.col("_label").isNotNull() & mine, F.lit(False))
    goes_on = mine & (F.col("_s") <= F.col("_c"))
    before = F.greatest(F.when(F.col("_has_prev"), F.col("_prev")), F.when(mine, F.col("_c")))
    whole = (
        islands.join(carry, "_part", "left")
        .select(*keys, F.when(goes_on, F.col("_label")).otherwise(F.col("_s")).alias("_s"), "_e", F.when(~goes_on, before).alias("_before"))
        .groupBy(*keys, "_s")
        .agg(F.max("_e").alias("_e"), F.max("_before").alias("_before"))
    )
    shown = F.when(F.col("_e") == OPEN_END, F.lit(0).cast("long")).otherwise(F.col("_e"))
    kinds = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s").alias("start_s"), shown.alias("end_s")),
        F.struct(F.lit("gap").alias("kind"), F.col("_before").alias("start_s"), F.col("_s").alias("end_s")),
    )
    return whole.select(*keys, F.explode(F.filter(kinds, lambda x: x["start_s"].isNotNull())).alias("_x")).select(*keys, "_x.*")
