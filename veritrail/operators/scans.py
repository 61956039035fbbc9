"""Ordered scans per key that stay distributed when one key is hot.

Rows are put in global range order and scanned once per partition; one summary per partition is
combined by prefix; only rows of a partition's first key may need what was carried into it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from veritrail.operators.intervals import key_changes
from veritrail.operators.shared import in_range_order, stage


def _scan(keys: list[str], flag: str, payload: str):
    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for pdf in batches:
            if not len(pdf):
                continue
            size = len(pdf)
            kept = pdf[payload].astype("Int64").where(pdf[flag])
            pdf = pdf.assign(_kept=kept)
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            group = np.cumsum(key_changes(pdf, keys))
            filled = pdf["_kept"].groupby(group).ffill()
            pdf["_before"] = filled.groupby(group).shift(1)
            pdf["_upto"] = filled
            held = pdf.iloc[-1:].copy()
            held["_kept"] = held["_upto"]
            held = held.drop(columns=["_before", "_upto"])
            yield pdf.iloc[-size:].drop(columns="_kept").assign(_part=np.int32(part))

    return scan


def last_before(df: DataFrame, keys: list[str], order: list[str], flag: str, payload: str, out: str) -> DataFrame:
    """Adds ``out``: the ``payload`` (BIGINT) of the latest preceding row of the key with ``flag``.

    ``order`` must be a total order within a key. Null where no such row precedes.
    """
    spark = df.sparkSession
    extra = [T.StructField("_before", T.LongType()), T.StructField("_upto", T.LongType()), T.StructField("_part", T.IntegerType())]
    rows = stage(in_range_order(df, *keys, *order).mapInPandas(_scan(keys, flag, payload), T.StructType([*df.schema.fields, *extra])), "scan")
    bounds = rows.groupBy("_part").agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys, *order, "_upto")).alias("last")).collect()  # a row per partition
    carried, held = [], None
    for row in sorted(bounds, key=lambda r: r["_part"]):
        first, key, value = tuple(row["first"]), tuple(row["last"][k] for k in keys), row["last"]["_upto"]
        if held and held[0] == first and held[1] is not None:
            carried.append((row["_part"], *first, held[1]))
        held = (key, value if value is not None else held[1] if held and held[0] == key else None)
    schema = T.StructType([T.StructField("_part", T.IntegerType()), *(T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)), T.StructField("_c", T.LongType())])
    carry = F.broadcast(spark.createDataFrame(carried, schema))
    mine = F.lit(True)
    for i, k in enumerate(keys):
        mine = mine & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(carry, "_part", "left").select(*df.columns, F.coalesce("_before", F.when(mine, F.col("_c"))).alias(out))


def lasts_before(df: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, str]], rows: str, hot_rows: int) -> DataFrame:
    """Adds a column per entry of ``wanted`` (out: flag, payload), each as ``last_before`` does.

    ``rows`` holds how many rows a key has. Keys of up to ``hot_rows`` go through one window; the
    others are scanned in range order, so that no key of any size is gathered in one task.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cold = df.filter(F.col(rows) <= hot_rows).withColumns({out: F.last(F.when(F.col(flag), F.col(payload)), ignorenulls=True).over(before) for out, (flag, payload) in wanted.items()})
    hot = df.filter(F.col(rows) > hot_rows)
    if not hot.head(1):
        return cold
    for out, (flag, payload) in wanted.items():
        hot = last_before(hot, keys, order, flag, payload, out)
    return cold.unionByName(hot)
