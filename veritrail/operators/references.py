"""References to records that do not exist, or that arrive after the reference.

Method: the parents' integer keys are put in global range order and compressed into contiguous
runs; the distinct referenced keys lie in the same order and are matched as-of to the run that
starts at or before them. A key beyond that run's end is missing. Equal keys always share a range
partition, so a run cut by a partition border loses nothing. A run carries the least and the
greatest arrival of its keys; only where these leave it open is the key itself looked up. Runs end
at multiples of ``RUN``: keys that were given one after another arrive over a long time, and a run
of all of them would leave every reference open.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veritrail.operators.shared import OPEN_END, lookup, stage, width


#: A run holds at most so many keys, a power of two.
RUN = 256


def _as_of_runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (_id, _ref, _lo, _hi): parents with their arrival in both _lo and _hi, then the
    reference with its count and first ts there. Yields the references and what they met."""
    run: tuple[int, int, int, int] | None = None  # start, end, least and greatest arrival
    for pdf in batches:
        ids, ref = pdf["_id"].to_numpy(), pdf["_ref"].to_numpy()
        parent = np.flatnonzero(ref == 0)
        keys = ids[parent]
        lo, hi = pdf["_lo"].to_numpy()[parent], pdf["_hi"].to_numpy()[parent]
        breaks = np.ones(len(keys), dtype=bool)
        breaks[1:] = (keys[1:] != keys[:-1] + 1) | (keys[1:] % RUN == 0)
        if run is not None:
            keys, lo, hi = np.concatenate([[run[0]], keys]), np.concatenate([[run[2]], lo]), np.concatenate([[run[3]], hi])
            breaks = np.concatenate([[True], breaks])
            if len(keys) > 1:
                breaks[1] = keys[1] != run[1] + 1 or keys[1] % RUN == 0
        at = np.flatnonzero(breaks)
        starts = keys[at]
        ends = np.concatenate([keys[at[1:] - 1], keys[-1:]]) if len(at) else keys
        if run is not None and len(at):
            first_end = at[1] - 1 if len(at) > 1 else len(keys) - 1
            if first_end == 0:
                ends[0] = run[1]
        least = np.minimum.reduceat(lo, at) if len(at) else lo
        most = np.maximum.reduceat(hi, at) if len(at) else hi
        refs = pdf.iloc[np.flatnonzero(ref == 1)]
        wanted = refs["_id"].to_numpy()
        place = np.searchsorted(starts, wanted, side="right") - 1
        if len(starts):
            safe = np.maximum(place, 0)
            found = (place >= 0) & (wanted <= ends[safe])
            yield pd.DataFrame({"_id": wanted, "_found": found, "_lo": least[safe], "_hi": most[safe], "_n": refs["_lo"].to_numpy(), "_first": refs["_hi"].to_numpy()})
            run = (int(starts[-1]), int(ends[-1]), int(least[-1]), int(most[-1]))
        else:
            zero = np.zeros(len(wanted), dtype="int64")
            yield pd.DataFrame({"_id": wanted, "_found": np.zeros(len(wanted), dtype=bool), "_lo": zero, "_hi": zero, "_n": refs["_lo"].to_numpy(), "_first": refs["_hi"].to_numpy()})


def broken_references(refs: DataFrame, parents: DataFrame, parent_id: str, parent_known: str) -> DataFrame:
    """References whose target is missing or became known after the reference was made.

    ``refs``: columns src_table, ref_field, src_id, ref_id, ts, all pointing into ``parents``.
    Null and 0 are no reference; each (src_table, ref_field, src_id, ref_id) comes out once; a
    parent that was delivered repeatedly counts from its earliest arrival; a reference with null
    ts cannot be late. Parents with a null id are ignored, with null arrival count as always
    known. Returns those columns and state (``missing`` or ``late``).

    The references are reduced to distinct keys with their counts before the range shuffle, so a
    key that a third of all rows cite is one row there; back on the rows it is a broadcast one.
    """
    rows = refs.select("src_table", "ref_field", "src_id", "ref_id", "ts").filter(F.coalesce(F.col("ref_id"), F.lit(0)) != 0)
    least = F.coalesce(F.col(parent_known), F.lit(-(1 << 63)))
    have = parents.filter(F.col(parent_id).isNotNull()).groupBy(F.col(parent_id).cast("long").alias("_id")).agg(F.min(least).cast("long").alias("_at"))
    want = rows.groupBy(F.col("ref_id").cast("long").alias("_id")).agg(F.count("*").alias("_n"), F.min("ts").alias("_first"))
    both = have.select("_id", F.lit(0).alias("_ref"), F.col("_at").alias("_lo"), F.col("_at").alias("_hi")).unionByName(
        want.select("_id", F.lit(1).alias("_ref"), F.col("_n").alias("_lo"), F.coalesce("_first", F.lit(OPEN_END)).alias("_hi"))
    )
    # ranges by _id alone, so that a reference always lies with the parent it names
    ordered = both.repartitionByRange(width(both.sparkSession), "_id").sortWithinPartitions("_id", "_ref")
    matched = ordered.mapInPandas(_as_of_runs, "_id long, _found boolean, _lo long, _hi long, _n long, _first long")
    suspect = matched.filter(~F.col("_found") | (F.col("_hi") > F.col("_first")))
    suspect = stage(suspect, "suspects")
    exact = suspect.filter(~F.col("_found") | (F.col("_lo") == F.col("_hi"))).select("_id", "_n", "_found", F.col("_hi").alias("_at"))
    open_ = suspect.filter(F.col("_found") & (F.col("_lo") != F.col("_hi"))).select("_id", "_n", "_found").join(have, "_id")
    bad = exact.unionByName(open_).withColumnRenamed("_id", "ref_id")
    late = F.col("_found") & (F.col("_at") > F.col("ts"))
    return (
        lookup(rows.withColumn("ref_id", F.col("ref_id").cast("long")), bad, ["ref_id"], "_n")
        .select("src_table", "ref_field", "src_id", "ref_id", F.when(~F.col("_found"), "missing").when(late, "late").alias("state"), "ts")
        .filter(F.col("state").isNotNull())
        .groupBy("src_table", "ref_field", "src_id", "ref_id")
        .agg(F.max("state").alias("state"), F.min("ts").alias("ts"))
    )


def orphan_report(broken: DataFrame) -> DataFrame:
    """Broken references per table, field, state and UTC month of ts."""
    month = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM")
    return broken.groupBy("src_table", "ref_field", "state", month.alias("month")).agg(F.count("*").alias("n"))
