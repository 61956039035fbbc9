"""Full history of changing attributes from snapshots and updates.

Method: an event-sourced change log per attribute (one counting record per start), each attribute
with its own intervals; the attribute's timeline is split at the union of its boundary dates
(starts and explicit ends) and touching pieces with one value are coalesced. ``entity_states``
combines all attributes of an entity: its timeline is split at the union of the boundaries of all
attributes, every piece gets the value each attribute had, equal neighbours are coalesced.

Both work on rows in global range order with one carried state per partition, so an attribute or
entity may hold any share of all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from veritrail.operators.intervals import key_changes
from veritrail.operators.shared import OPEN_END, in_range_order, stage


def change_log(df: DataFrame, keys: list[str], value: str, start: str, end: str, known: str, tiebreak: str) -> DataFrame:
    """One counting record per (keys, start): greatest ``known``, then greatest ``tiebreak``.

    Returns keys, _s, _e (own end, or open), _v. Repeated rows vanish here, before any sort; the
    aggregation combines map-side, so a hot key or a repeated row costs one group per task.
    """
    ends = F.when(F.coalesce(F.col(end), F.lit(0)) == 0, F.lit(OPEN_END)).otherwise(F.col(end)).cast("long")
    picked = F.struct(F.col(known).alias("a"), F.col(tiebreak).alias("b"), ends.alias("e"), F.col(value).alias("v"))
    return (
        df.filter(F.col(start).isNotNull())
        .groupBy(*keys, F.col(start).cast("long").alias("_s"))
        .agg(F.max(picked).alias("_p"))
        .select(*keys, "_s", F.col("_p.e").alias("_e"), F.col("_p.v").alias("_v"))
    )


def _local_versions(keys: list[str]):
    def coalesce(pdf: pd.DataFrame, part: int, whole: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        """Versions of sorted pieces; the last piece waits for its successor unless ``whole``."""
        fresh = key_changes(pdf, keys)
        start, end = pdf["_s"].to_numpy(), pdf["_e"].to_numpy().copy()
        follows = ~fresh[1:]
        end[:-1] = np.where(follows, np.minimum(end[:-1], start[1:]), end[:-1])
        values, _ = pd.factorize(pdf["_v"])
        joined = np.zeros(len(pdf), dtype=bool)
        joined[1:] = follows & (end[:-1] == start[1:]) & (end[1:] > start[1:]) & (values[1:] == values[:-1])
        at = np.flatnonzero(~joined)
        last = np.concatenate([at[1:] - 1, [len(pdf) - 1]])
        out = pdf.iloc[at].copy()
        out["_own"] = pdf["_e"].to_numpy()[last]
        out["_e"] = end[last]
        out["_z"] = start[last]
        out["_part"] = np.int32(part)
        return (out, None) if whole else (out.iloc[:-1], out.iloc[-1:])

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for pdf in batches:
            if not len(pdf):
                continue
            if held is not None:
                # the held version's last piece goes back in front, its earlier pieces stay in _s0
                piece = held.assign(_s=held["_z"], _e=held["_own"])
                out, nxt = coalesce(pd.concat([piece[[*keys, "_s", "_e", "_v"]], pdf], ignore_index=True), part, False)
                first = out if len(out) else nxt
                first.iloc[0, first.columns.get_loc("_s")] = held["_s"].iloc[0]
                out, held = out, nxt
            else:
                out, held = coalesce(pdf, part, False)
            yield out
        if held is not None:
            yield held

    return scan


def _stitch(bounds: list, keys: list[str]) -> list[tuple]:
    """Per partition: label of its first version, cut of its last; nulls where nothing changes."""
    rows, held = [], None
    for bound in bounds:
        first, last = bound["first"], bound["last"]
        first_key, last_key = tuple(first[k] for k in keys), tuple(last[k] for k in keys)
        label = None
        if held and held["key"] == first_key:
            rows[-1]["cut"] = first["_s"]
            if min(held["e"], first["_s"]) == first["_s"] < first["_e"] and held["v"] == first["_v"]:
                label = held["label"]
        rows.append({"part": bound["_part"], "fk": first_key, "fs": first["_s"], "label": label, "lk": last_key, "ls": last["_s"], "cut": None})
        alone = (first_key, first["_s"]) == (last_key, last["_s"])
        held = {"key": last_key, "e": last["_e"], "v": last["_v"], "label": label if alone and label is not None else last["_s"]}
    return [(r["part"], *r["fk"], r["fs"], r["label"], *r["lk"], r["ls"], r["cut"]) for r in rows]


def versions(log: DataFrame, keys: list[str]) -> DataFrame:
    """Versions of a change log (keys, _s, _e, _v; unique on keys and _s): keys, _s, _e, _v.

    A piece holds from its start to the next piece's start or its own end, whichever is first;
    a piece whose own end is not after its start holds for no time but still ends its
    predecessor. Touching pieces of equal value (null equals null) are one version. No rows in,
    no rows out.
    """
    spark, long, part = log.sparkSession, T.LongType(), T.StructField("_part", T.IntegerType())
    kinds = [log.schema[k].dataType for k in keys]
    schema = T.StructType([*(log.schema[k] for k in keys), *(T.StructField(n, t) for n, t in (("_s", long), ("_e", long), ("_v", log.schema["_v"].dataType), ("_own", long), ("_z", long))), part])
    pieces = stage(in_range_order(log.select(*keys, "_s", "_e", "_v"), *keys, "_s").mapInPandas(_local_versions(keys), schema), "versions")
    edge = F.struct(*keys, "_s", "_e", "_v")
    bounds = pieces.groupBy("_part").agg(F.min(edge).alias("first"), F.max(edge).alias("last")).collect()  # a row per partition
    links = _stitch(sorted(bounds, key=lambda r: r["_part"]), keys)
    side = lambda x: [T.StructField(f"_{x}{i}", t) for i, t in enumerate(kinds)]
    link = F.broadcast(spark.createDataFrame(links, T.StructType([part, *side("f"), T.StructField("_fs", long), T.StructField("_label", long), *side("l"), T.StructField("_ls", long), T.StructField("_cut", long)])))

    def at(x: str) -> Column:
        found = F.col("_s") == F.col(f"_{x}s")
        for i, k in enumerate(keys):
            found = found & F.col(k).eqNullSafe(F.col(f"_{x}{i}"))
        return found

    start = F.when(at("f") & F.col("_label").isNotNull(), F.col("_label")).otherwise(F.col("_s"))
    end = F.when(at("l") & F.col("_cut").isNotNull(), F.least("_e", "_cut")).otherwise(F.col("_e"))
    return (
        pieces.join(link, "_part")
        .select(*keys, start.alias("_n"), end.alias("_e"), "_v")
        .groupBy(*keys, F.col("_n").alias("_s"))
        .agg(F.max("_e").alias("_e"), F.first("_v").alias("_v"))
        .filter(F.col("_e") > F.col("_s"))
    )


def attribute_history(df: DataFrame, keys: list[str], value: str, start: str, end: str, known: str, tiebreak: str) -> DataFrame:
    """Versions of every attribute: keys, ``value``, valid_from, valid_to (0 if open).

    Of records equal in keys and ``start`` the one with the greatest ``known`` counts (then the
    greatest ``tiebreak``). Null ``start`` states nothing and is left out; null or 0 ``end`` is
    open; null keys form a group of their own; columns not named are ignored.
    """
    found = versions(change_log(df, keys, value, start, end, known, tiebreak), keys)
    shown = F.when(F.col("_e") == OPEN_END, F.lit(0).cast("long")).otherwise(F.col("_e"))
    return found.select(*keys, F.col("_v").alias(value), F.col("_s").alias("valid_from"), shown.alias("valid_to"))


def _fill_states(keys: list[str], slots: list[str]):
    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for pdf in batches:
            if not len(pdf):
                continue
            size = len(pdf)
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            pdf[slots] = pdf[slots].groupby(np.cumsum(key_changes(pdf, keys))).ffill()
            held = pdf.iloc[-1:].copy()
            yield pdf.iloc[-size:].assign(_part=np.int32(part))

    return scan


def entity_states(history: DataFrame, entity: list[str], attribute: str, value: str, attributes: list[str]) -> DataFrame:
    """All attributes of an entity side by side: entity, valid_from, valid_to, state MAP.

    ``history``: as from ``attribute_history`` with keys entity + attribute. ``attributes`` is the
    vocabulary (a short fixed list); others are ignored. The timeline is split at the union of
    all boundary dates and equal neighbours are coalesced; stretches in which no attribute holds
    are left out. A null value stays in the map as null.
    """
    spark = history.sparkSession
    slots = [f"_a{i}" for i in range(len(attributes))]
    # "=" and a value, "<" for a null value, "-" for an end; of two at one date the start wins
    said = F.coalesce(F.concat(F.lit("="), F.col(value)), F.lit("<"))
    known = history.filter(F.col(attribute).isin(attributes))
    at = F.explode(F.array(F.struct(F.col("valid_from").alias("_s"), said.alias("_x")), F.struct(F.when(F.col("valid_to") != 0, F.col("valid_to")).alias("_s"), F.lit("-").alias("_x"))))
    events = known.select(*entity, F.col(attribute).alias("_attribute"), at.alias("_ev")).select(*entity, "_attribute", "_ev.*").filter(F.col("_s").isNotNull())
    wide = events.groupBy(*entity, "_s").agg(*(F.max(F.when(F.col("_attribute") == a, F.col("_x"))).alias(s) for a, s in zip(attributes, slots)))
    schema = T.StructType([*wide.schema.fields, T.StructField("_part", T.IntegerType())])
    filled = stage(in_range_order(wide, *entity, "_s").mapInPandas(_fill_states(entity, slots), schema), "states")
    last = filled.groupBy("_part").agg(F.min(F.struct(*entity)).alias("first"), F.max(F.struct(*entity, "_s", *slots)).alias("last")).collect()  # a row per partition
    carried, held = [], None
    for row in sorted(last, key=lambda r: r["_part"]):
        first, key = tuple(row["first"]), tuple(row["last"][k] for k in entity)
        state = [row["last"][s] for s in slots]
        if held and held[0] == first:
            carried.append((row["_part"], *held[0], *held[1]))
            if key == first:
                state = [new if new is not None else old for new, old in zip(state, held[1])]
        held = (key, state)
    schema = T.StructType([T.StructField("_part", T.IntegerType())] + [T.StructField(f"_k{i}", wide.schema[k].dataType) for i, k in enumerate(entity)] + [T.StructField(f"_c{s}", T.StringType()) for s in slots])
    carry = F.broadcast(spark.createDataFrame(carried, schema))
    mine = F.lit(True)
    for i, k in enumerate(entity):
        mine = mine & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    pairs = [F.coalesce(F.col(s), F.when(mine, F.col(f"_c{s}"))) for s in slots]
    state = F.to_json(F.filter(F.array(*(F.struct(F.lit(a).alias("key"), p.alias("value")) for a, p in zip(attributes, pairs))), lambda x: x["value"] != "-"))
    log = filled.join(carry, "_part", "left").select(*entity, "_s", F.lit(OPEN_END).alias("_e"), state.alias("_v"))
    found = versions(log, entity).filter(F.col("_v") != "[]")
    entries = F.transform(F.from_json("_v", "array<struct<key:string,value:string>>"), lambda x: F.struct(x["key"], F.when(x["value"] != "<", F.substring(x["value"], 2, 1 << 30))))
    shown = F.when(F.col("_e") == OPEN_END, F.lit(0).cast("long")).otherwise(F.col("_e"))
    return found.select(*entity, F.col("_s").alias("valid_from"), shown.alias("valid_to"), F.map_from_entries(entries).alias("state"))
