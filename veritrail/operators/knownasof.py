"""Attributes as they were known at an event's time.

Method: per entity a persistent search tree over valid time, path-copied at every change of what
is known; an event selects the root of its time and searches the valid-time key in it.

An entity with many rows is cut into slabs of event time. A row that covers a slab from end to
end differs from others there only by its rank, so of these just the best one enters the slab;
other rows enter the one or two slabs in which they begin or end. Every event lies in one slab.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veritrail.operators.shared import OPEN_END, lookup, stage, width

#: Rows of one entity above which it is cut into slabs of about as many rows.
SLAB_ROWS = 50_000


class PersistentTree:
    """A path-copied treap over (valid_from, id, row), augmented with the greatest end below a node.

    Nodes are never changed; ``put`` returns the root of a new version. ``search`` finds the
    greatest key not above ``at`` whose end lies after ``at``.
    """

    __slots__ = ("key", "end", "left", "right", "most", "heat")

    def __init__(self) -> None:
        self.key: list[tuple] = [(0, 0, 0)]
        self.end, self.most, self.heat = [0], [-(1 << 63)], [0]
        self.left, self.right = [0], [0]

    def _node(self, key: tuple, end: int, heat: int, left: int, right: int) -> int:
        self.key.append(key)
        self.end.append(end)
        self.heat.append(heat)
        self.left.append(left)
        self.right.append(right)
        self.most.append(max(end, self.most[left], self.most[right]))
        return len(self.key) - 1

    @staticmethod
    def _heat(key: tuple) -> int:
        return (hash(key) * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF | 1

    def put(self, root: int, key: tuple, end: int) -> int:
        """A new version in which ``key`` ends at ``end``."""
        path, node = [], root
        while node and self.key[node] != key:
            path.append(node)
            node = self.left[node] if key < self.key[node] else self.right[node]
        if node:
            made = self._node(key, end, self.heat[node], self.left[node], self.right[node])
        else:
            made = self._node(key, end, self._heat(key), 0, 0)
        for parent in reversed(path):
            low, high, heat = self.left[parent], self.right[parent], self.heat[parent]
            if key < self.key[parent]:
                if self.heat[made] > heat and self.key[made] == key:  # rotate right on the copy
                    below = self._node(self.key[parent], self.end[parent], heat, self.right[made], high)
                    made = self._node(key, end, self.heat[made], self.left[made], below)
                else:
                    made = self._node(self.key[parent], self.end[parent], heat, made, high)
            elif self.heat[made] > heat and self.key[made] == key:
                below = self._node(self.key[parent], self.end[parent], heat, low, self.left[made])
                made = self._node(key, end, self.heat[made], below, self.right[made])
            else:
                made = self._node(self.key[parent], self.end[parent], heat, low, made)
        return made

    def search(self, root: int, at: int) -> tuple | None:
        wait, node = [], root
        while True:
            while node and self.most[node] > at:
                if self.key[node][0] > at:
                    node = self.left[node]
                else:
                    wait.append(node)
                    node = self.right[node]
            if not wait:
                return None
            node = wait.pop()
            if self.end[node] > at:
                return self.key[node]
            node = self.left[node]


def _ask(key: tuple, facts: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    """One shard: its entities' trees are built one after another and asked in order of time."""
    found_key, found_t, found_id = [], [], []
    facts = facts.reset_index(drop=True)
    groups = facts.groupby("_e", sort=False).indices
    for entity, rows in events.groupby("_e", sort=False).indices.items():
        mine = groups.get(entity)
        if mine is None:
            continue
        part = facts.iloc[mine]
        changes = []
        for n, (start, fact, known, end, end_known) in enumerate(zip(*(part[c].to_numpy().tolist() for c in ("_from", "_id", "_known", "_to", "_to_known")))):
            key = (start, fact, n)
            changes.append((known, 0, key, OPEN_END))
            if end != OPEN_END and end_known != OPEN_END:
                changes.append((max(known, end_known), 1, key, end))
        changes.sort()
        tree, root, times, roots = PersistentTree(), 0, [], []
        for known, _, key, end in changes:
            root = tree.put(root, key, end)
            if times and times[-1] == known:
                roots[-1] = root
            else:
                times.append(known)
                roots.append(root)
        asked = np.unique(events["_t"].to_numpy()[rows])
        version = np.searchsorted(np.asarray(times), asked, side="right") - 1
        for t, v in zip(asked.tolist(), version.tolist()):
            hit = tree.search(roots[v], t) if v >= 0 else None
            if hit:
                found_key.append(entity)
                found_t.append(t)
                found_id.append(hit[1])
    return pd.DataFrame({"_e": pd.Series(found_key, dtype=object), "_t": pd.Series(found_t, dtype="int64"), "_id": pd.Series(found_id, dtype="int64")})


def _open(column: str):
    value = F.col(column).cast("long")
    return F.coalesce(F.when(value != 0, value), F.lit(OPEN_END))


def known_at(
    events: DataFrame,
    facts: DataFrame,
    keys: list[str],
    event_id: str,
    at: str,
    fact_id: str,
    valid_from: str,
    valid_to: str,
    known: str,
    end_known: str,
    slab_rows: int = SLAB_ROWS,
) -> DataFrame:
    """Per event the fact valid at its time as far as known then: event_id, fact_id.

    Of several the greatest ``valid_from`` counts, then the greatest ``fact_id``; an event for
    which nothing held has no row. An end (null or 0: none) counts only once it is both past and
    known; with unknown ``end_known`` it never does. Events or facts with a null key, id, time,
    ``valid_from`` or ``known`` match nothing. Repeated rows count once, and two rows of one
    fact count as two facts with one id. Other columns are ignored. Empty tables give no rows.
    """
    spark = events.sparkSession
    no_null = F.lit(True)
    for k in keys:
        no_null = no_null & F.col(k).isNotNull()
    # text lengths in front make the joined key unambiguous whatever the values hold
    entity = F.concat(*(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")) for k in keys)).alias("_e")
    asked = events.filter(no_null & F.col(at).isNotNull() & F.col(event_id).isNotNull()).select(F.col(event_id).alias("_event"), entity, F.col(at).cast("long").alias("_t"))
    times = asked.groupBy("_e", "_t").agg(F.count("*").alias("_n"))
    known_facts = (
        facts.filter(no_null & F.col(fact_id).isNotNull() & F.col(valid_from).isNotNull() & F.col(known).isNotNull())
        .select(entity, F.col(valid_from).cast("long").alias("_from"), F.col(fact_id).cast("long").alias("_id"), F.col(known).cast("long").alias("_known"), _open(valid_to).alias("_to"), F.coalesce(F.col(end_known).cast("long"), F.lit(OPEN_END)).alias("_to_known"))
        .withColumn("_begin", F.greatest("_from", "_known"))
        .withColumn("_stop", F.when((F.col("_to") == OPEN_END) | (F.col("_to_known") == OPEN_END), F.lit(OPEN_END)).otherwise(F.greatest("_to", "_to_known")))
        # alike but for the rank: the best stands for all
        .groupBy("_e", "_begin", "_stop")
        .agg(F.max(F.struct("_from", "_id", "_known", "_to", "_to_known")).alias("_f"))
        .filter(F.col("_stop") > F.col("_begin"))
    )
    times, known_facts = stage(times, "event-times"), stage(known_facts, "known-facts")
    # entities above slab_rows: at most all rows / slab_rows of them, so they can be broadcast
    counted = known_facts.select("_e").unionAll(times.select("_e")).groupBy("_e").agg(F.count("*").alias("_rows"))
    most, total = (n or 0 for n in counted.agg(F.max("_rows"), F.sum("_rows")).first())
    sizes = counted.filter(F.col("_rows") > slab_rows)
    cuts = max(1, -(-most // slab_rows))
    points = known_facts.select("_e", F.col("_begin").alias("_t")).unionAll(times.select("_e", "_t")).join(F.broadcast(sizes), "_e")
    quantiles = F.percentile_approx("_t", F.array(*(F.lit(i / cuts) for i in range(1, cuts + 1))), max(10_000, 10 * cuts))
    stride = F.greatest(F.lit(1), F.floor(F.lit(cuts * slab_rows) / F.col("_rows")).cast("int"))
    kept = F.array_distinct(F.filter("_q", lambda _, i: (i + 1) % F.col("_stride") == 0))
    slabs = F.broadcast(points.groupBy("_e").agg(quantiles.alias("_q"), F.first(stride).alias("_stride")).select("_e", kept.alias("_cuts")))

    def slab(x: str):
        return F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(x))), F.lit(0))

    placed = times.join(slabs, "_e", "left").select("_e", "_t", slab("_t").alias("_slab"))
    spread = known_facts.join(slabs, "_e", "left").select("*", slab("_begin").alias("_b"), F.when(F.col("_stop") == OPEN_END, F.coalesce(F.size("_cuts"), F.lit(0)) + 1).otherwise(slab("_stop")).alias("_z"), F.coalesce(F.size("_cuts"), F.lit(0)).alias("_last"))
    edges = spread.withColumn("_slab", F.explode(F.array_distinct(F.array("_b", F.least("_z", "_last"))))).filter((F.col("_slab") == F.col("_b")) | (F.col("_slab") == F.col("_z"))).select("_e", "_slab", "_f.*")
    covers = (
        spread.filter(F.col("_z") - F.col("_b") > 1)
        .groupBy("_e", "_b", "_z")
        .agg(F.max("_f").alias("_f"))
        .select("_e", F.explode(F.sequence(F.col("_b") + 1, F.col("_z") - 1)).alias("_slab"), "_f")
        .groupBy("_e", "_slab")
        .agg(F.max("_f").alias("_f"))
        .select("_e", "_slab", "_f.*")
    )
    # a shard holds about slab_rows rows, as a slab does, however many there are
    shards = max(width(spark) * 4, -(-total // slab_rows))
    shard = F.pmod(F.xxhash64("_e", "_slab"), F.lit(shards)).cast("int").alias("_shard")
    left = edges.unionByName(covers).select(shard, F.concat("_e", F.lit("#"), "_slab").alias("_e"), "_from", "_id", "_known", "_to", "_to_known")
    right = placed.select(shard, F.concat("_e", F.lit("#"), "_slab").alias("_e"), "_t")
    hits = left.groupBy("_shard").cogroup(right.groupBy("_shard")).applyInPandas(_ask, "_e string, _t long, _id long")
    answers = hits.select(F.regexp_replace("_e", "#[0-9]+$", "").alias("_e"), "_t", "_id").join(times, ["_e", "_t"])
    return lookup(asked, answers, ["_e", "_t"], "_n").select(F.col("_event").alias(event_id), F.col("_id").alias(fact_id))
