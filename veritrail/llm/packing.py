"""Whole texts into containers of fixed capacity with little room left over.

Method: best-two-fit. A container is filled greedily with the longest text that fits; then its
shortest text is exchanged for two unpacked ones that fill the enlarged gap more tightly.

Only lengths matter for the plan, so it is made over the histogram of lengths (at most
``capacity`` rows, whatever the number of texts): equal containers are planned once with their
number. Texts then find their container by their rank among texts of equal length.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veritrail.operators.shared import HOT_ROWS, stage, width

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to this public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, row_id: str, text: str, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``row_id`` and n_tokens of every non-null text, whole."""
    kind = df.schema[row_id].dataType.simpleString()

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(ranks, pattern).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({row_id: pdf[row_id], "n_tokens": np.fromiter((len(encode(t)) for t in pdf[text]), dtype="int64", count=len(pdf))})

    return df.filter(F.col(text).isNotNull() & F.col(row_id).isNotNull()).select(row_id, text).mapInPandas(count, f"`{row_id}` {kind}, n_tokens long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Kinds of containers as (lengths in it, number of such containers), by best-two-fit."""
    left = {s: n for s, n in histogram.items() if 0 < s <= capacity and n > 0}
    sizes = sorted(left)
    out = []

    def take(size: int, by: int = 1) -> None:
        left[size] -= by
        if left[size] == 0:
            del left[size]
            sizes.pop(bisect_right(sizes, size) - 1)

    def give(size: int) -> None:
        if size not in left:
            left[size] = 0
            sizes.insert(bisect_right(sizes, size), size)
        left[size] += 1

    def best_pair(room: int, above: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the greatest sum in (above, room]."""
        low, high, best = 0, bisect_right(sizes, room) - 1, None
        while low <= high:
            total = sizes[low] + sizes[high]
            if total > room or (low == high and left[sizes[low]] < 2):
                high -= 1
                continue
            if total > above:
                above, best = total, (sizes[low], sizes[high])
                if total == room:
                    break
            low += 1
        return best

    while sizes:
        filled, room = Counter(), capacity
        while room and (at := bisect_right(sizes, room)):
            size = sizes[at - 1]
            filled[size] += 1
            room -= size
            take(size)
        while room and len(sizes):
            least = min(filled)
            pair = best_pair(room + least, least)
            if pair is None:
                break
            for size in pair:
                take(size)
                filled[size] += 1
            filled -= Counter({least: 1})
            give(least)
            room -= sum(pair) - least
        # every further container would be filled alike while its lengths last
        times = min(left.get(s, 0) // n for s, n in filled.items())
        for size, n in filled.items():
            if times:
                take(size, n * times)
        out.append((filled, times + 1))
    return out


def _places(kinds: list[tuple[Counter, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) keys, number of containers of the kind, first container."""
    used: Counter = Counter()
    rows, base = [], 0
    for filled, times in kinds:
        for size, n in filled.items():
            rows.append(((size << 40) + used[size], used[size], times, base))
            used[size] += n * times
        base += times
    rows.sort()
    table = np.array(rows, dtype="int64").reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2:]


def packed(counts: DataFrame, row_id: str, capacities: dict[int, int]) -> DataFrame:
    """Containers for all capacities: size_id, bin_id, ``row_id``, piece, first_token, n_tokens.

    ``counts``: ``row_id`` (unique) and n_tokens. A text is one piece, unless it is longer than
    the capacity: then it fills containers alone and only its rest shares one. A text of no
    tokens takes no room and has bin_id -1. ``capacities``: size_id to capacity in tokens, a
    short fixed table. A repeated ``row_id`` is packed as often as it comes.
    """
    spark = counts.sparkSession
    # a length that very many texts have is ranked in as many parts as it takes
    buckets = max(width(spark), -(-counts.count() // HOT_ROWS))
    sizes = F.explode(F.array(*(F.struct(F.lit(i).alias("size_id"), F.lit(c).cast("long").alias("capacity")) for i, c in sorted(capacities.items()))))
    each = counts.select(row_id, "n_tokens", sizes.alias("_x")).select(row_id, F.col("n_tokens").alias("_t"), "_x.*")
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("_t") / F.col("capacity"))).cast("int")
    pieces = (
        each.select("*", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece"))
        .select("size_id", row_id, "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.least(F.col("capacity"), F.col("_t") - F.col("piece") * F.col("capacity")).cast("long").alias("n_tokens"))
        .withColumn("_bucket", F.pmod(F.xxhash64(row_id, "piece"), F.lit(buckets)).cast("int"))
    )
    group = ["size_id", "n_tokens", "_bucket"]
    parts = stage(pieces.groupBy(*group).agg(F.count("*").alias("_n")), "piece-counts")
    histogram: dict[int, dict[int, int]] = {i: {} for i in capacities}
    for row in parts.groupBy("size_id", "n_tokens").agg(F.sum("_n").alias("n")).collect():  # at most the sum of capacities
        histogram[row["size_id"]][row["n_tokens"]] = row["n"]
    held = spark.sparkContext.broadcast({i: _places(plan(h, capacities[i])) for i, h in histogram.items()})

    from pyspark.sql import Window

    before = Window.partitionBy("size_id", "n_tokens").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = pieces.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(row_id, "piece"))).join(offsets, group)

    @F.pandas_udf("long")
    def container(size_id: pd.Series, tokens: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.full(len(rank), -1, dtype="int64")
        for i, (keys, first, kind) in held.value.items():
            rows = np.flatnonzero((size_id.to_numpy() == i) & (tokens.to_numpy() > 0))
            if len(rows):
                r = rank.to_numpy()[rows]
                at = np.searchsorted(keys, (tokens.to_numpy()[rows] << 40) + r, side="right") - 1
                out[rows] = kind[at, 1] + (r - first[at]) % kind[at, 0]
        return pd.Series(out)

    rank = F.col("_r") - 1 + F.col("_offset")
    return ranked.select("size_id", container("size_id", "n_tokens", rank).alias("bin_id"), row_id, "piece", "first_token", "n_tokens")


def packing_report(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per capacity: containers used, unused tokens, pieces, and the least possible containers."""
    used = placed.filter(F.col("bin_id") >= 0).groupBy("size_id", "bin_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    return (
        used.groupBy("size_id").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum("k").alias("pieces"))
        .join(sizes.select("size_id", F.col("capacity").cast("long").alias("capacity")), "size_id")
        .select("size_id", "capacity", "containers", (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused_tokens"), "pieces", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))
    )
