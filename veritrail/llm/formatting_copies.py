"""Records that are the same but for their formatting.

Method: every (field name, normalised value) pair is hashed, the hashes are combined by addition,
which is commutative (a multiset hash), so field order never matters. Rows are grouped by that
fingerprint and the fields are then compared with those of the group's first record; rows that
differ from it (a collision) are grouped by their fields. Aggregates and joins hash; nothing is
sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritrail.operators.shared import HOT_ROWS, stage

FIELDS = ("subject", "predicate", "object", "text")


def read_fields(payload: str, fields: tuple[str, ...] = FIELDS) -> list[Column]:
    """Each field of a JSON object or of lines ``name: value``; null where it is not given."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    parsed = F.from_json(payload, schema)
    is_json = F.ltrim(F.col(payload)).startswith("{")
    names = "|".join(fields)
    line = lambda f: F.nullif(F.regexp_extract(payload, rf"(?is)(?:^|\R)\h*{f}\h*:(.*?)(?=\R\h*(?:{names})\h*:|\z)", 1), F.lit(""))
    return [F.when(is_json, parsed[f]).otherwise(line(f)) for f in fields]


def letters_and_digits(value: Column) -> Column:
    """Letters, their marks and digits in order, without case; null counts as empty."""
    return F.regexp_replace(F.lower(F.upper(F.coalesce(value, F.lit("")))), r"[^\p{L}\p{M}\p{N}]+", "")


def formatting_copies(df: DataFrame, row_id: str, scope: str, payload: str, fields: tuple[str, ...] = FIELDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each copy beside the smallest ``row_id`` of its set: keep_id, copy_id.

    The record that is kept is no copy and has no row, nor has a record without copies. Sets lie
    within one ``scope`` (null is a scope of its own). A payload without any letter or digit in its
    fields (null, empty or unreadable ones among them) is the copy of its likes only if the whole
    payloads agree in letters and digits. Rows with a null id are left out; a row delivered twice
    is one record.

    A set of more than ``hot_rows`` rows is spread over several tasks, to each of which its first
    record is sent; such sets number at most rows / ``hot_rows``, and only their fingerprint and
    smallest id are broadcast.
    """
    values = [letters_and_digits(v) for v in read_fields(payload, fields)]
    named = [f"_f{i}" for i in range(len(fields))]
    rows = df.filter(F.col(row_id).isNotNull()).select(F.col(row_id).alias("copy_id"), F.coalesce(F.concat(F.lit("="), scope), F.lit("")).alias("_scope"), *(v.alias(n) for v, n in zip(values, named)), letters_and_digits(F.col(payload)).alias("_all"))
    void = F.concat(*named) == ""
    rows = rows.select("copy_id", "_scope", *named, F.when(void, F.col("_all")).otherwise(F.lit("")).alias("_rest"))
    parts = [*zip(fields, named), ("", "_rest"), ("scope", "_scope")]
    # two independent sums of 60-bit hashes; the shift keeps their total inside a long
    total = lambda seed: sum((F.shiftright(F.xxhash64(F.lit(seed), F.lit(f), n), 4) for f, n in parts), F.lit(0).cast("long"))
    same, keys = ["_scope", *named, "_rest"], ["_h1", "_h2"]
    marked = stage(rows.select("copy_id", *same, total(11).alias("_h1"), total(23).alias("_h2")), "fingerprints")
    sets = stage(marked.groupBy(*keys).agg(F.min("copy_id").alias("keep_id"), F.max("copy_id").alias("_last"), F.count("*").alias("_n")).filter(F.col("keep_id") < F.col("_last")).drop("_last"), "sets")
    hot = F.broadcast(sets.filter(F.col("_n") > hot_rows).withColumn("_parts", F.ceil(F.col("_n") / hot_rows).cast("int")).drop("_n"))
    cold = sets.filter(F.col("_n") <= hot_rows).drop("_n")
    # both joins of a cold set use one exchange of the rows; its first record stays where it is
    placed = marked.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    kept = lambda found: found.filter(F.col("copy_id") == F.col("keep_id")).select(*keys, "keep_id", F.struct(*same).alias("_first")).distinct()
    few = placed.join(kept(placed.join(cold.hint("shuffle_hash"), keys)).hint("shuffle_hash"), keys).select("copy_id", "keep_id", *same, "_first")
    spread = marked.join(hot, keys)
    sent = kept(spread).join(hot.select(*keys, "_parts"), keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "keep_id")
    many = spread.withColumn("_part", F.pmod(F.xxhash64("copy_id"), F.col("_parts")).cast("int")).join(sent.hint("shuffle_hash"), [*keys, "_part"]).select("copy_id", "keep_id", *same, "_first")
    equal = F.lit(True)
    for s in same:
        equal = equal & (F.col(s) == F.col(f"_first.{s}"))
    # written once; the fields go along only where the fingerprints collide, a few rows in 2^60
    compared = few.unionByName(many).select("copy_id", F.when(equal, F.col("keep_id")).alias("keep_id"), *(F.when(~equal, F.col(s)).alias(s) for s in same))
    checked = stage(compared, "compared")
    odd = checked.filter(F.col("keep_id").isNull()).drop("keep_id")
    odd_first = odd.groupBy(*same).agg(F.min("copy_id").alias("keep_id"))
    rest = odd.join(odd_first.hint("shuffle_hash"), same).select("keep_id", "copy_id")
    found = checked.filter(F.col("keep_id").isNotNull()).select("keep_id", "copy_id").unionByName(rest)
    return found.filter(F.col("keep_id") < F.col("copy_id")).distinct()


def copy_counts(rows: DataFrame, row_id: str, pairs: DataFrame) -> DataFrame:
    """One row per set of ``rows``, sets of one record among them: keep_id, copies (itself included).

    ``pairs``: what ``formatting_copies`` found in ``rows``. A row delivered twice counts once.
    """
    ids = rows.filter(F.col(row_id).isNotNull()).select(F.col(row_id).alias("copy_id")).distinct()
    return ids.join(pairs, "copy_id", "left").groupBy(F.coalesce("keep_id", "copy_id").alias("keep_id")).agg(F.count("*").alias("copies"))
