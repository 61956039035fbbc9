"""Turns: trust tiers, windows, chunks, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritrail.functions.text import estimated_tokens

#: Which roles speak with whose authority; any other role has none.
ROLES = {3: ("user", "human", "owner"), 2: ("assistant", "ai", "agent", "bot"), 1: ("tool", "function", "observation")}
TIERS = ("external", "tool", "assistant", "owner")
_OUTSIDE = "^(https?|shared-document|file)://"


def role_rank(role: Column, origin: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    rank = F.when(F.coalesce(origin, F.lit("")).rlike(_OUTSIDE), F.lit(0))
    for value, names in ROLES.items():
        rank = rank.when(plain.isin(*names), F.lit(value))
    return rank.otherwise(F.lit(0))


def tiered_turns(turns: DataFrame) -> DataFrame:
    """Each turn once, with its rank clamped to what its role and origin allow."""
    rank = F.least(F.coalesce(F.col("trank"), F.lit(0)), role_rank(F.col("turn_role"), F.col("origin")))
    label = F.element_at(F.array(*(F.lit(t) for t in TIERS)), F.col("rank") + 1)
    return turns.dropDuplicates(["turn_id"]).withColumn("rank", rank).select("turn_id", "corpus", "sid", "idx", F.col("rank").cast("int").alias("rank"), label.alias("tier"))


def windows(turns: DataFrame, size: int = 6, overlap: int = 2) -> DataFrame:
    """Overlapping windows over a session: corpus, sid, window, first_idx, turns, claimable.

    Windows start every ``size - overlap`` turns; a turn is claimable in the first window that
    holds it. A window without claimable turns is left out. ``idx`` places a turn, so every turn
    finds its windows by arithmetic and no session is gathered in one task.
    """
    step = size - overlap
    rows = turns.dropDuplicates(["turn_id"]).filter(F.col("idx").isNotNull()).select("corpus", "sid", "idx")
    lowest = F.greatest(F.lit(0), F.floor((F.col("idx") - size + step) / step))
    placed = rows.select("*", F.explode(F.sequence(lowest, F.floor(F.col("idx") / step))).alias("window"))
    mine = (F.col("window") == 0) | (F.col("idx") >= F.col("window") * step + overlap)
    return placed.groupBy("corpus", "sid", "window").agg(F.min("idx").cast("long").alias("first_idx"), F.count("*").alias("turns"), F.count_if(mine).alias("claimable")).filter(F.col("claimable") > 0)


def within_budget(turns: DataFrame, budget: int) -> DataFrame:
    """Newest turns first while their estimated tokens fit; too long ones are skipped, not a stop.

    Returns corpus, sid, used, kept, dropped; the newest turn is always kept. What is used only
    grows, so of turns of one cost only the newest ``budget / cost`` can be kept, and of those
    beyond the budget only the newest: at most about ``budget * ln(budget)`` turns of a session
    are folded in order, however many it has.
    """
    rows = turns.dropDuplicates(["turn_id"]).filter(F.col("idx").isNotNull()).select("corpus", "sid", (-F.col("idx")).alias("back"), "turn_id", estimated_tokens(F.coalesce("text", F.lit(""))).alias("cost"))
    level = F.least(F.col("cost"), F.lit(budget + 1))
    place = F.row_number().over(Window.partitionBy("corpus", "sid", "level").orderBy("back", "turn_id"))
    # the constant bound lets every task cut its groups before the shuffle
    newest = rows.withColumn("level", level).withColumn("n", place).filter(F.col("n") <= budget).filter(F.col("n") <= F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("level"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("kept"))

    def fold(acc: Column, t: Column) -> Column:
        fits = (acc["used"] + t["cost"] <= budget) | (acc["kept"] == 0)
        return F.struct((acc["used"] + F.when(fits, t["cost"]).otherwise(F.lit(0))).alias("used"), (acc["kept"] + fits.cast("long")).alias("kept"))

    folded = newest.groupBy("corpus", "sid").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("back", "turn_id", "cost"))), start, fold).alias("r"))
    total = rows.groupBy("corpus", "sid").agg(F.count("*").alias("all"))
    both = folded.join(total, folded["corpus"].eqNullSafe(total["corpus"]) & folded["sid"].eqNullSafe(total["sid"]))
    return both.select(folded["corpus"], folded["sid"], "r.used", "r.kept", (F.col("all") - F.col("r.kept")).alias("dropped"))


def origins(turns: DataFrame) -> DataFrame:
    """Outside sources: turns that carry them and the least rank among these."""
    return turns.dropDuplicates(["turn_id"]).filter(F.col("origin").isNotNull()).groupBy("corpus", "origin").agg(F.count("*").alias("turns"), F.min("trank").alias("rank"))
