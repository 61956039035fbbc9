"""Scorecards, judging without a model, apportionment and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritrail.functions.text import declines, plain_answer


def rate(hits: Column, of: Column) -> Column:
    """A rounded share; null where nothing could count."""
    return F.round(F.when(of > 0, hits / of), 4)


def scorecard(records: DataFrame, by: str) -> DataFrame:
    """Per system: accuracy on answerable questions only, abstention recall and precision,
    hallucination and over-refusal rates, mean latency.

    ``records``: ``by``, is_abstention, abstained, correct (BOOLEAN), latency_ms.
    """
    off, said_no, right = F.col("is_abstention"), F.col("abstained"), F.col("correct")
    count = F.count_if
    sums = records.groupBy(by).agg(
        F.count("*").alias("n"), count(~off).alias("answerable"), count(off).alias("abstention_items"), count(~off & right).alias("right"), count(said_no).alias("declined"),
        count(off & said_no).alias("rightly_declined"), count(off & ~said_no & ~right).alias("invented"), count(~off & said_no).alias("refused"), F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))).alias("latency"),
    )
    return sums.select(
        by, "n", "answerable", "abstention_items", rate(F.col("right"), F.col("answerable")).alias("accuracy"), rate(F.col("rightly_declined"), F.col("abstention_items")).alias("abstention_recall"),
        rate(F.col("rightly_declined"), F.col("declined")).alias("abstention_precision"), rate(F.col("invented"), F.col("abstention_items")).alias("hallucination_rate"), rate(F.col("refused"), F.col("answerable")).alias("over_refusal_rate"),
        F.round("latency", 1).alias("mean_latency_ms"),
    )


#: What stands between the alternatives of a gold answer; those of several characters need space.
SEPARATORS = ("; ", " or ", " / ", "/", ". ", ";", ", which ", ", also ")


def alternatives(gold: Column | str) -> Column:
    """The whole gold answer, then each part that could stand as an answer."""
    whole = F.trim(F.coalesce(gold, F.lit("")))
    cut = whole
    for mark in SEPARATORS:
        cut = F.replace(cut, F.lit(mark), F.lit("\u001f"))
    parts = F.transform(F.split(cut, "\u001f"), lambda p: F.btrim(p, F.lit(" .")))
    return F.filter(F.array_distinct(F.concat(F.array(whole), parts)), lambda a: a != "")


def numbers(text: Column) -> Column:
    """The distinct numbers of a text, grouping commas dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(-?\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, ",", "").cast("double")))


_MONTHS = "january february march april may june july august september october november december".split()


def dates(text: Column) -> Column:
    """The distinct dates of a text as year-month-day (the year may be missing), and its years."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(1))
    two = lambda x: F.lpad(x, 2, "0")
    months = F.array(*(F.lit(m) for m in _MONTHS))

    def named(x: Column) -> Column:
        at = F.array_position(F.transform(months, lambda m: F.startswith(x, m)), F.lit(True)).cast("string")
        return F.concat(F.regexp_extract(x, r"(\d{4})$", 1), F.lit("-"), two(at), F.lit("-"), two(F.regexp_extract(x, r"^[a-z]+\s+(\d{1,2})", 1)))

    parts = lambda x: F.split(x, "[-/]")
    year_first = lambda x: F.concat(parts(x)[0], F.lit("-"), two(parts(x)[1]), F.lit("-"), two(parts(x)[2]))
    year_last = lambda x: F.concat(parts(x)[2], F.lit("-"), two(parts(x)[0]), F.lit("-"), two(parts(x)[1]))
    found = F.concat(
        F.transform(every(rf"\b((?:{'|'.join(_MONTHS)})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?)\b"), named),
        F.transform(every(r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"), year_first), F.transform(every(r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b"), year_last), every(r"\b((?:19|20)\d{2})\b"),
    )
    return F.array_distinct(found)


def judged(records: DataFrame, gold: str, prediction: str, unanswerable: str | None = None, judge=None) -> DataFrame:
    """Adds ``correct`` and ``why``, the first that fits of: the answer declines, it contains a
    gold alternative, it agrees with the numbers and dates of one, it has 85 % of the words of one.

    ``unanswerable``: a BOOLEAN column; where it is true, declining is correct and nothing else is.
    ``judge``: a caller's function of the columns (gold, prediction) to a BOOLEAN column, for a
    judge with a model; its null leaves the decision to these rules.
    """
    parts = F.transform(alternatives(F.col(gold)), lambda a: F.struct(plain_answer(a).alias("t"), numbers(a).alias("n"), dates(a).alias("d")))
    plain = records.withColumn("_alts", parts).withColumn("_got", plain_answer(prediction)).withColumn("_nums", numbers(F.col(prediction))).withColumn("_dates", dates(F.col(prediction)))
    got, words = F.col("_got"), F.split("_got", " ")
    some = lambda test: F.exists("_alts", lambda a: (a["t"] != "") & test(a))
    contained = some(lambda a: got.contains(a["t"]))
    agree = some(lambda a: (F.size(a["n"]) + F.size(a["d"]) > 0) & ((F.size(a["n"]) == 0) | (F.size(F.array_except(a["n"], F.col("_nums"))) == 0)) & ((F.size(a["d"]) == 0) | F.arrays_overlap(a["d"], F.col("_dates"))))
    overlap = some(lambda a: F.size(F.array_intersect(F.array_distinct(F.split(a["t"], " ")), words)) / F.size(F.array_distinct(F.split(a["t"], " "))) >= 0.85)
    why = F.when(declines(prediction), "declined").when(contained, "contained").when(agree, "numbers").when(overlap, "overlap").otherwise("no match")
    right = F.col("why").isin("contained", "numbers", "overlap")
    if unanswerable is not None:
        right = F.when(F.coalesce(F.col(unanswerable), F.lit(False)), F.col("why") == "declined").otherwise(right)
    if judge is not None:
        right = F.coalesce(judge(F.col(gold), F.col(prediction)), right)
    return plain.withColumn("why", why).withColumn("correct", right).drop("_alts", "_got", "_nums", "_dates")


def quotas(weights: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``total`` places shared out in proportion to ``n`` by largest remainders (ties by key)."""
    # one row per key: the number of keys is that of a category
    exact = F.lit(total) * F.col(n) / F.col("_pool")
    pooled = weights.withColumn("_pool", F.sum(n).over(Window.partitionBy()))
    parts = pooled.withColumn("_base", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 12))
    order = Window.orderBy(F.desc("_rest"), key)
    ranked = parts.withColumn("_i", F.row_number().over(order)).withColumn("_left", F.lit(total) - F.sum("_base").over(Window.partitionBy()))
    return ranked.select(key, n, F.least(F.col(n), F.col("_base") + (F.col("_i") <= F.col("_left")).cast("long")).alias("quota"))


def stratified(rows: DataFrame, row_id: str, key: str, total: int, seed: int = 0) -> DataFrame:
    """A deterministic sample of about ``total`` rows that keeps the shares of ``key``.

    Within a key the rows with the smallest hashes are taken. Hashes are bucketed, so that only
    the buckets a quota needs are ranked: no key is sorted in one task.
    """
    hashed = rows.select(row_id, key, F.md5(F.concat_ws(":", F.lit(seed), F.col(row_id).cast("string"))).alias("_h")).withColumn("_b", F.substring("_h", 1, 4))
    per_bucket = hashed.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    share = quotas(per_bucket.groupBy(key).agg(F.sum("_n").alias("n")), key, "n", total)
    needed = per_bucket.withColumn("_before", F.coalesce(upto, F.lit(0))).join(share.select(key, "quota"), key).filter(F.col("_before") < F.col("quota"))
    ranked = hashed.join(needed, [key, "_b"]).withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(key, "_b").orderBy("_h", row_id)))
    return ranked.filter(F.col("_r") <= F.col("quota")).select(row_id, key)


def sampled(rows: DataFrame, row_id: str, key: str, off: str, total: int, least: int = 8, most_share: float = 0.3, seed: int = 0) -> DataFrame:
    """A deterministic sample of ``total`` rows that never loses the unanswerable ones: ``row_id``, ``key``, ``off``.

    Rows with ``off`` get their true share of the places, at least ``least`` (which counts for at
    most ``most_share`` of the sample); the other places go to the other rows in proportion to
    ``key``. Too few rows of a kind leave places empty. Up to ``total`` rows are all taken.
    """
    part = rows.select(row_id, F.coalesce(key, F.lit("")).alias(key), F.coalesce(off, F.lit(False)).alias(off))
    n, n_off = part.agg(F.count("*"), F.count_if(off)).first()
    if n <= total:
        return part
    floor = min(least, max(1, int(total * most_share)))
    places = min(n_off, max(floor, int(total * n_off / n + 0.5)), total)
    declined = stratified(part.filter(off).withColumn("_one", F.lit("")), row_id, "_one", places, seed).select(row_id)
    asked = stratified(part.filter(~F.col(off)), row_id, key, total - places, seed).select(row_id)
    return part.join(declined.unionByName(asked), row_id, "left_semi")
