"""The gate between a reply and an answer: checks in a fixed order, citations, explanation.

A reply is one row; every check is a predicate over it, the first that fails names the reason. A
model, where one is used, comes in as columns: its reply, and its verdict on each citation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritrail.functions.text import let, plain_answer

#: The checks in their order, and the reason that a failed one gives.
CHECKS = (
    ("warrant_nonempty", "no-evidence"), ("model_available", "model-unavailable"), ("response_json", "malformed-response"), ("response_schema", "malformed-response"), ("sufficient", "insufficient-evidence"), ("citations_present", "no-citations"),
    ("citations_in_warrant", "invented-citation"), ("answer_text", "malformed-response"), ("answer_not_refusal", "insufficient-evidence"), ("citations_supported", "unverified-citation"), ("citations_relevant", "unverified-citation"),
)
#: How a provider may fail; each stands in the trail of checks and means no model.
PROVIDER_FAILURES = ("provider_unavailable", "provider_timeout", "provider_error")
#: What an abstention says about the check that failed.
MISSING = {
    "warrant_nonempty": "nothing that is stored comes near the question.", "model_available": "no model was there to read them, and none of them decides the question alone.", "response_json": "the reply could not be read, so it was dropped.",
    "response_schema": "the reply lacked a part, so it was dropped.", "sufficient": "none of them says what was asked.", "citations_present": "no answer could be tied to one of them.", "citations_in_warrant": "the reply leaned on something that memory does not hold, so it was dropped.",
    "answer_text": "the reply held no answer.", "answer_not_refusal": "none of them says what was asked.", "citations_supported": "what was cited does not carry the answer, so it was dropped.", "citations_relevant": "what was cited had no part in the answer, so it was dropped.",
}

_UNABLE = ("do not", "dont", "cannot", "cant", "can not", "am unable to", "am not able to")
_KNOW = ("know", "say", "tell", "find", "answer", "determine", "have")
_EVIDENCE = ("information", "record", "evidence", "memory", "idea")
#: Openings of an answer that is none: a mind that cannot tell, or evidence that is not there.
OPENINGS = tuple(
    [f"i {u} {k}" for u in _UNABLE for k in _KNOW] + [f"i have no {e}" for e in _EVIDENCE] + [f"there is no {e}" for e in _EVIDENCE[:3]] + [f"no {e} {x}" for e in _EVIDENCE[:3] for x in ("is available", "is found", "available", "found")]
    + [f"{t}{e} {x}" for t in ("", "the ") for e in ("warrant", "memory", "evidence") for x in ("is insufficient", "is sufficient", "insufficient", "sufficient")] + ["insufficient evidence", "unable to answer", "unable to determine"]
)


def refuses(answer: Column) -> Column:
    """Whether an answer opens by declining; what it says later does not count."""
    low = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(answer, F.lit("")))), "['’]", ""), r"\s+", " ")

    def opens(text: Column) -> Column:
        out = F.lit(False)
        for o in OPENINGS:
            out = out | F.startswith(F.concat(text, F.lit(" ")), F.lit(o + " ")) | F.startswith(text, F.lit(o + ".")) | F.startswith(text, F.lit(o + ","))
        return out

    return let(low, opens)


def cited_ids(citations: Column) -> Column:
    """Citations of a reply (a JSON array of anything) as distinct ids in order; what is no id is dropped."""
    raw = F.transform(F.coalesce(F.from_json(citations, "array<string>"), F.array().cast("array<string>")), lambda c: F.trim(c).try_cast("bigint"))
    return F.array_distinct(F.filter(raw, lambda c: c.isNotNull()))


def decided(replies: DataFrame, warrants: DataFrame, supports: DataFrame | None = None, quotable: DataFrame | None = None) -> DataFrame:
    """One verdict per reply: id, answered, answer, citations, failed_check, abstained_because, checks, verified, kind.

    ``replies``: id, provider (null, or one of ``PROVIDER_FAILURES``, or "none"), reply (JSON text).
    ``warrants``: id, fact_id, the evidence that may be cited. ``supports``: id, fact_id, supports
    (BOOLEAN), reason: a verdict on each citation; without this table citations are not verified.
    A citation without a clear yes is dropped; an answer that has none left is refused. A reply of
    kind "grounded" need not be sufficient and is checked for relevance instead. ``quotable``: id,
    fact_id, text: evidence that may be quoted where no model is there.
    """
    held = warrants.select("id", "fact_id").distinct()
    keys = F.json_object_keys("reply")
    fields = F.from_json("reply", "answer string, sufficient boolean, kind string, citations string")
    read = replies.dropDuplicates(["id"]).select("id", "provider", keys.alias("keys"), fields.alias("f")).withColumn("cited", cited_ids(F.col("f.citations"))).withColumn("grounded", F.lower(F.trim(F.coalesce("f.kind", F.lit("")))) == "grounded")
    counts = held.groupBy("id").agg(F.count("*").alias("evidence"))
    each = read.select("id", F.posexplode("cited").alias("place", "fact_id")).join(held.withColumn("in_warrant", F.lit(True)), ["id", "fact_id"], "left")
    if supports is not None:
        each = each.join(supports.select("id", "fact_id", "supports", "reason").dropDuplicates(["id", "fact_id"]), ["id", "fact_id"], "left")
    else:
        each = each.withColumns({"supports": F.lit(True), "reason": F.lit(None).cast("string")})
    good = F.coalesce("supports", F.lit(False))
    marks = F.array_sort(F.collect_list(F.struct("place", "fact_id", good.alias("good"), F.coalesce("reason", F.lit("not verified")).alias("reason"))))
    cited = each.groupBy("id").agg(F.count_if(F.col("in_warrant").isNull()).alias("invented"), marks.alias("marks"))
    rows = read.join(counts, "id", "left").join(cited, "id", "left")
    if quotable is not None:
        rows = rows.join(quotable.groupBy("id").agg(F.min(F.struct("fact_id", "text")).alias("quote")), "id", "left")
    else:
        rows = rows.withColumn("quote", F.lit(None).cast("struct<fact_id:bigint,text:string>"))

    no_model = F.col("provider") == "none"
    failure = F.when(F.col("provider").isin(*PROVIDER_FAILURES), F.col("provider"))
    schema = F.array_contains("keys", "answer") & F.array_contains("keys", "citations") & F.array_contains("keys", "sufficient")
    survivors = F.transform(F.filter("marks", lambda m: m["good"]), lambda m: m["fact_id"])
    last = F.when(F.col("grounded"), "citations_relevant").otherwise("citations_supported")
    failed = (
        F.when(F.coalesce("evidence", F.lit(0)) == 0, "warrant_nonempty").when(F.coalesce(no_model, F.lit(False)), "model_available").when(failure.isNotNull(), failure).when(F.col("keys").isNull(), "response_json").when(~schema, "response_schema")
        .when(~F.coalesce("f.sufficient", F.lit(False)) & ~F.col("grounded"), "sufficient").when(F.size("cited") == 0, "citations_present").when(F.col("invented") > 0, "citations_in_warrant")
        .when(F.trim(F.coalesce("f.answer", F.lit(""))) == "", "answer_text").when(refuses(F.col("f.answer")), "answer_not_refusal").when(F.size(survivors) == 0, last)
    )
    judged = rows.withColumn("failed", failed).withColumn("quoted", F.col("failed").isin("model_available", "provider_unavailable"))
    names = [n for n, _ in CHECKS[:9]]
    order = F.array(*(F.lit(n) for n in names))
    # the trail holds every check up to the one that failed; a provider fails while its reply is awaited
    upto = F.when(F.col("failed").isin(*PROVIDER_FAILURES), F.lit(3)).otherwise(F.coalesce(F.nullif(F.array_position(order, F.col("failed")), F.lit(0)), F.lit(9))).cast("int")
    late = F.col("failed").isNull() | F.col("failed").isin("citations_supported", "citations_relevant")
    dropped = F.transform(F.filter("marks", lambda m: ~m["good"]), lambda m: F.concat(last, F.lit(":dropped:"), m["fact_id"].cast("string"), F.lit(":"), F.substring(F.replace(m["reason"], F.lit(","), F.lit(";")), 1, 80)))
    verified = supports is not None
    tail = F.concat(F.array(last), dropped, F.when(F.col("failed").isNull() & F.col("grounded"), F.array(F.lit("grounded_answer"))).otherwise(F.array().cast("array<string>"))) if verified else F.when(F.col("grounded"), F.array(F.lit("grounded_answer"))).otherwise(F.array().cast("array<string>"))
    trail = F.concat(F.slice(order, 1, upto), F.when(F.col("failed").isin(*PROVIDER_FAILURES), F.array("failed")).when(late, tail).otherwise(F.array().cast("array<string>")), F.when(F.col("quoted"), F.array(F.lit("extractive_answer"))).otherwise(F.array().cast("array<string>")))
    by_quote = F.col("quoted") & F.col("quote").isNotNull()
    answered = F.coalesce(F.col("failed").isNull() | by_quote, F.lit(False))
    reasons = F.create_map(*(F.lit(x) for pair in CHECKS for x in pair))
    because = F.when(answered, "").otherwise(F.coalesce(reasons[F.col("failed")], F.lit("model-unavailable")))
    none = F.array().cast("array<bigint>")
    return judged.select(
        "id", answered.alias("answered"), F.when(by_quote, F.col("quote.text")).when(answered, F.trim("f.answer")).alias("answer"), F.when(by_quote, F.array("quote.fact_id")).when(answered, survivors).otherwise(none).alias("citations"),
        F.when(answered, None).otherwise(F.col("failed")).alias("failed_check"), because.alias("abstained_because"), trail.alias("checks"), F.when(answered & ~by_quote & F.lit(verified), F.size(survivors)).otherwise(0).alias("verified"), F.when(answered, F.when(by_quote, "extractive").when(F.col("grounded"), "grounded").otherwise("recall")).otherwise("").alias("kind"),
    )


def carried(citations: DataFrame, facts: DataFrame) -> DataFrame:
    """A verdict without a model on each citation: id, fact_id, supports, reason.

    ``citations``: id, fact_id, answer. A fact carries a part of an answer that states its object.
    """
    said = facts.dropDuplicates(["fact_id"]).select("fact_id", plain_answer("obj").alias("o"))
    rows = citations.select("id", "fact_id", plain_answer("answer").alias("a")).distinct().join(said, "fact_id", "left")
    holds = F.coalesce((F.col("o") != "") & F.contains(F.concat(F.lit(" "), F.col("a"), F.lit(" ")), F.concat(F.lit(" "), F.col("o"), F.lit(" "))), F.lit(False))
    return rows.select("id", "fact_id", holds.alias("supports"), F.when(F.col("o").isNull(), "no such fact").when(~holds, "does not state it").otherwise("states it").alias("reason"))


def abstentions(verdicts: DataFrame, searched: DataFrame, warrants: DataFrame) -> DataFrame:
    """What is said instead of an answer: id, text. ``searched``: id, terms (ARRAY), refused (held-back items seen)."""
    found = warrants.select("id", "fact_id").distinct().groupBy("id").agg(F.count("*").alias("found"))
    rows = verdicts.filter(~F.col("answered")).select("id", "failed_check").join(searched, "id", "left").join(found, "id", "left")
    n, refused = F.coalesce("found", F.lit(0)), F.coalesce("refused", F.lit(0))
    terms = F.array_join(F.transform(F.slice(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != "")), 1, 3), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ")
    lacks = F.create_map(*(F.lit(x) for pair in MISSING.items() for x in pair))
    why = F.coalesce(lacks[F.col("failed_check")], F.lit("the answering step failed."))
    first = F.concat(F.lit("Memory does not hold enough to answer that. Searched for "), F.when(terms == "", "the words of the question").otherwise(terms), F.lit(": "), n.cast("string"), F.when(n == 1, " related fact; ").otherwise(" related facts; "), why)
    seen = F.when(refused > 0, F.concat(F.lit(" Left out as not trusted: "), refused.cast("string"), F.lit(".")))
    return rows.select("id", F.concat(first, F.coalesce(seen, F.lit("")), F.lit(" Say it once and it will be kept.")).alias("text"))


def explained_citations(verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per verdict and fact of its warrant: id, fact_id, cited, score, hops, chain, reads (the fact's period).

    ``evidence``: id, fact_id, score, hops, chain, vfrom, vto. What was considered and not cited
    comes with ``cited`` false.
    """
    used = verdicts.select("id", F.explode("citations").alias("fact_id")).distinct().withColumn("cited", F.lit(True))
    stamp = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, "unknown").otherwise(F.concat(F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm"), F.lit(" UTC")))
    ends = F.when(F.coalesce("vto", F.lit(0)) == 0, "open").otherwise(stamp(F.col("vto")))
    rows = verdicts.select("id").join(evidence, "id").join(used, ["id", "fact_id"], "left")
    return rows.select("id", "fact_id", F.coalesce("cited", F.lit(False)).alias("cited"), "score", "hops", "chain", F.concat(stamp(F.col("vfrom")), F.lit(" to "), ends).alias("reads"))
