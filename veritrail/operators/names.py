"""Entity names: matching by phrase and prefix, folding of longer spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veritrail.functions.text import entity_key, phrases
from veritrail.operators.shared import stage

#: Small words inside proper names.
PARTICLES = "de da do dos das del della di van von der den la le el bin al of and".split()
PROPER = r"^(?:(?:[\p{Lu}\p{Lt}\p{Lo}][^\s,]*|(?i:" + "|".join(PARTICLES) + r"))(?:[\s,]+|$))+$"


def entity_names(facts: DataFrame) -> DataFrame:
    """corpus, norm, name: every entity that facts mention or speak of, one spelling each."""
    every = facts.select("corpus", F.explode(F.concat(F.array("subj"), F.coalesce("mentions", F.array().cast("array<string>")))).alias("name")).filter(F.col("name").isNotNull())
    return every.select("corpus", entity_key("name").alias("norm"), F.trim("name").alias("name")).filter(F.col("norm") != "").groupBy("corpus", "norm").agg(F.min("name").alias("name"))


def matched_entities(questions: DataFrame, names: DataFrame, cap: int = 12) -> DataFrame:
    """Entities a question names: step_id, norm, pass (1 exact, 2 prefix), at most ``cap`` each.

    Exact matches come first, then those of earlier phrases. The prefix match is an equi-join on
    the first four letters; shorter phrases match only whole.
    """
    asked = questions.select("step_id", "corpus", F.posexplode(phrases("question")).alias("place", "phrase"))
    norms = names.select("corpus", "norm")
    exact = asked.join(norms, (asked["corpus"] == norms["corpus"]) & (asked["phrase"] == norms["norm"])).select("step_id", "norm", F.lit(1).alias("pass"), "place")
    heads = norms.select(F.col("corpus").alias("c"), "norm", F.substring("norm", 1, 4).alias("head"))
    longer = asked.filter(F.length("phrase") >= 4).withColumn("head", F.substring("phrase", 1, 4)).join(heads, "head").filter((F.col("corpus") == F.col("c")) & F.col("norm").startswith(F.col("phrase"))).select("step_id", "norm", F.lit(2).alias("pass"), "place")
    best = exact.unionByName(longer).groupBy("step_id", "norm").agg(F.min(F.struct("pass", "place")).alias("at"))
    first = F.row_number().over(Window.partitionBy("step_id").orderBy("at", "norm"))
    return best.withColumn("n", first).filter(F.col("n") <= cap).select("step_id", "norm", "at.pass")


def folded_names(names: DataFrame, longest: int = 4, aliases: DataFrame | None = None) -> DataFrame:
    """corpus, norm, target: longer names that fold onto a shorter one nothing else competes for.

    Only between proper names of at most ``longest`` words. ``aliases`` (corpus, alias, target) are
    folds that were stated; they outrank those found. Chains are followed to their end, and what
    leads into a circle folds onto nothing.
    """
    proper = names.filter(F.col("name").rlike(PROPER)).select("corpus", "norm", F.split("norm", " ").alias("parts"))
    longer = proper.filter((F.size("parts") > 1) & (F.size("parts") <= longest)).select("corpus", "norm", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("cut"))
    heads = longer.select("corpus", "norm", "cut", F.array_join(F.slice("parts", 1, F.col("cut")), " ").alias("target"))
    known = proper.select("corpus", F.col("norm").alias("target"))
    nearest = heads.join(known, ["corpus", "target"]).groupBy("corpus", "norm").agg(F.max_by("target", "cut").alias("target"))
    links = nearest.groupBy("corpus", "target").agg(F.count("*").alias("n"), F.min("norm").alias("norm")).filter(F.col("n") == 1).select("corpus", "norm", "target")
    rounds = longest - 2  # doubling the reach of a link that leads to a shorter name
    if aliases is not None:
        said = aliases.select("corpus", entity_key("alias").alias("norm"), entity_key("target").alias("target")).filter((F.col("norm") != "") & (F.col("target") != "") & (F.col("norm") != F.col("target")))
        said = stage(said.groupBy("corpus", "norm").agg(F.min("target").alias("target")), "aliases")
        links = said.unionByName(links.join(said, ["corpus", "norm"], "left_anti"))
        rounds += said.count().bit_length() + 1
    links = stage(links, "links")
    folded = links
    for _ in range(rounds):
        then = folded.select("corpus", F.col("norm").alias("target"), F.col("target").alias("further"))
        folded = folded.join(then, ["corpus", "target"], "left").select("corpus", "norm", F.coalesce("further", "target").alias("target"))
        folded = folded if aliases is None else stage(folded, "folded")
    # an end of a chain leads nowhere itself
    return folded if aliases is None else folded.join(links.select("corpus", F.col("norm").alias("target")), ["corpus", "target"], "left_anti").select("corpus", "norm", "target")


def resolved_names(rows: DataFrame, row_id: str, names: str, aliases: DataFrame) -> DataFrame:
    """``row_id`` and its names, normalised, folded by ``aliases`` (corpus, norm, target), each once, in order of first mention.

    ``rows``: ``row_id``, corpus and the array ``names``. A row without names has none.
    """
    each = rows.select(row_id, "corpus", F.posexplode(names).alias("place", "name")).select(row_id, "corpus", "place", entity_key("name").alias("norm")).filter(F.col("norm") != "")
    folded = each.join(aliases.select("corpus", "norm", "target"), ["corpus", "norm"], "left").select(row_id, "place", F.coalesce("target", "norm").alias("norm"))
    first = folded.groupBy(row_id, "norm").agg(F.min("place").alias("place"))
    return first.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "norm"))), lambda x: x["norm"]).alias("names"))
