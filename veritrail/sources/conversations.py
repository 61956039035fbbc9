"""Readers of conversation files and sinks for results.

Every schema is explicit; a file that does not fit it fails or loses the row, it is never guessed.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritrail.operators.conversation import TIERS, role_rank

_TURN = "role STRING, text STRING, origin STRING, ts BIGINT"
CORPUS = f"corpus STRING, principal STRING, description STRING, sessions ARRAY<STRUCT<sid: STRING, date: STRING, title: STRING, turns: ARRAY<STRUCT<{_TURN.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT')}>>>>"
HAYSTACK = (
    "question_id STRING, question_type STRING, question STRING, answer STRING, question_date STRING, answer_session_ids ARRAY<STRING>, haystack_dates ARRAY<STRING>, "
    "haystack_session_ids ARRAY<STRING>, haystack_sessions ARRAY<ARRAY<STRUCT<role: STRING, content: STRING, has_answer: BOOLEAN>>>"
)
#: Seconds between turns that carry no time of their own.
SPACING = 60


def iso_seconds(text: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text))


def slashed_seconds(text: Column) -> Column:
    """``2023/05/30 (Tue) 23:40`` as UTC seconds."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"\(.*?\)", ""), r"\s+", " "))
    return F.unix_seconds(F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp(plain, F.lit("yyyy/MM/dd"))))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus file (sessions with turns) as one row per turn with its place, time and rank."""
    whole = spark.read.schema(CORPUS).option("multiLine", True).json(path)
    sessions = whole.select("corpus", "principal", F.posexplode("sessions").alias("sidx", "s"))
    turns = sessions.select("corpus", "principal", "sidx", F.col("s.sid").alias("sid"), F.col("s.title").alias("title"), iso_seconds(F.col("s.date")).alias("session_ts"), F.posexplode("s.turns").alias("idx", "t"))
    ts = F.coalesce(F.nullif(F.col("t.ts"), F.lit(0)), F.col("session_ts") + SPACING * F.col("idx"))
    rank = role_rank(F.col("t.role"), F.col("t.origin"))
    return turns.select("corpus", "principal", "sid", "sidx", "title", "idx", F.col("t.role").alias("turn_role"), F.col("t.text").alias("text"), ts.alias("ts"), F.col("t.origin").alias("origin"), rank.alias("trank"), F.element_at(F.array(*(F.lit(t) for t in TIERS)), rank + 1).alias("tier"))


def read_haystacks(spark: SparkSession, path: str) -> DataFrame:
    """Questions with three parallel arrays of sessions: one row per session; ``place`` counts from the oldest.

    Arrays of unequal length are an error. A question whose id ends in ``_abs`` has no answer.
    """
    raw = spark.read.schema(HAYSTACK).option("multiLine", True).json(path)
    sizes = (F.size("haystack_dates") == F.size("haystack_session_ids")) & (F.size("haystack_dates") == F.size("haystack_sessions"))
    checked = raw.withColumn("ok", F.assert_true(sizes, F.lit("haystack arrays differ in length"))).filter(F.col("ok").isNull())
    zipped = F.arrays_zip(F.col("haystack_dates").alias("date"), F.col("haystack_session_ids").alias("sid"), F.col("haystack_sessions").alias("turns"))
    each = checked.select("question_id", "question_type", "question", "answer", "question_date", F.col("question_id").endswith("_abs").alias("is_abstention"), "answer_session_ids", F.posexplode(zipped).alias("position", "s"))
    gold = F.array_contains("answer_session_ids", F.col("s.sid"))
    flat = each.select("question_id", "question_type", "question", "answer", "is_abstention", F.col("s.sid").alias("sid"), slashed_seconds(F.col("s.date")).alias("ts"), F.coalesce(gold, F.lit(False)).alias("gold"), F.col("s.turns").alias("turns"), "position")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("ts", "position")) - 1
    return flat.withColumn("place", place).drop("position")


def literal_json(values: Column) -> Column:
    """A Python literal as JSON; null where it is none."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(ast.literal_eval(text))
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None

        return texts.map(one, na_action="ignore")

    return convert(values)


def salvaged_json(values: Column) -> Column:
    """The outermost balanced object of a model's reply, fences and chatter dropped; null if none."""

    def outermost(text: str) -> str | None:
        start = text.find("{")
        while start >= 0:
            depth, quoted, skip = 0, False, False
            for i in range(start, len(text)):
                c = text[i]
                if skip:
                    skip = False
                elif c == "\\":
                    skip = quoted
                elif c == '"':
                    quoted = not quoted
                elif not quoted and c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        try:
                            json.loads(text[start : i + 1])
                            return text[start : i + 1]
                        except ValueError:
                            break
            start = text.find("{", start + 1)
        return None

    @F.pandas_udf("string")
    def salvage(texts: pd.Series) -> pd.Series:
        return texts.map(outermost, na_action="ignore")

    return salvage(values)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table whose ``probing_questions`` hold a Python literal: kind and question."""
    rows = spark.read.parquet(path).select(literal_json(F.col("probing_questions")).alias("q"))
    entry = "map<string, array<struct<question: string, answer: string, difficulty: string>>>"
    return rows.select(F.explode(F.from_json("q", entry)).alias("kind", "qs")).select("kind", F.explode("qs").alias("p")).select("kind", "p.question", "p.answer")


def append_records(records: DataFrame, path: str, keys: list[str]) -> None:
    """Append JSON lines that are not there yet (by ``keys``); a torn last line is ignored."""
    spark = records.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        held = spark.read.schema(records.schema).option("mode", "DROPMALFORMED").json(path)
        records = records.join(held.select(*keys), keys, "left_anti")
    records.write.mode("append").json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of sessions in any of three dresses: one row per turn, as ``read_corpus`` has them.

    A session is an object with sid or id, ts and turns, or only a list of turns. A turn without a
    role is the user's, one without a place takes its position, one without a time follows its
    session's by a minute a turn; a declared tier never exceeds what role and origin allow.
    """
    turn = "struct<sid: string, role: string, text: string, origin: string, tier: string, ts: bigint, idx: int>"
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("line"))
    bare = F.ltrim("value").startswith("[")
    whole = F.from_json("value", f"struct<sid: string, id: string, ts: bigint, turns: array<{turn}>>")
    listed = F.from_json("value", f"array<{turn}>")
    # lines are numbered in the order of the files; the numbers only name sessions that have no name
    read = lines.select("line", bare.alias("bare"), whole.alias("s"), F.when(bare, listed).otherwise(whole["turns"]).alias("turns"))
    first = F.try_element_at("turns", F.lit(1))
    named = F.coalesce(F.nullif(F.when(F.col("bare"), first["sid"]).otherwise(F.coalesce("s.sid", "s.id")), F.lit("")), F.concat(F.lit("s"), F.col("line").cast("string")))
    began = F.coalesce(F.nullif(F.when(F.col("bare"), first["ts"]).otherwise(F.col("s.ts")), F.lit(0)), F.lit(0))
    each = read.select(named.alias("sid"), began.alias("session_ts"), F.posexplode("turns").alias("position", "t"))
    role = F.coalesce(F.nullif(F.col("t.role"), F.lit("")), F.lit("user"))
    allowed = role_rank(role, F.col("t.origin"))
    declared = F.array_position(F.array(*(F.lit(x) for x in TIERS)), F.lower(F.trim("t.tier"))) - 1
    rank = F.least(allowed, F.when(declared >= 0, declared).otherwise(allowed)).cast("int")
    ts = F.coalesce(F.nullif(F.col("t.ts"), F.lit(0)), F.when(F.col("session_ts") > 0, F.col("session_ts") + SPACING * F.col("position")), F.lit(0))
    return each.select("sid", F.coalesce("t.idx", "position").alias("idx"), role.alias("turn_role"), F.coalesce("t.text", F.lit("")).alias("text"), ts.alias("ts"), F.col("t.origin").alias("origin"), rank.alias("trank"), F.element_at(F.array(*(F.lit(x) for x in TIERS)), rank + 1).alias("tier"))


#: Sessions of a trajectory file have no times: they start here and follow one another by an hour.
FIRST_SECOND, HOUR = 1_767_225_600, 3600


def read_trajectories(spark: SparkSession, questions: str, trajectories: str, haystacks: str) -> DataFrame:
    """Questions over agent trajectories: one row per turn.

    ``questions`` and ``trajectories`` are JSON lines, ``haystacks`` one JSON object of question id
    to trajectory ids. A trajectory is a session: its goal, then for every state the thought, the
    observation and the action where it has them, then its outcome. Observations come from a tool.
    Trajectories that are not there are left out; times only tell the order.
    """
    asked = spark.read.schema("id string, question_type string, question string, answer string").json(questions)
    ids = spark.read.text(haystacks, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("id", "tids")).select("id", F.posexplode("tids").alias("order", "tid"))
    state = "struct<thought: string, accessibility_tree: string, url: string, action: string>"
    runs = spark.read.schema(f"id string, goal string, outcome string, states array<{state}>").json(trajectories)
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    none = lambda c: F.coalesce(c, F.lit(""))
    of_state = lambda s: F.filter(F.array(turn("assistant", none(s["thought"])), turn("tool", F.when(none(s["accessibility_tree"]) != "", F.concat(F.lit("["), none(s["url"]), F.lit("]\n"), s["accessibility_tree"])).otherwise("")), turn("assistant", F.when(none(s["action"]) != "", F.concat(F.lit("action: "), s["action"])).otherwise(""))), lambda t: t["text"] != "")
    states = F.flatten(F.transform(F.coalesce("states", F.array().cast(f"array<{state}>")), of_state))
    turns = F.concat(F.array(turn("user", F.concat(F.lit("Task: "), none(F.col("goal"))))), states, F.array(turn("tool", F.concat(F.lit("outcome: "), F.coalesce("outcome", F.lit("unknown"))))))
    sessions = ids.join(runs.select(F.col("id").alias("tid"), turns.alias("turns")), "tid")
    off = F.col("question_type").endswith("-abs")
    rows = asked.join(sessions, "id").select(F.concat("id", F.when(off, "_abs").otherwise("")).alias("question_id"), "question_type", "question", "answer", off.alias("is_abstention"), F.col("tid").alias("sid"), (F.lit(FIRST_SECOND) + HOUR * F.col("order")).alias("ts"), F.posexplode("turns").alias("idx", "t"))
    return rows.select("question_id", "question_type", "question", "answer", "is_abstention", "sid", "ts", "idx", F.col("t.role").alias("turn_role"), F.col("t.text").alias("text"))


#: Readers by the name of the form.
READERS: dict[str, Callable[..., DataFrame]] = {"corpus": read_corpus, "sessions": read_sessions, "haystacks": read_haystacks, "trajectories": read_trajectories, "probes": read_probes}


def load(spark: SparkSession, form: str, *paths: str) -> DataFrame:
    """Read files of a named form; an unknown name is an error that lists the known ones."""
    if form not in READERS:
        raise ValueError(f"no reader for {form!r}; there are {', '.join(sorted(READERS))}")
    return READERS[form](spark, *paths)


def request_key(model: Column, messages: Column, temperature: Column, max_tokens: Column) -> Column:
    """The key of a model's reply: a hash of all that it depends on, fields in a fixed order."""
    return F.sha2(F.to_json(F.struct(max_tokens.alias("max_tokens"), messages.alias("messages"), model.alias("model"), temperature.cast("double").alias("temperature"))), 256)


def cached_replies(requests: DataFrame, *caches: DataFrame) -> DataFrame:
    """``requests`` (key and others) with ``reply``: that of the first cache (key, reply) that has one, else null."""
    found = None
    for place, cache in enumerate(caches):
        part = cache.select("key", F.lit(place).alias("place"), "reply")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return requests.withColumn("reply", F.lit(None).cast("string"))
    first = found.groupBy("key").agg(F.min(F.struct("place", "reply")).alias("r"))
    return requests.join(first, "key", "left").select(*requests.columns, F.col("r.reply").alias("reply"))


def seeded(held: DataFrame, seed: DataFrame, force: bool = False) -> DataFrame:
    """``held``, or ``seed`` where nothing is held yet or ``force`` asks for it."""
    return seed if force or not held.head(1) else held


#: Fixed value: characters of an assistant's message that are shown.
SHOWN = 700


def rendered_turns(turns: DataFrame) -> DataFrame:
    """Adds ``shown``, a turn as a model reads it. ``turns``: idx, turn_role, origin, ts, text, claimable (BOOLEAN).

    Messages of an assistant are cut; those of the owner, and what came from elsewhere, never.
    """
    role = F.coalesce(F.nullif(F.col("turn_role"), F.lit("")), F.lit("unknown"))
    outside = F.coalesce("origin", F.lit("")) != ""
    marks = F.concat_ws(" | ", role, F.when(outside, F.concat(F.lit("source: "), F.col("origin"))), F.when(~F.coalesce("claimable", F.lit(True)), "context"))
    at = F.when(F.coalesce("ts", F.lit(0)) == 0, "time unknown").otherwise(F.concat(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm"), F.lit(" UTC")))
    text = F.coalesce("text", F.lit(""))
    long = ~outside & (role_rank(F.col("turn_role"), F.lit(None).cast("string")) == 2) & (F.length(text) > SHOWN)
    body = F.when(long, F.concat(F.rtrim(F.substring(text, 1, SHOWN)), F.lit("\n[... the rest of the message is left out]"))).otherwise(text)
    return turns.withColumn("shown", F.concat(F.lit("#"), F.col("idx").cast("string"), F.lit(" ["), marks, F.lit("] "), at, F.lit("\n"), body))


def extracted(turns: DataFrame, extract, schema: str) -> DataFrame:
    """Claims from turns by a caller's ``extract(turns: DataFrame of pandas) -> pandas``, per batch.

    The extension point for model-backed extraction: partition-parallel, one call a batch; a
    batch that fails is tried turn by turn, so one bad turn costs only itself. Such a turn comes
    out as one row with ``failed`` set, those of its columns that ``schema`` has, and nulls: what
    was not extracted is told and can be counted, not lost.
    """
    named = [f.name for f in turns.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield extract(pdf).assign(failed=False)
            except Exception:  # noqa: BLE001  the caller's code may raise anything
                for i in range(len(pdf)):
                    one = pdf.iloc[i : i + 1]
                    try:
                        yield extract(one).assign(failed=False)
                    except Exception:  # noqa: BLE001
                        yield one.reindex(columns=named).assign(failed=True)

    return turns.mapInPandas(run, f"{schema}, failed boolean")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result (a report) as a markdown table; what is beyond ``limit`` rows is said, not dropped in silence."""
    rows = df.limit(limit + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:limit]]
    return "\n".join(lines + [f"\nOnly the first {limit} of {df.count()} rows are shown."] * (len(rows) > limit))
