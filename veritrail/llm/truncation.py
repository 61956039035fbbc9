"""Texts that were cut at a fixed length or in transfer.

Method: per source the discrete hazard of ending at each length (in characters and in UTF-8
bytes) is computed with window functions and tested against the hazards of neighbouring lengths
under false-discovery control. At significant lengths every incomplete ending is a cut; elsewhere
only an ending that its author cannot have meant: a broken escape, an unclosed structure, or a
sentence that breaks off.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: No residue of a cut that ``_RESIDUE`` can match needs more characters than this: its longest form
#: is a tag of 80, and of a run of octets or broken characters every end matches by itself.
_RESIDUE_REACH = 200
TERMINAL = ".!?。！？…"
CLOSERS = "\"'”’»)]}>*_`」』）】"
_ELLIPSIS = re.compile(r"(?:\.\.\.|…|\[\.\.\.\]|\(\.\.\.\)|\[…\]|\(…\))$")
#: What a cut through markup, an escape or an encoded line leaves behind.
_RESIDUE = re.compile(
    r"(?:�+"  # half a character
    r"|(?<![=\w])=[0-9A-Fa-f]?|(?<=\w)=[0-9A-F]?|(?<=[^\s=])=[0-9A-F]?(?:=[0-9A-F]{2})*"  # soft line end or half an octet
    r"|&(?:#\d{0,7}|#x[0-9A-Fa-f]{0,6}|[a-zA-Z]{1,7})"  # half an entity
    r"|</?[a-zA-Z][^<>]{0,80}|</?"  # half a tag
    r"|\\u[0-9a-fA-F]{0,3}|(?<!\\)\\)$"
)
_JSON_START = re.compile(r'[\[{]\s*(?:["\[{\]}\d-]|true|false|null)')
_LIST = re.compile(r"\s*(?:[-*•·+–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")
_QUOTE = re.compile(r"^(?:>\s?)+")
_ROLE = re.compile(r"^[a-z_]{2,12}: ", re.I)
#: Fixed value: how messages close in the languages of the corpus.
_CLOSING = re.compile(
    r"(?:(?:best|kind|warm|many)?\s*(?:regards|wishes|greetings)|(?:many\s+)?thanks(?:\s+(?:a lot|again|so much|in advance))?|thank you|cheers|yours(?: \w+)?|sincerely"
    r"|(?:mit freundlichen |viele |liebe |beste )?grü(?:ß|ss)e|danke(?: \w+)?|saludos|gracias|un saludo|cordialement|merci(?: \w+)?|bien à vous|atenciosamente|obrigad[oa]|abraços"
    r"|sent from .{1,40}|gesendet von .{1,40}|enviado desde .{1,40}|envoyé de .{1,40}|see also\W.*|siehe auch\W.*|attachments?: .*|anhänge?: .*|https?://\S+|ps:? .*|:\)|;\)|--|—)[,]?$",
    re.I,
)


def _ended(line: str) -> bool:
    """Whether a line stops with the mark of a whole sentence."""
    bare = line.rstrip().rstrip(CLOSERS).rstrip()
    return bool(bare) and bare[-1] in TERMINAL


def _open_json(text: str) -> bool:
    depth, quoted, escaped = 0, False, False
    for c in text:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return quoted or depth > 0


def ending(whole: str, fences: int) -> tuple[int, bool]:
    """How complete a text is: 0 whole, 1 without a full stop, 2 cut; and if it ends in dots.

    ``fences``: number of code fences in it.
    """
    text = whole.rstrip()
    if not text:
        return 0, False
    if text[0] in "{[" and (form := _structure(text)):
        return (2 if form == "open" else 0), False
    last_signs = text[-_RESIDUE_REACH:]
    if _RESIDUE.search(last_signs) and not re.search(r"(?:^|\s)(?:=+|&|<)$", last_signs):
        return 2, False
    if fences % 2:
        return 2, False
    dots = bool(_ELLIPSIS.search(text))
    lines = [_QUOTE.sub("", x).rstrip("\r") for x in text.split("\n")]
    last, before = lines[-1].strip(), [x.strip() for x in lines[:-1]]
    if dots:
        return 0, True
    body = re.sub(r"</?[a-zA-Z][^<>]*>", "", last).strip()
    if not body or last.startswith("```"):
        return 0, False
    if re.search(r"</(?:p|div|li|ul|ol|td|tr|table|body|html|h\d|span|blockquote)>$", last, re.I):
        return 0, False
    if _ended(last):
        opened = last.count("“") - last.count("”")
        return (2 if opened > 0 and last[-1] != "”" else 0), False
    if last.count(" | ") >= 1:
        widths = [x.count("|") for x in before if x]
        short = bool(widths) and last.count("|") < max(set(widths), key=widths.count)
        return (2 if short or last.endswith("|") and not last.startswith("|") else 1), False
    if re.fullmatch(r"[\[(<{].*[\])>}]", last):  # a marker line of its own
        return 0, False
    if _CLOSING.match(last):
        return 1, False
    if _LIST.match(lines[-1]):
        return 1, False
    if re.match(r"[A-Za-z][\w-]{0,20}: \S*$", last) and not _ROLE.match(last):
        return 1, False
    filled = [x for x in before if x]
    if filled and (_CLOSING.match(filled[-1]) and len(last.split()) <= 4 and not _ended(filled[-1])):
        return 1, False
    if len(filled) >= 2 and filled[-2] in ("--", "—") and len(last.split()) <= 5:
        return 1, False
    if filled and filled[-1] in ("--", "—") and len(last.split()) <= 5:
        return 1, False
    role = _ROLE.match(last)
    said = last[role.end() :] if role else last
    words = said.split()
    wide = re.search(r"[぀-ヿ一-鿿]", said)
    if role:
        # a short reply starts small; a sentence that breaks off starts like a sentence
        return (1 if len(words) <= 4 and said[:1].islower() and not whole.endswith(" ") else 2), False
    if not filled:
        # a text of one line: a word, a heading, a status
        if len(words) <= 7 and not wide and not re.search(r"[.!?]\s", said):
            return 1, False
        return 2, False
    return 2, False


def _structure(text: str) -> str:
    """``closed`` for JSON, ``open`` for the beginning of some; else the text is none and "" comes back.

    Prose that begins with a bracket ("[1] The ...", "[2024-05-01] done") opens nothing.
    """
    if not _JSON_START.match(text):
        return ""
    try:
        json.loads(text)
        return "closed"
    except ValueError:
        return "open" if _open_json(text) else ""


def _judge(doc: str, kind: str):
    def judge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            level, dots = [], []
            for text, fences in zip(pdf["_text"], pdf["_fences"]):
                a, b = ending(text, int(fences))
                level.append(a)
                dots.append(b)
            yield pd.DataFrame({doc: pdf[doc], "source": pdf["source"], "_chars": pdf["_chars"], "_bytes": pdf["_bytes"], "_level": level, "_dots": dots})

    return judge, f"`{doc}` {kind}, source string, _chars long, _bytes long, _level int, _dots boolean"


def _tail_chance(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p), by its largest terms; exact enough below 1e-300."""
    if k <= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) if 0 < p < 1 else 0.0
    total, term = 1.0, 1.0
    for i in range(k, min(n, k + 500)):
        term *= (n - i) / (i + 1) * p / (1 - p)
        total += term
        if term < total * 1e-12:
            break
    return min(1.0, math.exp(log) * total)


def length_hazards(lengths: DataFrame, reach: int = 25) -> DataFrame:
    """Per source, unit and length: texts that break off there, texts at least as long, neighbours.

    ``lengths``: source, unit, length, n (texts that break off or end in dots), texts (all).
    ``near_ends`` sums n over the lengths within ``reach`` of it, itself left out; it estimates the
    hazard it is tested against. A limit raises it for those beside it on purpose: cuts that left
    something behind scatter around their limit, and whole texts that end there are none. Whole texts that happen to be equally long (``ok``, a name)
    are at risk but are no event.
    """
    part = Window.partitionBy("source", "unit").orderBy("length")
    risk = F.sum("texts").over(part.rowsBetween(0, Window.unboundedFollowing))
    # by value of the length, as lengths at which nothing ends have no row
    around = F.sum("n").over(part.rangeBetween(-reach, reach)) - F.col("n")
    return lengths.select("*", risk.alias("at_risk"), around.alias("near_ends"))


def significant_lengths(hazards: DataFrame, reach: int = 25, rate: float = 0.01) -> DataFrame:
    """Lengths whose hazard exceeds their neighbours' (Benjamini-Hochberg at ``rate``).

    Every length of a source at which a text ends is a hypothesis, those at which none breaks off
    among them, so that the rate of false discoveries is the stated one. The neighbouring hazard
    counts one text more than was seen: an empty neighbourhood proves nothing by itself.
    """

    def chances(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = [min(0.5, (near + 1) / (2 * reach * max(1, risk))) for near, risk in zip(pdf["near_ends"], pdf["at_risk"])]
            pdf["chance"] = [_tail_chance(int(k), int(n), q) for k, n, q in zip(pdf["n"], pdf["at_risk"], p)]
            yield pdf[["source", "unit", "length", "n", "at_risk", "_m", "chance"]]

    by_source = Window.partitionBy("source", "unit")
    counted = hazards.withColumn("_m", F.count("*").over(by_source))
    # where nothing breaks off the chance is 1: such a length counts, but needs no test
    tested = counted.filter(F.col("n") > 0).select("source", "unit", "length", "n", "at_risk", "near_ends", "_m").mapInPandas(chances, "source string, unit string, length long, n long, at_risk long, _m long, chance double")
    ranked = tested.withColumn("_i", F.row_number().over(by_source.orderBy("chance", "length")))
    passing = F.max(F.when(F.col("chance") <= rate * F.col("_i") / F.col("_m"), F.col("_i"))).over(by_source)
    return ranked.withColumn("_k", passing).filter(F.col("_i") <= F.col("_k")).select("source", "unit", "length", "n", "at_risk", "chance")


def judged_endings(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """doc_id, source, _chars, _bytes, _level and _dots of every text that is not empty."""
    body = F.col(text)
    rows = docs.filter(F.length(body) > 0).select(
        doc_id,
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.length(body).cast("long").alias("_chars"),
        F.octet_length(body).cast("long").alias("_bytes"),
        F.ltrim(body).alias("_text"),
        F.size(F.split(body, r"(?m)^\s*```", -1)).alias("_fences"),
    ).withColumn("_fences", F.col("_fences") - 1)
    judge, schema = _judge(doc_id, docs.schema[doc_id].dataType.simpleString())
    return rows.mapInPandas(judge, schema)


def cut_texts(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Texts that were cut: doc_id, source, at_limit.

    Null and empty texts were not cut. Null sources form a source of their own. A row that comes
    twice comes out twice. The lengths of all texts enter the hazards; only (source, unit,
    length) counts are shuffled, so a source of any size is aggregated map-side.
    """
    from veritrail.operators.shared import stage

    judged = stage(judged_endings(docs, doc_id, text, source), "endings")
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("_bytes").alias("length"))))
    lengths = judged.select("source", "_level", "_dots", units.alias("_u")).groupBy("source", "_u.unit", "_u.length").agg(F.count_if((F.col("_level") == 2) | F.col("_dots")).alias("n"), F.count("*").alias("texts"))
    limits = stage(significant_lengths(length_hazards(lengths)), "limits")
    at = lambda unit, column: limits.filter(F.col("unit") == unit).select("source", F.col("length").alias(column), F.lit(True).alias(f"_at{column}"))
    seen = judged.join(at("chars", "_chars"), ["source", "_chars"], "left").join(at("bytes", "_bytes"), ["source", "_bytes"], "left")
    limit = F.coalesce(F.col("_at_chars"), F.lit(False)) | F.coalesce(F.col("_at_bytes"), F.lit(False))
    cut = (F.col("_level") == 2) | (limit & ((F.col("_level") == 1) | F.col("_dots")))
    return seen.filter(cut).select(doc_id, "source", limit.alias("at_limit"))


def truncation_report(docs: DataFrame, cut: DataFrame, source: str) -> DataFrame:
    """Per source: texts, cut texts, those of them at a limit, and the share of cut ones."""
    total = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("texts"))
    cuts = cut.groupBy("source").agg(F.count("*").alias("cut"), F.count_if("at_limit").alias("at_limit"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return total.join(cuts, "source", "left").select("source", "texts", none("cut"), none("at_limit"), F.round(F.coalesce(F.col("cut"), F.lit(0)) / F.col("texts"), 6).alias("share"))
