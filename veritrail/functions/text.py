"""Text functions as SQL expressions and Columns; nothing here leaves whole-stage codegen.

``stem_sql`` states the stemmer as one ANSI expression, ``stem`` is what queries use.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: Words that carry no meaning for search.
STOPWORDS = """
a about after again all also am an and any are as at be because been before being both but by can could did do does
doing done down during each few for from further had has have having he her here hers him his how i if in into is it
its itself just me might more most must my no nor not now of off on once only or other our ours out over own same she
should so some such than that the their theirs them then there these they this those through to too under until up us
very was we were what when where which while who whom why will with would you your yours s t
""".split()



def _base_letters() -> tuple[str, str]:
    """Small letters of the European alphabets and full-width ones whose compatible form without
    marks is another single letter, and these; then the marks themselves, which have none."""
    bare = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
    signs = [chr(c) for c in (*range(0xA0, 0x2000), *range(0xFF01, 0xFF5F)) if chr(c) == chr(c).lower() and chr(c).isalnum()]
    pairs = [(c, bare(c)) for c in signs if len(bare(c)) == 1 and bare(c) != c and bare(c).isalnum()]
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(p for _, p in pairs)


ACCENTED, PLAIN = _base_letters()


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column | str) -> Column:
    """Lower-case runs of letters or digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def stem_sql(w: str) -> str:
    """A small suffix stripper: plurals, -ing, -ed, trailing -e; words of up to three letters stay."""
    def undouble(x: str) -> str:
        return f"CASE WHEN length({x}) > 3 AND right({x}, 1) = left(right({x}, 2), 1) AND right({x}, 1) NOT IN ('l', 's', 'z') THEN left({x}, length({x}) - 1) ELSE {x} END"

    cut = lambda n: f"left({w}, length({w}) - {n})"
    first = f"""CASE WHEN right({w}, 3) = 'ies' AND length({w}) > 4 THEN concat({cut(3)}, 'y')
      WHEN right({w}, 4) = 'sses' THEN {cut(2)}
      WHEN length({w}) > 5 AND (right({w}, 4) IN ('ches', 'shes') OR right({w}, 3) IN ('xes', 'zes', 'ses')) THEN {cut(2)}
      WHEN right({w}, 1) = 's' AND right({w}, 2) NOT IN ('ss', 'us', 'is') THEN {cut(1)}
      WHEN right({w}, 3) = 'ing' AND length({w}) > 5 THEN {undouble(cut(3))}
      WHEN right({w}, 2) = 'ed' AND length({w}) > 4 THEN {undouble(cut(2))}
      ELSE {w} END"""
    return f"""CASE WHEN length({w}) <= 3 OR {w} = regexp_extract({w}, '([0-9]+)', 1) THEN {w}
      WHEN length({first}) > 3 AND right({first}, 1) = 'e' THEN left({first}, length({first}) - 1)
      ELSE {first} END"""


#: The stemmer as rewriting steps; # ends a finished word, % one that may lose a doubled letter.
_SUFFIXES = (
    (r"^(.{2,})ies$", "$1y#"), (r"^(.*ss)es$", "$1#"), (r"^(.{2,}[cs]h|.{3,}[xzs])es$", "$1#"), (r"^(.*[^sui])s$", "$1#"),
    (r"^(.{3,})(?:ing|ed)$", "$1%"), (r"^(.{2,})([^lsz])\2%$", "$1$2#"), (r"[#%]$", ""), (r"^(.{3,})e$", "$1"),
)


def stem(word: Column | str) -> Column:
    """What ``stem_sql`` says, as short code: nested cases would outgrow a generated method."""
    w = F.col(word) if isinstance(word, str) else word
    out = w
    for pattern, replacement in _SUFFIXES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when((F.length(w) > 3) & w.rlike("(?:s|e|ed|ing)$"), out).otherwise(w)


def content_words(text: Column | str) -> Column:
    """``words`` without stopwords, unstemmed."""
    return F.filter(words(text), lambda w: ~w.isin(*STOPWORDS))


def fold(text: Column | str) -> Column:
    """Lower case, compatible forms and marks of letters removed, sharp s as ss."""
    return F.replace(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def entity_key(text: Column | str) -> Column:
    """The form under which an entity is matched.

    Folded; possessives dropped; hyphens, underscores and punctuation to spaces; white space
    squeezed; leading articles dropped unless nothing else is left.
    """
    x = F.regexp_replace(fold(text), r"['’`]s\b", "")
    x = F.regexp_replace(x, r"([\p{L}\p{N}_])['’`](\s|$)", "$1$2")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "), r"\s+", " "))
    return F.regexp_replace(x, r"^((the|a|an) )+", "")


def predicate_key(text: Column | str) -> Column:
    """Snake case: ``works at`` and ``works_at`` are one."""
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^0-9a-z]+", "_"), r"^_+|_+$", "")


def canonical_key(subject: Column | str, predicate: Column | str, object_: Column | str) -> Column:
    return F.concat_ws("|", entity_key(subject), predicate_key(predicate), entity_key(object_))


def stable_id(kind: str, *parts: Column | str) -> Column:
    """A deterministic 60-bit id of a record."""
    joined = F.concat_ws("\u001f", F.lit(kind), *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")).cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("long")


def estimated_tokens(text: Column | str) -> Column:
    """A quarter of the characters, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def plain_answer(text: Column | str) -> Column:
    """Answers compared: lower case, apostrophes dropped, punctuation to spaces, no articles."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[’'`]", "")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", " ")
    kept = F.filter(F.split(x, r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the"))
    return F.array_join(kept, " ")


#: Phrases of an answer that declines for lack of evidence.
ABSTENTIONS = (
    "i dont know", "i do not know", "no information", "not enough information", "insufficient information",
    "information provided is not enough", "dont have that information", "do not have that information",
    "dont have any information", "do not have any information", "dont have enough", "do not have enough",
    "dont have access to", "no mention of", "wasnt mentioned", "was not mentioned", "not mentioned",
    "you did not mention", "you have not mentioned", "never mentioned", "no record", "not in my memory",
    "cannot determine", "cant determine", "unable to determine", "no evidence", "not stated", "isnt anything in",
    "there is nothing in", "no supporting", "insufficient evidence", "does not contain", "doesnt contain",
    "do not contain", "dont contain", "does not include", "doesnt include", "does not mention", "doesnt mention",
    "does not specify", "doesnt specify", "not specified", "is not provided", "was not provided", "no details about",
    "no details on", "does not appear", "doesnt appear", "cannot answer", "cant answer", "unable to answer",
    "not available in", "no relevant", "based on the provided chat there is no", "memory does not contain",
    "memory has no", "did not find", "couldnt find", "could not find",
)


def declines(text: Column | str) -> Column:
    """Whether an answer declines for lack of evidence; an empty one does."""
    return let(plain_answer(text), lambda plain: (plain == "") | plain.rlike("|".join(ABSTENTIONS)))


def phrases(text: Column | str, most: int = 3) -> Column:
    """Runs of up to ``most`` neighbouring words none of which is a stopword or a single letter."""
    found = words(text)

    def of(size: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(found) - size + 1)), lambda i: F.slice(found, i, size))
        return F.transform(F.filter(runs, lambda r: (F.size(r) == size) & F.forall(r, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))), lambda r: F.array_join(r, " "))

    return F.array_distinct(F.concat(*(of(n) for n in range(most, 0, -1))))
