"""Personal information in free text: found, classified, replaced by typed placeholders.

Method: weak supervision. Generous patterns propose spans; labelers (patterns, a gazetteer of
given names with corpus statistics of what follows them, and context words) vote on each;
expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is;
its soft labels train the final span classifier, which decides.

A name need not be in the gazetteer: capitalised words behind a word that introduces a person are
proposed too, and how often their words are introduced like that in the whole corpus, and how often
they are written small, are votes like those of the gazetteer.

Vote patterns (at most 3^labelers) and corpus statistics cover all texts. Tokens are counted one by
one, and the counts of those that stand beside a given name, an initial or such an introduction are
kept, however many they are. The classifier is fitted on at most ``TRAIN_TEXTS`` texts, chosen by
hash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from veritrail.operators.shared import stage

#: Bound of the sample on which the classifier is fitted.
TRAIN_TEXTS = 40_000
FEATURES = 1 << 16
#: Texts of at most so many characters are remembered while a task runs (at most 20 000 of them).
SHORT = 400

#: Given names of several languages, the gazetteer unless a caller gives another.
GIVEN_NAMES = """
Aaron Abena Adam Agnes Aisha Alice Amara Amina Ana Anders Andrea Andrei Anja Anna Antonio Arjun Astrid Beatriz Bjørn
Bruno Camila Carla Carlos Carmen Cerys Charlotte Chidi Chiara Chloé Clara Cormac Daniel David Dawn Deepa Diego Dmitri
Eduardo Elena Elif Emil Emma Erik Esther Eva Fatima Felix Francisco Frank Gabriel George Grace Greta Grete Hannah Haruto
Hassan Helen Helena Henrik Hugo Ines Ingrid Ioana Isabel Ivan Jade Jakub James Jan Jane Javier Jean Joao João Johannes
John José Julia Jun Jürgen Karin Katarina Kemal Kenji Kofi Lars Laura Leila Lena Lerato Lin Linda Louise Lucas Lucia
Luis Lukas Maja Manuel Marek Maria Marie Mark Marta Martin Mary Mateo Maëlle Mehmet Mei Michael Miguel Milan Miriam
Mohammed Nadia Naomi Niamh Nikhil Nina Noah Olaf Olga Oksana Omar Oscar Pablo Paul Paula Pedro Peter Petra Pierre Piotr
Priya Rafael Rhys Rosa Rose Ruth Samira Sara Sarah Simon Sofia Sophie Stefan Susan Sven Søren Tariq Thabo Thomas Théo
Tomas Ulrike Victor Wen Will William Yuki Yusuf Zoé Zofia
""".split()

_PARTICLE = r"(?:(?i:van|von|de|da|del|di|der|den|la|le|dos|du|al|el|bin)[ ]+){0,2}"
_TOKEN = r"[^\W\d_]+(?:['’\-](?![sS]\b)[^\W\d_]+)*"
_SURNAME = re.compile(rf"[ ](?P<s>{_PARTICLE}(?P<last>{_TOKEN}))(?![\w@+])")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")


class Gazetteer:
    """Given names: where a text has them."""

    def __init__(self, names: tuple[str, ...]):
        self.patterns = {n.lower(): re.compile(rf"(?<![\w.@+'’\-]){re.escape(n)}(?![\w@+]|[.\-_](?=\w)|\s*\(?\[?at[\])]\s*\w)", re.I) for n in names}
        self.names = frozenset(self.patterns)

    def find(self, text: str, words: set[str]) -> list[re.Match]:
        """Names in a text whose words, in lower case, are ``words``: these tell which of the names to look for."""
        there = self.names & words
        return sorted((m for n in there for m in self.patterns[n].finditer(text)), key=re.Match.start) if there else []


_INITIAL = re.compile(rf"(?<![\w./])(?P<i>[^\W\d_]\.(?:[ ]?[^\W\d_]\.)?)[ ](?P<s>{_PARTICLE}(?P<last>{_TOKEN}))(?![\w@+])")
_BEFORE = re.compile(rf"(?P<s>(?<![\w.@'’\-]){_PARTICLE}(?P<last>{_TOKEN})),[ ]$")
_NEXT = re.compile(rf"[ ]({_TOKEN})")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")

#: Words behind which a person is named, also those with "is", and what may stand between.
_TITLES = "dr prof professor mr mrs ms herr frau señor señora madame monsieur".split()
_VERBS = "ask asked tell told copy contact thank thanks met meet call called named".split()
_ROLES = "manager sister brother mother father daughter son colleague neighbour neighbor partner friend boss landlord owner holder name".split()
_INTRODUCTIONS = frozenset([*_TITLES, *_VERBS, *_ROLES])
_INTRODUCED = re.compile(rf"(?<!\w)(?i:(?:{'|'.join(_TITLES)})\.?|{'|'.join(_VERBS)}|(?:{'|'.join(_ROLES)})(?:\s(?:is|was))?)[:,]?[ ]")
_CAPITAL = r"[A-ZÀ-ÖØ-ÞĀ-Ž][^\W\d_A-Z]+(?:['’\-][^\W\d_]+)*"
_RUN = re.compile(rf"{_CAPITAL}(?:[ ]{_PARTICLE}{_CAPITAL}){{0,2}}(?![\w@+])")

_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*"
_LABEL = r"[A-Za-z][A-Za-z0-9\-]*"
_AT = r"(?:\s?@\s?|\s?[\(\[\{]\s?at\s?[\)\]\}]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\(\[\{]\s?dot\s?[\)\]\}]\s?|\sdot\s)"
_EMAIL = re.compile(rf"(?<![\w.+\-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
_AT_WORD = re.compile(r"@|[\s(\[{]at[\s)\]}]", re.I)
_PLAIN_EMAIL = re.compile(rf"(?<![\w.+\-]){_LOCAL}\s?@\s?{_LABEL}(?:\.{_LABEL})+", re.I)
_NUMBER = re.compile(r"(?<![\w.,:#/@\-])(?:\+|\()?\d[\d ()./\-]{5,22}\d(?:,?\s?(?:ext|x|extension|durchwahl|poste)\.?\s?\d{1,6})?(?![\w]|[./\-]\d)", re.I)
_DOCUMENT = re.compile(r"(?<![\w\-])(?:[A-Z]{1,3}[ \-]?\d(?:[ \-]?\d){4,9}(?:[ \-]?[A-Z])?|\d(?:[ .\-]?\d){6,9}[ \-]?[A-Z]|\d{2,3}(?:[ \-]\d{2,4}){2,3})(?![\w]|-\d)")

_STREET = r"(?:street|str|st|road|rd|lane|ln\.?|avenue|ave|close|terrace|court|square|sq\.?|drive|way|place|row|crescent|gardens|mews|hill)"
_NO = r"\d{1,5}(?:\s?[-–]\s?\d{1,5})?[a-z]?"
_POST = r"(?:,\s(?:[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}|\d{4,5}(?:-\d{3,4})?))"
_FLAT = r"(?:(?:flat|apt|apartment|unit|suite|room|floor|wohnung|apto|appt)\.?\s\d{1,4}\s?[a-z]?)"
_STAIR = r"(?:,\s\d{1,2}\.?[ºª°o]\s?(?:[A-Z]\b|Esq\.?|Dto\.?|Dta\.?|Izq\.?|Dcha\.?|Frente)?)"
_ADDRESSES = [
    re.compile(rf"(?<![\w\-])(?:{_FLAT},\s)?{_NO}\s(?:[^\W\d_]+[ \-]){{1,3}}?{_STREET}(?!\w)(?:,\s{_FLAT})?{_POST}?(?!\w)", re.I),
    re.compile(rf"(?<![\w\-]){_NO},?\s(?:bis\s|ter\s)?(?:rue|avenue|boulevard|quai|allée|place|impasse|chemin|cours|route|square|passage)(?:\s(?:des?|du|de la|aux?|la|le|les))?\s(?:(?:de l|d|l)['’])?(?:(?:vieux|vieil|vieille|grande?|petite?|haute?|bas|basse|nouveau|nouvelle|beau|belle|saint|sainte|général|maréchal|docteur|président|jean|jules|victor|pierre|paul|charles)[ \-])?[^\W\d_]+(?:[\-'’][^\W\d_]+)*(?:,\s(?:bât|appt|étage)\.?\s\w+)?(?:,\s\d{{5}}(?!\d))?", re.I),
    re.compile(rf"(?<!\w)(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|ronda|rua|travessa|largo|praça|estrada|alameda|beco)\s(?:(?:del?|de la|de los|de las|dos?|das?)\s)?[^\W\d_]+(?:[ \-][^\W\d_]+)?,?\s{_NO}(?!\w){_STAIR}?(?:,\s\d{{4,5}}(?:-\d{{3}})?)?", re.I),
    re.compile(rf"(?<!\w)(?:(?:am|an der|an den|im|in der|zum|zur|auf der|auf dem|unter den)\s[^\W\d_]+(?:[\-][^\W\d_]+)*|[^\W\d_]+(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|kehre|grund|hof|steig|pfad|chaussee|markt|berg|tal|feld|see))\s\d{{1,4}}\s?[a-z]?(?!\w|[:.,]\d)(?:,\s(?:\d{{1,2}}\.\s?(?:OG|Stock|Etage)|EG))?(?:,\s\d{{5}}(?!\d))?", re.I),
]

_PLACE_WORDS = [
    frozenset("street str st road rd lane ln avenue ave close terrace court square sq drive way place row crescent gardens mews hill".split()),
    frozenset("rue avenue boulevard quai allée place impasse chemin cours route square passage".split()),
    frozenset("calle c avenida avda plaza paseo camino ronda rua travessa largo praça estrada alameda beco".split()),
    frozenset("am im an der den dem zum zur".split()),
]
_PLACE_ENDS = ("straße", "strasse", "str", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer", "kehre", "grund", "hof", "steig", "pfad", "chaussee", "markt", "berg", "tal", "feld", "see")

_PHONE_SHAPES = re.compile(
    r"\+\d{1,3}[ \-.]?(?:\(0\)[ ]?)?\d{1,4}(?:[ \-./]?\d{2,5}){1,5}|00[ ]?\d{1,3}(?:[ \-]\d{1,5}){2,5}|\(\d{2,5}\)[ ]?\d{3,5}[ \-.]?\d{3,5}|\d{3}([\-. ])\d{3}\1\d{4}"
    r"|0\d{2,4}[ /]\d{3,5}(?:[ \-]\d{3,5})?|0\d(?:[ .]\d{2}){4}"
)
_ID_SHAPES = re.compile(r"[A-Z]{2}\d{7}|[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z]|\d{8}-?[A-Z]|\d{3}([ \-])\d{2}\1\d{4}|\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}|[A-Z]\d{8}|[A-Z]{1,2}[ \-]?\d{6}")

_CUES = {
    "email": (r"mail|correo|reach|contact|konto|account|bounced|try|from|reply|receipt|notes|write|send|copy|page|es|says", r"follow|ping"),
    "phone": (r"phone|call|callback|text|reach|number|num[eé]ro|mobile|cell|sim|fax|tel|ring|an|on|to|contact|page|back|à|ou", r"order|parcel|invoice|ticket|build|version|section|record|entry|port|page|pedido|colis|isbn|sku"),
    "id_number": (r"id|ids?|passport|ssn|licen[cs]e|tax|doc|document|documento|national|identity|insurance|typed|nummer|ausweis|dni|nie", r"order|parcel|invoice|ticket|build|version|section|record|entry|port|page|pedido|colis|phone|call"),
    "address": (r"live[sd]?|living|address|adresse|at|owner|wohn\w*|calle|au|vit|mora|moved?|from|deliver\w*|ship\w*|is|ist|to|before", r"page|version|section|build|order"),
    "person": (
        r"owner|holder|contact|ansprechpartner(?:in)?|landlord|from|text|manager|sister|brother|dr|prof|professor|mrs?|ms|thanks|told|answer|for|copy|met|guest|list|identity|tell|is|under|by|to|with|à|an|nuevo|novo|contacto|that|and|or|demande|friend|colleague|neighbour|partner|mit|de|et|y|e|on",
        r"the|a|an|be|we|i|last|at|in|this|all|my|very|more|not",
    ),
}
_CUES = {k: (re.compile(rf"(?:{a})", re.I), re.compile(rf"(?:{b})", re.I)) for k, (a, b) in _CUES.items()}
#: Fixed value: words that make a verb or noun of an ambiguous name before them.
_ORDINARY = frozenset(
    "the a an my your our his her this that these those it be is was on at in of to for from and or as by up beds bushes garden green period folder point with you we they i not "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split()
)
#: Fixed value: what follows such a name where it is a verb, noun or adjective.
_VERBAL = frozenset(
    "the a an my your our his her these those be it you me us them beds bushes garden green period folder point "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split()
)
KINDS = ("email", "phone", "id_number", "address", "person")


def _print(token: str, salt: str) -> int:
    """Spark's xxhash64 of ``salt`` and ``token``."""
    said = xxhash.xxh64_intdigest((salt + token).encode(), seed=42)
    return said - (1 << 64) if said >> 63 else said


class Lexicon:
    """How often a token comes, follows a given name or initial (or stands before one and a comma),
    looks like an ordinary word, and is introduced as a person.

    ``prints``: ascending, one for each token that may be asked; ``table``: its four counts.
    """

    def __init__(self, prints: np.ndarray, table: np.ndarray, salt: str = ""):
        self.prints, self.table, self.salt = prints, table, salt
        self._known: dict[str, tuple[float, ...]] = {}

    def counts(self, token: str) -> tuple[float, ...]:
        held = self._known.get(token)
        if held is None:
            wanted = _print(token.lower(), self.salt)
            at = int(np.searchsorted(self.prints, np.int64(wanted)))
            held = tuple(self.table[at].tolist()) if at < len(self.prints) and self.prints[at] == wanted else (0.0, 0.0, 0.0, 0.0)
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[token] = held
        return held

    def anchored(self, token: str) -> float:
        total, after, _, _ = self.counts(token)
        return (after + 0.6) / (total + 1.0)

    def ordinary(self, token: str) -> float:
        """Share of its occurrences written small or before a word that makes it a verb or noun."""
        total, _, plain, _ = self.counts(token)
        return plain / total if total else 0.0

    def introduced(self, token: str) -> float:
        """Share of its occurrences in a run of capitalised words that an introduction precedes."""
        total, after, _, cued = self.counts(token)
        return (cued + after + 0.6) / (total + 1.0)


def _following(text: str, at: int) -> str | None:
    m = _NEXT.match(text, at)
    return m[1] if m else None


def introduced_runs(text: str, names: list[re.Match], words: set[str]) -> list[re.Match]:
    """Runs of up to three capitalised words behind an introduction, unless one starts with a listed name."""
    if _INTRODUCTIONS.isdisjoint(words):
        return []
    listed = {m.start() for m in names}
    runs = (_RUN.match(text, m.end()) for m in _INTRODUCED.finditer(text))
    return [r for r in runs if r and r.start() not in listed and r[0].split(" ")[0].lower() not in _INTRODUCTIONS]


def _asked(text: str, names: list[re.Match], initials: list[re.Match], runs: list[re.Match]) -> Iterator[str | None]:
    """The tokens beside names, initials and introductions, which ``candidates`` looks up, and the names."""
    for m in names:
        yield from (m[0], _following(text, m.end()))
        if after := _SURNAME.match(text, m.end()):
            yield from (after["last"], _following(text, after.end("s")))
        if before := _BEFORE.search(text, max(0, m.start() - 48), m.start()):
            yield before["last"]
    for m in initials:
        yield from (m["last"], _following(text, m.end("s")))
    for r in runs:
        yield from r[0].split(" ")


def _count_tokens(gazetteer: tuple[str, ...]):
    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Gazetteer(gazetteer)
        for pdf in batches:
            seen, asked = Counter(), set()
            after, verbal, cued = Counter(), Counter(), Counter()
            for text in pdf["text"]:
                seen.update(_WORD.findall(text))
                words = set(_LETTERS.findall(text.lower()))
                names, initials = known.find(text, words), list(_INITIAL.finditer(text))
                runs = introduced_runs(text, names, words)
                for at in {m.end() for m in names} | {m.end("i") for m in initials}:
                    if text[at : at + 1] == " " and (m := _WORD.match(text, at + 1)):
                        after[m[0].lower()] += 1
                for m in names:
                    if before := _BEFORE.search(text, max(0, m.start() - 48), m.start()):
                        after[before["last"].lower()] += 1  # a surname that is put first
                    follow = _WORD.match(text, m.end() + 1)
                    verbal[m[0].lower()] += not m[0].islower() and follow is not None and follow[0].lower() in _VERBAL
                for r in runs:
                    cued.update(r[0].lower().split(" "))
                asked.update(t.lower() for t in _asked(text, names, initials, runs) if t)
            total, small = Counter(), Counter()
            for token, n in seen.items():
                low = token.lower()
                total[low] += n
                small[low] += n if token.islower() else 0
            yield pd.DataFrame([(k, n, after[k], small[k] + verbal[k], cued[k], k in asked) for k, n in total.items()], columns=["token", "total", "after", "small", "cued", "asked"])

    return count


def token_counts(full: DataFrame, gazetteer: tuple[str, ...] = tuple(GIVEN_NAMES)) -> DataFrame:
    """token, total, after, small, cued: exact counts of every token beside a given name, initial or introduction."""
    counted = full.select("text").mapInPandas(_count_tokens(gazetteer), "token string, total long, after long, small long, cued long, asked boolean")
    summed = counted.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("total", "after", "small", "cued")), F.max("asked").alias("asked"))
    return summed.filter("asked").drop("asked")


def _lexicon(full: DataFrame, gazetteer: tuple[str, ...]) -> Lexicon:
    counts = stage(token_counts(full, gazetteer), "tokens")
    columns = ("total", "after", "small", "cued")
    salt = ""
    while True:
        # 24 bytes a token; the words themselves stay on the executors
        found = counts.select(F.xxhash64(F.concat(F.lit(salt), "token")).alias("p"), *(F.col(c).cast("float") for c in columns)).toArrow()
        prints = found["p"].to_numpy()
        order = np.argsort(prints)
        prints = prints[order]
        if (prints[1:] != prints[:-1]).all():
            return Lexicon(prints, np.stack([found[c].to_numpy() for c in columns], axis=1)[order], salt)
        salt += "~"  # two tokens with one print: all are taken anew


def _sided(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    left = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])][-3:]
    right = [w.lower() for w in _WORD.findall(text[end : end + 32])][:2]
    return left, right


def _shape(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", lambda m: "a" if m[0].islower() else "A", re.sub(r"\d", "9", s)))


def _case(s: str) -> str:
    return "low" if s.islower() else "up" if s.isupper() and len(s) > 1 else "title" if s[:1].isupper() else "mixed"


def candidates(text: str, lexicon: Lexicon, gazetteer: Gazetteer) -> list[tuple[int, int, str, str, list[int], list[str]]]:
    """(start, end, kind, form, votes, features) of every span that might be personal."""
    out = []

    def add(start: int, end: int, kind: str, votes: list[int], features: list[str], form: str = "", cued: bool = True) -> None:
        left, right = _sided(text, start, end)
        good, bad = _CUES[kind]
        near = left[-1] if left else ""
        cue = 1 if any(good.fullmatch(w) for w in left[-2:]) else 0
        cue = -1 if bad.fullmatch(near) else cue
        # introduced runs are learned apart, so that they do not change what holds for listed names
        own = "run" if form.startswith("r") else kind
        features = [own, f"{own}|cue{cue}", f"{own}|l1={near}", f"{own}|l2={' '.join(left[-2:])}", f"{own}|r1={right[0] if right else ''}", f"{own}|after={text[end : end + 2]}", *(f"{own}|v{i}={v}" for i, v in enumerate(votes)), *(f"{own}|{f}" for f in features)]
        out.append((start, end, kind, form, [cue, *votes] if cued else votes, features))

    emails = [m.span() for m in _PLAIN_EMAIL.finditer(text)] if "@" in text else []
    # a written sign outranks the word "at" in front of the address
    at, plain_only = 0, sorted(emails)
    for x, y in [*plain_only, (len(text), len(text))] if emails or _AT_WORD.search(text) else []:
        emails += [(m.start() + at, m.end() + at) for m in _EMAIL.finditer(text[at:x])]
        at = y
    for a, b in emails:
        said = text[a:b]
        plain = "@" in said
        spoken = bool(re.search(r"\sat\s", said, re.I))
        # "at" between ordinary words is no address unless a spoken dot follows
        host = re.search(r"(?:\sdot\s|[\[({]\s?dot|\.)", said[re.search(_AT, said, re.I).start() :], re.I)
        tail = re.split(_DOT, said, flags=re.I)[-1]
        add(a, b, "email", [1 if plain or re.search(r"[\[({]\s?at", said, re.I) else 0, 1 if host and len(tail) >= 2 else -1, -1 if spoken and not re.search(r"dot", said, re.I) else 0], [_shape(said)[:16], f"plain{plain}"])
    taken = emails
    digits_there, said_words = _DIGIT.search(text) is not None, set(_LETTERS.findall(text.lower()))
    for m in _NUMBER.finditer(text) if digits_there else ():
        a, b = m.span()
        said = m[0]
        if said.count("(") > said.count(")") and said.startswith("("):
            a += 1
            said = text[a:b]
        core = re.sub(r",?\s?(?:ext|x|extension|durchwahl|poste)\.?\s?\d+$", "", said, flags=re.I)
        digits = sum(c.isdigit() for c in core)
        exact = _PHONE_SHAPES.fullmatch(core)
        other = _ID_SHAPES.fullmatch(said)
        if other and not exact:  # the shape of a document only; it is proposed as one
            continue
        add(a, b, "phone", [1 if exact else -1, 1 if 9 <= digits <= 14 else -1, 1 if said[:1] in "+(" or said[:2] == "00" else 0, -1 if other else 0], [f"s={_shape(core)}", f"d={digits}"])
    for m in _DOCUMENT.finditer(text) if digits_there else ():
        a, b = m.span()
        if any(x < b and a < y for x, y in taken):
            continue
        said = m[0]
        exact = _ID_SHAPES.fullmatch(said)
        add(a, b, "id_number", [1 if exact else -1, 1 if any(c.isalpha() for c in said) else 0, -1 if _PHONE_SHAPES.fullmatch(said) else 0], [f"s={_shape(said)}", f"n={len(said)}"])
    places = []
    for n, pattern in enumerate(_ADDRESSES if digits_there else ()):
        # without a word that every address of this kind has, the pattern need not be tried
        if _PLACE_WORDS[n].isdisjoint(said_words) and not (n == 3 and any(w.endswith(_PLACE_ENDS) for w in said_words)):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            said = m[0]
            places.append((a, b))
            words = _WORD.findall(said)
            add(a, b, "address", [1 if re.search(r"\d", said) else -1, 1 if len(words) >= 3 else 0, 1 if re.search(_POST + "|" + _FLAT + "|" + _STAIR, said, re.I) else 0], [f"p{n}", f"t={words[-1].lower()}", f"w={len(words)}"])
    blocked = emails + places
    names = gazetteer.find(text, said_words)
    hits = [m.span() for m in names if not any(x < m.end() and m.start() < y for x, y in blocked)]
    ends = {b for _, b in hits}

    def person(a: int, b: int, form: str, given: str | None, last: str | None, follow: str | None) -> None:
        anchored = lexicon.anchored(last) if last else -1.0
        nexts = lexicon.anchored(follow) if follow else -1.0
        common = lexicon.ordinary(given) if given else 0.0
        grade = lambda x: 1 if x > 0.5 else -1 if x < 0.2 else 0
        fits = lambda x, y: _case(x) == _case(y) or (_case(x) == "title" and _case(y) == "mixed")
        if form == "g":
            verbal = bool(follow) and follow.lower() in _VERBAL
            votes = [-1 if verbal else 1 if not follow else 0, 1 if common < 0.4 else -1 if given.islower() or verbal else 0]
            if follow and nexts > 0.5 and fits(given, follow):
                form, votes = "gn", [-1]
        else:
            head = given if given else text[a]
            alike = 1 if fits(head, last) or not given and head.isupper() and not last.islower() else -1
            votes = [grade(anchored), alike]
            if form == "is":  # the letter may close the capitalised word before it
                lead = re.search(r"([^\W\d_]+) $", text[max(0, a - 30) : a])
                if lead and lead[1][0].isupper() and not lead[1].isupper() and not _CUES["person"][0].fullmatch(lead[1]):
                    form, votes = "io", [-1]
            if last.lower() in _ORDINARY:
                form, votes = "go", [-1]
        level = lambda x: "n" if x < 0 else str(int(x * 5))
        features = [form, f"{form}|a={level(anchored)}", f"{form}|n={level(nexts)}", f"{form}|c={level(common)}|{_case(given) if given else ''}", f"{form}|{_case(last) if last else ''}{_case(given) if given else ''}", f"f={(follow or '').lower()}|{level(common)}"]
        if last:
            low = f"^{last.lower()}$"
            features += [f"g={low[i : i + 3]}" for i in range(len(low) - 2)]
        add(a, b, "person", votes, features, form, form in ("g", "is"))

    for a, b in hits:
        given = text[a:b]
        m = _SURNAME.match(text, b)
        person(a, b, "g", given, None, _following(text, b))
        if m:
            person(a, m.end("s"), "gs", given, m["last"], _following(text, m.end("s")))
        before = _BEFORE.search(text, max(0, a - 48), a)
        own = m and lexicon.anchored(m["last"]) > 0.5 and _case(m["last"]) == _case(given)
        lead = text[max(0, before.start("s") - 4) : before.start("s")] if before else ""
        if before and not own and not re.search(r"(?<!\w)[^\W\d_]\. $", lead) and before.start("s") - 1 not in ends and not any(x <= before.start("last") < y for x, y in hits):
            person(before.start("s"), b, "sg", given, before["last"], _following(text, b))
            if before.start("s") != before.start("last"):
                person(before.start("last"), b, "sg", given, before["last"], _following(text, b))
    for m in _INITIAL.finditer(text):
        if not any(x < m.end() and m.start() < y for x, y in blocked):
            person(m.start(), m.end("s"), "is", None, m["last"], _following(text, m.end("s")))
    for r in introduced_runs(text, names, said_words):
        # the run ends before the first word that is ordinary elsewhere
        a, parts = r.start(), []
        for part in r[0].split(" "):
            if lexicon.ordinary(part) > 0.3 and not re.fullmatch(_PARTICLE.rstrip("{0,2}") + "?", part + " "):
                break
            parts.append(part)
        while parts and not parts[-1][0].isupper():
            parts.pop()
        b = a + len(" ".join(parts))
        # a listed name behind a comma makes the run its surname, which is proposed with it
        turned = re.match(r",[ ]", text[b : b + 2]) and any(x == b + 2 for x, _ in hits)
        if not parts or turned or any(x < b and a < y for x, y in blocked):
            continue
        capital = [p for p in parts if p[0].isupper()]
        share = min(lexicon.introduced(p) for p in capital)
        votes = [1 if share > 0.5 else -1 if share < 0.2 else 0, 1 if len(capital) > 1 else 0, -1 if any(p.lower() in _ORDINARY for p in capital) else 0]
        add(a, b, "person", votes, [f"run{len(capital)}", f"run|i={int(share * 5)}"], f"r{min(len(capital), 2)}", False)
    return out


def _hashed(features: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(f) % FEATURES for f in features]


def _propose(held, gazetteer: tuple[str, ...]):
    def propose(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, known = Lexicon(*held.value), Gazetteer(gazetteer)

        @lru_cache(maxsize=20_000)  # the same short texts come again and again
        def proposed(text: str) -> tuple | None:
            found = candidates(text, lexicon, known)
            if not found:
                return None
            return [c[0] for c in found], [c[1] for c in found], [KINDS.index(c[2]) for c in found], [f"{c[2]}-{c[3]}:" + ",".join(map(str, c[4])) for c in found], [" ".join(map(str, _hashed(c[5]))) for c in found]

        for pdf in batches:
            rows = []
            for src, rec, text in zip(pdf["src"], pdf["rec_id"], pdf["text"]):
                found = proposed(text) if len(text) <= SHORT else proposed.__wrapped__(text)
                if found:
                    rows.append((src, rec, *found))
            yield pd.DataFrame(rows, columns=["src", "rec_id", "starts", "ends", "kinds", "votes", "features"])

    return propose


_SPANS = "src string, rec_id long, starts array<int>, ends array<int>, kinds array<int>, votes array<string>, features array<string>"


def reliabilities(patterns: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Probability that a span of each vote pattern is personal, by EM per kind.

    Labelers are taken as independent given the truth; a vote of 0 says nothing. Starting from
    a weighted majority, the share of personal spans and each labeler's rates are re-estimated.
    """
    out = {}
    for kind in {p.split(":")[0] for p in patterns}:
        own = [p for p in patterns if p.startswith(kind + ":")]
        votes = np.array([[int(v) for v in p.split(":")[1].split(",")] for p in own])
        count = np.array([patterns[p] for p in own], dtype=float)
        # a single dissent weighs more than an assent: most labelers say no only with a reason
        belief = 1 / (1 + np.exp(-1.5 * (votes.clip(0).sum(axis=1) + 2 * votes.clip(None, 0).sum(axis=1))))
        for _ in range(rounds):
            prior = np.clip((count @ belief) / count.sum(), 0.02, 0.98)
            odds = np.full(len(own), np.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                for v in (-1, 1):
                    at = votes[:, j] == v
                    said = votes[:, j] != 0
                    right = (count[at] @ belief[at] + 1) / (count[said] @ belief[said] + 2)
                    wrong = (count[at] @ (1 - belief[at]) + 1) / (count[said] @ (1 - belief[said]) + 2)
                    odds[at] += np.clip(np.log(right / wrong), -4, 4)
            belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out.update(zip(own, belief))
    return out


def fit(rows: list[tuple[np.ndarray, float]], rounds: int = 120, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression on hashed features with soft labels (Adam, full batch)."""
    weights = np.zeros(FEATURES)
    if not rows:
        return weights
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feature = np.concatenate([f for f, _ in rows])
    label = np.array([y for _, y in rows])
    first, second = np.zeros(FEATURES), np.zeros(FEATURES)
    for step in range(1, rounds + 1):
        score = np.bincount(owner, weights[feature], len(rows))
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - label
        slope = np.bincount(feature, error[owner], FEATURES) / len(rows) + decay * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def choose(starts, ends, kinds, scores) -> list[tuple[int, int, int]]:
    """Spans scored as personal, without overlaps: longer first within a kind, then surer."""
    order = sorted((i for i in range(len(scores)) if scores[i] > 0), key=lambda i: (-(ends[i] - starts[i]) if kinds[i] == 4 else -(10_000 + scores[i]), -scores[i]))
    taken: list[tuple[int, int, int]] = []
    for i in order:
        if all(ends[i] <= a or b <= starts[i] for a, b, _ in taken):
            taken.append((int(starts[i]), int(ends[i]), int(kinds[i])))
    return sorted(taken)


def personal_spans(texts: DataFrame, train_texts: int = TRAIN_TEXTS, gazetteer: tuple[str, ...] = tuple(GIVEN_NAMES)) -> DataFrame:
    """``texts`` (src, rec_id, text) to spans: src, rec_id, start_pos, end_pos, kind.

    ``gazetteer``: given names; it is one labeler, and names that it lacks are found where they are
    introduced.

    Positions count code points, the end is exclusive. Null and empty texts hold none; a text
    that comes twice under one id is reported once. Spans of one text do not overlap.
    """
    spark = texts.sparkSession
    full = texts.filter((F.length("text") > 0) & F.col("rec_id").isNotNull()).select("src", "rec_id", "text")
    lexicon = _lexicon(full, gazetteer)
    spans = stage(full.mapInPandas(_propose(spark.sparkContext.broadcast((lexicon.prints, lexicon.table, lexicon.salt)), gazetteer), _SPANS), "spans")
    patterns = {r[0]: r[1] for r in spans.select(F.explode("votes").alias("v")).groupBy("v").count().collect()}  # at most 3^labelers a kind
    belief = reliabilities(patterns)
    sample = spans.select("votes", "features", F.xxhash64("src", "rec_id").alias("h")).orderBy("h").limit(train_texts)
    rows = [(np.array(f.split(), dtype=np.int64), belief[v]) for r in sample.toLocalIterator() for v, f in zip(r["votes"], r["features"])]
    held = spark.sparkContext.broadcast(fit(rows))

    def decide(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = held.value
        for pdf in batches:
            out = []
            for src, rec, starts, ends, kinds, features in zip(*(pdf[c] for c in ("src", "rec_id", "starts", "ends", "kinds", "features"))):
                scores = [weights[np.array(f.split(), dtype=np.int64)].sum() for f in features]
                out += [(src, rec, a, b, KINDS[k]) for a, b, k in choose(starts, ends, kinds, scores)]
            yield pd.DataFrame(out, columns=["src", "rec_id", "start_pos", "end_pos", "kind"])

    return spans.drop("votes").mapInPandas(decide, "src string, rec_id long, start_pos long, end_pos long, kind string").distinct()


def redacted(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with every span replaced by its kind in brackets: src, rec_id, text.

    Texts without spans, null and empty ones stay as they are; a text delivered twice under one
    id comes out once.
    """
    marks = spans.groupBy("src", "rec_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("m"))
    done = F.aggregate(
        "m",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, (x["start_pos"] - acc["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out"), x["end_pos"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))),
    )
    rows = texts.dropDuplicates(["src", "rec_id"])
    return rows.join(marks, ["src", "rec_id"], "left").select("src", "rec_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(done).alias("text"))
