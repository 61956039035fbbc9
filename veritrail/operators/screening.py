"""Screening of text and claims against a declarative rule set.

Text is read as a row of tokens, every token is reduced to the letter of its word class, and the
rules are short patterns over these letters. A rule thus speaks of classes and distances in words
("a verb of dismissal, at most eight words, an earlier thing, at most four, an order") and never of
spellings; the same letters can be made by any SQL engine.
"""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrail.functions.text import let, predicate_key

#: Word classes. A word is in one class; what is in none is no part of any rule.
CLASSES = {
    "as": "as", "i": "i", "be": "am is are", "a": "a an", "the": "the", "your": "your", "own": "my", "its": "its", "this": "this these following", "that": "that what whatever", "of": "of over", "on": "on", "now": "now", "from": "from", "to": "to into",
    "you": "you", "me": "me", "not": "not dont never wont", "new": "new", "there": "there", "none": "none no", "must": "must will shall should", "behalf": "behalf", "someone": "someone anyone anybody",
    "role": "owner administrator admin principal operator root superuser", "system": "system", "user": "user", "helper": "assistant agent", "account": "account profile",
    "speak": "speaking writing acting", "regard": "treat mark consider", "authority": "trust authority clearance privilege privileges permission permissions tier access priority", "level": "level rank status",
    "lift": "raise elevate escalate upgrade grant", "sure": "verified trusted confirmed authoritative authenticated official", "high": "high highest max maximum full top 3", "sign": ": =",
    "message": "message statement memo notice", "note": "note notes", "order": "instruction instructions directive directives rule rules prompt prompts direction directions guideline guidelines command commands", "part": "persona task",
    "memory": "memory memories", "belief": "knowledge belief beliefs", "context": "context history", "fact": "fact facts information", "record": "record records entry entries data file", "secret": "secret secrets credential credentials password passwords", "stored": "stored saved", "whole": "entire whole", "allergy": "allergy allergies",
    "dismiss": "ignore discard override overwrite", "disregard": "disregard", "earlier": "previous prior earlier above preceding", "all": "all any everything", "forget": "forget", "know": "know knew learned learnt told remembered", "remember": "remember", "always": "always only",
    "answer": "answer reply respond say state tell", "when": "when whenever if", "asked": "asked queried questioned", "hide": "mention", "show": "reveal disclose dump output print repeat list enumerate export", "update": "update rewrite", "keep": "add write save store commit",
    "send": "send email mail post upload forward transmit exfiltrate leak publish share sync report", "link": "§link", "mailbox": "§mail", "markup": "§mark", "stop": ". ! ?", "line": "§line",
}
#: One letter for each class, in their order; ``x`` is a word of no class.
OTHER = "x"
LETTERS = dict(zip(CLASSES, (c for c in string.ascii_letters + string.digits + "αβγδεζηθικλμνξοπρστυφχψω" if c != OTHER)))

#: Content rules in the order in which they are tried: name, highest rank it applies to, what it is
#: about, why it refuses, and its patterns. In a pattern ``a/b`` is a choice of classes, ``?`` makes
#: it optional, ``..n`` skips up to n words of one sentence, ``^`` is the start of a line, ``!a`` a
#: start of text or a word of any other class, and HERE is true unless an "of" leads to something
#: other than this memory.
RULES: tuple[tuple[str, int, str, str, tuple[str, ...]], ...] = (
    (
        "self-elevation", 3, "text that claims a rank for itself", "The text claims an authority that its channel does not have.", (
            "as the/your system? role HERE", "i be the/your system? role HERE", "speak as the system? role/user/system", "speak on behalf of the system? role/user/system",
            "regard this/me as the? role/sure", "authority level? sign/be role/system/sure/high", "this/that be a sure/system fact/message/note/order/memory/update", "sure fact/message/note from the role/user/system",
            "message/note/order from the system? role", "lift own/this/the authority",
        ),
    ),
    (
        "instruction-injection", 3, "orders that would rewrite the memory or how it behaves", "The text gives orders to the memory, which no fact has to do.", (
            "dismiss/disregard ..6 earlier/all/the ..3 order/context/memory/fact", "disregard the? earlier/all", "!not forget all", "!not forget that you know/remember", "!not forget that you x know/stored",
            "from now on ..5 always/not/remember/regard/answer/dismiss/disregard/forget", "from now on ..3 you must/be", "your new system? order/part/role", "system order be/sign", "^ system/helper/user sign",
            "system sign you/dismiss/disregard/forget/new/always/not/update/remember", "markup", "update your/the/its/stored stored? memory/note/record/belief/fact", "keep the? this to your memory/note/record",
        ),
    ),
    (
        "answer-shaping", 2, "text that scripts what is to be said when asked", "The source scripts an answer instead of stating a fact; only the owner leaves standing orders.", (
            "when you/someone? be? asked ..9 answer", "always answer", "answer that there be none", "not hide/show/answer ..6 record/fact/memory/allergy",
        ),
    ),
    (
        "exfiltration", 3, "orders to hand out what the memory holds", "The text asks for an action on the memory instead of stating a fact.", (
            "send ..6 your whole? stored? memory/fact/note/record/context/belief", "show ..6 all of? the/your? stored? fact/memory/record/secret/note", "show ..6 the stored fact/memory/record/secret/note", "show ..6 your whole? memory/context/order", "show ..6 your system order",
            "send ..7 memory/fact/record/note/secret/context ..6 link/mailbox",
        ),
    ),
)
#: Rules on claims rather than on text.
STRUCTURAL = (
    ("identity-forgery", 1, "a claim of low rank about who the principal is", "A source of this rank cannot say who the principal is."),
    ("tier-floor", 3, "a write that acts on a claim which outranks it", "A claim may not act on one that outranks it."),
)

#: How a writer refers to the person whose memory it is.
PRINCIPALS = ("i", "me", "my", "myself", "user", "the user", "owner", "the owner", "principal", "the principal", "account holder", "the account holder")
#: Slots that say who someone is, what they prefer, or how to be them.
IDENTITY = """
name full_name first_name last_name nickname username handle alias identity is_a role title job_title occupation employer
works_at works_for lives_in home home_address address email email_address phone phone_number age birthday birth_date
date_of_birth dob gender pronouns nationality citizenship religion prefers preference preferences likes dislikes wants
password passcode passphrase pin api_key apikey access_token token secret credential credentials account account_number
bank bank_account card card_number wallet wallet_address ssn passport license licence login security_question recovery_email
""".split()
#: The first words of further such slots, and the parts that make a slot a credential.
IDENTITY_STARTS = "preferred favorite favourite primary current default main usual home".split()
CREDENTIAL_PARTS = "password passcode passphrase api_key apikey access_token secret credential otp 2fa mfa seed_phrase private_key recovery".split()


def _compatible() -> tuple[str, str]:
    """Characters that compatibility normalisation makes another single one, and these."""
    pairs = [(chr(c), n) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _expanding() -> list[tuple[str, str]]:
    """Ligatures of letters and what they stand for."""
    return [(chr(c), n) for c in range(0xFB00, 0xFB07) if len(n := unicodedata.normalize("NFKC", chr(c))) > 1] + [("…", "...")]


#: Quotes, dashes and apostrophes, and their plain forms.
QUOTES, PLAIN_QUOTES = "‘’‚‛“”′–—−ʼ`", "''''\"\"'---''"
_FROM, _TO = _compatible()


def normalised(text: Column) -> Column:
    """Compatibility forms folded, format characters dropped, quotes plain, horizontal space squeezed."""
    x = F.translate(F.coalesce(text, F.lit("")), _FROM, _TO)
    for ligature, letters in _expanding():
        x = F.replace(x, F.lit(ligature), F.lit(letters))
    x = F.translate(F.regexp_replace(x, r"\p{Cf}", ""), QUOTES, PLAIN_QUOTES)
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\S\n]+", " "), r"\n{2,}", "\n"))


#: What becomes a token of its own before the words are read: pattern, token.
MARKS = (
    (r"https?://\S+", " §link "), (r"[\w.+-]+@[\w-]+\.[\w.-]+", " §mail "), (r"<\s*/?\s*system\s*>|\[\s*/?\s*inst\s*\]|<\|\s*im_(?:start|end)\s*\|>", " §mark "),
    (r"\n\s*", " §line "), (r"\b(i|you)'(?:m|re)\b", "$1 are"), (r"'", ""),
)
TOKEN = r"§[a-z]+|[\p{L}\p{N}]+|[.!?:=]"


def class_letters(text: Column) -> Column:
    """The word classes of a text as a row of letters."""
    x = F.lower(normalised(text))
    for pattern, token in MARKS:
        x = F.regexp_replace(x, pattern, token)
    known = [w for words in CLASSES.values() for w in words.split()]

    def letter(w: Column) -> Column:
        out = F.when(~w.isin(*known), OTHER)
        for name, words in CLASSES.items():
            out = out.when(w.isin(*words.split()), LETTERS[name])
        return out

    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f"({TOKEN})"), F.lit(1)), letter), "")


def letter_pattern(rule: str) -> str:
    """A rule's pattern as a regular expression over class letters, without lookaround."""
    ends = LETTERS["stop"] + LETTERS["line"]
    out = ""
    for part in rule.split():
        if part.startswith(".."):
            out += f"[^{ends}]{{0,{part[2:]}}}?"
        elif part == "^":
            out += f"(?:^|{LETTERS['line']})"
        elif part == "HERE":
            here = "".join(LETTERS[n] for n in ("account", "memory", "system", "record", "helper"))
            out += f"(?:$|[^{LETTERS['of']}]|{LETTERS['of']}[{LETTERS['the']}{LETTERS['your']}{LETTERS['this']}]?[{here}])"
        elif part.startswith("!"):
            out += f"(?:^|[^{LETTERS[part[1:]]}])"
        else:
            names = part.rstrip("?").split("/")
            out += "[" + "".join(OTHER if n == "x" else LETTERS[n] for n in names) + "]" + "?" * part.endswith("?")
    return out


def rule_pattern(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{letter_pattern(p)})" for p in patterns)


def screened(text: Column, rank: Column | None = None) -> Column:
    """The first content rule that the text trips at its rank, or null; without a rank all count."""

    def first(letters: Column) -> Column:
        out = None
        for name, highest, _, _, patterns in RULES:
            hit = letters.rlike(rule_pattern(patterns))
            if rank is not None and highest < 3:
                hit = hit & (F.coalesce(rank, F.lit(0)) <= highest)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    return let(class_letters(text), first)


def states_identity(predicate: Column) -> Column:
    """A slot that states identity, preference or a credential."""
    starts = "|".join(IDENTITY_STARTS)
    parts = "|".join(CREDENTIAL_PARTS)
    return let(predicate_key(predicate), lambda key: (key != "") & (key.isin(*IDENTITY) | key.rlike(f"^({starts})_.") | key.rlike(parts)))


def forges_identity(rank: Column, subject: Column, predicate: Column, aliases: tuple[str, ...] = ()) -> Column:
    """A claim of low rank about who the principal is; ``aliases`` are further names of theirs."""
    return (F.coalesce(rank, F.lit(0)) <= 1) & F.lower(F.trim(subject)).isin(*PRINCIPALS, *(a.strip().lower() for a in aliases)) & states_identity(predicate)


def below_floor(rank: Column, target_rank: Column, op: Column) -> Column:
    """A write that acts on a fact which outranks it."""
    return op.isin("supersede", "retract", "contradict") & target_rank.isNotNull() & (rank < target_rank)


def admission(text: Column, object_: Column, rank: Column, subject: Column, predicate: Column, target_rank: Column, op: Column, strict: bool = True, aliases: tuple[str, ...] = ()) -> Column:
    """A struct of admitted, status, rule and reason for one write.

    The first that fires decides: the claim's text, its object, identity forgery, the tier floor.
    Text is screened without a rank here, so that every content rule counts. If not ``strict`` a
    write that trips a rule is admitted and only carries the rule's name.
    """
    rule = F.coalesce(screened(text), screened(object_), F.when(forges_identity(rank, subject, predicate, aliases), "identity-forgery"), F.when(below_floor(rank, target_rank, op), "tier-floor"))

    def decided(r: Column) -> Column:
        why = F.when(r.isNull(), "")
        for name, *_, reason in [(n, reason) for n, _, _, reason, _ in RULES] + [(n, reason) for n, _, _, reason in STRUCTURAL]:
            why = why.when(r == name, reason)
        admitted = r.isNull() if strict else F.lit(True)
        return F.struct(admitted.alias("admitted"), F.when(admitted, "active").otherwise("quarantined").alias("status"), F.coalesce(r, F.lit("")).alias("rule"), why.alias("reason"))

    return let(rule, decided)


def rule_table(spark: SparkSession) -> DataFrame:
    """The rule set as data: position, rule, kind, max_rank, summary, reason, patterns."""
    rows = [(i, name, "content", highest, summary, reason, "; ".join(patterns)) for i, (name, highest, summary, reason, patterns) in enumerate(RULES)]
    rows += [(len(RULES) + i, name, "structural", highest, summary, reason, "") for i, (name, highest, summary, reason) in enumerate(STRUCTURAL)]
    return spark.createDataFrame(rows, "position int, rule string, kind string, max_rank int, summary string, reason string, patterns string")


def rule_position(rule: Column) -> Column:
    """Where a rule stands in the order in which rules are tried."""
    names = [n for n, *_ in RULES] + [n for n, *_ in STRUCTURAL]
    return F.array_position(F.array(*(F.lit(n) for n in names)), rule)
