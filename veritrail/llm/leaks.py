"""Documents that contain passages of held-out evaluation texts.

Method: q-gram lemma filtering. Two strings that agree over a window of w characters with at most
e edits share at least w + 1 - q - q*e q-grams, all on diagonals at most e apart. Shared q-grams
are counted in overlapping diagonal bands; windows that reach the bound are verified by banded
alignment. For exact passages of words, the words of the surviving region are compared last.

Documents are only mapped, never shuffled. The evaluation set is indexed in blocks of a fixed size,
and a pass over the documents takes a fixed number of blocks, each broadcast; what a pass found is
written before the next one begins, so neither the driver nor an executor ever holds more than the
blocks of one pass, whatever the size of the set. Equal texts are indexed once. Texts are indexed
apart by the length of their shortest passage, as that decides how long the grams may be.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from veritrail.operators.shared import stage

#: Characters of evaluation text per broadcast block (about 16 bytes of index each), and blocks that
#: one pass over the documents takes.
BLOCK_CHARS = 2_000_000
PASS_BLOCKS = 8
#: Candidate positions that are looked up at once.
HITS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalised_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram, built from powers of two of its length."""
    if len(codes) < q:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, span, doubled = _BASE, 1, codes + np.uint64(1)
        whole, covered = None, 0
        while True:
            if q & span:
                if whole is None:
                    whole, covered = doubled, span
                else:
                    size = len(codes) - covered - span + 1
                    whole = whole[:size] * power + doubled[covered : covered + size]
                    covered += span
            if covered == q:
                return whole
            doubled = doubled[: len(doubled) - span] * power + doubled[span:]
            power, span = power * power, span * 2


def within_edits(a: str, b: str, edits: int) -> bool:
    """Whether ``a`` equals some prefix of ``b`` within ``edits``, by alignment in a diagonal band."""
    far = edits + 1
    row = {j: j for j in range(edits + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            best = row.get(j, far) + 1
            if j:
                best = min(best, new.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
            new[j] = min(best, far)
        row = new
        if min(row.values(), default=far) > edits:
            return False
    return min(row.values(), default=far) <= edits


class ItemIndex:
    """The q-grams of a block of evaluation texts: hash, then (item, position) postings."""

    def __init__(self, ids: list[int], texts: list[str], words: int, q: int, edits: int):
        self.ids, self.texts, self.words, self.q, self.edits = ids, texts, words, q, edits
        self.passages: list[set[str]] = []
        shortest = 1 << 30
        for text in texts:
            parts = text.split(" ")
            runs = {" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)}
            self.passages.append(runs)
            shortest = min([shortest, *map(len, runs)])
        self.window = shortest
        # the bound must stay positive for the shortest passage; a long q only serves speed
        while self.window + 1 - self.q - self.q * edits < 1 and self.q > 2:
            self.q -= 1
        self.least = max(1, self.window + 1 - self.q - self.q * edits)
        hashes = [gram_hashes(_codes(t), self.q) for t in texts]
        every = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(texts), dtype="int32"), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h), dtype="int32") for h in hashes]) if hashes else np.empty(0, dtype="int32")
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)
        self.starts = np.append(first, len(every)).astype("int64")
        self.item, self.place = item[order], place[order]
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.grams >> np.uint64(42)).astype("int64")] = True

    def hits(self, hashes: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(position, item, item position) of every shared q-gram; null if there are more than ``most``."""
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(42)).astype("int64")])
        at = np.searchsorted(self.grams, hashes[maybe])
        at[at == len(self.grams)] = 0
        good = self.grams[at] == hashes[maybe] if len(self.grams) else np.zeros(0, dtype=bool)
        maybe, at = maybe[good], at[good]
        count = self.starts[at + 1] - self.starts[at]
        total = int(count.sum())
        if most is not None and total > most:
            return None
        rows = np.repeat(self.starts[at], count) + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(maybe, count), self.item[rows], self.place[rows]

    def leaks(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(text number, item number) of all texts that share a passage with an item."""
        if not self.texts or self.window == 1 << 30 or not texts:
            return
        starts, at = [], 0
        for t in texts:
            starts.append(at)
            at += len(t) + 1
        joined = "\x00".join(texts)
        met = self.hits(gram_hashes(_codes(joined), self.q), HITS if len(texts) > 1 else None)
        if met is None:  # grams that many items share: fewer texts at a time
            half = len(texts) // 2
            yield from self.leaks(texts[:half])
            yield from ((d + half, i) for d, i in self.leaks(texts[half:]))
            return
        where, item, place = met
        if not len(where):
            return
        doc = np.searchsorted(np.asarray(starts), where, side="right") - 1
        diagonal = where - place
        # bands of z diagonals overlap by e: a hit near a lower border also counts one band down
        e, z = self.edits, 2 * self.edits + 2
        band = diagonal // z
        again = np.flatnonzero(diagonal - band * z < e)
        band = np.concatenate([band, band[again] - 1])
        doc, item, where = (np.concatenate([x, x[again]]) for x in (doc, item, where))
        diagonal = np.concatenate([diagonal, diagonal[again]])
        order = np.lexsort((where, band, item, doc))
        doc, item, band, where, diagonal = (x[order] for x in (doc, item, band, where, diagonal))
        k = self.least - 1
        n = len(where) - k
        if n <= 0:
            return
        same = (doc[:n] == doc[k:]) & (item[:n] == item[k:]) & (band[:n] == band[k:])
        near = same & (where[k:] - where[:n] <= self.window - self.q + e)
        found: set[tuple[int, int]] = set()
        last: tuple | None = None
        span = [0, 0]
        pending: list[tuple[int, int, int, int]] = []
        for i in np.flatnonzero(near).tolist():
            key = (doc[i], item[i], band[i])
            if key == last and where[i] <= span[1]:
                span[1] = max(span[1], int(where[i + k]))
                pending[-1] = (*pending[-1][:3], span[1])
                continue
            last, span = key, [int(where[i]), int(where[i + k])]
            pending.append((int(doc[i]), int(item[i]), int(where[i]), span[1]))
        for d, it, lo, hi in pending:
            if (d, it) not in found and self._passes(texts[d], lo - starts[d], hi - starts[d] + self.q, it):
                found.add((d, it))
        yield from sorted(found)

    def _passes(self, text: str, lo: int, hi: int, item: int) -> bool:
        """Banded alignment over the region's windows, then the words themselves."""
        source, w, e = self.texts[item], self.window, self.edits
        aligned = False
        for m in range(lo, max(lo + 1, hi - w + 1)):
            gram, p = text[m : m + self.q], -1
            while not aligned and (p := source.find(gram, p + 1)) >= 0:
                size = min(w, len(source) - p)
                aligned = size >= w and within_edits(source[p : p + w], text[m : m + w + e], e)
            if aligned:
                break
        if not aligned:
            return False
        while lo and text[lo - 1] != " ":
            lo -= 1
        while hi < len(text) and text[hi] != " ":
            hi += 1
        parts = text[lo:hi].strip().split(" ")
        runs = self.passages[item]
        return any(" ".join(parts[i : i + self.words]) in runs for i in range(len(parts) - self.words + 1))


def passage_lengths(text: Column, words: int) -> Column:
    """Length of the shortest passage of ``words`` words; null where a text has fewer."""
    parts = F.split(text, " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - words + 1, F.lit(1)))
    return F.when(F.size(parts) >= words, F.array_min(F.transform(starts, lambda i: F.length(F.array_join(F.slice(parts, i, words), " ")))))


def _blocks(items: DataFrame, words: int, q: int, edits: int) -> Iterator[ItemIndex]:
    """``items`` (key, text, shortest) as indexes of at most about ``BLOCK_CHARS`` characters each.

    The grams of a block are as long as its shortest passage allows, at most ``q``. Where there are
    several blocks, texts with much shorter passages than ``q`` asks for are apart, so that they do
    not shorten the grams of all others; one block is hashed once, which costs less.
    """
    apart = q * 2 // 3 * (1 + edits) if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > BLOCK_CHARS else 0
    for mine in (items.filter(F.col("shortest") >= apart), items.filter(F.col("shortest") < apart)):
        keys, texts, held = [], [], 0
        for row in mine.select("key", "text").toLocalIterator():
            keys.append(row[0])
            texts.append(row[1])
            held += len(row[1])
            if held >= BLOCK_CHARS:
                yield ItemIndex(keys, texts, words, q, edits)
                keys, texts, held = [], [], 0
        if keys:
            yield ItemIndex(keys, texts, words, q, edits)


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 13, q: int = 24, edits: int = 1) -> DataFrame:
    """Documents and the items of which they hold at least ``words`` consecutive words.

    Words are runs of letters or digits in lower case. An item of fewer words cannot leak. Null
    texts or ids hold nothing; a repeated document comes out once per item, and items of equal
    text leak together. The window is the length of the shortest passage of ``words`` words in a
    block, so that every exact passage passes the filter; ``q`` is lowered for items whose
    passages are too short for it.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    out = f"`{doc_id}` {kind}, key {items.schema[item_id].dataType.simpleString()}"
    clean = docs.filter(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(doc_id, normalised_words(F.col(text)).alias("_text"))
    known = items.filter(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), normalised_words(F.col(item_text)).alias("text")).distinct()
    known = stage(known.withColumn("shortest", passage_lengths(F.col("text"), words)).filter(F.col("shortest").isNotNull()), "items")
    # equal texts stand as one under the least of their ids
    texts = stage(known.groupBy("text").agg(F.min("item").alias("key"), F.min("shortest").alias("shortest")), "item-texts")
    copies = known.select("text", "item").join(texts.select("text", "key"), "text").select("key", F.col("item").alias(item_id))

    def probing(held: list) -> DataFrame:
        def probe(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                names, said, rows = pdf[doc_id].tolist(), pdf["_text"].tolist(), []
                for block in held:
                    rows += [(names[d], block.value.ids[i]) for d, i in block.value.leaks(said)]
                yield pd.DataFrame(rows, columns=[doc_id, "key"])

        return clean.mapInPandas(probe, out).distinct()

    found, held = [], []
    blocks = _blocks(texts, words, q, edits)
    for index in blocks:
        held.append(spark.sparkContext.broadcast(index))
        if len(held) == PASS_BLOCKS:
            found.append(stage(probing(held), "leaks"))
            for block in held:
                block.destroy()
            held = []
    if held or not found:
        found.append(probing(held))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.join(copies, "key").select(doc_id, item_id).distinct()


def leak_report(found: DataFrame, item_id: str) -> DataFrame:
    """Leaked items and the number of documents that give each away."""
    return found.groupBy(item_id).agg(F.count("*").alias("documents"))
