"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of k edits, an item cut into k + 1 pieces leaves one piece untouched in any passage within the budget.
The pieces of all items form one Aho-Corasick automaton; a piece hit proposes a place, the q-gram lemma discards places that
share too few grams to be within the budget, and Myers' bit-parallel distance decides. Texts and items are compared with
letters lower-cased and white space runs as one space.

Map-only over documents. The items are read in blocks of ``ITEM_CHARS`` characters, one pass a block, so the automaton's size is
bounded whatever the number of items. An empty or null item matches nothing; a null text is an empty text. A piece that is very
frequent proposes many places, each is checked, none is dropped. An item_id with several texts is found by any of them; rows that
repeat are searched once each; other columns pass through, and one called like the result is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import appended, fresh, staged

#: Edits allowed a character of an item; characters of items in one automaton; length of the grams of the lemma.
ERROR_RATE, ITEM_CHARS, GRAM = 0.1, 4_000_000, 5
#: Blocks of items that are worked through in one chain of workers.
CHAINED = 2


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(rate * len(item))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces that cover the item, of lengths that differ by one at most."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def myers(peq: dict[str, int], m: int, text: str, most: int) -> int:
    """The least edits between the whole item and any part of text, or most + 1 if there are more."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, left = full, 0, m, min(m, most + 1), len(text)
    for c in text:
        left -= 1
        eq = peq.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (full & ~(xh | vp))
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        if score - left >= best:
            break
        hp <<= 1
        vp = (hn << 1 | ~(xv | hp)) & full
        vn = hp & xv
    return min(best, most + 1)


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items, where = [], defaultdict(list)
        for item_id, text in items:
            if not (t := normalised(text)):
                continue
            k = budget(t, rate)
            grams = defaultdict(int)
            for i in range(len(t) - GRAM + 1):
                grams[t[i : i + GRAM]] += 1
            need = len(t) - GRAM + 1 - k * GRAM
            self.items.append((item_id, t, k, masks(t), frozenset(grams), need))
            for at, p in pieces(t, k):
                where[p].append((len(self.items) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for p, hits in where.items():
            self.automaton.add_word(p, (len(p), hits))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, edits) of every item that the text holds within its budget, by item_id."""
        if self.empty or not text:
            return []
        t = normalised(text)
        places: dict[int, set[int]] = defaultdict(set)
        for end, (n, hits) in self.automaton.iter(t):
            for item, at in hits:
                places[item].add(end - n + 1 - at)
        out = []
        for item, starts in places.items():
            item_id, own, k, peq, grams, need = self.items[item]
            best = k + 1
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(t), s + len(own) + k)
                if t.startswith(own, max(0, s)):
                    best = 0
                    break
                w = t[a:b]
                if need > 0 and sum(w[i : i + GRAM] in grams for i in range(len(w) - GRAM + 1)) < need:
                    continue
                best = min(best, myers(peq, len(own), w, k))
            if best <= k:
                out.append((item_id, best))
        return sorted(out)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows, size = [], 0
    for r in items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if size >= ITEM_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def matches(documents: DataFrame, items: DataFrame, column: str = "items", rate: float = ERROR_RATE) -> DataFrame:
    """documents with an array of (item_id, edits): the benchmark items that a text holds. Every ``CHAINED`` blocks of items the result is written
    out, so that no more workers of a chain live at once."""
    kind = "array<struct<item_id:bigint,edits:int>>"
    out = documents.drop(column).withColumn(column, F.array().cast(kind))
    for n, rows in enumerate(_blocks(items)):
        if n and n % CHAINED == 0:
            out = staged(out)

        def make(rows=rows):
            m = Matcher(rows, rate)
            return lambda texts, had: [[[*h, *({"item_id": i, "edits": e} for i, e in m.find(t))] for t, h in zip(texts, had)]]

        out = appended(out, f"`{column}` {kind}", make, ("text", column))
    return out


def clean(documents: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = fresh("items", documents)
    return matches(documents, items, found, rate).filter(F.size(found) == 0).drop(found)


def query(documents: DataFrame, items: DataFrame) -> DataFrame:
    found = matches(documents.select("doc_id", "text"), items, "items").drop("text")
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.col("items.item_id").alias("item_ids"), F.array_min("items.edits").alias("least_edits"))
