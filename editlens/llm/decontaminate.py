"""Benchmark passages in documents, with a few edits: pigeonhole pieces, exact hits, Myers bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of a passage.
ERROR_RATE = 0.06
#: Passages (and their characters) a pass over the documents looks for; more passages take more passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
SLICE = 1 << 20
NO_WORD = re.compile(r"[\W_]+")
FOUND = "array<struct<item: long, distance: int>>"


def plain(text: str | None) -> str:
    """Lower case; anything but letters and digits is one space."""
    return NO_WORD.sub(" ", (text or "").lower()).strip()


class Pattern:
    """A passage with its error budget, its pieces and the letter masks of Myers' algorithm."""

    def __init__(self, item: int, text: str, rate: float):
        self.item, self.text, self.budget = item, text, int(len(text) * rate)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def pieces(self) -> Iterator[tuple[int, str]]:
        """Budget plus one pieces: an occurrence within the budget leaves one of them whole."""
        n, length = self.budget + 1, len(self.text)
        for i in range(n):
            begin, end = length * i // n, length * (i + 1) // n
            yield begin, self.text[begin:end]

    def distance(self, text: str) -> int:
        """Smallest edit distance of the passage to any substring of the text."""
        length = len(self.text)
        full, top = (1 << length) - 1, 1 << (length - 1)
        plus, minus, score, best = full, 0, length, length
        for c in text:
            equal = self.masks.get(c, 0)
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | (full & ~(across | plus)), plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                best = min(best, score)
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(vertical | up)), up & vertical
        return best


class Finder:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.patterns = [Pattern(i, t, rate) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for p, pattern in enumerate(self.patterns):
            for begin, piece in pattern.pieces():
                places.setdefault(piece, []).append((p, begin))
        self.words = ahocorasick.Automaton()
        for piece, where in places.items():
            self.words.add_word(piece, (len(piece), where))
        self.words.make_automaton()
        self.reach = max((len(p.text) + p.budget for p in self.patterns), default=0)

    def find(self, text: str | None) -> dict[int, int]:
        """Smallest distance of each passage that the text holds within its budget."""
        found: dict[int, int] = {}
        whole = plain(text)
        for at in range(0, max(1, len(whole)), SLICE):
            self._find(whole[at : at + SLICE + self.reach], found)
        return found

    def _find(self, text: str, found: dict[int, int]) -> None:
        seen: set[tuple[int, int]] = set()
        for end, (size, where) in self.words.iter(text):
            for p, begin in where:
                pattern = self.patterns[p]
                start = end + 1 - size - begin
                if found.get(p) == 0 or (p, start) in seen:
                    continue
                seen.add((p, start))
                if start >= 0 and text.startswith(pattern.text, start):
                    found[p] = 0
                elif pattern.budget:
                    low = max(0, start - pattern.budget)
                    distance = pattern.distance(text[low : start + len(pattern.text) + pattern.budget])
                    if distance <= pattern.budget:
                        found[p] = min(distance, found.get(p, distance))


def blocks(items: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int, str]]]:
    """The passages in lists of bounded size; the driver holds one list at a time."""
    block, size = [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        passage = plain(row["t"])
        if not passage or row["i"] is None:
            continue
        if block and (len(block) == BLOCK_ITEMS or size + len(passage) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((row["i"], passage))
        size += len(passage)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """Add ``leaks``: an array of ``(item, distance)``, by item, for every passage that a row's whole text holds.

    Text and passages are compared in lower case, with anything but letters and digits as one space. A passage of n
    characters may have up to n x rate edits. Passages without a letter or digit and those with a null id are left
    out; passages of one id count once, with the smallest distance. Null and empty texts have no leaks; repeated rows
    are treated alike; all other columns stay (a column ``leaks`` is replaced). Each block of passages is one pass
    over the documents, with an automaton of bounded size.
    """
    result = docs.drop("leaks").withColumn("leaks", F.array().cast(FOUND))
    for block in blocks(items, item_text, item_id):
        result = result.withColumn("leaks", F.concat("leaks", _search(block, rate)(F.col(text))))
    return result.withColumn("leaks", _smallest(F.col("leaks")))


def _search(block: list[tuple[int, str]], rate: float):
    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(block, rate)
        for texts in batches:
            yield pd.Series([[{"item": finder.patterns[p].item, "distance": d} for p, d in finder.find(t).items()] for t in texts])

    return search


def _smallest(leaks):
    """One entry an item: entries are sorted by item and distance, and the first of an item stays."""
    ordered = F.array_sort(leaks)
    return F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["item"] != x["item"]))
