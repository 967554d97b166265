"""Benchmark items inside documents, up to an edit distance.

An item with an error budget of k is cut into k + 1 pieces. Where it occurs with at most k edits, one piece is
untouched, so exact hits of pieces are the only places to look at; each is verified with Myers' bit-parallel
distance. Both sides are compared in lower case with white space as one blank.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creaseline.llm.common import slices, texts

BLOCK = 1 << 20  # characters of items that one scan of the documents looks for


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, rate: float, least: int = 0) -> int:
    """Edits that an item may differ by; none under ``least`` characters."""
    return int(length * rate) if length >= least else 0


def bare(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` ends inside no word on either side."""
    return all(not (text[i - 1].isalnum() and text[i].isalnum()) for i in (start, end) if 0 < i < len(text))


def cut(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of near equal length, with their places."""
    bounds = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


class Pattern:
    """Myers' automaton of one item: the distance of the best match that ends at each place of a text."""

    def __init__(self, item: str):
        self.length = len(item)
        self.full = (1 << self.length) - 1
        self.top = 1 << (self.length - 1)
        self.places: dict[str, int] = defaultdict(int)
        for i, char in enumerate(item):
            self.places[char] |= 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Smallest distance of the item to any substring, and the first end (exclusive) where it is reached."""
        plus, minus, score = self.full, 0, self.length
        lowest, end = score, 0
        places, full, top = self.places, self.full, self.top
        for i, char in enumerate(text):
            match = places.get(char, 0)
            vertical = match | minus
            horizontal = (((match & plus) + plus) ^ plus) | match
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < lowest:
                    lowest, end = score, i + 1
            up = (up << 1) & full  # a match may begin anywhere, so nothing is carried in
            plus = ((down << 1) & full) | (full & ~(vertical | up))
            minus = up & vertical
        return lowest, end


class Finder:
    """The items of one block.

    A hit is verified from the piece upwards: neighbouring pieces are joined two by two, and a run of m pieces may
    hold m - 1 errors. Some untouched piece passes on every level up to the whole item if the item is there at all
    (else each half of a run would be over its share), and a chance hit ends at the first level.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int = 0):
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.errors = [budget(len(t), rate, least) for t in self.texts]
        self.short = [len(t) < least for t in self.texts]
        self.patterns: dict[tuple[int, int, int], Pattern] = {}
        self.bounds: list[list[int]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, item in enumerate(self.texts):
            own = cut(item, self.errors[n])
            self.bounds.append([a for a, _ in own] + [len(item)])
            for j, (_, piece) in enumerate(own):
                pieces[piece].append((n, j))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, owners)
        self.automaton.make_automaton()

    def _pattern(self, n: int, a: int, b: int) -> Pattern:
        if (n, a, b) not in self.patterns:
            if len(self.patterns) > 100_000:
                self.patterns.clear()
            self.patterns[n, a, b] = Pattern(self.texts[n][a:b])
        return self.patterns[n, a, b]

    def _verify(self, text: str, n: int, j: int, start: int) -> tuple[int, int] | None:
        """Distance and end of item ``n`` where its piece ``j`` is untouched and the item would begin at ``start``."""
        runs, low, high = [], 0, len(self.bounds[n]) - 1
        while high - low > 1:
            runs.append((low, high))
            middle = (low + high) // 2
            low, high = (low, middle) if j < middle else (middle, high)
        best = None
        for low, high in reversed(runs or [(0, 1)]):
            a, b, errors = self.bounds[n][low], self.bounds[n][high], high - low - 1
            begin = max(0, start + a - errors)
            distance, end = self._pattern(n, a, b).best(text[begin : start + b + errors])
            if distance > errors:
                return None
            best = distance, begin + end
        return best

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``item_id, distance, end`` for each item within its budget."""
        found: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
        for last, owners in self.automaton.iter(text):
            for n, j in owners:
                start = last + 1 - self.bounds[n][j + 1]
                if self.short[n]:  # the piece is the whole item
                    if n not in found and bare(text, start, last + 1):
                        found[n][start] = 0, last + 1
                    continue
                if start not in found[n] and (match := self._verify(text, n, j, start)):
                    found[n][start] = match
        for n, matches in found.items():
            if matches:
                yield self.ids[n], *min(matches.values())


def _blocks(items: DataFrame, least: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, streamed through the driver."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select("item_id", "text").where("text is not null").toLocalIterator():
        item = normal(row["text"])
        if len(item) < least:
            continue
        if block and size + len(item) > BLOCK:
            yield block
            block, size = [], 0
        block.append((row["item_id"], item))
        size += len(item)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.1, least: int = 40, short: bool = False) -> DataFrame:
    """``doc_id, item_id, distance, budget, end_char`` for each document and item that occurs in it.

    An item of n characters may differ by ``rate`` times n edits; one under ``least`` characters is left out or, with
    ``short``, may differ by none and must not begin or end inside a word. Null and empty texts hold no item; repeated rows give repeated rows; without items the result is
    empty. Items go out in blocks, one scan of the documents each, so no broadcast grows with the benchmark.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, distance int, budget int, end_char long"
    found = None
    for block in _blocks(items, 1 if short else least):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            finder = Finder(sent.value, rate, least)
            of = dict(zip(finder.ids, finder.errors, strict=True))
            for batch in slices(batches):
                ids, rows = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for item, distance, end in finder.find(normal(text)):
                        ids.append(i)
                        rows.append((item, distance, of[item], end))
                if rows:
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), *cols], names)

        names = ["doc_id", "item_id", "distance", "budget", "end_char"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        part = texts(docs).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found
