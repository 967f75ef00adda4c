"""Evaluation texts leaking into training text.

The test items' words form a generalised suffix automaton. It is built once, on the driver,
and broadcast as flat arrays, which each worker process opens once and turns into tables
only for the states it visits. Words of the training text stream through it, and the length
of the longest match that ends at each word is tracked. Where it reaches the limit, the
items that hold those words are reported. A word that no item has ends every match, so only
runs of known words are streamed. An automaton holds a bounded number of words; all items
of an ordinary evaluation fit one, and the documents pass it once. More items make further
automata, each with its pass over the documents and gone after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kenmark.plans.scratch import materialise

#: A word is a run of ASCII letters, digits and underscores, in lower case.
WORD = re.compile(rb"[a-z0-9_]+")
#: Words of items that one automaton holds at most; a longer item is cut into segments that overlap.
WORDS_PER_BLOCK = 500_000


def words(text: str) -> list[bytes]:
    """bytes.lower touches ASCII letters only, as the definition wants it."""
    return WORD.findall(text.encode("utf-8", "replace").lower())


class SuffixAutomaton:
    """Of several sequences of words, as flat arrays; a state knows the items that hold its words."""

    def __init__(self, items: list[tuple[object, list[bytes]]], least: int) -> None:
        self.number: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        coded = [[self.number.setdefault(w, len(self.number)) for w in text] for _, text in items]
        steps, link, length = _build(coded)
        holders: list[list[int]] = [[] for _ in length]
        for item, text in enumerate(coded):
            state = 0
            for c in text:
                state = at = steps[state][c]
                # Items come one after the other, so the last holder tells whether this one is known.
                while at > 0 and (not holders[at] or holders[at][-1] != item):
                    holders[at].append(item)
                    at = link[at]
        # The shortest suffix of at least `least` words is held by the most items.
        order = sorted(range(len(length)), key=length.__getitem__)
        shortest = [0] * len(length)
        for state in order:
            if length[state] >= least:
                up = link[state]
                shortest[state] = shortest[up] if length[up] >= least else state
        self.link, self.length, self.shortest = (np.array(x, np.int32) for x in (link, length, shortest))
        self.at = np.cumsum([0, *map(len, steps)], dtype=np.int64)
        self.symbols = np.fromiter((c for step in steps for c in step), np.int32, self.at[-1])
        self.targets = np.fromiter((t for step in steps for t in step.values()), np.int32, self.at[-1])
        kept = [holders[s] if shortest[s] == s and s else [] for s in range(len(length))]
        self.held_at = np.cumsum([0, *map(len, kept)], dtype=np.int64)
        self.held = np.fromiter((i for x in kept for i in x), np.int32, self.held_at[-1])
        self.steps: dict[int, dict[int, int]] = {}
        self.ups: list[int] | None = None

    @classmethod
    def of(cls, state: dict) -> SuffixAutomaton:
        """From the attributes of one, of which a broadcast holds a copy per worker process; so do the tables that are opened."""
        found = cls.__new__(cls)
        found.__dict__ = state
        return found

    def step(self, state: int) -> dict[int, int]:
        """The transitions of a state, as a table that is kept."""
        found = self.steps.get(state)
        if found is None:
            part = slice(self.at[state], self.at[state + 1])
            found = self.steps[state] = dict(zip(self.symbols[part].tolist(), self.targets[part].tolist()))
        return found

    def items(self, state: int) -> list:
        """The items that hold at least ``least`` words which end a match in this state."""
        at = self.shortest[state]
        return [self.names[i] for i in self.held[self.held_at[at] : self.held_at[at + 1]].tolist()]

    def matches(self, coded: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest match that ends at each place."""
        if self.ups is None:
            self.ups, self.lengths = self.link.tolist(), self.length.tolist()
        state, length = 0, 0
        for place, c in enumerate(coded):
            while (to := self.step(state).get(c)) is None and state:
                state = self.ups[state]
                length = self.lengths[state]
            if to is not None:
                state = to
                length += 1
            yield place, state, length


def _build(texts: list[list[int]]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """(transitions, suffix links, lengths) of the generalised suffix automaton, by adding word after word."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def split(at: int, c: int, state: int) -> int:
        """The state whose longest words are those of ``at`` and ``c``, taken out of ``state`` if it holds longer ones."""
        if length[state] == length[at] + 1:
            return state
        steps.append(dict(steps[state]))
        link.append(link[state])
        length.append(length[at] + 1)
        link[state] = copy = len(length) - 1
        while at >= 0 and steps[at].get(c) == state:
            steps[at][c] = copy
            at = link[at]
        return copy

    for text in texts:
        last = 0
        for c in text:
            if c in steps[last]:
                last = split(last, c, steps[last][c])
                continue
            steps.append({})
            link.append(0)
            length.append(length[last] + 1)
            new, at = len(length) - 1, last
            while at >= 0 and c not in steps[at]:
                steps[at][c] = new
                at = link[at]
            if at >= 0:
                link[new] = split(at, c, steps[at][c])
            last = new
    return steps, link, length


def known_runs(coded: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of at least ``least`` words that items have."""
    bounds = np.flatnonzero(np.r_[True, coded < 0, True])
    long = np.flatnonzero(np.diff(bounds) > least)
    return [(int(bounds[i]), int(bounds[i + 1]) - 1) for i in long]


def find_spans(automaton: SuffixAutomaton, text: str, least: int) -> list[tuple[int, int, int]]:
    """(item, first word, end word) of the matches of at least ``least`` words that can't be extended."""
    found = words(text)
    if len(found) < least:
        return []
    coded = np.fromiter(map(automaton.number.get, found, repeat(-1)), np.int64, len(found))
    spans: dict[tuple[int, int], int] = {}
    for start, end in known_runs(coded, least):
        for place, state, length in automaton.matches(coded[start:end].tolist()):
            if length >= least:
                first, last = start + place - length + 1, start + place + 1
                for item in automaton.items(state):
                    spans[item, first] = max(spans.get((item, first), 0), last)
    return [(item, first, last) for (item, first), last in spans.items()]


def item_blocks(items: DataFrame, key: str, text: str, least: int, words_per_block: int = WORDS_PER_BLOCK) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items in blocks of at most ``words_per_block`` words; they are read one after the other.

    A longer item is cut into segments that share ``least - 1`` words, so that no run of
    ``least`` words is lost.
    """
    block: list[tuple[object, list[bytes]]] = []
    size, most = 0, max(words_per_block, 2 * least)
    for row in items.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).dropDuplicates().toLocalIterator():
        own = words(row[1])
        for start in range(0, max(len(own) - least + 1, 1), most - least + 1):
            part = own[start : start + most]
            if block and size + len(part) > words_per_block:
                yield block
                block, size = [], 0
            block.append((row[0], part))
            size += len(part)
    if block:
        yield block


def leaked_spans(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 12, words_per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """(key, item key, first_word, end_word) of each maximal run of at least ``least`` words that a document shares with an item.

    ``end_word`` is exclusive; places count the document's words from 0. An item reported
    for a run holds at least ``least`` words that end within it. A run that crosses segments
    of a cut item gives overlapping spans. Null keys and texts give nothing, nor do items
    with fewer words; repeated rows count once per copy.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    item_kind = items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, first_word int, end_word int"
    names = pa.schema([(item_key, to_arrow_type(items.schema[item_key].dataType))])
    rows = documents.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    parts: list[DataFrame] = []
    blocks = item_blocks(items, item_key, item_text, least, words_per_block)
    block = next(blocks, None)
    while block is not None:
        held = spark.sparkContext.broadcast(SuffixAutomaton(block, least).__dict__)
        block = next(blocks, None)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton.of(held.value)
            for batch in batches:
                rows = []
                for place, body in enumerate(batch.column(1).to_pylist()):
                    rows += [(place, *span) for span in find_spans(automaton, body, least)]
                if rows:
                    places, found, first, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array(found, names.field(0).type), pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=[key, item_key, "first_word", "end_word"])

        part = rows.mapInArrow(scan, schema)
        if block is not None or parts:
            # Of several automata only one is held at a time.
            part = materialise(part, "spans")
            held.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def without_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 12, most_coverage: float = 0.5) -> DataFrame:
    """(key, text, leaked_words, n_words): texts without the leaked runs.

    Of a document whose leaked words are more than ``most_coverage`` of all its words the
    text becomes empty. Documents without leaks keep their text, whatever it is.
    """
    spans = leaked_spans(documents, key, text, items, item_key, item_text, least)
    per = spans.groupBy(key).agg(F.collect_set(F.struct("first_word", "end_word")).alias("_spans"))
    fields = f"`{key}` {documents.schema[key].dataType.simpleString()}, `{text}` string, leaked_words int, n_words int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (body or "").encode("utf-8", "replace")
                at = [m.span() for m in WORD.finditer(raw.lower())]
                gone = np.zeros(len(at), bool)
                for span in spans or []:
                    gone[span["first_word"] : span["end_word"]] = True
                n = int(gone.sum())
                if n > most_coverage * len(at):
                    body = ""
                elif n:
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
                    kept, begin = [], 0
                    for a, b in zip(edges[::2], edges[1::2]):
                        kept.append(raw[begin : at[a][0]])
                        begin = at[b - 1][1]
                    body = b"".join([*kept, raw[begin:]]).decode()
                out.append((body, n, len(at)))
            bodies, leaked, n_words = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(leaked, pa.int32()), pa.array(n_words, pa.int32())], names=[key, text, "leaked_words", "n_words"])

    return documents.select(key, text).join(per, key, "left").mapInArrow(cut, fields)
