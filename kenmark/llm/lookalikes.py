"""Visually identical text in one consistent form.

Tokens that hold a non-ASCII character are counted over all documents; the most frequent
spellings form the vocabulary, a trie, and each that reads as ASCII brings its ASCII
spelling along. Every token with a non-ASCII character is run through the trie by a
weighted edit automaton: a look-alike letter, full-width form, combining or composed accent
and an ignorable character cost nothing, any other edit costs one, and the limit is zero
unless a caller raises it. Of the spellings reached at the least cost an ASCII one is the
canonical one, else the most frequent; tokens that no spelling matches are normalised by
table. With the limit of zero two tokens get the same form exactly if they read the same,
whatever the vocabulary holds: a spelling reads as the tokens that reach it, and where the
reading is ASCII the ASCII spelling is among those reached.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kenmark.operators.heavy import expand_links, join_on_hot_keys
from kenmark.plans.scratch import materialise

# Letters that look like a Latin one, in natural order.
LATIN_FOR = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"))
LATIN_FOR |= dict(zip("ЅІЈАВЕКМНОРСТУХаеорсухѕіјһԁԛԝӀ", "SIJABEKMHOPCTYXaeopcyxsijhdqwI"))
# Characters that show nothing.
IGNORABLE = frozenset("­͏؜᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿")
# Spaces that read as a plain one.
SPACES = frozenset("              　")
# Look-alikes of ASCII punctuation.
PUNCTUATION = dict(zip("‐‑−‘’“”;․⁄", "---''\"\";./"))

_MARKS = "̀-ͯ" + "".join(sorted(IGNORABLE))
#: A token with a non-ASCII character in it.
TOKEN = re.compile(rf"(?<![A-Za-z0-9_])[A-Za-z0-9_]*(?:[^\W\x00-\x7f]|[{_MARKS}])[\w{_MARKS}]*")
#: Any other non-ASCII character.
OTHER = re.compile(r"[^\w\x00-\x7f]")

#: Spellings that the vocabulary holds at most.
VOCABULARY = 100_000


def plain(char: str) -> str:
    """The table for one character: its visible letter, or nothing."""
    if char in IGNORABLE:
        return ""
    if char in SPACES:
        return " "
    code = ord(char)
    if 0xFF01 <= code <= 0xFF5E:
        char = chr(code - 0xFEE0)
    return LATIN_FOR.get(char) or PUNCTUATION.get(char, char)


def letters(token: str) -> list[str]:
    """The visible letters and accents of a token, decomposed, in canonical order."""
    kept = "".join(c for c in token if c not in IGNORABLE)
    return [p for c in unicodedata.normalize("NFD", kept) if (p := plain(c))]


def by_table(token: str) -> str:
    return unicodedata.normalize("NFC", "".join(letters(token)))


def spelling(token: str) -> str:
    """How a token enters the vocabulary: composed and without ignorables, its letters as they are."""
    return unicodedata.normalize("NFC", "".join(c for c in token if c not in IGNORABLE))


class Trie:
    """Spellings with their counts; edges are single decomposed characters, also found by how they look."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.like: list[dict[str, list[int]]] = [{}]
        self.ends: dict[int, tuple[bool, int, str]] = {}
        for word, n in counts.items():
            self._add(word, n)
            if not word.isascii() and (form := by_table(word)).isascii() and form:
                self._add(form, counts.get(form, 0))

    def _add(self, word: str, n: int) -> None:
        node = 0
        for c in unicodedata.normalize("NFD", word):
            child = self.edges[node].get(c)
            if child is None:
                child = self.edges[node][c] = len(self.edges)
                self.edges.append({})
                self.like.append({})
                self.like[node].setdefault(plain(c), []).append(child)
            node = child
        own = (word.isascii(), n, word)
        self.ends[node] = max(self.ends.get(node, own), own, key=lambda x: (x[0], x[1], [-ord(c) for c in x[2]]))

    def best(self, token: str, limit: int = 0) -> str | None:
        """The ASCII, else the most frequent spelling at the least cost within ``limit``, ties by the smaller text."""
        if not limit:
            nodes = [0]
            for char in letters(token):
                nodes = [child for node in nodes for child in self.like[node].get(char, ())]
                if not nodes:
                    return None
            states = dict.fromkeys(nodes, 0)
        else:
            states = {0: 0}
            for char in letters(token):
                states = self._step(self._skip(states, limit), char, limit)
                if not states:
                    return None
            states = self._skip(states, limit)
        reached = [(cost, *self.ends[node]) for node, cost in states.items() if node in self.ends]
        return min(reached, key=lambda x: (x[0], not x[1], -x[2], x[3]))[3] if reached else None

    def _skip(self, states: dict[int, int], limit: int) -> dict[int, int]:
        """Also the states that are reached by characters which the token lacks."""
        out, queue = dict(states), list(states)
        while queue:
            node = queue.pop()
            for child in self.edges[node].values():
                if out[node] + 1 <= limit and out[node] + 1 < out.get(child, limit + 1):
                    out[child] = out[node] + 1
                    queue.append(child)
        return out

    def _step(self, states: dict[int, int], char: str, limit: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, cost in states.items():
            if cost < limit:
                out[node] = min(out.get(node, limit), cost + 1)
            for c, child in self.edges[node].items():
                price = cost + (plain(c) != char)
                if price <= limit and price < out.get(child, limit + 1):
                    out[child] = price
        return out


class Canon:
    """The canonical form of texts, given a vocabulary."""

    def __init__(self, counts: dict[str, int], limit: int = 0) -> None:
        self.trie, self.limit, self.known = Trie(counts), limit, {}

    def token(self, token: str) -> str:
        if (form := self.known.get(token)) is None:
            form = self.trie.best(token, self.limit)
            if form is None:
                form = by_table(token)
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[token] = form
        return form

    def text(self, text: str) -> str:
        if not text.isascii():
            text = TOKEN.sub(lambda m: self.token(m[0]), text)
            text = OTHER.sub(lambda m: plain(m[0]), text)
            # Marks outside tokens compose with what stands before them.
            text = unicodedata.normalize("NFC", text)
        return text.replace("\r\n", "\n")


def vocabulary(documents: DataFrame, text: str, most: int = VOCABULARY) -> dict[str, int]:
    """The ``most`` most frequent non-ASCII spellings over all documents, with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for body in batch.column(0).to_pylist():
                if body is not None and not body.isascii():
                    counts.update(TOKEN.findall(body))
            if len(counts) > 200_000:
                yield flush()
        raw = flush()
        yield raw

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([spelling(t) for t in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["token", "n"])

    counted = documents.select(text).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    spelled = counted.mapInArrow(spell, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).where("token <> ''")
    return {r["token"]: r["n"] for r in spelled.orderBy(F.desc("n"), "token").limit(most).collect()}


def canonical_texts(documents: DataFrame, key: str, text: str, most: int = VOCABULARY, limit: int = 0, keep_text: bool = True) -> DataFrame:
    """(key, text in canonical form, stored, reads): the last two are 128-bit digests of the stored and of the canonical text.

    A null text stays null, with null digests. With ``keep_text`` false the text is left out.
    """
    held = documents.sparkSession.sparkContext.broadcast(vocabulary(documents, text, most))
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, " + f"`{text}` string, " * keep_text + "stored binary, reads binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon(held.value, limit)
        digest = lambda x: None if x is None else xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            forms = [None if x is None else canon.text(x) for x in bodies]
            stored = [digest(x) for x in bodies]
            reads = [s if f is x or f == x else digest(f) for x, f, s in zip(bodies, forms, stored)]
            columns = [batch.column(0), *([pa.array(forms, pa.string())] if keep_text else []), pa.array(stored, pa.binary()), pa.array(reads, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *([text] if keep_text else []), "stored", "reads"])

    return documents.select(key, text).mapInArrow(run, schema)


def _readings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stored, reads) of the rows with key and text, once each, written."""
    return materialise(canonical_texts(documents, key, text, keep_text=False).where(F.col("stored").isNotNull() & F.col(key).isNotNull()).distinct().withColumnRenamed(key, "key"), "readings")


def same_reading_pairs(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(id_a, id_b), smaller id first: texts that differ as stored but read the same.

    Stored texts are paired first, so that documents meet between different texts only;
    readings of many spellings and spellings of many documents are split over tasks.
    """
    keyed = _readings(documents, key, text)
    several = keyed.groupBy("reads").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low <> high").select("reads")
    members = materialise(keyed.join(several, "reads", "left_semi"), "members")
    texts = members.select("reads", "stored").distinct()
    own = texts.select(F.col("reads").alias("reads_a"), F.col("reads").alias("reads_b")).distinct()
    pairs = expand_links(own, texts, "reads").where("stored_a < stored_b").select("stored_a", "stored_b")
    met = expand_links(pairs, members.select("stored", "key"), "stored")
    return met.select(F.least("key_a", "key_b").alias("id_a"), F.greatest("key_a", "key_b").alias("id_b"))


def readings(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reading, n_spellings, n_links): the compact form of ``same_reading_pairs``, one row per document.

    ``reading`` is the smallest key of the documents that read the same, ``n_spellings``
    counts their different texts, ``n_links`` those whose stored text is another one. Rows
    without key or text don't count, repeated rows count once.
    """
    keyed = _readings(documents, key, text)
    spelled = materialise(keyed.groupBy("reads", "stored").agg(F.count(F.lit(1)).alias("own"), F.min("key").alias("reading")), "spelled")
    classes = spelled.groupBy("reads").agg(F.count(F.lit(1)).alias("n_spellings"), F.sum("own").alias("n"), F.min("reading").alias("reading"))
    counted = join_on_hot_keys(spelled.drop("reading"), classes, ["reads"]).select("reads", "stored", "reading", "n_spellings", (F.col("n") - F.col("own")).alias("n_links"))
    out = join_on_hot_keys(keyed, counted, ["reads", "stored"])
    return out.select(F.col("key").alias(key), "reading", "n_spellings", "n_links")
