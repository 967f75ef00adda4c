"""Deeply nested semi-structured records as related flat tables.

A first pass over all bodies infers one merged schema: objects merge member by member, an
object met where others have a list counts as a list of one, and JSON kept as text inside
JSON is read as JSON. A second pass walks every record along that schema and explodes each
array level into rows of a child table, recursively, and each object member into a row of a
table of its own; rows carry a surrogate key, their parent's key and their place. Levels
are rows and never types, so there is no limit to their depth: what the parser of the
standard library is too deep for is read by one without recursion.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kenmark.plans.scratch import materialise

#: Merged shapes that the driver gets at most.
SHAPES = 16
#: Names of one object that become columns or tables; the members of an object of more are rows of one table.
MOST_MEMBERS = 1000
#: Rows of a batch that are given out at once.
ROWS_OUT = 20_000
#: Levels that the functions below may call themselves for; they are plain Python, which takes no stack of the process.
LEVELS = 1_000_000

# Reading.


#: Names as they were spelled once; a worker begins with what the driver has.
_SPELLED: dict[str, str] = {}


def camel_case(name: str) -> str:
    """high_entropy_values and highEntropyValues are one name."""
    if (known := _SPELLED.get(name)) is None:
        if len(_SPELLED) >= 100_000:
            _SPELLED.clear()
        known = _SPELLED[name] = re.sub(r"(?<=[A-Za-z0-9])_+([A-Za-z0-9])", lambda m: m[1].upper(), name)
    return known


def _opened(value: object) -> object:
    """JSON that is kept as text inside JSON becomes part of the tree."""
    if type(value) is str:
        if value[:1] in "{[ \t\r\n" and value.lstrip()[:1] in ("{", "["):
            try:
                return strict_json(value)
            except ValueError:
                return value
    elif type(value) is list:
        for i, x in enumerate(value):
            if type(x) in (str, list):
                value[i] = _opened(x)
    return value


def _object(pairs: list[tuple[str, object]]) -> dict:
    """An object whose names get one spelling; of two spellings of a name, the one with a value counts."""
    out: dict = {}
    for name, value in pairs:
        if type(value) in (str, list):
            value = _opened(value)
        name = camel_case(name)
        if out.get(name) is None:
            out[name] = value
    return out


def _refuse(name: str) -> None:
    raise ValueError(name)


def _decoded(text: str) -> object:
    return json.loads(text, object_pairs_hook=_object, parse_constant=_refuse)


_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*"|[^\s{}\[\],:"]+))')


def strict_json(text: str) -> object:
    """The tree of complete JSON, names in one spelling and JSON in text opened, or ValueError; NaN and Infinity aren't JSON."""
    try:
        return _opened(_decoded(text))
    except RecursionError:
        sys.setrecursionlimit(LEVELS)
        return _opened(deep_json(text))


def deep_json(text: str) -> object:
    """The same without recursion, for any depth."""
    # Open containers: their kind, their entries, and the name that waits for its value.
    stack: list[list] = []
    at, expects = 0, "value"
    while True:
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"no JSON at {at}")
        at = found.end()
        mark, rest = found[1], found[2]
        if mark in ("{", "[") and expects in ("value", "entry"):
            stack.append([mark, [], None])
            expects = "name or end" if mark == "{" else "entry"
            continue
        if mark == ":" and expects == "colon":
            expects = "value"
            continue
        if mark == "," and expects == "more":
            expects = "name" if stack[-1][0] == "{" else "value"
            continue
        if mark in ("}", "]"):
            if not stack or stack[-1][0] != {"}": "{", "]": "["}[mark] or expects not in ("more", "name or end" if mark == "}" else "entry"):
                raise ValueError(f"unexpected {mark} at {at}")
            kind, entries, _ = stack.pop()
            value = _object(entries) if kind == "{" else entries
        elif rest is not None and expects in ("name", "name or end"):
            stack[-1][2] = _decoded(rest)
            if not isinstance(stack[-1][2], str):
                raise ValueError(f"no name at {at}")
            expects = "colon"
            continue
        elif rest is not None and expects in ("value", "entry"):
            value = _decoded(rest)
        else:
            raise ValueError(f"unexpected {mark or rest} at {at}")
        if not stack:
            if text[at:].strip(" \t\r\n"):
                raise ValueError(f"more at {at}")
            return value
        top = stack[-1]
        top[1].append((top[2], value) if top[0] == "{" else value)
        expects = "more"


def records(body: str | None, envelope: tuple[str, ...]) -> list[tuple[int, dict]]:
    """The records of a body: the members of a list, or what lies in the envelope's members, with their places."""
    if body is None:
        return []
    try:
        tree = strict_json(body)
    except ValueError:
        return []
    while isinstance(tree, dict) and (inner := [x for x in envelope if isinstance(tree.get(x), (dict, list))]):
        tree = tree[inner[0]]
    if isinstance(tree, list):
        opened = []
        for x in tree:
            while isinstance(x, dict) and (inner := [k for k in envelope if isinstance(x.get(k), dict)]):
                x = x[inner[0]]
            opened.append(x)
        tree = opened
    return [(i, x) for i, x in enumerate(tree if isinstance(tree, list) else [tree]) if isinstance(x, dict)]


# The merged schema.

SCALAR, OBJECT, LIST = 1, 2, 4


class Shape:
    """What was met at one place: kinds of values, members of objects, entries of lists, members of very wide objects."""

    __slots__ = ("kinds", "members", "entries", "wide")

    def __init__(self) -> None:
        self.kinds, self.members, self.entries, self.wide = 0, {}, None, None

    def observe(self, value: object, most: int = MOST_MEMBERS) -> Shape:
        """Adds a value; nulls leave no trace."""
        if type(value) is dict:
            self.kinds |= OBJECT
            for name, x in value.items():
                if x is None:
                    continue
                at = self.wide
                if at is None and (at := self.members.get(name)) is None:
                    at = self.members[name] = Shape()
                if type(x) is dict or type(x) is list:
                    at.observe(x, most)
                else:
                    at.kinds |= SCALAR
            self._narrow(most)
        elif type(value) is list:
            self.kinds |= LIST
            self.entries = self.entries or Shape()
            for x in value:
                self.entries.observe(x, most)
        elif value is not None:
            self.kinds |= SCALAR
        return self

    def merge(self, other: Shape | None, most: int = MOST_MEMBERS) -> Shape:
        """Adds all that ``other`` met."""
        if other is None:
            return self
        self.kinds |= other.kinds
        for name, x in other.members.items():
            if self.wide is not None:
                self.wide.merge(x, most)
            else:
                self.members.setdefault(name, Shape()).merge(x, most)
        for part in ("entries", "wide"):
            if (x := getattr(other, part)) is not None:
                setattr(self, part, (getattr(self, part) or Shape()).merge(x, most))
        self._narrow(most)
        return self

    def _narrow(self, most: int) -> None:
        if self.members and (self.wide is not None or len(self.members) > most):
            members, self.members = self.members, {}
            self.wide = self.wide or Shape()
            for x in members.values():
                self.wide.merge(x, most)

    def rows(self) -> Shape:
        """Of the rows of the table at this place: single values and the entries of lists alike."""
        out = Shape()
        out.kinds, out.members, out.wide = self.kinds & ~LIST, dict(self.members), self.wide
        if self.entries is None:
            return out
        return Shape().merge(out).merge(self.entries)

    def dump(self) -> str:
        """As a flat list of (place of the parent, name, kinds), whatever the depth."""
        out, queue = [], [(self, -1, "")]
        while queue:
            shape, parent, name = queue.pop()
            out.append((parent, name, shape.kinds))
            at = len(out) - 1
            queue += [(x, at, "." + n) for n, x in shape.members.items()]
            queue += [(x, at, n) for x, n in ((shape.entries, "[]"), (shape.wide, "*")) if x is not None]
        return json.dumps(out)

    @classmethod
    def load(cls, text: str) -> Shape:
        out: list[Shape] = []
        for parent, name, kinds in json.loads(text):
            shape = cls()
            shape.kinds = kinds
            out.append(shape)
            if name == "[]":
                out[parent].entries = shape
            elif name == "*":
                out[parent].wide = shape
            elif parent >= 0:
                out[parent].members[name[1:]] = shape
        return out[0]


def merged_shape(df: DataFrame, body: str, envelope: tuple[str, ...], most: int = MOST_MEMBERS) -> Shape:
    """The schema that holds every record of ``df``."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(LEVELS)
        shape = Shape()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, record in records(text, envelope):
                    shape.observe(record, most)
        yield pa.RecordBatch.from_pydict({"shape": pa.array([shape.dump()], pa.string())})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(LEVELS)
        shape = Shape()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                shape.merge(Shape.load(text), most)
        yield pa.RecordBatch.from_pydict({"shape": pa.array([shape.dump()], pa.string())})

    # Merged in two steps, so that the driver gets at most SHAPES of them.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), LEVELS))
    found = df.select(body).mapInArrow(infer, "shape string").distinct()
    shape = Shape()
    for row in found.repartition(SHAPES, "shape").mapInArrow(combine, "shape string").distinct().toLocalIterator():
        shape.merge(Shape.load(row["shape"]), most)
    return shape


# Tables.


class Table:
    """A table of the schema, as the second pass needs it: its number, columns and child tables."""

    def __init__(self, path: str, shape: Shape, all_tables: list[Table], listed: bool = False, named: bool = False) -> None:
        self.path, self.number, self.listed, self.named = path, len(all_tables), listed, named
        all_tables.append(self)
        rows = shape.rows()
        self.columns = sorted(n for n, x in rows.members.items() if x.kinds == SCALAR)
        if rows.kinds & SCALAR and "value" not in self.columns:
            self.columns.append("value")
        below = lambda name: f"{path}.{name}".lstrip(".")
        self.children = {n: Table(below(n), x, all_tables, bool(x.kinds & LIST)) for n, x in sorted(rows.members.items()) if x.kinds & ~SCALAR}
        self.inner = Table(f"{path}[]", rows.entries, all_tables, True) if rows.entries is not None else None
        self.wide = Table(below("*"), rows.wide, all_tables, bool(rows.wide.kinds & LIST), True) if rows.wide is not None else None
        self.wanted: frozenset[str] | None = frozenset(self.columns)

    def keep(self, chosen: dict[str, set[str]]) -> bool:
        """Restricts the tables, and their columns, to the chosen ones; False if nothing is left here or below."""
        self.wanted = frozenset(chosen[self.path]) if self.path in chosen else None
        self.children = {n: t for n, t in self.children.items() if t.keep(chosen)}
        self.inner = self.inner if self.inner and self.inner.keep(chosen) else None
        self.wide = self.wide if self.wide and self.wide.keep(chosen) else None
        return self.wanted is not None or bool(self.children or self.inner or self.wide)


def tables_of(shape: Shape) -> list[Table]:
    out: list[Table] = []
    Table("", shape, out)
    return out


def empty(value: object) -> bool:
    return value is None or value == {} or value == []


def scalar_text(value: object) -> str:
    return value if type(value) is str else json.dumps(value)


def walk(table: Table, value: object, own: str, parent: str | None, pos: int, put: Callable[..., None], name: str | None = None) -> None:
    """Gives ``put`` a row for the value and for all below it: (table, id, parent, pos, filled members, texts)."""
    texts = None
    if type(value) is dict:
        if table.wanted is not None:
            texts = [(n, scalar_text(value[n])) for n in table.wanted if value.get(n) is not None and type(value[n]) not in (dict, list)]
            if name is not None:
                texts.append(("", name))
            put(table.number, own, parent, pos, sum(not empty(x) for x in value.values()), texts)
        for n, child in table.children.items():
            x = value.get(n)
            if x is None:
                continue
            at = f"{own}/{n}"
            if type(x) is list:
                for i, y in enumerate(x):
                    if y is not None:
                        walk(child, y, f"{at}/{i}", own, i, put)
            else:
                walk(child, x, f"{at}/0" if child.listed else at, own, 0, put)
        if table.wide is not None:
            for i, (n, x) in enumerate(value.items()):
                if x is not None:
                    walk(table.wide, x, f"{own}/{n}", own, i, put, n)
        return
    if table.wanted is not None:
        texts = [("value", scalar_text(value))] if type(value) is not list and "value" in table.wanted else []
        if name is not None:
            texts.append(("", name))
        put(table.number, own, parent, pos, sum(not empty(x) for x in value) if type(value) is list else 0, texts)
    if type(value) is list and table.inner is not None:
        for i, y in enumerate(value):
            if y is not None:
                walk(table.inner, y, f"{own}/{i}", own, i, put)


def exploded(df: DataFrame, key: str, body: str, envelope: tuple[str, ...], shape: Shape, chosen: dict[str, set[str]] | None = None) -> DataFrame:
    """(key, rec, t, id, parent_id, pos, n_filled, texts): the rows of all or the chosen tables, ``t`` being the number in ``tables_of``."""
    dumped = shape.dump()
    kind = to_arrow_type(df.schema[key].dataType)
    texts_kind = pa.map_(pa.string(), pa.string())
    names = [key, "rec", "t", "id", "parent_id", "pos", "n_filled", "texts"]
    if len(set(names)) < len(names):
        raise ValueError(f"the key column can't be named {key}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(LEVELS)
        part, row = TaskContext.get().partitionId(), 0
        root = tables_of(Shape.load(dumped))[0]
        if chosen is not None:
            root.keep(chosen)
        rows: list[tuple] = []

        def take(batch: pa.RecordBatch) -> pa.RecordBatch:
            place, rec, t, own, parent, pos, filled, texts = zip(*rows)
            rows.clear()
            columns = [batch.column(0).take(pa.array(place)).cast(kind), pa.array(rec, pa.int32()), pa.array(t, pa.int32()), pa.array(own, pa.string()), pa.array(parent, pa.string()), pa.array(pos, pa.int32()), pa.array(filled, pa.int32()), pa.array(texts, texts_kind)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for place, text in enumerate(batch.column(1).to_pylist()):
                for i, record in records(text, envelope):
                    # Rows with equal keys have keys of their own here, so children find their parent.
                    walk(root, record, f"{part:x}.{row:x}/{i}", None, 0, lambda *x, place=place, i=i: rows.append((place, i, *x)))
                row += 1
                if len(rows) >= ROWS_OUT:
                    yield take(batch)
            if rows:
                yield take(batch)

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, rec int, t int, id string, parent_id string, pos int, n_filled int, texts map<string,string>"
    return df.select(key, body).mapInArrow(run, schema)


def flatten(df: DataFrame, key: str, body: str, envelope: tuple[str, ...] = (), most_members: int = MOST_MEMBERS) -> dict[str, DataFrame]:
    """Tables by their path, '' being the records themselves.

    Columns of each: the record's key, rec (the record's place in the body), id, parent_id,
    pos (the place in the parent's list, 0 for an object member), n_filled (members that
    are neither null nor an empty object or list), then the scalar members as text. A
    member that is ever a list or an object is a child table, of which each entry is a row;
    an entry that is no object has its text in ``value``. Entries that are lists themselves
    have their own entries in a table whose path ends in []. An object that has more than
    ``most_members`` names over all records has its members as rows of a table whose path
    ends in *, with the column ``name``. Member names that clash with these columns get a
    trailing '_'. Ids are unique over the table. Bodies that are null or not complete JSON
    give nothing; so do records that aren't objects. Null entries of a list give no row but
    keep their place. Rows with the same key each give their own rows.
    """
    shape = merged_shape(df, body, envelope, most_members)
    rows = materialise(exploded(df, key, body, envelope, shape), "records")
    out: dict[str, DataFrame] = {}
    for table in tables_of(shape):
        own = {key, "rec", "id", "parent_id", "pos", "n_filled", *(["name"] if table.named else [])}
        names = [F.element_at("texts", F.lit("")).alias("name")] if table.named else []
        texts = [F.element_at("texts", F.lit(n)).alias(n + "_" if n in own else n) for n in table.columns]
        out[table.path] = rows.where(F.col("t") == table.number).select(key, "rec", "id", "parent_id", "pos", "n_filled", *names, *texts)
    return out


#: Members of a body in which collectors wrap the fingerprint or the list of them.
ENVELOPE = ("data", "records", "fingerprint")
#: Children of a fingerprint by the path of their table.
CHILDREN = {
    "highEntropyValues": "highEntropyValues",
    "screen": "screen",
    "screen.orientation": "orientation",
    "behavioralMetrics.mouse": "mouse",
    "behavioralMetrics.keyboard": "keyboard",
    "behavioralMetrics.scroll": "scroll",
    "behavioralMetrics.session": "session",
}
BRANDS = "highEntropyValues.brands"


def payload_children(payloads: DataFrame) -> DataFrame:
    """One row per filled child of the fingerprints in a payloads table, with its place.

    Only the tables of these children are exploded. An empty table gives no rows.
    """
    shape = merged_shape(payloads, "body", ENVELOPE)
    paths = {t.path: t for t in tables_of(shape)}
    chosen = {path: set() for path in CHILDREN} | {BRANDS: {"brand", "value"} & set(paths[BRANDS].columns) if BRANDS in paths else set()}
    rows = exploded(payloads, "payload_id", "body", ENVELOPE, shape, chosen)
    number = F.coalesce(*(F.when(F.col("t") == paths[p].number, F.lit(child)) for p, child in {**CHILDREN, BRANDS: "brands"}.items() if p in paths), F.lit(None).cast("string"))
    brand = F.coalesce(F.element_at("texts", F.lit("brand")), F.element_at("texts", F.lit("value")))
    listed = F.col("child") == "brands"
    out = rows.withColumn("child", number).select("payload_id", "rec", "child", F.when(listed, F.col("pos")).otherwise(0).alias("pos"), F.when(listed, brand).otherwise("").alias("item"), "n_filled")
    return out.where(F.when(listed, F.col("item").isNotNull()).otherwise(F.col("child").isNotNull() & (F.col("n_filled") > 0))).drop("n_filled")
