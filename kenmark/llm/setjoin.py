"""All similar pairs between set-valued records, by a prefix-filtered join.

Records with the same set form one class, and classes are joined. Elements are ordered by
rarity over all classes. Two sets of Jaccard similarity t or more share an element within
the prefixes that t determines; only prefixes are joined, on their rare elements and on
pairs of their frequent ones. The length filter and the positional filter (what can still
be shared after the key) cut candidates, each of which is verified once, by its exact
overlap. Nothing is capped; keys of many sets are split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kenmark.functions.text import normalised_set
from kenmark.operators.heavy import MOST_HEAVY, SKETCH_ITEMS, expand_links, join_on_hot_keys
from kenmark.plans.scratch import materialise

_SLACK = 1e-9

#: An element of at most so many distinct sets is a key of its own; others are keys in pairs.
RARE = 40
#: A set of more elements has single keys only, as pairs of its prefix would be too many.
LONG = 400
#: A key that more sets hold is split into parts of about so many.
SETS_PER_PART = 20_000
#: Share of the sets whose keys are counted to find such keys; it decides on routes only.
COUNTED = 1 / 16


def _ceil(x: Column) -> Column:
    return F.ceil(x - F.lit(_SLACK)).cast("int")


def with_classes(records: DataFrame, key: str, elements: str, least_size: int, among: str | None = None) -> DataFrame:
    """(class, key, elements, among): the records that count, each with the class of its set, a 128-bit digest."""
    own = F.array_sort(F.array_distinct(F.array_compact(elements)))
    aside = F.coalesce(F.col(among), F.lit(False)) if among else F.lit(False)
    sized = records.select(F.col(key).alias("key"), own.alias("elements"), aside.alias("among")).where((F.size("elements") >= least_size) & F.col("key").isNotNull())
    return sized.select(F.unhex(F.md5(F.to_json("elements"))).alias("class"), "key", "elements", "among")


def _keys(tokens: Column, n: Column, length: Column, first_frequent: int, threshold: float, most: int) -> Column:
    """The keys of a set as (k1, k2, rest): ``rest`` is what the set can share at most if the key is the first that is shared.

    Keys are the rare elements of the prefix, of tiny and of nearly long sets all of them,
    and of sets that aren't long all pairs of frequent elements of the prefix that is one
    longer. A set that may be similar to a long one has both kinds.
    """
    placed = F.transform(F.slice(tokens, 1, length + 1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    every = (n * threshold <= 1 + _SLACK) | (n > threshold * most - _SLACK)
    alone = F.filter(placed, lambda p: (p["i"] < length) & ((p["x"] < first_frequent) | every))
    singles = F.transform(alone, lambda p: F.struct(p["x"].alias("k1"), F.lit(-1).cast("long").alias("k2"), (n - p["i"]).alias("rest")))
    frequent = F.filter(placed, lambda p: (p["x"] >= first_frequent) & (n <= most))
    pairs = F.transform(frequent, lambda p, i: F.transform(F.slice(frequent, i + 2, F.size(frequent)), lambda q: F.struct(p["x"].alias("k1"), q["x"].alias("k2"), (n - q["i"] + 1).alias("rest"))))
    return F.concat(singles, F.flatten(pairs))


def _split_keys(index: DataFrame, probe: DataFrame, hot: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns to join on: an index row of a hot key lies in one part, a probing row goes to all."""
    if not hot:
        return index, probe, ["k1", "k2"]
    table = F.broadcast(index.sparkSession.createDataFrame(hot, "_h long, _parts int"))
    placed = lambda df: df.withColumn("_h", F.xxhash64("k1", "k2")).join(table, "_h", "left").drop("_h")
    held = placed(index).withColumn("part", F.coalesce(F.pmod(F.xxhash64("set_a"), F.col("_parts").cast("long")), F.lit(0)).cast("int"))
    asked = placed(probe).withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return held.drop("_parts"), asked.drop("_parts"), ["k1", "k2", "part"]


def _hot_keys(index: DataFrame, share: float, sets_per_part: int) -> list[tuple[int, int]]:
    """(hash, parts) of keys that very many sets hold, from the index rows of a share of the sets; at most ``MOST_HEAVY``."""
    row = index.select(F.xxhash64("k1", "k2").alias("_h")).agg(F.expr(f"approx_top_k(_h, {MOST_HEAVY}, {SKETCH_ITEMS})").alias("top")).first()
    counts = [(x["item"], int(x["count"] / share)) for x in row["top"] or []]
    return [(h, min(4096, -(-n // sets_per_part))) for h, n in counts if n > sets_per_part]


def similar_classes(classes: DataFrame, threshold: float, rare: int = RARE, most: int = LONG, sets_per_part: int = SETS_PER_PART, counted: float = COUNTED) -> DataFrame:
    """(class_a, class_b, overlap, size_a, size_b) of all pairs of distinct sets with similarity of at least ``threshold``.

    ``classes`` has one row (class, elements) per distinct set. Of a pair, class_a is that
    of the smaller set, or the smaller class if the sizes are equal.

    Two similar sets share an element within their prefixes. If the rarest shared one is in
    at most ``rare`` sets, it is their key. Else all shared elements are frequent, and
    within prefixes that are longer by one the sets share two; such pairs are their keys.
    Sets so small that one shared element could suffice have all their elements as keys, and
    so do sets of more than ``most`` elements and those that may be similar to one. Of a
    similar pair the first shared key passes the positional filter, since nothing before it
    is shared; from other keys the pair needn't pass.
    """
    held = classes.select("class", F.explode("elements").alias("element"))
    # Numbers follow rarity: the sort gives increasing partitions, and so increasing numbers.
    ranked = held.groupBy("element").agg(F.count(F.lit(1)).alias("holders")).orderBy("holders", "element")
    order = materialise(ranked.select("element", "holders", F.monotonically_increasing_id().alias("token")), "order")
    first_frequent = order.where(F.col("holders") > rare).agg(F.min("token")).first()[0]
    first_frequent = 2**62 if first_frequent is None else first_frequent
    numbered = join_on_hot_keys(held, order.select("element", "token"), ["element"])
    sets = numbered.groupBy("class").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select("class", "tokens", F.size("tokens").alias("n"), F.monotonically_increasing_id().alias("set"))
    sets = materialise(sets, "sets")

    probe = F.col("n") - _ceil(F.lit(threshold) * F.col("n")) + 1
    index = F.col("n") - _ceil(F.lit(2 * threshold / (1 + threshold)) * F.col("n")) + 1

    def keyed(length: Column, side: str, share: float = 1.0) -> DataFrame:
        keys = _keys(F.col("tokens"), F.col("n"), length, first_frequent, threshold, most)
        chosen = sets if share >= 1 else sets.where(F.pmod(F.xxhash64("class"), F.lit(2**20)) < int(share * 2**20))
        rows = chosen.select(F.explode(keys).alias("k"), F.col("set").alias(f"set_{side}"), F.col("n").alias(f"n_{side}"), F.col("class").alias(f"c_{side}"))
        return rows.select("k.k1", "k.k2", F.col("k.rest").alias(f"rest_{side}"), f"set_{side}", f"n_{side}", f"c_{side}")

    shorter = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("c_a") < F.col("c_b")))
    long_enough = F.col("n_a") >= F.lit(threshold) * F.col("n_b") - _SLACK
    enough_left = F.least("rest_a", "rest_b") >= F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - _SLACK
    hot = _hot_keys(keyed(index, "a", counted), counted, sets_per_part)
    held, asked, on = _split_keys(keyed(index, "a"), keyed(probe, "b"), hot)
    met = held.join(asked, on).where(shorter & long_enough & enough_left).select("set_a", "set_b").distinct()
    side = lambda s: sets.select(F.col("set").alias(f"set_{s}"), F.col("class").alias(f"class_{s}"), F.col("tokens").alias(f"tokens_{s}"), F.col("n").alias(f"size_{s}"))
    needed = _ceil(F.lit(threshold / (1 + threshold)) * (F.col("size_a") + F.col("size_b")))
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
    full = met.join(side("a"), "set_a").join(side("b"), "set_b")
    return full.where(overlap >= needed).select("class_a", "class_b", overlap.alias("overlap"), "size_a", "size_b")


def similar_pairs(records: DataFrame, key: str, elements: str, threshold: float = 0.8, least_size: int = 1, among: str | None = None) -> DataFrame:
    """(id_a, id_b) of all records whose sets of elements overlap by at least ``threshold``, smaller id first.

    Sets are taken of the non-null elements; records with a null list, fewer than
    ``least_size`` elements or a null key don't count, repeated rows count once. ``among``
    names a boolean column of rows that aren't paired with each other.
    """
    held = materialise(with_classes(records, key, elements, least_size, among), "classed")
    members = held.select("class", "key", "among").distinct()
    links = similar_classes(held.groupBy("class").agg(F.any_value("elements").alias("elements")), threshold).select("class_a", "class_b")
    same = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    pairs = expand_links(links.unionByName(same), members, "class").where("not (among_a and among_b)")
    pairs = pairs.where((F.col("key_a") < F.col("key_b")) | (F.col("class_a") != F.col("class_b")) & (F.col("key_a") != F.col("key_b")))
    return pairs.select(F.least("key_a", "key_b").alias("id_a"), F.greatest("key_a", "key_b").alias("id_b")).distinct()


def linked_records(records: DataFrame, key: str, elements: str, threshold: float = 0.8, least_size: int = 1, among: str | None = None) -> DataFrame:
    """(key, class, n_links): the compact form, in which copies aren't expanded into pairs.

    A record links to the other records of its class and to all of the similar classes;
    rows that ``among`` marks link to unmarked ones only.
    """
    held = materialise(with_classes(records, key, elements, least_size, among), "classed")
    members = held.select("class", "key", "among").distinct()
    links = similar_classes(held.groupBy("class").agg(F.any_value("elements").alias("elements")), threshold).select("class_a", "class_b")
    sizes = materialise(members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("among")).alias("free")), "sizes")
    both = links.unionByName(links.select(F.col("class_a").alias("class_b"), F.col("class_b").alias("class_a")))
    near = both.join(sizes.select(F.col("class").alias("class_b"), "n", "free"), "class_b").groupBy(F.col("class_a").alias("class")).agg(F.sum("n").alias("near"), F.sum("free").alias("near_free"))
    totals = sizes.join(near, "class", "left").na.fill(0, ["near", "near_free"])
    linked = F.when(F.col("among"), F.col("near_free") + F.col("free")).otherwise(F.col("near") + F.col("n") - 1)
    return join_on_hot_keys(members, totals, ["class"]).select(F.col("key").alias(key), F.hex("class").alias("class"), linked.alias("n_links"))


#: Lists of a record whose elements form its set, kept apart by list.
LISTS = ["fonts", "plugins", "mime_types", "languages"]
LEAST_ELEMENTS = 5


def elements_of(lists: list[str]) -> Column:
    """The distinct normalised entries of the lists, each marked with its list; null lists are empty."""
    marked = []
    for i, name in enumerate(lists):
        prefix = F.lit(f"{i}:")
        marked.append(F.transform(F.coalesce(normalised_set(F.col(name)), F.array().cast("array<string>")), lambda x: F.concat(prefix, x)))
    return F.concat(*marked)


def set_records(signal_sets: DataFrame, known_sets: DataFrame) -> DataFrame:
    """(id, elements, known) of both tables."""
    own = signal_sets.select(F.col("record_id").alias("id"), elements_of(LISTS).alias("elements"), F.lit(False).alias("known"))
    return own.unionByName(known_sets.select(F.col("known_id").alias("id"), elements_of(LISTS).alias("elements"), F.lit(True).alias("known")))


def similar_records(signal_sets: DataFrame, known_sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b) within ``signal_sets`` and between the two tables."""
    return similar_pairs(set_records(signal_sets, known_sets), "id", "elements", threshold, LEAST_ELEMENTS, among="known")
