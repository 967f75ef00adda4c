import math
import pickle
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kenmark.llm import leaks
from kenmark.llm.cells import CellIndex, known_rows
from kenmark.llm.eliteness import distinctive_terms, fit
from kenmark.llm.groups import components
from kenmark.llm.lookalikes import Canon, Trie, by_table, readings, same_reading_pairs
from kenmark.llm.packing import carried_deficits, fill_window, pack, packed
from kenmark.llm.queries import queries
from kenmark.llm.setjoin import linked_records, similar_classes, similar_pairs
from kenmark.plans.scratch import new_path

# Consolidating matches into groups.


def groups_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("per_task", [7, 10_000])
def test_components(spark, per_task):
    rng = random.Random(3)
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)]
    pairs += [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(50)] + [("a", "a"), (None, "b"), ("c", None)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs + pairs[:20] + [(b, a) for a, b in pairs[:20]], "u string, v string").withColumn("root", F.lit(1))
    got = {r.node: r.root for r in components(df, "u", "v", per_task).collect()}
    assert got == groups_of(pairs)
    assert components(df.limit(0), "u", "v").count() == 0


@pytest.mark.parametrize("order", ["rising", "falling", "shuffled"])
def test_chains_end_whatever_the_order_of_ids(spark, order):
    n, per_task = 1000, 50
    ids = list(range(n + 1))
    {"rising": ids.sort, "falling": ids.reverse, "shuffled": lambda: random.Random(5).shuffle(ids)}[order]()
    pairs = [(f"n{a:06d}", f"n{b:06d}") for a, b in zip(ids, ids[1:])]
    trace: list[int] = []
    got = components(spark.createDataFrame(pairs, "u string, v string"), "u", "v", per_task, trace).collect()
    assert {r.node for r in got} == {f"n{i:06d}" for i in range(n + 1)} and {r.root for r in got} == {"n000000"}
    assert len(trace) - 1 <= 2 * math.log2(n / per_task) and all(b < 0.85 * a for a, b in zip(trace, trace[1:]))


# All similar pairs of sets.


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(7)
    base = [rng.sample(range(60), rng.randrange(5, 25)) for _ in range(40)]
    rows = []
    for i in range(300):
        items = set(rng.choice(base))
        for _ in range(rng.randrange(4)):
            items ^= {rng.randrange(60)}
        rows.append((i, [str(x) for x in items] * rng.randrange(1, 3), i % 5 == 0))
    rows += [(900, None, False), (901, [], False), (902, ["a", None], False), (None, ["a"] * 9, False), rows[3]]
    df = spark.createDataFrame(rows, "id long, items array<string>, known boolean").withColumn("class", F.lit("x")).withColumn("key", F.lit("y"))
    got = [tuple(r) for r in similar_pairs(df, "id", "items", 0.8, 5, "known").collect()]
    sets = {i: (set(x), k) for i, x, k in rows if i is not None and x and len(set(x) - {None}) >= 5}
    expected = {(a, b) for a in sets for b in sets if a < b and not (sets[a][1] and sets[b][1]) and len(sets[a][0] & sets[b][0]) * 5 >= len(sets[a][0] | sets[b][0]) * 4}
    assert set(got) == expected and len(got) == len(expected)
    linked = {r.id: r.n_links for r in linked_records(df, "id", "items", 0.8, 5, "known").collect()}
    degree = Counter(x for pair in expected for x in pair)
    assert linked == {i: degree[i] for i in sets}
    assert similar_pairs(df.limit(0), "id", "items").count() == 0


@pytest.mark.parametrize(("threshold", "rare", "most", "per_part"), [(0.3, 0, 400, 20_000), (0.5, 3, 4, 5), (0.9, 1000, 400, 3), (0.3, 0, 3, 4)])
def test_similar_classes_at_other_thresholds(spark, threshold, rare, most, per_part):
    rng = random.Random(11)
    sets = {tuple(sorted(rng.sample(range(12), rng.randrange(1, 6)))) for _ in range(80)}
    rows = [(f"c{i}", [str(x) for x in s]) for i, s in enumerate(sorted(sets))]
    got = {tuple(sorted((r.class_a, r.class_b))): r.overlap for r in similar_classes(spark.createDataFrame(rows, "class string, elements array<string>"), threshold, rare, most, per_part, 1.0).collect()}
    held = {c: set(e) for c, e in rows}
    expected = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and len(held[a] & held[b]) >= threshold * len(held[a] | held[b]) - 1e-9}
    assert got == expected


# Known rows of new batches.


def test_known_rows_against_brute_force(spark):
    rng = np.random.default_rng(2)
    width, limit = 9, 2
    seeds = rng.integers(0, 5, (30, width))

    def row():
        v = seeds[rng.integers(30)].copy()
        v[rng.integers(0, width, rng.integers(0, 5))] = rng.integers(0, 9)
        return v.tolist()

    history = [(str(rng.integers(900)) if i % 3 else None, row()) for i in range(150)]
    incoming = [(int(rng.integers(1, 6)), f"s{i}", str(rng.integers(900)) if i % 3 else None, row()) for i in range(150)]
    incoming += incoming[:10] + [(6, x[1] + "b", x[2], x[3]) for x in incoming[:10]]
    h = spark.createDataFrame(history, "hash string, v array<long>").withColumn("batch", F.lit("clash"))
    n = spark.createDataFrame(incoming, "b int, id string, hash string, v array<long>").withColumn("cell", F.lit(0))
    vector = [F.col("v")[i].alias(f"f{i}") for i in range(width)]
    found, index = known_rows(h, n, "b", "hash", vector, ["id"], limit)
    accepted, expected = [*history], []
    for b in sorted({x[0] for x in incoming}):
        fresh = []
        for _, i, own, v in (x for x in incoming if x[0] == b):
            match = any((own is not None and own == o) or sum(p != q for p, q in zip(v, w)) <= limit for o, w in accepted)
            (expected.append((b, i)) if match else fresh.append((own, v)))
        accepted += fresh
    assert Counter(map(tuple, found.collect())) == Counter(expected)
    assert len(index.parts) > 1
    empty, _ = known_rows(h.limit(0), n.limit(0), "b", "hash", vector, ["id"], limit)
    assert empty.count() == 0


def test_split_cells_lose_nothing(spark):
    rows = spark.range(400).select(F.lit(None).cast("string").alias("own_hash"), F.lit(0).alias("batch"), F.lit(1).cast("long").alias("f0"), F.col("id").alias("f1"))
    index = CellIndex(spark, [[0], [1]], 2, 1, new_path(spark, "index"))
    part = index.append(rows, {index.entries(rows).where("space = 0").first().cell: 3})
    asked = spark.createDataFrame([(1, None, 1, 1, 999), (2, None, 1, 2, 999), (3, None, 1, 2, 5)], "row long, own_hash string, batch int, f0 long, f1 long")
    assert {r.row for r in index.probe(asked, part).collect()} == {1, 3}


def test_an_index_is_opened_in_a_later_session(spark, tmp_path):
    path, vector = str(tmp_path / "index"), [F.col("v")[i].alias(f"f{i}") for i in range(4)]
    rows = lambda data: spark.createDataFrame(data, "b int, id string, hash string, v array<long>")
    history = rows([(0, f"h{i}", f"{i}", [i, i, i, i]) for i in range(50)])
    built = CellIndex.build(history, "hash", vector, 1, path)
    built.close()
    # Nothing but the path goes on.
    opened = CellIndex.open(spark.newSession(), path)
    one = rows([(1, "near", None, [3, 3, 3, 9]), (1, "same", "7", [0, 1, 2, 3]), (1, "new", "x", [90, 91, 92, 93])])
    found, _ = known_rows(opened, one, "b", "hash", vector, ["id"])
    assert {r.id for r in found.collect()} == {"near", "same"}
    opened.close()
    again = CellIndex.open(spark, path)
    assert len(again.parts) == 2
    two = rows([(2, "x again", "x", [1, 2, 3, 4]), (2, "near new", None, [90, 91, 92, 0]), (2, "other", None, [90, 91, 0, 0])])
    assert {r.id for r in known_rows(again, two, "b", "hash", vector, ["id"])[0].collect()} == {"x again", "near new"}
    again.compact()
    last = CellIndex.open(spark, path)
    assert len(last.parts) == 1 and last.parts[0].rows.where("space = 0").count() == 52
    three = rows([(3, "other again", None, [90, 91, 0, 1]), (3, "old", "49", [7, 8, 9, 10]), (3, "none", None, [None, 1, 2, 3])])
    assert {r.id for r in known_rows(last, three, "b", "hash", vector, ["id"])[0].collect()} == {"other again", "old"}
    with pytest.raises(FileNotFoundError):
        CellIndex.open(spark, str(tmp_path / "nothing"))


# How distinctive a term is.


def test_fit_separates_rates():
    rng = np.random.default_rng(0)
    counts = np.r_[rng.poisson(6, 200), rng.poisson(0.3, 1800)]
    k, n = np.unique(counts[counts > 0], return_counts=True)
    share, high, low, post = fit(np.zeros(len(k), int), k.astype(float), n.astype(float), 2000)
    assert abs(share[0] - 0.1) < 0.03 and abs(high[0] - 6) < 0.7 and abs(low[0] - 0.3) < 0.15
    assert (np.diff(post) >= 0).all() and post[0] < 0.2 and post[-1] > 0.99


def test_distinctive_terms(spark):
    rows = [(i, f"o{i // 2}", "f", "common") for i in range(200)] + [(i, f"o{i // 2}", "f", "rare") for i in (1, 2, 9)] * 2
    rows += [(5, None, "f", "alone"), (None, "o1", "f", "x"), (6, "o3", "f", None)]
    df = spark.createDataFrame(rows, "id long, owner string, field string, term string").withColumn("tf", F.lit("clash"))
    got = {(r.id, r.term): r for r in distinctive_terms(df.drop("tf"), "id", ["field", "term"], 200, "owner").collect()}
    assert got[1, "rare"].n_holders == 3 and got[1, "rare"].tf == 2 and got[1, "common"].n_holders == 100
    assert got[1, "rare"].score > 5 * got[1, "common"].score
    assert (5, "alone") in got and len(got) == 200 + 3 + 1
    few = distinctive_terms(df, "id", ["field", "term"], 200, "owner", (2, 6)).select("term").distinct().collect()
    assert [r.term for r in few] == ["rare"]
    assert distinctive_terms(df.limit(0), "id", ["field", "term"], 0, "owner").count() == 0


# Leaks.

WORDS = [b"a", b"b", b"c", b"d"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=14), min_size=1, max_size=4), st.lists(st.sampled_from([*WORDS, b"zz"]), max_size=40), st.integers(1, 4))
def test_automaton_finds_what_ngrams_find(items, text, least):
    held = dict(enumerate(items))
    automaton = pickle.loads(pickle.dumps(leaks.SuffixAutomaton(list(held.items()), least)))
    found = {item for item, _, _ in leaks.find_spans(automaton, b" ".join(text).decode(), least)}
    grams = lambda t: {tuple(t[i : i + least]) for i in range(len(t) - least + 1)}
    assert found == {i for i, t in held.items() if grams(t) & grams(text)}


def test_leaks_in_documents(spark):
    item = "def leaked(x):\n  return x + some_name_1 * 3 - y / other # and more words here"
    docs = [(1, f"before {item.upper()} after"), (2, "nothing"), (3, ""), (4, None), (None, item), (5, "K" + item[3:]), (6, "w " * 100_000 + item)]
    d = spark.createDataFrame(docs, "doc long, text string").withColumn("item", F.lit("clash"))
    e = spark.createDataFrame([(9, item), (10, "too short"), (11, None), (12, item)], "item long, text string")
    got = {(r.doc, r.item) for r in leaks.leaked_spans(d, "doc", "text", e, "item", "text", 12).collect()}
    assert got == {(k, i) for k in (1, 5, 6) for i in (9, 12)}
    clean = {r.doc: r for r in leaks.without_leaks(d, "doc", "text", e, "item", "text", 12, 0.95).collect()}
    assert clean[1].text == "before  after" and clean[2].text == "nothing" and clean[4].leaked_words == 0
    assert leaks.leaked_spans(d, "doc", "text", e.limit(0), "item", "text").count() == 0
    assert len(list(leaks.item_blocks(e, "item", "text", 12, 10))) == 3
    cut = {(r.doc, r.item) for r in leaks.leaked_spans(d, "doc", "text", e, "item", "text", 5, 6).collect()}
    assert cut == {(r.doc, r.item) for r in leaks.leaked_spans(d, "doc", "text", e, "item", "text", 5).collect()} >= got


# Look-alikes.


def test_forms():
    canon = Canon({"ουρά": 3})
    assert canon.text("ｐａｓｓ​ｗｏｒｄ（１）") == "password(1)"
    assert canon.text("раssword café \r\n") == "password café \n"
    assert canon.text("oυρά") == "ουρά" == canon.text("ουρά")
    assert canon.text("Résumé") != canon.text("Resume") and canon.text("A") != canon.text("a")
    assert canon.text("") == "" and canon.text("​") == ""
    assert canon.text("раѕѕ") == Canon({"раѕѕ": 9}).text("раѕѕ") == "pass" and Trie({"раѕѕ": 9}).best("pаss") == "pass"
    assert Trie({"ab": 1, "abc": 5}).best("ab", 1) == "ab" and Trie({"abc": 5}).best("ab", 1) == "abc" and Trie({"abc": 5}).best("x", 1) is None


@settings(max_examples=100, deadline=None)
@given(st.text("aoсοеéé​оＡA", max_size=6), st.text("aoсοеéé​оＡA", max_size=6), st.dictionaries(st.text("aoсοеéγ", min_size=1, max_size=4), st.integers(1, 9), max_size=5))
def test_vocabulary_never_changes_what_is_equal(a, b, counts):
    canon = Canon(counts)
    assert (canon.token(a) == canon.token(b)) == (by_table(a) == by_table(b))


def test_same_reading_pairs(spark):
    long = "x" * 300_000
    rows = [(1, "pаss"), (2, "pass"), (3, "pass"), (4, "Pass"), (5, None), (6, ""), (7, long), (8, long + "​"), (None, "pass"), (2, "pass")]
    got = sorted(map(tuple, same_reading_pairs(spark.createDataFrame(rows, "id long, text string").withColumn("stored", F.lit(1)), "id", "text").collect()))
    assert got == [(1, 2), (1, 3), (7, 8)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("key", F.lit("clash"))
    compact = {r.id: (r.n_spellings, r.n_links) for r in readings(df, "id", "text").collect()}
    assert compact == {1: (2, 2), 2: (2, 1), 3: (2, 1), 4: (1, 0), 6: (1, 0), 7: (2, 1), 8: (2, 1)}
    assert readings(df.limit(0), "id", "text").count() == 0
    assert same_reading_pairs(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


# Packing.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from("abc")), max_size=80), st.integers(1, 6))
def test_pack_places_everything_within_capacity(items, window):
    sizes, sources = [s for s, _ in items], [x for _, x in items]
    found = pack(sizes, sources, {}, {"a": 0.5, "b": 0.5}, 50, window)
    load = defaultdict(int)
    for size, container in zip(sizes, found):
        load[container] += size
    assert all(x <= 50 for x in load.values()) and sorted(load) == list(range(len(load)))


def test_windows_follow_the_target():
    rng = random.Random(1)
    sizes = [rng.randrange(20, 900) for _ in range(6000)]
    sources = ["a" if i < 3000 else "b" for i in range(6000)]
    found = pack(sizes, sources, {}, {"a": 0.5, "b": 0.5}, 2048, 16)
    per = defaultdict(Counter)
    for s, x, c in zip(sizes, sources, found):
        per[c // 16][x] += s
    shares = [per[w]["a"] / sum(per[w].values()) for w in sorted(per)[:-2]]
    assert max(abs(x - 0.5) for x in shares) < 0.1
    assert sum(sizes) / (max(found) + 1) / 2048 > 0.98
    assert fill_window([(5, 0), (5, 1)], 5, 1) == ({0: 0}, [(5, 1)])


def test_packed_documents(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(1, 1500), rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(200, "", "a"), (201, None, "b"), (202, "many " * 5000, "a"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc long, text string, src string").withColumn("n", F.lit("clash"))
    got = packed(df, "doc", "text", "src", tokens_per_task=20_000).toPandas()
    assert got.groupby("container").n_tokens.sum().max() <= 2048
    assert set(got.doc) == {r[0] for r in rows} and (got.doc == 5).sum() == 2
    whole = got[got.doc == 202].sort_values("first_token")
    assert whole.first_token.tolist() == [0, 2048, 4096] and whole.n_tokens.tolist()[:2] == [2048, 2048]
    split = got.groupby("doc").piece.max()
    assert set(split[split > 0].index) == {202}
    assert packed(df.limit(0), "doc", "text", "src").count() == 0


def test_shares_hold_across_tasks_and_hot_keys_spread(spark):
    rng = random.Random(9)
    # One key and one source for most rows, very many empty texts.
    rows = [(1, "word " * rng.randrange(1, 300), "a" if rng.random() < 0.75 else "b") for _ in range(1500)] + [(1, "", "a")] * 3000
    df = spark.createDataFrame(rows, "doc long, text string, src string")
    got = packed(df, "doc", "text", "src", window=8, tokens_per_task=10**9, pieces_per_task=900).toPandas()
    assert len(got) == len(rows) and got.groupby("container").n_tokens.sum().max() <= 2048
    per_task = got.groupby(got.container // 2**32).size()
    assert len(per_task) == 5 and per_task.max() < 1200
    target = got[got.src == "a"].n_tokens.sum() / got.n_tokens.sum()
    for task, own in got.groupby(got.container // 2**32):
        windows = own.groupby(own.container % 2**32 // 8)
        for w, part in windows:
            if w < own.container.max() % 2**32 // 8 - 1:
                assert abs(part[part.src == "a"].n_tokens.sum() / part.n_tokens.sum() - target) < 0.12, (task, w)


def test_deficits_are_what_earlier_tasks_leave(spark):
    per = spark.createDataFrame([(0, "a", 90), (0, "b", 10), (1, "b", 50), (2, "a", 60), (2, "b", 40), (2, "c", 50)], "task int, s string, n long")
    got = {(r.task, r.s): (round(r.share, 6), round(r.deficit, 6)) for r in carried_deficits(per).collect()}
    assert got == {(0, "a"): (0.5, 0), (0, "b"): (0.333333, 0), (1, "b"): (0.333333, 23.333333), (2, "a"): (0.5, -15), (2, "b"): (0.333333, -10), (2, "c"): (0.166667, 25)}
    given = {(r.task, r.s): r.deficit for r in carried_deficits(per, {"a": 1, "b": 3}).collect()}
    assert given[1, "b"] == 65 and given[2, "a"] == -52.5 and given[2, "c"] == 0


def test_queries_run(spark, tables):
    for name, query in queries().items():
        assert query(spark, tables).count() > 0, name


def test_arrow_batches_without_rows():
    empty = pa.RecordBatch.from_pydict({"u": pa.array([], pa.string()), "v": pa.array([], pa.string())})
    from kenmark.llm.groups import spanning_forest

    assert list(spanning_forest(iter([empty]))) == []
