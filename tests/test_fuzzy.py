"""Near-duplicates by digest against all pairs, one by one."""

from itertools import combinations

from kenmark.functions.tlsh import tlsh_digest, tlsh_distances
from kenmark.operators import fuzzy
from kenmark.plans.queries import queries


def brute(texts, below=50):
    digests = {k: d for k, t in texts.items() if (d := tlsh_digest(t))}
    pairs = list(combinations(sorted(digests), 2))
    near = tlsh_distances([digests[a] for a, _ in pairs], [digests[b] for _, b in pairs])
    return sorted((a, b, int(d)) for (a, b), d in zip(pairs, near) if d < below)


def test_query_finds_all_near_documents(spark, tables, monkeypatch):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    wanted = brute(texts)
    assert wanted
    for rows in (4000, 9):
        monkeypatch.setattr(fuzzy, "ROWS_PER_TILE", rows)
        assert sorted(tuple(r) for r in queries()["tlsh_near_duplicates"](spark, tables).collect()) == wanted


def test_digest_pairs_at_every_limit(monkeypatch, spark, tables):
    monkeypatch.setattr(fuzzy, "ROWS_PER_PRODUCT", 7)
    found = {tlsh_digest(r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()} - {None}
    digests = sorted(found)
    for below in (1, 50, 120, 1000):
        wanted = sorted((a, b, int(d)) for a, b in combinations(digests, 2) if (d := tlsh_distances([a], [b])[0]) < below)
        assert sorted(fuzzy.digest_pairs(digests, None, below)) == wanted
        half = len(digests) // 2
        parts = [*fuzzy.digest_pairs(digests[:half], None, below), *fuzzy.digest_pairs(digests[half:], None, below), *fuzzy.digest_pairs(digests[:half], digests[half:], below)]
        assert sorted(parts) == wanted
