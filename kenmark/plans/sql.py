"""The engine's operators as DuckDB SQL, to check their results against.

Written from the definitions, value by value, and independent of the Column expressions.
"""

from __future__ import annotations

from pyspark.sql import types as T

from kenmark.functions.minhash import BANDS, HASHES, seeds
from kenmark.functions.text import WHITE_SPACE
from kenmark.schema import (
    COMMON_BROWSERS,
    COMMON_LANGUAGES,
    COMMON_RESOLUTIONS,
    DEFAULT_WEIGHT,
    ENTROPY_FIELDS,
    FIELDS,
    FINGERPRINT,
    MOBILE_MARKS,
    STABLE_FIELDS,
    WEIGHTS,
)

JACCARD = ("languages", "plugins", "mimeTypes", "fonts")


def num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def plus(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITE_SPACE}')"


def rounded(x: str) -> str:
    return f"floor(greatest(0::DOUBLE, least(100::DOUBLE, {x})) + 0.5::DOUBLE)::INT"


def present(x: str, kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return f"coalesce(length({strip(x)}) > 0, false)"
    if isinstance(kind, T.ArrayType):
        return f"coalesce(len({x}) > 0, false)"
    return f"({x} IS NOT NULL)"


def positional(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    same = f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1)))"
    return f"(CASE WHEN {a} = {b} THEN 1::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0::DOUBLE ELSE 1 - ({longest} - {same}) / {longest}::DOUBLE END)"


def folded(a: str, b: str) -> str:
    return positional(f"lower(coalesce({a}, ''))", f"lower(coalesce({b}, ''))")


def jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct(coalesce({a}, []))", f"list_distinct(coalesce({b}, []))"
    union = f"len(list_distinct(list_concat({x}, {y})))"
    return f"(CASE WHEN {union} = 0 THEN 1::DOUBLE ELSE len(list_intersect({x}, {y})) / {union}::DOUBLE END)"


def near(a: str, b: str) -> str:
    gap = f"abs({a} - {b}) / greatest(abs({a}), abs({b}), 1)::DOUBLE"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.5::DOUBLE WHEN {a} = {b} THEN 1::DOUBLE ELSE greatest(0::DOUBLE, 1 - {gap}) END)"


def exact(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.5::DOUBLE ELSE ({a} = {b})::INT::DOUBLE END)"


def screen(a: str, b: str) -> str:
    parts = [near(f"{a}.{c}", f"{b}.{c}") for c in ("width", "height", "colorDepth", "pixelDepth")]
    parts.append(exact(f"{a}.orientation.type", f"{b}.orientation.type"))
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.5::DOUBLE ELSE {plus(parts)} / 5 END)"


def canonical(x: str, kind: T.DataType, level: int = 0) -> str:
    if isinstance(kind, T.StructType):
        members = [f"'{f.name}:' || {canonical(f'{x}.{f.name}', f.dataType, level)}" for f in sorted(kind.fields, key=lambda f: f.name)]
        return f"(CASE WHEN {x} IS NOT NULL THEN '{{' || concat_ws(',', {', '.join(members)}) || '}}' END)"
    if isinstance(kind, T.ArrayType):
        v = f"x{level}"
        parts = f"list_transform({x}, lambda {v}: coalesce({canonical(v, kind.elementType, level + 1)}, ''))"
        return f"(CASE WHEN {x} IS NOT NULL THEN '[' || array_to_string({parts}, ',') || ']' END)"
    return f"CAST({x} AS VARCHAR)"


def canonical_fingerprint(fp: str) -> str:
    members = [f"'{f}:' || {canonical(f'{fp}.{f}', FINGERPRINT[f].dataType)}" for f in sorted(FIELDS)]
    return f"('{{' || concat_ws(',', {', '.join(members)}) || '}}')"


def leaves(a: str, b: str, kind: T.DataType, path: str, weight: str) -> list[tuple[str, str]]:
    """(weight, weight times similarity) of the leaves; ``weight`` is that of a top-level leaf."""
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in leaves(f"{a}.{f.name}", f"{b}.{f.name}", f.dataType, f"{path}.{f.name}", num(DEFAULT_WEIGHT))]
    if isinstance(kind, T.ArrayType):
        places = f"range(1, least(len({a}), len({b})) + 1)"
        names = [f".{f.name}" for f in kind.elementType.fields] if isinstance(kind.elementType, T.StructType) else [""]
        known = [f"len(list_filter({places}, lambda i: {a}[i]{n} IS NOT NULL AND {b}[i]{n} IS NOT NULL))" for n in names]
        same = [f"len(list_filter({places}, lambda i: coalesce({a}[i]{n} = {b}[i]{n}, false)))" for n in names]
        return [(f"(CASE WHEN {both} THEN {plus(known)} * {num(DEFAULT_WEIGHT)} ELSE 0::DOUBLE END)", f"(CASE WHEN {both} THEN {plus(same)} * {num(DEFAULT_WEIGHT)} ELSE 0::DOUBLE END)")]
    like = {"userAgent": folded(a, b), "platform": folded(a, b)}.get(path, f"({a} = {b})::INT::DOUBLE")
    return [(f"(CASE WHEN {both} THEN {weight} ELSE 0::DOUBLE END)", f"(CASE WHEN {both} THEN {weight} * {like} ELSE 0::DOUBLE END)")]


def ratio(parts: list[tuple[str, str]], fallback: str) -> str:
    weight, matched = plus([w for w, _ in parts]), plus([m for _, m in parts])
    return f"(CASE WHEN {weight} > 0 THEN {matched} / {weight} ELSE {fallback} END)"


def similarity(a: str, b: str, name: str) -> str:
    """Of one field that both sides have."""
    kind = FINGERPRINT[name].dataType
    if name in ("userAgent", "platform"):
        return folded(a, b)
    if name in JACCARD:
        return jaccard(a, b)
    if name == "screen":
        return screen(a, b)
    if name == "highEntropyValues":
        same = f"({canonical(a, kind)} = {canonical(b, kind)})::INT::DOUBLE"
        return ratio(leaves(a, b, kind, name, num(DEFAULT_WEIGHT)), same)
    return f"({a} = {b})::INT::DOUBLE"


def whole_similarity(a: str, b: str, name: str) -> str:
    """As in histories, where structs without a comparator are equal or not."""
    return f"({a} = {b})::INT::DOUBLE" if name == "highEntropyValues" else similarity(a, b, name)


def signals(fp: str) -> list[str]:
    agent = f"lower(coalesce({fp}.userAgent, ''))"
    contains = lambda x, marks: "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"
    listed = lambda values: ", ".join(f"'{v}'" for v in values)
    return [
        f"(contains(lower(coalesce({fp}.platform, '')), 'win') OR {contains(agent, MOBILE_MARKS)})",
        f"(lower(coalesce({fp}.language, '')) IN ({listed(COMMON_LANGUAGES)}))",
        contains(agent, COMMON_BROWSERS),
        f"({size(fp)} IN ({listed(COMMON_RESOLUTIONS)}))",
        f"(coalesce({fp}.hardwareConcurrency, 0) IN (4, 8) AND {memory(fp)} IN (4, 8))",
        "(NOT (" + " OR ".join(present(f"{fp}.{f}", T.StringType()) for f in ENTROPY_FIELDS) + "))",
    ]


def size(fp: str) -> str:
    return f"(CASE WHEN {fp}.screen.width <> 0 AND {fp}.screen.height <> 0 THEN {fp}.screen.width || 'x' || {fp}.screen.height ELSE '' END)"


def memory(fp: str) -> str:
    return f"coalesce(TRY_CAST({strip(f'{fp}.deviceMemory')} AS DOUBLE), 0)"


def risk(fp: str) -> str:
    return rounded(f"{plus([f'{s}::INT' for s in signals(fp)])} / 6::DOUBLE * 100")


def scores(source: str, left: str, right: str, decay: str = "1::DOUBLE", stability: str | None = None, features: bool = False) -> str:
    """CTEs that give ``scored``: the columns of ``source`` and the nine scores, without TLSH.

    stability: a map column of field weights' scale. features: the source has l_can, l_risk,
    r_can and r_risk, and they aren't computed per pair.
    """
    l, r, n = left, right, len(FIELDS)
    pres = ", ".join(f"{present(f'{l}.{f}', FINGERPRINT[f].dataType)} AS lp{i}, {present(f'{r}.{f}', FINGERPRINT[f].dataType)} AS rp{i}" for i, f in enumerate(FIELDS))
    weight = {f: num(WEIGHTS[f]) + (f" * coalesce({stability}['{f}'], 1::DOUBLE)" if stability else "") for f in FIELDS}
    sims = ", ".join(f"(CASE WHEN lp{i} AND rp{i} THEN {similarity(f'{l}.{f}', f'{r}.{f}', f)} END) AS s{i}" for i, f in enumerate(FIELDS))
    structural = ratio([x for f in FIELDS for x in leaves(f"{l}.{f}", f"{r}.{f}", FINGERPRINT[f].dataType, f, f"({weight[f]})")], "0::DOUBLE")
    own = "" if features else f", {canonical_fingerprint(l)} AS l_can, {canonical_fingerprint(r)} AS r_can, {risk(l)} AS l_risk, {risk(r)} AS r_risk"
    at = {f: i for i, f in enumerate(FIELDS)}

    def subset(names: list[str]) -> str:
        w = plus([f"(CASE WHEN s{at[f]} IS NOT NULL THEN {weight[f]} ELSE 0::DOUBLE END)" for f in names])
        m = plus([f"(CASE WHEN s{at[f]} IS NOT NULL THEN {weight[f]} * s{at[f]} ELSE 0::DOUBLE END)" for f in names])
        return f"(CASE WHEN {w} > 0 THEN {rounded(f'{m} / {w} * 100')} ELSE 50 END)"

    comparable = plus([f"(s{i} IS NOT NULL)::INT" for i in range(n)])
    agreeing = plus([f"coalesce((s{i} >= 0.9::DOUBLE)::INT, 0)" for i in range(n)])
    rich = [rounded(f"{plus([f'{s}p{i}::INT' for i in range(n)])} / {n}::DOUBLE * 100") for s in "lr"]
    dims = {
        "deviceSimilarity": rounded("structural * 100"),
        "evidenceRichness": rounded(f"({rich[0]} + {rich[1]}) / 2::DOUBLE"),
        "fieldAgreement": f"(CASE WHEN {comparable} > 0 THEN {rounded(f'{agreeing} / {comparable}::DOUBLE * 100')} ELSE 50 END)",
        "structuralStability": subset(STABLE_FIELDS),
        "entropyContribution": subset(ENTROPY_FIELDS),
        "attractorRisk": rounded("(l_risk + r_risk) / 2::DOUBLE"),
        "missingOneSide": rounded(f"{plus([f'(lp{i} <> rp{i})::INT' for i in range(n)])} / {n}::DOUBLE * 100"),
        "missingBothSides": rounded(f"{plus([f'(NOT lp{i} AND NOT rp{i})::INT' for i in range(n)])} / {n}::DOUBLE * 100"),
    }
    ds, fa = '("deviceSimilarity" / 100::DOUBLE)', '("fieldAgreement" / 100::DOUBLE)'
    fw = f"(0.18::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * decay))"
    gained = f"({ds} * 0.62::DOUBLE + \"evidenceRichness\" / 100::DOUBLE * 0.06::DOUBLE + {fa} * {fw} + \"structuralStability\" / 100::DOUBLE * 0.08::DOUBLE + \"entropyContribution\" / 100::DOUBLE * 0.06::DOUBLE)"
    most = f"(0.62::DOUBLE + 0.06::DOUBLE + {fw} + 0.08::DOUBLE + 0.06::DOUBLE)"
    ar = '("attractorRisk" / 100::DOUBLE)'
    low = f"(CASE WHEN \"deviceSimilarity\" >= 60 THEN 0::DOUBLE ELSE (60 - \"deviceSimilarity\") / 60::DOUBLE * (1 - {fa}) END)"
    lost = f"({ar} * {ar} * (0.35::DOUBLE + {fa} * 0.4::DOUBLE + {ds} * 0.25::DOUBLE) * 0.55::DOUBLE + (1 - {fa}) * (1 - {ds}) * 0.08::DOUBLE * decay + {low} * 0.16::DOUBLE * decay + \"missingOneSide\" / 100::DOUBLE * 0.02::DOUBLE + \"missingBothSides\" / 100::DOUBLE * 0.01::DOUBLE)"
    raw = rounded(f"({gained} - {lost}) / {most} * 100 + 15")
    ceiling = 'greatest(95, least(99, "deviceSimilarity" + 12))'
    aged = f"floor({ceiling} * (0.5::DOUBLE + 0.5::DOUBLE * decay) + 35 * (1 - decay) + 0.5::DOUBLE)"
    limit = f"greatest(70, CASE WHEN decay >= 1 THEN {ceiling} ELSE {aged} END)"
    composite = f"(CASE WHEN l_can = r_can THEN CASE WHEN \"attractorRisk\" < 70 THEN 100 ELSE {raw} END ELSE least({raw}, {limit}) END)::INT"
    return (
        f"f1 AS MATERIALIZED (SELECT *, {pres}{own}, {decay} AS decay FROM {source}), "
        f"f2 AS MATERIALIZED (SELECT *, {sims}, {structural} AS structural FROM f1), "
        f"f3 AS MATERIALIZED (SELECT *, {', '.join(f'{x} AS \"{k}\"' for k, x in dims.items())} FROM f2), "
        f"scored AS MATERIALIZED (SELECT *, {composite} AS composite FROM f3)"
    )


def history(n: int | None, source: str = "snapshots") -> str:
    """CTEs ``once`` (snapshots once each) and ``hist`` (all or the n newest of each device, with rank)."""
    return (
        f"once AS MATERIALIZED (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY device_id, snapshot_id ORDER BY received_at) AS k FROM {source} WHERE device_id IS NOT NULL) WHERE k = 1), "
        f"hist AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, snapshot_id) AS rank FROM once) WHERE {f'rank <= {n}' if n else 'true'})"
    )


def consecutive(n: int | None = None) -> str:
    """CTE ``pairs``: neighbours among all, or the n newest, snapshots of each device, l the newer."""
    return (
        history(n) + ", pairs AS MATERIALIZED (SELECT a.device_id, a.rank, a.snapshot_id, a.ts, b.ts AS older_ts, a.fingerprint AS l, b.fingerprint AS r "
        "FROM hist a JOIN hist b ON a.device_id = b.device_id AND b.rank = a.rank + 1)"
    )


AGE = "(epoch_us(ts) // 1000 - epoch_us(older_ts) // 1000)"


def decay(age: str) -> str:
    return f"(CASE WHEN {age} <= 0 THEN 1::DOUBLE ELSE exp(-{age} / 2592000000.0::DOUBLE) END)"


def stability(n: int, strict: bool) -> str:
    """CTEs up to ``stable``: one column per field."""
    def one(i: int, f: str) -> str:
        kind = FINGERPRINT[f].dataType
        both = f"{present(f'l.{f}', kind)} AND {present(f'r.{f}', kind)}" if strict else f"l.{f} IS NOT NULL AND r.{f} IS NOT NULL"
        return f"coalesce(avg(CASE WHEN {both} THEN {whole_similarity(f'l.{f}', f'r.{f}', f)} END), 1) AS \"{f}\""

    return consecutive(n) + f", stable AS MATERIALIZED (SELECT device_id, {', '.join(one(i, f) for i, f in enumerate(FIELDS))} FROM pairs GROUP BY device_id)"


def subnet_visits(peers: int = 200) -> str:
    """CTEs up to ``met``: visit after visit of each /24, every visitor meets the devices then listed, first in, first out."""
    return (
        "visits AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY net ORDER BY ts, snapshot_id, device_id) AS k FROM (SELECT DISTINCT regexp_extract(ip, '^(\\d+\\.\\d+\\.\\d+)\\.\\d+$', 1) AS net, device_id, ts, snapshot_id FROM snapshots "
        "WHERE device_id IS NOT NULL AND ip IS NOT NULL AND ts IS NOT NULL) WHERE net <> ''), "
        "listing(net, k, ts, device_id, found, listed) AS (SELECT net, k, ts, device_id, CAST([] AS VARCHAR[]), [device_id] FROM visits WHERE k = 1 "
        "UNION ALL SELECT v.net, v.k, v.ts, v.device_id, l.listed, CASE WHEN list_contains(l.listed, v.device_id) THEN l.listed "
        f"WHEN len(l.listed) >= {peers} THEN list_append(l.listed[2:], v.device_id) ELSE list_append(l.listed, v.device_id) END FROM listing l JOIN visits v ON v.net = l.net AND v.k = l.k + 1), "
        "met AS (SELECT device_id AS a, unnest(found) AS b, ts FROM listing)"
    )


def bands(source: str, key: str, fp: str, name: str) -> str:
    """CTEs up to ``name`` (key, band, rows): the MinHash bands of the fingerprints ``fp`` in ``source``, rows being the band's part of the signature."""
    low = "4294967295::UBIGINT"
    first = [(int(s) * 0x9E3779B9 % 2**32) ^ 0x811C9DC5 for s in seeds(HASHES)]
    spread = f"list_reduce(list_transform(string_split(token, ''), lambda c: unicode(c)::UBIGINT), lambda h, u: (xor(h, u) * 16777619::UBIGINT) & {low}, seed)"
    mixed = f"(xor(h, h >> 16) * 73244475::UBIGINT) & {low}"
    listed = ", ".join(f"list_transform(list_filter(coalesce({fp}.{f}, []), lambda x: x <> ''), lambda x: '{f[0]}:' || x)" for f in ("fonts", "languages"))
    return (
        f"{name}_held AS MATERIALIZED (SELECT DISTINCT {key}, unnest(list_concat({listed})) AS token FROM {source}), "
        f"{name}_seeds AS (SELECT unnest({first})::UBIGINT AS seed, unnest(range({HASHES})) AS i), "
        f"{name}_h AS (SELECT token, i, {spread} AS h FROM (SELECT DISTINCT token FROM {name}_held), {name}_seeds), "
        f"{name}_m AS (SELECT token, i, {mixed} AS h FROM {name}_h), "
        f"{name}_s AS MATERIALIZED (SELECT token, i, xor(h, h >> 16)::BIGINT AS v FROM {name}_m), "
        f"{name}_sig AS (SELECT {key}, i, min(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END) AS v FROM {name}_held JOIN {name}_s USING (token) GROUP BY ALL), "
        f"{name} AS MATERIALIZED (SELECT {key}, (i // {HASHES // BANDS})::INT AS band, string_agg(v::VARCHAR, ',' ORDER BY i) AS rows FROM {name}_sig GROUP BY ALL)"
    )
