"""Similarity of two fingerprints: eight dimensions and one calibrated composite, 0 to 100.

All options are resolved when the plan is built, and the whole breakdown is one
projection. What depends on one side only (presence, canonical text, risk, digest) is
computed by ``features`` once per record, before records are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kenmark.functions.registry import ScoringOptions
from kenmark.functions.similarity import canonical_string, decay, exact, present, round_half_up, score, total, unit
from kenmark.functions.tlsh import MAX_DISTANCE, digest_udf, distance_udf
from kenmark.operators.attractor import attractor_risk
from kenmark.schema import ENTROPY_FIELDS, FIELDS, FINGERPRINT, SCORES, STABLE_FIELDS, VOLATILE, WEIGHTS

# Share of each dimension in the composite, penalties and the offset.
POSITIVE = {"deviceSimilarity": 0.62, "evidenceRichness": 0.06, "fieldAgreement": 0.18, "structuralStability": 0.08, "entropyContribution": 0.06}
PENALTY = {"attractor": 0.55, "mismatch": 0.08, "low": 0.16, "missingOneSide": 0.02, "missingBothSides": 0.01}
OFFSET = 15

_COMPARABLE = T.StructType([f for f in FINGERPRINT.fields if f.name != VOLATILE])


def comparable(fp: Column) -> Column:
    """The fingerprint without its volatile member."""
    return F.struct(*(fp[f].alias(f) for f in FIELDS))


def richness(fp: Column) -> Column:
    return score(total([present(fp[f], FINGERPRINT[f].dataType).cast("int") for f in FIELDS]) / len(FIELDS) * 100)


def canonical_fingerprint(fp: Column) -> Column:
    return canonical_string(comparable(fp), _COMPARABLE)


def features(df: DataFrame, struct: str = "fingerprint", options: ScoringOptions | None = None, prefix: str = "") -> DataFrame:
    """Adds ``_present``, ``_canonical`` (an MD5 of the canonical text), ``_risk`` and, if TLSH counts, ``_digest``."""
    options = options or ScoringOptions()
    fp = F.col(struct)
    model = options.attractor_model or attractor_risk
    columns = {
        f"{prefix}_present": F.array(*(present(fp[f], FINGERPRINT[f].dataType) for f in FIELDS)),
        f"{prefix}_canonical": canonical_fingerprint(fp) if options.tlsh_weight > 0 else F.md5(canonical_fingerprint(fp)),
        f"{prefix}_risk": F.greatest(F.lit(0), F.least(F.lit(100), model(fp))),
    }
    out = df.withColumns(columns)
    if options.tlsh_weight > 0:
        out = out.withColumn(f"{prefix}_digest", digest_udf(f"{prefix}_canonical")).withColumn(f"{prefix}_canonical", F.md5(f"{prefix}_canonical"))
    return out


def _leaves(a: Column, b: Column, kind: T.DataType, path: str, depth: int, options: ScoringOptions, scale) -> list[tuple[Column, Column]]:
    """(weight, weight times similarity) of each leaf below a path; absent values have no weight."""
    if depth > options.max_depth:
        return []
    both = a.isNotNull() & b.isNotNull()
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(a[f.name], b[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, depth + 1, options, scale)]
    if isinstance(kind, T.ArrayType):
        return [_list_leaves(a, b, kind.elementType, path, depth, options)]
    comparator = options.comparator(path)
    similarity = unit(comparator(a, b, path)) if comparator else (a == b).cast("double")
    weight = scale(path)
    return [(F.when(both, weight).otherwise(0.0), F.when(both, weight * similarity).otherwise(0.0))]


def _list_leaves(a: Column, b: Column, kind: T.DataType, path: str, depth: int, options: ScoringOptions) -> tuple[Column, Column]:
    """Lists are compared place by place up to the shorter one; their elements have the default weight."""
    if depth + 1 > options.max_depth:
        return F.lit(0.0), F.lit(0.0)
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    members = [(f.name, f.dataType) for f in kind.fields] if isinstance(kind, T.StructType) else [(None, kind)]
    weights, matches = [], []
    for name, _ in members:
        get = (lambda p, side, name=name: p[side][name]) if name else (lambda p, side: p[side])
        known = lambda p, get=get: get(p, "x").isNotNull() & get(p, "y").isNotNull()
        equal = lambda p, get=get: get(p, "x") == get(p, "y")
        weights.append(F.size(F.filter(pairs, _one(known))))
        matches.append(F.size(F.filter(pairs, _one(equal))))
    some = a.isNotNull() & b.isNotNull() & (n > 0)
    return (
        F.when(some, total(weights) * options.default_weight).otherwise(0.0),
        F.when(some, total(matches) * options.default_weight).otherwise(0.0),
    )


def _one(f):
    return lambda p: f(p)


def _ratio(parts: list[tuple[Column, Column]], fallback: Column) -> Column:
    if not parts:
        return fallback
    weight, matched = total([w for w, _ in parts]), total([m for _, m in parts])
    return F.when(weight > 0, matched / weight).otherwise(fallback)


def field_similarity(a: Column, b: Column, name: str, options: ScoringOptions) -> Column:
    """Of one top-level field that both sides have."""
    kind = FINGERPRINT[name].dataType
    comparator = options.comparator(name)
    if comparator:
        return F.when(a.isNull() | b.isNull(), 0.0).otherwise(unit(comparator(a, b, name)))
    if isinstance(kind, (T.StructType, T.ArrayType)):
        same = (canonical_string(a, kind) == canonical_string(b, kind)).cast("double")
        return _ratio(_leaves(a, b, kind, name, 0, options, lambda p: F.lit(options.weight(p))), same)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(exact(a, b))


def _stability(options: ScoringOptions, names: list[str]) -> Column:
    if options.stabilities is None:
        return F.lit(1.0)
    return total([F.coalesce(options.stabilities[f], F.lit(1.0)) for f in names]) / len(names)


def dimension_weights(options: ScoringOptions) -> dict[str, Column]:
    """How much each dimension counts, given the stability of fields; 1 where nothing is known."""
    whole = _stability(options, FIELDS)
    return {
        "deviceSimilarity": whole,
        "evidenceRichness": F.lit(1.0),
        "fieldAgreement": whole,
        "structuralStability": _stability(options, STABLE_FIELDS),
        "entropyContribution": _stability(options, ENTROPY_FIELDS),
    }


def score_pairs(df: DataFrame, left: str, right: str, options: ScoringOptions | None = None, prefixes: tuple[str, str] | None = None) -> DataFrame:
    """Adds the nine scores of the fingerprint columns ``left`` and ``right``.

    With ``prefixes`` the columns of ``features`` are taken from the frame, else they are
    computed. Where TLSH counts and a side is too short for a digest, all scores are 0.
    """
    options = options or ScoringOptions()
    kept = df.columns
    if prefixes is None:
        prefixes = ("_l", "_r")
        df = features(features(df, left, options, "_l"), right, options, "_r")
    l, r = F.col(left), F.col(right)
    use_tlsh = options.tlsh_weight > 0
    pl, pr = (F.col(f"{p}_present") for p in prefixes)
    both = {f: pl[i] & pr[i] for i, f in enumerate(FIELDS)}
    scaled = lambda path: F.lit(options.weight(path)) * (F.coalesce(options.field_stabilities[path], F.lit(1.0)) if options.field_stabilities is not None and path in WEIGHTS else F.lit(1.0))

    similar = [f"_s{i}" for i in range(len(FIELDS))]
    # Compared scalars count as fields and as leaves, so each is compared once.
    once = {f: f"_x{i}" for i, f in enumerate(FIELDS) if options.comparator(f) and not isinstance(FINGERPRINT[f].dataType, (T.StructType, T.ArrayType)) and options.max_depth >= 1}
    known = {f: l[f].isNotNull() & r[f].isNotNull() for f in once}
    df = df.withColumns({x: F.when(known[f], unit(options.comparator(f)(l[f], r[f], f))) for f, x in once.items()}) if once else df
    df = df.withColumns({s: F.when(both[f], F.coalesce(once[f], F.lit(0.0)) if f in once else field_similarity(l[f], r[f], f, options)) for s, f in zip(similar, FIELDS)})
    of = dict(zip(FIELDS, similar))
    leaf = lambda f: [(F.when(known[f], scaled(f)).otherwise(0.0), F.when(known[f], scaled(f) * F.col(once[f])).otherwise(0.0))]
    structural = _ratio([x for f in FIELDS for x in (leaf(f) if f in once else _leaves(l[f], r[f], FINGERPRINT[f].dataType, f, 1, options, scaled))], F.lit(0.0))
    df = df.withColumn("_structural", structural)
    if use_tlsh:
        df = df.withColumn("_distance", distance_udf(f"{prefixes[0]}_digest", f"{prefixes[1]}_digest"))
        df = df.withColumn("_fuzzy", F.when(F.col("_distance").isNotNull(), F.greatest(F.lit(0.0), (MAX_DISTANCE - F.col("_distance")) / MAX_DISTANCE)))
    else:
        df = df.withColumn("_fuzzy", F.lit(1.0))

    def subset(names: list[str]) -> Column:
        weight = total([F.when(F.col(of[f]).isNotNull(), scaled(f)).otherwise(0.0) for f in names])
        matched = total([F.when(F.col(of[f]).isNotNull(), scaled(f) * F.col(of[f])).otherwise(0.0) for f in names])
        return F.when(weight > 0, score(matched / weight * 100)).otherwise(50)

    comparable_n = total([F.col(s).isNotNull().cast("int") for s in similar])
    agreeing = total([F.coalesce((F.col(s) >= 0.9).cast("int"), F.lit(0)) for s in similar])
    n = len(FIELDS)
    rich = [total([p[i].cast("int") for i in range(n)]) for p in (pl, pr)]
    df = df.withColumns(
        {
            "deviceSimilarity": score((F.col("_structural") * (1 - options.tlsh_weight) + F.col("_fuzzy") * options.tlsh_weight) * 100),
            "evidenceRichness": score((score(rich[0] / n * 100) + score(rich[1] / n * 100)) / 2),
            "fieldAgreement": F.when(comparable_n > 0, score(agreeing / comparable_n * 100)).otherwise(50),
            "structuralStability": subset(STABLE_FIELDS),
            "entropyContribution": subset(ENTROPY_FIELDS),
            "attractorRisk": score((F.col(f"{prefixes[0]}_risk") + F.col(f"{prefixes[1]}_risk")) / 2),
            "missingOneSide": score(total([(pl[i] != pr[i]).cast("int") for i in range(n)]) / n * 100),
            "missingBothSides": score(total([(~pl[i] & ~pr[i]).cast("int") for i in range(n)]) / n * 100),
        }
    )
    same = F.col(f"{prefixes[0]}_canonical") == F.col(f"{prefixes[1]}_canonical")
    df = df.withColumn("_decay", F.lit(1.0) if options.age is None else F.coalesce(decay(options.age, options.decay_tau_ms), F.lit(1.0)))
    df = df.withColumn("composite", composite(same, F.col("_decay"), dimension_weights(options)))
    if use_tlsh:
        df = df.withColumns({s: F.when(F.col("_fuzzy").isNull(), 0).otherwise(F.col(s)) for s in SCORES})
    return df.select(*kept, *SCORES)


def dimension(df: DataFrame, left: str, right: str, name: str, options: ScoringOptions | None = None) -> DataFrame:
    """Adds one of the nine scores alone, as ``value``; what only the others need isn't computed."""
    if name not in SCORES:
        raise ValueError(f"no score {name}; one of {', '.join(SCORES)}")
    return score_pairs(df, left, right, options).select(*df.columns, F.col(name).alias("value"))


def composite(same: Column, decay_factor: Column, adaptive: dict[str, Column]) -> Column:
    """The calibrated score from the eight dimensions (columns of those names)."""
    part = {d: F.col(d) / 100 for d in ("deviceSimilarity", "evidenceRichness", "fieldAgreement", "structuralStability", "entropyContribution", "attractorRisk", "missingOneSide", "missingBothSides")}
    weight = {d: F.lit(w) for d, w in POSITIVE.items()}
    weight["fieldAgreement"] = F.lit(POSITIVE["fieldAgreement"]) * (0.5 + 0.5 * decay_factor)
    gained = total([part[d] * weight[d] * adaptive[d] for d in POSITIVE])
    most = total([weight[d] * adaptive[d] for d in POSITIVE])
    alike, agreed = part["deviceSimilarity"], part["fieldAgreement"]
    lost = total(
        [
            part["attractorRisk"] * part["attractorRisk"] * (0.35 + agreed * 0.4 + alike * 0.25) * PENALTY["attractor"],
            (1 - agreed) * (1 - alike) * PENALTY["mismatch"] * decay_factor,
            F.when(F.col("deviceSimilarity") >= 60, 0.0).otherwise((60 - F.col("deviceSimilarity")) / 60 * (1 - agreed)) * PENALTY["low"] * decay_factor,
            part["missingOneSide"] * PENALTY["missingOneSide"],
            part["missingBothSides"] * PENALTY["missingBothSides"],
        ]
    )
    raw = F.when(most > 0, score((gained - lost) / most * 100 + OFFSET)).otherwise(F.col("deviceSimilarity"))
    ceiling = F.greatest(F.lit(95), F.least(F.lit(99), F.col("deviceSimilarity") + 12))
    aged = round_half_up(ceiling * (0.5 + 0.5 * decay_factor) + 35 * (1 - decay_factor))
    limit = F.greatest(F.lit(70), F.when(decay_factor >= 1, ceiling).otherwise(aged))
    return F.when(same, F.when(F.col("attractorRisk") < 70, 100).otherwise(raw)).otherwise(F.least(raw, limit)).cast("int")
