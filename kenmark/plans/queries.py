"""Queries of the core, by name: (session, folder of tables) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kenmark.functions import similarity as sim
from kenmark.functions.generate import scenario_pairs
from kenmark.functions.minhash import band_table, tokens
from kenmark.functions.registry import ScoringOptions
from kenmark.functions.text import normalised
from kenmark.functions.tlsh import digest_udf
from kenmark.operators import blocking, evaluate, fuzzy, graph
from kenmark.operators import drift as drifts
from kenmark.operators import identify as identification
from kenmark.operators import store as stores
from kenmark.operators.attractor import attractor_risk, frequency_model
from kenmark.operators.heavy import latest_snapshots
from kenmark.operators.history import FOLLOWED_TEXT, fingerprint_history
from kenmark.operators.nested import ENVELOPE, payload_children
from kenmark.operators.scoring import canonical_fingerprint, dimension_weights, richness, score_pairs
from kenmark.plans import sql
from kenmark.schema import FIELDS, SCORES

Query = Callable[[SparkSession, str], DataFrame]

#: Scoring without fuzzy digests, which SQL can't express.
PLAIN = ScoringOptions(tlsh_weight=0.0)
# A sample of population frequencies.
FREQUENCIES = {
    "platforms": {"Win32": 0.72, "MacIntel": 0.18, "iPhone": 0.05},
    "languages": {"en-US": 0.45, "de": 0.2, "es": 0.15},
    "browsers": {"Edg/": 0.1, "Chrome/": 0.65, "Firefox/": 0.05},
    "resolutions": {"1920x1080": 0.48, "2560x1440": 0.22, "1366x768": 0.1},
    "hardware": [(8.0, 8.0, 0.3), (4.0, 8.0, 0.2), (16.0, 32.0, 0.1)],
}
#: Dates of the retention and prune queries.
NOW, RETENTION_DAYS, EDGE_AGE_MS = "2026-01-01 00:00:00", 90, 120 * sim.DAY_MS
REPORT_DEVICE = "dv_0000000000000000"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


#: Columns of times, which queries and SQL give as microseconds since 1970: engines differ in how they show times.
TIMES = {
    **dict.fromkeys(["evidence_richness", "attractor_risk", "attractor_freq_model", "canonical_fingerprint", "lsh_tokens"], ["received_at"]),
    **dict.fromkeys(["history_last_n", "latest_per_device", "dedup_window"], ["ts"]),
    **dict.fromkeys(["candidates_none", "candidates_any_key", "candidates_all_keys", "candidate_topk"], ["last_seen"]),
    **dict.fromkeys(["subnet_edges", "edges_folded"], ["first_seen", "last_seen"]),
    "device_user_link": ["linked_at"],
    "as_of_latest": ["query_ts", "ts"],
    "edge_prune": ["last_seen"],
}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    times = TIMES.get(name, [])

    def register(f: Query) -> Query:
        _QUERIES[name] = (lambda spark, folder: f(spark, folder).withColumns({t: F.unix_micros(t) for t in times})) if times else f
        if oracle:
            replaced = ", ".join(f"epoch_us({t}) AS {t}" for t in times)
            _SQL[name] = f"SELECT * REPLACE ({replaced}) FROM ({oracle})" if times else oracle
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return stores.neighbours(table(spark, folder, "snapshots"))


def once(incoming: DataFrame) -> DataFrame:
    """Each incoming snapshot as it came first."""
    first = lambda c: F.min_by(c, F.struct("batch_no", "received_at")).alias(c)
    return incoming.groupBy("snapshot_id").agg(*(first(c) for c in ("device_id", "ts", "fingerprint")))


def every_arrival(spark: SparkSession, folder: str) -> DataFrame:
    """Every incoming snapshot as it came first."""
    return once(table(spark, folder, "incoming"))


def search_set(spark: SparkSession, folder: str) -> DataFrame:
    """A smaller query set of searches: incoming snapshots whose id is divisible by 50."""
    divisible = F.conv(F.substring("snapshot_id", -6, 6), 16, 10).cast("long") % 50 == 0
    return once(table(spark, folder, "incoming").where(divisible))


_ONCE = "arrived AS MATERIALIZED (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY batch_no, received_at) AS k FROM incoming) WHERE k = 1)"
_ASKED = _ONCE + ", asked AS MATERIALIZED (SELECT snapshot_id AS query_id, ts AS query_ts, fingerprint AS q FROM arrived WHERE ('0x' || right(snapshot_id, 6))::BIGINT % 50 = 0)"
_EVERY = _ONCE + ", asked AS MATERIALIZED (SELECT snapshot_id AS query_id, ts AS query_ts, fingerprint AS q FROM arrived)"
_HELD = sql.history(1) + ", held AS MATERIALIZED (SELECT device_id, ts, fingerprint AS h FROM hist)"
_SCORES = ", ".join(f'"{s}"' for s in SCORES)


# Problems of TESTDATA.md.


def _versions_sql() -> str:
    text = lambda f: f"nullif(lower({sql.strip(f'fingerprint.{f}')}), '')"
    values = {f: text(f) for f in FOLLOWED_TEXT}
    values |= {"cores": "fingerprint.hardwareConcurrency", "memory": f"TRY_CAST({sql.strip('fingerprint.deviceMemory')} AS DOUBLE)", "width": "fingerprint.screen.width", "height": "fingerprint.screen.height"}
    values["fonts"] = f"nullif(list_sort(list_distinct(list_filter(list_transform(fingerprint.fonts, lambda x: lower({sql.strip('x')})), lambda x: x <> ''))), [])"
    before = ", ".join(f"lag({v} IGNORE NULLS) OVER w AS p{i}" for i, v in enumerate(values))
    differs = " OR ".join(f"coalesce({v} <> p{i}, false)" for i, v in enumerate(values))
    return (
        "WITH seen AS (SELECT device_id, snapshot_id, ts, " + ", ".join(f"any_value({x}) AS {v}" for v, x in values.items()) + " FROM snapshots WHERE device_id IS NOT NULL GROUP BY device_id, snapshot_id, ts), "
        f"led AS (SELECT *, row_number() OVER w AS k, {before} FROM seen WINDOW w AS (PARTITION BY device_id ORDER BY ts, snapshot_id)) SELECT device_id, snapshot_id FROM led WHERE k = 1 OR {differs}"
    )


@query("p1_found", _versions_sql())
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_history(table(spark, folder, "snapshots")).select("device_id", "snapshot_id")


def _payload_sql() -> str:
    """JSON text opened, envelopes taken off and both spellings of names tried, level by level."""
    opened = lambda x: f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') AND left(ltrim({x} ->> '$'), 1) IN ('{{', '[') THEN ({x} ->> '$')::JSON ELSE {x} END)"
    step = lambda j, kinds: f"(CASE WHEN json_type({j}) = 'OBJECT' THEN coalesce({', '.join(f'''CASE WHEN json_type({opened(f'''json_extract({j}, '$.{n}')''')}) IN ({kinds}) THEN {opened(f'''json_extract({j}, '$.{n}')''')} END''' for n in ENVELOPE)}, {j}) ELSE {j} END)"
    either = lambda r, *names: "coalesce(" + ", ".join(f"CASE WHEN json_type(json_extract({r}, '$.{n}')) <> 'NULL' THEN json_extract({r}, '$.{n}') END" for n in names) + ")"
    whole, single = "'OBJECT', 'ARRAY'", "'OBJECT'"
    ctes = ["t0 AS (SELECT payload_id, body::JSON AS j FROM payloads WHERE json_valid(body))", f"t1 AS (SELECT payload_id, {opened('j')} AS j FROM t0)"]
    ctes += [f"t{i + 1} AS MATERIALIZED (SELECT payload_id, {step('j', whole)} AS j FROM t{i})" for i in range(1, 4)]
    ctes.append("r0 AS (SELECT payload_id, unnest(range(len(l))) AS rec, unnest(l) AS j FROM (SELECT payload_id, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS l FROM t4))")
    ctes.append(f"r1 AS (SELECT payload_id, rec, {opened('j')} AS j FROM r0)")
    ctes += [f"r{i + 1} AS MATERIALIZED (SELECT payload_id, rec, {step('j', single)} AS j FROM r{i})" for i in range(1, 3)]
    ctes.append("records AS MATERIALIZED (SELECT payload_id, rec, j FROM r3 WHERE json_type(j) = 'OBJECT')")
    ctes.append(f"parts AS MATERIALIZED (SELECT payload_id, rec, {opened(either('j', 'highEntropyValues', 'high_entropy_values'))} AS hev, {opened(either('j', 'screen'))} AS screen, {opened(either('j', 'behavioralMetrics', 'behavioral_metrics'))} AS b FROM records)")
    one = {"highEntropyValues": "hev", "screen": "screen", "orientation": opened("json_extract(screen, '$.orientation')")} | {n: opened(f"json_extract(b, '$.{n}')") for n in ("mouse", "keyboard", "scroll", "session")}
    ctes.append("objects AS (" + " UNION ALL ".join(f"SELECT payload_id, rec, '{n}' AS child, {x} AS o FROM parts" for n, x in one.items()) + ")")
    ctes.append(f"listed AS (SELECT payload_id, rec, {opened(either('hev', 'brands'))} AS l FROM parts WHERE json_type(hev) = 'OBJECT')")
    ctes.append("entries AS (SELECT payload_id, rec, unnest(range(len(e))) AS pos, unnest(e) AS e FROM (SELECT payload_id, rec, CASE WHEN json_type(l) = 'ARRAY' THEN json_extract(l, '$[*]') ELSE [l] END AS e FROM listed WHERE l IS NOT NULL))")
    ctes.append(f"brands AS (SELECT payload_id, rec, pos, CASE WHEN json_type({opened('e')}) = 'OBJECT' THEN json_extract_string({opened('e')}, '$.brand') WHEN json_type(e) <> 'NULL' THEN e ->> '$' END AS item FROM entries)")
    filled = "len(list_filter(json_extract(o, '$.*'), lambda v: json_type(v) <> 'NULL' AND v::VARCHAR NOT IN ('{}', '[]', '\"{}\"', '\"[]\"'))) > 0"
    return f"WITH {', '.join(ctes)} SELECT payload_id, rec::INT AS rec, child, 0 AS pos, '' AS item FROM objects WHERE json_type(o) = 'OBJECT' AND {filled} UNION ALL SELECT payload_id, rec::INT, 'brands', pos::INT, item FROM brands WHERE item IS NOT NULL"


@query("p4_found", _payload_sql())
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return payload_children(table(spark, folder, "payloads"))


@query(
    "p5_found",
    f"SELECT platform, width, height, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY platform, width, height ORDER BY ts DESC, snapshot_id) AS k FROM "
    f"(SELECT DISTINCT lower({sql.strip('fingerprint.platform')}) AS platform, fingerprint.screen.width AS width, fingerprint.screen.height AS height, snapshot_id, ts FROM snapshots) "
    "WHERE platform IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL) WHERE k <= 3",
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return latest_snapshots(table(spark, folder, "snapshots")).drop("ts")


# Scoring.


def scored_pairs(spark: SparkSession, folder: str, options: ScoringOptions = PLAIN) -> DataFrame:
    return score_pairs(pairs(spark, folder), "l", "r", options)


_SCORED = f"WITH {sql.consecutive()}, {sql.scores('pairs', 'l', 'r')} "


@query("score_breakdown", _SCORED + f"SELECT device_id, snapshot_id, {_SCORES} FROM scored")
def score_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return scored_pairs(spark, folder).select("device_id", "snapshot_id", *SCORES)


@query(
    "score_breakdown_aged",
    f"WITH {sql.consecutive()}, {sql.scores('pairs', 'l', 'r', sql.decay(sql.AGE))} SELECT device_id, snapshot_id, {_SCORES} FROM scored",
)
def score_breakdown_aged(spark: SparkSession, folder: str) -> DataFrame:
    options = ScoringOptions(tlsh_weight=0.0, age=sim.age_ms(F.col("ts"), F.col("older_ts")))
    return scored_pairs(spark, folder, options).select("device_id", "snapshot_id", *SCORES)


def _dimension(name: str, columns: list[str]) -> None:
    chosen = ", ".join(f'"{c}"' for c in columns)

    @query(name, _SCORED + f"SELECT device_id, snapshot_id, {chosen} FROM scored")
    def one(spark: SparkSession, folder: str) -> DataFrame:
        return scored_pairs(spark, folder).select("device_id", "snapshot_id", *columns)


_dimension("field_agreement", ["fieldAgreement"])
_dimension("structural_stability", ["structuralStability"])
_dimension("entropy_contribution", ["entropyContribution"])
_dimension("missingness", ["missingOneSide", "missingBothSides"])


@query("score_breakdown_full")
def score_breakdown_full(spark: SparkSession, folder: str) -> DataFrame:
    return scored_pairs(spark, folder, ScoringOptions()).select("device_id", "snapshot_id", *SCORES)


@query(
    "evidence_richness",
    "SELECT snapshot_id, received_at, "
    + sql.rounded(f"{sql.plus([sql.present(f'fingerprint.{f}', t) + '::INT' for f, t in ((f, sql.FINGERPRINT[f].dataType) for f in FIELDS)])} / {len(FIELDS)}::DOUBLE * 100")
    + " AS richness FROM snapshots",
)
def evidence_richness(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "snapshots").select("snapshot_id", "received_at", richness(F.col("fingerprint")).alias("richness"))


@query("attractor_risk", f"SELECT snapshot_id, received_at, {sql.risk('fingerprint')} AS risk FROM snapshots")
def attractor_risk_query(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "snapshots").select("snapshot_id", "received_at", attractor_risk(F.col("fingerprint")).alias("risk"))


def _frequency_sql() -> str:
    fp = "fingerprint"
    agent, language = f"lower(coalesce({fp}.userAgent, ''))", f"lower(coalesce({fp}.language, ''))"
    cases = [
        [(f"contains(lower(coalesce({fp}.platform, '')), '{k.lower()}')", v) for k, v in FREQUENCIES["platforms"].items()],
        [(f"({language} = '{k.lower()}' OR starts_with({language}, '{k.lower()}-') OR starts_with('{k.lower()}', {language} || '-'))", v) for k, v in FREQUENCIES["languages"].items()],
        [(f"contains({agent}, '{k.lower()}')", v) for k, v in FREQUENCIES["browsers"].items()],
        [(f"{sql.size(fp)} = '{k}'", v) for k, v in FREQUENCIES["resolutions"].items()],
        [(f"coalesce({fp}.hardwareConcurrency, 0) = {c} AND {sql.memory(fp)} = {m}", v) for c, m, v in FREQUENCIES["hardware"]],
        [],
    ]
    parts = []
    for sign, rules in zip(sql.signals(fp), cases):
        whens = " ".join(f"WHEN {c} THEN {sql.num(v)}" for c, v in rules)
        parts.append(f"(CASE {whens} ELSE {sign}::INT::DOUBLE END)" if rules else f"{sign}::INT::DOUBLE")
    return f"SELECT snapshot_id, received_at, {sql.rounded(f'{sql.plus(parts)} / 6 * 100')} AS risk FROM snapshots"


@query("attractor_freq_model", _frequency_sql())
def attractor_freq_model(spark: SparkSession, folder: str) -> DataFrame:
    model = frequency_model(**FREQUENCIES)
    return table(spark, folder, "snapshots").select("snapshot_id", "received_at", model(F.col("fingerprint")).alias("risk"))


def _pair_function(name: str, column: Callable[[], F.Column], expression: str) -> None:
    @query(name, f"WITH {sql.consecutive()} SELECT device_id, snapshot_id, round({expression}, 9) AS value FROM pairs")
    def one(spark: SparkSession, folder: str) -> DataFrame:
        return pairs(spark, folder).select("device_id", "snapshot_id", F.round(column(), 9).alias("value"))


_l, _r = (lambda f: F.col("l")[f]), (lambda f: F.col("r")[f])
_pair_function("temporal_decay", lambda: sim.decay(sim.age_ms(F.col("ts"), F.col("older_ts"))), sql.decay(sql.AGE))
_pair_function("positional_similarity", lambda: sim.folded_similarity(_l("userAgent"), _r("userAgent")), sql.folded("l.userAgent", "r.userAgent"))
_pair_function("jaccard_fonts", lambda: sim.jaccard(_l("fonts"), _r("fonts"), T.ArrayType(T.StringType())), sql.jaccard("l.fonts", "r.fonts"))
_pair_function("numeric_proximity", lambda: sim.numeric_proximity(_l("hardwareConcurrency").cast("double"), _r("hardwareConcurrency").cast("double")), sql.near("l.hardwareConcurrency", "r.hardwareConcurrency"))
_pair_function("screen_similarity", lambda: sim.screen_similarity(_l("screen"), _r("screen")), sql.screen("l.screen", "r.screen"))


@query("canonical_fingerprint", f"SELECT snapshot_id, received_at, md5({sql.canonical_fingerprint('fingerprint')}) AS digest FROM snapshots")
def canonical_query(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "snapshots").select("snapshot_id", "received_at", F.md5(canonical_fingerprint(F.col("fingerprint"))).alias("digest"))


# The store.


@query("history_last_n", f"WITH {sql.history(5)} SELECT device_id, snapshot_id, rank::INT AS rank, ts FROM hist")
def history_last_n(spark: SparkSession, folder: str) -> DataFrame:
    return stores.history(table(spark, folder, "snapshots"), 5).select("device_id", "snapshot_id", "rank", "ts")


@query("latest_per_device", f"WITH {sql.history(1)} SELECT device_id, snapshot_id, ts FROM hist")
def latest_per_device(spark: SparkSession, folder: str) -> DataFrame:
    return stores.latest(table(spark, folder, "snapshots")).select("device_id", "snapshot_id", "ts")


@query(
    "as_of_latest",
    f"WITH {_ONCE}, seen AS (SELECT DISTINCT device_id, ts, snapshot_id FROM snapshots WHERE ts IS NOT NULL) SELECT a.snapshot_id AS query_id, any_value(a.device_id) AS device_id, any_value(a.ts) AS query_ts, "
    "arg_max(h.snapshot_id, struct_pack(t := epoch_us(h.ts), i := -h.k)) AS snapshot_id, max(h.ts) AS ts "
    "FROM arrived a LEFT JOIN (SELECT *, row_number() OVER (ORDER BY snapshot_id) AS k FROM seen) h ON h.device_id = a.device_id AND h.ts < a.ts GROUP BY a.snapshot_id",
)
def as_of_latest(spark: SparkSession, folder: str) -> DataFrame:
    asked = once(table(spark, folder, "incoming")).select(F.col("snapshot_id").alias("query_id"), "device_id", F.col("ts").alias("query_ts"))
    return stores.as_of(asked, table(spark, folder, "snapshots"))


@query(
    "dedup_by_hash",
    "SELECT signals_hash, min(struct_pack(ts := ts, snapshot_id := snapshot_id)).snapshot_id AS snapshot_id FROM snapshots WHERE signals_hash IS NOT NULL GROUP BY ALL "
    "UNION ALL SELECT signals_hash, snapshot_id FROM snapshots WHERE signals_hash IS NULL",
)
def dedup_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    return stores.first_by_hash(table(spark, folder, "snapshots")).select("signals_hash", "snapshot_id")


@query(
    "append_new",
    "WITH fresh AS (SELECT * FROM incoming WHERE signals_hash IS NOT NULL AND signals_hash NOT IN (SELECT signals_hash FROM snapshots WHERE signals_hash IS NOT NULL)) "
    "SELECT signals_hash, min(struct_pack(ts := ts, snapshot_id := snapshot_id)).snapshot_id AS snapshot_id FROM fresh GROUP BY ALL UNION ALL SELECT signals_hash, snapshot_id FROM incoming WHERE signals_hash IS NULL",
)
def append_new(spark: SparkSession, folder: str) -> DataFrame:
    return stores.new_by_hash(table(spark, folder, "snapshots"), table(spark, folder, "incoming")).select("signals_hash", "snapshot_id")


@query("hash_index", "SELECT signals_hash, max(struct_pack(ts := ts, snapshot_id := snapshot_id)).snapshot_id AS snapshot_id FROM snapshots WHERE signals_hash IS NOT NULL GROUP BY ALL")
def hash_index(spark: SparkSession, folder: str) -> DataFrame:
    return stores.hash_index(table(spark, folder, "snapshots"))


@query("retention_delete", f"SELECT coalesce(device_id, '') AS device_id, count(*) AS deleted FROM snapshots WHERE ts < TIMESTAMPTZ '{NOW}+00' - INTERVAL {RETENTION_DAYS} DAYS GROUP BY ALL")
def retention_delete(spark: SparkSession, folder: str) -> DataFrame:
    gone = stores.expired(table(spark, folder, "snapshots"), F.lit(NOW).cast("timestamp"), RETENTION_DAYS)
    return gone.groupBy(F.coalesce("device_id", F.lit("")).alias("device_id")).agg(F.count(F.lit(1)).alias("deleted"))


@query("device_user_link", "SELECT device_id, x.user_id AS user_id, x.ts AS linked_at FROM (SELECT device_id, max(struct_pack(ts := ts, snapshot_id := snapshot_id, user_id := user_id)) AS x FROM snapshots WHERE device_id IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL)")
def device_user_link(spark: SparkSession, folder: str) -> DataFrame:
    return stores.device_users(table(spark, folder, "snapshots"))


@query("record_decode", "SELECT payload_id, CASE WHEN json_type(body) IN ('OBJECT', 'ARRAY') THEN json_type(body) ELSE 'SCALAR' END AS kind FROM payloads WHERE json_valid(body)")
def record_decode(spark: SparkSession, folder: str) -> DataFrame:
    parsed = table(spark, folder, "payloads").select("payload_id", F.try_parse_json("body").alias("v")).where("v is not null")
    kind = F.when(F.schema_of_variant("v").startswith("ARRAY"), "ARRAY").when(F.schema_of_variant("v").startswith("OBJECT"), "OBJECT").otherwise("SCALAR")
    return parsed.select("payload_id", kind.alias("kind"))


# History and drift.


@query("field_stability", f"WITH {sql.stability(5, False)} SELECT device_id, {', '.join(f'round(\"{f}\", 9) AS \"{f}\"' for f in FIELDS)} FROM stable")
def field_stability(spark: SparkSession, folder: str) -> DataFrame:
    stable = drifts.field_stability(table(spark, folder, "snapshots"), 5)
    return stable.select("device_id", *(F.round(f, 9).alias(f) for f in FIELDS))


def _mean(names: list[str]) -> str:
    return f"round({sql.plus([f'\"{f}\"' for f in names])} / {len(names)}, 9)"


@query(
    "adaptive_weights",
    f"WITH {sql.stability(5, False)} SELECT device_id, {_mean(FIELDS)} AS \"deviceSimilarity\", {_mean(FIELDS)} AS \"fieldAgreement\", {_mean(sql.STABLE_FIELDS)} AS \"structuralStability\", {_mean(sql.ENTROPY_FIELDS)} AS \"entropyContribution\" FROM stable",
)
def adaptive_weights(spark: SparkSession, folder: str) -> DataFrame:
    mapped = drifts.stability_map(drifts.field_stability(table(spark, folder, "snapshots"), 5))
    weights = dimension_weights(ScoringOptions(stabilities=F.col("stabilities")))
    return mapped.select("device_id", *(F.round(weights[d], 9).alias(d) for d in ("deviceSimilarity", "fieldAgreement", "structuralStability", "entropyContribution")))


def _drift_sql() -> str:
    deviations = ", ".join(
        f"1 - avg(CASE WHEN {sql.present(f'q.{f}', sql.FINGERPRINT[f].dataType)} AND {sql.present(f'h.{f}', sql.FINGERPRINT[f].dataType)} THEN {sql.whole_similarity(f'q.{f}', f'h.{f}', f)} END) AS d{i}"
        for i, f in enumerate(FIELDS)
    )
    entries = ", ".join(f"struct_pack(place := {i}, field := '{f}', dev := d{i}, stab := coalesce(s.\"{f}\", 1::DOUBLE), weight := {sql.num(sql.WEIGHTS[f])})" for i, f in enumerate(FIELDS))
    return (
        f"WITH {sql.stability(10, True)}, {_ONCE}, "
        "met AS MATERIALIZED (SELECT a.device_id, a.snapshot_id, a.fingerprint AS q, b.fingerprint AS h, b.ts FROM arrived a JOIN hist b ON a.device_id = b.device_id), "
        f"per AS MATERIALIZED (SELECT device_id, snapshot_id, {deviations}, min({sql.risk('q')}) AS risk, count(*)::INT AS snapshots_analyzed, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS baseline_window_ms FROM met GROUP BY device_id, snapshot_id), "
        f"long AS MATERIALIZED (SELECT p.device_id, p.snapshot_id, unnest([{entries}]) AS e FROM per p LEFT JOIN stable s ON p.device_id = s.device_id), "
        "zs AS MATERIALIZED (SELECT device_id, snapshot_id, e.field AS field, e.place AS place, e.weight AS weight, e.stab AS stab, e.dev AS dev, e.dev / (1 - e.stab + 0.05::DOUBLE) AS z FROM long WHERE e.dev IS NOT NULL), "
        "sums AS (SELECT device_id, snapshot_id, sum(least(z, 5::DOUBLE) * weight ORDER BY place) AS zs, sum(weight * 5) AS most, count(*) FILTER (WHERE z >= 1.5::DOUBLE) AS n FROM zs GROUP BY ALL), "
        f"rated AS MATERIALIZED (SELECT p.device_id, p.snapshot_id, CASE WHEN most > 0 THEN {sql.rounded('zs / most * 100')} ELSE 0 END AS drift_score, coalesce(n, 0) AS n, risk, snapshots_analyzed, baseline_window_ms FROM per p LEFT JOIN sums USING (device_id, snapshot_id)) "
    )


@query(
    "drift_report",
    _drift_sql()
    + "SELECT device_id, snapshot_id, drift_score, n::INT AS n_suspicious, CASE WHEN drift_score >= 75 AND risk >= 50 THEN 'CANONICAL_INJECTION' WHEN drift_score >= 55 AND n <= 3 THEN 'ABRUPT_CHANGE' "
    "WHEN drift_score >= 30 THEN 'INCREMENTAL_DRIFT' ELSE 'NORMAL_AGING' END AS pattern_flag, snapshots_analyzed, baseline_window_ms FROM rated",
)
def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    report = drifts.drift(once(table(spark, folder, "incoming")), table(spark, folder, "snapshots"))
    return report.withColumn("n_suspicious", F.size("suspicious_fields")).drop("suspicious_fields")


@query("drift_suspicious_fields", _drift_sql() + "SELECT device_id, snapshot_id, field, round(stab, 6) AS historical_stability, round(dev, 6) AS current_deviation, round(z, 6) AS z_score FROM zs WHERE z >= 1.5::DOUBLE")
def drift_suspicious_fields(spark: SparkSession, folder: str) -> DataFrame:
    report = drifts.drift(once(table(spark, folder, "incoming")), table(spark, folder, "snapshots"))
    rows = report.select("device_id", "snapshot_id", F.explode("suspicious_fields").alias("x"))
    return rows.select("device_id", "snapshot_id", "x.field", *(F.round(f"x.{c}", 6).alias(c) for c in ("historical_stability", "current_deviation", "z_score")))


# Candidates and identification.

_FEATURED = (
    f"asked2 AS MATERIALIZED (SELECT *, {sql.canonical_fingerprint('q')} AS l_can, {sql.risk('q')} AS l_risk FROM asked), "
    f"held2 AS MATERIALIZED (SELECT *, {sql.canonical_fingerprint('h')} AS r_can, {sql.risk('h')} AS r_risk FROM held)"
)
_EQUAL = {k: f"q.{k} = h.{k}" for k in blocking.HARDWARE_KEYS}
_MEETS = {
    "none": "true",
    "any_key": " OR ".join(_EQUAL.values()),
    "all_keys": " AND ".join(f"(q.{k} IS NULL OR {e})" for k, e in _EQUAL.items()) + " AND (" + " OR ".join(f"q.{k} IS NOT NULL" for k in _EQUAL) + ")",
}


def _pool(strategy: str, asked: str = _ASKED) -> str:
    strong = "coalesce((q.canvas <> '' AND q.canvas = h.canvas) OR (q.webgl <> '' AND q.webgl = h.webgl), false)"
    chosen = "(strong OR NOT any_strong)" if strategy == "any_key" else "true"
    return (
        f"WITH {asked}, {_HELD}, {_FEATURED}, met AS (SELECT *, {strong} AS strong FROM asked2 JOIN held2 ON {_MEETS[strategy]}), "
        f"pool AS MATERIALIZED (SELECT * FROM (SELECT *, bool_or(strong) OVER (PARTITION BY query_id) AS any_strong FROM met) WHERE {chosen}), {sql.scores('pool', 'q', 'h', features=True)}, "
        "ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, device_id) AS place FROM scored WHERE composite >= 30) "
    )


def _candidates(name: str, strategy: str, limit: int, asked_sql: str = _EVERY, source: Query = every_arrival) -> None:
    @query(name, _pool(strategy, asked_sql) + f"SELECT query_id, device_id, composite AS confidence, ts AS last_seen, place::INT AS place FROM ranked WHERE place <= {limit}")
    def one(spark: SparkSession, folder: str) -> DataFrame:
        asked = identification.queries_of(source(spark, folder)).select("query_id", "q")
        held = identification.store_of(table(spark, folder, "snapshots"))
        return blocking.candidates(asked, held, strategy, limit=limit, options=PLAIN)


_candidates("candidates_none", "none", 20)
_candidates("candidates_any_key", "any_key", 20)
_candidates("candidates_all_keys", "all_keys", 20, _ASKED, search_set)
_candidates("candidate_topk", "any_key", 3)


@query("lsh_tokens", "SELECT snapshot_id, received_at, md5(array_to_string(list_sort(list_distinct(list_concat(list_transform(list_filter(coalesce(fingerprint.fonts, []), lambda x: x <> ''), lambda x: 'f:' || x), list_transform(list_filter(coalesce(fingerprint.languages, []), lambda x: x <> ''), lambda x: 'l:' || x)))), ',')) AS tokens FROM snapshots")
def lsh_tokens(spark: SparkSession, folder: str) -> DataFrame:
    listed = F.array_join(F.array_sort(tokens(F.col("fingerprint"))), ",")
    return table(spark, folder, "snapshots").select("snapshot_id", "received_at", F.md5(listed).alias("tokens"))


@query("minhash_bands", f"WITH {_HELD}, {sql.bands('held', 'device_id', 'h', 'bands')} SELECT device_id, band, md5(band || ':' || rows) AS bucket FROM bands")
def minhash_bands(spark: SparkSession, folder: str) -> DataFrame:
    held = identification.store_of(table(spark, folder, "snapshots"))
    named = lambda band, rows: F.md5(F.concat_ws(":", band, F.array_join(rows.cast("array<string>"), ",")))
    return band_table(held.select("device_id", tokens(F.col("h")).alias("_t")), "device_id", "_t", bucket=named)


_SHARED = f"WITH {_ASKED}, {_HELD}, {sql.bands('asked', 'query_id', 'q', 'qb')}, {sql.bands('held', 'device_id', 'h', 'hb')}, shared AS MATERIALIZED (SELECT DISTINCT query_id, device_id FROM qb JOIN hb USING (band, rows))"


@query("lsh_candidates", f"{_SHARED} SELECT query_id, device_id FROM shared")
def lsh_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return blocking.shared_bands(identification.queries_of(search_set(spark, folder)), identification.store_of(table(spark, folder, "snapshots")))


@query(
    "lsh_extra_anti",
    _pool("any_key").rstrip() + f", {sql.bands('asked', 'query_id', 'q', 'qb')}, {sql.bands('held', 'device_id', 'h', 'hb')}, shared AS (SELECT DISTINCT query_id, device_id FROM qb JOIN hb USING (band, rows)) "
    "SELECT query_id, device_id FROM shared ANTI JOIN (SELECT query_id, device_id FROM ranked WHERE place <= 100) USING (query_id, device_id)",
)
def lsh_extra_anti(spark: SparkSession, folder: str) -> DataFrame:
    found = blocking.candidates(identification.queries_of(search_set(spark, folder)).select("query_id", "q"), identification.store_of(table(spark, folder, "snapshots")), limit=100, options=PLAIN)
    return lsh_candidates(spark, folder).join(found, ["query_id", "device_id"], "left_anti")


def _identify_sql(asked: str = _ASKED) -> str:
    first = _pool("any_key", asked).rstrip()
    stability = sql.stability(5, False).replace("once AS", "once5 AS").replace("FROM once)", "FROM once5)").replace("hist AS", "hist5 AS").replace("hist a JOIN hist b", "hist5 a JOIN hist5 b").replace("pairs AS", "pairs5 AS").replace("FROM pairs ", "FROM pairs5 ")
    mapped = f"stabs AS MATERIALIZED (SELECT device_id, MAP {{{', '.join(f"'{f}': \"{f}\"" for f in FIELDS)}}} AS m FROM stable)"
    kept = "again AS MATERIALIZED (SELECT r.query_id, r.device_id, r.composite AS first_confidence, a.query_ts, a.q, h.ts, h.h, a.l_can, a.l_risk, h.r_can, h.r_risk, s.m FROM ranked r JOIN asked2 a USING (query_id) JOIN held2 h USING (device_id) LEFT JOIN stabs s USING (device_id) WHERE r.place <= 100)"
    scores = sql.scores("again", "q", "h", sql.decay("(epoch_us(query_ts) // 1000 - epoch_us(ts) // 1000)"), "m", True)
    for name in ("f1", "f2", "f3"):
        scores = scores.replace(f"{name} AS MAT", f"g{name} AS MAT").replace(f"FROM {name})", f"FROM g{name})")
    scores = scores.replace("scored AS MAT", "rescored AS MAT")
    return (
        f"{first}, {stability}, {mapped}, {kept}, {scores}, "
        "best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, first_confidence DESC, device_id) AS k, count(*) OVER (PARTITION BY query_id) AS n FROM rescored) WHERE k = 1), "
        "identified AS MATERIALIZED (SELECT a.query_id, CASE WHEN coalesce(b.composite > 50, false) THEN b.device_id ELSE 'dev_' || sha256(a.query_id) END AS device_id, coalesce(b.composite, 0) AS confidence, "
        "NOT coalesce(b.composite > 50, false) AS is_new_device, coalesce(b.n, 0)::INT AS candidates FROM asked a LEFT JOIN best b USING (query_id)) "
    )


def identified(spark: SparkSession, folder: str, source: Query = search_set) -> DataFrame:
    options = identification.IdentifyOptions(scoring=PLAIN)
    return identification.identify(source(spark, folder), table(spark, folder, "snapshots"), options)


@query("identify_batch", _identify_sql() + "SELECT * FROM identified")
def identify_batch(spark: SparkSession, folder: str) -> DataFrame:
    return identified(spark, folder)


@query("best_match", _identify_sql(_EVERY) + "SELECT query_id, device_id, confidence FROM identified WHERE NOT is_new_device")
def best_match(spark: SparkSession, folder: str) -> DataFrame:
    return identified(spark, folder, every_arrival).where(~F.col("is_new_device")).select("query_id", "device_id", "confidence")


@query("identify_metrics", _identify_sql() + "SELECT count(*) AS identify_total, count(*) FILTER (WHERE is_new_device) AS new_devices, count(*) FILTER (WHERE NOT is_new_device) AS matches, round(avg(confidence), 6) AS mean_confidence, round(avg(candidates), 6) AS mean_candidates FROM identified")
def identify_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return identification.identify_metrics(identified(spark, folder))


@query(
    "dedup_window",
    "WITH RECURSIVE times AS MATERIALIZED (SELECT DISTINCT signals_hash AS h, epoch_us(ts) // 1000 AS ms FROM snapshots WHERE signals_hash IS NOT NULL AND ts IS NOT NULL), "
    f"opens AS (SELECT h, min(ms) AS o FROM times GROUP BY h UNION ALL SELECT t.h, min(t.ms) FROM opens p JOIN times t ON t.h = p.h AND t.ms >= p.o + {sim.DAY_MS} GROUP BY t.h, p.o), "
    "opened AS (SELECT t.h, t.ms, max(o) AS o FROM times t JOIN opens p ON t.h = p.h AND p.o <= t.ms GROUP BY t.h, t.ms) "
    "SELECT snapshot_id, signals_hash, ts, coalesce(o, epoch_us(ts) // 1000) AS opened_ms FROM snapshots LEFT JOIN opened ON h = signals_hash AND ms = epoch_us(ts) // 1000",
)
def dedup_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "snapshots").select("snapshot_id", "signals_hash", "ts")
    return identification.within_window(rows, "signals_hash", "ts", sim.DAY_MS)


# The graph.


@query(
    "subnet_edges",
    f"WITH RECURSIVE {sql.subnet_visits()} SELECT least(a, b) AS device_id_a, greatest(a, b) AS device_id_b, round(least(0.97::DOUBLE, 0.4::DOUBLE + 0.2::DOUBLE * (count(*) - 1)), 9) AS weight, "
    "min(ts) AS first_seen, max(ts) AS last_seen, count(*)::INT AS occurrences FROM met WHERE a <> b GROUP BY ALL",
)
def subnet_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = graph.subnet_edges(table(spark, folder, "snapshots"))
    return edges.select("device_id_a", "device_id_b", F.round("weight", 9).alias("weight"), "first_seen", "last_seen", "occurrences")


@query(
    "font_overlap_edges",
    _identify_sql()
    + f", fonted AS (SELECT i.device_id AS a, r.device_id AS b, {sql.jaccard('q.fonts', 'h.fonts')} AS j FROM identified i JOIN ranked r USING (query_id) WHERE r.place <= 100 AND len(q.fonts) > 0 AND r.device_id <> i.device_id) "
    "SELECT a, b, round(j * 0.3::DOUBLE, 9) AS weight FROM fonted WHERE j >= 0.8::DOUBLE",
)
def font_overlap_edges(spark: SparkSession, folder: str) -> DataFrame:
    asked, held = identification.queries_of(search_set(spark, folder)), identification.store_of(table(spark, folder, "snapshots"))
    found = blocking.candidates(asked.select("query_id", "q"), held, limit=100, options=PLAIN)
    known = identified(spark, folder).select("query_id", F.col("device_id").alias("a"))
    fonts = asked.select("query_id", F.col("q.fonts").alias("fonts_a"), F.col("query_ts").alias("seen_at"))
    met = found.select("query_id", F.col("device_id").alias("b")).join(known, "query_id").join(fonts, "query_id").join(held.select(F.col("device_id").alias("b"), F.col("h.fonts").alias("fonts_b")), "b")
    return graph.font_observations(met).select("a", "b", F.round("weight", 9).alias("weight"))


def folded_edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "edges")
    named = rows.withColumns({c: F.when(normalised(F.col(c)) != "", normalised(F.col(c))) for c in ("device_id_a", "device_id_b")})
    return graph.merge_edges(named)


_FOLDED = (
    f"WITH obs AS (SELECT * EXCLUDE (device_id_a, device_id_b), lower({sql.strip('device_id_a')}) AS a, lower({sql.strip('device_id_b')}) AS b FROM edges WHERE weight IS NOT NULL), "
    "folded AS MATERIALIZED (SELECT least(a, b) AS device_id_a, greatest(a, b) AS device_id_b, arg_min(weight, struct_pack(s := first_seen, w := weight)) AS w0, sum(round(weight * 1000000000)::BIGINT) AS ws, min(first_seen) AS first_seen, max(last_seen) AS last_seen, "
    "sum(coalesce(occurrences, 1))::INT AS occurrences, array_to_string(list_sort(list_distinct(flatten(list(coalesce(reasons, []))))), ',') AS reasons FROM obs WHERE a <> '' AND b <> '' AND a <> b GROUP BY ALL), "
    "folded2 AS MATERIALIZED (SELECT device_id_a, device_id_b, least(0.97::DOUBLE, least(0.97::DOUBLE, w0) + (ws - round(w0 * 1000000000)::BIGINT) / 1000000000::DOUBLE * 0.5::DOUBLE) AS weight, reasons, first_seen, last_seen, occurrences FROM folded) "
)


@query("edges_folded", _FOLDED + "SELECT device_id_a, device_id_b, round(weight, 9) AS weight, reasons, first_seen, last_seen, occurrences FROM folded2")
def edges_folded(spark: SparkSession, folder: str) -> DataFrame:
    return folded_edges(spark, folder).withColumns({"weight": F.round("weight", 9), "reasons": F.array_join("reasons", ",")})


@query(
    "related_devices",
    _FOLDED + ", ends AS (SELECT device_id_a AS device_id, device_id_b AS related_id, round(weight, 9) AS weight, occurrences FROM folded2 UNION ALL SELECT device_id_b, device_id_a, round(weight, 9), occurrences FROM folded2) "
    "SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY weight DESC, related_id)::INT AS place FROM ends",
)
def related_devices(spark: SparkSession, folder: str) -> DataFrame:
    edges = folded_edges(spark, folder).withColumn("weight", F.round("weight", 9))
    return graph.related(edges).select("device_id", "related_id", "weight", "occurrences", "place")


@query("edge_lookup", _FOLDED + f"SELECT device_id_a, device_id_b, round(weight, 9) AS weight FROM folded2 WHERE device_id_a = '{REPORT_DEVICE}' OR device_id_b = '{REPORT_DEVICE}'")
def edge_lookup(spark: SparkSession, folder: str) -> DataFrame:
    touching = (F.col("device_id_a") == REPORT_DEVICE) | (F.col("device_id_b") == REPORT_DEVICE)
    return folded_edges(spark, folder).where(touching).select("device_id_a", "device_id_b", F.round("weight", 9).alias("weight"))


@query("edge_prune", _FOLDED + f"SELECT device_id_a, device_id_b, last_seen FROM folded2 WHERE epoch_us(last_seen) // 1000 + {EDGE_AGE_MS} > epoch_us(TIMESTAMPTZ '{NOW}+00') // 1000")
def edge_prune(spark: SparkSession, folder: str) -> DataFrame:
    kept = graph.prune(folded_edges(spark, folder), F.lit(NOW).cast("timestamp"), EDGE_AGE_MS)
    return kept.select("device_id_a", "device_id_b", "last_seen")


# Evaluation.


def labelled_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Scored pairs of profiles: neighbours by id, and neighbours of one label."""
    p = table(spark, folder, "profiles").select("profile_id", "device_label", "is_attractor", F.col("fingerprint").alias("f"))
    other = p.select((F.col("profile_id") - 1).alias("profile_id"), F.col("f").alias("g"), F.col("device_label").alias("label_g"), F.col("is_attractor").alias("attractor_g"))
    near = p.join(other, "profile_id").select("profile_id", F.lit("neighbour").alias("scenario"), "f", "g", (F.col("device_label") == F.col("label_g")).alias("same_device"), (F.col("is_attractor") | F.col("attractor_g")).alias("is_attractor"))
    nxt = F.lead(F.struct("f", "is_attractor")).over(Window.partitionBy("device_label").orderBy("profile_id"))
    own = p.withColumn("n", nxt).where("n is not null").select("profile_id", F.lit("same label").alias("scenario"), "f", F.col("n.f").alias("g"), F.lit(True).alias("same_device"), (F.col("is_attractor") | F.col("n.is_attractor")).alias("is_attractor"))
    return score_pairs(near.unionByName(own), "f", "g", PLAIN).select("profile_id", "scenario", "same_device", "is_attractor", F.col("composite").alias("score"))


_LABELLED = (
    "WITH near AS (SELECT a.profile_id, 'neighbour' AS scenario, a.fingerprint AS f, b.fingerprint AS g, a.device_label = b.device_label AS same_device, a.is_attractor OR b.is_attractor AS is_attractor FROM profiles a JOIN profiles b ON b.profile_id = a.profile_id + 1), "
    "led AS (SELECT profile_id, fingerprint AS f, lead(fingerprint) OVER w AS g, is_attractor, lead(is_attractor) OVER w AS attractor_g, lead(profile_id) OVER w AS n FROM profiles WINDOW w AS (PARTITION BY device_label ORDER BY profile_id)), "
    "labelled AS MATERIALIZED (SELECT * FROM near UNION ALL SELECT profile_id, 'same label', f, g, true, is_attractor OR attractor_g FROM led WHERE n IS NOT NULL), "
    + sql.scores("labelled", "f", "g")
)
_SWEEP = (
    f"{_LABELLED}, limits AS (SELECT unnest(range(0, 101, 5))::INT AS threshold), "
    "counts AS (SELECT threshold, count(*) FILTER (WHERE same_device AND composite >= threshold) AS tp, count(*) FILTER (WHERE NOT same_device AND composite >= threshold) AS fp, count(*) FILTER (WHERE same_device) AS p, count(*) FILTER (WHERE NOT same_device) AS n, "
    "count(*) FILTER (WHERE NOT same_device AND is_attractor AND composite >= threshold) AS ap, count(*) FILTER (WHERE NOT same_device AND is_attractor) AS a FROM scored, limits GROUP BY threshold), "
    "rated AS (SELECT threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS recall, CASE WHEN n > 0 THEN fp / n ELSE 0 END AS far, CASE WHEN p > 0 THEN (p - tp) / p ELSE 0 END AS frr, CASE WHEN a > 0 THEN ap / a ELSE 0 END AS attr FROM counts), "
    "sweep AS MATERIALIZED (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, abs(far - frr) AS eer FROM rated) "
)
_RATES = ["precision", "recall", "f1", "far", "frr", "eer", "attr"]


@query("threshold_sweep", f"{_SWEEP} SELECT threshold, {', '.join(f'round({c}, 9) AS {c}' for c in _RATES)} FROM sweep")
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.threshold_sweep(labelled_pairs(spark, folder)).select("threshold", *(F.round(c, 9).alias(c) for c in _RATES))


@query("best_threshold", f"{_SWEEP} SELECT threshold, round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall FROM sweep ORDER BY f1 DESC, threshold DESC LIMIT 1")
def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    best = evaluate.best_threshold(evaluate.threshold_sweep(labelled_pairs(spark, folder)))
    return best.select("threshold", *(F.round(c, 9).alias(c) for c in ("f1", "precision", "recall")))


@query("scenario_summary", f"{_LABELLED} SELECT scenario, count(*) AS n, round(avg(composite), 6) AS avg_score, min(composite) AS min_score, max(composite) AS max_score FROM scored GROUP BY scenario")
def scenario_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.summary(labelled_pairs(spark, folder), "scenario", F.col("score")).withColumn("avg_score", F.round("avg_score", 6))


def synthetic_pairs(spark: SparkSession, options: ScoringOptions = PLAIN) -> DataFrame:
    """The generated scenarios with their scores."""
    made = scenario_pairs(spark)
    return score_pairs(made, "f", "g", options).select("scenario", "seed", "same_device", "is_attractor", F.col("composite").alias("score"))


@query("scenario_matrix")
def scenario_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.summary(synthetic_pairs(spark, ScoringOptions()), "scenario", F.col("score"))


@query("scenario_sweep")
def scenario_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.threshold_sweep(synthetic_pairs(spark, ScoringOptions()))


# Fuzzy digests.


@query("tlsh_hash")
def tlsh_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "snapshots").select("snapshot_id", digest_udf(canonical_fingerprint(F.col("fingerprint"))).alias("digest"))


@query("tlsh_near_duplicates")
def tlsh_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy.near_duplicates(table(spark, folder, "documents"), "doc_id", F.col("text")).withColumnsRenamed({"a": "doc_id_a", "b": "doc_id_b"})


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
