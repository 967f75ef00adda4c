"""Queries of the operators for training data, by name."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kenmark.functions.text import WHITE_SPACE
from kenmark.llm.cells import NUMBER_TEXT, VOLATILE, known_snapshots
from kenmark.llm.eliteness import ROUNDS, profile_scores, shared_rare_terms
from kenmark.llm.groups import device_groups
from kenmark.llm.leaks import leaked_spans
from kenmark.llm.lookalikes import IGNORABLE, LATIN_FOR, PUNCTUATION, SPACES, readings, same_reading_pairs
from kenmark.llm.packing import packed_documents
from kenmark.llm.setjoin import LEAST_ELEMENTS, LISTS, linked_records, set_records, similar_records
from kenmark.plans.queries import Query, table
from kenmark.schema import FINGERPRINT


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_rare_terms(table(spark, folder, "profiles"))


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of every profile with what the mixture makes of its count."""
    scored = profile_scores(table(spark, folder, "profiles"))
    return scored.select("profile_id", "field", "term", "tf", *(F.round(c, 4).alias(c) for c in ("posterior", "score")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return known_snapshots(table(spark, folder, "snapshots"), table(spark, folder, "incoming"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_records(table(spark, folder, "signal_sets"), table(spark, folder, "known_sets"))


def p6_linked(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that counts with its class and the number of records it links to."""
    records = set_records(table(spark, folder, "signal_sets"), table(spark, folder, "known_sets"))
    return linked_records(records, "id", "elements", 0.8, LEAST_ELEMENTS, "known")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return device_groups(table(spark, folder, "edges"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    spans = leaked_spans(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")
    return spans.select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_reading_pairs(table(spark, folder, "documents"), "doc_id", "text").toDF("doc_id_a", "doc_id_b")


def p10_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the class of texts that read the same, its spellings and links."""
    return readings(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {"p2_found": p2_found, "p2_scores": p2_scores, "p3_found": p3_found, "p6_found": p6_found, "p6_linked": p6_linked, "p7_found": p7_found, "p8_packed": p8_packed, "p9_found": p9_found, "p10_found": p10_found, "p10_readings": p10_readings}


_STRIP = f"trim(x, '{WHITE_SPACE}')"

_TERMS = f"""terms AS (
  SELECT profile_id, device_label, 'fonts' AS field, unnest(list_transform(fingerprint.fonts, lambda x: lower({_STRIP}))) AS term FROM profiles
  UNION ALL SELECT profile_id, device_label, 'platform', lower(trim(fingerprint.platform, '{WHITE_SPACE}')) FROM profiles
  UNION ALL SELECT profile_id, device_label, 'userAgent', unnest(regexp_split_to_array(lower(trim(fingerprint.userAgent, '{WHITE_SPACE}')), '\\s+')) FROM profiles
)"""
P2_SQL = f"""
WITH {_TERMS}, few AS (SELECT field, term FROM terms WHERE term <> '' GROUP BY ALL HAVING count(DISTINCT device_label) BETWEEN 2 AND 6)
SELECT DISTINCT profile_id, field, term FROM terms JOIN few USING (field, term)
"""


def _elite(k: str) -> str:
    return f"1 / (1 + exp(-greatest(-500::DOUBLE, least(500::DOUBLE, ln(share) - ln(1 - share) + {k} * (ln(high) - ln(low)) - (high - low)))))"


P2_SCORES_SQL = f"""
WITH RECURSIVE {_TERMS}, counted AS MATERIALIZED (
  SELECT profile_id, field, term, count(*) AS tf FROM terms WHERE term <> '' AND profile_id IS NOT NULL GROUP BY profile_id, device_label, field, term
), hist AS MATERIALIZED (SELECT field, term, tf, count(*)::DOUBLE AS n FROM counted GROUP BY ALL
), size AS (SELECT count(DISTINCT profile_id)::DOUBLE AS total FROM profiles
), base AS MATERIALIZED (SELECT field, term, sum(n) AS holders, sum(n * tf) AS mass, any_value(total) AS total FROM hist, size GROUP BY ALL
), fits AS (
  SELECT 0 AS step, field, term, greatest(1e-9, least(0.5::DOUBLE, holders / total)) AS share, mass / holders * 1.2::DOUBLE AS high, greatest(mass / total * 0.02::DOUBLE, 1e-9) AS low FROM base
  UNION ALL SELECT step + 1, field, term, CASE WHEN l > h THEN 1 - s ELSE s END, greatest(h, l), least(h, l) FROM (
    SELECT step, field, term, greatest(1e-9, least(1 - 1e-9, weight / total)) AS s, greatest(elite_mass / greatest(weight, 1e-12), 1e-9) AS h, greatest((mass - elite_mass) / greatest(total - weight, 1e-12), 1e-9) AS l FROM (
      SELECT step, field, term, sum(n * elite) + any_value(greatest(total - holders, 0) * elite0) AS weight, sum(n * tf * elite) AS elite_mass, any_value(mass) AS mass, any_value(total) AS total FROM (
        SELECT step, field, term, n, tf, mass, total, holders, {_elite("tf")} AS elite, {_elite("0")} AS elite0 FROM fits JOIN base USING (field, term) JOIN hist USING (field, term) WHERE step < {ROUNDS}
      ) GROUP BY step, field, term
    )
  )
), last AS MATERIALIZED (SELECT field, term, tf, {_elite("tf")} AS posterior, share, total FROM fits JOIN base USING (field, term) JOIN hist USING (field, term) WHERE step = {ROUNDS})
SELECT profile_id, field, term, tf, round(posterior, 4) AS posterior, round(posterior * greatest(-ln(share), 0) / ln(greatest(total, 2)), 4) AS score FROM counted JOIN last USING (field, term, tf)
"""

P9_SQL = """
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM documents
  UNION ALL SELECT 'i', item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) FROM eval_items
), grams AS (SELECT DISTINCT kind, id, md5(array_to_string(w[i:i + 11], ' ')) AS g FROM (SELECT kind, id, w, unnest(range(1, len(w) - 10)) AS i FROM words))
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i ON d.g = i.g WHERE d.kind = 'd' AND i.kind = 'i'
"""


_ID = f"lower(trim({{}}, '{WHITE_SPACE}'))"

P7_SQL = f"""
WITH RECURSIVE links AS MATERIALIZED (
  SELECT {_ID.format("device_id_a")} AS a, {_ID.format("device_id_b")} AS b FROM edges WHERE weight >= 0.5 AND NOT isnan(weight)
), ways AS MATERIALIZED (SELECT a, b FROM links WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM links WHERE a <> '' AND b <> '' AND a <> b
), reach(device_id, group_id) USING KEY (device_id) AS (
  SELECT a, least(a, min(b)) FROM ways GROUP BY a
  UNION SELECT w.a, min(r.group_id) FROM reach r JOIN ways w ON w.b = r.device_id JOIN recurring.reach o ON o.device_id = w.a WHERE r.group_id < o.group_id GROUP BY w.a
) SELECT device_id, group_id FROM reach
"""




def _canonical(x: str, kind: T.DataType, level: int = 0) -> str:
    """Text that is equal for equal values: text normalised, lists as sets, structs as a whole."""
    if isinstance(kind, T.StringType):
        return f"lower(trim({x}, '{WHITE_SPACE}'))"
    if isinstance(kind, T.ArrayType):
        v = f"v{level}"
        parts = f"list_sort(list_distinct(list_transform({x}, lambda {v}: coalesce({_canonical(v, kind.elementType, level + 1)}, chr(1)))))"
        return f"CASE WHEN {x} IS NOT NULL THEN '[' || array_to_string({parts}, chr(2)) || ']' || len({parts}) END"
    if isinstance(kind, T.StructType):
        members = " || chr(3) || ".join(f"coalesce({_canonical(f'{x}.{f.name}', f.dataType, level)}, chr(1))" for f in kind.fields)
        return f"CASE WHEN {x} IS NOT NULL THEN {members} END"
    return f"CAST({x} AS VARCHAR)"


def _known_sql(limit: int = 3, batches: int = 12) -> str:
    """Batch after batch, each against the history and the accepted rows of those before."""
    fields = [f for f in FINGERPRINT.fields if f.name != VOLATILE]
    text = {f.name: f"({_canonical(f'fingerprint.{f.name}', f.dataType)})" for f in fields}
    text[NUMBER_TEXT] = f"coalesce(CAST(TRY_CAST({text[NUMBER_TEXT]} AS DOUBLE) AS VARCHAR), {text[NUMBER_TEXT]})"
    vector = ", ".join(f"coalesce(hash({text[f.name]}), 0) AS f{i}" for i, f in enumerate(fields))
    differing = " + ".join(f"(a.f{i} <> b.f{i})::INT" for i in range(len(fields)))
    meets = f"(a.signals_hash = b.signals_hash OR {differing} <= {limit})"
    rounds = ["a0 AS MATERIALIZED (SELECT row FROM fresh WHERE false)"]
    for b in range(1, batches + 1):
        rounds.append(
            f"a{b} AS MATERIALIZED (SELECT row FROM a{b - 1} UNION ALL SELECT row FROM fresh WHERE batch_no = {b} AND row NOT IN (SELECT later FROM met WHERE earlier IN (SELECT row FROM a{b - 1})))"
        )
    return (
        f"WITH past AS MATERIALIZED (SELECT DISTINCT signals_hash, {vector} FROM snapshots), "
        f"rows AS MATERIALIZED (SELECT row_number() OVER () AS row, batch_no, snapshot_id, signals_hash, {vector} FROM incoming), "
        f"old AS MATERIALIZED (SELECT DISTINCT a.row FROM rows a JOIN past b ON {meets}), "
        "fresh AS MATERIALIZED (SELECT * FROM rows WHERE row NOT IN (SELECT row FROM old)), "
        f"met AS MATERIALIZED (SELECT a.row AS later, b.row AS earlier FROM fresh a JOIN fresh b ON a.batch_no > b.batch_no AND {meets}), "
        f"{', '.join(rounds)} SELECT DISTINCT batch_no, snapshot_id FROM rows WHERE row NOT IN (SELECT row FROM a{batches})"
    )


_LISTED = ", ".join(f"list_transform(coalesce({c}, []), lambda x: '{i}:' || lower(trim(x, '{WHITE_SPACE}')))" for i, c in enumerate(LISTS))
_SETS = f"""
WITH raw AS (
  SELECT record_id AS id, false AS known, fonts, plugins, mime_types, languages FROM signal_sets UNION ALL SELECT known_id, true, fonts, plugins, mime_types, languages FROM known_sets
), sets AS MATERIALIZED (
  SELECT DISTINCT id, known, e, len(e) AS n FROM (SELECT id, known, list_sort(list_distinct(list_filter(list_concat({_LISTED}), lambda x: length(x) > 2))) AS e FROM raw) WHERE len(e) >= {LEAST_ELEMENTS} AND id IS NOT NULL
), pairs AS MATERIALIZED (
  SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM sets a JOIN sets b ON a.id < b.id AND NOT (a.known AND b.known) AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  WHERE 9 * len(list_intersect(a.e, b.e)) >= 4 * (a.n + b.n)
)
"""
P6_SQL = f"{_SETS} SELECT id_a, id_b FROM pairs"
P6_LINKED_SQL = f"""{_SETS}, ends AS (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs), degree AS (SELECT id, count(*) AS n_links FROM ends GROUP BY id)
SELECT id, upper(md5(to_json(e)::VARCHAR)) AS class, coalesce(n_links, 0) AS n_links FROM sets LEFT JOIN degree USING (id)
"""


def _reading_sql() -> str:
    """The table of readings as one translation, with composed letters whose base looks like a Latin one."""
    shown = dict.fromkeys(SPACES, " ") | LATIN_FOR | PUNCTUATION | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in map(chr, range(0x80, 0x2000)):
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and apart[0] in LATIN_FOR:
            composed = unicodedata.normalize("NFC", LATIN_FOR[apart[0]] + apart[1:])
            if len(composed) == 1:
                shown[c] = composed
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    gone = "".join(sorted(IGNORABLE))
    read = f"nfc_normalize(translate(nfc_normalize(translate(text, {quoted(gone)}, '')), {quoted(''.join(shown))}, {quoted(''.join(shown.values()))}))"
    return f"WITH seen AS (SELECT DISTINCT doc_id, text, replace({read}, chr(13) || chr(10), chr(10)) AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) "


P10_SQL = f"{_reading_sql()} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM seen a JOIN seen b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id"

P10_READINGS_SQL = f"""{_reading_sql()}, texts AS (SELECT form, text, count(*) AS own, min(doc_id) AS least FROM seen GROUP BY form, text),
forms AS (SELECT form, count(*) AS n_spellings, sum(own)::BIGINT AS n, min(least) AS reading FROM texts GROUP BY form)
SELECT doc_id, reading, n_spellings, n - own AS n_links FROM seen JOIN texts USING (form, text) JOIN forms USING (form)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p2_scores": P2_SCORES_SQL, "p3_found": _known_sql(), "p6_found": P6_SQL, "p6_linked": P6_LINKED_SQL, "p7_found": P7_SQL, "p9_found": P9_SQL, "p10_found": P10_SQL, "p10_readings": P10_READINGS_SQL}
