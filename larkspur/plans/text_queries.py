"""Queries on text: signals, scores, features, hooks, names, versions, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import spread, table
from ..functions import patterns as P
from ..functions import text as T
from ..functions import versions as V
from ..operators import evaluation, names, signals
from ..sources import manifests
from . import fixtures as X

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return enter


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("package"), F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    docs = spread(docs)
    return docs.unionByName(X.table(spark, X.FILES, "package, path, text"))


FILES = X.values(X.FILES, "x", "package, path, text") + ", files AS (SELECT source AS package, doc_id::VARCHAR AS path, coalesce(text, '') AS text FROM documents UNION ALL SELECT * FROM x)"
ADDRESSES = (
    rf"list_filter(regexp_extract_all(text, '\b({T.ADDRESS})(:[0-9]{{1,5}})?\b', 1), lambda a: len(list_filter(string_split(a, '.'), lambda o: o::INT > 255)) = 0 AND "
    + " AND ".join(f"NOT starts_with(a, '{p}')" for p in P.NON_ROUTABLE)
    + " AND string_split(a, '.')[1]::INT BETWEEN 1 AND 223)"
)
BLOBS = f"list_filter(regexp_extract_all(text, '{T.BASE64_RUN}'), lambda r: length(r) >= 120 AND regexp_matches(r, '[a-z]') AND regexp_matches(r, '[A-Z]'))"
HEX, UNI = (f"len(regexp_extract_all(text, '{p}'))" for p in (r"\\x[0-9a-fA-F]{2}", r"\\u[0-9a-fA-F]{4}"))
LINES = "list_transform(string_split(text, chr(10)), lambda l: length(l))"
MINIFIED = f"((len({LINES}) <= 2 AND length(text) > 2000) OR len(list_filter({LINES}, lambda n: n > 500)) >= 3 OR (list_max({LINES}) > 1000 AND len({LINES}) < 50))"


def _any(family: list[str]) -> str:
    body = "|".join(f"({p})" for p in family).replace("'", "''")
    return f"regexp_matches(text, '(?i){body}')"


CHECKS = {
    "SENSITIVE_PATH_ACCESS": _any(P.SENSITIVE_PATHS),
    "CRYPTO_WALLET_ACCESS": _any(P.CRYPTO_WALLETS),
    "FILE_WRITE_SENSITIVE": _any(P.PERSISTENCE),
    "SUSPICIOUS_ENDPOINT": _any(P.ENDPOINTS),
    "HARDCODED_IP_ENDPOINT": f"len({ADDRESSES}) > 0",
    "REVERSE_SHELL_PATTERN": _any(P.REVERSE_SHELLS),
    "HOST_RECON": _any(P.HOST_RECON),
    "BASE64_BLOB": f"len({BLOBS}) > 0",
    "HEX_ESCAPE_HEAVY": f"({HEX} + {UNI} > 60 AND (4 * {HEX} + 6 * {UNI}) / length(text) > 0.15)",
    "MINIFIED_SOURCE": MINIFIED,
    "ENV_ACCESS": r"regexp_matches(text, 'os\.environ|os\.getenv|process\.env')",
    "NETWORK_ACCESS": r"regexp_matches(text, 'urlopen|requests\.|https?://|fetch\(')",
}
FLAGS = f"WITH {FILES}, flags AS (SELECT package, path, " + ", ".join(f"coalesce({c}, false) AS {k}" for k, c in CHECKS.items()) + " FROM files)"
CREDENTIALS = "((SENSITIVE_PATH_ACCESS OR CRYPTO_WALLET_ACCESS) AND NETWORK_ACCESS)"
RAISED = (
    FLAGS
    + ", signals AS ("
    + " UNION ALL ".join(
        [f"SELECT package, path, '{k}' AS code FROM flags WHERE {k}" for k in CHECKS]
        + [
            f"SELECT package, path, 'EXFIL_CREDENTIALS_TO_NETWORK' FROM flags WHERE {CREDENTIALS}",
            f"SELECT package, path, 'EXFIL_ENV_TO_NETWORK' FROM flags WHERE ENV_ACCESS AND NETWORK_ACCESS AND HOST_RECON AND NOT {CREDENTIALS}",
        ]
    )
    + "), catalogue(code, family, severity, weight, rank) AS (VALUES "
    + ", ".join(f"('{c}', '{f}', '{s}', {w}::DOUBLE, {P.SEVERITY_RANK[s]})" for c, f, s, w in P.SIGNALS)
    + ")"
)
SCORES = (
    RAISED
    + ", occ AS (SELECT package, code, weight, rank, row_number() OVER (PARTITION BY package, code ORDER BY path) AS n FROM signals JOIN catalogue USING (code))"
    + ", raw AS (SELECT package, sum(weight / n) AS raw, count(*) AS signals, count(DISTINCT code) AS codes, max(rank) AS worst FROM occ GROUP BY package)"
    + f", scores AS (SELECT *, 1 / (1 + exp(-(raw - {P.SCORE_MIDPOINT}) / {P.SCORE_SCALE})) AS score FROM raw)"
)


def raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.scan(files(spark, sf_dir), "package", "path", "text")


@query("q01_signal_scan", RAISED + " SELECT package, path, code FROM signals")
def q01(spark, sf_dir):
    return raised(spark, sf_dir)


@query("q02_public_ip_literals", f"WITH {FILES} SELECT package, path, unnest({ADDRESSES}) AS address FROM files")
def q02(spark, sf_dir):
    return files(spark, sf_dir).select("package", "path", F.explode(T.public_addresses(F.col("text"))).alias("address"))


@query(
    "q03_text_entropy",
    f"WITH {FILES}, c AS (SELECT package, path, unnest(string_split(text, '')) AS ch FROM files), n AS (SELECT package, path, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL), "
    "e AS (SELECT package, path, -sum(k / t * log2(k / t)) AS e FROM (SELECT *, sum(k) OVER (PARTITION BY package, path) AS t FROM n) GROUP BY ALL) "
    "SELECT package, path, round(coalesce(e, 0.0), 6) + 0.0 AS entropy FROM files LEFT JOIN e USING (package, path)",
)
def q03(spark, sf_dir):
    return files(spark, sf_dir).select("package", "path", (F.round(T.entropy(F.col("text")), 6) + F.lit(0.0)).alias("entropy"))


SHAPE = (
    "length(text) >= 180 AND length(text) - length(regexp_replace(text, '\\s', '', 'g')) <= length(text) * 0.02 "
    "AND length(text) - length(regexp_replace(text, '[A-Za-z0-9+/=_\\-]', '', 'g')) >= length(text) * 0.92 "
    "AND NOT (contains(text, '://') OR length(text) - length(replace(text, '/', '')) > length(text) / 12)"
)


@query(
    "q04_encoded_payload",
    f"WITH {FILES}, {X.values(X.LITERALS, 'lits', 'text')}, t AS (SELECT path AS name, text FROM files UNION ALL SELECT 'literal', text FROM lits), "
    "i AS (SELECT row_number() OVER () AS i, * FROM t), c AS (SELECT i, unnest(string_split(text, '')) AS ch FROM i), n AS (SELECT i, ch, count(*) AS k FROM c GROUP BY ALL), "
    "e AS (SELECT i, -sum(k / t * log2(k / t)) AS e FROM (SELECT *, sum(k) OVER (PARTITION BY i) AS t FROM n) GROUP BY ALL) "
    f"SELECT name, count(*) AS texts, count(*) FILTER (WHERE {SHAPE} AND coalesce(e, 0) > 4.8) AS payloads FROM i LEFT JOIN e USING (i) GROUP BY name",
)
def q04(spark, sf_dir):
    lits = X.table(spark, X.LITERALS, "text").select(F.lit("literal").alias("name"), "text")
    rows = files(spark, sf_dir).select(F.col("path").alias("name"), "text").unionByName(lits)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("texts"), F.count_if(T.encoded_payload(F.col("text"))).alias("payloads"))


@query(
    "q05_minified",
    f"WITH {FILES}, t AS (SELECT 'file' AS kind, path AS name, text FROM files UNION ALL SELECT 'page', page_id::VARCHAR, html FROM pages) SELECT kind, name, {MINIFIED} AS minified, list_max({LINES}) AS longest_line FROM t",
)
def q05(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("name"), F.col("html").alias("text"))
    rows = files(spark, sf_dir).select(F.lit("file").alias("kind"), F.col("path").alias("name"), "text").unionByName(pages)
    return rows.select("kind", "name", T.minified(F.col("text")).alias("minified"), F.array_max(T.line_lengths(F.col("text"))).cast("long").alias("longest_line"))


@query("q06_escape_density", f"WITH {FILES} SELECT package, path, {HEX} AS hex, {UNI} AS uni, round((4.0 * {HEX} + 6.0 * {UNI}) / greatest(length(text), 1), 6)::DOUBLE AS density FROM files")
def q06(spark, sf_dir):
    h, u = T.escapes(F.col("text"))
    density = F.round((4.0 * h + 6.0 * u) / F.greatest(F.char_length("text"), F.lit(1)), 6)
    return files(spark, sf_dir).select("package", "path", h.cast("long").alias("hex"), u.cast("long").alias("uni"), density.alias("density"))


@query("q07_rules_score", SCORES + " SELECT package, round(score, 6) AS score, signals, codes, worst FROM scores")
def q07(spark, sf_dir):
    return signals.rules_score(raised(spark, sf_dir)).select("package", F.round("score", 6).alias("score"), "signals", "codes", "worst")


@query(
    "q08_verdict_bands",
    SCORES + f" SELECT verdict, count(*) AS packages FROM (SELECT CASE WHEN s.score >= {P.MALICIOUS} THEN 'malicious' WHEN s.score >= {P.SUSPICIOUS} THEN 'suspicious' ELSE 'benign' END AS verdict FROM (SELECT DISTINCT package FROM files) LEFT JOIN scores s USING (package)) GROUP BY verdict",
)
def q08(spark, sf_dir):
    scores = signals.rules_score(raised(spark, sf_dir)).select("package", "score")
    all_ = files(spark, sf_dir).select("package").distinct().join(scores, "package", "left")
    return all_.groupBy(signals.verdict(F.coalesce("score", F.lit(0.0))).alias("verdict")).agg(F.count(F.lit(1)).alias("packages"))


@query("q09_composites", RAISED + " SELECT package, code, count(*) AS files, min(path) AS first_path FROM signals WHERE starts_with(code, 'EXFIL') GROUP BY ALL")
def q09(spark, sf_dir):
    return raised(spark, sf_dir).where("startswith(code, 'EXFIL')").groupBy("package", "code").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))


@query(
    "q10_top_signals",
    RAISED + ", o AS (SELECT package, code, severity, rank, count(*) AS occurrences, min(path) AS first_path FROM signals JOIN catalogue USING (code) GROUP BY ALL) "
    "SELECT * FROM (SELECT package, code, severity, occurrences, first_path, row_number() OVER (PARTITION BY package ORDER BY rank DESC, occurrences DESC, code)::INT AS place FROM o) WHERE place <= 12",
)
def q10(spark, sf_dir):
    return signals.collapse(raised(spark, sf_dir)).select("package", "code", "severity", "occurrences", "first_path", "place")


_COUNTS = ", ".join([f"round(ln(1 + count(*) FILTER (WHERE code = '{c}')), 6) AS {c.lower()}" for c in sorted(CHECKS)] + [f"round(ln(1 + count(*) FILTER (WHERE rank = {r})), 6) AS {n}_signals" for n, r in (("critical", 4), ("high", 3), ("medium", 2))])
_NAMES = [*(c.lower() for c in sorted(CHECKS)), "critical_signals", "high_signals", "medium_signals", "total_signals", "distinct_signal_types"]
FEATURES = (
    RAISED + f", b AS (SELECT package, {_COUNTS}, round(ln(1 + count(*)), 6) AS total_signals, round(ln(1 + count(DISTINCT code)), 6) AS distinct_signal_types FROM signals JOIN catalogue USING (code) GROUP BY package), "
    "s AS (SELECT package, round(ln(1 + count(*)), 6) AS file_count, round(ln(1 + sum(length(text))), 6) AS total_bytes, round(ln(1 + avg(length(text))), 6) AS avg_file_bytes, "
    f"round(avg({MINIFIED}::INT), 6) AS minified_ratio, round(ln(1 + max(list_max({LINES}))), 6) AS max_line_length FROM files GROUP BY package), "
    "v AS (SELECT package, file_count, total_bytes, avg_file_bytes, minified_ratio, max_line_length, " + ", ".join(f"coalesce({n}, 0.0) AS {n}" for n in _NAMES) + " FROM s LEFT JOIN b USING (package))"
)
SHAPES = ["file_count", "total_bytes", "avg_file_bytes", "minified_ratio", "max_line_length"]


def vectors(spark, sf_dir):
    f = files(spark, sf_dir)
    v = signals.feature_vector(raised(spark, sf_dir), f, "package", "text")
    return v.select("package", *[F.round(c, 6).alias(c) for c in SHAPES + _NAMES])


@query("q11_feature_vector", FEATURES + " SELECT * FROM v")
def q11(spark, sf_dir):
    return vectors(spark, sf_dir)


ZEROED = ["network_access", "env_access", "host_recon"]


@query("q47_feature_zeroing", FEATURES + " SELECT package, " + ", ".join("0.0::DOUBLE AS " + c if c in ZEROED else c for c in SHAPES + _NAMES) + " FROM v")
def q47(spark, sf_dir):
    return evaluation.zeroed(vectors(spark, sf_dir), ZEROED)


WEIGHTS = [("sensitive_path_access", 0.3), ("crypto_wallet_access", 0.25), ("network_access", 0.2), ("total_bytes", 0.15), ("distinct_signal_types", 0.1), ("env_access", 0.05), ("max_line_length", 0.02)]


@query(
    "q49_contributors",
    FEATURES + ", c AS (" + " UNION ALL ".join(f"SELECT package, '{n}' AS feature, {w}::DOUBLE AS importance, {n}::DOUBLE AS value FROM v" for n, w in WEIGHTS) + "), "
    "r AS (SELECT package, feature, round(importance * value, 6) AS contribution, row_number() OVER (PARTITION BY package ORDER BY importance * value DESC, feature)::INT AS place FROM c WHERE importance * value > 0) SELECT * FROM r WHERE place <= 6",
)
def q49(spark, sf_dir):
    from ..operators import ml

    found = ml.contributors(vectors(spark, sf_dir), "package", WEIGHTS)
    return found.select("package", "feature", F.round("contribution", 6).alias("contribution"), "place")


@query(
    "q12_metadata_signals",
    """WITH m AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 'https://example.org/' || c_custkey END AS repository, CASE WHEN c_mktsegment = 'MACHINERY' THEN ' ' ELSE c_mktsegment END AS description,
        count(o_orderkey) AS versions, date_diff('day', max(o_orderdate), TIMESTAMP '1998-08-02 00:00:00') AS age FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_custkey, repository IS NULL AS no_repository, coalesce(age < 7, false) AS very_new, versions = 1 AS single_version, trim(description) = '' AS empty_description FROM m""",
)
def q12(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("versions"), F.max("o_orderdate").alias("last"))
    m = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.col("last").cast("date"))
    description = F.when(F.col("c_mktsegment") == "MACHINERY", " ").otherwise(F.col("c_mktsegment"))
    return m.select("c_custkey", (F.col("c_nationkey") % 5 == 0).alias("no_repository"), F.coalesce(age < 7, F.lit(False)).alias("very_new"), (F.coalesce("versions", F.lit(0)) == 1).alias("single_version"), (F.trim(description) == "").alias("empty_description"))


def _m(p: str) -> str:
    return "regexp_matches(text, '(?i)" + p.replace("'", "''") + "')"


HOOK = [
    ("INSTALL_HOOK_PRESENT", "true"),
    ("INSTALL_HOOK_SHELL_PIPE", _m(P.PIPE_TO_SHELL)),
    ("INSTALL_HOOK_NETWORK", f"({_m(P.FETCH)} OR ({_m(P.URL)} AND NOT {_m('^echo')}))"),
    ("HARDCODED_IP_ENDPOINT", CHECKS["HARDCODED_IP_ENDPOINT"]),
    ("SUSPICIOUS_ENDPOINT", CHECKS["SUSPICIOUS_ENDPOINT"]),
    ("INSTALL_HOOK_OBFUSCATED", f"({_m(P.BASE64_DECODE)} OR len({BLOBS}) > 0 OR {HEX} > 8 OR {UNI} > 8)"),
    ("DYNAMIC_EVAL", f"({_m(P.INLINE_EXEC)} AND NOT {_m(P.BENIGN_BUILD)})"),
    ("PROCESS_SPAWN", f"({_m(P.INTERPRETER)} AND NOT {_m(P.BENIGN_BUILD)})"),
    ("INSTALL_HOOK_OBFUSCATED", f"({_m(P.SILENCING)} AND ({_m(P.URL)} OR {_m(P.FETCH)}))"),
]


@query(
    "q15_near_miss_band",
    "WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT a.name AS candidate, b.name AS target, levenshtein(a.name, b.name)::INT AS distance FROM n a JOIN n b ON a.name <> b.name AND abs(length(a.name) - length(b.name)) <= 3 WHERE levenshtein(a.name, b.name) <= 5",
)
def q15(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    near = names.within_band(n.select(F.col("name").alias("bare")), n, 3, 5)
    return near.select(F.col("bare").alias("candidate"), "target", F.col("edits").alias("distance"))


_VERSIONS = "(p_size % 4) || '.' || CASE WHEN p_partkey % 13 = 0 THEN 20240100 + p_partkey % 6 ELSE p_partkey % 6 END || '.' || (p_partkey % 9) || CASE WHEN p_partkey % 11 = 0 THEN '-beta.' || (p_partkey % 3) ELSE '' END"
_NO_TOP = "[9223372036854775807]"
#: Ranges and their intervals, typed in.
_INTERVALS = [
    ("^1.2.3", "[1, 2, 3]", "[2, 0, 0]"), ("~1.2.0", "[1, 2, 0]", "[1, 3, 0]"), ("1.x", "[1, 0, 0]", "[2, 0, 0]"), (">=1.0.0 <2.0.0", "[1, 0, 0]", "[2, 0, 0]"), ("1.2.3", "[1, 2, 3]", "[1, 2, 4]"), ("*", "[0]", _NO_TOP),
    ("^0.2.1", "[0, 2, 1]", "[0, 3, 0]"), ("1.0.0 - 1.4.0", "[1, 0, 0]", "[1, 4, 1]"), ("<1.0.0 || >=3.1.0", "[0]", "[1, 0, 0]"), ("<1.0.0 || >=3.1.0", "[3, 1, 0]", _NO_TOP), (">= 2.0.0", "[2, 0, 0]", _NO_TOP), ("~2", "[2, 0, 0]", "[3, 0, 0]"),
]


@query(
    "q17_semver_max_satisfying",
    f"""WITH v AS (SELECT DISTINCT {_VERSIONS} AS version FROM part), k AS (SELECT version, regexp_extract(version, '^([0-9]+)\\.([0-9]+)\\.([0-9]+)(-(.*))?$', ['a', 'b', 'c', 'd', 'e']) AS m FROM v),
    n AS (SELECT version, m.e <> '' AS pre, [m.a::BIGINT, m.b::BIGINT, m.c::BIGINT] AS n FROM k), r(range, low, high) AS (VALUES {", ".join(f"('{r}', {a}::BIGINT[], {b}::BIGINT[])" for r, a, b in _INTERVALS)})
    SELECT range, count(DISTINCT version) AS matching, max_by(version, n) AS best FROM r JOIN n ON NOT pre AND n >= low AND n < high GROUP BY range
    UNION ALL SELECT '2.0.0-beta.1', count(*), max(version) FROM v WHERE version = '2.0.0-beta.1' HAVING count(*) > 0""",
)
def q17(spark, sf_dir):
    v = table(spark, sf_dir, "part").select(F.expr(_VERSIONS).alias("version")).distinct().withColumn("key", V.version_key(F.col("version")))
    # A range is a row of a small fixed table, its intervals are expanded before the join.
    r = X.table(spark, X.RANGES, "range")
    hit = v.join(F.broadcast(r), V.satisfies(F.col("version"), F.col("range")))
    return hit.groupBy("range").agg(F.count(F.lit(1)).alias("matching"), F.max_by("version", "key").alias("best"))


@query(
    "q19_manifest_json",
    "SELECT 'event' AS project, 'k' AS name, json_extract_string(props, '$.k') AS spec, event_type AS kind FROM events "
    "UNION ALL SELECT * FROM (VALUES ('web', 'react', '^18.0.0', 'runtime'), ('web', '@babel/core', '7.x', 'runtime'), ('web', 'jest', '^29', 'dev'), ('web', 'vue', '>=3', 'warning'))",
)
def q19(spark, sf_dir):
    return manifest_json(spark, table(spark, sf_dir, "events"))


def manifest_json(spark, rows: DataFrame) -> DataFrame:
    inline = manifests.package_json(X.table(spark, X.PACKAGE_FILES, "project, text"))
    events = rows.select(F.lit("event").alias("project"), F.explode(F.from_json("props", "map<string,string>")).alias("name", "spec"), F.col("event_type").alias("kind"))
    return events.unionByName(inline)


def _weight(metric: str) -> str:
    return f"CASE regexp_extract(vector, '/{metric}:([A-Z])', 1) " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in P.CVSS[metric].items()) + " END"


def _metric(name: str, values: str, step: int) -> str:
    """A metric that goes through its values every `step` parts; reads the same in both engines."""
    cases = " ".join(f"WHEN {i} THEN '/{name}:{v}'" for i, v in enumerate(values))
    return f"CASE CAST(floor(p_partkey / {step}) AS BIGINT) % {len(values)} {cases} END"


_METRICS = [("AV", "NALP", 1), ("AC", "LH", 4), ("PR", "NLH", 8), ("UI", "NR", 24), ("S", "UC", 48), ("C", "HLN", 3), ("I", "HNL", 9), ("A", "LHN", 27)]
#: A vector for each part: all metrics, some without the last one, some of another version.
_VECTOR = "concat(CASE WHEN p_partkey % 77 = 5 THEN 'CVSS:2.0' ELSE 'CVSS:3.1' END, " + ", ".join(_metric(*m) for m in _METRICS[:-1]) + f", CASE WHEN p_partkey % 50 = 3 THEN '' ELSE {_metric(*_METRICS[-1])} END)"


@query(
    "q31_cvss_score",
    f"WITH v AS (SELECT p_partkey, {_VECTOR} AS vector FROM part), m AS (SELECT p_partkey, vector, contains(vector, '/S:C') AS changed, 1 - (1 - {_weight('C')}) * (1 - {_weight('I')}) * (1 - {_weight('A')}) AS base, "
    f"8.22::DOUBLE * {_weight('AV')} * {_weight('AC')} * {_weight('PR')} * {_weight('UI')} AS exploit FROM v), "
    "i AS (SELECT *, CASE WHEN changed THEN 7.52::DOUBLE * (base - 0.029) - 3.25::DOUBLE * pow(base - 0.02, 15) ELSE 6.42::DOUBLE * base END AS impact FROM m), "
    "s AS (SELECT p_partkey, vector, CASE WHEN exploit IS NULL OR base IS NULL THEN NULL WHEN impact <= 0 THEN 0.0::DOUBLE ELSE floor(least(CASE WHEN changed THEN 1.08::DOUBLE ELSE 1.0 END * (impact + exploit), 10.0) * 10 + 0.99999) / 10 END AS score FROM i) "
    "SELECT p_partkey, vector, score, CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MODERATE' WHEN score IS NOT NULL THEN 'LOW' ELSE 'UNKNOWN' END AS severity FROM s",
)
def q31(spark, sf_dir):
    vectors_ = spread(table(spark, sf_dir, "part")).select("p_partkey", F.expr(_VECTOR).alias("vector"))
    scored = vectors_.withColumn("score", V.cvss(F.col("vector")))
    return scored.withColumn("severity", V.severity(F.col("score")))


