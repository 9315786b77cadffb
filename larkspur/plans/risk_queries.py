"""Queries on advisories, graphs, releases, history and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cut, shared_path, table
from ..functions import patterns as P
from ..operators import calibration, diffs, evaluation, features, graph, history, ml, names, resolution, vulns
from ..sources import archives, registry, shipped, store
from ..streaming import incremental

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return enter


#: Findings that lineitem stands for; each expression reads the same in both engines.
FINDING = {
    "ord": "l_orderkey * 8 + l_linenumber",
    "scan": "l_suppkey",
    "package": "concat('pkg', CAST(l_partkey AS VARCHAR(20)))",
    "id": "concat('ADV-', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))",
    "cve": "CASE WHEN l_linenumber % 3 <> 0 THEN concat('CVE-', CAST(l_orderkey % 7 AS VARCHAR(20))) END",
    "severity": "CASE WHEN l_quantity >= 45 THEN 'CRITICAL' WHEN l_quantity >= 30 THEN 'HIGH' WHEN l_quantity >= 15 THEN 'MODERATE' WHEN l_quantity >= 5 THEN 'LOW' ELSE 'UNKNOWN' END",
    "cvss": "CASE WHEN l_discount > 0.02 THEN CAST(l_quantity AS DOUBLE) / 5 END",
    "n_symbols": "l_linenumber % 4",
    "summary": "l_linestatus",
    "fixed": "CASE WHEN l_linenumber % 2 = 0 THEN concat(CAST(l_orderkey % 3 AS VARCHAR(20)), '.', CAST(l_orderkey % 12 AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(20))) END",
    "reachable": "l_returnflag = 'R'",
}
FINDINGS = "findings AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FINDING.items()) + " FROM lineitem)"
RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def findings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in FINDING.items()])


@query(
    "q26_advisory_join",
    f"WITH {FINDINGS} SELECT f.package, f.id, p_name AS name, o_orderstatus AS status FROM findings f JOIN part ON package = concat('pkg', p_partkey) JOIN orders ON o_orderkey = ord // 8",
)
def q26(spark, sf_dir):
    return advisory_join(spark, sf_dir, findings(spark, sf_dir))


def advisory_join(spark, sf_dir, found: DataFrame) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.expr("concat('pkg', p_partkey)").alias("package"), F.col("p_name").alias("name"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("advisory"), F.col("o_orderstatus").alias("status"))
    return vulns.matched(found.withColumn("advisory", F.expr("ord div 8")), part, orders).select("package", "id", "name", "status")


@query(
    "q27_advisory_dedupe",
    f"""WITH {FINDINGS}, r AS (SELECT *, coalesce(cve, id) AS cve_or_id, {RANK} AS rank FROM findings),
    w AS (SELECT *, row_number() OVER (PARTITION BY package, cve_or_id ORDER BY cvss IS NOT NULL DESC, rank DESC, coalesce(cvss, 0) DESC, n_symbols DESC, length(summary) DESC, ord) AS n,
        count(*) OVER (PARTITION BY package, cve_or_id) AS records FROM r),
    o AS (SELECT package, cve_or_id, min_by(fixed, ord) FILTER (fixed IS NOT NULL) AS other FROM r GROUP BY ALL)
    SELECT package, cve_or_id, id, severity, cvss, coalesce(fixed, other) AS fixed, records FROM w JOIN o USING (package, cve_or_id) WHERE n = 1""",
)
def q27(spark, sf_dir):
    return vulns.deduplicated(findings(spark, sf_dir))


@query(
    "q28_remediation_plan",
    f"""WITH {FINDINGS} SELECT package, max_by(fixed, list_transform(string_split(fixed, '.'), lambda x: x::INT)) AS upgrade_to, count(*) AS fixes, count(*) FILTER (WHERE reachable) AS reachable_fixes,
        max({RANK}) AS worst, array_to_string(list_sort(list_distinct(list(id)))[1:12], ',') AS ids FROM findings WHERE fixed IS NOT NULL GROUP BY package""",
)
def q28(spark, sf_dir):
    return vulns.remediation(findings(spark, sf_dir)).withColumn("worst", F.col("worst").cast("int")).withColumn("ids", F.array_join("ids", ","))


@query(
    "q28b_ordered_plan",
    f"WITH {FINDINGS}, r AS (SELECT package, count(*) AS fixes, count(*) FILTER (WHERE reachable) AS reachable_fixes FROM findings WHERE fixed IS NOT NULL GROUP BY package) SELECT package, p_name AS version, fixes, reachable_fixes FROM r JOIN part ON package = 'pkg' || p_partkey",
)
def q28b(spark, sf_dir):
    packages = table(spark, sf_dir, "part").select(F.expr("concat('pkg', p_partkey)").alias("package"), F.col("p_name").alias("version"), F.lit(True).alias("is_direct"))
    return vulns.remediation_plan(findings(spark, sf_dir), packages).select("package", "version", "fixes", "reachable_fixes")


_SEV = ", ".join([f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in vulns.RANKS] + [f"count(*) FILTER (WHERE severity = '{s}' AND reachable) AS reachable_{s.lower()}" for s in vulns.RANKS])


@query("q29_scan_summary", f"WITH {FINDINGS} SELECT scan, count(*) AS total, count(*) FILTER (WHERE reachable) AS reachable, {_SEV}, round((count(*) - count(*) FILTER (WHERE reachable)) / count(*), 6) AS noise_reduction FROM findings GROUP BY scan")
def q29(spark, sf_dir):
    return vulns.summary(findings(spark, sf_dir)).withColumn("noise_reduction", F.round("noise_reduction", 6))


_PRIORITY = "coalesce(cvss, CASE severity WHEN 'CRITICAL' THEN 9.0 WHEN 'HIGH' THEN 7.5 WHEN 'MODERATE' THEN 5.0 WHEN 'LOW' THEN 2.5 ELSE 4.0 END) * CASE WHEN reachable THEN 1.0 ELSE 0.1 END"


@query("q30_priority_topk", f"WITH {FINDINGS} SELECT id, package, severity, round(({_PRIORITY})::DOUBLE, 6) AS priority FROM findings ORDER BY ({_PRIORITY})::DOUBLE DESC, id LIMIT 100")
def q30(spark, sf_dir):
    return vulns.top_by_priority(findings(spark, sf_dir), 100).select("id", "package", "severity", F.round("priority", 6).alias("priority"))


#: Dependency edges among parts.
EDGES = "edges AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2 AND p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_partkey % 97 + 1 FROM part WHERE p_partkey % 5 = 0) WHERE src <> dst)"
ROOTS = "roots AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 250 = 7)"


def edges(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    half = p.where("p_partkey >= 2 AND p_partkey % 3 <> 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    other = p.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") % 97 + 1).alias("dst"))
    return half.unionByName(other).where("src <> dst").distinct()


def roots(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 250 = 7").select(F.col("p_partkey").alias("node"))


#: Levels of the dependency closure.
DEPTH = 6
CLOSURE = f"WITH RECURSIVE {EDGES}, {ROOTS}, walk AS (SELECT node AS root, node, 0 AS depth FROM roots UNION SELECT root, dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 6), reached AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY ALL)"


@query("q20_dependency_closure", CLOSURE + " SELECT root, node, depth FROM reached")
def q20(spark, sf_dir):
    return graph.closure(edges(spark, sf_dir), roots(spark, sf_dir), DEPTH)


@query(
    "q20b_merged_dependencies",
    CLOSURE + ", inside AS (SELECT DISTINCT node FROM reached), p AS (SELECT dst AS node, array_to_string(list_sort(list(DISTINCT src)), ',') AS required_by FROM edges WHERE src IN (SELECT node FROM inside) GROUP BY dst) "
    "SELECT node, depth, depth = 1 AS is_direct, required_by FROM (SELECT node, min(depth) AS depth FROM reached WHERE depth > 0 GROUP BY node) JOIN p USING (node)",
)
def q20b(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.merged_dependencies(e, graph.closure(e, roots(spark, sf_dir), DEPTH)).select("node", "depth", "is_direct", F.array_join("required_by", ",").alias("required_by"))


#: A registry of parts: releases of each, and what each release depends on; reads the same in both engines.
_RELEASES = [("true", "'1.0.0'", 1, "0"), ("true", "concat('1.', CAST(p_partkey % 4 + 1 AS VARCHAR(9)), '.0')", 1, "p_partkey % 4 + 1"), ("p_partkey % 3 > 0", "concat('2.', CAST(p_partkey % 3 AS VARCHAR(9)), '.1')", 2, "p_partkey % 3"), ("p_partkey % 5 = 0", "'3.0.0-beta.1'", 3, "0")]
_WANTS = [
    ("p_partkey > 1", "concat('pk', CAST(floor(p_partkey / 2) AS BIGINT))", "CASE WHEN major = 1 THEN '^1.0.0' ELSE '>=1.0.0 <3.0.0' END", 0),
    ("p_partkey % 4 > 0", "concat('pk', CAST(p_partkey % 97 + 1 AS BIGINT))", "CASE WHEN major = 2 THEN '^2.0.0' ELSE '1.x' END", 1),
    ("p_partkey % 7 = 0", "concat('gone', CAST(p_partkey AS BIGINT))", "'*'", 2),
]
_ASKS = [("concat('pk', CAST(s_suppkey AS BIGINT))", "'^1.0.0'", 0), ("concat('pk', CAST(s_suppkey * 3 + 1 AS BIGINT))", "'>=1.0.0 <3.0.0'", 1), ("concat('pk', CAST(s_suppkey * 11 + 5 AS BIGINT))", "'^2.0.0'", 2)]
_RELEASE_SQL = " UNION ALL ".join(f"SELECT p_partkey, concat('pk', CAST(p_partkey AS BIGINT)) AS name, {v} AS version, {major} AS major, {minor} AS minor FROM part WHERE {c}" for c, v, major, minor in _RELEASES)
_WANT_SQL = " UNION ALL ".join(f"SELECT name, version, {d} AS dependency, {spec} AS range, {i} AS ord FROM releases WHERE {c}" for c, d, spec, i in _WANTS)
_ASK_SQL = " UNION ALL ".join(f"SELECT s_name AS root, {n} AS name, {spec} AS spec, {i} AS ord FROM supplier" for n, spec, i in _ASKS)


def _levels_sql(last: int = 6) -> str:
    """Each level spelled out: q what is asked for, t with the version that fits best, f the first that can be met, n the level's packages."""
    out = [
        f"releases AS ({_RELEASE_SQL})",
        f"wants AS ({_WANT_SQL})",
        f"q0 AS (SELECT root, name, spec, root AS parent, 0::BIGINT AS place, ord FROM ({_ASK_SQL}))",
        "specs AS (SELECT * FROM (VALUES ('^1.0.0', 1, 1), ('1.x', 1, 1), ('^2.0.0', 2, 2), ('>=1.0.0 <3.0.0', 1, 2), ('*', 1, 2)) s(spec, low, high))",
        "best AS (SELECT name, spec, max_by(version, major * 100 + minor) AS version FROM releases, specs WHERE major BETWEEN low AND high GROUP BY name, spec)",
    ]
    for d in range(last + 1):
        seen = " UNION ALL ".join(f"SELECT root, name FROM n{i}" for i in range(d)) or "SELECT NULL::VARCHAR AS root, NULL::VARCHAR AS name WHERE false"
        if d:
            out.append(f"q{d} AS (SELECT n.root, w.dependency AS name, w.range AS spec, n.name AS parent, n.place, w.ord FROM n{d - 1} n JOIN wants w ON w.name = n.name AND w.version = n.version)")
        out.append(f"seen{d} AS ({seen})")
        out.append(f"t{d} AS (SELECT q.*, b.version, EXISTS (SELECT 1 FROM seen{d} s WHERE s.root = q.root AND s.name = q.name) AS there FROM q{d} q LEFT JOIN best b USING (name, spec))")
        out.append(f"f{d} AS (SELECT root, name, min((place, ord)) AS first FROM t{d} WHERE version IS NOT NULL AND NOT there GROUP BY root, name)")
        out.append(f"n{d} AS (SELECT root, name, t.version, t.spec, {d} AS depth, row_number() OVER (PARTITION BY root ORDER BY first) AS place FROM t{d} t JOIN f{d} USING (root, name) WHERE (t.place, t.ord) = first)")
        out.append(f"u{d} AS (SELECT t.root, t.name, t.spec, t.parent, {d} AS depth FROM t{d} t LEFT JOIN f{d} f USING (root, name) WHERE NOT there AND version IS NULL AND (first IS NULL OR (place, ord) < first))")
        out.append(f"p{d} AS (SELECT t.root, t.name, {d} AS level, t.place, t.ord, t.parent FROM t{d} t LEFT JOIN f{d} f USING (root, name) WHERE there OR (place, ord) >= first)")
    return "WITH " + ", ".join(out)


_EACH = lambda letter, columns, last=6: " UNION ALL ".join(f"SELECT {columns} FROM {letter}{d}" for d in range(last + 1))


def resolved(spark, sf_dir, max_depth: int | None = None) -> resolution.Resolution:
    parts = table(spark, sf_dir, "part")
    releases = cut(reduce(DataFrame.unionByName, [parts.where(c).select("p_partkey", F.expr("concat('pk', p_partkey)").alias("name"), F.expr(v).alias("version"), F.lit(major).alias("major")) for c, v, major, _ in _RELEASES]))
    wants = cut(reduce(DataFrame.unionByName, [releases.where(c).select("name", "version", F.expr(d).alias("dependency"), F.expr(spec).alias("range"), F.lit(i).alias("ord")) for c, d, spec, i in _WANTS]))
    asks = reduce(DataFrame.unionByName, [table(spark, sf_dir, "supplier").select(F.col("s_name").alias("root"), F.expr(n).alias("name"), F.expr(spec).alias("spec"), F.lit(i).alias("ord")) for n, spec, i in _ASKS])
    tags = releases.select("name", F.lit("latest").alias("tag"), "version").limit(0)
    return resolution.resolve(asks, wants, lambda asked: registry.resolve_npm(asked, releases.select("name", "version"), tags), max_depth)


@query(
    "q20d_resolved_packages",
    _levels_sql() + f", p AS ({_EACH('p', '*')}), by_first AS (SELECT root, name, parent, min((level, place, ord)) AS met FROM p GROUP BY root, name, parent), r AS (SELECT root, name, string_agg(parent, ',' ORDER BY met) AS required_by FROM by_first GROUP BY root, name) "
    f"SELECT root, name, version, depth, depth = 0 AS is_direct, spec, required_by FROM ({_EACH('n', 'root, name, version, depth, spec')}) JOIN r USING (root, name)",
)
def q20d(spark, sf_dir):
    return resolved(spark, sf_dir, DEPTH).packages.withColumn("required_by", F.array_join("required_by", ","))


#: The same to the end: n hands on what a root has while it grows, a package being fresh in the level that finds it; f has each package once.
_TO_THE_END = (
    f"WITH RECURSIVE releases AS ({_RELEASE_SQL}), wants AS ({_WANT_SQL}), asks AS ({_ASK_SQL}), "
    "specs AS (SELECT * FROM (VALUES ('^1.0.0', 1, 1), ('1.x', 1, 1), ('^2.0.0', 2, 2), ('>=1.0.0 <3.0.0', 1, 2), ('*', 1, 2)) s(spec, low, high)), "
    "best AS (SELECT name, spec, max_by(version, major * 100 + minor) AS version FROM releases, specs WHERE major BETWEEN low AND high GROUP BY name, spec), "
    "n AS (SELECT root, name, version, 0 AS depth, 0::BIGINT AS asked, ord, row_number() OVER (PARTITION BY root ORDER BY ord, name) AS place, true AS fresh "
    "FROM (SELECT root, name, version, ord FROM asks JOIN best USING (name, spec) QUALIFY row_number() OVER (PARTITION BY root, name ORDER BY ord) = 1) "
    "UNION ALL (SELECT root, name, version, depth, asked, ord, place, false FROM n WHERE root IN (SELECT root FROM n WHERE fresh) "
    "UNION ALL SELECT root, name, version, depth, asked, ord, row_number() OVER (PARTITION BY root ORDER BY asked, ord, name), true "
    "FROM (SELECT o.root, w.dependency AS name, b.version, o.depth + 1 AS depth, o.place AS asked, w.ord FROM n o JOIN wants w ON w.name = o.name AND w.version = o.version JOIN best b ON b.name = w.dependency AND b.spec = w.range "
    "WHERE o.fresh AND NOT EXISTS (SELECT 1 FROM n s WHERE s.root = o.root AND s.name = w.dependency) QUALIFY row_number() OVER (PARTITION BY o.root, w.dependency ORDER BY o.place, w.ord) = 1))), "
    "f AS (SELECT * FROM n WHERE fresh), q AS (SELECT root, name, spec, root AS parent, 0 AS depth, 0::BIGINT AS place, ord FROM asks "
    "UNION ALL SELECT f.root, w.dependency, w.range, f.name, f.depth + 1, f.place, w.ord FROM f JOIN wants w ON w.name = f.name AND w.version = f.version)"
)


@query(
    "q20e_unresolved_requirements",
    _TO_THE_END + " SELECT q.root, q.name, q.spec, q.parent, q.depth FROM q LEFT JOIN best b USING (name, spec) LEFT JOIN f ON f.root = q.root AND f.name = q.name WHERE b.version IS NULL AND (f.depth IS NULL OR (f.depth, f.asked, f.ord) > (q.depth, q.place, q.ord))",
)
def q20e(spark, sf_dir):
    return resolved(spark, sf_dir).unresolved


@query("q21_entry_points", f"WITH {EDGES} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM edges)")
def q21(spark, sf_dir):
    return graph.entry_points(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), edges(spark, sf_dir))


REACHED = f"WITH RECURSIVE {EDGES}, {ROOTS}, walk AS (SELECT node AS root, node FROM roots UNION SELECT root, dst FROM walk JOIN edges ON src = node)"


@query(
    "q22_proof_paths",
    f"WITH RECURSIVE {EDGES}, {ROOTS}, walk(node, path) USING KEY (node) AS (SELECT node, [node::VARCHAR] FROM roots UNION SELECT dst, min(list_append(path, dst::VARCHAR)) FROM walk JOIN edges ON src = node "
    "WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.node = dst) GROUP BY dst) SELECT node AS target, (len(path) - 1)::INT AS hops, array_to_string(path, ' > ') AS path FROM walk",
)
def q22(spark, sf_dir):
    return graph.proof_paths(edges(spark, sf_dir), roots(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")).unionByName(edges(spark, sf_dir).select(F.col("dst").alias("node"))))


@query("q23_reachable_set", REACHED + " SELECT node, count(*) AS roots FROM walk GROUP BY node")
def q23(spark, sf_dir):
    return graph.closure(edges(spark, sf_dir), roots(spark, sf_dir)).groupBy("node").agg(F.count(F.lit(1)).alias("roots"))


_VERDICT = (
    REACHED + ", s AS (SELECT DISTINCT node FROM walk), f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 0 THEN [] ELSE ['s' || (l_linenumber % 3)] END AS symbols FROM lineitem), "
    "v AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 10 = 9 OR p_partkey IS NULL THEN 'not_analysed' WHEN s.node IS NULL THEN 'not_imported' WHEN len(symbols) = 0 THEN 'assumed_reachable' WHEN list_contains(symbols, 's' || (l_partkey % 3)) THEN 'reachable' ELSE 'symbol_not_called' END AS verdict "
    "FROM f LEFT JOIN s ON s.node = l_partkey LEFT JOIN part ON p_partkey = l_partkey)"
)


def verdicts(spark, sf_dir) -> DataFrame:
    reached = graph.closure(edges(spark, sf_dir), roots(spark, sf_dir)).select(F.col("node").alias("package")).distinct()
    part = table(spark, sf_dir, "part")
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("package"), F.expr("CASE WHEN l_linenumber % 4 = 0 THEN array() ELSE array(concat('s', l_linenumber % 3)) END").cast("array<string>").alias("symbols"))
    called = part.select(F.col("p_partkey").alias("package"), F.expr("concat('s', p_partkey % 3)").alias("symbol"))
    return vulns.reachability(f, part.where("p_partkey % 10 <> 9").select(F.col("p_partkey").alias("package")), reached, called)


@query("q24_reachability_verdict", _VERDICT + " SELECT l_orderkey, l_linenumber, l_partkey, verdict, CASE verdict WHEN 'not_analysed' THEN 'none' WHEN 'assumed_reachable' THEN 'low' WHEN 'symbol_not_called' THEN 'medium' ELSE 'high' END AS confidence FROM v")
def q24(spark, sf_dir):
    return verdicts(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("package").alias("l_partkey"), "verdict", "confidence")


@query(
    "q25_exposure",
    _VERDICT + " SELECT CASE WHEN l_linenumber = 1 AND l_partkey % 7 = 0 THEN 'install_time' WHEN verdict = 'not_analysed' THEN 'unknown' WHEN verdict = 'not_imported' THEN 'not_imported' WHEN l_linenumber = 2 THEN 'import_time' WHEN verdict = 'reachable' THEN 'call_reachable' ELSE 'not_called' END AS exposure, count(*) AS flows FROM v GROUP BY exposure",
)
def q25(spark, sf_dir):
    v = F.col("verdict")
    e = vulns.exposure((F.col("l_linenumber") == 1) & (F.col("package") % 7 == 0), v != "not_analysed", v != "not_imported", F.col("l_linenumber") == 2, v == "reachable")
    return verdicts(spark, sf_dir).groupBy(e.alias("exposure")).agg(F.count(F.lit(1)).alias("flows"))


_SIDE = "SELECT doc_id // 2 AS path, sha256(coalesce(text, '')) AS sha256, n_chars AS size FROM documents WHERE doc_id % 2 = {} AND doc_id % 7 <> {}"


@query(
    "q34_version_diff",
    f"WITH o AS ({_SIDE.format(0, 3)}), n AS ({_SIDE.format(1, 5)}) SELECT path, CASE WHEN o.sha256 IS NULL THEN 'added' WHEN n.sha256 IS NULL THEN 'removed' ELSE 'modified' END AS status, o.sha256 AS old_sha256, n.sha256 AS new_sha256, o.size AS old_size, n.size AS new_size "
    "FROM o FULL JOIN n USING (path) WHERE o.sha256 IS DISTINCT FROM n.sha256",
)
def q34(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 2").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("n_chars").alias("size"))
    found = diffs.changes(docs.where("doc_id % 2 = 0 AND doc_id % 7 <> 3"), docs.where("doc_id % 2 = 1 AND doc_id % 7 <> 5"))
    return found.select("path", "status", "old_sha256", "new_sha256", "old_size", "new_size")


@query(
    "q35_archive_ceilings",
    "WITH r AS (SELECT source, doc_id, count(*) OVER w AS members, sum(n_chars) OVER w AS bytes FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) "
    "SELECT source, doc_id, members, bytes::BIGINT AS bytes, CASE WHEN members > 40 THEN 'members' WHEN bytes > 80000 THEN 'bytes' END AS reason, members <= 40 AND bytes <= 80000 AS kept FROM r",
)
def q35(spark, sf_dir):
    return vulns.running_limit(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 40, 80_000).select("source", "doc_id", "members", "bytes", "reason", "kept")


@query("q36_last_write_wins", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q36(spark, sf_dir):
    return vulns.last_write(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", F.struct("ts", "event_id")).drop("ts")


@query("q41_matrix_summary", "SELECT source, quality, count(*) AS n, count(DISTINCT lang) AS distinct_lang FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((source, quality), (quality), ())")
def q41(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return evaluation.matrix_summary(rows, "source", "quality", "lang")


@query("q37_integrity_check", "SELECT doc_id AS sample_id, CASE WHEN text IS NULL OR doc_id % 5 = 1 THEN 'missing' ELSE 'corrupt' END AS problem FROM documents WHERE text IS NULL OR doc_id % 5 = 1 OR doc_id % 7 = 2")
def q37(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    digest = F.when(F.col("doc_id") % 7 == 2, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return store.vault_problems(docs.select(F.col("doc_id").alias("sample_id"), digest.alias("sha256"), F.when(F.col("doc_id") % 5 != 1, F.col("text")).cast("binary").alias("content")))


@query("q37b_digest_check", "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE doc_id % 3 <> 0 END AS agrees FROM documents")
def q37b(spark, sf_dir):
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.coalesce("text", F.lit(""))).cast("binary")
    own, kind = F.coalesce("text", F.lit("")).cast("binary"), F.col("doc_id") % 4
    sha512 = F.concat(F.lit("sha512-"), F.base64(F.unhex(F.sha2(own, 512))))
    agrees = diffs.digest_matches(content, F.when(kind == 0, F.upper(F.sha2(own, 256))), F.when(kind == 1, sha512), F.when(kind == 2, F.sha1(own)))
    return table(spark, sf_dir, "documents").select("doc_id", agrees.alias("agrees"))


@query("q38_scan_history", "SELECT event_id AS scan_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 150")
def q38(spark, sf_dir):
    scans = table(spark, sf_dir, "events").select(F.col("event_id").alias("scan_id"), F.col("ts").alias("created_at"), "event_type")
    return history.latest_scans(scans, 150).select("scan_id", "event_type")


@query("q39_log_filter", "SELECT event_id AS seq, event_type AS logger FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 3000) WHERE value >= 10 AND (contains(lower(props), '1') OR contains(lower(event_type), '1')) ORDER BY event_id DESC LIMIT 400")
def q39(spark, sf_dir):
    logs = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("value").alias("rank"), F.col("props").alias("message"), F.col("event_type").alias("logger"))
    return history.log_entries(logs, F.lit(10), "1", 400).select("seq", "logger")


@query("q40_package_history", "SELECT c_name AS name, o_orderstatus AS status, count(*) AS scans, max(o_orderkey) AS last_scan FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL")
def q40(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    packages = orders.select(F.col("o_orderkey").alias("scan_id"), "o_custkey").join(c.select("c_custkey", F.col("c_name").alias("name")), F.col("o_custkey") == F.col("c_custkey")).select("scan_id", "name")
    return history.package_history(orders.select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderstatus").alias("status")), packages, c.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("name")))


#: A score for each labelled document, as a fraction of whole numbers.
_SCORED = "scored AS (SELECT doc_id, quality AS label, (n_chars % 64) / 64.0::DOUBLE AS score, (n_chars % 10) / 10.0::DOUBLE AS other, source FROM labels JOIN documents USING (doc_id))"


def scored(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), ((F.col("n_chars") % 64) / 64.0).alias("score"), ((F.col("n_chars") % 10) / 10.0).alias("other"), "source")


_METRICS = "round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
_COUNTS = "count(*) FILTER (WHERE {p} AND label = 1) AS tp, count(*) FILTER (WHERE {p} AND label = 0) AS fp, count(*) FILTER (WHERE NOT ({p}) AND label = 1) AS fn, count(*) FILTER (WHERE NOT ({p}) AND label = 0) AS tn"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@query("q42_confusion_metrics", f"WITH {_SCORED}, c AS (SELECT {_COUNTS.format(p='score >= 0.5')} FROM scored) SELECT tp, fp, fn, tn, {_METRICS} FROM c")
def q42(spark, sf_dir):
    return _rounded(ml.confusion(scored(spark, sf_dir)))


@query(
    "q43_average_precision",
    f"WITH {_SCORED}, s AS (SELECT score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY score), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM s WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(pos * tp / n) / sum(pos), 6) AS average_precision FROM c",
)
def q43(spark, sf_dir):
    return _rounded(ml.average_precision(scored(spark, sf_dir)))


@query("q44_roc_auc", f"WITH {_SCORED} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END)::DOUBLE, 6) AS roc_auc FROM scored p JOIN scored n ON p.label = 1 AND n.label = 0")
def q44(spark, sf_dir):
    return _rounded(ml.roc_auc(scored(spark, sf_dir)))


@query(
    "q45_grouped_folds",
    f"WITH {_SCORED}, g AS (SELECT source AS grp, count(*) AS n, max(label) AS has_positive FROM scored GROUP BY source) SELECT grp, n, has_positive, ((row_number() OVER (PARTITION BY has_positive ORDER BY n DESC, md5(grp), grp) - 1) % 5)::INT AS fold FROM g",
)
def q45(spark, sf_dir):
    return ml.folds(scored(spark, sf_dir).withColumnRenamed("source", "grp"), 5)


@query("q46_duplicate_groups", "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS component FROM documents")
def q46(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    # A group's rows are linked to its first, not to each other.
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("dst"))
    links = docs.join(first, "digest").select(F.col("doc_id").alias("src"), "dst").where("src <> dst")
    return graph.components(links, docs.select(F.col("doc_id").alias("node")))


_GROUPED = """WITH RECURSIVE x AS (SELECT doc_id, doc_id // 3 AS name, n_chars // 7 || ':' || doc_id % 2 AS vec, quality AS label FROM documents JOIN labels USING (doc_id)),
    e AS (SELECT a.doc_id AS src, b.doc_id AS dst FROM x a JOIN x b ON a.name = b.name OR a.vec = b.vec),
    w AS (SELECT doc_id AS key, doc_id AS far FROM x UNION SELECT key, dst FROM w JOIN e ON far = src),
    g AS (SELECT key AS doc_id, min(far) AS grp FROM w GROUP BY key)"""


def agreeing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    vector = F.array(F.floor(F.col("n_chars") / 7) + 0.00001, (F.col("doc_id") % 2).cast("double"))
    found = graph.groups(docs, "doc_id", {"name": F.floor(F.col("doc_id") / 3), "vector": graph.rounded_key(vector)})
    return found.join(docs.select("doc_id", "label"), "doc_id")


@query("q46b_agreeing_groups", _GROUPED + " SELECT doc_id, grp FROM g")
def q46b(spark, sf_dir):
    return agreeing(spark, sf_dir).select("doc_id", "grp")


@query("q45b_stratified_fold_groups", _GROUPED + " SELECT grp, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives FROM g JOIN x USING (doc_id) GROUP BY grp")
def q45b(spark, sf_dir):
    return ml.stratified_folds(agreeing(spark, sf_dir), 5).drop("fold")


@query(
    "q51_ensemble_agreement",
    f"WITH {_SCORED}, e AS (SELECT 'either' AS rule, {_COUNTS.format(p='(score >= 0.5 OR other >= 0.5)')} FROM scored UNION ALL SELECT 'both', {_COUNTS.format(p='(score >= 0.5 AND other >= 0.5)')} FROM scored) SELECT rule, tp, fp, fn, tn, {_METRICS.split(' AS accuracy, ')[1]} FROM e",
)
def q51(spark, sf_dir):
    return _rounded(evaluation.ensemble(scored(spark, sf_dir), "score", "other"))


@query(
    "q51b_published_verdicts",
    f"WITH {_SCORED}, v AS (SELECT doc_id, 'a' AS tool, score FROM scored WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, 'b', other FROM scored), j AS (SELECT tool, v.score, label FROM v JOIN scored USING (doc_id)), "
    f"e AS (SELECT tool, {_COUNTS.format(p='score >= 0.5')} FROM j GROUP BY tool) SELECT tool, tp, fp, fn, tn, {_METRICS.split(' AS accuracy, ')[1]} FROM e",
)
def q51b(spark, sf_dir):
    s = scored(spark, sf_dir)
    verdicts = s.where("doc_id % 3 > 0").select("doc_id", F.lit("a").alias("tool"), "score").unionByName(s.select("doc_id", F.lit("b").alias("tool"), F.col("other").alias("score")))
    return _rounded(evaluation.by_tool(s, verdicts, "doc_id"))


@query(
    "q48_ablation_zeroing",
    f"WITH {_SCORED} SELECT g.name AS ablated, count(*) FILTER (WHERE CASE WHEN g.name = 'score' THEN 0 ELSE score END + CASE WHEN g.name = 'other' THEN 0 ELSE other END >= 0.8) AS flagged FROM scored, (VALUES ('none'), ('score'), ('other')) AS g(name) GROUP BY 1",
)
def q48(spark, sf_dir):
    rows = scored(spark, sf_dir).select("score", "other")
    flagged = lambda name, columns: evaluation.zeroed(rows, columns).agg(F.count_if(F.col("score") + F.col("other") >= 0.8).alias("flagged")).select(F.lit(name).alias("ablated"), "flagged")
    return flagged("none", []).unionByName(flagged("score", ["score"])).unionByName(flagged("other", ["other"]))


@query("q50_name_disjoint_holdout", "SELECT doc_id, source FROM documents WHERE doc_id % 2 = 1 AND source NOT IN (SELECT source FROM documents WHERE doc_id % 40 = 0)")
def q50(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return evaluation.disjoint(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 40 = 0"), ["source"])


@query("q52_seeded_sample", "SELECT doc_id, source FROM documents ORDER BY md5('20260817:' || doc_id), doc_id LIMIT 100")
def q52(spark, sf_dir):
    return store.seeded_subset(table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("doc_id").cast("string"), 100, 20260817).select("doc_id", "source")


@query("q53_resumable_append", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q53(spark, sf_dir):
    return incremental.unseen(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    "q62_severity_phrase",
    f"WITH {FINDINGS}, c AS (SELECT scan, severity, count(*) AS n, {RANK} AS rank FROM findings WHERE {RANK} >= 2 GROUP BY ALL) SELECT scan, string_agg(n || ' ' || lower(severity), ', ' ORDER BY rank DESC) AS phrase FROM c GROUP BY scan",
)
def q62(spark, sf_dir):
    return history.severity_phrases(findings(spark, sf_dir), "scan", "severity", vulns.rank(F.col("severity")))


def embedding_rows(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(64)]
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("label") % 2).alias("label"), (F.col("vec_id") % 25).cast("string").alias("grp"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query("q54_gbt_out_of_fold")
def q54(spark, sf_dir):
    rows, names = embedding_rows(spark, sf_dir)
    return ml.out_of_fold(rows, names, 3, 10).select("grp", "label", "score", "fold")


@query("q55_isotonic_calibration")
def q55(spark, sf_dir):
    rows, names = embedding_rows(spark, sf_dir)
    model = calibration.CalibratedClassifier(features=names, folds=3, trees=5, score="calibrated").fit(rows)
    return model.transform(rows).select("grp", "label", "calibrated")


@query(
    "q59_vault_stats",
    "SELECT event_type AS label, user_id % 3 AS ecosystem, count(*) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 GROUP BY GROUPING SETS ((event_type, user_id % 3), ())",
)
def q59(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("label"), (F.col("user_id") % 3).alias("ecosystem"))
    return store.vault_stats(store.vault_index(entries))


@query(
    "q60_path_filters",
    "WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/?', '') AS path FROM pages) SELECT page_id, regexp_matches(lower(path), '" + P.SKIPPED_PATH + "') AS skipped, "
    "regexp_matches(path, '(^|/)\\.\\.(/|$)|^/') AS unsafe, CASE WHEN regexp_matches(lower(path), '\\.pyi?$') THEN 'python' WHEN regexp_matches(lower(path), '\\.(js|mjs|cjs|jsx)$') THEN 'javascript' ELSE 'other' END AS language FROM p",
)
def q60(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*/?", "").alias("path"))
    language = F.coalesce(features.language(F.col("path")), F.lit("other"))
    return p.select("page_id", F.lower("path").rlike(P.SKIPPED_PATH).alias("skipped"), archives.unsafe_path(F.col("path")).alias("unsafe"), language.alias("language"))


@query(
    "q61_shallowest_file",
    "SELECT package, text FROM (SELECT page_id % 40 AS package, page_id::VARCHAR AS text, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id % 3, 'd/' || page_id || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/x' ELSE '/x/y' END || '/PKG-INFO') AS n FROM pages WHERE page_id % 4 > 0) WHERE n = 1",
)
def q61(spark, sf_dir):
    path = F.expr("concat('d/', page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/x' ELSE '/x/y' END, CASE WHEN page_id % 4 > 0 THEN '/PKG-INFO' ELSE '/OTHER' END)")
    files = table(spark, sf_dir, "pages").select(F.expr("page_id % 40").alias("package"), path.alias("path"), F.col("page_id").cast("string").alias("text"))
    return shipped.shallowest_file(files, ["PKG-INFO"])


@query("q63_popular_union", "SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT n_name FROM nation) WHERE name <> ''")
def q63(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return names.popular_list([part.select(F.col("p_name").alias("name")), part.select(F.col("p_brand").alias("name"))], table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


#: A small matrix: features of labelled documents, one of them no number in some rows.
_MATRIX_SQL = "SELECT 's' || doc_id AS sample_id, quality AS label, source AS \"group\", n_chars::DOUBLE AS size, CASE WHEN doc_id % 7 = 3 THEN 0.0 ELSE (n_chars % 10) / 8.0 END::DOUBLE AS part FROM labels JOIN documents USING (doc_id)"


@query("q94_matrix_round_trip", _MATRIX_SQL)
def q94(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("source").alias("group"))
    part = F.when(F.col("doc_id") % 7 == 3, "none").otherwise(((F.col("n_chars") % 10) / 8).cast("string"))
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.expr("concat('s', doc_id)").alias("sample_id"), F.col("quality").alias("label"), "group", F.col("n_chars").cast("double").alias("size"), part.alias("part"))
    path = shared_path(spark, "matrix")
    store.write_matrix(store.coerced(rows, ["part"]), path, ["size", "part"])
    return store.read_matrix(spark, f"{path}/features", ["size", "part"])


@query(
    "q95_vault_put_get",
    "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS sample_id, count(*) AS copies FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text",
)
def q95(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    samples = docs.select(F.col("doc_id").cast("string").alias("name"), F.lit("benign").alias("label"), F.lit("npm").alias("ecosystem"), F.encode("text", "UTF-8").alias("content"))
    path = shared_path(spark, "vault")
    for some in (samples.where("name % 2 = 0"), samples):  # what is there already is not stored again
        store.put(spark, path, some)
    held = spark.read.parquet(path).select("sample_id")
    own = docs.withColumn("sample_id", F.sha2("text", 256)).join(held, "sample_id")
    return own.groupBy("sample_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(
    "q96_scan_store",
    "SELECT 'c' || o_custkey AS scan_id, o_orderkey AS package, CASE WHEN o_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS run FROM orders WHERE o_custkey % 3 <> 0 OR o_orderkey % 2 = 0",
)
def q96(spark, sf_dir):
    scans = table(spark, sf_dir, "orders").select(F.expr("concat('c', o_custkey)").alias("scan_id"), F.col("o_orderkey").alias("package"), F.lit("first").alias("run"), "o_custkey")
    path = shared_path(spark, "scans")
    store.upsert_scans(spark, path, scans.drop("o_custkey"), 16)
    again = scans.where("o_custkey % 3 = 0").withColumn("run", F.lit("second"))
    # a customer whose orders are all odd is scanned again without a package: a row without one stands for that
    none = again.groupBy("scan_id").agg(F.count_if(F.col("package") % 2 == 0).alias("n")).where("n = 0").select("scan_id", F.lit(None).cast("long").alias("package"), F.lit("second").alias("run"))
    store.upsert_scans(spark, path, again.where("package % 2 = 0").drop("o_custkey").unionByName(none), 16)
    return spark.read.parquet(path).where("package IS NOT NULL").select("scan_id", "package", "run")


@query(
    "q98_detector_comparison",
    f"WITH {_SCORED}, c AS (SELECT 'new' AS detector, label = 1 AS expected, score >= 0.5 AS raised FROM scored UNION ALL SELECT 'old', label = 1, other >= 0.5 FROM scored) "
    "SELECT detector, count(*) FILTER (WHERE expected AND raised) AS found, count(*) FILTER (WHERE expected AND NOT raised) AS missed, count(*) FILTER (WHERE NOT expected AND raised) AS false_alarms FROM c GROUP BY detector",
)
def q98(spark, sf_dir):
    rows = scored(spark, sf_dir)
    case = lambda name, column: rows.select(F.lit(name).alias("detector"), (F.col("label") == 1).alias("expected"), (F.col(column) >= 0.5).alias("raised"))
    return evaluation.detector_comparison(case("new", "score").unionByName(case("old", "other")))
