import json

from larkspur import projects


def test_lock_files_pins_and_ranges(spark):
    """A lock file and a list of pins say what is installed; a pin among ranges is resolved like them; dev requirements only on demand."""
    lock = json.dumps({"lockfileVersion": 3, "packages": {"": {"name": "a"}, "node_modules/left": {"version": "1.2.0"}, "node_modules/deep": {"version": "0.3.0"}}})
    files = [
        ("a", "package-lock.json", lock),
        ("a", "package.json", json.dumps({"dependencies": {"left": "^1.0.0"}})),
        ("a", "index.js", "const l = require('left');"),
        ("b", "requirements.txt", "x==1.0\ny==2.0\n"),
        ("c", "requirements.txt", "x==1.0\ny>=1\ngone\n"),
        ("d", "package.json", json.dumps({"dependencies": {"left": "^1.0.0"}, "devDependencies": {"deep": "*"}})),
        ("e", "notes.txt", "nothing"),
    ]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    releases = df([("npm", "left", "1.2.0"), ("npm", "left", "1.3.0"), ("npm", "deep", "0.3.0"), ("pypi", "x", "1.0"), ("pypi", "y", "2.0"), ("pypi", "z", "1.0")], "ecosystem string, name string, version string")
    tags = df([], "ecosystem string, name string, tag string, version string")
    needs = df([("pypi", "y", "2.0", "z", ">=1", 0), ("npm", "left", "1.3.0", "deep", "^0.3.0", 0)], "ecosystem string, name string, version string, dependency string, range string, ord int")
    ids = df([("npm", "left", "1.2.0", "L"), ("npm", "deep", "0.3.0", "D"), ("pypi", "z", "1.0", "Z"), ("pypi", "y", "2.0", "Z")], "ecosystem string, name string, version string, id string")
    doc = lambda i, package: json.dumps({"id": i, "severity": [{"score": "8.0"}], "affected": [{"package": {"name": package}}]})
    documents = df([("L", doc("L", "left")), ("D", doc("D", "deep")), ("Z", doc("Z", "z"))], "id string, text string")
    stages = []
    got = projects.scan(df(files, "project string, path string, text string"), projects.Registry(releases, tags, needs), ids, documents, callback=lambda stage, share: stages.append(stage))
    packages = {(r["project"], r["name"], r["version"], r["depth"], r["is_direct"]) for r in got.packages.collect()}
    assert packages == {
        ("a", "left", "1.2.0", 0, True), ("a", "deep", "0.3.0", 0, False), ("b", "x", "1.0", 0, True), ("b", "y", "2.0", 0, True),
        ("c", "x", "1.0", 0, True), ("c", "y", "2.0", 0, True), ("c", "z", "1.0", 1, False), ("d", "left", "1.3.0", 0, True), ("d", "deep", "0.3.0", 1, False),
    }
    findings = {(r["project"], r["package"], r["id"]): (r["verdict"], r["reachable"]) for r in got.findings.collect()}
    assert findings == {
        ("a", "left", "L"): ("assumed_reachable", True), ("a", "deep", "D"): ("not_imported", False), ("d", "deep", "D"): ("not_analysed", True),
        ("b", "y", "Z"): ("not_analysed", True), ("c", "y", "Z"): ("not_analysed", True), ("c", "z", "Z"): ("not_analysed", True),
    }
    assert {tuple(r) for r in got.warnings.collect()} == {("c", "Unresolved: gone")}
    assert {r["project"]: (r["total"], r["reachable"]) for r in got.summary.collect()} == {"a": (2, 1), "b": (1, 1), "c": (2, 2), "d": (1, 1)}
    assert set(projects.STAGES) <= set(stages)
    order = [(r["project"], r["package"]) for r in got.findings.orderBy(*projects.ranked(got.findings)).collect()]
    assert order[:2] == [("a", "left"), ("a", "deep")]


def test_page_of_a_project(spark):
    """Sections of findings, paths, upgrades and warnings are there, in order of urgency, and everything is escaped."""
    from larkspur import report

    app = "import lib\ndef main():\n    lib.parse(1)\nmain()\n"
    files = [("p<1>", "requirements.txt", "lib>=1\nquiet\n<gone>\nmissing>=9\n"), ("p<1>", "app.py", app), ("other", "requirements.txt", "lib>=1\n")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    releases = df([("pypi", "lib", "1.0"), ("pypi", "quiet", "2.0")], "ecosystem string, name string, version string")
    known = projects.Registry(releases, df([], "ecosystem string, name string, tag string, version string"), df([], "ecosystem string, name string, version string, dependency string, range string, ord int"))
    ids = df([("pypi", "lib", "1.0", "L<b>"), ("pypi", "quiet", "2.0", "Q")], "ecosystem string, name string, version string, id string")
    doc = lambda i, n, fixed: json.dumps({"id": i, "severity": [{"score": "8.0"}], "affected": [{"package": {"name": n}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": fixed}]}], "ecosystem_specific": {"imports": ["lib.parse"]}}]})
    documents = df([("L<b>", doc("L<b>", "lib", "1.5.0")), ("Q", doc("Q", "quiet", "2.1.0"))], "id string, text string")
    got = projects.scan(df(files, "project string, path string, text string"), known, ids, documents)
    scores = df([("lib", "1.0", 0.95, "malicious"), ("quiet", "2.0", 0.1, "benign"), ("elsewhere", "1", 0.99, "malicious")], "package string, version string, score double, verdict string")
    signals = df([("lib", "DYNAMIC_EVAL", "high", 3, 2, "a<b>.py")], "package string, code string, severity string, rank int, occurrences int, first_path string")
    page = report.page(got, "p<1>", scores, signals)
    assert "<b>" not in page and "p&lt;1&gt;" in page and "a&lt;b&gt;.py" in page and "elsewhere" not in page
    for text in ("malicious 0.950", "L&lt;b&gt;", "app → app.main (app.py:4)", "app.main → lib.parse (app.py:3)", "Not reachable (1)", "<td>1.5.0</td>", "Unresolved: missing&gt;=9", "<td>50%</td>"):
        assert text in page, text
    assert page.index("Flagged") < page.index("Reachable vulnerabilities") < page.index("Not reachable") < page.index("Upgrades") < page.index("Warnings")
    other = report.page(got, "other")
    assert "No source was analysed" in other and "None." in other and "Not reachable" not in other


def test_which_releases_an_advisory_affects(spark):
    from larkspur.sources import advisories

    of = lambda i, **a: (i, json.dumps({"id": i, "affected": [{"package": {"name": "Lib", "ecosystem": a.pop("ecosystem", "PyPI")}, **a}]}))
    events = lambda *e, kind="ECOSYSTEM": [{"type": kind, "events": list(e)}]
    documents = [
        of("open", ranges=events({"introduced": "1.2"})), of("fixed", ranges=events({"introduced": "0"}, {"fixed": "1.5"})), of("again", ranges=events({"introduced": "0"}, {"fixed": "1.1"}, {"introduced": "2.0rc1"})),
        of("last", ranges=events({"introduced": "0"}, {"last_affected": "1.4"})), of("listed", versions=["1.4", "9"]), of("commits", ranges=events({"introduced": "0"}, kind="GIT")), of("npm", ecosystem="npm", ranges=events({"introduced": "0"})),
        of("two", ranges=events({"introduced": "0"}, {"fixed": "1.0"}) + events({"introduced": "1.4"}, {"fixed": "1.6"})), ("broken", "no json"), ("empty", "{}"),
    ]
    packages = spark.createDataFrame([("pypi", "lib", v) for v in ("1.0", "1.4", "1.5", "2.0")] + [("npm", "lib", "1.10.0"), ("pypi", "other", "1.4")], "ecosystem string, name string, version string")
    got = {}
    for r in advisories.affecting(packages, spark.createDataFrame(documents, "id string, text string")).collect():
        got.setdefault((r["ecosystem"], r["version"]), set()).add(r["id"])
    assert got == {("pypi", "1.0"): {"fixed", "again", "last"}, ("pypi", "1.4"): {"open", "fixed", "last", "listed", "two"}, ("pypi", "1.5"): {"open", "two"}, ("pypi", "2.0"): {"open", "again"}, ("npm", "1.10.0"): {"npm"}}


def test_command_line_from_stored_documents(spark, tmp_path, capsys):
    from larkspur import cli

    put = lambda path, text: ((tmp_path / path).parent.mkdir(parents=True, exist_ok=True), (tmp_path / path).write_text(text))
    put("shop/requirements.txt", "Web>=1\nghost\n")
    put("shop/app.py", "import web\nweb.load(1)\n")
    release = [{"filename": "x.tar.gz", "packagetype": "sdist"}]
    put("reg/pypi/web.json", json.dumps({"info": {"name": "Web", "version": "1.1", "requires_dist": ["Deep (>=1); python_version > '3'", "tests; extra == 't'"]}, "releases": {"1.0": release, "1.1": release}}))
    put("reg/pypi/deep.json", json.dumps({"info": {"name": "deep", "version": "2.0", "requires_dist": None}, "releases": {"2.0": release}}))
    put("reg/npm/left.json", json.dumps({"name": "left", "dist-tags": {"latest": "1.0.0"}, "versions": {"1.0.0": {"dependencies": {"b": "^1"}}}}))
    advisory = lambda i, n, fixed, score: json.dumps({"id": i, "severity": [{"score": score}], "affected": [{"package": {"name": n, "ecosystem": "PyPI"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": fixed}]}], "ecosystem_specific": {"imports": [f"{n}.load"]}}]})
    put("adv/1.json", advisory("A1", "web", "1.2", "9.0"))
    put("adv/2.json", advisory("A2", "deep", "3.0", "8.0"))
    put("adv/3.json", advisory("A3", "web", "1.1", "9.9"))
    assert cli.main(["scan-tree", str(tmp_path / "shop"), "--registry", str(tmp_path / "reg"), "--advisories", str(tmp_path / "adv"), "--report", str(tmp_path / "r.html")], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["web\t1.1\tA1\treachable\t9.0\t1.2", "deep\t2.0\tA2\tnot_imported\t0.8\t3.0", "warning\tUnresolved: ghost"]
    assert "web.load" in (tmp_path / "r.html").read_text()
