import random

import pytest
from pyspark.sql import functions as F

from larkspur.core import cut
from larkspur.sources import call_graph as G

FILES = {
    "pkg/__init__.py": "from .util import run\n",
    "pkg/app.py": "from .util import run\nfrom . import util as u\nimport pkg.util, numpy as np\nfrom json import dumps\ndef main():\n    run()\n    u.A.run()\n    pkg.util.run()\n    np.random.seed(1)\n    dumps(1)\n    f()\n    len(x)\n    self.go2()\n    u.missing()\ndef f():\n    def inner():\n        main()\n    inner()\n",
    "pkg/util.py": "def run():\n    B.run()\n    A.f()\nclass A:\n    def f(self):\n        self.f()\n    def run(self):\n        pass\nclass B:\n    def run(self):\n        f()\n",
    "pkg/sub/core.py": "from ..util import A\nfrom . import other\nfrom .other import go as g\ndef go():\n    A.run()\n    g()\n    other.go()\n    other()\n",
    "pkg/sub/other.py": "from ...nowhere import x\ndef go():\n    x.y()\n",
    "bad.py": "def (",
}


def graph(spark, files, project=""):
    rows = [(project, p, s) for p, s in files.items()]
    found = cut(G.facts(spark.createDataFrame(rows, "project string, path string, source string")))
    return found, cut(G.nodes(found)), cut(G.edges(found))


def test_longest_prefix_relative_imports_and_class_members(spark):
    _, scopes, links = graph(spark, FILES)
    got = {(r["src"], r["dst"]) for r in links.collect()}
    m = "::<module>"
    assert got == {
        (f"pkg{m}", f"pkg.util{m}"), (f"pkg.app{m}", f"pkg.util{m}"), (f"pkg.app{m}", f"pkg{m}"), (f"pkg.sub.core{m}", f"pkg.util{m}"), (f"pkg.sub.core{m}", f"pkg.sub.other{m}"),
        ("pkg.app::main", "pkg.util::run"), ("pkg.app::main", "pkg.util::A.run"), ("pkg.app::main", "ext:numpy.random.seed"), ("pkg.app::main", "ext:json.dumps"), ("pkg.app::main", "pkg.app::f"),
        ("pkg.app::f", "pkg.app::inner"), ("pkg.app::inner", "pkg.app::main"), ("pkg.util::run", "pkg.util::B.run"), ("pkg.util::run", "pkg.util::A.f"),
        ("pkg.sub.core::go", "pkg.util::A.run"), ("pkg.sub.core::go", "pkg.sub.other::go"), ("pkg.sub.core::go", f"pkg.sub.other{m}"), ("pkg.sub.other::go", "ext:nowhere.x.y"),
    }
    assert {r["node"] for r in scopes.where("module = 'bad'").collect()} == set()
    assert {r["line"] for r in links.where("dst = 'pkg.util::run'").collect()} == {6}


@pytest.mark.parametrize(
    ("package", "level", "name", "want"),
    [("a.b", 0, "x.y", "x.y"), ("a.b", 1, "x", "a.b.x"), ("a.b", 2, "x", "a.x"), ("a.b", 3, "x", "x"), ("a.b", 9, "x", "x"), ("a", 1, "", "a"), ("", 1, "x", "x")],
)
def test_relative_names(package, level, name, want):
    assert G.absolute(package, level, name) == want


def test_module_names():
    assert G.module_of("a/b/__init__.py") == ("a.b", "a.b") and G.module_of("a/b.py") == ("a.b", "a") and G.module_of("c.py") == ("c", "") and G.module_of("__init__.py") == ("__init__", "")


def brute(scopes, links, wanted):
    """{(project, id): (proven, [node, ...])} by breadth-first search with lists."""
    out = {}
    for project, i, roots, symbols in wanted:
        own = {s["node"]: s for s in scopes if s["project"] == project}
        mine = [e for e in links if e["project"] == project]
        imported = {e["dst"].split("::")[0] for e in mine if e["kind"] == "import" and e["src"] != e["dst"]}
        modules = {s["module"] for s in own.values()}
        entry = (modules - imported) or modules
        for proven in (True, False):
            start = [n for n, s in own.items() if s["module"] in entry and (s["scope"] == "<module>" or not proven and not any(p.startswith("_") for p in s["scope"].split(".")))]
            parent, level, best = {n: None for n in start}, sorted(start), []
            while level and not best:
                nxt = {}
                for n in level:
                    for e in mine:
                        if e["src"] == n and e["dst"].startswith("ext:"):
                            t = e["dst"][4:].lower()
                            if t.split(".")[0] in [r.lower() for r in roots] and (not symbols or t.split(".")[-1] in [s.split(".")[-1].lower() for s in symbols]):
                                best.append((n, e["line"], e["dst"][4:]))
                    follow = [e["dst"] for e in mine if e["src"] == n and e["kind"] == "call" and e["dst"] in own] + [e["dst"] for e in mine if e["kind"] == "import" and e["src"].split("::")[0] == own[n]["module"]]
                    for d in follow:
                        if d not in parent:
                            nxt[d] = min(nxt.get(d, n), n)
                parent.update(nxt)
                level = sorted(nxt)
            if best:
                n, _, target = min(best)
                path = [n]
                while parent[path[-1]] is not None:
                    path.append(parent[path[-1]])
                out[project, i] = (proven, target, list(reversed(path)))
                break
    return out


def random_project(r):
    modules = [f"m{i}" for i in range(r.randrange(2, 7))]
    files = {}
    for i, m in enumerate(modules):
        lines = [f"import {o}" for o in modules if o != m and r.random() < 0.3] + (["import yaml, json"] if r.random() < 0.6 else [])
        for f in range(r.randrange(4)):
            lines.append(f"def {'_' if r.random() < 0.3 else ''}f{f}():")
            calls = [f"{r.choice(modules)}.f{r.randrange(4)}()", f"f{r.randrange(4)}()", "yaml.load(1)" if r.random() < 0.3 else "pass", "json.dumps(2)" if r.random() < 0.3 else "pass"]
            lines += [f"    {c}" for c in r.sample(calls, 2)]
        if r.random() < 0.3:
            lines.append(f"f{r.randrange(4)}()")
        files[f"{m}.py"] = "\n".join(lines)
    return files


def test_search_equals_brute_force_on_random_projects(spark):
    r = random.Random(11)
    rows = [(f"p{k}", p, s) for k in range(25) for p, s in random_project(r).items()]
    found = cut(G.facts(spark.createDataFrame(rows, "project string, path string, source string")))
    scopes, links = cut(G.nodes(found)), cut(G.edges(found))
    wanted = [(f"p{k}", i, roots, symbols) for k in range(25) for i, (roots, symbols) in enumerate([(["PyYAML", "yaml"], ["yaml.load"]), (["json"], ["loads", "dumps"]), (["json"], []), (["json"], ["loads"])])]
    got = {}
    for x in G.search(scopes, links, spark.createDataFrame(wanted, "project string, id int, roots array<string>, symbols array<string>")).collect():
        chain = [s["caller"] for s in x["steps"]]
        assert [s["callee"] for s in x["steps"]][:-1] == chain[1:] and x["steps"][-1]["callee"] == x["symbol"]
        got[x["project"], x["id"]] = (x["proven"], x["symbol"], chain)
    pretty = lambda n: n.removesuffix("::<module>").replace("::", ".")
    want = {k: (p, t, [pretty(n) for n in path]) for k, (p, t, path) in brute(scopes.collect(), links.collect(), wanted).items()}
    assert got == want and len({v[0] for v in got.values()}) == 2


def test_verdicts(spark):
    files = {"app.py": "import yaml, jinja2\nfrom helpers import load_it\ndef main():\n    load_it()\nif __name__ == '__main__':\n    main()\n", "helpers.py": "import yaml\ndef load_it():\n    return yaml.load(open('x'))\n"}
    found, _, _ = graph(spark, files, "one")
    wanted = [("one", "a", ["pyyaml", "yaml"], ["yaml.load"]), ("one", "b", ["jinja2"], ["Environment"]), ("one", "c", ["flask"], ["Flask"]), ("one", "d", ["jinja2"], []), ("none", "e", ["x"], ["y"])]
    got = {r["id"]: r for r in G.verdicts(found, spark.createDataFrame(wanted, "project string, id string, roots array<string>, symbols array<string>")).collect()}
    assert {i: (r["verdict"], r["confidence"], r["reachable"]) for i, r in got.items()} == {
        "a": ("reachable", "high", True), "b": ("symbol_not_called", "medium", False), "c": ("not_imported", "high", False), "d": ("assumed_reachable", "low", True), "e": ("not_analysed", "none", True),
    }
    assert [(s["caller"], s["callee"], s["file"], s["line"]) for s in got["a"]["steps"]] == [("app", "app.main", "app.py", 6), ("app.main", "helpers.load_it", "app.py", 4), ("helpers.load_it", "yaml.load", "helpers.py", 3)]
    assert got["a"]["proven"] and got["b"]["imported_by"] == 1


def test_no_files(spark):
    found = G.facts(spark.createDataFrame([], "path string, source string"))
    assert G.edges(found).count() == 0 and G.nodes(found).agg(F.count(F.lit(1))).first()[0] == 0


def test_edges_gather_no_table_at_the_driver(spark):
    links = G.edges(graph(spark, FILES)[0])
    assert links.count() and "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that the module writes."""
    seen = []

    def write(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(G, "cut", write)
    return seen


def test_search_gathers_no_table_at_the_driver(spark, plans):
    found = graph(spark, FILES)[0]
    wanted = spark.createDataFrame([("", "a", ["json"], ["dumps"]), ("", "b", ["nowhere"], ["y"])], "project string, id string, roots array<string>, symbols array<string>")
    judged = G.verdicts(found, cut(wanted))
    assert {r["verdict"] for r in judged.collect()} == {"reachable"}
    plans.append(judged._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)
