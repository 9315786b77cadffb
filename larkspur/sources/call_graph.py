"""Call graphs of Python projects: scopes, imports, resolved calls, and the search for calls of advisories' symbols.

Sources are parsed, never run. A task turns a file into scopes, bindings of imported
names (absolute, relative ones resolved against the file's package) and calls. Which
module a dotted name lies in is the longest of its prefixes that is a module, found by
an equality join of exploded prefixes with the modules of the project. Projects are
worked on together; every table carries its project, null counting as the empty name.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import cut, in_batches, merging

MODULE = "<module>"
EXTERNAL = "ext:"
SCHEMA = "project string, path string, module string, kind string, scope string, target string, line int"


def module_of(path: str) -> tuple[str, str]:
    """(module, package) of a file: relative imports start from the package."""
    parts = path.removesuffix(".py").split("/")
    if parts[-1] == "__init__" and len(parts) > 1:
        return ".".join(parts[:-1]), ".".join(parts[:-1])
    return ".".join(parts), ".".join(parts[:-1])


def absolute(package: str, level: int, name: str) -> str:
    """A dotted name that an import of `level` dots means; beyond the topmost package the dots are as many as there are."""
    if not level:
        return name
    parts = package.split(".") if package else []
    return ".".join([*parts[: max(0, len(parts) - level + 1)], *filter(None, [name])])


class Scopes(ast.NodeVisitor):
    """Scopes are the module and its functions, those of classes with the names of the classes; a function within another has its own name."""

    def __init__(self, package: str) -> None:
        self.package = package
        self.names: dict[str, str] = {}
        self.scopes: list[tuple[str, int]] = [(MODULE, 1)]
        self.calls: list[tuple[str, str, int]] = []
        self.classes: list[str] = []
        self.within = [MODULE]

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            first = a.name.split(".")[0]
            self.names[a.asname or first] = a.name if a.asname else first

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = absolute(self.package, node.level, node.module or "")
        for a in node.names:
            self.names[a.asname or a.name] = f"{base}.{a.name}" if base else a.name

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.classes.append(node.name)
        self.generic_visit(node)
        self.classes.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        scope = ".".join([*self.classes, node.name])
        self.scopes.append((scope, node.lineno))
        self.within.append(scope)
        self.generic_visit(node)
        self.within.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_Call(self, node: ast.Call) -> None:
        tail, called = [], node.func
        while isinstance(called, ast.Attribute):
            tail.append(called.attr)
            called = called.value
        if isinstance(called, ast.Name):
            self.calls.append((self.within[-1], ".".join([called.id, *reversed(tail)]), node.lineno))
        self.generic_visit(node)


def analyse(path: str, source: str | None) -> list[tuple]:
    """(module, kind, scope, target, line) of one file.

    Kinds: scope; name, for what an import binds; call, for calls through such a name; own, for calls of the file's
    own functions; failed, for a file that does not parse. Calls of anything else are no edges: they are of
    builtins, of locals, or of attributes of values.
    """
    module, package = module_of(path)
    try:
        found = Scopes(package)
        found.visit(ast.parse(source or ""))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(module, "failed", MODULE, None, 0)]
    rows = [(module, "scope", scope, None, line) for scope, line in found.scopes]
    rows += [(module, "name", MODULE, target, 0) for target in sorted(set(found.names.values()))]
    own = {scope for scope, _ in found.scopes}
    for scope, raw, line in found.calls:
        head, _, tail = raw.partition(".")
        if head in found.names:
            rows.append((module, "call", scope, f"{found.names[head]}.{tail}" if tail else found.names[head], line))
        elif raw in own:
            rows.append((module, "own", scope, raw, line))
    return rows


def facts(files: DataFrame) -> DataFrame:
    """files: path and source, and project where there is more than one. Paths are relative to the project."""
    project = F.coalesce(F.col("project").cast("string"), F.lit("")) if "project" in files.columns else F.lit("")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((g, p, *r) for g, p, s in zip(batch["project"], batch["path"], batch["source"], strict=True) for r in analyse(p, s))
            yield from in_batches(rows, [c.split()[0] for c in SCHEMA.split(", ")])

    return files.select(project.alias("project"), "path", "source").where("endswith(path, '.py')").mapInPandas(work, SCHEMA)


def node(module: Column, scope: Column) -> Column:
    return F.concat_ws("::", module, scope)


def nodes(found: DataFrame) -> DataFrame:
    """project, node, module, scope, path, line: every scope once, at its first line."""
    scopes = found.where("kind = 'scope'").groupBy("project", "module", "scope").agg(F.min(F.struct("path", "line")).alias("at"))
    return scopes.select("project", node(F.col("module"), F.col("scope")).alias("node"), "module", "scope", "at.path", "at.line")


def homes(found: DataFrame) -> DataFrame:
    """project, target, home: the longest prefix of each dotted name that is a module of its project; names without one are left out."""
    modules = found.where("kind = 'scope'").select("project", F.col("module").alias("home")).distinct()
    parts = F.split("target", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    named = found.where("kind IN ('name', 'call')").select("project", "target").distinct()
    return named.select("project", "target", F.explode(prefixes).alias("home")).join(merging(modules), ["project", "home"]).groupBy("project", "target").agg(F.max_by("home", F.length("home")).alias("home"))


def edges(found: DataFrame) -> DataFrame:
    """project, src, dst, line, kind: imports between modules, calls of scopes, and calls of names outside (dst begins with ext:).

    found is read several times. An edge that is there several times has its first line. A call that leads
    into a module of the project, but to no scope of it, is none.
    """
    home = homes(found)
    src = node(F.col("module"), F.col("scope"))
    imports = found.where("kind = 'name'").join(merging(home), ["project", "target"]).select("project", src.alias("src"), node(F.col("home"), F.lit(MODULE)).alias("dst"), "line", F.lit("import").alias("kind"))
    met = found.where("kind = 'call'").join(merging(home), ["project", "target"], "left")
    inside = F.col("home").isNotNull()
    scope = F.when(F.col("target") == F.col("home"), F.lit(MODULE)).otherwise(F.expr("substr(target, length(home) + 2)"))
    calls = met.select("project", src.alias("src"), F.when(inside, node(F.col("home"), scope)).otherwise(F.concat(F.lit(EXTERNAL), "target")).alias("dst"), "line", F.lit("call").alias("kind"))
    own = found.where("kind = 'own'").select("project", src.alias("src"), node(F.col("module"), F.col("target")).alias("dst"), "line", F.lit("call").alias("kind"))
    there = nodes(found).select("project", F.col("node").alias("dst"))
    outside = F.startswith("dst", F.lit(EXTERNAL))
    linked = calls.where(~outside).join(merging(there), ["project", "dst"], "left_semi").select("project", "src", "dst", "line", "kind")
    every = imports.unionByName(own).unionByName(linked).unionByName(calls.where(outside))
    return every.groupBy("project", "src", "dst", "kind").agg(F.min("line").alias("line")).select("project", "src", "dst", "line", "kind")


def entry_modules(scopes: DataFrame, links: DataFrame) -> DataFrame:
    """project, module: modules that no other module of the project imports; all of a project's if each one is imported."""
    modules = scopes.select("project", "module").distinct()
    imported = links.where("kind = 'import' AND src <> dst").select("project", F.substring_index("dst", "::", 1).alias("module")).distinct()
    free = modules.join(merging(imported), ["project", "module"], "left_anti")
    closed = modules.join(merging(free.select("project").distinct()), "project", "left_anti")
    return free.unionByName(closed)


def seeds(scopes: DataFrame, links: DataFrame, public: bool) -> DataFrame:
    """project, node: module scopes of the entry modules and, with `public`, their functions whose names do not start with _, nor those of their classes."""
    entry = scopes.join(merging(entry_modules(scopes, links)), ["project", "module"], "left_semi")
    private = F.exists(F.split("scope", r"\."), lambda part: F.startswith(part, F.lit("_")))
    return entry.where((F.col("scope") == MODULE) | (F.lit(public) & ~private)).select("project", "node")


def reach(scopes: DataFrame, links: DataFrame, start: DataFrame) -> list[DataFrame]:
    """Level by level (project, node, depth, parent, line): what the start reaches, each scope with one parent and the line that leads to it.

    A scope leads to what it calls and, as what a module imports is run, to the module scopes of its module's
    imports. Of several parents on the level before, the least name is kept. scopes, links: written tables.
    """
    calls = links.where(f"kind = 'call' AND NOT startswith(dst, '{EXTERNAL}')").select("project", "src", "dst", "line")
    imports = links.where("kind = 'import'").select("project", F.substring_index("src", "::", 1).alias("module"), "dst")
    where = scopes.select("project", "node", "module", F.col("line").alias("own_line"))
    start = start.distinct().join(merging(where), ["project", "node"])
    frontier = cut(start.select("project", "node", "module", "own_line", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("line")))
    levels, seen = [frontier], frontier.select("project", "node")
    while True:
        called = frontier.join(merging(calls), (frontier["project"] == calls["project"]) & (frontier["node"] == calls["src"])).select(frontier["project"], calls["dst"], frontier["node"].alias("parent"), calls["line"])
        # one scope stands for all of its module: what it imports is the same
        opened = frontier.groupBy("project", "module").agg(F.min(F.struct("node", "own_line")).alias("first"))
        brought = opened.join(merging(imports), ["project", "module"]).select("project", "dst", F.col("first.node").alias("parent"), F.col("first.own_line").alias("line"))
        new = called.unionByName(brought).groupBy("project", F.col("dst").alias("node")).agg(F.min(F.struct("parent", "line")).alias("by"))
        new = new.join(merging(seen), ["project", "node"], "left_anti").join(merging(where), ["project", "node"])
        frontier = cut(new.select("project", "node", "module", "own_line", F.lit(len(levels)).alias("depth"), "by.parent", "by.line"))
        if frontier.isEmpty():
            return levels
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("project", "node"))
        if len(levels) % 8 == 0:
            seen = cut(seen)


def _keys(wanted: DataFrame) -> DataFrame:
    """project, id, root, key: what an external call must have; * where an advisory names no symbol."""
    symbols = F.filter(F.col("symbols"), lambda s: F.length(s) > 0)
    keys = F.flatten(F.transform(symbols, lambda s: F.array(F.concat(F.lit("t:"), F.lower(F.element_at(F.split(s, r"\."), -1))), F.concat(F.lit("f:"), F.lower(s)))))
    keys = F.when(F.coalesce(F.size(symbols), F.lit(0)) <= 0, F.array(F.lit("*"))).otherwise(F.array_distinct(keys))
    roots = F.array_distinct(F.transform("roots", F.lower))
    return wanted.select("project", "id", F.explode(roots).alias("root"), keys.alias("keys")).select("project", "id", "root", F.explode("keys").alias("key"))


def _hits(levels: list[DataFrame], links: DataFrame, keys: DataFrame) -> DataFrame:
    """project, id, depth, src, line, target: for each advisory the nearest call of its package's symbols, the least by name and line."""
    outside = links.where(f"startswith(dst, '{EXTERNAL}')").select("project", "src", F.expr(f"substr(dst, {len(EXTERNAL) + 1})").alias("target"), F.col("line").alias("at"))
    low = F.lower("target")
    offered = F.array(F.lit("*"), F.concat(F.lit("t:"), F.element_at(F.split(low, r"\."), -1)), F.concat(F.lit("f:"), low))
    calls = outside.select("project", "src", "target", "at", F.split(low, r"\.")[0].alias("root"), F.explode(offered).alias("key")).join(merging(keys), ["project", "root", "key"])
    reached = _all([x.select("project", F.col("node").alias("src"), "depth") for x in levels])
    best = calls.join(merging(reached), ["project", "src"]).groupBy("project", "id").agg(F.min(F.struct("depth", "src", "at", "target")).alias("m"))
    return best.select("project", "id", "m.depth", "m.src", F.col("m.at").alias("line"), "m.target")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def pretty(name: Column) -> Column:
    """module.scope, or the module alone for its own scope."""
    module, scope = F.substring_index(name, "::", 1), F.substring_index(name, "::", -1)
    return F.when(scope == MODULE, module).otherwise(F.concat(module, F.lit("."), scope))


def _paths(levels: list[DataFrame], hits: DataFrame, scopes: DataFrame) -> DataFrame:
    """project, id, symbol, steps: each hit's chain of calls from its seed, followed back from parent to parent.

    A hit is taken up at the level of its scope; each level is joined once.
    """
    hits = cut(hits)
    steps = [hits.select("project", "id", (F.col("depth") + 1).alias("step"), F.col("src").alias("caller"), F.col("target").alias("callee"), "line")]
    going = None
    for depth in range(len(levels) - 1, 0, -1):
        here = hits.where(F.col("depth") == depth).select("project", "id", F.col("src").alias("node"))
        going = here if going is None else here.unionByName(going)
        back = cut(going.join(merging(levels[depth].select("project", "node", "parent", "line")), ["project", "node"]))
        steps.append(back.select("project", "id", F.lit(depth).alias("step"), F.col("parent").alias("caller"), pretty(F.col("node")).alias("callee"), "line"))
        going = back.select("project", "id", F.col("parent").alias("node"))
    where = scopes.select("project", F.col("node").alias("caller"), F.col("path").alias("file"))
    named = _all(steps).join(merging(where), ["project", "caller"]).withColumn("caller", pretty(F.col("caller")))
    lined = named.groupBy("project", "id").agg(F.sort_array(F.collect_list(F.struct("step", "caller", "callee", "file", "line"))).alias("steps"))
    return hits.select("project", "id", F.col("target").alias("symbol")).join(merging(lined), ["project", "id"])


def search(scopes: DataFrame, links: DataFrame, wanted: DataFrame) -> DataFrame:
    """project, id, symbol, proven, steps: a reachable call of each advisory's package and symbols, with its shortest path.

    wanted: project, id, roots (the names that the package is imported by) and symbols (none: any call). The search starts
    from what runs by itself, the entry modules' own code; only for what that leaves it starts from their public
    functions too, which are assumed to be called (`proven` is false). Advisories without a call are left out.
    scopes, links: nodes() and edges(), written.
    """
    keys = cut(_keys(wanted))
    levels = reach(scopes, links, seeds(scopes, links, False))
    first = cut(_paths(levels, _hits(levels, links, keys), scopes).withColumn("proven", F.lit(True)))
    rest = keys.join(merging(first.select("project", "id")), ["project", "id"], "left_anti")
    if rest.isEmpty():
        return first
    levels = reach(scopes, links, seeds(scopes, links, True))
    return first.unionByName(_paths(levels, _hits(levels, links, rest), scopes).withColumn("proven", F.lit(False)))


def verdicts(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with verdict, confidence, reachable, imported_by, symbol, proven and steps.

    not_analysed: the project has no source that parses; not_imported: no module imports the package; assumed_reachable:
    the advisory names no symbol; reachable: the search found a call; symbol_not_called. Uncertain ones count as reachable.
    """
    found = cut(found)
    scopes, links = cut(nodes(found)), cut(edges(found))
    analysed = scopes.select("project", F.lit(True).alias("seen")).distinct()
    outside = found.where("kind = 'name'").join(merging(homes(found)), ["project", "target"], "left_anti")
    imports = outside.select("project", F.lower(F.substring_index("target", ".", 1)).alias("root"), "module").distinct()
    roots = wanted.select("project", "id", F.explode(F.array_distinct(F.transform("roots", F.lower))).alias("root"))
    users = roots.join(merging(imports), ["project", "root"]).groupBy("project", "id").agg(F.count_distinct("module").alias("imported_by"))
    named = F.coalesce(F.size(F.filter("symbols", lambda s: F.length(s) > 0)), F.lit(0)) > 0
    calls = search(scopes, links, wanted.where(named))
    out = wanted.join(merging(analysed), "project", "left").join(merging(users), ["project", "id"], "left").join(merging(calls), ["project", "id"], "left")
    verdict = (
        F.when(F.col("seen").isNull(), "not_analysed")
        .when(F.col("imported_by").isNull(), "not_imported")
        .when(~named, "assumed_reachable")
        .when(F.col("symbol").isNotNull(), "reachable")
        .otherwise("symbol_not_called")
    )
    confidence = F.create_map(*[F.lit(x) for x in ("not_analysed", "none", "not_imported", "high", "assumed_reachable", "low", "reachable", "high", "symbol_not_called", "medium")])
    out = out.withColumn("verdict", verdict).withColumn("confidence", confidence[F.col("verdict")]).drop("seen")
    return out.withColumn("reachable", F.col("verdict").isin("not_analysed", "assumed_reachable", "reachable"))
