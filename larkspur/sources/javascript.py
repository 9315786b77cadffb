"""Facts of JavaScript sources from their syntax trees; sources are read, never run.

Calls, `new` expressions, member chains, arrays of strings and literals are found in the
tree. Names stand for what they are bound to where they are used: a module that is
required or imported, or a member of one; a parameter or a variable of the same name hides
it. A source that has no tree gives one row of kind parse_failed and all of it as one
literal, so that what its text shows still counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import in_batches
from ..functions import patterns as P
from ..functions import text as T
from .js_tree import Node, NotParsed, parse

SCHEMA = "path string, kind string, target string, line int, detail string"
_REQUIRE = r"""(?:require\s*\(\s*|import\s+(?:[^'"()]*?\s+from\s+)?|import\s*\(\s*)['"]([^'"]+)['"]"""
_FUNCTIONS = ("function", "declared")


class Scope:
    """What names stand for: a module or a member of one, or nothing known (None)."""

    def __init__(self, outer: Scope | None, function: bool):
        self.outer, self.function = outer, function
        self.names: dict[str, str | None] = {}

    def holder(self, name: str) -> Scope | None:
        scope: Scope | None = self
        while scope and name not in scope.names:
            scope = scope.outer
        return scope

    def hoisted(self) -> Scope:
        scope = self
        while not scope.function and scope.outer:
            scope = scope.outer
        return scope


def required(node: Node | None) -> str | None:
    """The module of require("...")."""
    if node and node.kind == "call" and node.kids[0].kind == "name" and node.kids[0].text == "require" and len(node.kids) > 1 and node.kids[1].kind == "string":
        return node.kids[1].text
    return None


def bound(pattern: Node, module: str | None = None) -> Iterator[tuple[str, str | None]]:
    """The names that a pattern binds, and what each stands for if a module is taken apart by it."""
    stack = [(pattern, module, True)]
    while stack:
        node, at, top = stack.pop()
        if node.kind == "name":
            yield node.text, at
        elif node.kind == "assign":
            stack.append((node.kids[0], at, top))
        elif node.kind == "property":
            stack.append((node.kids[-1], f"{at}.{node.text}" if at and top else None, False))
        elif node.kind in ("object", "array", "group", "sequence", "spread"):
            stack += [(k, at if node.kind in ("object", "spread") and top else None, top) for k in reversed(node.kids)]


class Facts:
    def __init__(self, source: str):
        self.rows: list[tuple] = []
        self.scopes: dict[int, Scope] = {}
        self.root = parse(source)
        self._bind()
        self._walk()

    def _bind(self) -> None:
        """Scopes with the names that they declare, then what declarations, assignments and imports make of them."""
        given: list[tuple[Scope, str, str]] = []
        stack = [(self.root, Scope(None, True))]
        while stack:
            node, scope = stack.pop()
            if node.kind in ("declared", "class") and node.text:
                scope.names.setdefault(node.text, None)
            if node.kind in (*_FUNCTIONS, "block", "program"):
                scope = Scope(scope, node.kind != "block")
                if node.kind == "function" and node.text:
                    scope.names.setdefault(node.text, None)
            self.scopes[id(node)] = scope
            if node.kind == "parameters":
                for k in node.kids:
                    scope.names.update((name, None) for name, _ in bound(k))
            elif node.kind == "declare":
                for one in node.kids:
                    module = required(one.kids[1]) if len(one.kids) > 1 else None
                    for name, target in bound(one.kids[0], module):
                        (scope.hoisted() if node.text == "var" else scope).names.setdefault(name, None)
                        if target:
                            given.append((scope, name, target))
            elif node.kind == "assign" and node.text == "=" and (module := required(node.kids[1])):
                given += [(scope, name, target) for name, target in bound(node.kids[0], module) if target]
            elif node.kind == "import":
                for one in node.kids[:-1]:
                    if one.kind == "bind":
                        scope.names[one.text] = f"{node.text}.{one.kids[0].text}" if one.kids and one.kids[0].text != "default" else node.text
                continue
            stack += [(k, scope) for k in reversed(node.kids)]
        for scope, name, target in given:
            (scope.holder(name) or scope.hoisted()).names[name] = target

    def name(self, node: Node, scope: Scope) -> str | None:
        """The dotted name of an expression, resolved; a computed member's name is not known."""
        tail = []
        while node.kind in ("member", "index"):
            tail.append(node.text if node.kind == "member" else "<computed>")
            node = node.kids[0]
        if node.kind != "name":
            return None
        holder = scope.holder(node.text)
        return ".".join([(holder and holder.names[node.text]) or node.text, *reversed(tail)])

    def _decodes(self, call: Node) -> bool:
        stack = list(call.kids[1:])
        while stack:
            node = stack.pop()
            if node.kind == "call":
                name = self.name(node.kids[0], self.scopes[id(node)]) or ""
                if name.rsplit(".", 1)[-1] in P.JS_DECODE_CALLS or name in ("Buffer.from", "String.fromCharCode"):
                    return True
            stack += node.kids
        return False

    def _walk(self) -> None:
        stack = [(self.root, False)]
        while stack:
            node, within = stack.pop()  # within: as the object of a longer chain
            scope = self.scopes.get(id(node))
            if node.kind in ("string", "piece") and node.text:
                self.rows.append(("literal", None, node.line, node.text))
            elif node.kind == "array" and len(node.kids) >= 25 and all(k.kind == "string" for k in node.kids):
                self.rows.append(("array", None, node.line, str(len(node.kids))))
            elif node.kind in ("member", "index") and scope and not within:
                name = self.name(node, scope)
                if name and name.startswith("process.env"):
                    self.rows.append(("env", "whole" if name == "process.env" else "one", node.line, ""))
            elif node.kind in ("call", "new") and scope:
                self._call(node, scope)
            for i, k in reversed(list(enumerate(node.kids))):
                stack.append((k, node.kind in ("member", "index") and i == 0))

    def _call(self, node: Node, scope: Scope) -> None:
        name = self.name(node.kids[0], scope)
        if name is None:
            return
        first = node.kids[1] if len(node.kids) > 1 else None
        marks = {
            "text": first is not None and first.kind == "string" and first.text != "",
            "computed": first is not None and first.kind not in ("string", "number", "regex", "constant"),
            "decoded": self._decodes(node),
            "direct": node.kids[0].kind == "name" and node.kids[0].text == "require",
        }
        self.rows.append((node.kind, name, node.line, ",".join(m for m, on in marks.items() if on)))


def analyse(source: str) -> list[tuple]:
    """(kind, target, line, detail) of one source."""
    source = source or ""
    try:
        return Facts(source).rows
    except (NotParsed, RecursionError):
        return [("parse_failed", None, 0, ""), ("literal", None, 0, source)]


def facts(files: DataFrame) -> DataFrame:
    """files: path, source."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((p, *r) for p, s in zip(batch["path"], batch["source"], strict=True) for r in analyse(s))
            yield from in_batches(rows, [c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "source").mapInPandas(work, SCHEMA)


def imports(files: DataFrame) -> DataFrame:
    """path, specifier, package: packages are null for relative paths and node: modules."""
    rows = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(_REQUIRE), 1))).alias("specifier"))
    return rows.withColumn("package", T.package_of_specifier(F.col("specifier")))


def code_signals(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """path, code, key, line: each code once for a file and key. found: the files' facts, if they exist already."""
    from ..operators.signals import literal_codes, once

    found = facts(files) if found is None else found
    name, line = F.col("target"), F.col("line").cast("string")
    parts = F.split(name, r"\.")
    base, root = F.element_at(parts, -1), parts[0]
    has = lambda mark: F.array_contains(F.split("detail", ","), mark)
    spawns = root.isin(P.JS_PROCESS_MODULES) & base.isin(P.JS_PROCESS_CALLS)
    rules = [
        ("DECODE_THEN_EXEC", line, (base == "eval") & has("decoded")),
        ("DYNAMIC_EVAL", F.lit("eval"), (base == "eval") & ~has("decoded")),
        ("DYNAMIC_EVAL", name, name.isin(P.JS_EVALUATORS)),
        ("DYNAMIC_EVAL", base, base.isin("setTimeout", "setInterval") & has("text")),
        ("PROCESS_SPAWN", name, spawns),
        ("SHELL_TRUE", name, spawns & base.isin("exec", "execSync")),
        ("NETWORK_ACCESS", name, (root.isin(P.JS_NETWORK_MODULES) & base.isin(P.JS_NETWORK_CALLS)) | root.isin(P.JS_HTTP_LIBRARIES)),
        ("NETWORK_ACCESS", F.lit("fetch"), (name == "XMLHttpRequest") | (base == "fetch")),
        ("DNS_EXFIL_PATTERN", name, (root == "dns") & has("computed")),
        ("DYNAMIC_IMPORT", F.lit("require"), has("direct") & has("computed")),
        ("HOST_RECON", name, root.isin(P.JS_RECON_MODULES) & base.isin(P.JS_RECON_CALLS)),
    ]
    made = [("DYNAMIC_EVAL", F.lit("new Function"), name == "Function"), ("NETWORK_ACCESS", name, name.isin("WebSocket", "net.Socket"))]
    env = [("ENV_ACCESS", F.lit("env"), F.lit(True)), ("ENV_BULK_HARVEST", F.lit("bulk"), name == "whole")]
    codes = lambda some: F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), key.alias("key"))) for code, key, c in some]))
    kind = F.col("kind")
    raised = F.when(kind == "call", codes(rules)).when(kind == "new", codes(made)).when(kind == "env", codes(env)).when(kind == "literal", literal_codes(F.col("detail")))
    single = once(found.select("path", "line", F.explode(raised).alias("c")))
    # What a whole file shows.
    evaluates = (kind == "call") & ((base == "eval") | name.isin(P.JS_EVALUATORS) | (base.isin("setTimeout", "setInterval") & has("text"))) | (kind == "new") & (name == "Function")
    whole = found.groupBy("path").agg(
        F.count_if((kind == "call") & (name == "String.fromCharCode")).alias("charcodes"),
        F.max(F.when(kind == "array", F.col("detail").cast("int"))).alias("strings"),
        F.coalesce(F.bool_or(evaluates), F.lit(False)).alias("evaluates"),
    )
    whole = whole.join(files.select("path", T.minified(F.col("source")).alias("minified")), "path")
    rest = codes([("CHARCODE_OBFUSCATION", F.lit(""), F.col("charcodes") >= 5), ("STRING_ARRAY_DECODER", F.lit(""), (F.col("strings") >= 40) & (F.col("minified") | F.col("evaluates")))])
    more = whole.select("path", F.explode(rest).alias("c")).select("path", "c.code", "c.key", F.lit(0).alias("line"))
    return single.unionByName(more)
