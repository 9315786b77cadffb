"""Facts of Python sources from their syntax trees; sources are parsed, never run.

One row per fact: calls with their resolved target and scope, imports, definitions,
reads of the environment, string literals and taint flows. A source that does not
parse gives one row of kind parse_failed; what its text shows still counts.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import in_batches
from ..functions import patterns as P

SCHEMA = "path string, kind string, target string, scope string, line int, detail string"
MODULE = "<module>"
#: Paths of setup scripts.
SETUP = r"(^|[/\x01])setup\.py$"
_SENSITIVE = [re.compile(p, re.IGNORECASE) for p in P.SENSITIVE_PATHS]
_SECRET = re.compile(P.SECRET_NAME, re.IGNORECASE)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Clients whose every call is network access.
CLIENTS = ("requests", "httpx")


def dotted(node: ast.AST, names: dict[str, str]) -> str | None:
    """The dotted name of an expression with its first part resolved, or None."""
    tail: list[str] = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([names.get(node.id, node.id), *reversed(tail)])
    return None


def _last(name: str | None) -> str:
    return (name or "").rsplit(".", 1)[-1]


def _networks(target: str | None) -> bool:
    return target is not None and (target in P.NETWORK_CALLS or target.split(".")[0] in CLIENTS)


def _texts(node: ast.AST) -> str:
    return "/".join(n.value for n in ast.walk(node) if isinstance(n, ast.Constant) and isinstance(n.value, str))


def _decodes(call: ast.Call, names: dict[str, str]) -> bool:
    """Whether something is decoded, or put together from numbers, within a call."""
    for inner in ast.walk(call):
        if isinstance(inner, ast.Call):
            target = dotted(inner.func, names)
            if target in P.DECODE_CALLS or _last(target) == "decode":
                return True
            if target in ("chr", "bytes", "bytearray") and inner.args and isinstance(inner.args[0], (ast.BinOp, ast.ListComp, ast.GeneratorExp)):
                return True
    return False


class Facts(ast.NodeVisitor):
    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.names: dict[str, str] = {}
        self.scope: list[str] = []
        #: Whether the statement of the module that is being visited defines a function or class.
        self.defines = False

    def add(self, kind: str, target: str | None, node: ast.AST, detail: str = "") -> None:
        self.rows.append((kind, target, ".".join(self.scope) or MODULE, getattr(node, "lineno", 0), detail))

    def visit_Module(self, node: ast.Module) -> None:
        for statement in node.body:
            self.defines = isinstance(statement, (*_FUNCTIONS, ast.ClassDef))
            self.visit(statement)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.add("import", a.name, node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        self.add("import", base, node)
        for a in node.names:
            self.names[a.asname or a.name] = f"{base}.{a.name}" if base else a.name

    def _defined(self, node: ast.AST) -> None:
        self.scope.append(node.name)
        if not isinstance(node, ast.ClassDef):
            self.add("function", node.name, node)
        self.generic_visit(node)
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _defined

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if dotted(node, self.names) in P.ENV_CALLS:
            self.add("env", "env", node)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        name = dotted(node.func, self.names)
        options = {k.arg: k.value for k in node.keywords if k.arg}
        constant = lambda x: getattr(x, "value", None) if isinstance(x, ast.Constant) else None
        mode = str(constant(options.get("mode")) or constant(node.args[1] if len(node.args) > 1 else None) or "")
        marks = {
            "decoded": _last(name) in P.EXEC_CALLS and _decodes(node, self.names),
            "shell": constant(options.get("shell")) is True,
            "computed": bool(node.args) and not isinstance(node.args[0], ast.Constant),
            "writes": name in P.WRITE_CALLS and any(c in mode for c in "wax+"),
            "module": not self.defines,
            "cmdclass": "cmdclass" in options,
        }
        self.add("call", name, node, ",".join(m for m, on in marks.items() if on))
        self.generic_visit(node)

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str) and node.value:
            self.add("literal", None, node, node.value)


class Reads:
    """What the expressions of a file read: secrets by themselves, and names."""

    def __init__(self, names: dict[str, str]):
        self.names = names
        self.seen: dict[int, list[tuple[int, str] | str]] = {}

    def secret(self, node: ast.AST) -> str | None:
        """The kind of secret that an expression itself reads."""
        if isinstance(node, ast.Subscript):
            key = node.slice if dotted(node.value, self.names) == "os.environ" else None
            return "env" if key is not None and _SECRET.search(_texts(key)) else None
        if not isinstance(node, ast.Call):
            return None
        if isinstance(node.func, ast.Attribute) and node.func.attr in ("read", "readline", "readlines"):
            if inner := self.secret(node.func.value):
                return inner
        target = dotted(node.func, self.names)
        first = _texts(node.args[0]) if node.args else ""
        if target in ("open", "io.open") and any(p.search(first) for p in _SENSITIVE):
            return "file"
        if target in ("os.getenv", "os.environ.get") and _SECRET.search(first):
            return "env"
        return None

    def of(self, expression: ast.AST) -> list[tuple[int, str] | str]:
        """(line, kind) of secrets and names, in the order of a walk; worked out once for an expression."""
        if id(expression) not in self.seen:
            found: list[tuple[int, str] | str] = []
            for n in ast.walk(expression):
                if kind := self.secret(n):
                    found.append((n.lineno, kind))
                elif isinstance(n, ast.Name):
                    found.append(n.id)
            self.seen[id(expression)] = found
        return self.seen[id(expression)]


def _statements(body: Iterable[ast.stmt]) -> Iterator[ast.stmt]:
    """The statements of a scope in source order; functions in it are listed, but not their bodies."""
    for statement in body:
        yield statement
        if not isinstance(statement, _FUNCTIONS):
            for name in ("body", "orelse", "finalbody"):
                yield from _statements(getattr(statement, name, None) or [])
            for handler in getattr(statement, "handlers", []):
                yield from _statements(handler.body)


def _bindings(statement: ast.stmt) -> Iterator[tuple[ast.AST, str]]:
    """(value, plain name) that a statement binds."""
    if isinstance(statement, ast.Assign):
        pairs = [(statement.value, t) for t in statement.targets]
    elif isinstance(statement, (ast.AnnAssign, ast.AugAssign)):
        pairs = [(statement.value, statement.target)]
    elif isinstance(statement, (ast.With, ast.AsyncWith)):
        pairs = [(i.context_expr, i.optional_vars) for i in statement.items]
    else:
        return
    for value, target in pairs:
        if value is not None and isinstance(target, ast.Name):
            yield value, target.id


def flows(tree: ast.Module, names: dict[str, str]) -> list[tuple[int, str, int, str, str]]:
    """(source line, its kind, sink line, sink, scope): secrets that a scope binds to a name and that reach a network call in it.

    Which bindings feed which names is a small graph; it is followed from the names
    bound to secrets, in source order, until nothing is added. A call gives one flow,
    and so do calls of one line for the same source line.
    """
    reads = Reads(names)
    out: list[tuple[int, str, int, str, str]] = []
    scopes = [(MODULE, tree.body), *((n.name, n.body) for n in ast.walk(tree) if isinstance(n, _FUNCTIONS))]
    for scope, body in scopes:
        statements = list(_statements(body))
        bound = [(name, reads.of(value)) for st in statements for value, name in _bindings(st)]
        origin: dict[str, tuple[int, str]] = {}

        def first(found: list, origin: dict = origin) -> tuple[int, str] | None:
            return next((x if isinstance(x, tuple) else origin[x] for x in found if isinstance(x, tuple) or x in origin), None)

        waiting = bound
        while waiting:
            left = []
            for name, found in waiting:
                if name not in origin:
                    if come := first(found):
                        origin[name] = come
                    else:
                        left.append((name, found))
            if len(left) == len(waiting):
                break
            waiting = left
        if not origin:
            continue
        calls = {id(n): n for st in statements for n in ast.walk(st) if isinstance(n, ast.Call) and _networks(dotted(n.func, names))}
        seen = set()
        for call in calls.values():
            come = next(filter(None, (first(reads.of(a)) for a in [*call.args, *(k.value for k in call.keywords)])), None)
            if come and (come[0], call.lineno) not in seen:
                seen.add((come[0], call.lineno))
                out.append((*come, call.lineno, dotted(call.func, names), scope))
    return sorted(out)


def analyse(source: str) -> list[tuple]:
    """(kind, target, scope, line, detail) of one source."""
    try:
        tree = ast.parse(source or "")
        found = Facts()
        found.visit(tree)
        taints = flows(tree, found.names)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [("parse_failed", None, MODULE, 0, "")]
    return found.rows + [("flow", sink, scope, line, f"{kind}@{at}") for at, kind, line, sink, scope in taints]


def facts(files: DataFrame) -> DataFrame:
    """files: path, source."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((p, *r) for p, s in zip(batch["path"], batch["source"], strict=True) for r in analyse(s))
            yield from in_batches(rows, [c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "source").mapInPandas(work, SCHEMA)


def code_signals(found: DataFrame) -> DataFrame:
    """path, code, key, line: signals of calls, flows and literals, each once for a path, code and key.

    Calls of one function count once, so do literals that match one pattern; found: rows of facts().
    """
    from ..operators.signals import literal_codes, once

    target, line = F.col("target"), F.col("line").cast("string")
    base = F.element_at(F.split(target, r"\."), -1)
    has = lambda mark: F.array_contains(F.split("detail", ","), mark)
    network = target.isin(P.NETWORK_CALLS) | F.split(target, r"\.")[0].isin(*CLIENTS)
    executes = base.isin(P.EXEC_CALLS)
    setup = F.col("path").rlike(SETUP)
    names_setup = F.endswith(target, F.lit("setup"))
    risky = target.isin(P.PROCESS_CALLS + P.NETWORK_CALLS + P.DECODE_CALLS) | executes
    rules = [
        ("DECODE_THEN_EXEC", line, executes & has("decoded")),
        ("DYNAMIC_EVAL", base, executes & ~has("decoded")),
        ("PROCESS_SPAWN", target, target.isin(P.PROCESS_CALLS)),
        ("SHELL_TRUE", target, target.isin(P.PROCESS_CALLS) & has("shell")),
        ("NETWORK_ACCESS", target, network),
        ("ENV_ACCESS", F.lit("env"), target.isin(P.ENV_CALLS) | F.endswith(target, F.lit("getenv"))),
        ("DYNAMIC_IMPORT", target, target.isin(P.IMPORT_CALLS) & has("computed")),
        ("SETUP_PY_SIDE_EFFECTS", line, setup & risky & ~names_setup & has("module")),
        ("SETUP_PY_SIDE_EFFECTS", F.lit("cmdclass"), setup & names_setup & has("cmdclass")),
    ]
    calls = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), key.alias("key"))) for code, key, c in rules]))
    one = lambda code, key: F.array(F.struct(F.lit(code).alias("code"), key.alias("key")))
    kind = F.col("kind")
    raised = (
        F.when(kind == "call", calls)
        .when(kind == "env", one("ENV_ACCESS", F.lit("env")))
        .when(kind == "flow", one("CONFIRMED_CREDENTIAL_EXFILTRATION", F.concat_ws(":", "scope", "detail", line)))
        .when(kind == "literal", literal_codes(F.col("detail"), http=True))
    )
    return once(found.select("path", "line", F.explode(raised).alias("c")))


def importing_modules(found: DataFrame, packages: DataFrame) -> DataFrame:
    """package, path: the files that import a package, by its own name, with - for _ or _ for -, or by a name that it provides.

    packages: package, aliases (an array). Names are compared in lower case, by the first part of what is imported.
    """
    own = F.lower("package")
    names = F.array_distinct(F.concat(F.array(own, F.replace(own, F.lit("-"), F.lit("_")), F.replace(own, F.lit("_"), F.lit("-"))), F.transform("aliases", F.lower)))
    wanted = packages.select("package", F.explode(names).alias("name")).distinct()
    imports = found.where("kind = 'import' AND NOT startswith(target, '.')").select("path", F.lower(F.substring_index("target", ".", 1)).alias("name")).distinct()
    return imports.join(wanted, "name").select("package", "path").distinct()
