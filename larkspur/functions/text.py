"""Text measures as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

ADDRESS = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
BASE64_RUN = r"[A-Za-z0-9+/]{60,}={0,2}"


#: Up to so many distinct characters each is counted by a pass over the text; beyond, all by sorting them.
FEW_KINDS = 200


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once, however often it is named in lambdas."""
    return F.transform(F.array(value), then)[0]


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    # -sum p log p = log n - sum k log k / n
    added = lambda counts: F.aggregate(counts, F.lit(0.0), lambda s, k: s + k * F.log2(k.cast("double")))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    passes = lambda kinds, size: added(F.transform(kinds, lambda c: size - F.char_length(F.replace(text, c))))

    def sorted_runs(own: Column) -> Column:
        ends = lambda s: F.array_compact(F.transform(s, lambda c, i: F.when(c.eqNullSafe(F.get(s, i + 1)), None).otherwise(i + 1)))
        runs = lambda e: F.transform(e, lambda x, i: (x - F.coalesce(F.get(e, i - 1), F.lit(0))))
        return _bound(F.array_sort(own), lambda s: _bound(ends(s), lambda e: added(runs(e))))

    total = lambda size: _bound(F.array_distinct(chars), lambda kinds: F.when(F.size(kinds) <= FEW_KINDS, passes(kinds, size)).otherwise(sorted_runs(chars)))
    return _bound(F.char_length(text), lambda size: F.when(size > 0, F.log2(size.cast("double")) - total(size) / size).otherwise(F.lit(0.0)))


def public_addresses(text: Column) -> Column:
    """IPv4 literals that can be routed, in order."""
    found = F.regexp_extract_all(text, F.lit(rf"\b({ADDRESS})(:[0-9]{{1,5}})?\b"), 1)
    octets = lambda a: F.transform(F.split(a, r"\."), lambda o: o.cast("int"))
    private = lambda a: reduce(lambda x, y: x | y, [F.startswith(a, F.lit(p)) for p in P.NON_ROUTABLE])
    return F.filter(found, lambda a: F.forall(octets(a), lambda o: o <= 255) & ~private(a) & octets(a)[0].between(1, 223))


def base64_blobs(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"({BASE64_RUN})"), 1)
    return F.filter(runs, lambda r: (F.char_length(r) >= 120) & r.rlike("[a-z]") & r.rlike("[A-Z]"))


def encoded_payload(text: Column) -> Column:
    """Long, unspaced, of a base64 or hex alphabet, not a URL or path, and of high entropy."""
    size = F.char_length(text)
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    shape = (size >= 180) & (size - left(r"\s") <= size * 0.02) & (size - left(r"[A-Za-z0-9+/=_\-]") >= size * 0.92)
    path = F.contains(text, F.lit("://")) | (size - left("/") > size / 12)
    return shape & ~path & (entropy(text) > 4.8)


def escapes(text: Column) -> tuple[Column, Column]:
    r"""Numbers of \xHH and \uHHHH."""
    return F.regexp_count(text, F.lit(r"\\x[0-9a-fA-F]{2}")), F.regexp_count(text, F.lit(r"\\u[0-9a-fA-F]{4}"))


def line_lengths(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), F.char_length)


def minified(text: Column) -> Column:
    lines = line_lengths(text)
    longest, many = F.array_max(lines), F.size(lines)
    return ((many <= 2) & (F.char_length(text) > 2000)) | (F.size(F.filter(lines, lambda n: n > 500)) >= 3) | ((longest > 1000) & (many < 50))


def evidence(text: Column, limit: int = 220) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def required_literals(pattern: str) -> list[str]:
    """For each outermost alternative, the longest run of plain characters that its every match holds, in lower case."""
    done, runs, now, depth, i = [], [], "", 0, 0
    while i < len(pattern):
        c, plain = pattern[i], ""
        if c == "\\":
            i += 1
            plain = "" if pattern[i].isalnum() else pattern[i]
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            done.append(max([*runs, now], key=len))
            runs, now = [], ""
            i += 1
            continue
        elif c not in ".^$|{}*+?":
            plain = c
        if plain and not depth and pattern[i + 1 : i + 2] not in ("*", "?", "{"):
            now += plain
        else:
            runs.append(now)
            now = ""
        i += 1
    return [x.lower() for x in [*done, max([*runs, now], key=len)]]


def holds_any(text: Column, family: list[str], lowered: Column | None = None) -> Column:
    """Whether any pattern of the family matches.

    A plain search for what each pattern must hold comes first, so that most texts
    meet no regular expression. lowered: the text in lower case.
    """
    lowered = F.lower(text) if lowered is None else lowered
    any_of = lambda patterns: text.rlike("(?i)" + "|".join(f"({p})" for p in patterns))
    found = {p: required_literals(p) for p in family}
    sought = [p for p, literals in found.items() if min(map(len, literals)) >= 3]
    bare = [p for p in found if p not in sought]
    checks = [any_of([p]) for p in bare]
    if sought:
        literals = sorted({x for p in sought for x in found[p]})
        checks.append(reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(x)) for x in literals]) & any_of(sought))
    return reduce(lambda a, b: a | b, checks)


def numbers(text: Column, family: list[str]) -> Column:
    """The places, in the family, of the patterns that match."""
    found = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(family)]))
    return F.when(holds_any(text, family), found).otherwise(F.array().cast("array<int>"))


def hook_signals(command: Column) -> Column:
    """The codes a lifecycle command raises, in order; one code twice if two checks raise it."""
    c = F.trim(command)
    has = lambda p: c.rlike(f"(?i){p}")
    url, fetch, benign = has(P.URL), has(P.FETCH), has(P.BENIGN_BUILD)
    hex_, uni = escapes(c)
    hidden = has(P.BASE64_DECODE) | (F.size(base64_blobs(c)) > 0) | ((F.char_length(c) > 160) & (entropy(c) > 4.8)) | (hex_ > 8) | (uni > 8)
    rules = [
        ("INSTALL_HOOK_PRESENT", F.lit(True)),
        ("INSTALL_HOOK_SHELL_PIPE", has(P.PIPE_TO_SHELL)),
        ("INSTALL_HOOK_NETWORK", fetch | (url & ~has("^echo"))),
        ("HARDCODED_IP_ENDPOINT", F.size(public_addresses(c)) > 0),
        ("SUSPICIOUS_ENDPOINT", holds_any(c, P.ENDPOINTS)),
        ("INSTALL_HOOK_OBFUSCATED", hidden),
        ("DYNAMIC_EVAL", has(P.INLINE_EXEC) & ~benign),
        ("PROCESS_SPAWN", has(P.INTERPRETER) & ~benign),
        ("INSTALL_HOOK_OBFUSCATED", has(P.SILENCING) & (url | fetch)),
    ]
    raised = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    return F.when(F.char_length(c) > 0, raised).otherwise(F.array().cast("array<string>"))


def package_of_specifier(spec: Column) -> Column:
    """The package a JavaScript import names; null for relative paths and node: modules."""
    parts = F.split(spec, "/")
    name = F.when(F.startswith(spec, F.lit("@")), F.concat_ws("/", parts[0], F.get(parts, F.lit(1)))).otherwise(parts[0])
    return F.when(~spec.rlike(r"^(\.|/|node:)") & (spec != ""), F.lower(name))
