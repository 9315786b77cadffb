"""Versions, version ranges and CVSS scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

VERSION = r"^v?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-([0-9A-Za-z.\-]+))?(?:\+.*)?$"
#: Above every part of a version.
TOP = (1 << 63) - 1


def version_key(version: Column) -> Column:
    """A struct that orders as versions do: a prerelease before its release, numeric
    identifiers before text, fewer before more; null where the text is no version."""
    v = F.trim(version)
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(v, VERSION, i), F.lit("")), F.lit("999999999999999")).cast("long"), F.lit(0).cast("long"))
    pre = F.regexp_extract(v, VERSION, 4)
    ids = F.transform(
        F.filter(F.split(pre, r"\."), lambda x: x != ""),
        lambda x: F.struct(
            (~x.rlike("^[0-9]+$")).cast("int").alias("text"),
            F.when(x.rlike("^[0-9]{1,18}$"), x.cast("long")).otherwise(F.lit(0).cast("long")).alias("number"),
            F.when(x.rlike("^[0-9]+$"), F.lit("")).otherwise(x).alias("name"),
        ),
    )
    key = F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").cast("int").alias("release"), ids.alias("pre"))
    return F.when(v.rlike(VERSION), key)


def number(major: Column, minor: Column, patch: Column) -> Column:
    """Three parts of any size, which order one after the other."""
    return F.struct(major.cast("long").alias("major"), minor.cast("long").alias("minor"), patch.cast("long").alias("patch"))


def version_number(version: Column) -> Column:
    """Major, minor and patch; null where the text is no version."""
    v = F.trim(version)
    part = lambda i: F.when(F.regexp_extract(v, VERSION, i) == "", F.lit(0)).otherwise(F.regexp_extract(v, VERSION, i)).cast("long")
    return F.when(v.rlike(VERSION), number(part(1), part(2), part(3)))


def is_prerelease(version: Column) -> Column:
    return F.regexp_extract(F.trim(version), VERSION, 4) != ""


def range_groups(spec: Column) -> Column:
    """A range as alternatives of half-open intervals [low, high) over version numbers.

    Each alternative is the intersection of its comparators: caret, tilde, x-ranges,
    hyphen ranges and the five operators, with or without a space after them.
    """
    tidy = F.regexp_replace(F.trim(spec), r"(>=|<=|>|<|=|\^|~)\s+", "$1")
    tidy = F.regexp_replace(tidy, r"(\S+)\s+-\s+(\S+)", ">=$1 <=$2")
    zero = F.lit(0).cast("long")
    none, top = number(zero, zero, zero), number(F.lit(TOP), zero, zero)
    pattern = r"^(\^|~|>=|<=|>|<|=)?v?([0-9]+|[xX*])?(?:\.([0-9]+|[xX*]))?(?:\.([0-9]+|[xX*]))?(-[0-9A-Za-z.\-]+)?$"

    def interval(token: Column) -> Column:
        g = lambda i: F.regexp_extract(token, pattern, i)
        given = lambda i: g(i).rlike("^[0-9]+$")
        value = lambda i: F.when(given(i), g(i)).otherwise(F.lit("0")).cast("long")
        a, b, c = value(2), value(3), value(4)
        op = g(1)
        at = number(a, b, c)
        # One above the last number that the given parts cover.
        past = F.when(~given(2), top).when(~given(3), number(a + 1, F.lit(0), F.lit(0))).when(~given(4), number(a, b + 1, F.lit(0))).otherwise(number(a, b, c + 1))
        caret = F.when(~given(2), top).when((a > 0) | ~given(3), number(a + 1, F.lit(0), F.lit(0))).when((b > 0) | ~given(4), number(a, b + 1, F.lit(0))).otherwise(number(a, b, c + 1))
        tilde = F.when(~given(2), top).when(~given(3), number(a + 1, F.lit(0), F.lit(0))).otherwise(number(a, b + 1, F.lit(0)))
        # Of releases, those above a prerelease begin with its own release.
        pre = g(5) != ""
        past = F.when(pre, at).otherwise(past)
        low = F.when(op == ">", past).when(op.isin("<", "<="), none).otherwise(at)
        high = F.when(op.isin(">", ">="), top).when(op == "<", at).when(op == "^", caret).when(op == "~", tilde).otherwise(past)
        good = token.rlike(pattern) & ~(pre & op.isin("", "="))
        return F.struct(F.when(good, low).otherwise(top).alias("low"), F.when(good, high).otherwise(none).alias("high"))

    def group(text: Column) -> Column:
        parts = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != ""), interval)
        start = F.struct(none.alias("low"), top.alias("high"))
        return F.aggregate(parts, start, lambda s, x: F.struct(F.greatest(s["low"], x["low"]).alias("low"), F.least(s["high"], x["high"]).alias("high")))

    return F.transform(F.split(tidy, r"\|\|"), group)


def satisfies(version: Column, spec: Column) -> Column:
    """A release within some alternative; a prerelease only if the range is its own text."""
    n = version_number(version)
    inside = F.exists(range_groups(spec), lambda g: (n >= g["low"]) & (n < g["high"]))
    return F.coalesce(F.when(is_prerelease(version), F.trim(version) == F.trim(spec)).otherwise(inside), F.lit(False))


def cvss(vector: Column) -> Column:
    """Approximate CVSS v3 base score, rounded up to a tenth; null if a metric is missing."""
    metric = F.str_to_map(vector, F.lit("/"), F.lit(":"))

    def weight(name: str) -> Column:
        out = F.lit(None).cast("double")
        for value, w in P.CVSS[name].items():
            out = F.when(metric[name] == value, F.lit(w)).otherwise(out)
        return out

    base = 1 - (1 - weight("C")) * (1 - weight("I")) * (1 - weight("A"))
    changed = F.coalesce(metric["S"] == "C", F.lit(False))
    impact = F.when(changed, 7.52 * (base - 0.029) - 3.25 * F.pow(base - 0.02, F.lit(15.0))).otherwise(6.42 * base)
    exploit = 8.22 * weight("AV") * weight("AC") * weight("PR") * weight("UI")
    raw = F.least(F.when(changed, F.lit(1.08)).otherwise(F.lit(1.0)) * (impact + exploit), F.lit(10.0))
    return F.when(exploit.isNull() | base.isNull(), F.lit(None)).when(impact <= 0, F.lit(0.0)).otherwise(F.floor(raw * 10 + 0.99999) / 10)


def severity(score: Column, label: Column | None = None) -> Column:
    """The database's own label, or else the score's band."""
    band = F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MODERATE").when(score.isNotNull(), "LOW").otherwise("UNKNOWN")
    return band if label is None else F.coalesce(F.upper(label), band)
