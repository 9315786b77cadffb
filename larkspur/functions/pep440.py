"""Python package versions and specifier sets as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import merging

VERSION = r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+[a-z0-9._\-]+)?$"
SPECIFIER = r"^\s*(===|==|!=|~=|<=|>=|<|>)\s*([^\s,]+?)(\.\*)?\s*$"
_LAST = 10**15


def _text(version: Column) -> Column:
    return F.lower(F.trim(version))


def _part(version: Column, i: int) -> Column:
    return F.regexp_extract(_text(version), VERSION, i)


def _number(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.substring(text, 1, 15)).cast("long")


def release(version: Column) -> Column:
    return F.transform(F.split(_part(version, 2), r"\."), lambda x: F.substring(x, 1, 15).cast("long"))


def _stripped(numbers: Column) -> Column:
    """Without zeros at the end: 1.0 equals 1.0.0."""
    kept = F.array_max(F.transform(numbers, lambda n, i: F.when(n > 0, i + 1).otherwise(F.lit(0))))
    return F.slice(numbers, F.lit(1), kept)


def is_prerelease(version: Column) -> Column:
    return (_part(version, 3) != "") | (_part(version, 8) != "")


def version_key(version: Column) -> Column:
    """A struct that orders as the versions do; null where the text is no version."""
    pre, dev = _part(version, 3), _part(version, 8) != ""
    post = (_part(version, 5) != "") | (_part(version, 6) != "")
    phase = F.when(pre.isin("a", "alpha"), 0).when(pre.isin("b", "beta"), 1).when(pre != "", 2).when(dev & ~post, -1).otherwise(3)
    key = F.struct(
        _number(_part(version, 1)).alias("epoch"),
        _stripped(release(version)).alias("release"),
        phase.alias("phase"),
        _number(_part(version, 4)).alias("pre"),
        F.when(post, _number(F.concat(_part(version, 5), _part(version, 7)))).otherwise(F.lit(-1)).cast("long").alias("post"),
        F.when(dev, _number(_part(version, 9))).otherwise(F.lit(_LAST)).cast("long").alias("dev"),
    )
    return F.when(_text(version).rlike(VERSION), key)


def same(a: Column, b: Column) -> Column:
    """Equal versions, however written; equal texts where one is no version."""
    return F.coalesce(version_key(a) == version_key(b), F.trim(a) == F.trim(b))


def _begins(version: Column, prefix: Column, drop: int) -> Column:
    """The release of version begins with prefix's numbers but the last `drop`."""
    want = F.slice(release(prefix), F.lit(1), F.size(release(prefix)) - drop)
    padded = F.concat(release(version), F.array_repeat(F.lit(0).cast("long"), F.size(want)))
    return F.slice(padded, F.lit(1), F.size(want)) == want


def satisfies(version: Column, spec: Column) -> Column:
    """Whether every specifier of a comma-separated set allows the version; an empty set allows all."""
    key = version_key(version)

    def one(text: Column) -> Column:
        op, other, star = (F.regexp_extract(text, SPECIFIER, i) for i in (1, 2, 3))
        at = version_key(other)
        rules = [
            ("===", F.trim(version) == other),
            ("==", F.when(star != "", _begins(version, other, 0)).otherwise(key == at)),
            ("!=", ~F.when(star != "", _begins(version, other, 0)).otherwise(key == at)),
            ("~=", (key >= at) & _begins(version, other, 1)),
            ("<=", key <= at),
            (">=", key >= at),
            ("<", (key < at) & ~(is_prerelease(version) & ~is_prerelease(other) & (_stripped(release(version)) == _stripped(release(other))))),
            (">", key > at),
        ]
        return reduce(lambda rest, r: F.when(op == r[0], r[1]).otherwise(rest), reversed(rules), F.lit(False))

    parts = F.filter(F.split(F.coalesce(spec, F.lit("")), ","), lambda t: F.trim(t) != "")
    return F.coalesce(F.forall(parts, one), F.lit(False)) & key.isNotNull()


def resolve(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """name, spec, version: the highest stable release that the set allows, else the highest prerelease, else null."""
    hits = requests.select("name", "spec").distinct().join(merging(versions.select("name", "version")), "name").where(satisfies(F.col("version"), F.col("spec")))
    best = hits.groupBy("name", "spec").agg(F.max_by("version", F.struct((~is_prerelease(F.col("version"))).alias("stable"), version_key(F.col("version")).alias("key"))).alias("version"))
    return requests.select("name", "spec").distinct().join(merging(best), ["name", "spec"], "left")
