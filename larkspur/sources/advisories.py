"""Advisory documents as rows: severity, bounds, symbols and references, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import pep440
from ..functions import versions as V

_SYMBOLS = "imports:array<string>,affected_functions:array<string>,functions:array<string>,symbols:array<string>"
_AFFECTED = f"struct<package:struct<name:string>,ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>,ecosystem_specific:struct<{_SYMBOLS}>>"
SCHEMA = (
    "struct<id:string,summary:string,details:string,published:string,aliases:array<string>,severity:array<struct<score:string>>,"
    f"database_specific:struct<severity:string>,affected:array<{_AFFECTED}>,references:array<struct<url:string>>>"
)
# What in prose names a symbol.
SPAN, CALL = r"`([A-Za-z_$][\w$.]{2,60})(?:\(\))?`", r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(\s*\)"
# So much of a text, and so many references and parsed symbols, are kept.
SUMMARY, DETAILS, REFERENCES, SYMBOLS = 500, 4000, 8, 12


def _list(column: Column, kind: str = "string") -> Column:
    return F.coalesce(column, F.array().cast(f"array<{kind}>"))


def cve_id(id_: Column, aliases: Column) -> Column:
    """The id itself, or the first alias, that is a CVE."""
    return F.when(F.startswith(id_, F.lit("CVE-")), id_).otherwise(F.get(F.filter(_list(aliases), lambda a: F.startswith(a, F.lit("CVE-"))), F.lit(0)))


def score_and_vector(entries: Column) -> Column:
    """score, vector of the first entry that is a CVSS vector or a number."""
    usable = F.filter(entries, lambda e: F.startswith(e["score"], F.lit("CVSS:")) | e["score"].try_cast("double").isNotNull())
    text = F.get(usable, F.lit(0))["score"]
    vector = F.when(F.startswith(text, F.lit("CVSS:")), text)
    return F.struct(F.when(vector.isNotNull(), V.cvss(vector)).otherwise(text.try_cast("double")).alias("score"), vector.alias("vector"))


def bounds(affected: Column, package: Column) -> Column:
    """introduced, fixed of the package's first range that has one of them; of several events in a range the last counts."""
    own = F.filter(_list(affected, _AFFECTED), lambda a: F.lower(a["package"]["name"]) == F.lower(package))
    ranges = F.flatten(F.transform(own, lambda a: a["ranges"]))
    last = lambda events, field: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(events, lambda e: e[field]), lambda x: x.isNotNull())), -1)
    found = F.transform(ranges, lambda r: F.struct(last(r["events"], "introduced").alias("introduced"), last(r["events"], "fixed").alias("fixed")))
    return F.get(F.filter(found, lambda b: b["introduced"].isNotNull() | b["fixed"].isNotNull()), F.lit(0))


def symbols(affected: Column, package: Column, summary: Column, details: Column) -> Column:
    """symbols, confidence: from the advisory's own fields, else the curated table, else code spans and calls in its prose."""
    fields = lambda s: F.flatten(F.array(*[_list(s[k]) for k in ("imports", "affected_functions", "functions", "symbols")]))
    named = F.flatten(F.transform(_list(affected, _AFFECTED), lambda a: fields(a["ecosystem_specific"])))
    own = F.array_sort(F.array_distinct(F.flatten(F.transform(named, lambda x: F.when(F.startswith(x, F.lit("{")), _list(F.from_json(x, "struct<symbols:array<string>>")["symbols"])).otherwise(F.array(x))))))
    table = F.create_map(*[c for name, found in P.CURATED_SYMBOLS.items() for c in (F.lit(name), F.array(*map(F.lit, found)))])
    curated = table[F.lower(package)]
    prose = F.concat(F.coalesce(summary, F.lit("")), F.lit("\n"), F.coalesce(details, F.lit("")))
    parsed = parsed_symbols(prose)
    return (
        F.when(F.size(own) > 0, F.struct(own.alias("symbols"), F.lit("structured").alias("confidence")))
        .when(curated.isNotNull(), F.struct(curated.alias("symbols"), F.lit("curated").alias("confidence")))
        .when(F.size(parsed) > 0, F.struct(parsed.alias("symbols"), F.lit("parsed").alias("confidence")))
        .otherwise(F.struct(F.array().cast("array<string>").alias("symbols"), F.lit("none").alias("confidence")))
    )


def parsed_symbols(prose: Column) -> Column:
    """The first SYMBOLS names, in order, that prose sets as code or calls; common words aside."""
    found = F.array_distinct(F.concat(F.regexp_extract_all(prose, F.lit(SPAN), 1), F.regexp_extract_all(prose, F.lit(CALL), 1)))
    last = lambda x: F.lower(F.element_at(F.split(x, r"\."), -1))
    kept = F.filter(found, lambda x: (F.char_length(x) >= 3) & ~last(x).isin(P.SYMBOL_STOPWORDS) & ~F.lower(x).rlike("^(cve-|ghsa-|http)"))
    return F.slice(F.array_sort(kept), 1, SYMBOLS)


def parse(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per package and advisory, with the columns to keep. documents: ecosystem, package, text; unreadable texts give a row without severity."""
    d = documents.withColumn("d", F.from_json("text", SCHEMA))
    field = lambda n: F.col(f"d.{n}")
    d = d.withColumn("s", score_and_vector(field("severity"))).withColumn("b", bounds(field("affected"), F.col("package")))
    d = d.withColumn("y", symbols(field("affected"), F.col("package"), field("summary"), field("details")))
    return d.select(
        "ecosystem",
        "package",
        F.coalesce(field("id"), F.lit("UNKNOWN")).alias("id"),
        cve_id(field("id"), field("aliases")).alias("cve"),
        F.substring(F.coalesce(field("summary"), F.lit("")), 1, SUMMARY).alias("summary"),
        F.substring(F.coalesce(field("details"), F.lit("")), 1, DETAILS).alias("details"),
        V.severity(F.col("s.score"), F.nullif(field("database_specific.severity"), F.lit(""))).alias("severity"),
        F.col("s.score").alias("cvss"),
        F.col("s.vector").alias("vector"),
        F.col("b.introduced").alias("introduced"),
        F.col("b.fixed").alias("fixed"),
        F.nullif(field("published"), F.lit("")).alias("published"),
        F.slice(F.filter(F.transform(_list(field("references"), "struct<url:string>"), lambda r: r["url"]), lambda u: u.isNotNull() & (u != "")), 1, REFERENCES).alias("references"),
        F.col("y.symbols").alias("symbols"),
        F.col("y.confidence").alias("symbol_confidence"),
        *keep,
    )


def for_packages(packages: DataFrame, ids: DataFrame, advisories: DataFrame) -> DataFrame:
    """Each package with its advisories; an advisory is read once, however many packages share it.

    packages: ecosystem, name, version; ids: the same and id; advisories: id, text.
    """
    asked = packages.join(ids, ["ecosystem", "name", "version"]).distinct()
    return parse(asked.join(advisories.dropDuplicates(["id"]), "id").select("ecosystem", F.col("name").alias("package"), "version", "text"))


_RANGES = "struct<affected:array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>>"


def affecting(packages: DataFrame, documents: DataFrame) -> DataFrame:
    """ecosystem, name, version, id: which advisories affect which releases, by listed versions or by ranges of introduced, fixed and last affected ones.

    packages: ecosystem, name, version; documents: id, text. Names agree in lower case; a document without an ecosystem is of any. Ranges of commits
    say nothing about versions.
    """
    each = documents.dropDuplicates(["id"]).select("id", F.explode(F.from_json("text", _RANGES)["affected"]).alias("a"))
    events = F.flatten(F.transform(F.filter(_list(F.col("a.ranges"), "struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>"), lambda r: F.coalesce(r["type"], F.lit("")) != "GIT"), lambda r: _list(r["events"], "struct<introduced:string,fixed:string,last_affected:string>")))
    named = each.select("id", F.lower("a.package.name").alias("low"), F.lower("a.package.ecosystem").alias("of"), _list(F.col("a.versions")).alias("listed"), events.alias("events"))
    met = packages.select("ecosystem", "name", "version").distinct().withColumn("low", F.lower("name")).join(named, "low").where(F.col("of").isNull() | (F.col("of") == F.col("ecosystem")))

    def within(key: Callable[[Column], Column]) -> Column:
        own = key(F.col("version"))
        best = lambda field, keep: F.array_max(F.filter(F.transform("events", lambda e: key(e[field])), lambda k: keep(k)))
        since, fixed, last = best("introduced", lambda k: k <= own), best("fixed", lambda k: k <= own), best("last_affected", lambda k: k < own)
        return since.isNotNull() & (fixed.isNull() | (since > fixed)) & (last.isNull() | (since > last))

    ranged = F.when(F.col("ecosystem") == "pypi", within(pep440.version_key)).otherwise(within(V.version_key))
    return met.where(F.array_contains("listed", F.col("version")) | F.coalesce(ranged, F.lit(False))).select("ecosystem", "name", "version", "id").distinct()
