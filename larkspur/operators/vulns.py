"""Advisories: join, de-duplication, verdicts, remediation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import cut
from ..functions import versions as V

RANKS = ["UNKNOWN", "LOW", "MODERATE", "HIGH", "CRITICAL"]
#: What a label without a score counts as.
LABEL_SCORES = {"CRITICAL": 9.0, "HIGH": 7.5, "MODERATE": 5.0, "MEDIUM": 5.0, "LOW": 2.5}
UNLABELLED = 4.0


def rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RANKS]), severity), F.lit(1)) - 1


def package_key(ecosystem: Column, name: Column, version: Column) -> Column:
    return F.concat_ws(":", ecosystem, F.lower(name), version)


def matched(findings: DataFrame, packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings with their package's and advisory's columns; those without either are left out. Keys: package and advisory."""
    return findings.join(packages, "package").join(advisories, "advisory")


def deduplicated(findings: DataFrame) -> DataFrame:
    """The most informative finding of each package and CVE; its fixed version, or the first other one.

    findings: package, id, cve, severity, cvss, n_symbols, summary, fixed, ord (input order).
    One aggregation: a maximum over structs, so a heavy key is combined before the shuffle.
    """
    info = F.struct(F.col("cvss").isNotNull().alias("a"), rank(F.col("severity")).alias("b"), F.coalesce("cvss", F.lit(0.0)).alias("c"), F.col("n_symbols").alias("d"), F.char_length("summary").alias("e"), (-F.col("ord")).alias("f"))
    return (
        findings.withColumn("cve_or_id", F.coalesce("cve", "id"))
        .groupBy("package", "cve_or_id")
        .agg(
            F.max_by(F.struct("id", "severity", "cvss", "fixed"), info).alias("w"),
            F.min_by("fixed", F.when(F.col("fixed").isNotNull(), F.col("ord"))).alias("other"),
            F.count(F.lit(1)).alias("records"),
        )
        .select("package", "cve_or_id", "w.id", "w.severity", "w.cvss", F.coalesce("w.fixed", "other").alias("fixed"), "records")
    )


def priority(cvss: Column, severity: Column, reachable: Column) -> Column:
    """The score, or the label's; a tenth of it where nothing reaches the code."""
    by_label = F.coalesce(F.create_map(*[x for k, v in LABEL_SCORES.items() for x in (F.lit(k), F.lit(v))])[severity], F.lit(UNLABELLED))
    return F.coalesce(cvss, by_label) * F.when(reachable, 1.0).otherwise(0.1)


def remediation(findings: DataFrame, ids: int = 12) -> DataFrame:
    """Per package the version that fixes all, what it fixes, and the first ids."""
    fixed = findings.where(F.col("fixed").isNotNull())
    named = fixed.select("package", "id").distinct().withColumn("__place", F.row_number().over(Window.partitionBy("package").orderBy("id")))
    first = named.where(F.col("__place") <= ids).groupBy("package").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    plan = fixed.groupBy("package").agg(
        F.max_by("fixed", V.version_key(F.col("fixed"))).alias("upgrade_to"),
        F.count(F.lit(1)).alias("fixes"),
        F.count_if("reachable").alias("reachable_fixes"),
        F.max(rank(F.col("severity"))).alias("worst"),
    )
    return plan.join(first, "package", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def remediation_plan(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """The upgrades of packages that a scan has, with their present version, in order: reachable fixes, all fixes, name. packages: package, version, is_direct."""
    return remediation(findings).join(packages, "package").orderBy(F.col("reachable_fixes").desc(), F.col("fixes").desc(), "package")


def reachability(findings: DataFrame, analysed: DataFrame, imported: DataFrame, called: DataFrame) -> DataFrame:
    """Verdict and confidence: not_analysed, not_imported, assumed_reachable, reachable or symbol_not_called.

    analysed and imported list packages; called lists packages and symbols.
    """
    a = analysed.select("package", F.lit(True).alias("seen")).distinct()
    i = imported.select("package", F.lit(True).alias("used")).distinct()
    # symbols are looked up one by one, so a package with many calls is no long list
    asked = findings.select("package", "symbols").distinct().withColumn("symbol", F.explode("symbols"))
    c = asked.join(called.select("package", "symbol").distinct(), ["package", "symbol"]).select("package", "symbols", F.lit(True).alias("hit")).distinct()
    out = findings.join(a, "package", "left").join(i, "package", "left").join(c, ["package", "symbols"], "left")
    verdict = (
        F.when(F.col("seen").isNull(), "not_analysed")
        .when(F.col("used").isNull(), "not_imported")
        .when(F.size("symbols") == 0, "assumed_reachable")
        .when(F.col("hit").isNotNull(), "reachable")
        .otherwise("symbol_not_called")
    )
    confidence = F.create_map(*[F.lit(x) for x in ("not_analysed", "none", "not_imported", "high", "assumed_reachable", "low", "reachable", "high", "symbol_not_called", "medium")])
    return out.withColumn("verdict", verdict).withColumn("confidence", confidence[F.col("verdict")]).drop("seen", "used", "hit")


def exposure(install: Column, analysed: Column, imported: Column, module_level: Column, called: Column) -> Column:
    return F.when(install, "install_time").when(~analysed, "unknown").when(~imported, "not_imported").when(module_level, "import_time").when(called, "call_reachable").otherwise("not_called")


def summary(findings: DataFrame, key: str = "scan") -> DataFrame:
    """Totals by severity, reachable ones, and the share that analysis rules out."""
    sev = lambda s, r=None: F.count_if((F.col("severity") == s) & (F.col("reachable") if r else F.lit(True)))
    return findings.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("reachable").alias("reachable"),
        *[sev(s).alias(s.lower()) for s in RANKS],
        *[sev(s, True).alias(f"reachable_{s.lower()}") for s in RANKS],
    ).withColumn("noise_reduction", F.coalesce(F.try_divide(F.col("total") - F.col("reachable"), F.col("total")), F.lit(0.0)))


def top_by_priority(findings: DataFrame, limit: int) -> DataFrame:
    return findings.withColumn("priority", priority(F.col("cvss"), F.col("severity"), F.col("reachable"))).orderBy(F.col("priority").desc(), "id").limit(limit)


def last_write(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key; an aggregate, so repeated writes are combined before the shuffle."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("w")).select(key, "w.*")


#: Rows of a range within which members are added up.
RANGE_ROWS = 1_000_000


def running_limit(members: DataFrame, archive: str, seq: str, size: str, max_members: int, max_bytes: int) -> DataFrame:
    """Members with running totals; `kept` until the first that breaches a ceiling, with the reason.

    Members are ordered in ranges, and what an archive has in the ranges before is added up apart, so that an archive with
    most of the members is no task of its own.
    """
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), members.count() // RANGE_ROWS)
    placed = cut(members.repartitionByRange(parts, archive, seq).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy(archive)
    earlier = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy(archive, "__part").agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__s"))
    before = heads.select(archive, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__members"), F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__bytes"))
    here = Window.partitionBy(archive, "__part").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumns({"__a": F.count(F.lit(1)).over(here), "__b": F.sum(size).over(here)}).join(before.withColumnRenamed(archive, "__archive").withColumnRenamed("__part", "__at"), F.col(archive).eqNullSafe(F.col("__archive")) & (F.col("__part") == F.col("__at")))
    run = joined.withColumns({"members": F.col("__a") + F.col("__members"), "bytes": F.col("__b") + F.col("__bytes")}).drop("__a", "__b", "__members", "__bytes", "__part", "__at", "__archive")
    why = F.when(F.col("members") > max_members, "members").when(F.col("bytes") > max_bytes, "bytes")
    return run.withColumn("reason", why).withColumn("kept", F.col("reason").isNull())
