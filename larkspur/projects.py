"""From manifests to ranked findings: projects are read, resolved, matched with advisories and judged, all of them in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import cut
from .functions import pep440
from .operators import resolution, vulns
from .sources import advisories, call_graph, javascript, manifests, registry
from .streaming.progress import Progress

STAGES = ["manifests", "resolve", "advisories", "reachability", "rank"]
_READERS = {"package.json": manifests.package_json, "requirements.txt": manifests.requirements_lines, "pyproject.toml": manifests.pyproject, "package-lock.json": manifests.package_lock}


@dataclass
class Registry:
    """releases: ecosystem, name, version; tags: ecosystem, name, tag, version; dependencies: ecosystem, name, version, dependency, range, ord."""

    releases: DataFrame
    tags: DataFrame
    dependencies: DataFrame


def registry_tables(npm: DataFrame, pypi: DataFrame) -> Registry:
    """What registry documents (text) say of releases, tags and dependencies; a PyPI project names those of its present release alone."""
    n = npm.select(F.from_json("text", registry.NPM).alias("d")).where("d.name IS NOT NULL").select("d.name", "d.`dist-tags`", "d.versions")
    p = pypi.select(F.from_json("text", registry.PYPI).alias("d")).where("d.info.name IS NOT NULL").select(F.lower("d.info.name").alias("name"), F.col("d.info.version").alias("version"), "d.releases", F.col("d.info.requires_dist").alias("requires"))
    of = lambda rows, ecosystem: rows.withColumn("ecosystem", F.lit(ecosystem))
    releases = of(n.select("name", F.explode(F.map_keys("versions")).alias("version")), "npm").unionByName(of(p.select("name", F.explode(F.map_keys("releases")).alias("version")), "pypi"))
    tags = of(n.select("name", F.explode("dist-tags").alias("tag", "version")), "npm")
    of_npm = n.select("name", F.explode("versions").alias("version", "v")).select("name", "version", F.posexplode(F.map_entries("v.dependencies")).alias("ord", "e")).select("name", "version", F.col("e.key").alias("dependency"), F.col("e.value").alias("range"), "ord")
    plain = F.filter(F.coalesce("requires", F.array().cast("array<string>")), lambda r: ~r.rlike(r";.*\bextra\b"))
    line = r"^\s*([A-Za-z0-9._\-]+)\s*(?:\[[^\]]*\])?\s*\(?([^;)]*)\)?"
    of_pypi = p.select("name", "version", F.posexplode(plain).alias("ord", "r")).select("name", "version", F.lower(F.regexp_extract("r", line, 1)).alias("dependency"), F.trim(F.regexp_extract("r", line, 2)).alias("range"), "ord")
    return Registry(releases, tags, of(of_npm, "npm").unionByName(of(of_pypi, "pypi")))


@dataclass
class Scan:
    """packages: project, ecosystem, name, version, depth, is_direct, spec, required_by; findings: one row for each package of a
    project and vulnerability, with verdict and priority; plan: the upgrades; warnings: project, warning; summary: project and totals."""

    packages: DataFrame
    findings: DataFrame
    plan: DataFrame
    warnings: DataFrame
    summary: DataFrame


def requirements(files: DataFrame) -> DataFrame:
    """project, ecosystem, name, spec, kind, direct of each project's preferred manifests; kinds: runtime, dev, locked. files: project, path, text.

    direct marks what the manifest beside a lock file asks for, and pins outside of one.
    """
    chosen = cut(manifests.preferred(files).withColumn("project", F.struct("project", "ecosystem")).withColumn("project", F.to_json("project")))
    # a lock file says what is installed, the manifest beside it what is asked for directly
    beside = files.where("path = 'package.json'").select(F.to_json(F.struct("project", F.lit("npm").alias("ecosystem"))).alias("project"), "path", "text")
    locked = chosen.where("path = 'package-lock.json'").select("project")
    every = chosen.select("project", "path", "text").unionByName(beside.join(locked, "project", "left_semi"))
    read = reduce(DataFrame.unionByName, [reader(every.where(F.col("path") == name).select("project", "text")).toDF("project", "name", "spec", "kind").withColumn("from", F.lit(name)) for name, reader in _READERS.items()])
    read = read.join(locked.withColumn("lock", F.lit(True)), "project", "left").withColumn("direct", (F.col("lock").isNotNull() & (F.col("from") == "package.json")) | ((F.col("kind") == "locked") & (F.col("from") != "package-lock.json")))
    key = F.from_json("project", "struct<project: string, ecosystem: string>")
    return read.where("kind <> 'warning'").select(key.alias("k"), "name", "spec", "kind", "direct").select("k.project", "k.ecosystem", "name", "spec", "kind", "direct")


def packages_of(asked: DataFrame, known: Registry, include_dev: bool = False) -> tuple[DataFrame, DataFrame]:
    """(packages, warnings) of projects; asked: rows of requirements().

    A project that pins all it needs, as with a lock file, has the packages and versions that it lists, at depth 0; the others
    are resolved level by level, a pin among other requirements being a range like any.
    """
    asked = cut(asked)
    kinds = ["runtime", "dev"] if include_dev else ["runtime"]
    pins = asked.groupBy("project", "ecosystem").agg(F.count_if(F.col("kind") == "locked").alias("pins"), F.count_if((F.col("kind") == "runtime") & ~F.coalesce(F.col("direct"), F.lit(False))).alias("open"))
    has_lock = pins.where("pins > 0 AND open = 0").select("project", "ecosystem")
    free = asked.where("kind = 'locked'").join(has_lock, ["project", "ecosystem"], "left_anti").withColumn("kind", F.lit("runtime"))
    asked = cut(asked.join(free.select("project", "ecosystem").distinct(), ["project", "ecosystem"], "left_anti").unionByName(asked.where("kind <> 'locked'").join(free.select("project", "ecosystem").distinct(), ["project", "ecosystem"], "left_semi")).unionByName(free))
    wanted = asked.where(F.col("kind").isin(kinds)).groupBy("project", "ecosystem", "name").agg(F.min("spec").alias("spec"))
    direct = wanted.select("project", "ecosystem", F.lower("name").alias("low"), F.col("spec").alias("asked"))
    pinned = asked.where("kind = 'locked'").select("project", "ecosystem", "name", F.regexp_replace("spec", r"^[= ]+", "").alias("version"), "direct").distinct().withColumn("low", F.lower("name")).join(direct, ["project", "ecosystem", "low"], "left")
    out = [pinned.select("project", "ecosystem", "name", "version", F.lit(0).alias("depth"), (F.col("asked").isNotNull() | F.col("direct")).alias("is_direct"), F.col("asked").alias("spec"), F.array("project").alias("required_by"))]
    said = [asked.select("project").limit(0).withColumn("warning", F.lit(""))]
    for ecosystem in ("npm", "pypi"):
        mine = lambda t: t.where(F.col("ecosystem") == ecosystem).drop("ecosystem")  # noqa: B023, E731
        roots = mine(wanted.join(has_lock, ["project", "ecosystem"], "left_anti")).select(F.col("project").alias("root"), "name", "spec", F.xxhash64("name").alias("ord"))
        pick = (lambda q: registry.resolve_npm(q, mine(known.releases), mine(known.tags))) if ecosystem == "npm" else (lambda q: pep440.resolve(q, mine(known.releases)))
        got = resolution.resolve(roots, mine(known.dependencies), pick)
        out.append(got.packages.select(F.col("root").alias("project"), F.lit(ecosystem).alias("ecosystem"), "name", "version", "depth", "is_direct", "spec", "required_by"))
        said.append(got.unresolved.select(F.col("root").alias("project"), F.concat(F.lit("Unresolved: "), "name", "spec").alias("warning")))
        said.append(got.truncated.select(F.col("root").alias("project"), F.concat(F.lit("Dependency resolution truncated: "), "reason").alias("warning")))
    return cut(reduce(DataFrame.unionByName, out)), reduce(DataFrame.unionByName, said).distinct()


def _judged(found: DataFrame, files: DataFrame, import_names: DataFrame | None) -> DataFrame:
    """found with verdict, confidence, reachable, symbol and steps: by the call graph for Python, by imports for JavaScript."""
    key = ["project", "ecosystem", "package", "version", "id"]
    own = F.lower("package")
    roots = F.array(own, F.replace(own, F.lit("-"), F.lit("_")))
    python = found.where("ecosystem = 'pypi'").withColumn("roots", roots)
    if import_names is not None:
        known = import_names.select(F.lower("distribution").alias("low"), "modules")
        python = python.join(known, own == F.col("low"), "left").withColumn("roots", F.array_union("roots", F.coalesce("modules", F.array().cast("array<string>")))).drop("low", "modules")
    sources = files.withColumn("source", F.col("text"))
    graph = call_graph.facts(sources.where("endswith(path, '.py')").select("project", "path", "source"))
    wanted = python.select("project", F.to_json(F.struct("package", "version", "id")).alias("id"), "roots", "symbols")
    verdicts = call_graph.verdicts(graph, wanted).select("project", "id", "verdict", "confidence", "reachable", "symbol", "steps", "imported_by")
    python = python.drop("roots").withColumn("__id", F.to_json(F.struct("package", "version", "id"))).join(verdicts.withColumnRenamed("id", "__id"), ["project", "__id"]).drop("__id")
    scripts = sources.where(F.lower("path").rlike(r"\.(js|mjs|cjs|jsx|ts|tsx)$"))
    users = javascript.imports(scripts.select(F.to_json(F.struct("project", "path")).alias("path"), "source")).where("package IS NOT NULL")
    users = users.select(F.from_json("path", "struct<project: string, path: string>")["project"].alias("project"), F.col("path").alias("file"), F.lower("package").alias("low")).distinct()
    users = users.groupBy("project", "low").agg(F.count(F.lit(1)).alias("imported_by"))
    seen = scripts.select("project", F.lit(True).alias("seen")).distinct()
    npm = found.where("ecosystem <> 'pypi'").withColumn("low", own).join(seen, "project", "left").join(users, ["project", "low"], "left")
    verdict = F.when(F.col("seen").isNull(), "not_analysed").when(F.col("imported_by").isNull(), "not_imported").otherwise("assumed_reachable")
    confidence = F.when(verdict == "not_analysed", "none").when(verdict == "not_imported", "high").otherwise("low")
    npm = npm.withColumns({"verdict": verdict, "confidence": confidence, "reachable": verdict != "not_imported"}).drop("seen", "low")
    both = python.unionByName(npm, allowMissingColumns=True)
    return both.select(*key, *[c for c in both.columns if c not in key])


def scan(files: DataFrame, known: Registry, ids: DataFrame | None, documents: DataFrame, import_names: DataFrame | None = None, include_dev: bool = False, callback: Callable[[str, float], None] | None = None) -> Scan:
    """Scan projects. files: project, path, text, manifests and sources alike; ids: ecosystem, name, version, id, by default what the advisories'
    ranges say; documents: id, text of an advisory; import_names: distribution, modules. Projects without source have every advisory reported as reachable."""
    progress = Progress(STAGES, callback)
    with progress.stage("manifests"):
        asked = requirements(files)
    with progress.stage("resolve"):
        packages, warnings = packages_of(asked, known, include_dev)
    with progress.stage("advisories"):
        refs = packages.select("ecosystem", "name", "version").distinct()
        ids = advisories.affecting(refs, documents) if ids is None else ids
        hits = cut(refs.join(ids, ["ecosystem", "name", "version"]).distinct())
        texts = hits.select("ecosystem", "name", "id").distinct().join(documents.dropDuplicates(["id"]), "id").select("ecosystem", F.col("name").alias("package"), "text", F.col("id").alias("asked_id"))
        parsed = advisories.parse(texts, ["asked_id"])
        placed = packages.select("project", "ecosystem", F.col("name").alias("package"), "version", "depth", "is_direct", "required_by")
        found = placed.join(hits.select("ecosystem", F.col("name").alias("package"), "version", F.col("id").alias("asked_id")), ["ecosystem", "package", "version"]).join(parsed, ["ecosystem", "package", "asked_id"]).drop("asked_id")
    with progress.stage("reachability"):
        judged = cut(_judged(found, files, import_names))
    with progress.stage("rank"):
        one = F.to_json(F.struct("project", "ecosystem", "package", "version"))
        rows = judged.withColumns({"key": one, "n_symbols": F.size("symbols"), "ord": F.xxhash64("id")})
        best = vulns.deduplicated(rows.select(F.col("key").alias("package"), "id", "cve", "severity", "cvss", "n_symbols", "summary", "fixed", "ord"))
        kept = rows.join(best.select(F.col("package").alias("key"), "id", F.col("fixed").alias("__fixed"), "records"), ["key", "id"])
        kept = kept.withColumn("fixed", F.col("__fixed")).withColumn("priority", vulns.priority(F.col("cvss"), F.col("severity"), F.col("reachable")))
        findings = cut(kept.drop("__fixed", "key", "n_symbols", "ord"))
        named = findings.withColumn("package", F.to_json(F.struct("project", "ecosystem", "package", "version")))
        plan = vulns.remediation(named).withColumn("k", F.from_json("package", "struct<project: string, ecosystem: string, package: string, version: string>")).select("k.*", "upgrade_to", "fixes", "reachable_fixes", "worst", "ids")
        summary = vulns.summary(findings, "project")
    return Scan(packages, findings, plan, warnings, summary)


def ranked(findings: DataFrame) -> list[Column]:
    """What findings are ordered by: the projects, and within each the most urgent first."""
    return [F.col("project"), F.col("priority").desc(), F.col("package"), F.col("id")]
