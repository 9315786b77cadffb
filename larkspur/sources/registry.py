"""Registry documents as metadata rows: npm packuments and PyPI projects, from snapshots.

Snapshots are JSON texts in a table; nothing is fetched here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import merging

#: The lifecycle commands that run by themselves.
HOOKS = ["preinstall", "install", "postinstall", "prepare", "prepublish"]
_NPM_VERSION = "struct<description:string,license:string,homepage:string,dependencies:map<string,string>,scripts:map<string,string>,dist:struct<tarball:string,integrity:string,shasum:string,unpackedSize:long>>"
NPM = f"struct<name:string,description:string,license:string,homepage:string,repository:string,maintainers:array<string>,time:map<string,string>,`dist-tags`:map<string,string>,versions:map<string,{_NPM_VERSION}>>"
PYPI = "struct<info:struct<name:string,version:string,summary:string,license:string,home_page:string,author:string,maintainer:string,project_urls:map<string,string>,requires_dist:array<string>>,releases:map<string,array<struct<filename:string,packagetype:string,url:string,size:long,upload_time_iso_8601:string,digests:struct<sha256:string>>>>>"


def repository_url(repository: Column) -> Column:
    """The URL of an npm repository field, which is a text or an object with url."""
    inner = F.coalesce(F.get_json_object(repository, "$.url"), repository)
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(inner), r"^git\+", ""), r"\.git$", ""), F.lit(""))


def npm_metadata(documents: DataFrame) -> DataFrame:
    """One row per package and version. documents: text."""
    doc = F.from_json("text", NPM)
    rows = documents.select(doc.alias("d")).where("d.name IS NOT NULL").select("d", F.explode("d.versions").alias("version", "v"))
    scripts = F.map_filter(F.coalesce("v.scripts", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(HOOKS) & (F.trim(v) != ""))
    return rows.select(
        F.lit("npm").alias("ecosystem"),
        F.col("d.name").alias("name"),
        "version",
        F.coalesce("v.description", "d.description").alias("description"),
        F.coalesce("v.license", "d.license").alias("license"),
        repository_url(F.col("d.repository")).alias("repository_url"),
        F.try_to_timestamp(F.col("d.time")[F.col("version")]).alias("published_at"),
        F.coalesce(F.size("d.maintainers"), F.lit(0)).alias("maintainer_count"),
        F.size("d.versions").alias("version_count"),
        F.array_sort(F.map_keys(F.coalesce("v.dependencies", F.create_map().cast("map<string,string>")))).alias("dependency_names"),
        scripts.alias("install_scripts"),
        F.col("v.dist.tarball").alias("dist_url"),
        F.col("v.dist.integrity").alias("integrity"),
    )


def npm_dependencies(documents: DataFrame) -> DataFrame:
    """name, version, dependency, range; runtime dependencies only."""
    rows = documents.select(F.from_json("text", NPM).alias("d")).select("d.name", F.explode("d.versions").alias("version", "v"))
    return rows.select("name", "version", F.explode("v.dependencies").alias("dependency", "range"))


def resolve_npm(requests: DataFrame, versions: DataFrame, tags: DataFrame) -> DataFrame:
    """name, spec, version: by tag, exact text, range, or else the latest; null for other protocols.

    versions: name, version; tags: name, tag, version.
    """
    from ..functions import versions as V

    by_tag = tags.select("name", F.col("tag").alias("spec"), F.col("version").alias("tagged"))
    latest = tags.where("tag = 'latest'").select("name", F.col("version").alias("latest"))
    asked = requests.select("name", "spec").distinct()
    hits = asked.join(merging(versions), "name").groupBy("name", "spec").agg(
        F.max(F.when(F.col("version") == F.trim("spec"), F.col("version"))).alias("exact"),
        F.max_by("version", F.when(V.satisfies(F.col("version"), F.col("spec")), V.version_key(F.col("version")))).alias("ranged"),
    )
    out = asked.join(merging(by_tag), ["name", "spec"], "left").join(merging(hits), ["name", "spec"], "left").join(merging(latest), "name", "left")
    foreign = F.col("spec").rlike(r"^(git|file|link|http|https|workspace|npm|github):|^git\+")
    return out.select("name", "spec", F.when(~foreign, F.coalesce("tagged", "exact", "ranged", F.when(F.trim("spec").isin("", "latest"), F.col("latest")))).alias("version"))


def pypi_metadata(documents: DataFrame) -> DataFrame:
    """One row per project and release, with its chosen file."""
    d = documents.select(F.from_json("text", PYPI).alias("d")).where("d.info.name IS NOT NULL").select("d", F.explode("d.releases").alias("version", "files"))
    urls = F.map_entries(F.coalesce("d.info.project_urls", F.create_map().cast("map<string,string>")))
    labelled = F.filter(urls, lambda e: F.lower(e["key"]).rlike("source|repository|code|github"))
    home = F.when(F.col("d.info.home_page").rlike(r"github|gitlab|bitbucket"), F.col("d.info.home_page"))
    return d.select(
        F.lit("pypi").alias("ecosystem"),
        F.lower("d.info.name").alias("name"),
        "version",
        F.col("d.info.summary").alias("description"),
        F.coalesce(F.get(labelled, F.lit(0))["value"], home).alias("repository_url"),
        F.when(F.coalesce(F.nullif("d.info.author", F.lit("")), F.nullif("d.info.maintainer", F.lit(""))).isNotNull(), 1).otherwise(0).alias("maintainer_count"),
        F.size("d.releases").alias("version_count"),
        runtime_names(F.col("d.info.requires_dist")).alias("dependency_names"),
        chosen_file(F.col("files")).alias("dist"),
    )


def chosen_file(files: Column) -> Column:
    """The source archive, else a pure wheel, else any wheel, else the first file."""
    rank = lambda f: F.when(f["packagetype"] == "sdist", 0).when(F.endswith(f["filename"], F.lit("-none-any.whl")), 1).when(f["packagetype"] == "bdist_wheel", 2).otherwise(3)
    ranked = F.transform(files, lambda f, i: F.struct(rank(f).alias("rank"), i.alias("i"), f.alias("file")))
    return F.get(F.array_sort(ranked, lambda a, b: (a["rank"] * 100_000 + a["i"]) - (b["rank"] * 100_000 + b["i"])), F.lit(0))["file"]


def runtime_names(requires: Column) -> Column:
    """Names of requirements without an extra marker."""
    plain = F.filter(F.coalesce(requires, F.array().cast("array<string>")), lambda r: ~r.rlike(r";.*\bextra\b"))
    return F.array_distinct(F.transform(plain, lambda r: F.lower(F.regexp_extract(r, r"^\s*([A-Za-z0-9._\-]+)", 1))))


def import_names(top_level: DataFrame, paths: DataFrame, curated: DataFrame, distributions: DataFrame) -> DataFrame:
    """distribution, modules: what top_level.txt lists or the layout shows, what is curated, else the name itself."""
    listed = top_level.groupBy("distribution").agg(F.collect_set("module").alias("listed"))
    head = F.split("path", "/")
    module = F.when(F.size(head) == 1, F.regexp_extract("path", r"^([A-Za-z_]\w*)\.py$", 1)).when(head[F.size(head) - 1] == "__init__.py", head[0])
    layout = paths.select("distribution", module.alias("module")).where("module <> '' AND module IS NOT NULL").groupBy("distribution").agg(F.collect_set("module").alias("layout"))
    known = curated.groupBy("distribution").agg(F.collect_set("module").alias("curated"))
    none = F.array().cast("array<string>")
    out = distributions.select("distribution").distinct().join(listed, "distribution", "left").join(layout, "distribution", "left").join(known, "distribution", "left")
    found = F.array_union(F.coalesce("listed", "layout", none), F.coalesce("curated", none))
    return out.select("distribution", F.array_sort(F.when(F.size(found) > 0, found).otherwise(F.array(F.replace("distribution", F.lit("-"), F.lit("_"))))).alias("modules"))


def fresh(snapshots: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cached documents within their time to live, the newest for each digest of the request."""
    live = snapshots.where(F.col("fetched_at") >= now - F.expr(f"INTERVAL {days} DAYS"))
    return live.groupBy(F.sha2(F.concat_ws("\n", "method", "url", F.coalesce("body", F.lit(""))), 256).alias("key")).agg(F.max_by(F.struct("url", "content", "fetched_at"), "fetched_at").alias("d")).select("key", "d.*")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """text of every stored registry document below a folder, one row a file, through Spark's own reader."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("value").alias("text"))
