"""Dependency graphs and package lists from lock files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Packages of a scan, at most.
MAX_PACKAGES = 750


def graph(pinned: DataFrame, requirements: DataFrame, include_dev: bool = False, limit: int = MAX_PACKAGES) -> DataFrame:
    """project, name, version, depth, is_direct, requested, truncated of the packages that a lock file pins.

    pinned: project, name, version, kind (locked or dev); requirements: project, name,
    spec. A flat lock file tells no depth, so it is 0; direct are those that the
    manifest names. Beyond `limit` packages, by name, a project is cut and marked.
    """
    use = pinned.where("kind = 'locked'" if not include_dev else "kind IN ('locked', 'dev')")
    # A development entry of the same name comes later and replaces the other.
    one = use.groupBy("project", "name").agg(F.max_by("version", F.struct((F.col("kind") == "dev").cast("int"), "version")).alias("version"))
    asked = requirements.groupBy("project", F.lower("name").alias("__name")).agg(F.min("spec").alias("requested"))
    out = one.withColumn("__name", F.lower("name")).join(asked, ["project", "__name"], "left").drop("__name")
    by = Window.partitionBy("project").orderBy("name")
    out = out.withColumn("__place", F.row_number().over(by)).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy("project")) > limit)
    return out.where(F.col("__place") <= limit).select("project", "name", "version", F.lit(0).alias("depth"), F.col("requested").isNotNull().alias("is_direct"), "requested", "truncated")


def package_list(files: DataFrame) -> DataFrame:
    """The distinct ecosystem, name, version that the install paths of lock files name; links and paths without a version aside. files: text."""
    entry = F.from_json("text", "struct<packages:map<string,struct<version:string,link:boolean>>>")["packages"]
    rows = files.select(F.explode(F.map_entries(entry)).alias("e")).select("e.key", "e.value.version", F.coalesce("e.value.link", F.lit(False)).alias("link"))
    good = rows.where("key LIKE '%node_modules/%' AND NOT link AND coalesce(version, '') <> ''")
    return good.select(F.lit("npm").alias("ecosystem"), F.substring_index("key", "node_modules/", -1).alias("name"), "version").distinct()


def shallowest(nodes: DataFrame, limit: int, key: str = "scan") -> DataFrame:
    """Of each scan the `limit` packages with the least depth, ties by name. nodes: scan, name, depth."""
    by = Window.partitionBy(key).orderBy("depth", "name")
    return nodes.withColumn("__place", F.row_number().over(by)).where(F.col("__place") <= limit).drop("__place")


def views(nodes: DataFrame, key: str = "project") -> DataFrame:
    """Of each graph its size, direct and transitive packages, and greatest depth. nodes: is_direct, depth."""
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("packages"), F.count_if("is_direct").alias("direct"), F.count_if(~F.col("is_direct")).alias("transitive"), F.max("depth").alias("max_depth"))
