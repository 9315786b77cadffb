"""Metadata from what a package ships: package.json, PKG-INFO and METADATA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import HOOKS

_JSON = "struct<description:string,license:string,homepage:string,repository:string,scripts:map<string,string>,dependencies:map<string,string>>"


def shallowest_file(files: DataFrame, names: list[str]) -> DataFrame:
    """package, text of the file of one of the names, an earlier name first, then with the fewest folders, then by path."""
    name = F.element_at(F.split("path", "/"), -1)
    place = F.array_position(F.array(*map(F.lit, names)), name)
    depth = F.char_length("path") - F.char_length(F.replace("path", F.lit("/")))
    return files.where(name.isin(names)).groupBy("package").agg(F.min_by("text", F.struct(place, depth, "path")).alias("text"))


def _url(repository: Column) -> Column:
    """The text itself, or the url of an object; null for anything empty."""
    return F.nullif(F.when(F.startswith(repository, F.lit("{")), F.get_json_object(repository, "$.url")).otherwise(repository), F.lit(""))


def npm(files: DataFrame) -> DataFrame:
    """Metadata of npm packages from their package.json. files: package, path, text; unreadable documents give nulls."""
    d = shallowest_file(files, ["package.json"]).select("package", F.from_json("text", _JSON).alias("d"))
    none = F.create_map().cast("map<string,string>")
    return d.select(
        "package",
        F.col("d.description").alias("description"),
        _url(F.col("d.repository")).alias("repository_url"),
        F.col("d.license").alias("license"),
        F.col("d.homepage").alias("homepage"),
        F.map_filter(F.coalesce("d.scripts", none), lambda k, v: k.isin(HOOKS) & v.isNotNull() & (v != "")).alias("install_scripts"),
        F.array_sort(F.map_keys(F.coalesce("d.dependencies", none))).alias("dependency_names"),
    )


def pypi(files: DataFrame) -> DataFrame:
    """Metadata of PyPI packages from PKG-INFO, or else METADATA: of a repeated header the last, of project URLs the first that is a source."""
    d = shallowest_file(files, ["PKG-INFO", "METADATA"]).withColumn("lines", F.split("text", r"\r?\n"))

    def header(name: str) -> Column:
        found = F.filter("lines", lambda x: F.startswith(x, F.lit(f"{name}:")))
        return F.transform(found, lambda x: F.trim(F.substring(x, F.lit(len(name) + 2), F.char_length(x))))

    last = lambda name: F.nullif(F.element_at(F.concat(F.array(F.lit("")), header(name)), -1), F.lit(""))
    source = F.get(F.filter(header("Project-URL"), lambda u: F.lower(u).rlike("source|repository|github")), F.lit(0))
    return d.select(
        "package", last("Summary").alias("description"), source.alias("repository_url"), last("License").alias("license"), last("Home-page").alias("homepage"),
        F.create_map().cast("map<string,string>").alias("install_scripts"), F.array().cast("array<string>").alias("dependency_names"),
    )


def hooks(metadata: DataFrame) -> DataFrame:
    """package, hook, command of the lifecycle commands."""
    return metadata.select("package", F.explode("install_scripts").alias("hook", "command"))
