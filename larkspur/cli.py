"""Command line: python -m larkspur.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, projects, report
from .sources import archives, registry, shipped, store

VERSION = "0.2"


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """package, path, text of the files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", r"^.*?" + root.strip("/").replace(".", r"\.") + "/", "")
    return found.select(F.lit(root.rstrip("/").rsplit("/", 1)[-1]).alias("package"), path.alias("path"), archives.text_of(F.col("content")).alias("text"))


def _show(df: DataFrame, report: str | None, title: str) -> None:
    if report:
        with open(report, "w", encoding="utf-8") as f:
            f.write(store.report(df, title))
    for row in df.orderBy(F.col("score").desc(), "package").limit(50).collect():
        print(f"{row['package']}\t{row['verdict']}\t{row['score']:.3f}")


def scan_project(spark: SparkSession, a: argparse.Namespace) -> None:
    _show(api.score(_files(spark, a.path, "*.{py,pyi,js,mjs,cjs,jsx}")), a.report, a.path)


def scan_manifest(spark: SparkSession, a: argparse.Namespace) -> None:
    folder, name = a.path.rsplit("/", 1) if "/" in a.path else (".", a.path)
    rows = spark.read.text(a.path, wholetext=True).select(F.lit(folder).alias("project"), F.lit(name).alias("path"), F.col("value").alias("text"))
    for row in api.scan_manifests(rows).orderBy("name").collect():
        print(f"{row['name']}\t{row['spec']}\t{row['kind']}")


def scan_package(spark: SparkSession, a: argparse.Namespace) -> None:
    files = archives.source_files(archives.read(spark, a.path))
    metadata = (shipped.npm if a.ecosystem == "npm" else shipped.pypi)(files)
    _show(api.score(files, hooks=shipped.hooks(metadata)), a.report, a.path)


def scan_sample(spark: SparkSession, a: argparse.Namespace) -> None:
    found = spark.read.format("binaryFile").load(a.path).select(F.col("path").alias("archive"), "content")
    _show(api.score(archives.source_files(archives.samples(found, a.password))), a.report, a.path)


def scan_tree(spark: SparkSession, a: argparse.Namespace) -> None:
    """A project from its manifest to ranked findings, with stored registry documents (folders npm and pypi) and advisories, one JSON file each."""
    name = a.path.rstrip("/").rsplit("/", 1)[-1]
    files = _files(spark, a.path, "*.{py,js,mjs,cjs,jsx,ts,tsx,json,txt,toml}").withColumnRenamed("package", "project")
    none = spark.createDataFrame([], "text string")
    stored = lambda folder: registry.snapshots(spark, folder) if folder else none
    known = projects.registry_tables(stored(f"{a.registry}/npm"), stored(f"{a.registry}/pypi"))
    documents = stored(a.advisories).select(F.coalesce(F.get_json_object("text", "$.id"), F.lit("UNKNOWN")).alias("id"), "text")
    found = projects.scan(files, known, None, documents)
    for row in found.findings.orderBy(*projects.ranked(found.findings)).limit(50).collect():
        print(f"{row['package']}\t{row['version']}\t{row['id']}\t{row['verdict']}\t{row['priority']:.1f}\t{row['fixed'] or ''}")
    for row in found.warnings.limit(15).collect():
        print(f"warning\t{row['warning']}")
    if a.report:
        with open(a.report, "w", encoding="utf-8") as f:
            f.write(report.page(found, name))


COMMANDS = {"scan-project": scan_project, "scan-tree": scan_tree, "scan-manifest": scan_manifest, "scan-package": scan_package, "scan-sample": scan_sample}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="larkspur")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    for name in COMMANDS:
        sub = commands.add_parser(name)
        sub.add_argument("path")
        sub.add_argument("--report", help="write an HTML page here")
        sub.add_argument("--ecosystem", choices=["npm", "pypi"], default="npm")
        sub.add_argument("--password", default="infected")
        sub.add_argument("--registry", help="folder of registry documents, npm and pypi below it")
        sub.add_argument("--advisories", help="folder of advisories")
    a = parser.parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    from .core import local_session

    COMMANDS[a.command](spark or local_session(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
