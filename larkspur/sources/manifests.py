"""Dependency manifests as rows: requirements files, package.json, lock files, pyproject."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name, extras, operator and version, marker.
REQUIREMENT = r"^([A-Za-z0-9][A-Za-z0-9._\-]*)\s*(\[[^\]]*\])?\s*([^;]*?)\s*(;.*)?$"
REQUIREMENTS = "project string, name string, spec string, kind string"


def requirements_lines(files: DataFrame) -> DataFrame:
    """project, name, spec, kind of each requirement line; `kind` is locked for ==, warning for VCS or URL lines.

    files: project, text. Continued lines are joined, comments and option lines left out.
    """
    joined = F.regexp_replace("text", r"\\\r?\n", " ")
    line = F.trim(F.regexp_replace(F.col("line"), r"(^|\s)#.*$", ""))
    rows = files.select("project", F.explode(F.split(joined, r"\r?\n")).alias("line")).select("project", line.alias("line")).where("line <> '' AND NOT startswith(line, '-')")
    part = lambda i: F.regexp_extract("line", REQUIREMENT, i)
    remote = F.col("line").rlike(r"^(git|hg|svn|bzr)\+|://")
    spec = F.regexp_replace(part(3), r"\s+", "")
    return rows.select(
        "project",
        F.when(remote, F.col("line")).otherwise(F.lower(part(1))).alias("name"),
        F.when(remote, F.lit("")).otherwise(spec).alias("spec"),
        F.when(remote, "warning").when(spec.rlike(r"^==[^*,]+$"), "locked").otherwise("runtime").alias("kind"),
    ).where("name <> ''")


def _entries(text: Column, key: str) -> Column:
    kind = f"struct<{key}:map<string,string>>"
    return F.map_entries(F.coalesce(F.from_json(text, kind)[key], F.create_map().cast("map<string,string>")))


def package_json(files: DataFrame) -> DataFrame:
    """project, name, spec, kind from package.json texts; peers are warnings."""
    kinds = [("dependencies", "runtime"), ("optionalDependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "warning")]

    def tagged(kind: str):
        return lambda e: F.struct(e["key"].alias("name"), e["value"].alias("spec"), F.lit(kind).alias("kind"))

    all_ = F.concat(*[F.transform(_entries(F.col("text"), k), tagged(kind)) for k, kind in kinds])
    return files.select("project", F.explode(all_).alias("d")).select("project", "d.*")


def lock_name(path: Column) -> Column:
    """The package a lock file's install path names: what follows the last node_modules/."""
    return F.regexp_extract(path, r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1)


def package_lock(files: DataFrame) -> DataFrame:
    """project, name, version, kind of every install path of a lock file; links are left out.

    Versions 2 and 3 list paths in `packages`; without it, as in version 1, the nested
    `dependencies` are read at any depth.
    """
    entry = "struct<version:string,dev:boolean,devOptional:boolean,link:boolean>"
    packages = F.from_json("text", f"struct<packages:map<string,{entry}>>")["packages"]
    rows = files.select("project", F.explode(F.map_entries(packages)).alias("e")).where("e.key <> '' AND NOT coalesce(e.value.link, false)")
    dev = F.coalesce("e.value.dev", F.lit(False)) | F.coalesce("e.value.devOptional", F.lit(False))
    flat = rows.select("project", lock_name(F.col("e.key")).alias("name"), F.col("e.value.version").alias("version"), F.when(dev, "dev").otherwise("locked").alias("kind"))
    nested = files.where(packages.isNull() | (F.size(packages) == 0)).select("project", "text").mapInPandas(_nested, "project string, name string, version string, kind string")
    return flat.unionByName(nested).distinct()


def _nested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of the `dependencies` trees; unreadable texts give none."""
    for batch in batches:
        out = []
        for project, text in zip(batch["project"], batch["text"], strict=True):
            try:
                todo = [json.loads(text or "")]
            except (ValueError, RecursionError):
                continue
            while todo:
                node = todo.pop()
                found = node.get("dependencies") if isinstance(node, dict) else None
                for name, entry in found.items() if isinstance(found, dict) else ():
                    if isinstance(entry, dict):
                        version = entry.get("version")
                        dev = entry.get("dev") is True or entry.get("devOptional") is True
                        out.append((project, name, version if isinstance(version, str) else None, "dev" if dev else "locked"))
                        todo.append(entry)
        yield pd.DataFrame(out, columns=["project", "name", "version", "kind"], dtype=object)


def pyproject(files: DataFrame) -> DataFrame:
    """project, name, spec, kind from pyproject texts, standard and Poetry tables; unreadable ones give none."""

    def rows(text: str) -> list[tuple[str, str, str]]:
        try:
            doc = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            return []
        out = []
        for line in doc.get("project", {}).get("dependencies", []):
            name = line.split(";")[0].strip()
            cut = next((i for i, c in enumerate(name) if not (c.isalnum() or c in "-_.")), len(name))
            out.append((name[:cut].lower(), name[cut:].split("]")[-1].replace(" ", ""), "runtime"))
        poetry = doc.get("tool", {}).get("poetry", {})
        for table, kind in (("dependencies", "runtime"), ("dev-dependencies", "dev")):
            for name, spec in poetry.get(table, {}).items():
                if name.lower() != "python":
                    out.append((name.lower(), spec if isinstance(spec, str) else str(spec.get("version", "")), kind))
        return out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(batch["project"], batch["text"], strict=True) for r in rows(t)], columns=["project", "name", "spec", "kind"])

    return files.select("project", "text").mapInPandas(work, REQUIREMENTS)


def merged(requirements: DataFrame) -> DataFrame:
    """One spec per project and name; locked before runtime before dev."""
    order = F.when(F.col("kind") == "locked", 0).when(F.col("kind") == "runtime", 1).otherwise(2)
    return requirements.where("kind <> 'warning'").groupBy("project", "name").agg(F.min_by(F.struct("spec", "kind"), F.struct(order, "spec")).alias("b")).select("project", "name", "b.*")


#: The manifests of a project's top folder, the preferred one of each ecosystem first.
PREFERRED = {"npm": ["package-lock.json", "package.json"], "pypi": ["requirements.txt", "pyproject.toml"]}


def kind_of(path: Column) -> Column:
    """Which reader a manifest of this name has; null where it has none."""
    name = F.element_at(F.split(path, "/"), -1)
    lower = F.lower(name)
    return (
        F.when(name.isin(*[n for names in PREFERRED.values() for n in names]), name)
        .when(F.endswith(name, F.lit(".txt")) & F.contains(lower, F.lit("require")), "requirements.txt")
        .when(F.endswith(name, F.lit(".json")), F.when(F.contains(name, F.lit("lock")), "package-lock.json").otherwise("package.json"))
        .when(F.endswith(name, F.lit(".toml")), "pyproject.toml")
    )


def preferred(files: DataFrame) -> DataFrame:
    """Of each project and ecosystem the one manifest in its top folder that says most about what is installed. files: project, path, text."""
    rank = F.create_map(*[x for names in PREFERRED.values() for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    ecosystem = F.create_map(*[x for e, names in PREFERRED.items() for n in names for x in (F.lit(n), F.lit(e))])
    top = files.withColumn("ecosystem", ecosystem[F.col("path")]).where("ecosystem IS NOT NULL")
    return top.groupBy("project", "ecosystem").agg(F.min_by(F.struct("path", "text"), rank[F.col("path")]).alias("m")).select("project", "ecosystem", "m.*")
