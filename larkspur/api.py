"""Entry points: analyse packages, scan projects, compare releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import cut, merging, spread
from .functions import text as T
from .operators import diffs, features, names, signals
from .sources import javascript, manifests, python_ast

# Suffixes by language.
PYTHON, SCRIPT = r"\.pyi?$", r"\.(js|mjs|cjs|jsx)$"
_FILE = ["package", "path"]


def sources(files: DataFrame) -> DataFrame:
    """The files that are analysed: of a known language, not below vendored, test or documentation folders; any number, of any size.

    package, path, language and the key of the file's text.
    """
    return _read(files).select(*_FILE, "language", "key")


def _read(files: DataFrame) -> DataFrame:
    """Sources with language and key: files of one key differ in nothing that an analysis of one file looks at."""
    path = F.lower("path")
    language = F.when(path.rlike(PYTHON), "python").when(path.rlike(SCRIPT), "javascript")
    name = F.when(F.col("path").rlike(python_ast.SETUP), "/setup.py").otherwise("")
    return files.where(features.is_source()).withColumn("language", language).withColumn("key", F.concat(F.sha2("text", 256), F.lit("."), "language", name))


def texts(files: DataFrame) -> DataFrame:
    """path (the key), source, language: each different source once, written, however many packages carry it."""
    return spread(cut(_read(files).select(F.col("key").alias("path"), F.col("text").alias("source"), "language").distinct()))


def raised(found: DataFrame) -> DataFrame:
    """path (the key) and what is raised there, as a list of code, key and line; written. found: texts()."""
    whole = found.select("path", F.explode(signals.file_codes(F.col("source"), F.col("language") == "python")).alias("c"), F.lit(0).alias("line"))
    scripts = found.where("language = 'javascript'")
    every = python_ast.code_signals(python_ast.facts(found.where("language = 'python'")))
    every = every.unionByName(javascript.code_signals(scripts, cut(javascript.facts(scripts)))).unionByName(signals.once(whole))
    return cut(every.groupBy("path").agg(F.collect_list(F.struct("code", "key", "line")).alias("raised")))


def install_files(files: DataFrame, hooks: DataFrame | None) -> DataFrame:
    """package, path of the files that run at installation: setup.py, and scripts that a lifecycle command names by path or by name."""
    name = F.element_at(F.split("path", "/"), -1)
    setup = files.where(name == "setup.py").select(*_FILE)
    if hooks is None:
        return setup
    said = F.transform(F.regexp_extract_all("command", F.lit(r"([\w./\\-]+\.(?:js|cjs|mjs))\b"), 1), lambda x: F.translate(F.regexp_replace(x, r"^[./]+", ""), "\\", "/"))
    named = hooks.select("package", F.explode(said).alias("said")).distinct()
    scripts = files.select(*_FILE, F.explode(F.array_distinct(F.array("path", name))).alias("said")).join(merging(named), ["package", "said"]).select(*_FILE)
    return setup.unionByName(scripts).distinct()


def analyse(files: DataFrame, hooks: DataFrame | None = None, metadata: DataFrame | None = None, candidates: DataFrame | None = None, popular: DataFrame | None = None) -> DataFrame:
    """All signals of packages: package, path, code, key, line; one row for each that counts.

    files: package, path, text; hooks: package, command of a lifecycle hook; metadata:
    package, repository_url, age_days, version_count, description; candidates and
    popular: names for look-alikes. Calls, literals and flows come from the syntax,
    so comments raise nothing; what a whole file shows comes from its text. A text that
    many files have is analysed once, and its signals are handed to them.
    """
    kept = sources(files)
    there = kept.join(merging(raised(texts(files)).withColumnRenamed("path", "key")), "key").select(*_FILE, F.explode("raised").alias("c"))
    found = cut(there.groupBy(*_FILE, "c.code", "c.key").agg(F.min("c.line").alias("line")))
    both = signals.composites(found, install_files(kept, hooks), _FILE)
    out = found.unionByName(both.select(*_FILE, "code", F.lit("").alias("key"), F.lit(0).alias("line")))
    add = lambda rows: out.unionByName(rows.select("package", F.lit(None).cast("string").alias("path"), "code", F.lit("").alias("key"), F.lit(0).alias("line")))
    if hooks is not None:
        out = add(hooks.select("package", F.explode(T.hook_signals(F.col("command"))).alias("code")))
    if metadata is not None:
        none = files.sparkSession.createDataFrame([], "package string, command string")
        out = add(features.metadata_signals(metadata, files, none if hooks is None else hooks))
    if candidates is not None and popular is not None:
        kind = F.when(F.col("kind") == "homoglyph", "TYPOSQUAT_HOMOGLYPH").when(F.col("kind") == "scope", "TYPOSQUAT_SCOPE_CONFUSION").otherwise("TYPOSQUAT_NEAR_MISS")
        out = add(names.typosquats(candidates, popular).select(F.col("candidate").alias("package"), kind.alias("code")))
    return out


def failed(files: DataFrame) -> DataFrame:
    """package, path of the sources that don't parse."""
    found = texts(files)
    rows = python_ast.facts(found.where("language = 'python'")).select("path", "kind").unionByName(javascript.facts(found.where("language = 'javascript'")).select("path", "kind"))
    broken = rows.where("kind = 'parse_failed'").select(F.col("path").alias("key")).distinct()
    return sources(files).join(merging(broken), "key", "left_semi").select(*_FILE).distinct()


def score(files: DataFrame, candidates: DataFrame | None = None, popular: DataFrame | None = None, hooks: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """package, score, verdict of every package; without any signal the score is 0."""
    raised = analyse(files, hooks, metadata, candidates, popular)
    scores = signals.rules_score(raised).select("package", "score")
    out = files.select("package").distinct().join(merging(scores), "package", "left").na.fill(0.0, ["score"])
    return out.withColumn("verdict", signals.verdict(F.col("score")))


def scan_manifests(files: DataFrame) -> DataFrame:
    """Requirements of all manifests of projects, each by the reader of its name. files: project, path, text."""
    read = {"package.json": manifests.package_json, "requirements.txt": manifests.requirements_lines, "pyproject.toml": manifests.pyproject, "package-lock.json": manifests.package_lock}
    named = files.withColumn("__kind", manifests.kind_of(F.col("path")))
    found = [f(named.where(F.col("__kind") == kind).select("project", "text")).toDF("project", "name", "spec", "kind") for kind, f in read.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return manifests.merged(out)


def compare(spark: SparkSession, old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed files of two releases; old and new: path, content."""
    side = lambda d: d.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))
    return diffs.ordered(diffs.changes(side(old), side(new)))
