"""The full package vector: 58 columns in 11 groups, in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import merging
from ..functions import patterns as P
from ..functions import text as T
from . import signals as S

# Columns that are log1p of a code's count, by group.
COUNTS = {
    "install_execution": [
        ("install_hook_present", "INSTALL_HOOK_PRESENT"), ("install_hook_count", "INSTALL_HOOK_PRESENT"), ("install_hook_network", "INSTALL_HOOK_NETWORK"),
        ("install_hook_shell_pipe", "INSTALL_HOOK_SHELL_PIPE"), ("install_hook_obfuscated", "INSTALL_HOOK_OBFUSCATED"), ("setup_py_side_effects", "SETUP_PY_SIDE_EFFECTS"),
    ],
    "dynamic_execution": [("dynamic_eval", "DYNAMIC_EVAL"), ("decode_then_exec", "DECODE_THEN_EXEC"), ("dynamic_import", "DYNAMIC_IMPORT")],
    "process": [("process_spawn", "PROCESS_SPAWN"), ("shell_execution", "SHELL_TRUE"), ("reverse_shell", "REVERSE_SHELL_PATTERN")],
    "network": [("network_access", "NETWORK_ACCESS"), ("hardcoded_ip", "HARDCODED_IP_ENDPOINT"), ("suspicious_endpoint", "SUSPICIOUS_ENDPOINT"), ("dns_exfil", "DNS_EXFIL_PATTERN")],
    "credentials": [
        ("sensitive_path_access", "SENSITIVE_PATH_ACCESS"), ("crypto_wallet_access", "CRYPTO_WALLET_ACCESS"), ("env_access", "ENV_ACCESS"),
        ("env_bulk_harvest", "ENV_BULK_HARVEST"), ("file_write_sensitive", "FILE_WRITE_SENSITIVE"), ("host_recon", "HOST_RECON"),
    ],
    "obfuscation": [
        ("high_entropy_string", "HIGH_ENTROPY_STRING"), ("base64_blob", "BASE64_BLOB"), ("charcode_obfuscation", "CHARCODE_OBFUSCATION"),
        ("hex_escape_heavy", "HEX_ESCAPE_HEAVY"), ("string_array_decoder", "STRING_ARRAY_DECODER"),
    ],
    "exfiltration": [("exfil_env_to_network", "EXFIL_ENV_TO_NETWORK"), ("exfil_credentials_to_network", "EXFIL_CREDENTIALS_TO_NETWORK"), ("exfil_on_install", "EXFIL_ON_INSTALL")],
}
# The other columns, by group.
OTHERS = {
    "obfuscation": ["minified_ratio", "parse_failure_ratio", "max_line_length"],
    "metadata": ["has_repository", "age_days", "version_count", "maintainer_count", "description_length", "dependency_count", "is_single_version", "has_empty_description", "is_very_new"],
    "structure": ["file_count", "total_bytes", "source_file_count", "avg_file_bytes", "source_file_ratio", "tiny_package_with_hook"],
    "typosquat": ["typosquat_proximity", "typosquat_homoglyph", "typosquat_scope_confusion", "typosquat_affix"],
    "aggregate": ["critical_signals", "high_signals", "medium_signals", "total_signals", "distinct_signal_types", "rules_baseline_score"],
}
GROUPS = {g: [c for c, _ in COUNTS.get(g, [])] + OTHERS.get(g, []) for g in [*COUNTS, "metadata", "structure", "typosquat", "aggregate"]}
NAMES = [c for cols in GROUPS.values() for c in cols]
REGISTRY_ONLY = ["age_days", "version_count", "maintainer_count", "is_single_version", "is_very_new"]
SOURCE = r"\.(py|pyi|js|mjs|cjs|jsx)$"


def _log(c: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)))


def language(path: Column) -> Column:
    """python or javascript by a path's suffix, null for anything else."""
    return F.when(F.lower(path).rlike(r"\.pyi?$"), "python").when(F.lower(path).rlike(r"\.(js|mjs|cjs|jsx)$"), "javascript")


def age_days(published: Column, now: Column) -> Column:
    """Days from publication to now, with fractions; null where it is unknown."""
    return F.timestamp_diff("SECOND", published, now) / 86400.0


def is_source() -> Column:
    """Whether a file is one that the engine analyses. Columns: path, text."""
    path = F.lower("path")
    return F.coalesce(path.rlike(SOURCE) & ~path.rlike(P.SKIPPED_PATH) & F.col("text").isNotNull(), F.lit(False))


def metadata_signals(metadata: DataFrame, files: DataFrame, hooks: DataFrame) -> DataFrame:
    """package, code from what the registry says. hooks: package, command."""
    size = files.groupBy("package").agg(F.count_if(is_source()).alias("sources"), F.sum(F.octet_length("text")).alias("bytes"))
    hooked = hooks.where(F.trim("command") != "").select("package", F.lit(True).alias("hooked")).distinct()
    rows = metadata.join(merging(size), "package", "left").join(merging(hooked), "package", "left")
    rules = {
        "NO_REPOSITORY": F.col("repository_url").isNull(),
        "VERY_NEW_PACKAGE": F.col("age_days") < 7,
        "SINGLE_VERSION": F.col("version_count") == 1,
        "EMPTY_DESCRIPTION": F.trim(F.coalesce("description", F.lit(""))) == "",
        "TINY_PACKAGE_WITH_HOOK": F.col("hooked") & (F.col("sources") <= 3) & (F.col("bytes") < 20_000),
    }
    raised = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return rows.select("package", F.explode(raised).alias("code"))


def vector(signals: DataFrame, files: DataFrame, metadata: DataFrame, squats: DataFrame, failed: DataFrame) -> DataFrame:
    """package and the 58 columns.

    signals: package, code; files: package, path, text; metadata: package,
    repository_url, age_days, version_count, maintainer_count, description,
    dependency_count; squats: candidate, kind, distance; failed: package, path of
    sources that don't parse. Each input is aggregated by package before it is joined.
    """
    cat = F.broadcast(S.catalogue(signals.sparkSession).select("code", "rank"))
    counts = [(c, code) for cols in COUNTS.values() for c, code in cols]
    by_code = signals.join(cat, "code").groupBy("package").agg(
        *[_log(F.count_if(F.col("code") == code)).alias(c) for c, code in counts],
        *[_log(F.count_if(F.col("rank") == r)).alias(f"{n}_signals") for n, r in (("critical", 4), ("high", 3), ("medium", 2))],
        _log(F.count(F.lit(1))).alias("total_signals"),
        _log(F.count_distinct("code")).alias("distinct_signal_types"),
        F.bool_or(F.col("code").isin("INSTALL_HOOK_PRESENT", "SETUP_PY_SIDE_EFFECTS")).alias("__hooked"),
    )
    scores = S.rules_score(signals).select("package", F.col("score").alias("rules_baseline_score"))
    source = is_source()
    size = F.octet_length("text")
    shape = files.groupBy("package").agg(
        _log(F.count(F.lit(1))).alias("file_count"),
        _log(F.sum(size)).alias("total_bytes"),
        _log(F.count_if(source)).alias("source_file_count"),
        _log(F.avg(F.when(source, F.char_length("text")))).alias("avg_file_bytes"),
        (F.count_if(source) / F.count(F.lit(1))).alias("source_file_ratio"),
        F.avg(F.when(source, T.minified(F.col("text")).cast("double"))).alias("minified_ratio"),
        _log(F.max(F.when(source, F.array_max(T.line_lengths(F.col("text")))))).alias("max_line_length"),
        F.count_if(source).alias("__sources"),
        F.sum(size).alias("__bytes"),
    )
    broken = failed.groupBy("package").agg(F.count(F.lit(1)).alias("__failed"))
    known = metadata.groupBy("package").agg(*[F.max(c).alias(c) for c in ("repository_url", "age_days", "version_count", "maintainer_count", "description", "dependency_count")])
    about = known.select(
        "package",
        F.col("repository_url").isNotNull().cast("double").alias("has_repository"),
        _log(F.col("age_days")).alias("age_days"),
        _log(F.col("version_count")).alias("version_count"),
        _log(F.col("maintainer_count")).alias("maintainer_count"),
        _log(F.char_length("description")).alias("description_length"),
        _log(F.col("dependency_count")).alias("dependency_count"),
        (F.coalesce("version_count", F.lit(0)) <= 1).cast("double").alias("is_single_version"),
        (F.trim(F.coalesce("description", F.lit(""))) == "").cast("double").alias("has_empty_description"),
        F.coalesce(F.col("age_days") < 7, F.lit(False)).cast("double").alias("is_very_new"),
    )
    kind = lambda k: F.max((F.col("kind") == k).cast("double"))
    alike = squats.groupBy(F.col("candidate").alias("package")).agg(
        F.max(1 / (1 + F.col("distance"))).alias("typosquat_proximity"), kind("homoglyph").alias("typosquat_homoglyph"), kind("scope").alias("typosquat_scope_confusion"), F.max(F.col("kind").isin("affix", "separator").cast("double")).alias("typosquat_affix")
    )
    out = shape
    for part in (by_code, scores, about, alike, broken):
        out = out.join(merging(part), "package", "left")
    out = out.withColumn("parse_failure_ratio", F.coalesce(F.try_divide(F.col("__failed"), F.col("__sources")), F.lit(0.0)))
    out = out.withColumn("tiny_package_with_hook", (F.col("__hooked") & (F.col("__sources") <= 3) & (F.col("__bytes") < 20_000)).cast("double"))
    return out.select("package", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NAMES])


def without(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """The same width with some columns zeroed."""
    return vectors.withColumns({c: F.lit(0.0) for c in columns})
