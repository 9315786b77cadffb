"""Signals of source files: text checks, composites, collapse, rules score, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import merging
from ..functions import patterns as P
from ..functions import text as T

#: Harmonic numbers are added up term by term to here.
TERMS = 2000
CATALOGUE = "code string, family string, severity string, weight double, rank int"


def catalogue(spark: SparkSession) -> DataFrame:
    """The 39 signal types; a fixed table."""
    return spark.createDataFrame([(*s, P.SEVERITY_RANK[s[2]]) for s in P.SIGNALS], CATALOGUE)


def text_checks(text: Column, lowered: Column | None = None) -> dict[str, Column]:
    """Code -> condition, for what can be seen in a file's text. lowered: the text in lower case."""
    hex_, uni = T.escapes(text)
    size = F.char_length(text)
    return {
        "SENSITIVE_PATH_ACCESS": T.holds_any(text, P.SENSITIVE_PATHS, lowered),
        "CRYPTO_WALLET_ACCESS": T.holds_any(text, P.CRYPTO_WALLETS, lowered),
        "FILE_WRITE_SENSITIVE": T.holds_any(text, P.PERSISTENCE, lowered),
        "SUSPICIOUS_ENDPOINT": T.holds_any(text, P.ENDPOINTS, lowered),
        "HARDCODED_IP_ENDPOINT": F.size(T.public_addresses(text)) > 0,
        "REVERSE_SHELL_PATTERN": T.holds_any(text, P.REVERSE_SHELLS, lowered),
        "HOST_RECON": T.holds_any(text, P.HOST_RECON, lowered),
        "BASE64_BLOB": F.size(T.base64_blobs(text)) > 0,
        "HEX_ESCAPE_HEAVY": (hex_ + uni > 60) & ((4 * hex_ + 6 * uni) / size > 0.15),
        "MINIFIED_SOURCE": T.minified(text),
        "ENV_ACCESS": text.rlike(r"os\.environ|os\.getenv|process\.env"),
        "NETWORK_ACCESS": text.rlike(r"urlopen|requests\.|https?://|fetch\("),
    }


def scan(files: DataFrame, package: str, path: str, text: str) -> DataFrame:
    """package, path, code: one row per file and code raised, composites included."""
    checks = text_checks(F.col(text), F.col("__lowered"))
    flags = files.withColumn("__lowered", F.lower(text)).select(F.col(package).alias("package"), F.col(path).alias("path"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()])
    on = F.col
    sensitive = on("SENSITIVE_PATH_ACCESS") | on("CRYPTO_WALLET_ACCESS")
    credentials = sensitive & on("NETWORK_ACCESS")
    composites = {
        "EXFIL_CREDENTIALS_TO_NETWORK": credentials,
        "EXFIL_ENV_TO_NETWORK": on("ENV_ACCESS") & on("NETWORK_ACCESS") & on("HOST_RECON") & ~credentials,
    }
    raised = F.array_compact(F.array(*[F.when(on(k), F.lit(k)) for k in checks], *[F.when(c, F.lit(k)) for k, c in composites.items()]))
    return flags.select("package", "path", F.explode(raised).alias("code"))


_CODES = "array<struct<code:string,key:string>>"


def _keyed(code: str, numbers: Column) -> Column:
    return F.transform(numbers, lambda i: F.struct(F.lit(code).alias("code"), i.cast("string").alias("key")))


def _one(code: str, condition: Column, key: str = "") -> Column:
    return F.when(condition, F.array(F.struct(F.lit(code).alias("code"), F.lit(key).alias("key")))).otherwise(F.array().cast(_CODES))


def literal_codes(text: Column, http: bool = False) -> Column:
    """code and key of what a string literal shows, all of it; the key is the number of the pattern.

    http: a literal that begins with http counts as an address even without ://.
    """
    address = F.contains(text, F.lit("://")) | (F.char_length(text) - F.char_length(F.replace(text, F.lit("."))) == 3)
    if http:
        address = address | F.startswith(text, F.lit("http"))
    return F.concat(
        _keyed("SENSITIVE_PATH_ACCESS", T.numbers(text, P.SENSITIVE_PATHS)),
        _keyed("CRYPTO_WALLET_ACCESS", T.numbers(text, P.CRYPTO_WALLETS)),
        _keyed("SUSPICIOUS_ENDPOINT", T.numbers(text, P.ENDPOINTS)),
        _keyed("FILE_WRITE_SENSITIVE", T.numbers(text, P.PERSISTENCE)),
        _one("HARDCODED_IP_ENDPOINT", address & (F.size(T.public_addresses(text)) > 0)),
        _one("HIGH_ENTROPY_STRING", T.encoded_payload(text)),
    )


def once(rows: DataFrame) -> DataFrame:
    """path, code, key and the first line of each; rows: path, line, c with code and key."""
    return rows.groupBy("path", "c.code", "c.key").agg(F.min("line").alias("line"))


def file_codes(text: Column, python: Column) -> Column:
    """code and key of what a source's text shows, comments and all."""
    hex_, uni = T.escapes(text)
    return F.concat(
        _one("MINIFIED_SOURCE", T.minified(text)),
        _one("BASE64_BLOB", F.size(T.base64_blobs(text)) > 0),
        _one("HEX_ESCAPE_HEAVY", (hex_ + uni > 60) & ((4 * hex_ + 6 * uni) / F.char_length(text) > 0.15)),
        _one("CHARCODE_OBFUSCATION", python & (F.regexp_count(text, F.lit(r"chr\(")) >= 10), "text"),
        _one("HOST_RECON", T.holds_any(text, P.HOST_RECON), "text"),
        _one("REVERSE_SHELL_PATTERN", T.holds_any(text, P.REVERSE_SHELLS)),
    )


def composites(signals: DataFrame, at_install: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code of behaviours that come together in a file.

    signals: keys and code; at_install: keys of the files that run when the package
    is installed. One aggregation by file, whatever the number of its signals.
    """
    any_of = lambda *codes: F.bool_or(F.col("code").isin(*codes))
    flags = signals.groupBy(*keys).agg(
        any_of("SENSITIVE_PATH_ACCESS", "CRYPTO_WALLET_ACCESS").alias("secrets"),
        any_of("NETWORK_ACCESS", "DNS_EXFIL_PATTERN", "SUSPICIOUS_ENDPOINT", "HARDCODED_IP_ENDPOINT").alias("network"),
        any_of("ENV_ACCESS").alias("env"),
        any_of("HOST_RECON").alias("recon"),
    ).join(merging(at_install.select(*keys, F.lit(True).alias("install")).distinct()), keys, "left")
    on, install = F.col, F.coalesce("install", F.lit(False))
    rules = [
        ("EXFIL_CREDENTIALS_TO_NETWORK", on("secrets") & on("network")),
        ("EXFIL_ENV_TO_NETWORK", on("env") & on("network") & (on("recon") | install) & ~on("secrets")),
        ("EXFIL_ON_INSTALL", install & on("network") & (on("env") | on("secrets") | on("recon"))),
    ]
    return flags.select(*keys, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules]))).alias("code"))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; above TERMS by its expansion, whose error is below 1e-16 there."""
    terms = F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(TERMS).cast("long")))
    added = F.aggregate(terms, F.lit(0.0), lambda s, k: s + 1.0 / k)
    x = n.cast("double")
    return F.when(n <= TERMS, added).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x))


def rules_score(signals: DataFrame, key: str = "package") -> DataFrame:
    """Sum over each code's occurrences of weight / its rank, squashed. One row per package with a signal.

    The n-th occurrence counts weight / n, so a code's share depends on its count
    alone: occurrences are counted before the shuffle, not ranked after it.
    """
    spark = signals.sparkSession
    counted = signals.groupBy(key, "code").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(catalogue(spark)), "code")
    raw = counted.groupBy(key).agg(F.sum(F.col("weight") * harmonic(F.col("n"))).alias("raw"), F.sum("n").alias("signals"), F.count(F.lit(1)).alias("codes"), F.max("rank").alias("worst"))
    return raw.withColumn("score", 1 / (1 + F.exp(-(F.col("raw") - P.SCORE_MIDPOINT) / P.SCORE_SCALE)))


def verdict(score: Column) -> Column:
    return F.when(score >= P.MALICIOUS, "malicious").when(score >= P.SUSPICIOUS, "suspicious").otherwise("benign")


def collapse(signals: DataFrame, key: str = "package", limit: int = 12) -> DataFrame:
    """One row per code with its occurrences and first path; the `limit` worst of each package."""
    cat = F.broadcast(catalogue(signals.sparkSession).select("code", "severity", "rank"))
    one = signals.groupBy(key, "code").agg(F.count(F.lit(1)).alias("occurrences"), F.min("path").alias("first_path")).join(cat, "code")
    by = Window.partitionBy(key).orderBy(F.col("rank").desc(), F.col("occurrences").desc(), "code")
    return one.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit)


def feature_vector(signals: DataFrame, files: DataFrame, package: str, text: str) -> DataFrame:
    """Counts, severities and structure of each package, as log1p or ratios."""
    cat = F.broadcast(catalogue(signals.sparkSession).select("code", "rank"))
    codes = sorted(text_checks(F.lit("")).keys())
    count = lambda c: F.log1p(F.count_if(c).cast("double"))
    by_code = signals.join(cat, "code").groupBy("package").agg(
        *[count(F.col("code") == c).alias(c.lower()) for c in codes],
        *[count(F.col("rank") == r).alias(f"{n}_signals") for n, r in (("critical", 4), ("high", 3), ("medium", 2))],
        F.log1p(F.count(F.lit(1)).cast("double")).alias("total_signals"),
        F.log1p(F.count_distinct("code").cast("double")).alias("distinct_signal_types"),
    )
    shape = files.groupBy(F.col(package).alias("package")).agg(
        F.log1p(F.count(F.lit(1)).cast("double")).alias("file_count"),
        F.log1p(F.sum(F.char_length(text)).cast("double")).alias("total_bytes"),
        F.log1p(F.avg(F.char_length(text))).alias("avg_file_bytes"),
        F.avg(T.minified(F.col(text)).cast("double")).alias("minified_ratio"),
        F.log1p(F.max(F.array_max(T.line_lengths(F.col(text)))).cast("double")).alias("max_line_length"),
    )
    names = [c for c in by_code.columns if c != "package"]
    return shape.join(by_code, "package", "left").na.fill(0.0, names)
