"""Look-alike package names: variants, an index of stretches for near misses and a weighted distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import patterns as P

KINDS = ["scope", "homoglyph", "separator", "affix", "near_miss"]


def bare(name: Column) -> Column:
    """Lower case, without a scope."""
    return F.regexp_replace(F.lower(F.trim(name)), "^@[^/]+/", "")


def separator_variants(name: Column) -> Column:
    return F.array_distinct(F.array(F.regexp_replace(name, r"[-_.]", ""), F.replace(name, F.lit("-"), F.lit("_")), F.replace(name, F.lit("_"), F.lit("-")), F.replace(name, F.lit("."), F.lit("-"))))


def homoglyph_variants(name: Column) -> Column:
    """Names with one confusable character or pair in another's place."""
    places = F.sequence(F.lit(1), F.char_length(name))
    swap = F.create_map(*[F.lit(x) for pair in P.LOOKALIKES for x in pair])
    single = F.filter(F.transform(places, lambda i: F.concat(F.substring(name, F.lit(1), i - 1), swap[F.substring(name, i, F.lit(1))], F.substring(name, i + 1, F.char_length(name)))), lambda v: v.isNotNull())

    def once(old: str, new: str) -> Column:
        at = F.locate(old, name)
        return F.when(at > 0, F.concat(F.substring(name, F.lit(1), at - 1), F.lit(new), F.substring(name, at + len(old), F.char_length(name))))

    pairs = F.array_compact(F.array(*[once(*p) for a, b in P.LOOKALIKE_PAIRS for p in ((a, b), (b, a))]))
    return F.when(F.char_length(name) > 0, F.array_distinct(F.concat(single, pairs))).otherwise(F.array().cast("array<string>"))


def affix_variants(name: Column) -> Column:
    added = [F.concat(name, F.lit(sep + a)) for a in P.AFFIXES for sep in ("", "-")]
    cut = [F.when(F.endswith(name, F.lit(a)) & (F.char_length(name) > len(a) + 2), F.regexp_replace(F.substring(name, F.lit(1), F.char_length(name) - len(a)), r"[-._]+$", "")) for a in P.AFFIXES]
    return F.filter(F.array_distinct(F.array_compact(F.array(*added, *cut))), lambda v: v != "")


def weighted_distance(a: str, b: str, ceiling: float) -> float:
    """Edits with neighbouring keys and transpositions at 0.6; ceiling + 1 as soon as it must exceed ceiling."""
    if abs(len(a) - len(b)) > ceiling:
        return ceiling + 1
    rows = [[float(j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            swap = 0.0 if x == y else 0.6 if y in P.NEIGHBOURS.get(x, "") else 1.0
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + swap)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 0.6)
            row.append(best)
        rows.append(row)
        # A transposition reaches back two rows.
        if min(row) > ceiling and min(rows[-2]) > ceiling:
            return ceiling + 1
    return rows[-1][-1] if rows[-1][-1] <= ceiling else ceiling + 1


@F.pandas_udf(DoubleType())
def weighted_dl(a: pd.Series, b: pd.Series, ceiling: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x or "", y or "", c) for x, y, c in zip(a, b, ceiling, strict=True)])


def variant_matches(candidates: DataFrame, popular: DataFrame) -> DataFrame:
    """candidate, target, kind, distance: generated variants that are popular names, by hash join."""
    name = F.col("bare")
    c = candidates.select(F.col("name").alias("candidate"), bare(F.col("name")).alias("bare")).where(F.char_length("bare") >= 3)
    tag = lambda variants, kind, d: F.transform(variants, lambda v: F.struct(v.alias("target"), F.lit(kind).alias("kind"), F.lit(d).alias("distance")))
    scope = F.when(F.startswith("candidate", F.lit("@")), F.array(name)).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(tag(scope, "scope", 0.0), tag(homoglyph_variants(name), "homoglyph", 0.5), tag(separator_variants(name), "separator", 0.5), tag(affix_variants(name), "affix", 1.0))
    rows = c.select("candidate", "bare", F.explode(all_).alias("v")).select("candidate", "bare", "v.*").where((F.col("target") != F.col("bare")) | (F.col("kind") == "scope"))
    return rows.join(popular.select(F.col("name").alias("target")).distinct(), "target").select("candidate", "target", "kind", "distance").distinct()


def _segments(name: Column, size: Column, parts: int) -> Column:
    """The name's cut into `parts` stretches of like length: place and text of each."""
    limit = lambda i: F.floor(size * i / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("i"), F.substring(name, limit(i) + 1, limit(i + 1) - limit(i)).alias("text")))


def signature_pairs(candidates: DataFrame, popular: DataFrame, parts: int, edits: int, band: int) -> DataFrame:
    """bare, target: different names, of lengths that differ by at most `band`, that share one of the target's stretches in its place.

    A target is cut into `parts` stretches. Fewer edits than that, each in one stretch, leave one of them as it is, moved by what
    was inserted less what was deleted before it, so by no more than `edits` allow. The candidate's stretches of these lengths at these
    places are looked up by equality with length, number and text. candidates: bare; popular: name.
    """
    p = popular.select(F.col("name").alias("target")).distinct().withColumn("size", F.char_length("target"))
    index = p.select("target", "size", F.explode(_segments(F.col("target"), F.col("size"), parts)).alias("s")).select("target", "size", "s.i", "s.text")
    length, half = F.char_length("bare"), lambda n: F.floor(n / 2).cast("int")
    limit = lambda size, i: F.floor(size * i / parts).cast("int")

    def stretch(longer: Column, i: Column, moved: Column) -> Column:
        size = length - longer
        begin, wide = limit(size, i) + 1 + moved, limit(size, i + 1) - limit(size, i)
        inside = (size > 0) & (begin >= 1) & (begin + wide - 1 <= length)
        return F.when(inside, F.struct(size.alias("size"), i.alias("i"), F.substring(F.col("bare"), begin, wide).alias("text")))

    # longer: the candidate's length less the target's; moved: by how much a stretch may have moved then
    moves = lambda longer, i: F.transform(F.sequence(-half(edits - longer), half(edits + longer)), lambda moved: stretch(longer, i, moved))
    places = lambda longer: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: moves(longer, i)))
    keys = F.flatten(F.transform(F.sequence(F.lit(-band), F.lit(band)), places))
    c = candidates.select("bare").distinct()
    asked = c.select("bare", F.explode(F.array_distinct(F.array_compact(keys))).alias("k")).select("bare", "k.*")
    return asked.join(index, ["size", "i", "text"]).where("bare <> target").select("bare", "target").distinct()


def within_band(candidates: DataFrame, popular: DataFrame, band: int, edits: int) -> DataFrame:
    """candidates with target and edits: pairs of different names whose lengths differ by at most `band` and plain edits by at most `edits`.

    candidates: bare and more; popular: name. Pairs come from shared stretches, one more than there may be edits.
    """
    close = signature_pairs(candidates, popular, edits + 1, edits, min(band, edits)).withColumn("edits", F.levenshtein("bare", "target", edits))
    return candidates.join(close.where("edits >= 0"), "bare")


#: The least costs of an edit that keeps the length and of one that changes it, in tenths; shorter popular names have no near misses.
KEEPING, CHANGING, LEAST_TARGET = 6, 10, 5


def near_misses(candidates: DataFrame, popular: DataFrame, band: int = 3, ceiling: float = 2.0) -> DataFrame:
    """Popular names whose length differs by at most `band` and whose weighted distance is at most `ceiling`.

    What the ceiling allows is either edits that keep the length, or one less of them for an edit that changes it; an edit, a
    transposition too, lies in two stretches of a name at most. So names that can pass share one of twice as many stretches and one.
    """
    tenths = int(ceiling * 10 + 1e-9)
    c = candidates.select(F.col("name").alias("candidate"), bare(F.col("name")).alias("bare")).where(F.char_length("bare") >= 3)
    p = popular.where(F.char_length("name") >= LEAST_TARGET)
    pairs = signature_pairs(c, p, 2 * (tenths // KEEPING) + 1, 0, 0)
    if tenths >= CHANGING:
        edits = 1 + (tenths - CHANGING) // KEEPING
        pairs = pairs.unionByName(signature_pairs(c, p, 2 * edits + 1, edits, min(band, tenths // CHANGING))).distinct()
    # plain edits, which Spark counts itself, leave few for the weighted ones; a transposition is two of them
    pairs = pairs.where(F.levenshtein("bare", "target", 2 * (tenths // KEEPING)) >= 0)
    scored = pairs.withColumn("distance", weighted_dl("bare", "target", F.lit(ceiling))).where((F.col("distance") <= ceiling) & (F.col("distance") > 0))
    return c.join(scored, "bare").select("candidate", "target", F.lit("near_miss").alias("kind"), "distance")


def typosquats(candidates: DataFrame, popular: DataFrame) -> DataFrame:
    """The closest resemblance of each name that is not popular itself: by kind, distance, target."""
    known = popular.select(F.lower(F.trim("name")).alias("known")).distinct()
    unknown = candidates.join(known, F.lower(F.trim(candidates["name"])) == known["known"], "left_anti")
    found = variant_matches(unknown, popular).unionByName(near_misses(unknown, popular))
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    by = Window.partitionBy("candidate").orderBy(order[F.col("kind")], "distance", "target")
    return found.withColumn("place", F.row_number().over(by)).where("place = 1").drop("place")


def popular_list(found: list[DataFrame], fallback: DataFrame) -> DataFrame:
    """The distinct names of several sources and the fallback. Each has name."""
    out = fallback.select("name")
    for f in found:
        out = out.unionByName(f.select("name"))
    return out.where("name IS NOT NULL AND name <> ''").distinct()
