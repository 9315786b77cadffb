"""Merkle manifests: trees of digests over rows, coordinate lookup proofs and their folding.

Every row is a leaf of its tree (a source, say). Within a tree the leaves have an
order; while a level has more than one node, every GROUP consecutive ones, the last run
with fewer, become the hash of their digests in hexadecimal. The tops of the trees,
ordered by tree, are the leaves of one more tree, whose top is the root.

The nodes are a table (tree, level, idx, digest). A leaf works out from its index and
the number of leaves which coordinates its siblings have, explodes them, joins the node
table, orders what it finds and folds it. BAND levels are looked up at once; above them a
node of the last of these levels stands for all leaves below it, so that the upper part of
a proof is looked up once for GROUP ** BAND leaves and handed down. So no key of a join
has more than a few dozen rows, however large a tree is.

Defined cases: rows that agree in order and leaf are interchangeable; null keys of a
tree's order come first; an empty table has no root and gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, tree_key, written

#: Nodes of a run.
GROUP = 3
#: Levels of one lookup.
BAND = 4

_STEP = "struct<left: string, right: string>"


def digest_of(fields: list[Column]) -> Column:
    """SHA-256 of fields, each `-` if null, else its bytes in UTF-8, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _runs(n: Column, size: int) -> Column:
    """The number of runs of `size` that n nodes make."""
    return F.floor((n + (size - 1)) / size)


def _hashed(nodes: Column) -> Column:
    """The level above an array of nodes."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / GROUP).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * GROUP + 1, F.lit(GROUP)), ""), 256))


@dataclass
class Trees:
    """bands: for each lookup its first level, its lowest nodes (tree, idx, n) and the node table of its levels; tops: tree, level, digest."""

    bands: list[tuple[int, DataFrame, DataFrame]]
    tops: DataFrame | None


def build(leaves: DataFrame) -> Trees:
    """leaves: tree, idx, n, digest. Every band is one aggregation of GROUP ** BAND nodes a row, and is written."""
    wide = GROUP**BAND
    base, low = leaves.select("tree", "idx", "n", "digest"), 0
    bands: list[tuple[int, DataFrame, DataFrame]] = []
    tops = None
    while True:
        blocks = base.groupBy("tree", F.floor(F.col("idx") / wide).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("sorted"))
        blocks = blocks.withColumn("l0", F.transform("sorted", lambda x: x["digest"])).drop("sorted")
        for j in range(1, BAND + 1):
            level = _hashed(F.col(f"l{j - 1}"))
            blocks = blocks.withColumn(f"l{j}", F.when(_runs(F.col("n"), GROUP ** (j - 1)) > 1, level))
        node = lambda j: lambda d, i: F.struct(F.lit(low + j).alias("level"), (F.col("block") * GROUP ** (BAND - j) + i).alias("idx"), _runs(F.col("n"), GROUP**j).alias("n"), d.alias("digest"))
        levels = [F.coalesce(F.transform(f"l{j}", node(j)), F.array().cast("array<struct<level: int, idx: bigint, n: bigint, digest: string>>")) for j in range(BAND + 1)]
        nodes = written(blocks.select("tree", F.explode(F.flatten(F.array(*levels))).alias("x")).select("tree", "x.*"), "merkle-nodes")
        bands.append((low, nodes.where(F.col("level") == low).select("tree", "idx", "n"), nodes))
        found = nodes.where("n = 1").select("tree", "level", "digest")
        tops = found if tops is None else tops.unionByName(found)
        base, low = nodes.where((F.col("level") == low + BAND) & (F.col("n") > 1)), low + BAND
        if base.isEmpty():
            return Trees(bands, tops)


def _lookup(low: int, base: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, idx, steps: what stands left and right of each base node's line, for the levels of one band."""
    many = lambda j: _runs(F.col("n"), GROUP**j)
    own = lambda j: F.floor(F.col("idx") / GROUP**j)
    coordinates = []
    for j in range(BAND):
        for m in range(GROUP):
            at = F.floor(own(j) / GROUP) * GROUP + m
            coordinates.append(F.when((at != own(j)) & (at < many(j)), F.struct(F.lit(low + j).alias("level"), at.alias("at"))))
    wanted = base.select("tree", "idx", "n", F.explode_outer(F.array_compact(F.array(*coordinates))).alias("c")).select("tree", "idx", "n", "c.level", "c.at")
    found = wanted.join(nodes.select("tree", "level", F.col("idx").alias("at"), "digest"), ["tree", "level", "at"], "left")
    lined = found.groupBy("tree", "idx", "n").agg(F.sort_array(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("level", "at", "digest")))).alias("siblings"))
    side = lambda j, keep: F.array_join(F.transform(F.filter("siblings", lambda x: (x["level"] == low + j) & keep(x["at"])), lambda x: x["digest"]), "")
    steps = [F.when(many(j) > 1, F.struct(side(j, lambda at: at < own(j)).alias("left"), side(j, lambda at: at > own(j)).alias("right"))) for j in range(BAND)]
    return lined.select("tree", "idx", F.array_compact(F.array(*steps)).alias("steps"))


def paths(trees: Trees, above: DataFrame) -> DataFrame:
    """tree, idx, steps and what else `above` holds, for every leaf: its proof from the leaf up.

    above: tree, steps from the tree's top on, and further columns that every leaf of the tree is given.
    """
    wide = GROUP**BAND
    last = F.greatest(F.lit(0), F.floor((F.col("level") - 1) / BAND))
    crown = above.join(trees.tops.select("tree", last.alias("__band")), "tree")
    handed = None
    for band in reversed(range(len(trees.bands))):
        here = crown.where(F.col("__band") == band).drop("__band").withColumn("idx", F.lit(0).cast("long"))
        handed = here if handed is None else handed.unionByName(here)
        upper = handed.withColumnsRenamed({"idx": "__up", "steps": "__rest"})
        own = _lookup(*trees.bands[band]).withColumn("__up", F.floor(F.col("idx") / wide))
        handed = own.join(upper, ["tree", "__up"]).withColumn("steps", F.concat("steps", "__rest")).drop("__up", "__rest")
        if band:
            handed = written(handed, "merkle-paths")
    return handed


def prove(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows: tree (a key without nulls), leaf, and what else they hold. Adds subroot, root and steps, each row's proof."""
    placed = written(numbered(rows, [*order, "leaf"]), "merkle-leaves")
    trees = build(placed.withColumn("digest", F.col("leaf")))
    tops = written(trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "merkle-tops")
    tops = written(numbered(tops, ["name"]), "merkle-sources")
    upper = build(tops)
    nothing = F.array().cast(f"array<{_STEP}>")
    over = paths(upper, upper.tops.select("tree", F.col("digest").alias("root"), nothing.alias("steps")))
    above = over.join(tops, ["tree", "idx"]).select(F.col("name").alias("tree"), "steps", "root", F.col("digest").alias("subroot"))
    proofs = paths(trees, written(above, "merkle-above"))
    return placed.join(proofs, ["tree", "idx"]).drop("idx", "n", "row")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf gives with the siblings of its proof."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of a proof's siblings, from left to right, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def documents_manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tree, n_siblings of each row of documents.

    Leaves are digests of doc_id, source, lang, n_chars and text; trees are sources, null a source like
    any other. `changed` gives the text that is to be verified, the documents' own by default; null takes its
    own. Siblings are those of the unchanged documents.
    """
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    other = F.lit(None).cast("string") if changed is None else F.when(~changed.eqNullSafe(text), digest_of([*rest, changed]))
    leaves = written(docs.select("doc_id", tree_key(F.col("source")).alias("tree"), digest_of([*rest, text]).alias("leaf"), other.alias("shown")), "merkle-rows")
    proved = prove(leaves, ["doc_id"])
    out = proved.withColumn("folded_root", folded(F.coalesce("shown", "leaf"), F.col("steps")))
    siblings = F.aggregate("steps", F.lit(0).cast("long"), lambda acc, s: acc + F.length(s["left"]) + F.length(s["right"])) / 64
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.size("steps").alias("levels"), siblings.cast("long").alias("n_siblings"))
