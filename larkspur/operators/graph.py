"""Closures, proof paths, components and entry points over edge tables."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import cut as _cut


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth: what each root reaches over (src, dst), with the least number of steps.

    Breadth first: a level is joined with the edges once and what is known already
    leaves by anti-join, so cycles end. Without max_depth it goes on until no level has a new node.
    """
    edges = edges.select("src", "dst").distinct()
    frontier = _cut(roots.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    levels = [frontier]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(_all(levels).select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        levels = _merged([*levels, frontier])
    return _all(levels)


def _all(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _merged(levels: list[DataFrame], most: int = 8) -> list[DataFrame]:
    """The levels as they are, so that each is written once; if there are many, as one."""
    return levels if len(levels) < most else [_cut(_all(levels))]


def merged_dependencies(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """node, depth, is_direct, required_by: over all roots, the least depth and the sorted parents."""
    nodes = reached.where("depth > 0").groupBy("node").agg(F.min("depth").alias("depth"))
    inside = reached.select("node").distinct()
    parents = edges.join(inside, edges["src"] == inside["node"], "left_semi").groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("required_by"))
    return nodes.join(parents, "node").withColumn("is_direct", F.col("depth") == 1)


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no other node imports; all of them if every one is imported."""
    free = nodes.select("node").distinct().join(edges.where("src <> dst").select(F.col("dst").alias("node")), "node", "left_anti")
    return nodes.select("node").distinct() if free.isEmpty() else free


def proof_paths(edges: DataFrame, roots: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """target, hops, path: a shortest path from any root to each target, the least by its text.

    Each node keeps one path, so a level holds as many rows as it has new nodes. Without
    max_depth it goes on until no level has any.
    """
    edges = edges.select("src", "dst").distinct()
    frontier = _cut(roots.select("node").distinct().withColumn("path", F.array(F.col("node").cast("string"))))
    levels = [frontier]
    for _ in count() if max_depth is None else range(max_depth):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node"), F.array_append("path", F.col("dst").cast("string")).alias("path"))
        frontier = _cut(step.groupBy("node").agg(F.min("path").alias("path")).join(_all(levels).select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        levels = _merged([*levels, frontier])
    found = targets.select("node").distinct().join(_all(levels), "node")
    return found.select(F.col("node").alias("target"), (F.size("path") - 1).alias("hops"), F.array_join("path", " > ").alias("path"))


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v. Each node's neighbours are linked to its least one instead; a hub's many links meet one row, which the adaptive join may split."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pair = lambda a, b: F.struct(F.col(a).alias("u"), F.col(b).alias("v"))
        out = met.select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select("e.*")
    return _cut(out.where("u > v").distinct())


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component: the least node that undirected edges (src, dst) reach.

    Stars are contracted until nothing changes: each node's larger neighbours go to its least one, then the others do. It takes about
    as many rounds as the logarithm of the number of nodes, and no task holds a node's neighbours.
    """
    now = _cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        after = _stars(_stars(now, True), False)
        seen = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            break
        now, state = after, seen
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def rounded_key(vector: Column, places: int = 4) -> Column:
    """A vector as one text, its numbers rounded half to even; zero has no sign. Null where the vector or one of its numbers is."""
    text = F.transform(vector, lambda x: (F.bround(x.cast("double"), places) + F.lit(0.0)).cast("string"))
    return F.when(~F.exists(vector, lambda x: x.isNull()), F.array_join(text, ","))


def groups(rows: DataFrame, key: str, by: dict[str, Column]) -> DataFrame:
    """key, grp: rows that agree in one of several ways, directly or through others, are one group, named by its least key.

    by: ways to agree, such as the name and the rounded vector; null agrees with nothing. Rows and values are the two sides of a graph, so
    a value that most rows have gives each row one link, and none between rows. Keys are unique.
    """
    row = F.concat(F.lit("r"), F.col(key).cast("string"))
    values = F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"v{i}:"), F.sha2(c.cast("string"), 256))) for i, c in enumerate(by.values())]))
    links = rows.select(row.alias("src"), F.explode(values).alias("dst"))
    found = _cut(components(links, rows.select(row.alias("node"))).where(F.startswith("node", F.lit("r"))))
    named = found.join(rows.select(row.alias("node"), F.col(key)), "node")
    least = named.groupBy("component").agg(F.min(key).alias("grp"))
    return named.join(least, "component").select(key, "grp")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modules, functions, files, external targets, edges and entry points of a call graph.

    nodes: node, kind (module or function), path; edges: src, dst between nodes or to
    names that begin with ext:.
    """
    outside = F.startswith("dst", F.lit("ext:"))
    n = nodes.agg(F.count_if(F.col("kind") == "module").alias("modules"), F.count_if(F.col("kind") == "function").alias("functions"), F.count_distinct("path").alias("files"))
    e = edges.agg(F.count_distinct(F.when(outside, F.col("dst"))).alias("externals"), F.count(F.lit(1)).alias("edges"))
    modules = nodes.where("kind = 'module'").select("node")
    entries = entry_points(modules, edges.join(modules.withColumnRenamed("node", "dst"), "dst", "left_semi")).agg(F.count(F.lit(1)).alias("entry_points"))
    one = F.lit(1).alias("__one")
    return n.select("*", one).join(e.select("*", one), "__one").join(entries.select("*", one), "__one").drop("__one")


def importers(imports: DataFrame, limit: int = 8) -> DataFrame:
    """package, n, importers: the first `limit` files, in order, that import each package. imports: path, package.

    Only the first files of a package are gathered, so one that every file imports is no long list.
    """
    pairs = imports.where("package IS NOT NULL").select("package", "path").distinct()
    first = pairs.withColumn("__place", F.row_number().over(Window.partitionBy("package").orderBy("path"))).where(F.col("__place") <= limit)
    lists = first.groupBy("package").agg(F.array_sort(F.collect_list("path")).alias("importers"))
    return pairs.groupBy("package").agg(F.count(F.lit(1)).alias("n")).join(lists, "package")
