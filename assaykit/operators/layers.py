"""Layers by what files do: those with routes are the interface, those that ask a database the data, and
what lies between them on a path of imports is service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions import text as T
from assaykit.functions.storage import checkpoints
from assaykit.operators import code, graph, joins


def evidence(lines: DataFrame) -> DataFrame:
    """(path, layer): files with a route, or with a query; a file with both is the interface. lines: path,
    language, line_no, line."""
    routes = code.routes(lines.select("path", "line_no", "line")).select("path", F.lit(0).alias("rank"))
    queries = lines.where(F.coalesce(code.by_language(F.col("language"), "query_calls", F.col("line")), F.lit(False))).select("path", F.lit(1).alias("rank"))
    return routes.unionAll(queries).groupBy("path").agg(F.min("rank").alias("rank")).select("path", F.when(F.col("rank") == 0, "api").otherwise("data").alias("layer"))


def by_behaviour(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(path, layer): known layers, and service for files that the interface reaches and that reach the
    data. Two searches over the edges (src, dst), each as long as the longest path that it takes."""
    checkpoints(edges.sparkSession)
    known = known.checkpoint()
    start = lambda layer: known.where(F.col("layer") == layer).select(F.col("path").alias("node"))
    from_api = graph.distances(edges, start("api")).select("node")
    to_data = graph.distances(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start("data")).select("node")
    between = from_api.join(to_data, "node", "left_semi").join(known.select(F.col("path").alias("node")), "node", "left_anti")
    return known.unionAll(between.select(F.col("node").alias("path"), F.lit("service").alias("layer")))


def units(layers: DataFrame, manifests: DataFrame) -> DataFrame:
    """(unit, files): the deepest directories with a manifest above files of the interface."""
    dirs = manifests.select(T.parent(F.col("path")).alias("__dir")).distinct()
    up = layers.where("layer = 'api'").select("path", F.explode(T.ancestors(F.col("path"))).alias("__dir")).join(dirs, "__dir")
    return up.groupBy("path").agg(F.max_by("__dir", F.length("__dir")).alias("unit")).groupBy("unit").agg(F.count("*").alias("files"))


def request_paths(edges: DataFrame, layers: DataFrame, routes: DataFrame, most: int = 20) -> DataFrame:
    """(path, line_no, way): for each route whether its file reaches the data by way of others (chain),
    asks for it itself (direct) or does neither (none); the first so many in this order, then by place."""
    data = layers.where("layer = 'data'").select(F.col("path").alias("node"))
    back = graph.distances(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), data).select(F.col("node").alias("path"), "depth")
    rows = routes.select("path", "line_no").join(back, "path", "left")
    way = F.when(F.col("depth") > 0, "chain").when(F.col("depth") == 0, "direct").otherwise("none")
    rank = F.when(F.col("depth") > 0, 0).when(F.col("depth") == 0, 1).otherwise(2)
    return rows.select("path", "line_no", way.alias("way"), rank.alias("rank")).orderBy("rank", "path", "line_no").limit(most).drop("rank")


def stack(manifests: DataFrame, detection: DataFrame) -> DataFrame:
    """(framework, path): frameworks whose package a manifest (path, text) names. detection: framework,
    package."""
    words = manifests.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[@A-Za-z0-9_./-]+"), F.lit(0)))).alias("package"))
    return words.join(detection, "package").groupBy("framework").agg(F.min("path").alias("path"))


def imports_of(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges of import lines to the files that own the imported name; owners: name, dst."""
    return joins.token_lines(lines, owners.select(F.col("name").alias("token"), F.col("dst").alias("owner"))).select(F.col("path").alias("src"), F.col("owner").alias("dst")).distinct()
