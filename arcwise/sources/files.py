"""Readers and writers of edge lists, labels, alignments, embeddings and citation files.

All reading goes through Spark, so any store that Spark reads will do; only
NumPy archives, which Spark cannot split, are opened whole from their bytes.
"""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, canonical_flow, canonical_mean, drop_loops, symmetrize, unweighted


def sniff_header(spark: SparkSession, path: str) -> tuple[int | None, str | None]:
    """(number of nodes, comment character) of a first line `%N` or `#N`, else (None, None)."""
    first = spark.read.text(path).limit(1).select(F.regexp_extract("value", r"^\s*([%#])\s*(\d+)", 1).alias("c"), F.regexp_extract("value", r"^\s*[%#]\s*(\d+)", 1).alias("n")).first()
    return (int(first["n"]), first["c"]) if first is not None and first["c"] else (None, None)


def _columns(spark: SparkSession, path: str, filetype: str) -> DataFrame:
    """Data lines of a text file as an array column v of doubles and strings."""
    split = r"\s+" if filetype in ("tsv", "edgelist") else r"\s*,\s*"
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([%#].*)?$"))
    return lines.select(F.split(F.trim("value"), split).alias("v"))


def read_edges(
    spark: SparkSession, path: str, filetype: str = "csv", weighted: bool | None = None, canonical: bool = False, symmetrical: bool = False, num_nodes: int | None = None, remove_loops: bool = True
) -> Graph:
    """A graph from csv, txt (comma), tsv, edgelist (white space) or parquet: src, dst[, w].

    Weighting follows the number of columns unless told. Canonical averages
    repeated undirected edges, symmetrical then adds the other direction.
    Nodes are 0..num_nodes-1, from the argument, the header or the largest id.
    """
    if filetype == "parquet":
        raw = spark.read.parquet(path)
        names = raw.columns
        edges = raw.select(F.col(names[0]).cast("long").alias("src"), F.col(names[1]).cast("long").alias("dst"), (F.col(names[2]).cast("double") if len(names) > 2 else F.lit(1.0)).alias("w"))
        has = len(names) > 2
    elif filetype in ("csv", "txt", "tsv", "edgelist"):
        if num_nodes is None:
            num_nodes = sniff_header(spark, path)[0]
        rows = _columns(spark, path, filetype)
        edges = rows.select(F.get("v", F.lit(0)).cast("long").alias("src"), F.get("v", F.lit(1)).cast("long").alias("dst"), F.coalesce(F.get("v", F.lit(2)).cast("double"), F.lit(1.0)).alias("w"))
        has = rows.where(F.size("v") > 2).limit(1).count() > 0
    else:
        raise ValueError(f"file type {filetype!r}")
    if weighted and not has:
        raise ValueError("no weight column")
    if weighted is False:
        edges = unweighted(edges)
    if remove_loops:
        edges = drop_loops(edges)
    if canonical:
        edges = canonical_mean(edges)
        if symmetrical:
            edges = symmetrize(edges, "mean")
    if num_nodes is None:
        num_nodes = (edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or -1) + 1
    return Graph(edges, spark.range(num_nodes), directed=not canonical)


def read_flow(spark: SparkSession, path: str, filetype: str = "csv") -> DataFrame:
    """Canonical (src, dst, flow, cnt, w) of a file whose third column is a flow."""
    rows = _columns(spark, path, filetype) if filetype != "parquet" else spark.read.parquet(path).select(F.array("*").cast("array<string>").alias("v"))
    edges = rows.select(F.get("v", F.lit(0)).cast("long").alias("src"), F.get("v", F.lit(1)).cast("long").alias("dst"), F.get("v", F.lit(2)).cast("double").alias("flow"), F.lit(1).alias("cnt"), F.lit(1.0).alias("w"))
    return canonical_flow(drop_loops(edges))


def read_npz(spark: SparkSession, path: str) -> Graph:
    """A graph archive: edge_index (m x 2 or 2 x m) or edges_index, optional edge_attr, x, num_nodes, directed."""
    raw = spark.read.format("binaryFile").load(path).first()["content"]
    z = np.load(io.BytesIO(bytes(raw)))
    e = z["edge_index"] if "edge_index" in z else z["edges_index"] if "edges_index" in z else None
    if e is None:
        raise ValueError("no edges")
    if e.shape[1] != 2:
        e = e.T
    w = np.asarray(z["edge_attr"], "f8").reshape(len(e), -1)[:, 0] if "edge_attr" in z else np.ones(len(e))
    x = np.asarray(z["x"], "f8") if "x" in z else None
    n = int(z["num_nodes"]) if "num_nodes" in z else len(x) if x is not None else int(e.max()) + 1 if len(e) else 0
    edges = spark.createDataFrame(pd.DataFrame({"src": e[:, 0].astype("i8"), "dst": e[:, 1].astype("i8"), "w": w}), "src long, dst long, w double")
    nodes = spark.range(n) if x is None else spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": list(x)}), "id long, x array<double>")
    return Graph(edges, nodes, bool(z["directed"]) if "directed" in z else False)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of a JSON map {"id": class}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("id", "label")).select(F.col("id").cast("long"), "label")


def read_multilabels(spark: SparkSession, path: str) -> DataFrame:
    """(id, labels) of lines `id l1,l2`."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v"))
    return rows.select(F.get("v", F.lit(0)).cast("long").alias("id"), F.array_sort(F.array_distinct(F.split(F.get("v", F.lit(1)), ","))).alias("labels"))


def read_alignment(spark: SparkSession, path: str) -> tuple[int, int, DataFrame]:
    """(n1, n2, pairs g2, g1) of a file with header `%n1::n2`."""
    head = spark.read.text(path).limit(1).first()[0]
    n1, n2 = map(int, head.lstrip("%").split("::"))
    rows = _columns(spark, path, "csv")
    return n1, n2, rows.select(F.get("v", F.lit(0)).cast("long").alias("g2"), F.get("v", F.lit(1)).cast("long").alias("g1"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, emb) of word2vec text: a `n d` line, then `id x1 .. xd`."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") > 2)
    return rows.select(F.get("v", F.lit(0)).cast("long").alias("id"), F.transform(F.slice("v", 2, 1 << 30), lambda x: x.cast("double")).alias("emb"))


def index_names(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(src, dst string, w) as ids from 1: (id, name) by name order, and the edges by id."""
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    ids = names.withColumn("id", F.row_number().over(Window.orderBy("name")).cast("long"))
    a, b = ids.select(F.col("name").alias("src"), F.col("id").alias("_s")), ids.select(F.col("name").alias("dst"), F.col("id").alias("_d"))
    return ids.select("id", "name"), edges.join(a, "src").join(b, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "w")


def citation_edges(spark: SparkSession, path: str, venue: str | None = None) -> DataFrame:
    """(src, dst) of blank-line separated records: #index id, #c venue, #% cited id."""
    block = spark.read.option("lineSep", "\n\n").text(path)
    if venue is not None:
        block = block.where(F.regexp_extract("value", r"(?m)^#c\s*(.*)$", 1).contains(venue))
    return block.select(F.regexp_extract("value", r"#index\s*(\S+)", 1).alias("src"), F.explode(F.regexp_extract_all("value", F.lit(r"#%\s*(\S+)"), 1)).alias("dst")).where("src <> ''")


def reference_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of JSON lines {id, references}, kept where the cited id is listed too."""
    rows = spark.read.schema("id string, references array<string>").json(path)
    edges = rows.select(F.col("id").alias("src"), F.explode("references").alias("dst"))
    return edges.join(rows.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


# ---- sinks -----------------------------------------------------------------


def _lines(df: DataFrame, path: str, header: str | None = None) -> None:
    """A text folder of column value; the header is the first line of the first file."""
    if header is not None:
        first = df.sparkSession.createDataFrame([(0, header)], "k int, value string")
        df = first.unionByName(df.select(F.lit(1).alias("k"), "value")).repartitionByRange("k").sortWithinPartitions("k").select("value")
    df.write.text(path)


def write_csv(graph: Graph, path: str, num_nodes: int | None = None, weighted: bool = True) -> None:
    """Comma-separated edges, with a `%N` line if the number of nodes is given."""
    cols = ["src", "dst", *(["w"] if weighted else [])]
    _lines(graph.edges.select(F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("value")), path, f"%{num_nodes}" if num_nodes is not None else None)


def write_graph(graph: Graph, path: str) -> None:
    """The at-rest form: Parquet of edges and nodes."""
    graph.edges.write.parquet(f"{path}/edges")
    graph.nodes.write.parquet(f"{path}/nodes")


def read_graph(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    return Graph(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/nodes"), directed)


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Lines `src d1 d2 ...`, neighbours ascending."""
    rows = edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("d"))
    rows.select(F.concat_ws(" ", F.col("src").cast("string"), F.array_join(F.col("d").cast("array<string>"), " ")).alias("value")).write.text(path)


def write_one_based(edges: DataFrame, path: str) -> None:
    """Lines `src+1 dst+1 1`."""
    edges.select(F.concat_ws(" ", (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"), F.lit("1")).alias("value")).write.text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """word2vec text of (id, emb)."""
    n, d = vectors.agg(F.count(F.lit(1)), F.max(F.size("emb"))).first()
    _lines(vectors.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.col("emb").cast("array<string>"), " ")).alias("value")), path, f"{n} {d or 0}")


def write_alignment(pairs: DataFrame, path: str, n1: int, n2: int) -> None:
    _lines(pairs.select(F.concat_ws(",", F.col("g2").cast("string"), F.col("g1").cast("string")).alias("value")), path, f"%{n1}::{n2}")


# ---- catalog ---------------------------------------------------------------

FILE_TYPES = {"csv", "txt", "tsv", "edgelist", "parquet", "npz"}


def build_catalog(entries: list[dict]) -> dict[str, dict]:
    """Dataset metadata by name; missing keys, unknown file types and repeated names are errors."""
    out: dict[str, dict] = {}
    for e in entries:
        for key in ("name", "graph_file", "file_info", "graph_info"):
            if key not in e:
                raise ValueError(f"{e.get('name', '?')}: no {key}")
        if e["file_info"].get("filetype") not in FILE_TYPES:
            raise ValueError(f"{e['name']}: file type {e['file_info'].get('filetype')!r}")
        for key in ("num_nodes", "weights", "directed"):
            if key not in e["graph_info"]:
                raise ValueError(f"{e['name']}: no graph_info.{key}")
        if e["name"] in out:
            raise ValueError(f"{e['name']} twice")
        out[e["name"]] = e
    return out


def load_graph(spark: SparkSession, catalog: dict[str, dict], name: str, root: str = "", as_undirected: bool = False, as_unweighted: bool = False, keep_loops: bool = False) -> Graph:
    """A catalogued graph under rewrite flags; an unknown name is a KeyError."""
    e = catalog[name]
    path = f"{root}/{e['graph_file']}" if root else e["graph_file"]
    if e["file_info"]["filetype"] == "npz":
        g = read_npz(spark, path)
    else:
        g = read_edges(spark, path, e["file_info"]["filetype"], None if e["graph_info"]["weights"] else False, False, False, e["graph_info"]["num_nodes"], not keep_loops)
        g = Graph(g.edges, g.nodes, e["graph_info"]["directed"])
    if as_unweighted:
        g = g.with_edges(unweighted(g.edges))
    if as_undirected or not g.directed:
        g = Graph(symmetrize(canonical_mean(g.edges), "mean"), g.nodes, False)
    return g


def catalog_json(catalog: dict[str, dict]) -> str:
    return json.dumps(catalog, indent=1, sort_keys=True)
