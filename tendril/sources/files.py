"""Files of graphs, images and neuron traces as DataFrames.

Spark lists and distributes the files (``binaryFile``), so any file system it knows works and
files are read in parallel, one task per group of files. Parsers are small generators.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.functions import labels as L
from tendril.functions import ordered as O

# Name patterns per kind of file.
GLOBS = {"tif": "*.{tif,tiff}", "am": "*.am", "hoc": "*.hoc"}
# Fixed value: content type that marks a spatial graph file.
GRAPH_CONTENT = "HxSpatialGraph"
ROWS_PER_BATCH = 50_000


def list_files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """``(path, length)`` of all files of a kind below a folder; none is an error.

    The contents column is pruned, so listing reads no data.
    """
    out = _binary(spark, folder, kind).select("path", "length")
    if out.isEmpty():
        raise FileNotFoundError(f"no {kind} files in {folder}")
    return out


def _binary(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", GLOBS[kind]).load(folder)


def file_per_step(files: DataFrame, with_object: bool = True) -> DataFrame:
    """``(path, obj, t)``: duplicate steps or gaps between first and last step are an error."""
    meta = files.select("path", (L.object_and_time("path") if with_object else F.struct(F.lit(None).cast("int").alias("obj"), L.time_only("path").alias("t"))).alias("m"))
    out = meta.select("path", "m.obj", "m.t")
    bad = (
        out.groupBy("obj", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("obj")
        .agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("steps"), (F.max("t") - F.min("t") + 1).alias("span"))
        .filter("most > 1 OR steps <> span")
    )
    if not bad.isEmpty():
        raise ValueError("files do not give exactly one per time step")
    return out


def _mesh_sections(text: str) -> Iterator[tuple[str, str, int, list[str]]]:
    """Sections of an ASCII mesh file: (location, attribute, width, tokens)."""
    head, _, _ = text.partition("\n@1")
    body = text[len(head) :]
    tags = {}
    for loc, width, attr, tag in re.findall(r"(\w+)\s*\{\s*\w+(?:\[(\d+)\])?\s+(\w+)\s*\}\s*=?\s*(@\d+)", head):
        tags[tag] = (loc, attr, int(width or 1))
    for tag, data in re.findall(r"(?m)^(@\d+)[ \t]*\n([^@]*)", body):
        if tag in tags:
            yield (*tags[tag], data.split())


def read_mesh_text(spark: SparkSession, folder: str, content: str | None = None) -> DataFrame:
    """``(path, location, attribute, row, vals)`` of ASCII mesh files, one row per element.

    With ``content`` only files declaring that content type are read; others are an error.
    """

    def parse(batches):
        for pdf in batches:
            for path, blob in zip(pdf.path, pdf.content):
                text = bytes(blob).decode("latin-1").replace("\r\n", "\n")
                if not text.startswith("#"):
                    raise ValueError(f"{path} is not a mesh file")
                if content and f'ContentType "{content}"' not in text:
                    raise ValueError(f"{path} does not hold {content}")
                for loc, attr, width, tokens in _mesh_sections(text):
                    vals = np.array(tokens, dtype=float).reshape(-1, width)
                    for at in range(0, len(vals), ROWS_PER_BATCH):
                        part = vals[at : at + ROWS_PER_BATCH]
                        yield pd.DataFrame({"path": path, "location": loc, "attribute": attr, "row": np.arange(at, at + len(part)), "vals": list(part)})

    return _binary(spark, folder, "am").select("path", "content").mapInPandas(
        parse, "path string, location string, attribute string, row bigint, vals array<double>"
    )


def lattice_size(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, nx, ny, nz)`` declared by lattice files."""
    m = r"define Lattice (\d+) (\d+) (\d+)"
    text = F.decode("content", "ISO-8859-1")  # a header has any length; the first match ends the search
    return _binary(spark, folder, "am").select("path", *[F.regexp_extract(text, m, i + 1).cast("int").alias(n) for i, n in enumerate(("nx", "ny", "nz"))])


def read_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, x, y, z, value)`` of lattice files, x running fastest. Files of another kind give no rows."""
    data = read_mesh_text(spark, folder).filter("location = 'Lattice'")
    dims = lattice_size(spark, folder)
    plane = F.col("nx").cast("bigint") * F.col("ny")
    return data.join(dims, "path").select(
        "path", (F.col("row") % F.col("nx")).cast("int").alias("x"), (F.floor(F.col("row") / F.col("nx")) % F.col("ny")).cast("int").alias("y"),
        F.floor(F.col("row") / plane).cast("int").alias("z"), F.col("vals")[0].alias("value"),
    )


def read_graphs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, edges and edge points of spatial graph files; ``graph_id`` is the path."""
    raw = read_mesh_text(spark, folder, GRAPH_CONTENT)
    pick = lambda loc, attr: raw.filter((F.col("location") == loc) & (F.col("attribute") == attr))
    v = pick("VERTEX", "VertexCoordinates").select(F.col("path").alias("graph_id"), F.col("row").alias("v"), *[F.col("vals")[i].alias(c) for i, c in enumerate("xyz")])
    ends = pick("EDGE", "EdgeConnectivity").select("path", "row", F.col("vals")[0].cast("bigint").alias("src"), F.col("vals")[1].cast("bigint").alias("dst"))
    size = pick("EDGE", "NumEdgePoints").select("path", "row", F.col("vals")[0].cast("bigint").alias("n"))
    edges = ends.join(size, ["path", "row"]).select(F.col("path").alias("graph_id"), F.col("row").alias("e"), "src", "dst", "n")
    # Points follow each other edge by edge: the edges that have points, numbered in order,
    # meet the points through the number of edge starts up to each point.
    full = edges.filter("n > 0").withColumn("one", F.lit(1))
    run = O.running_sums(full, ["graph_id"], "e", {"k": F.col("one"), "upto": F.col("n")})
    starts = run.select("graph_id", F.col("k").cast("bigint").alias("k"), "e", (F.col("upto") - F.col("n")).cast("bigint").alias("row"))
    pts = pick("POINT", "EdgePointCoordinates").select(F.col("path").alias("graph_id"), "row", *[F.col("vals")[i].alias(c) for i, c in enumerate("xyz")])
    marked = pts.join(starts.select("graph_id", "row", F.lit(1).alias("start")), ["graph_id", "row"], "left")
    numbered = O.running_sums(marked.withColumn("start", F.coalesce("start", F.lit(0))), ["graph_id"], "row", {"kk": F.col("start")})
    points = numbered.withColumn("k", F.col("kk").cast("bigint")).join(starts.select("graph_id", "k", "e", F.col("row").alias("at")), ["graph_id", "k"])
    return v, edges.drop("n"), points.select("graph_id", "e", (F.col("row") - F.col("at")).cast("int").alias("ord"), "x", "y", "z")


def read_traces(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Neuron trace text: points ``(path, section, ord, x, y, z, diameter)`` and links
    ``(path, child, parent)``."""

    def parse(batches):
        for pdf in batches:
            for path, blob in zip(pdf.path, pdf.content):
                section, at, rows = None, 0, []
                for line in bytes(blob).decode("latin-1").splitlines():
                    open_ = re.match(r"\s*(\w+(?:\[\d+\])?)\s*\{", line)
                    if open_:
                        section, at = open_.group(1), 0
                    for nums in re.findall(r"pt3dadd\(([^)]*)\)", line):
                        x, y, z, dia = (float(n) for n in nums.split(","))
                        rows.append((path, section, at, x, y, z, dia, None))
                        at += 1
                    link = re.search(r"connect\s+(\w+(?:\[\d+\])?)\s*\(\s*[\d.]+\s*\)\s*,\s*(\w+(?:\[\d+\])?)", line)
                    if link:
                        rows.append((path, link.group(1), None, None, None, None, None, link.group(2)))
                yield pd.DataFrame(rows, columns=["path", "section", "ord", "x", "y", "z", "diameter", "parent"]).astype({"ord": "Int32"})

    raw = _binary(spark, folder, "hoc").select("path", "content").mapInPandas(
        parse, "path string, section string, ord int, x double, y double, z double, diameter double, parent string"
    )
    return raw.filter("parent IS NULL").drop("parent"), raw.filter("parent IS NOT NULL").select("path", F.col("section").alias("child"), "parent")


def _tiff_pages(blob: bytes) -> Iterator[np.ndarray]:
    """Pages of an uncompressed grey-scale image stack."""
    mark = "<" if blob[:2] == b"II" else ">"
    kinds = {1: "B", 3: "H", 4: "I"}
    at = struct.unpack_from(mark + "I", blob, 4)[0]
    while at:
        n = struct.unpack_from(mark + "H", blob, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(mark + "HHI", blob, at + 2 + 12 * i)
            code = kinds.get(kind)
            if code is None:
                continue
            size = struct.calcsize(code) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(mark + "I", blob, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{mark}{count}{code}", blob, where)
        if tags.get(259, (1,))[0] != 1:
            raise ValueError("compressed images are not supported")
        bits = tags.get(258, (8,))[0]
        raw = b"".join(blob[o : o + c] for o, c in zip(tags[273], tags[279]))
        yield np.frombuffer(raw, dtype=f"{mark}u{bits // 8}").reshape(tags[257][0], tags[256][0])
        at = struct.unpack_from(mark + "I", blob, at + 2 + 12 * n)[0]


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, x, y, z, value)`` of image stacks, page by page."""

    def parse(batches):
        for pdf in batches:
            for path, blob in zip(pdf.path, pdf.content):
                for z, page in enumerate(_tiff_pages(bytes(blob))):
                    y, x = np.indices(page.shape)
                    yield pd.DataFrame({"path": path, "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), "z": np.int32(z), "value": page.ravel().astype(float)})

    return _binary(spark, folder, "tif").select("path", "content").mapInPandas(parse, "path string, x int, y int, z int, value double")


def convert_images(spark: SparkSession, folder: str, target: str, voxel=(0.1, 0.1, 0.5), window: tuple[float, float] | None = None) -> None:
    """Image stacks as a partitioned table, with voxel size and display window as columns."""
    if window is not None and not window[0] < window[1]:
        raise ValueError("display window needs low < high")
    out = read_images(spark, folder).withColumn("target", L.output_name("path", F.lit(target)))
    for c, s in zip("xyz", voxel):
        out = out.withColumn(f"d{c}", F.lit(float(s)))
    if window is not None:
        out = out.withColumn("low", F.lit(float(window[0]))).withColumn("high", F.lit(float(window[1])))
    out.write.mode("errorifexists").partitionBy("target").parquet(target)


def set_window(fields: DataFrame, low: float, high: float) -> DataFrame:
    """Display window of field headers."""
    if not low < high:
        raise ValueError("display window needs low < high")
    return fields.withColumn("low", F.lit(float(low))).withColumn("high", F.lit(float(high)))


def read_graph_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several stored graphs as one table; ``graph_id`` is the file each row came from."""
    return spark.read.parquet(*paths).withColumn("graph_id", F.input_file_name())


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("gc", "t")) -> None:
    """Rows laid out by object and step, so that a step is read alone. Rows of one step are
    spread over writers by AQE's rebalancing, so a large step gives several files."""
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode("errorifexists").partitionBy(*by).parquet(path)


def write_mesh_sections(graph_vertices: DataFrame, edges: DataFrame, points: DataFrame, path: str) -> None:
    """Text sections of a graph, one folder each, sorted across part files."""
    line = lambda cols: F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
    graph_vertices.orderBy("graph_id", "v").select(line(["x", "y", "z"])).write.text(f"{path}/VertexCoordinates")
    edges.orderBy("graph_id", "e").select(line(["src", "dst"])).write.text(f"{path}/EdgeConnectivity")
    points.orderBy("graph_id", "e", "ord").select(line(["x", "y", "z"])).write.text(f"{path}/EdgePointCoordinates")
