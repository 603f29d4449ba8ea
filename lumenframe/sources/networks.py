"""Network files: sectioned text, GML, GraphML and DOT. Attributes that a format can't type are packed as base64 JSON."""

from __future__ import annotations

import configparser
import re
from pathlib import PurePosixPath
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators.network import NODES, Layer, Network, build
from lumenframe.session import ship
from lumenframe.storage import discard, materialize

EDGES = "src string, dst string, src_layer string, dst_layer string, layer_id int, edge_order int, weight double"
READABLE = {"ini": "sections", "txt": "sections", "gml": "graph", "graphml": "graph", "xml": "graph", "dot": "graph", "bundle": "parquet"}


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def _items(text: str) -> list[str]:
    return [x.strip().strip("'\"") for x in re.split(r"[,\n\[\]()]+", text) if x.strip().strip("'\"")]


def read_sections(spark: SparkSession, path: str) -> Network:
    """[network], [layer NAME] (nodes, file or size; type, visible) and [binding A-B] (`a: b, c` lines or pairs).

    Layers follow the order of the list `layers` or `nodes` of [network], else of the sections. A layer without
    `visible` is visible if it is the first or last one.
    """
    config = configparser.ConfigParser(interpolation=None, strict=False)
    config.optionxform = str
    config.read_string(read_text(spark, path))
    head = dict(config["network"]) if config.has_section("network") else {}
    sections = [s for s in config.sections() if s.lower().startswith("layer ")]
    order = [f"layer {x}" for x in _items(head.get("layers", head.get("nodes", "")))]
    if order and set(order) <= set(sections):
        sections = order
    spec = []
    for k, section in enumerate(sections):
        s = config[section]
        if "file" in s:
            nodes = [r[0].strip() for r in spark.read.text(s["file"]).collect() if r[0].strip()]
        elif "nodes" in s:
            nodes = _items(s["nodes"])
        else:
            nodes = [f"n{j + 1}" for j in range(int(s.get("size", "0")))]
        visible = s.getboolean("visible") if "visible" in s else k in (0, len(sections) - 1)
        kind = s.get("type", s.get("distribution", s.get("function", "gauss" if visible else "sigmoid")))
        spec.append(Layer(section.split(" ", 1)[1].strip(), tuple(dict.fromkeys(nodes)), visible, kind))
    bindings: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for section in config.sections():
        if section.lower().startswith("binding "):
            a, _, b = section.split(" ", 1)[1].partition("-")
            bindings[a.strip(), b.strip()] = [(src, dst) for src, targets in config[section].items() for dst in _items(targets)]
    return build(spark, spec, bindings or None, name=head.get("name", PurePosixPath(path).stem))


def pack(values: Column) -> Column:
    """A struct as base64 of its JSON."""
    return F.translate(F.base64(F.to_json(values)), "\r\n", "")


def escaped(text: Column) -> Column:
    """Text inside quotes of a graph file: the characters that end a value or a block as XML entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("[", "&#91;"), ("]", "&#93;"), ("\n", "&#10;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


_NODE = ("label", "layer", "layer_id", "layer_sub_id", "node_order", "visible", "type")
_EDGE = ("src_layer", "dst_layer", "layer_id", "edge_order")


def quoted(name: str) -> str:
    """A graph's name as escaped() writes ids."""
    return escape(name, {'"': "&quot;", "[": "&#91;", "]": "&#93;", "\n": "&#10;"})


def to_gml(network: Network) -> DataFrame:
    """Lines (n, value) of a GML file; n orders them."""
    nodes = network.nodes.select(F.col("node_order").cast("long").alias("n"), F.format_string('  node [\n    id %d\n    label "%s"\n    params "%s"\n  ]', "node_order", escaped(F.col("id")), pack(F.struct(*_NODE))).alias("value"))
    at = network.nodes.select("id", "node_order")
    e = network.edges.join(at.select(F.col("id").alias("src"), F.col("node_order").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("node_order").alias("b")), "dst")
    edges = e.select((F.col("edge_order") + (1 << 40)).alias("n"), F.format_string('  edge [\n    source %d\n    target %d\n    weight %s\n    params "%s"\n  ]', "a", "b", F.col("weight").cast("string"), pack(F.struct(*_EDGE))).alias("value"))
    return _framed(network, nodes, edges, f'graph [\n  directed 1\n  name "{quoted(network.name)}"', "]")


def to_graphml(network: Network) -> DataFrame:
    nodes = network.nodes.select(F.col("node_order").cast("long").alias("n"), F.format_string('    <node id="%s"><data key="params">%s</data></node>', escaped(F.col("id")), pack(F.struct(*_NODE))).alias("value"))
    edges = network.edges.select((F.col("edge_order") + (1 << 40)).alias("n"), F.format_string('    <edge source="%s" target="%s"><data key="weight">%s</data><data key="params">%s</data></edge>', escaped(F.col("src")), escaped(F.col("dst")), F.col("weight").cast("string"), pack(F.struct(*_EDGE))).alias("value"))
    head = (
        '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
        '  <key id="params" for="all" attr.name="params" attr.type="string"/>\n  <key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n'
        f'  <graph id="{escape(network.name)}" edgedefault="directed">'
    )
    return _framed(network, nodes, edges, head, "  </graph>\n</graphml>")


def to_dot(network: Network) -> DataFrame:
    nodes = network.nodes.select(F.col("node_order").cast("long").alias("n"), F.format_string('  "%s" [params="%s"];', escaped(F.col("id")), pack(F.struct(*_NODE))).alias("value"))
    edges = network.edges.select((F.col("edge_order") + (1 << 40)).alias("n"), F.format_string('  "%s" -> "%s" [weight="%s", params="%s"];', escaped(F.col("src")), escaped(F.col("dst")), F.col("weight").cast("string"), pack(F.struct(*_EDGE))).alias("value"))
    return _framed(network, nodes, edges, f'digraph "{quoted(network.name)}" {{', "}")


def _framed(network: Network, nodes: DataFrame, edges: DataFrame, head: str, foot: str) -> DataFrame:
    ends = network.nodes.sparkSession.createDataFrame([(-1, head), (1 << 60, foot)], "n long, value string")
    return nodes.unionByName(edges).unionByName(ends)


WRITERS = {"gml": to_gml, "graphml": to_graphml, "xml": to_graphml, "dot": to_dot}


def write_network(network: Network, path: str, kind: str | None = None) -> None:
    """A network as a folder of text parts, whose contents one after the other make the file, or as parquet tables (bundle).

    Lines are dealt to the parts by ranges of their order, so a small network is one part and a large one many.
    """
    kind = kind or PurePosixPath(path).suffix.lstrip(".")
    if kind == "bundle":
        network.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        network.edges.write.mode("overwrite").parquet(f"{path}/edges")
        return
    if kind not in WRITERS:
        raise ValueError(f"can't write networks as {kind!r}")
    WRITERS[kind](network).orderBy("n").select("value").write.mode("overwrite").text(path)


# ---------------------------------------------------------------- graph files: blocks of text to nodes and edges

_NODE_TYPE = "struct<label:string,layer:string,layer_id:int,layer_sub_id:int,node_order:int,visible:boolean,type:string>"
_EDGE_TYPE = "struct<src_layer:string,dst_layer:string,layer_id:int,edge_order:int>"


def _place() -> Column:
    """Where a row was read: file, start of its split, and its number there."""
    return F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def _unescaped(text: Column) -> Column:
    """The text that escaped() got; entities of XML and of line ends and brackets."""
    for entity, plain in (("&#10;", "\n"), ("&#93;", "]"), ("&#91;", "["), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _attributes(packed: Column, kind: str, plain) -> Column:
    """The struct that pack() made or, in files of other programs, the attributes of these names."""
    names = _NODE if kind == _NODE_TYPE else _EDGE
    types = dict(x.split(":") for x in kind[len("struct<") : -1].split(","))
    other = F.struct(*(plain(n).try_cast(types[n]).alias(n) for n in names))
    return F.when(packed != "", F.from_json(F.unbase64(packed).cast("string"), kind)).otherwise(other)


def _numbered(df: DataFrame, order: str) -> DataFrame:
    """df with `order` counted in the order of the file where a row has none."""
    from lumenframe.operators.arrays import number_rows

    if df.where(F.col(order).isNull()).isEmpty():
        return df.drop("place")
    placed = number_rows(df, ["place"], "__at")
    return placed.withColumn(order, F.coalesce(order, F.col("__at").cast("int"))).drop("__at", "place")


def _assembled(name: str, nodes: DataFrame, edges: DataFrame) -> Network:
    """nodes: id, p, place; edges: src, dst, weight, p, place."""
    made = _numbered(nodes.select("id", F.coalesce("p.label", "id").alias("label"), *(f"p.{c}" for c in _NODE[1:]), "place"), "node_order")
    links = _numbered(edges.select("src", "dst", *(f"p.{c}" for c in _EDGE), F.coalesce("weight", F.lit(0.0)).alias("weight"), "place"), "edge_order")
    return Network(made.select(*(f.split()[0] for f in NODES.split(", "))), links.select(*(f.split()[0] for f in EDGES.split(", "))), name)


def _first(df: DataFrame, name: Column, otherwise: str) -> str:
    found = df.select(_unescaped(name).alias("x")).where("x <> ''").first()
    return found[0] if found else otherwise


def read_gml(spark: SparkSession, path: str) -> Network:
    """Blocks are read in parallel: a record of the text ends at a closing bracket, so files are split within."""
    records = spark.read.option("lineSep", "]").text(path).select("value", _place().alias("place"))
    if not records.where((F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1).isEmpty():
        raise ValueError(f"{path}: a closing bracket stands inside quotes; write it as &#93;")
    blocks = records.withColumn("kind", F.regexp_extract("value", r"(?s).*\b(node|edge)\s*\[(.*)$", 1)).withColumn("block", F.regexp_extract("value", r"(?s).*\b(?:node|edge)\s*\[(.*)$", 1))
    of = lambda n: F.coalesce(*(F.nullif(F.regexp_extract("block", rf"(?:^|\s){n}\s+{v}", 1), F.lit("")) for v in ('"([^"]*)"', r"([^\s\"]+)")))
    packed = F.coalesce(of("params"), F.lit(""))
    named = blocks.where("kind = 'node'").select(of("id").alias("number"), _unescaped(F.coalesce(of("label"), of("id"))).alias("id"), _attributes(packed, _NODE_TYPE, of).alias("p"), "place")
    links = blocks.where("kind = 'edge'").select(of("source").alias("s"), of("target").alias("t"), of("weight").try_cast("double").alias("weight"), _attributes(packed, _EDGE_TYPE, of).alias("p"), "place")
    ids = named.select("number", "id")
    edges = links.join(ids.select(F.col("number").alias("s"), F.col("id").alias("src")), "s").join(ids.select(F.col("number").alias("t"), F.col("id").alias("dst")), "t")
    name = _first(records, F.regexp_extract("value", r'(?s)\bgraph\s*\[[^\[]*?\bname\s+"([^"]*)"', 1), PurePosixPath(path).stem)
    return _assembled(name, named.drop("number"), edges.drop("s", "t"))


_START = re.compile(r"""<(node|edge)\b((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_END = {tag: re.compile(rf"</{tag}\s*>|<(?:node|edge)\b") for tag in ("node", "edge")}
_BORDER = re.compile(r"</(?:node|edge)\s*>|<(?:node|edge)\b")


def _find_elements(batches):
    """Nodes and edges of each split of a file, whose rows are what stands between opening brackets; of a split also what precedes its first element and an element that does not end in it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    out: list[tuple] = []
    split, head, closed, carry, n = None, [], False, "", 0

    def leftover():
        if split:
            out.append(("head", "".join(head), *split, 0))
            if closed:
                out.append(("tail", carry, *split, n))

    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("file"), batch.column("start").to_numpy()
        names = files.dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(starts) != 0) | (np.diff(names) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            values = batch.column("value").slice(a, b - a)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), values), "<")[0].as_py()
            here = (files[a].as_py(), int(starts[a]))
            if here != split:
                leftover()
                split, head, closed, carry, n = here, [], False, "", 0
                text = "<" + text if here[1] else text  # the rows of a later split follow a bracket
            else:
                text = "<" + text
            if not closed:
                border = _BORDER.search(text)
                head.append(text[: border.start()] if border else text)
                if not border:
                    continue
                closed, text = True, text[border.start() :]
            text, carry, at = carry + text, "", 0
            while m := _START.search(text, at):
                at = m.end()
                if not m[2].endswith("/"):
                    end = _END[m[1]].search(text, at)
                    if not end:
                        carry = text[m.start() :]
                        break
                    at = end.start()
                out.append((m[1], text[m.start() : at], *split, n))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOUND)] if out else [pa.array([], t) for t in _FOUND], ["kind", "e", "file", "start", "n"])
        out = []
    leftover()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOUND)], ["kind", "e", "file", "start", "n"])


_FOUND = ("string", "string", "string", "int64", "int64")


def _graphml_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(kind, e, place), and what it reads from the shared folder: the nodes and edges of GraphML files, each from its opening tag to its end or to the next element."""
    ship(spark)
    records = spark.read.option("lineSep", "<").text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    found = materialize(records.mapInArrow(_find_elements, "kind string, e string, file string, start long, n long"), "graphml")
    # an element that goes on in the next split: what begins it there, and what precedes the first element of those that follow
    ordered = Window.partitionBy("file").orderBy("start", "n", F.col("kind") == "tail")
    parts = found.where("kind IN ('head', 'tail')").withColumn("group", F.sum((F.col("kind") == "tail").cast("int")).over(ordered))
    parts = parts.groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("start", "n", (F.col("kind") == "tail").alias("tail"), "e"))).alias("parts"))
    mended = parts.select(F.array_join("parts.e", "").alias("e"), "file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["n"].alias("n"))
    mended = mended.select(F.regexp_extract("e", r"^<(node|edge)\b", 1).alias("kind"), "e", "file", "start", "n")
    both = found.where("kind IN ('node', 'edge')").unionByName(mended.where("kind <> ''"))
    return both.select("kind", "e", F.struct("file", "start", "n").alias("place")), found


def read_graphml(spark: SparkSession, path: str) -> Network:
    """Elements are read in parallel: files are split within, may come in parts, and a row of the text holds one tag, however nodes and edges follow each other."""
    found, stored = _graphml_elements(spark, path)
    given = lambda n: _unescaped(F.regexp_extract("e", rf"""^<\w+\b[^>]*?\s{n}=["']([^"']*)""", 1))
    of = lambda n: F.nullif(_unescaped(F.regexp_extract("e", rf"""<data\s+key=["']{n}["'][^>]*>([^<]*)<""", 1)), F.lit(""))
    packed = F.coalesce(of("params"), F.lit(""))
    nodes = found.where("kind = 'node'").select(given("id").alias("id"), _attributes(packed, _NODE_TYPE, of).alias("p"), "place")
    edges = found.where("kind = 'edge'").select(given("source").alias("src"), given("target").alias("dst"), of("weight").try_cast("double").alias("weight"), _attributes(packed, _EDGE_TYPE, of).alias("p"), "place")
    nodes, edges = materialize(nodes, "graphml-nodes"), materialize(edges, "graphml-edges")  # attributes are searched for once
    discard(stored)
    return _assembled(PurePosixPath(path).stem, nodes, edges)


def read_dot(spark: SparkSession, path: str) -> Network:
    """A node or an edge a line, in parallel."""
    line = F.col("value")
    lines = spark.read.text(path).select("value", _place().alias("place"))
    of = lambda n: F.nullif(F.regexp_extract(line, rf'\b{n}="([^"]*)"', 1), F.lit(""))
    packed = F.coalesce(of("params"), F.lit(""))
    a, b = F.regexp_extract(line, r'^\s*"([^"]+)"', 1), F.regexp_extract(line, r'->\s*"([^"]+)"', 1)
    nodes = lines.where((a != "") & (b == "")).select(_unescaped(a).alias("id"), _attributes(packed, _NODE_TYPE, of).alias("p"), "place")
    edges = lines.where(b != "").select(_unescaped(a).alias("src"), _unescaped(b).alias("dst"), of("weight").try_cast("double").alias("weight"), _attributes(packed, _EDGE_TYPE, of).alias("p"), "place")
    return _assembled(_first(lines, F.regexp_extract(line, r'^digraph\s+"([^"]*)"', 1), PurePosixPath(path).stem), nodes, edges)


def read_network(spark: SparkSession, path: str, kind: str | None = None) -> Network:
    """A network by the ending of its path."""
    kind = kind or PurePosixPath(path).suffix.lstrip(".")
    if kind in ("ini", "txt"):
        return read_sections(spark, path)
    if kind == "bundle":
        return Network(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), PurePosixPath(path).stem)
    readers = {"gml": read_gml, "graphml": read_graphml, "xml": read_graphml, "dot": read_dot}
    if kind not in readers:
        raise ValueError(f"unknown file type {kind!r}")
    return readers[kind](spark, path)
