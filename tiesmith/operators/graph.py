"""Relation records filtered, collapsed to edges and rendered as a graph."""

from __future__ import annotations

import html
import json
import re
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiesmith.functions.text import dot_escape, edge_id, html_escape, node_id, short_label, svg_box_id
from tiesmith.sources import files

# Colours of the attribute types, in the order of their boxes, and of the page.
COLOURS = {"time": "#4a90d9", "place": "#b07cd9", "institution": "#57b894", "action": "#e0c341"}
PAGE = {"bg": "#181818", "fill": "#2b2b2e", "border": "#6b6b70", "text": "#e8e8e8", "edge": "#8a8a90", "edge_text": "#c9c9cf", "box": "#151515"}
# The lines that open a drawing, and the table around the boxes of an edge.
DOT_HEAD = f"""graph relations {{
  bgcolor="{PAGE["bg"]}";
  overlap=false;
  sep="+12";
  splines=true;
  node [shape=ellipse, style=filled, fillcolor="{PAGE["fill"]}", color="{PAGE["border"]}", fontcolor="{PAGE["text"]}", fontname="sans-serif"];
  edge [color="{PAGE["edge"]}", fontcolor="{PAGE["edge_text"]}", fontname="sans-serif", fontsize=10];"""
BOX_TABLE = '<TABLE BORDER="0" CELLBORDER="0" CELLSPACING="3" CELLPADDING="4"><TR>', "</TR></TABLE>"
BOX_CHARS = 20
MOST_EDGES = 50_000


def pool(kept: DataFrame, low: DataFrame, high_coverage_only: bool = False) -> DataFrame:
    """Records of both coverages with `source_rank`, the well covered first."""
    first = kept.withColumn("source_rank", F.lit(0))
    return first if high_coverage_only else first.unionByName(low.withColumn("source_rank", F.lit(1)))


def at_institution(records: DataFrame, needle: str) -> DataFrame:
    """Records with an institution whose value holds `needle`, whatever the case."""
    return records.where(F.exists("attributes", lambda a: (a["attr_type"] == "institution") & F.coalesce(F.contains(F.lower(a["value"]), F.lower(F.lit(needle))), F.lit(False))))


def complete(records: DataFrame) -> DataFrame:
    """Records whose participants all have a qid."""
    return records.where(F.forall("participants", lambda p: p["qid"].isNotNull() & (p["qid"] != "")))


def nodes(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, label): everyone who takes part; the qid stands in for a missing name."""
    who = records.select(F.explode("participants").alias("p")).select("p.qid").distinct()
    names = entities.groupBy("qid").agg(F.max("canonical_name").alias("_n"))
    return who.join(names, "qid", "left").select("qid", F.coalesce("_n", "qid").alias("label"))


def edges(records: DataFrame, order: list[str]) -> DataFrame:
    """(a, b, n_relations, attributes, sentence): one row a pair whatever the direction.

    `attributes` and `sentence` are those of the first record by `order`. Records of one person with
    themselves give no edge. Nothing is gathered, so a pair with many records is no hot group.
    """
    pair = records.withColumn("x", F.col("participants")[0]["qid"]).withColumn("y", F.col("participants")[1]["qid"]).where((F.size("participants") == 2) & (F.col("x") != F.col("y")))
    first = F.min_by(F.struct("attributes", "sentence"), F.struct(*[F.col(c) for c in order])).alias("f")
    return pair.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n_relations"), first).select("a", "b", "n_relations", "f.attributes", "f.sentence")


def tooltips(records: DataFrame, order: list[str]) -> DataFrame:
    """(a, b, tooltip): all sentences of a pair, one a line, in order. For graphs that are drawn, which are small."""
    pair = records.withColumn("x", F.col("participants")[0]["qid"]).withColumn("y", F.col("participants")[1]["qid"]).where("x <> y")
    item = F.struct(*[F.col(c) for c in order], F.col("sentence").alias("_text"))
    return pair.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda r: r["_text"]), "\n").alias("tooltip"))


def primary_values(attributes) -> dict:
    """attr_type to expression: the first value of each known type."""
    first = lambda kind: F.get(F.filter(attributes, lambda a: a["attr_type"] == kind), F.lit(0))["value"]
    return {kind: first(kind) for kind in COLOURS}


def node_lines(found: DataFrame) -> DataFrame:
    """(qid, line) of DOT text."""
    return found.select("qid", F.concat(F.lit('  "'), dot_escape("qid"), F.lit('" [id="'), dot_escape(node_id("qid")), F.lit('", label="'), dot_escape("label"), F.lit('"];')).alias("line"))


def edge_lines(found: DataFrame) -> DataFrame:
    """(a, b, line) of DOT text: a row of coloured boxes for the attribute types, and the tooltip."""
    cells = []
    for kind, value in primary_values(F.col("attributes")).items():
        box = F.concat_ws("__", F.lit("box"), F.col("a"), F.col("b"), F.lit(kind))
        cell = F.concat(
            F.lit('<TD ID="'), html_escape(box), F.lit(f'" TOOLTIP="{kind.capitalize()}: '), html_escape(value), F.lit(f'" BGCOLOR="{COLOURS[kind]}"><FONT COLOR="{PAGE["box"]}" POINT-SIZE="9">'),
            html_escape(short_label(value, BOX_CHARS)), F.lit("</FONT></TD>"),
        )
        cells.append(F.when(value.isNotNull(), cell).otherwise(""))
    row = F.concat(*cells)
    label = F.when(row == "", 'label=""').otherwise(F.concat(F.lit(f"label=<{BOX_TABLE[0]}"), row, F.lit(f"{BOX_TABLE[1]}>")))
    line = F.concat(F.lit('  "'), dot_escape("a"), F.lit('" -- "'), dot_escape("b"), F.lit('" [id="'), dot_escape(edge_id("a", "b")), F.lit('", '), label, F.lit(', tooltip="'), dot_escape("tooltip"), F.lit('"];'))
    return found.select("a", "b", line.alias("line"))


def box_tooltips(found: DataFrame) -> DataFrame:
    """(id, tooltip) of every box that is drawn."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in primary_values(F.col("attributes")).items()])
    flat = found.select("a", "b", F.explode(kinds).alias("k")).where("k.value IS NOT NULL")
    return flat.select(svg_box_id("a", "b", F.col("k.kind")).alias("id"), F.concat(F.initcap("k.kind"), F.lit(": "), F.col("k.value")).alias("tooltip"))


def to_dot(found_nodes: DataFrame, found_edges: DataFrame, most: int = MOST_EDGES) -> str:
    """DOT text of a graph that is small enough to draw; a larger one is refused, not cut."""
    held = found_edges.limit(most + 1).count()
    if held > most:
        raise ValueError(f"more than {most} edges can't be drawn; filter first")
    body = [r.line for r in node_lines(found_nodes).orderBy("qid").toLocalIterator()] + [r.line for r in edge_lines(found_edges).orderBy("a", "b").toLocalIterator()]
    return "\n".join([DOT_HEAD, *body, "}"]) + "\n"


def to_svg(dot: str, engine: str = "neato") -> str:
    """Layout by Graphviz; a clear error where the engine isn't installed."""
    path = shutil.which(engine)
    if not path:
        raise RuntimeError(f"layout engine {engine!r} is not installed")
    return subprocess.run([path, "-Tsvg"], input=dot, capture_output=True, text=True, check=True).stdout


def to_html(svg: str, tips: dict[str, str], title: str = "relations") -> str:
    """A page that shows the drawing with tooltips, legend, zoom and pan, and loads nothing."""
    bare = re.sub(r'(<(?:g|a)\b[^>]*\bid="(?:edge__|a_box__)[^"]*"[^>]*>)\s*<title>.*?</title>', r"\1", svg, flags=re.S)
    data = json.dumps(tips, ensure_ascii=False).replace("</", "<\\/")
    legend = "".join(f'<b style="background:{c}">{html.escape(k)}</b>' for k, c in COLOURS.items())
    script = (
        "const tips=DATA,tip=document.getElementById('tip'),svg=document.querySelector('svg');let s=1,x=0,y=0,d=null;"
        "const put=()=>{svg.style.transform=`translate(${x}px,${y}px) scale(${s})`};"
        "for(const[k,v]of Object.entries(tips)){const e=document.getElementById(k);if(!e)continue;"
        "e.onmousemove=m=>{tip.textContent=v;tip.style.display='block';tip.style.left=m.clientX+12+'px';tip.style.top=m.clientY+12+'px';m.stopPropagation()};"
        "e.onmouseleave=()=>{tip.style.display='none'}}"
        "onwheel=m=>{const f=m.deltaY<0?1.15:1/1.15;x=m.clientX-(m.clientX-x)*f;y=m.clientY-(m.clientY-y)*f;s*=f;put()};"
        "onmousedown=m=>{d=[m.clientX-x,m.clientY-y]};onmousemove=m=>{if(d){x=m.clientX-d[0];y=m.clientY-d[1];put()}};onmouseup=()=>{d=null};ondblclick=()=>{s=1;x=y=0;put()};"
    )
    style = f"body{{margin:0;overflow:hidden;background:{PAGE['bg']};color:{PAGE['text']};font:13px sans-serif}}svg{{transform-origin:0 0}}#tip{{display:none;position:fixed;max-width:32em;white-space:pre-line;background:#000c;padding:6px}}#key{{position:fixed;left:8px;bottom:8px}}#key b{{color:{PAGE['box']};margin-right:6px;padding:2px 6px}}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body>{bare}<div id="key">{legend}</div><div id="tip"></div><script>{script.replace("DATA", data)}</script></body></html>\n'


def write_graph(found_nodes: DataFrame, found_edges: DataFrame, folder: Path | str, name: str, engine: str | None = None) -> dict:
    """DOT text and, with an engine, drawing and page, on any file system; returns what was written and the counts.

    `engine` may be the path of a program in a folder of its own.
    """
    put = lambda kind, text: files.write_text(found_nodes.sparkSession, files.join(str(folder), f"{name}.{kind}"), text)
    dot = to_dot(found_nodes, found_edges)
    put("dot", dot)
    counts = {"nodes": found_nodes.count(), "edges": found_edges.count(), "engine": engine}
    if engine:
        svg = to_svg(dot, engine)
        tips = {r.id: r.tooltip for r in box_tooltips(found_edges).toLocalIterator()} | {r.id: r.tooltip for r in found_edges.select(edge_id("a", "b").alias("id"), "tooltip").toLocalIterator()}
        put("svg", svg)
        put("html", to_html(svg, tips, name))
    return counts
