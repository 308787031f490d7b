"""Writers: TSV, JSON lines, jplace, Newick, tree JSON, radial SVG and HTML viewers."""

from __future__ import annotations

import html
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horocycle.functions import geometry as G
from horocycle.functions.constants import KAPPA


def finite(df: DataFrame) -> DataFrame:
    """Infinite doubles become null, so that text formats stay strict."""
    cols = [F.when(F.abs(F.col(c)) < F.lit(math.inf), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*cols)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated part files with a header; doubles to six digits, nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    rounded(finite(df)).select(*flat).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    rounded(finite(df)).write.mode("overwrite").json(path)


def placement_rows(placements: DataFrame) -> DataFrame:
    """The twelve flat columns of a placement report."""
    return placements.select(
        F.col("qid").alias("sequence_id"), "taxon_id", "rank", F.round("best_distance", 6).alias("distance"), F.round("margin", 6).alias("margin"), F.round("atlas_r", 6).alias("atlas_r"),
        F.round("atlas_theta", 6).alias("atlas_theta"), "zone", F.round("confidence", 6).alias("confidence"), "prediction_set_size", "lineage", F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"),
    )


def chimera_rows(scored: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """The fourteen columns of a chimera report from scores with ``length``."""
    r = lambda c, n: F.round(c, n).alias(c)
    return scored.select(
        "sequence_id", "length", F.round("score", 6).alias("chimera_score"), "is_chimera", r("confidence", 4), r("variance", 6), r("bimodality", 4), r("separation", 4), r("balance", 4),
        F.col("breakpoint_idx").alias("breakpoint"), r("atlas_r", 6), r("atlas_theta", 6), F.round(F.degrees("atlas_theta"), 2).alias("atlas_theta_deg"), F.lit(kappa).alias("kappa"),
    )


def triage_rows(triaged: DataFrame) -> DataFrame:
    """The seven columns of a triage report."""
    r = lambda c, name: F.round(c, 6).alias(name)
    return triaged.select(
        F.col("qid").alias("sequence_id"), "category", r("nearest_distance", "d_geo"), r("sigma", "sigma_local"), F.col("nearest_id").alias("nearest_taxon_id"), r("epsilon", "epsilon"), r("sigma_threshold", "sigma_threshold")
    )


def novelty_rows(found: DataFrame) -> DataFrame:
    """The six columns of a novelty report; the score is the distance of the nearest prototype."""
    r = lambda c, name: F.round(c, 6).alias(name)
    return found.select(
        F.col("qid").alias("sequence_id"), r("nearest_distance", "novelty_score"), "is_novel", r("threshold", "threshold"), F.col("nearest_id").alias("nearest_taxon_id"), r("nearest_distance", "nearest_distance")
    )


def write_dark_map(dark: DataFrame, summary: DataFrame, path: str) -> None:
    """The dark map as JSON lines in ``path``/taxa and its summary in ``path``/summary."""
    write_jsonl(dark.select(F.col("id").alias("taxon_id"), "sigma", "is_dark"), f"{path}/taxa")
    write_jsonl(summary, f"{path}/summary")


def jplace_rows(placements: DataFrame) -> DataFrame:
    """``n, p`` per query: placements as [edge, likelihood, weight, distal, pendant]; edges are numbers from a fixed checksum."""
    p = F.transform("candidates", lambda c, i: F.array(F.pmod(F.crc32(c["taxon_id"]), F.lit(100000)).cast("double"), -c["distance"], F.when(i == 0, F.col("confidence")).otherwise(0.0), F.lit(0.0), c["distance"]))
    return placements.select(F.array(F.col("qid").cast("string")).alias("n"), F.coalesce(p, F.array().cast("array<array<double>>")).alias("p"))


def write_jplace(placements: DataFrame, path: str) -> None:
    """One jplace document; its rows stream through the driver one at a time."""
    fields = ["edge_num", "likelihood", "like_weight_ratio", "distal_length", "pendant_length"]
    with open(path, "w") as f:
        f.write('{"version": 3, "tree": "", "fields": ' + json.dumps(fields) + ', "metadata": {"invocation": "horocycle"}, "placements": [')
        for i, row in enumerate(jplace_rows(placements).toLocalIterator()):
            f.write((", " if i else "") + json.dumps({"n": row["n"], "p": row["p"]}))
        f.write("]}\n")


def summary_json(df: DataFrame) -> str:
    """A one-row table as JSON."""
    return finite(df).select(F.to_json(F.struct("*"))).first()[0]


# ---- one tree, small enough to draw


def newick(taxa: list[str | None], edges: list[tuple[int, int, float]], root: int) -> str:
    """Newick of a tree; its depth is not bounded by the interpreter's stack."""
    if not taxa:
        return "();"
    if len(taxa) == 1:
        return f"{taxa[0]};"
    near: list[list[tuple[int, float]]] = [[] for _ in taxa]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    text: dict[int, str] = {}
    todo = [(root, -1, 0.0, False)]
    while todo:
        x, parent, w, ready = todo.pop()
        kids = [(y, v) for y, v in near[x] if y != parent]
        if not ready and kids:
            todo.append((x, parent, w, True))
            todo.extend((y, x, v, False) for y, v in reversed(kids))
            continue
        inner = f"({','.join(text[y] for y, _ in kids)})" if kids else ""
        text[x] = inner + (taxa[x] or "") + (f":{w:.6f}" if parent >= 0 else "")
    return text[root] + ";"


def tree_json(nodes: DataFrame, edges: DataFrame) -> str:
    n = nodes.agg(F.sort_array(F.collect_list(F.struct("node_id", "taxon_id", "parent", "embedding"))).alias("nodes"))
    e = edges.agg(F.sort_array(F.collect_list(F.struct("source", "target", "length", "support"))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges"))).first()[0]


def radial_svg(taxa: list[str | None], edges: list[tuple[int, int, float]], root: int, width: int = 800, height: int = 800, support: dict | None = None) -> str:
    """A radial drawing: leaves at equal angles, radius by depth, inner nodes at the circular mean of their children."""
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">'
    if not taxa:
        return head + f'<text x="{width / 2}" y="{height / 2}">Empty tree</text></svg>'
    near: list[list[tuple[int, float]]] = [[] for _ in taxa]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    depth, parent, order = {root: 0.0}, {root: -1}, [root]
    for x in order:
        for y, w in near[x]:
            if y not in depth:
                depth[y], parent[y] = depth[x] + w, x
                order.append(y)
    kids: dict[int, list[int]] = {}
    for x in order[1:]:
        kids.setdefault(parent[x], []).append(x)
    leaves, stack = [], [root]
    while stack:
        x = stack.pop()
        if x in kids:
            stack.extend(reversed(kids[x]))
        else:
            leaves.append(x)
    theta = {x: 2 * math.pi * i / len(leaves) for i, x in enumerate(leaves)}
    for x in reversed(order):
        if x in kids:
            theta[x] = math.atan2(sum(math.sin(theta[y]) for y in kids[x]), sum(math.cos(theta[y]) for y in kids[x]))
    scale = 0.38 * min(width, height) / (max(depth.values()) or 1.0)
    at = {x: (width / 2 + depth[x] * scale * math.cos(theta[x]), height / 2 + depth[x] * scale * math.sin(theta[x])) for x in order}
    out = [head]
    for x in order[1:]:
        (x1, y1), (x2, y2) = at[parent[x]], at[x]
        out.append(f'<line x1="{x1:.2f}" y1="{y1:.2f}" x2="{x2:.2f}" y2="{y2:.2f}" stroke="#555"/>')
        if support and x in support:
            out.append(f'<text x="{(x1 + x2) / 2:.2f}" y="{(y1 + y2) / 2:.2f}" font-size="8">{support[x]:.2f}</text>')
    out += [f'<text x="{at[x][0]:.2f}" y="{at[x][1]:.2f}" font-size="10">{html.escape(taxa[x] or "")}</text>' for x in leaves]
    return "".join(out) + "</svg>"


def viewer_payload(points: DataFrame, edges: list[tuple[int, int]], kappa: float, bands: list[dict], three_d: bool = False) -> dict:
    """The viewer's data from ``points(ordinal, taxon_id, rank, coords)`` in order; three coordinates for 3-D."""
    rows = points.orderBy("ordinal").collect()
    if three_d and any(len(r["coords"]) < 3 for r in rows):
        raise ValueError("the 3-D view needs three coordinates")
    return {"kappa": kappa, "ballRadius": G.ball_radius(kappa), "nPoints": len(rows), "taxa": [r["taxon_id"] for r in rows], "ranks": [r["rank"] for r in rows], "coords": [r["coords"][: 3 if three_d else 2] for r in rows], "edges": [list(e) for e in edges], "rankBands": bands}


def viewer_html(payload: dict, title: str = "Poincaré ball") -> str:
    """A page that draws the points on a canvas; moving over one names it."""
    data = json.dumps(payload).replace("</", "<\\/")
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><canvas id='c' width='800' height='800'></canvas><p id='t'></p>"
        f"<script type='application/json' id='d'>{data}</script><script>"
        "const D=JSON.parse(document.getElementById('d').textContent),c=document.getElementById('c'),g=c.getContext('2d'),s=380/D.ballRadius;"
        "const P=D.coords.map(p=>[400+p[0]*s,400-p[1]*s]);g.beginPath();g.arc(400,400,380,0,7);g.stroke();"
        "for(const[a,b]of D.edges){g.beginPath();g.moveTo(...P[a]);g.lineTo(...P[b]);g.stroke()}"
        "P.forEach(p=>{g.beginPath();g.arc(p[0],p[1],3,0,7);g.fill()});"
        "c.onmousemove=e=>{let n=-1,m=20;P.forEach((p,i)=>{const d=Math.hypot(p[0]-e.offsetX,p[1]-e.offsetY);if(d<m){m=d;n=i}});document.getElementById('t').textContent=n<0?'':D.taxa[n]};"
        "</script></body></html>"
    )
