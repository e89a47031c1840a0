"""Problem 5: dispatcher configurations of logged runs as flat tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphoquarry.operators.flatten import Node, flat_tables, opened, tagged
from morphoquarry.session import Cut
from morphoquarry.sources.tables import table


def _at(element, *path):
    for step in path:
        element = opened(element)
        element = element.get(step) if isinstance(element, dict) else None
    return opened(element)


def _text(value):
    """JSON of objects, lists and numbers; text as it is."""
    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _dispatcher(d):
    meta = _at(d, "exmd", "image_metadata")
    kept = {k: meta.get(k) for k in ("shape", "mag")} if isinstance(meta, dict) else {}
    whole = {k: _text(_at(meta, k)) for k in ("scaling", "ch_wavelengths", "zooms")}
    return {"name": d.get("ex_i"), "status": d.get("status"), "image_path": _at(d, "exmd", "image_path"), "shape": kept.get("shape"), "mag": kept.get("mag"), **whole}


def _channel_position(order, key, element):
    if isinstance(element, dict):
        given = element.get("index")
        return int(given) if isinstance(given, (int, str)) and str(given).isdigit() else order
    return int(key) if key is not None and key.isdigit() else order


TREE = (
    Node(
        "dispatcher",
        ("dispatcher_configs",),
        _dispatcher,
        children=(
            Node("channel", ("exmd", "data_metadata", "channel_info"), lambda c: {"name": c.get("name") if isinstance(c, dict) else str(c)}, position=_channel_position, scalars=True),
            Node("colocalization", ("exmd", "COLOCALIZE_PARAMS", "colocalizations"), lambda c: {"name": "+".join(str(x) for x in c)}, lists=True),
            Node("roi", ("rois",), lambda r: {"name": r.get("name")}, children=(Node("polygon", ("polygons",), lambda p: {"name": p.get("label") if p.get("label") is None else str(p["label"]), "area_px": p.get("area_px")}),)),
        ),
    ),
)


SCHEMAS = {
    "dispatcher": "name string, status string, image_path string, scaling string, shape array<long>, mag double, ch_wavelengths string, zooms string",
    "channel": "name string",
    "colocalization": "name string",
    "roi": "name string",
    "polygon": "name string, area_px double",
}


def _tables(spark: SparkSession, folder: str, *tags: str) -> dict[str, DataFrame]:
    """Flat tables with their keys: run_id and the positions of the element and of those above it."""
    rows = tagged(table(spark, folder, "quant_runs"), "run_id", "payload", TREE)
    flat = flat_tables(rows, {t: SCHEMAS[t] for t in tags or SCHEMAS}, Cut(spark).path())
    place = lambda tag: F.regexp_extract("pk", f"/{tag}:([0-9]+)", 1).cast("long").alias(f"{tag}_i")
    above = {"dispatcher": [], "polygon": ["roi"]}
    return {t: d.select(F.col("record").alias("run_id"), place("dispatcher"), *[place(a) for a in above.get(t, [])], "pos", *[c for c in d.columns if c not in ("record", "pk", "parent", "pos", "at_key")]) for t, d in flat.items()}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    none, out = F.lit(-1).cast("long"), None
    for kind, d in _tables(spark, folder).items():
        pos = none if kind == "dispatcher" else F.col("roi_i") if kind == "polygon" else F.col("pos")
        part = d.select("run_id", F.col("dispatcher_i").alias("disp_i"), F.lit(kind).alias("kind"), pos.alias("pos"), (F.col("pos") if kind == "polygon" else none).alias("sub_pos"), "name")
        out = part if out is None else out.unionAll(part)
    return out


def p5_image_metadata(spark: SparkSession, folder: str) -> DataFrame:
    rows = _tables(spark, folder, "dispatcher")["dispatcher"]
    return rows.select("run_id", F.col("dispatcher_i").alias("disp_i"), F.col("name").alias("ex_i"), "status", "image_path", "scaling", F.to_json("shape").alias("shape"), "mag", "ch_wavelengths", "zooms")


def p5_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Channels with the example of the dispatcher above them."""
    t = _tables(spark, folder, "dispatcher", "channel")
    above = t["dispatcher"].select("run_id", "dispatcher_i", F.col("name").alias("ex_i"))
    return t["channel"].join(above, ["run_id", "dispatcher_i"]).select("run_id", F.col("dispatcher_i").alias("disp_i"), "ex_i", F.col("pos").alias("channel"), "name")


def p5_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Polygons with the region above them."""
    t = _tables(spark, folder, "roi", "polygon")
    above = t["roi"].select("run_id", "dispatcher_i", F.col("pos").alias("roi_i"), F.col("name").alias("roi"))
    return t["polygon"].join(above, ["run_id", "dispatcher_i", "roi_i"]).select("run_id", F.col("dispatcher_i").alias("disp_i"), "roi_i", "roi", F.col("pos").alias("poly_i"), F.col("name").alias("label"), "area_px")


def _open(x: str) -> str:
    return f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') THEN CAST({x}->>'$' AS JSON) ELSE {x} END)"


def _listed(x: str) -> str:
    """Elements (k, v) of a list or of an object, or a lone object as the first of a list."""
    return f"(SELECT CAST(e.key AS BIGINT) AS k, e.value AS v FROM json_each({x}) e WHERE json_type({x}) = 'ARRAY' UNION ALL SELECT 0, {x} WHERE json_type({x}) = 'OBJECT' AND {x}::VARCHAR <> '{{}}')"


_FROM = f"""WITH j AS (SELECT DISTINCT run_id, CAST(payload AS JSON)->'dispatcher_configs' AS d FROM quant_runs WHERE payload IS NOT NULL AND json_valid(payload)),
o AS (SELECT run_id, {_open("d")} AS d FROM j), e AS (SELECT run_id, CAST(x.key AS BIGINT) AS disp_i, {_open("x.value")} AS v FROM o, json_each(o.d) x WHERE json_type(o.d) IN ('ARRAY', 'OBJECT')),
m AS (SELECT run_id, disp_i, v, {_open("v->'exmd'")} AS x, {_open("v->'rois'")} AS r FROM e WHERE json_type(v) = 'OBJECT'),
c AS (SELECT run_id, disp_i, t.key AS k, t.value AS v FROM m, json_each(x->'data_metadata'->'channel_info') t WHERE json_type(x->'data_metadata'->'channel_info') IN ('ARRAY', 'OBJECT')),
l AS (SELECT run_id, disp_i, t.key AS k, t.value AS v FROM m, json_each(x->'COLOCALIZE_PARAMS'->'colocalizations') t WHERE json_type(x->'COLOCALIZE_PARAMS'->'colocalizations') = 'ARRAY'),
ro AS (SELECT run_id, disp_i, t.k, t.v FROM m, LATERAL {_listed("m.r")} t WHERE json_type(t.v) = 'OBJECT'),
po AS (SELECT run_id, disp_i, ro.k AS roi, t.k, t.v FROM ro, LATERAL {_listed("(ro.v->'polygons')")} t WHERE json_type(t.v) = 'OBJECT')
"""
_FOUND = """SELECT run_id, disp_i, 'dispatcher' AS kind, CAST(-1 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS sub_pos, v->>'ex_i' AS name FROM m
UNION ALL SELECT run_id, disp_i, 'channel', CAST(CASE WHEN json_type(v) = 'OBJECT' THEN v->>'index' ELSE CAST(k AS VARCHAR) END AS BIGINT), -1, CASE WHEN json_type(v) = 'OBJECT' THEN v->>'name' ELSE v->>'$' END FROM c WHERE json_type(v) <> 'NULL'
UNION ALL SELECT run_id, disp_i, 'colocalization', CAST(k AS BIGINT), -1, array_to_string(CAST(v AS VARCHAR[]), '+') FROM l WHERE json_type(v) = 'ARRAY' AND json_array_length(v) > 0
UNION ALL SELECT run_id, disp_i, 'roi', k, -1, v->>'name' FROM ro UNION ALL SELECT run_id, disp_i, 'polygon', roi, k, v->>'label' FROM po"""
def _as_text(x: str) -> str:
    """As json.dumps writes it, but for spaces; small exponents have two digits."""
    x = _open(x)
    return f"CASE json_type({x}) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN {x}->>'$' ELSE regexp_replace(CAST({x} AS VARCHAR), 'e-([0-9])([],}}])', 'e-0\\1\\2', 'g') END"


_IMAGE = f"""SELECT run_id, disp_i, v->>'ex_i' AS ex_i, v->>'status' AS status, x->>'image_path' AS image_path, {_as_text("i->'scaling'")} AS scaling, {_as_text("i->'ch_wavelengths'")} AS ch_wavelengths, {_as_text("i->'zooms'")} AS zooms, CASE WHEN json_type(i->'shape') = 'ARRAY' THEN CAST(CAST(i->'shape' AS BIGINT[]) AS JSON)::VARCHAR END AS shape,
CAST(i->>'mag' AS DOUBLE) AS mag FROM (SELECT *, {_open("x->'image_metadata'")} AS i FROM m)"""
_CHANNELS = """SELECT c.run_id, c.disp_i, m.v->>'ex_i' AS ex_i, CAST(CASE WHEN json_type(c.v) = 'OBJECT' THEN c.v->>'index' ELSE CAST(c.k AS VARCHAR) END AS BIGINT) AS channel,
CASE WHEN json_type(c.v) = 'OBJECT' THEN c.v->>'name' ELSE c.v->>'$' END AS name FROM c JOIN m USING (run_id, disp_i) WHERE json_type(c.v) <> 'NULL'"""
_POLYGONS = """SELECT po.run_id, po.disp_i, po.roi AS roi_i, ro.v->>'name' AS roi, po.k AS poly_i, po.v->>'label' AS label, CAST(po.v->>'area_px' AS DOUBLE) AS area_px
FROM po JOIN ro ON po.run_id = ro.run_id AND po.disp_i = ro.disp_i AND po.roi = ro.k"""
QUERIES = {"p5_found": p5_found, "p5_image_metadata": p5_image_metadata, "p5_channels": p5_channels, "p5_polygons": p5_polygons}
SQL = {"p5_found": f"{_FROM} {_FOUND}", "p5_image_metadata": f"{_FROM} {_IMAGE}", "p5_channels": f"{_FROM} {_CHANNELS}", "p5_polygons": f"{_FROM} {_POLYGONS}"}
