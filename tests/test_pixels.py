"""Raster queries over every pixel, against brute force."""

import math
import random

import pytest

from morphoquarry.plans import pixels
from morphoquarry.plans.aggregates import polygons
from morphoquarry.plans.spatial import QUERIES as SPATIAL
from morphoquarry.plans.spatial import points, raster_lookup

RING = "array<struct<x:double,y:double>>"
SCHEMA = f"poly_id long, ex_i string, label long, sub_idx int, channel int, ring {RING}, holes array<{RING}>"
BOX = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
ROWS = [
    (1, "a", 7, 0, 0, BOX(0.0, 0.0, 12.0, 9.0), [BOX(2.0, 2.0, 3.0, 3.0), [(7.5, 1.5), (10.5, 4.0), (7.0, 6.5)]]),
    (2, "a", 8, 0, None, [(1.0, 1.0), (5.5, 7.0), (9.0, 0.5), (1.0, 1.0)], None),
    (3, "a", 9, 0, 0, [(3.2, 3.1), (6.9, 3.2), (5.0, 6.9)], []),
    (4, "b", 7, 0, 1, BOX(1.0, 1.0, 2.0, 2.0), [BOX(2.0, 2.0, 5.0, 5.0), [(0.0, 0.0)]]),
    (5, "b", 7, 0, 2, BOX(6.0, 1.0, 3.0, 2.0), None),
    (6, "b", 7, 0, 2, [(1.0, 1.0), (2.0, 2.0)], None),
]


def inside(ring, y, x):
    crossed = [a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:] + ring[:1]) if min(a[1], b[1]) <= y < max(a[1], b[1])]
    return sum(c <= x for c in crossed) % 2 == 1


def mask(ring, holes):
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = [(y, x) for y in range(math.floor(min(ys)), math.ceil(max(ys)) + 1) for x in range(math.floor(min(xs)), math.ceil(max(xs)) + 1)]
    return {p for p in box if len(ring) > 2 and inside(ring, *p) and not any(len(h) > 2 and inside(h, *p) for h in holes or [])}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pixels"))
    spark.createDataFrame(ROWS + ROWS[:2], SCHEMA).write.parquet(f"{d}/roi_polygons.parquet")
    return d


MASKS = {r[0]: (r[1], mask(r[5], r[6])) for r in ROWS}


def test_every_pixel_without_holes(spark, folder):
    got = [(r.poly_id, int(r.y), int(r.x)) for r in pixels.QUERIES["pixel_rasterise"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, *p) for i, (_, m) in MASKS.items() for p in m}
    areas = {r.poly_id: r.area for r in pixels.QUERIES["region_properties"](spark, folder).collect()}
    assert areas == {i: len(m) for i, (_, m) in MASKS.items() if m} and areas[4] == 3


def test_outlines_of_every_pixel(spark, folder):
    rings = {}
    for r in SPATIAL["polygonise"](spark, folder).collect():
        rings.setdefault((r.ex_i, r.poly_id), []).append([(p.x, p.y) for p in r.ring])
    got = {}
    for key, found in rings.items():
        assert all(ring[0] == ring[-1] for ring in found)
        xs, ys = ([int(p[k]) for ring in found for p in ring] for k in (0, 1))
        got[key] = {(y, x) for y in range(min(ys), max(ys)) for x in range(min(xs), max(xs)) if sum(inside(ring, y + 0.5, x + 0.5) for ring in found) % 2}
    assert got == {(ex, i): m for i, (ex, m) in MASKS.items() if m}
    assert len(rings["a", 1]) == 3 and len(rings["b", 5]) == 1


def test_lookup_at_every_pixel(spark):
    d = "/root/testdata/sf0.001"
    of = {}
    for r in polygons(spark, d).collect():
        ring = [(p.x, p.y) for p in r.ring or []]
        if len(ring) > 2:
            of.setdefault(r.ex_i, []).append((r.label, ring, [[(p.x, p.y) for p in h] for h in r.holes or [] if h and len(h) > 2]))
    want = {}
    for p in points(spark, d).collect():
        y, x = round(p.y), round(p.x)
        want[p.obj_id] = min((n for n, ring, holes in of.get(p.ex_i, []) if inside(ring, y, x) and not any(inside(h, y, x) for h in holes)), default=0)
    whole, coarse = ({r.obj_id: r.roi for r in q(spark, d).collect()} for q in (pixels.QUERIES["pixel_raster_lookup"], raster_lookup))
    assert whole == want and any(want.values()) and coarse != want


def test_every_pair_is_compared(spark, tmp_path):
    rng = random.Random(5)
    rows = [*ROWS, *[(100 + 2 * i, "c", 1, 0, c, BOX(3.0 * i, 2.0 * i, 15.0, 12.0), None) for i, c in enumerate((None, 0, 1, 0))]]
    for i in range(10, 34):
        x, y, w, h = rng.randrange(50), rng.randrange(50), rng.randrange(3, 22), rng.randrange(3, 22)
        rows.append((i, rng.choice("ab"), 1, 0, rng.choice([None, 0, 1, 2]), BOX(float(x), float(y), float(w), float(h)), [BOX(x + 1.0, y + 1.0, w / 2, h / 2), BOX(x + 2.5, y + 1.5, w / 2, h / 3)] if i % 2 else None))
    spark.createDataFrame(rows + rows[:3], SCHEMA).write.parquet(f"{tmp_path}/roi_polygons.parquet")
    masks = {r[0]: (r[1], mask(r[5], r[6]), -1 if r[4] is None else r[4]) for r in rows}
    others = lambda a: [b for b in masks if b != a and masks[b][0] == masks[a][0] and masks[b][1]]
    common = lambda *ids: set.intersection(*[masks[i][1] for i in ids])
    overlap, hit, triple, near = {}, {}, {}, {}
    for a, (_, m, c) in masks.items():
        found = [b for b in others(a) if common(a, b)]
        if found:
            b = min(found, key=lambda b: (-len(common(a, b)), b))
            overlap[a] = (b, len(common(a, b)), round(len(common(a, b)) / len(m | masks[b][1]), 9))
            cy, cx = sum(p[0] for p in m) / len(m), sum(p[1] for p in m) / len(m)
            hit[a] = min((round((p[0] - cy) ** 2 + (p[1] - cx) ** 2, 6), b) for b in found for p in common(a, b))[1]
        best = {k: min((b for b in found if masks[b][2] == k), key=lambda b: (-len(common(a, b)), b)) for k in {masks[b][2] for b in found} - {c}}
        triple |= {(a, best[i], best[j]): round(len(common(a, best[i], best[j])) / len(m), 9) for i in best for j in best if i < j and common(a, best[i], best[j])}
        gaps = [(min((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 for p in m for q in masks[b][1]), b) for b in others(a)] if m else []
        if gaps:
            near[a] = (min(gaps)[1], round(min(gaps)[0] ** 0.5, 6))
    run = lambda name: pixels.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.left_id: (r.right_id, r.shared, r.iou) for r in run("max_overlap_assign")} == overlap
    assert {r.poly_id: r.region for r in run("coords_first_hit")} == hit
    assert {(r.base, r.ch1, r.ch2): r.iou for r in run("overlap_coloc_iou")} == triple
    assert {r.poly_id: (r.target, r.distance) for r in run("min_distance_assign")} == near
    assert triple and any(a % 2 == b % 2 for a, (b, *_) in overlap.items()) and any(0 < v for _, v in near.values())
