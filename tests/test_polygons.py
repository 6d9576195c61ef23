"""Points in polygons: strips are shuffled, and pairs are summed where a point or a strip comes in several rows."""

import numpy as np
from conftest import SMALL

from patchscope.operators import patches
from patchscope.plans import all_queries


def test_no_side_of_the_join_is_broadcast(spark):
    """The table of polygons is small, what it unfolds into is not."""
    text = all_queries()[0]["points_in_polygons"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and "SortMergeJoin" in text


def test_repeated_points_and_cut_strips_count_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for poly in (1, 2, None, 4, 4):  # 4 comes twice, so that nothing is inside
        angle = np.sort(rng.random(9)) * 2 * np.pi
        x, y = (5 + 4 * f(angle) * (0.4 + 0.6 * rng.random(9)) for f in (np.cos, np.sin)) if poly != 4 else (np.array([1.0, 9, 9, 1]), np.array([1.0, 1, 9, 9]))
        rows += [(poly, float(x[i - 1]), float(y[i - 1]), float(x[i]), float(y[i])) for i in range(len(x))]
    rows += [(7, 2.0, 3.0, 2.0, 8.0), (7, None, 1.0, 4.0, 9.0), (1, 3.0, None, 3.0, 3.0)]  # an open polygon, edges with a gap
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((150, 2)) * 10)]
    pts += [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((20, 2)) * 10)] + pts[30:40] + [(None, 5.0, 5.0), (None, 0.1, 0.1), (900, None, 5.0)]
    points, edges = spark.createDataFrame(pts, "id int, px double, py double"), spark.createDataFrame(rows, "poly_id int, x0 double, y0 double, x1 double, y1 double")

    box = {}
    for poly, *e in rows:
        xs = [v for v in e[::2] if v is not None]
        box[poly] = (min([*xs, box.get(poly, (9e9, 0))[0]]), max([*xs, box.get(poly, (0, -9e9))[1]]))
    count = {}
    for i, px, py in pts:
        for poly, x0, y0, x1, y1 in rows:
            if None in (px, x0, y0, x1, y1) or not box[poly][0] <= px <= box[poly][1]:
                continue
            hit = (y0 > py) != (y1 > py) and px < (x1 - x0) * (py - y0) / (y1 - y0) + x0
            count[i, poly] = count.get((i, poly), 0) + hit
    want = sorted((k for k, n in count.items() if n % 2), key=repr)
    for most in (4096, 2, 1):
        monkeypatch.setattr(patches, "STRIP_EDGES", most)
        for band in (0.7, 20.0):
            got = [(r["id"], r["poly_id"]) for r in patches.points_in_polygons(points, edges, "id", band=band).collect()]
            assert sorted(got, key=repr) == want, (most, band)
    assert any(i is None for i, _ in want) and any(p is None for _, p in want)
