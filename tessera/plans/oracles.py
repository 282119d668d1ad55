"""SQL oracles of the registered queries: plain arithmetic, brute force where the engine is clever."""

from __future__ import annotations

GEO = """
geo AS (SELECT p_partkey AS k, CAST((p_partkey * 37) % 3900 AS DOUBLE) + CAST(p_partkey % 8 AS DOUBLE) / 8 AS x,
  CAST((p_partkey * 91) % 3900 AS DOUBLE) + CAST(p_partkey % 4 AS DOUBLE) / 4 AS y, CAST(p_size AS DOUBLE) AS w, CAST((p_size * 7) % 50 + 1 AS DOUBLE) AS h,
  CAST(p_size AS BIGINT) AS size_id, p_brand AS brand, p_type AS kind FROM part),
outline AS (SELECT k, 0 AS part, x, y, w, h,
    CASE k % 3 WHEN 0 THEN [0, 1, 1, 0, 0]::DOUBLE[] WHEN 1 THEN [0, 1, 0.5, 0]::DOUBLE[] ELSE [0, 1, 1, 0.5, 0.5, 0, 0]::DOUBLE[] END AS fx,
    CASE k % 3 WHEN 0 THEN [0, 0, 1, 1, 0]::DOUBLE[] WHEN 1 THEN [0, 0, 1, 0]::DOUBLE[] ELSE [0, 0, 0.5, 0.5, 1, 1, 0]::DOUBLE[] END AS fy FROM geo
  UNION ALL SELECT k, 1, x + w + 2, y, 2, 2, [0, 1, 1, 0, 0]::DOUBLE[], [0, 0, 1, 1, 0]::DOUBLE[] FROM geo WHERE k % 7 = 0),
pts AS (SELECT k, part, i, x + w * fx[i] AS x, y + h * fy[i] AS y FROM (SELECT *, unnest(range(1, len(fx) + 1)) AS i FROM outline)),
edge AS (SELECT p.k, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM pts p JOIN pts q ON p.k = q.k AND p.part = q.part AND q.i = p.i + 1),
lb AS (SELECT k, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM pts GROUP BY k)
"""
GRID = GEO + """,
cfg AS (SELECT CAST(ceil(quantile_cont(maxx - minx, 0.9)) AS INT) AS ow, CAST(ceil(quantile_cont(maxy - miny, 0.9)) AS INT) AS oh,
  greatest(min(minx), 0) AS pl, greatest(min(miny), 0) AS pt, least(max(maxx), 4096) AS pr, least(max(maxy), 4096) AS pb FROM lb),
sc AS (SELECT * FROM (VALUES (0, 64, 64), (1, 256, 256), (2, 512, 512)) v(i, ww, wh), cfg WHERE ww - 2 * ow > 0 AND wh - 2 * oh > 0 ORDER BY i LIMIT 1),
ax AS (SELECT *, greatest(0, pl - ow) AS c0, greatest(0, pt - oh) AS r0, ww - 2 * ow AS sw, wh - 2 * oh AS sh FROM sc),
n AS (SELECT *, CAST(ceil((pr - ow - c0) / sw) AS INT) AS nc, CAST(ceil((pb - oh - r0) / sh) AS INT) AS nr FROM ax),
win AS (SELECT CAST(a.ci * nr + b.ri AS BIGINT) AS window_ord, CAST(a.ci AS INT) AS ci, CAST(b.ri AS INT) AS ri, CAST(floor(c0 + a.ci * sw) AS INT) AS col_off,
  CAST(floor(r0 + b.ri * sh) AS INT) AS row_off, ww AS width, wh AS height
  FROM n, (SELECT unnest(range(0, 500)) AS ci) a, (SELECT unnest(range(0, 500)) AS ri) b WHERE a.ci < nc AND b.ri < nr)
"""
TOUCH = GRID + """,
near AS (SELECT k, window_ord, CAST(col_off AS DOUBLE) AS x0, CAST(row_off AS DOUBLE) AS y0, CAST(col_off + width AS DOUBLE) AS x1, CAST(row_off + height AS DOUBLE) AS y1, col_off, row_off, width, height
  FROM lb, win WHERE minx <= col_off + width AND maxx >= col_off AND miny <= row_off + height AND maxy >= row_off),
touch AS (SELECT n.k, window_ord, any_value(col_off) AS col_off, any_value(row_off) AS row_off, any_value(width) AS width, any_value(height) AS height
  FROM near n JOIN edge e ON e.k = n.k GROUP BY n.k, window_ord
  HAVING bool_or(least(x1_, x2_) <= x1 AND greatest(x1_, x2_) >= x0 AND least(y1_, y2_) <= y1 AND greatest(y1_, y2_) >= y0
      AND abs(sign(s00) + sign(s10) + sign(s01) + sign(s11)) < 4)
    OR count(*) FILTER ((y1_ > y0) <> (y2_ > y0) AND x0 < x1_ + (y0 - y1_) * (x2_ - x1_) / (y2_ - y1_)) % 2 = 1)
"""
# The join's columns are spelt out so that the having clause can name them.
TOUCH = TOUCH.replace(
    "FROM near n JOIN edge e ON e.k = n.k GROUP BY",
    """FROM (SELECT m.*, e.x1 AS x1_, e.y1 AS y1_, e.x2 AS x2_, e.y2 AS y2_,
      (e.x2 - e.x1) * (m.y0 - e.y1) - (e.y2 - e.y1) * (m.x0 - e.x1) AS s00, (e.x2 - e.x1) * (m.y0 - e.y1) - (e.y2 - e.y1) * (m.x1 - e.x1) AS s10,
      (e.x2 - e.x1) * (m.y1 - e.y1) - (e.y2 - e.y1) * (m.x0 - e.x1) AS s01, (e.x2 - e.x1) * (m.y1 - e.y1) - (e.y2 - e.y1) * (m.x1 - e.x1) AS s11
      FROM near m JOIN edge e ON e.k = m.k) n GROUP BY""",
)
PIXELS = """
spans AS (SELECT k, x1, y1, x2, y2, least(y1, y2) AS lo, greatest(y1, y2) AS hi, y1 = y2 AS flat FROM edge WHERE NOT (y1 = y2 AND y1 = floor(y1))),
rowed AS (SELECT *, unnest(range(CAST(floor(lo) AS BIGINT), CASE WHEN flat THEN CAST(floor(lo) AS BIGINT) + 1 ELSE CAST(ceil(hi) AS BIGINT) END)) AS r FROM spans),
cut AS (SELECT k, r, CASE WHEN flat THEN x1 ELSE x1 + (greatest(lo, r) - y1) * (x2 - x1) / (y2 - y1) END AS xa, CASE WHEN flat THEN x2 ELSE x1 + (least(hi, r + 1) - y1) * (x2 - x1) / (y2 - y1) END AS xb FROM rowed),
cover AS (SELECT k, r, CAST(floor(least(xa, xb)) AS BIGINT) AS c0, CAST(ceil(greatest(xa, xb)) AS BIGINT) - 1 AS c1 FROM cut),
hits AS (SELECT k, r, x1 + (r + CAST(0.5 AS DOUBLE) - y1) * (x2 - x1) / (y2 - y1) AS x FROM rowed WHERE NOT flat AND r + CAST(0.5 AS DOUBLE) >= lo AND r + CAST(0.5 AS DOUBLE) < hi),
paired AS (SELECT k, r, x, lead(x) OVER o AS nx, row_number() OVER o AS i FROM hits WINDOW o AS (PARTITION BY k, r ORDER BY x)),
fill AS (SELECT k, r, CAST(ceil(x - CAST(0.5 AS DOUBLE)) AS BIGINT) AS c0, CAST(ceil(nx - CAST(0.5 AS DOUBLE)) AS BIGINT) - 1 AS c1 FROM paired WHERE i % 2 = 1),
px AS (SELECT DISTINCT k, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT * FROM cover UNION ALL SELECT * FROM fill) WHERE c1 >= c0)
"""
CUT = TOUCH + "," + PIXELS + """,
wpx AS (SELECT t.k, t.window_ord, p.r - t.row_off AS r, p.c - t.col_off AS c, t.width, t.height FROM touch t JOIN px p ON p.k = t.k
  AND p.r BETWEEN greatest(t.row_off, 0) AND least(t.row_off + t.height - 1, 4095) AND p.c BETWEEN greatest(t.col_off, 0) AND least(t.col_off + t.width - 1, 4095)),
ann AS (SELECT k, window_ord, count(*) AS area, CAST(min(c) AS INT) AS x, CAST(min(r) AS INT) AS y, CAST(max(c) - min(c) + 1 AS INT) AS w, CAST(max(r) - min(r) + 1 AS INT) AS h FROM wpx GROUP BY k, window_ord),
img AS (SELECT window_ord, row_number() OVER (ORDER BY window_ord) AS image_id FROM (SELECT DISTINCT window_ord FROM touch))
"""
RLE = CUT + """,
flat AS (SELECT k, window_ord, c * height + r AS p, width * height AS total FROM wpx),
isl AS (SELECT k, window_ord, p, total, p - row_number() OVER (PARTITION BY k, window_ord ORDER BY p) AS g FROM flat),
runs AS (SELECT k, window_ord, any_value(total) AS total, min(p) AS s, count(*) AS n FROM isl GROUP BY k, window_ord, g),
gaps AS (SELECT k, window_ord, total, s, n, s - coalesce(lag(s + n) OVER w, 0) AS gap, row_number() OVER w AS i FROM runs WINDOW w AS (PARTITION BY k, window_ord ORDER BY s)),
cnt AS (SELECT k, window_ord, 2 * i - 2 AS i, gap AS n FROM gaps UNION ALL SELECT k, window_ord, 2 * i - 1, n FROM gaps
  UNION ALL SELECT k, window_ord, 2 * max(i), any_value(total) - max(s + n) FROM gaps GROUP BY k, window_ord HAVING max(s + n) < any_value(total)),
dif AS (SELECT k, window_ord, i, CAST(n - CASE WHEN i > 2 THEN lag(n, 2) OVER (PARTITION BY k, window_ord ORDER BY i) ELSE 0 END AS BIGINT) AS x FROM cnt),
grp AS (SELECT *, CASE WHEN x BETWEEN -16 AND 15 THEN 1 WHEN x BETWEEN -512 AND 511 THEN 2 WHEN x BETWEEN -16384 AND 16383 THEN 3 WHEN x BETWEEN -524288 AND 524287 THEN 4 ELSE 5 END AS g FROM dif),
enc AS (SELECT k, window_ord, string_agg(chr(CAST(48 + ((x + 1099511627776) // CAST(pow(32, j) AS BIGINT)) % 32 + CASE WHEN j < g - 1 THEN 32 ELSE 0 END AS INT)), '' ORDER BY i, j) AS counts
  FROM (SELECT *, unnest(range(0, g)) AS j FROM grp) GROUP BY k, window_ord),
whole AS (SELECT row_number() OVER (ORDER BY a.window_ord, size_id, a.k) AS id, image_id, size_id AS category_id, area, a.x AS x, a.y AS y, a.w AS w, a.h AS h, CAST(a.k % 7 = 0 AS INT) AS iscrowd, counts
  FROM ann a JOIN geo USING (k) JOIN img USING (window_ord) JOIN enc ON enc.k = a.k AND enc.window_ord = a.window_ord)
"""
LABELS = "SELECT p_partkey AS ord, CAST(p_size AS BIGINT) AS size_id, p_brand AS brand, p_type AS kind FROM part"
BY_ID = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'nation' AS supercategory FROM nation WHERE n_nationkey > 0"
BY_NAME = "(SELECT CAST(min(p_partkey) * 10 AS BIGINT) AS id, p_brand AS name, 'old' AS supercategory FROM part WHERE p_partkey <= 3 GROUP BY p_brand UNION ALL SELECT 500, 'unused', 'old')"
TILES = """
raster AS (SELECT CAST(vec_id AS INT) AS r, unnest(range(0, 64)) AS c, CAST(embedding[c + 1] AS DOUBLE) AS v0 FROM embeddings),
cells AS (SELECT r, CAST(c AS INT) AS c, CASE WHEN r % 3 = 0 AND v0 < 0 THEN CAST(0 AS DOUBLE) ELSE v0 END AS v FROM raster),
deep AS (SELECT max(r) AS last FROM cells),
wins AS (SELECT CAST(ri * 4 + ci AS BIGINT) AS window_ord, CAST(ci AS INT) * 20 AS col_off, CAST(ri AS INT) * 40 AS row_off
  FROM (SELECT unnest(range(0, CAST(floor((last + 20) / 40) AS BIGINT) + 1)) AS ri FROM deep) a, (SELECT unnest(range(0, 4)) AS ci) b),
spots AS (SELECT window_ord, CAST(a.r AS INT) AS "row", CAST(b.c AS INT) AS col, row_off + a.r AS sr, col_off + b.c AS sc FROM wins, range(0, 40) a(r), range(0, 24) b(c))
"""


def fresh(existing: str, key: str, name: str, parent: str, of: str) -> str:
    return (
        f"ex AS ({existing}), l AS ({LABELS}), f AS (SELECT {key} AS key, arg_min({name}, ord) AS name, arg_min({parent}, ord) AS supercategory FROM l GROUP BY {key}), "
        f"nw AS (SELECT * FROM f WHERE key NOT IN (SELECT {of} FROM ex))"
    )


def named(policy: str, parent: str) -> str:
    base = "SELECT coalesce(max(id), 0) FROM ex" + (" WHERE name IN (SELECT key FROM f)" if policy == "compat" else "")
    return f"WITH {fresh('SELECT * FROM ' + BY_NAME, 'brand', 'brand', parent, 'name')} SELECT CAST(row_number() OVER (ORDER BY key) + ({base}) AS BIGINT) AS id, key AS name, supercategory FROM nw"


def appended(part: int) -> str:
    """Annotations and number of images of the labels of one remainder of two, appended to an empty dataset."""
    chain = CUT.replace("p_type AS kind FROM part", f"p_type AS kind FROM part WHERE p_partkey % 2 = {part}")
    return f"""(WITH {chain} SELECT row_number() OVER (ORDER BY a.window_ord, size_id, a.k) AS id, image_id, size_id AS category_id, CAST(area AS DOUBLE) AS area, a.x AS x, a.y AS y, a.w AS w, a.h AS h,
      (SELECT count(*) FROM img) AS n_images FROM ann a JOIN geo USING (k) JOIN img USING (window_ord))"""


MERGED = f"{fresh(BY_ID, 'size_id', 'brand', 'kind', 'id')}, cats AS (SELECT * FROM ex UNION ALL SELECT key, name, supercategory FROM nw)"
STEP = "CASE WHEN new_dir THEN 'major' WHEN new_source THEN 'minor' ELSE 'patch' END"

ORACLES = {
    "validate_labels": """SELECT count(*) FILTER (p_partkey % 60 = 1) AS null_geometry, count(*) FILTER (p_partkey % 60 = 2) AS invalid_geometry,
      count(*) FILTER (p_partkey % 50 IN (3, 4)) AS bad_id, count(*) FILTER (p_partkey % 40 = 5) AS bad_name, count(*) FILTER (p_partkey % 30 = 6) AS bad_super FROM part""",
    "categories_by_id": f"WITH {fresh(BY_ID, 'size_id', 'CAST(size_id AS VARCHAR)', chr(39) + '1' + chr(39), 'id')} SELECT key AS id, name, supercategory FROM nw",
    "categories_by_both": f"WITH {fresh(BY_ID, 'size_id', 'brand', 'kind', 'id')} SELECT key AS id, name, supercategory FROM nw",
    "categories_super": f"WITH {fresh(BY_ID, 'size_id', 'CAST(size_id AS VARCHAR)', 'kind', 'id')} SELECT key AS id, name, supercategory FROM nw",
    "categories_by_name": named("compat", "'1'"),
    "categories_append_names": named("safe", "kind"),
    "categories_merged": f"WITH {MERGED} SELECT id, name, supercategory FROM cats",
    "label_category_join": f"WITH {MERGED} SELECT l.ord AS label_ord, c.id, c.name, c.supercategory FROM l JOIN cats c ON c.id = l.size_id",
    "label_bounds": f"WITH {GEO} SELECT k AS label_ord, minx, -maxy AS miny, maxx, -miny AS maxy FROM lb",
    "label_quantile": f"WITH {GEO} SELECT CAST(q AS DOUBLE) AS q, w[i] AS width, h[i] AS height FROM (SELECT quantile_cont(maxx - minx, [0.1, 0.5, 0.8, 0.9]) AS w, quantile_cont(maxy - miny, [0.1, 0.5, 0.8, 0.9]) AS h FROM lb), (VALUES (1, 0.1), (2, 0.5), (3, 0.8), (4, 0.9)) v(i, q)",
    # A box is convex: a label is within it, border included, where its extent is.
    "label_filters": f"""WITH {GEO} SELECT lb.k AS label_ord, size_id FROM lb JOIN geo USING (k) WHERE size_id IN (1, 5, 9, 20, 33, 48)
      AND minx >= 500 AND maxx <= 2500 AND -maxy >= -2500 AND -miny <= -500""",
    "window_schema": f"WITH {GRID} SELECT ww AS width_window, wh AS height_window, ow AS width_overlap, oh AS height_overlap, sw AS width_step, sh AS height_step FROM ax",
    "parent_window": f"WITH {GRID} SELECT CAST(pl AS DOUBLE) AS col_off, CAST(pt AS DOUBLE) AS row_off, CAST(pr - pl AS DOUBLE) AS width, CAST(pb - pt AS DOUBLE) AS height FROM cfg",
    "window_offsets": f"WITH {GRID} SELECT window_ord, ci, ri, col_off, row_off, width, height FROM win",
    "window_clip": f"""WITH {GRID} SELECT window_ord, greatest(CAST(col_off AS DOUBLE), pl) AS col_off, greatest(CAST(row_off AS DOUBLE), pt) AS row_off,
      least(CAST(col_off + width AS DOUBLE), pr) - greatest(CAST(col_off AS DOUBLE), pl) AS width, least(CAST(row_off + height AS DOUBLE), pb) - greatest(CAST(row_off AS DOUBLE), pt) AS height FROM win, cfg""",
    "window_polygon": f"""WITH {GRID} SELECT window_ord, 100 + col_off * CAST(0.5 AS DOUBLE) AS minx, 50 - (row_off + height) * CAST(0.25 AS DOUBLE) AS miny,
      100 + (col_off + width) * CAST(0.5 AS DOUBLE) AS maxx, 50 - row_off * CAST(0.25 AS DOUBLE) AS maxy FROM win""",
    "window_label_join": f"WITH {TOUCH} SELECT window_ord, count(*) AS n_labels, count(*) FILTER (k % 7 = 0) AS n_crowd, CAST(sum(k) AS BIGINT) AS label_sum FROM touch GROUP BY window_ord",
    "label_mask_rows": f"""WITH {GEO}, {PIXELS}, isl AS (SELECT k, r, c, c - row_number() OVER (PARTITION BY k, r ORDER BY c) AS g FROM px)
      SELECT k AS label_ord, CAST(r AS INT) AS "row", CAST(min(c) AS INT) AS c0, CAST(max(c) AS INT) AS c1 FROM isl GROUP BY k, r, g""",
    "mask_area_bbox": f"WITH {CUT} SELECT k AS label_ord, window_ord, CAST(k % 7 = 0 AS INT) AS iscrowd, area, x, y, w, h FROM ann",
    "rle_counts": f"""WITH {CUT}, flat AS (SELECT k, window_ord, c * height + r AS p, width * height AS total FROM wpx),
      isl AS (SELECT k, window_ord, p, total, p - row_number() OVER (PARTITION BY k, window_ord ORDER BY p) AS g FROM flat),
      runs AS (SELECT k, window_ord, any_value(total) AS total, min(p) AS s, count(*) AS n FROM isl GROUP BY k, window_ord, g),
      gaps AS (SELECT k, window_ord, total, s, n, s - coalesce(lag(s + n) OVER (PARTITION BY k, window_ord ORDER BY s), 0) AS gap FROM runs)
      SELECT k AS label_ord, window_ord, string_agg(gap || ',' || n, ',' ORDER BY s) || CASE WHEN max(s + n) < any_value(total) THEN ',' || (any_value(total) - max(s + n)) ELSE '' END AS counts FROM gaps GROUP BY k, window_ord""",
    "images": f"WITH {TOUCH}, img AS (SELECT DISTINCT window_ord, col_off, row_off, width, height FROM touch) SELECT row_number() OVER (ORDER BY window_ord) AS id, width, height, '/data/images/1_' || col_off || '_' || row_off || '_' || width || '_' || height || '.jpg' AS file_name, CAST(1 AS BIGINT) AS source_id FROM img",
    "annotations": f"""WITH {CUT} SELECT row_number() OVER (ORDER BY a.window_ord, size_id, a.k) AS id, image_id, size_id AS category_id, CAST(area AS DOUBLE) AS area, a.x, a.y, a.w, a.h,
      CAST(a.k % 7 = 0 AS INT) AS iscrowd, 256 AS "rows", 256 AS cols FROM ann a JOIN geo USING (k) JOIN img USING (window_ord)""",
    "annotation_masks": f'WITH {RLE} SELECT id, image_id, 256 AS "rows", 256 AS cols, counts FROM whole',
    "append_twice": f"""WITH one AS {appended(0)}, two AS {appended(1)}
      SELECT id, image_id, category_id, area, x, y, w, h, CAST(1 AS BIGINT) AS source_id, '/data/even' AS dir, '2.0.0' AS version, 1 AS n_sources FROM one
      UNION ALL SELECT id + (SELECT count(*) FROM one), image_id + (SELECT max(n_images) FROM one), category_id, area, x, y, w, h, 1, '/data/odd', '2.0.0', 1 FROM two""",
    "coco_json": f"""WITH {RLE}, {MERGED}, pic AS (SELECT DISTINCT window_ord, col_off, row_off, width, height FROM touch)
      SELECT 'images' AS "table", '{{"id":' || row_number() OVER (ORDER BY window_ord) || ',"width":' || width || ',"height":' || height || ',"file_name":"/data/images/1_' || col_off || '_' || row_off || '_' || width || '_' || height
        || '.jpg","source_id":1,"date_captured":null}}' AS j FROM pic
      UNION ALL SELECT 'annotations', '{{"id":' || id || ',"image_id":' || image_id || ',"category_id":' || category_id || ',"segmentation":{{"size":[256,256],"counts":"' || replace(counts, '\\', '\\\\') || '"}},"area":' || area
        || '.0,"bbox":[' || x || ',' || y || ',' || w || ',' || h || '],"iscrowd":' || iscrowd || '}}' FROM whole
      UNION ALL SELECT 'categories', '{{"id":' || id || ',"name":"' || name || '","supercategory":"' || supercategory || '"}}' FROM cats""",
    "tile_pad": f'WITH {TILES} SELECT window_ord, "row", col, coalesce(v, CAST(-9 AS DOUBLE)) AS value FROM spots LEFT JOIN cells ON r = sr AND c = sc',
    "tile_normalize": f"""WITH {TILES}, f AS (SELECT window_ord, "row", col, coalesce(v, CAST(0 AS DOUBLE)) AS v FROM spots LEFT JOIN cells ON r = sr AND c = sc),
      e AS (SELECT *, min(v) OVER (PARTITION BY window_ord) AS lo, max(v) OVER (PARTITION BY window_ord) AS hi FROM f)
      SELECT window_ord, "row", col, CASE WHEN hi > lo THEN CAST(round_even((v - lo) * CAST(255 AS DOUBLE) / (hi - lo), 0) AS INT) ELSE 0 END AS value FROM e""",
    "raster_reshape": f"""WITH {TILES}, frame AS (SELECT CAST(b AS INT) AS band, CAST(r AS INT) AS "row", CAST(c AS INT) AS c FROM range(0, 2) x(b), (SELECT unnest(range(0, last + 1 + (last + 1) // 10)) AS r FROM deep) y, range(0, 80) z(c)),
      f AS (SELECT band, frame."row", frame.c, coalesce(v, CAST(-1 AS DOUBLE)) AS v FROM frame LEFT JOIN cells ON band = 0 AND cells.r = frame."row" AND cells.c = frame.c)
      SELECT band, "row", CAST(count(*) AS INT) AS n, count(*) FILTER (v = -1) AS padded, round(max(v) FILTER (c = 5), 5) AS sixth FROM f GROUP BY band, "row" """,
    "pixel_validity": f"""WITH {TILES}, isl AS (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS g FROM cells WHERE v = 0)
      SELECT r AS "row", min(c) AS c0, max(c) AS c1 FROM isl GROUP BY r, g""",
    "pixel_validity_int16": f"""WITH {TILES}, isl AS (SELECT r, c, c - row_number() OVER (PARTITION BY r ORDER BY c) AS g FROM cells WHERE floor(v * 100) = -7)
      SELECT r AS "row", min(c) AS c0, max(c) AS c1 FROM isl GROUP BY r, g""",
    "masks_valid": f"""WITH {GEO}, {PIXELS}, {TILES} SELECT k AS label_ord, CAST(px.r AS INT) AS "row", count(*) AS n FROM px LEFT JOIN cells ON cells.r = px.r AND cells.c = px.c WHERE v IS NULL OR v <> 0 GROUP BY k, px.r""",
    "sources_versions": """WITH RECURSIVE l AS (SELECT o_custkey AS dataset, o_orderkey AS ord, strftime(o_orderdate, '%Y-%m') AS source, o_orderpriority AS dir,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
      n AS (SELECT *, row_number() OVER (PARTITION BY dataset, source ORDER BY ord) = 1 AS new_source, row_number() OVER (PARTITION BY dataset, dir ORDER BY ord) = 1 AS new_dir FROM l),
      fold AS (SELECT dataset, ord, i, 1 AS major, 0 AS minor, 0 AS patch FROM n WHERE i = 1
        UNION ALL SELECT n.dataset, n.ord, n.i, major + CAST(new_dir AS INT), CASE WHEN new_dir THEN 0 ELSE minor + CAST(new_source AS INT) END, CASE WHEN new_dir OR new_source THEN 0 ELSE patch + 1 END
        FROM fold JOIN n ON n.dataset = fold.dataset AND n.i = fold.i + 1),
      ids AS (SELECT dataset, source, row_number() OVER (PARTITION BY dataset ORDER BY min(ord)) AS source_id FROM n GROUP BY dataset, source)
      SELECT n.dataset, n.ord, source_id, major || '.' || minor || '.' || patch AS version FROM n JOIN fold USING (dataset, ord) JOIN ids USING (dataset, source)""",
    "version_bumps": """WITH v AS (SELECT event_id, user_id % 5 AS a, event_id % 7 AS b, event_id % 11 AS c, ['patch', 'minor', 'major'][event_id % 3 + 1] AS method FROM events)
      SELECT event_id, a || '.' || b || '.' || c AS version, method, CASE method WHEN 'patch' THEN a || '.' || b || '.' || (c + 1) WHEN 'minor' THEN a || '.' || (b + 1) || '.0' ELSE (a + 1) || '.0.0' END AS bumped FROM v""",
    "capture_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 OR o_orderkey % 4 = 3 THEN TIMESTAMP '2020-02-02 02:02:02'
      WHEN o_orderkey % 4 IN (0, 1) THEN date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) ELSE CAST(o_orderdate AS TIMESTAMP) END AS captured FROM orders""",
    "used_dirs": "SELECT '/data/images' AS dir",
}
