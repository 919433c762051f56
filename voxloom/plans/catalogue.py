"""Queries over generated volumes and over volumes and graphs derived from the tables, with their SQL.

A query is a function of (spark, sf_dir).  ``@query(sql)`` registers it with the statement that gives the same rows on the
same tables; without one, tests hold it against the kernels and fixed expectations."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.functions.voxel import allowed, affine, flat_index, freespace_distance, integer_label, penalty, step_array, steps, unravel
from voxloom.kernels.grid import GRAPH_BITS, OFFSETS
from voxloom.operators import aggregates as agg
from voxloom.operators import analysis, components as cc, distance, filters, joins, morphology, paths, postprocess as post, setops
from voxloom.operators.grouped import dealt
from voxloom.params import DEFAULT_TEASAR_PARAMS
from voxloom.plans import pipeline, shapes
from voxloom.plans.fixpoint import shared_base
from voxloom.schemas import VOLUMES, VOXELS
from voxloom.sources import volumes as src
from voxloom.streaming.slabs import SlabComponents, SlabDistances, SlabSkeletons

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# fixtures, in Spark and in SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, side: int, *, sides: tuple[int, int, int] | None = None, aniso=(1.0, 1.0, 1.0)) -> DataFrame:
    return spark.createDataFrame([(0, *(sides or (side, side, side)), *aniso)], VOLUMES)


def order_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.lineitem_voxels(table(spark, sf_dir, "lineitem"))


def order_volume(spark: SparkSession, voxels: DataFrame) -> DataFrame:
    return voxels.agg((F.max("y") + 1).alias("sy")).select(F.lit(0).cast("long").alias("volume_id"), F.lit(64).cast("long").alias("sx"), "sy", F.lit(50).cast("long").alias("sz"), F.lit(1.0).alias("ax"), F.lit(1.0).alias("ay"), F.lit(1.0).alias("az"))


def polylines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = src.event_polylines(table(spark, sf_dir, "events"))
    return v, src.polyline_edges(v)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return dealt(rows.select(F.lit(0).cast("long").alias("volume_id"), F.lit(0).cast("long").alias("label"), F.col("l_orderkey").alias("e0"), (F.col("l_partkey") + 1000000000).alias("e1")), rows.count(), "e0", "e1").distinct()


def point_queries(spark: SparkSession, sf_dir: str, voxels: DataFrame) -> DataFrame:
    size = order_volume(spark, voxels).select("sy")
    rows = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(size))  # one row
    part = lambda i, s: F.pmod(F.floor(F.col("embedding")[i].cast("double") * 1000).cast("long"), s) + 0.25
    return rows.select(F.col("vec_id").alias("qid"), (1 + F.col("label") % 3).cast("long").alias("label"), part(0, F.lit(64)).alias("cx"), part(1, F.col("sy")).alias("cy"), part(2, F.lit(50)).alias("cz"), (F.col("vec_id") % 4).alias("tag"))


def generated_sql(name: str, side: int, case: str) -> str:
    return f"{name} AS (SELECT x, y, z, x + {side} * (y + {side} * z) AS vid, label FROM (SELECT *, CAST(CASE {case} ELSE 0 END AS BIGINT) AS label FROM (SELECT i % {side} AS x, (i // {side}) % {side} AS y, i // {side * side} AS z FROM range({side**3}) r(i))) WHERE label <> 0)"


TUBES = generated_sql("vox", 24, "WHEN (x-8)*(x-8)+(y-8)*(y-8)+(z-8)*(z-8) <= 25 OR (x BETWEEN 7 AND 9 AND y BETWEEN 7 AND 9 AND z BETWEEN 8 AND 22) THEN 1 WHEN x BETWEEN 16 AND 19 AND z BETWEEN 16 AND 19 AND y BETWEEN 2 AND 21 THEN 2 WHEN x BETWEEN 2 AND 21 AND y BETWEEN 18 AND 20 AND z BETWEEN 2 AND 4 THEN 2")
SPECKLES = generated_sql("vox", 24, "WHEN (7919*x+104729*y+1299709*z+31*x*y+17*y*z+13*x*z) % 97 < 14 THEN 1 + (5*x+3*y+7*z) % 2")
HOLLOW = generated_sql("vox", 15, "WHEN x BETWEEN 2 AND 12 AND y BETWEEN 2 AND 12 AND z BETWEEN 2 AND 12 AND (x IN (2,12) OR y IN (2,12) OR z IN (2,12)) THEN 42 WHEN x BETWEEN 6 AND 8 AND y BETWEEN 6 AND 8 AND z BETWEEN 6 AND 8 THEN 77")
WARM = generated_sql("vox", 40, "WHEN (x-14)*(x-14)+(y-14)*(y-14)+(z-14)*(z-14) <= 100 OR (x BETWEEN 12 AND 16 AND y BETWEEN 12 AND 16 AND z BETWEEN 14 AND 37) THEN 1 WHEN x BETWEEN 28 AND 31 AND z BETWEEN 28 AND 31 AND y BETWEEN 4 AND 35 THEN 2 WHEN x BETWEEN 4 AND 35 AND y BETWEEN 30 AND 33 AND z BETWEEN 4 AND 7 THEN 3")


ORDERS = """raw AS (SELECT l_orderkey % 64 AS x, l_suppkey AS y, CAST(l_quantity AS BIGINT) - 1 AS z, CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS label FROM lineitem),
dims AS (SELECT max(y) + 1 AS sy FROM raw),
vox AS (SELECT x, y, z, min(label) AS label, x + 64 * (y + any_value(sy) * z) AS vid FROM raw, dims GROUP BY x, y, z)"""

STEPS = "off AS (SELECT CAST(k AS BIGINT) AS k, CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy, CAST(dz AS BIGINT) AS dz, CAST(bit AS BIGINT) AS bit FROM (VALUES " + ", ".join(f"({k}, {x}, {y}, {z}, {GRAPH_BITS[k]})" for k, (x, y, z) in enumerate(OFFSETS.tolist())) + ") o(k, dx, dy, dz, bit))"
NEAR = f"{STEPS}, nb AS MATERIALIZED (SELECT a.vid AS a, b.vid AS b, k, bit, sqrt(dx*dx + dy*dy + dz*dz) AS w FROM vox a, off JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND b.label = a.label)"
ROOTS = f"{NEAR}, t(id, root) USING KEY (id) AS (SELECT vid, vid FROM vox UNION SELECT nb.b, min(t.root) FROM t JOIN nb ON nb.a = t.id JOIN recurring.t r ON r.id = nb.b WHERE t.root < r.root GROUP BY nb.b), comp AS (SELECT vox.*, root, dense_rank() OVER (ORDER BY root) AS cc FROM vox JOIN t ON t.id = vox.vid)"
#: The same over all of lineitem's voxels: neighbours meet by index, after a test that the step stays inside.
ORDER_ROOTS = f"""{STEPS}, nb AS MATERIALIZED (SELECT a.vid AS a, b.vid AS b FROM (SELECT vox.*, vid + dx + 64 * (dy + sy * dz) AS nvid, x + dx AS nx, y + dy AS ny, z + dz AS nz, sy FROM vox, off, dims) a JOIN vox b ON b.vid = a.nvid AND b.label = a.label WHERE nx BETWEEN 0 AND 63 AND ny BETWEEN 0 AND a.sy - 1 AND nz BETWEEN 0 AND 49),
t(id, root) USING KEY (id) AS (SELECT vid, vid FROM vox UNION SELECT nb.b, min(t.root) FROM t JOIN nb ON nb.a = t.id JOIN recurring.t r ON r.id = nb.b WHERE t.root < r.root GROUP BY nb.b), comp AS (SELECT vox.*, root, dense_rank() OVER (ORDER BY root) AS cc FROM vox JOIN t ON t.id = vox.vid)"""
POLY = """k AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS z FROM (SELECT DISTINCT event_type FROM events)),
v AS (SELECT user_id + 1 AS label, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS vidx, CAST(floor(value) AS BIGINT) AS y, z, 1 + event_id % 5 AS radius FROM events JOIN k USING (event_type)),
vert AS (SELECT label, vidx, vidx AS x, y, z, radius FROM v),
edge AS (SELECT * FROM (SELECT label, vidx AS e0, lead(vidx) OVER (PARTITION BY label ORDER BY vidx) AS e1 FROM vert) WHERE e1 IS NOT NULL)"""
POINTS = "q AS (SELECT vec_id AS qid, CAST(1 + label % 3 AS BIGINT) AS label, ((CAST(floor(CAST(embedding[1] AS DOUBLE) * 1000) AS BIGINT) % 64) + 64) % 64 + 0.25 AS cx, ((CAST(floor(CAST(embedding[2] AS DOUBLE) * 1000) AS BIGINT) % sy) + sy) % sy + 0.25 AS cy, ((CAST(floor(CAST(embedding[3] AS DOUBLE) * 1000) AS BIGINT) % 50) + 50) % 50 + 0.25 AS cz, vec_id % 4 AS tag FROM embeddings, dims)"
WITH = "WITH RECURSIVE "


def out(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c) for c in columns])


# sources and projections


@query(WITH + WARM + " SELECT label, count(*) AS voxels, min(x) AS lo_x, max(x) AS hi_x, min(z) AS lo_z, max(z) AS hi_z FROM vox GROUP BY label")
def warm_up_volume(spark, sf_dir):
    return src.warm_up(spark).groupBy("label").agg(F.count("*").alias("voxels"), F.min("x").alias("lo_x"), F.max("x").alias("hi_x"), F.min("z").alias("lo_z"), F.max("z").alias("hi_z"))


@query(WITH + TUBES + " SELECT x, y, z, vid, label FROM vox")
def blocks_to_voxels(spark, sf_dir):
    """The volume as blocks of compressed bytes, and back."""
    blocks = src.to_blocks(src.small_tubes(spark), cube(spark, 24), side=16)
    return out(src.voxels_of_compressed(blocks, cube(spark, 24)), "x", "y", "z", "vid", "label")


@query(WITH + ORDERS + " SELECT vid, x, y, z FROM vox WHERE label = 2")
def blocks_of_one_label(spark, sf_dir):
    """Only blocks that list the label are decoded."""
    v = order_voxels(spark, sf_dir)
    size = order_volume(spark, v)
    return out(src.voxels_of_compressed(src.to_blocks(v, size, side=32), size, label=2), "vid", "x", "y", "z")


@query(WITH + TUBES + " SELECT x, y, z, vid, label FROM vox")
def arrow_to_voxels(spark, sf_dir):
    """Columns that arrive in memory as Arrow."""
    return out(src.from_arrow(spark, src.small_tubes(spark).toArrow(), cube(spark, 24)), "x", "y", "z", "vid", "label")


@query(WITH + ORDERS + " SELECT f AS factor, CASE WHEN max(label) * f < 256 THEN 'u1' WHEN max(label) * f < 65536 THEN 'u2' WHEN max(label) * f < 4294967296 THEN 'u4' ELSE 'u8' END AS type FROM vox, (VALUES (CAST(1 AS BIGINT)), (1000), (1000000), (10000000000)) m(f) GROUP BY f")
def label_types(spark, sf_dir):
    rows = order_voxels(spark, sf_dir).withColumn("factor", F.explode(F.array(*[F.lit(f).cast("long") for f in (1, 1000, 1000000, 10000000000)])))
    return src.narrowest(rows.withColumns({"label": F.col("label") * F.col("factor"), "volume_id": F.col("factor")})).select(F.col("volume_id").alias("factor"), "type")


@query(WITH + ORDERS + " SELECT vid, x, y, z, vid % 64 AS ux, (vid // 64) % sy AS uy, vid // (64 * sy) AS uz FROM vox, dims")
def index_round_trip(spark, sf_dir):
    v = order_voxels(spark, sf_dir)
    rows = v.join(order_volume(spark, v).drop("volume_id"))
    x, y, z = unravel("vid", "sx", "sy")
    return rows.select(flat_index("x", "y", "z", "sx", "sy").alias("vid"), "x", "y", "z", x.alias("ux"), y.alias("uy"), z.alias("uz"))


@query("SELECT x0, x1, y0, y1, z0, z1, row_number() OVER (ORDER BY x0, y0, z0) - 1 AS chunk_id FROM (SELECT r.range AS x0, least(r.range + 64, 200) AS x1 FROM range(0, 199, 63) r), (SELECT range AS y0, least(range + 32, 100) AS y1 FROM range(0, 99, 31)), (SELECT range AS z0, least(range + 50, 50) AS z1 FROM range(0, 49, 49))")
def chunk_plan(spark, sf_dir):
    return src.iter_chunks(spark, (200, 100, 50), (64, 32, 50))


@query("SELECT vid, count(*) AS chunks FROM (WITH " + TUBES + " SELECT vid FROM vox, (SELECT range AS x0 FROM range(0, 23, 9)), (SELECT range AS y0 FROM range(0, 23, 9)), (SELECT range AS z0 FROM range(0, 23, 9)) WHERE x BETWEEN x0 AND x0 + 9 AND y BETWEEN y0 AND y0 + 9 AND z BETWEEN z0 AND z0 + 9) GROUP BY vid")
def chunk_membership(spark, sf_dir):
    return src.to_chunks(src.small_tubes(spark), cube(spark, 24), (10, 10, 10)).groupBy("vid").agg(F.count("*").alias("chunks"))


@query("SELECT free, CAST(least(100, s) AS BIGINT) AS sx, CAST(least(300, s) AS BIGINT) AS sy, CAST(least(5000, s) AS BIGINT) AS sz FROM (SELECT free, greatest(64, CAST(floor(pow(0.85 * free / 108, 1.0 / 3)) AS BIGINT) // 32 * 32) AS s FROM (VALUES (25769803776), (1073741824), (1048576)) f(free))")
def chunk_shape(spark, sf_dir):
    rows = [(free, *src.chunk_side((100, 300, 5000), 4, free)) for free in (24 << 30, 1 << 30, 1 << 20)]
    return spark.createDataFrame(rows, "free long, sx long, sy long, sz long")


@query("SELECT event_id, CASE WHEN isnan(value) THEN -9223372036854775808 ELSE CAST(trunc(value) AS BIGINT) END AS label FROM events")
def float_labels(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", integer_label("value").alias("label"))


@query(WITH + ORDERS + " SELECT label, count(*) AS voxels FROM vox WHERE label IN (1, 3) GROUP BY label")
def label_filter_ids(spark, sf_dir):
    return filters.keep_ids(order_voxels(spark, sf_dir), [3, 1, 3]).groupBy("label").agg(F.count("*").alias("voxels"))


@query(WITH + ORDERS + " SELECT label, count(*) AS voxels FROM vox SEMI JOIN (SELECT DISTINCT 1 + s_suppkey % 2 AS label FROM supplier) USING (label) GROUP BY label")
def label_filter_table(spark, sf_dir):
    ids = table(spark, sf_dir, "supplier").select((1 + F.col("s_suppkey") % 2).alias("id")).distinct()
    return filters.keep_ids(order_voxels(spark, sf_dir), ids).groupBy("label").agg(F.count("*").alias("voxels"))


@query(WITH + ORDERS + " SELECT bool_or(label IN (2)) AS some, bool_or(label IN (9)) AS none FROM vox")
def label_filter_any(spark, sf_dir):
    v = order_voxels(spark, sf_dir)
    return spark.createDataFrame([(filters.any_foreground(v, [2]), filters.any_foreground(v, [9]))], "some boolean, none boolean")


@query(WITH + ORDERS + " SELECT label, count(*) AS voxels, CAST(sum(CASE WHEN label <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS ones FROM vox GROUP BY label")
def binarised_counts(spark, sf_dir):
    v = order_voxels(spark, sf_dir)
    b = filters.binarised(v).select("vid", F.col("label").alias("one"))
    return v.join(b, "vid").groupBy("label").agg(F.count("*").alias("voxels"), F.sum("one").alias("ones"))


@query(WITH + ORDERS + ", f AS (SELECT label, min(vid) AS first FROM vox GROUP BY label) SELECT label, dense_rank() OVER (ORDER BY first) AS new_label, n AS voxels FROM f JOIN (SELECT label, count(*) AS n FROM vox GROUP BY label) USING (label)")
def dense_renumber(spark, sf_dir):
    return filters.dense_renumber(order_voxels(spark, sf_dir)).groupBy("label", "new_label").agg(F.count("*").alias("voxels"))


@query(WITH + TUBES + f", {STEPS} SELECT vid, bit_or(1::BIGINT << bit) AS bits, count(*) AS degree FROM vox, off WHERE x+dx BETWEEN 0 AND 23 AND y+dy BETWEEN 0 AND 23 AND z+dz BETWEEN 0 AND 23 AND EXISTS (SELECT 1 FROM vox b WHERE b.x = vox.x+dx AND b.y = vox.y+dy AND b.z = vox.z+dz AND b.label = vox.label) GROUP BY vid")
def graph_bits(spark, sf_dir):
    return out(joins.neighbour_bits(src.small_tubes(spark), cube(spark, 24)), "vid", "bits", "degree")


@query(WITH + SPECKLES + f", {NEAR} SELECT a AS vid, count(*) AS degree FROM nb GROUP BY a")
def neighbor_degree26(spark, sf_dir):
    return out(joins.neighbour_bits(src.speckles(spark), cube(spark, 24)), "vid", "degree")


@query(WITH + SPECKLES + f", {NEAR}, g AS (SELECT vid, coalesce((SELECT bit_or(1::BIGINT << bit) FROM nb WHERE a = vid), 0) AS bits FROM vox) SELECT bit, count(*) AS allowed FROM g, off WHERE (bits >> bit) & 1 = 1 GROUP BY bit")
def graph_bit_decode(spark, sf_dir):
    bits = joins.neighbour_bits(src.speckles(spark), cube(spark, 24)).select("vid", "bits")
    return bits.select("vid", "bits", F.inline(step_array())).where(allowed("bits", "bit")).groupBy("bit").agg(F.count("*").alias("allowed"))


@query(WITH + ORDERS + ", f AS (SELECT 0 AS face, x AS u, y AS v, label FROM vox WHERE z = 0 UNION ALL SELECT 1, x, y, label FROM vox WHERE z = 49 UNION ALL SELECT 2, x, z, label FROM vox WHERE y = 0 UNION ALL SELECT 3, x, z, label FROM vox, dims WHERE y = sy - 1 UNION ALL SELECT 4, y, z, label FROM vox WHERE x = 0 UNION ALL SELECT 5, y, z, label FROM vox WHERE x = 63) SELECT CAST(face AS BIGINT) AS face, label, count(*) AS pixels, CAST(sum(u) AS BIGINT) AS sum_u, CAST(sum(v) AS BIGINT) AS sum_v FROM f GROUP BY face, label")
def face_pixels(spark, sf_dir):
    v = order_voxels(spark, sf_dir)
    return filters.faces(v, order_volume(spark, v)).groupBy("face", "label").agg(F.count("*").alias("pixels"), F.sum("u").alias("sum_u"), F.sum("v").alias("sum_v"))


@query(f"WITH {STEPS} SELECT k, dx, dy, dz, least(abs(dx), abs(dy), abs(dz)) AS corner, round(sqrt(dx*dx*9 + dy*dy*9 + dz*dz*9), 4) AS d FROM off")
def freespace_steps(spark, sf_dir):
    """Three steps in each direction over free space."""
    far = freespace_distance(F.col("dx") * 3, F.col("dy") * 3, F.col("dz") * 3)
    return steps(spark).select("k", "dx", "dy", "dz", F.least(F.abs("dx"), F.abs("dy"), F.abs("dz")).alias("corner"), F.round(far, 4).alias("d"))


@query(WITH + POLY + " SELECT label, vidx, CAST(2 * x + 10 AS DOUBLE) AS tx, CAST(3 * y - 1 AS DOUBLE) AS ty, CAST(40 * z AS DOUBLE) AS tz FROM vert")
def affine_vertices(spark, sf_dir):
    v, _ = polylines(spark, sf_dir)
    x, y, z = affine("x", "y", "z", [[2.0, 0.0, 0.0, 10.0], [0.0, 3.0, 0.0, -1.0], [0.0, 0.0, 40.0, 0.0]])
    return v.select("label", "vidx", x.alias("tx"), y.alias("ty"), z.alias("tz"))


# aggregates


@query(WITH + ORDERS + " SELECT label, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z, count(*) AS voxels, min(vid) AS root FROM vox GROUP BY label")
def bbox_by_label(spark, sf_dir):
    return agg.box_stats(order_voxels(spark, sf_dir), "label").drop("volume_id")


@query(WITH + ORDERS + " SELECT i AS label, CAST(coalesce(min(x), 2147483647) AS BIGINT) AS lo_x, CAST(coalesce(max(x), -1) AS BIGINT) AS hi_x, CAST(coalesce(min(y), 2147483647) AS BIGINT) AS lo_y, CAST(coalesce(max(y), -1) AS BIGINT) AS hi_y, CAST(coalesce(min(z), 2147483647) AS BIGINT) AS lo_z, CAST(coalesce(max(z), -1) AS BIGINT) AS hi_z, count(vid) AS voxels FROM range(6) r(i) LEFT JOIN vox ON label = i GROUP BY i")
def find_objects_dense(spark, sf_dir):
    return agg.dense_boxes(order_voxels(spark, sf_dir), "label", 5).drop("volume_id")


@query(WITH + ORDERS + " SELECT label, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z, count(*) AS voxels, min(vid) AS root FROM vox GROUP BY label")
def boxes_of_slabs(spark, sf_dir):
    v = order_voxels(spark, sf_dir).withColumn("slab", F.floor(F.col("z") / 10))
    parts = agg.box_stats(v.withColumn("cc", F.struct("label", "slab"))).withColumn("label", F.col("cc.label"))
    return agg.merged_boxes(parts.drop("cc"), "label").drop("volume_id")


@query(WITH + ORDERS + " SELECT 64 * any_value(sy) * 50 - count(*) AS background, min(label) AS least, max(label) AS greatest, count(DISTINCT label) AS labels FROM vox, dims")
def background_and_range(spark, sf_dir):
    v = order_voxels(spark, sf_dir)
    return agg.background_count(v, order_volume(spark, v)).join(agg.label_range(v), "volume_id").select("background", "least", "greatest", "labels")


@query(WITH + ORDERS + " SELECT label, min(vid) AS first FROM vox GROUP BY label")
def first_voxel_roots(spark, sf_dir):
    return out(agg.first_voxels(order_voxels(spark, sf_dir)), "label", "first")


@query(WITH + ORDERS + ", l AS (SELECT *, lag(vid) OVER (ORDER BY vid) AS v0, lag(label) OVER (ORDER BY vid) AS l0 FROM vox) SELECT vid, label FROM l WHERE v0 IS NULL OR v0 <> vid - 1 OR l0 <> label")
def run_starts(spark, sf_dir):
    return out(agg.run_starts(order_voxels(spark, sf_dir)), "vid", "label")


FIELD = ", f AS (SELECT vox.*, (x * 7 + y * 13 + z * 31) % 101 AS d FROM vox)"


def field(spark, sf_dir) -> DataFrame:
    return order_voxels(spark, sf_dir).withColumns({"d": (F.col("x") * 7 + F.col("y") * 13 + F.col("z") * 31) % 101, "cc": F.col("label")})


@query(WITH + ORDERS + FIELD + " SELECT label AS cc, max(d) AS greatest, count(*) AS valid, min(vid) AS first FROM f GROUP BY label")
def field_summary(spark, sf_dir):
    return agg.field_summary(field(spark, sf_dir), "d").drop("volume_id")


@query(WITH + ORDERS + FIELD + " SELECT label AS cc, vid FROM f WHERE d = (SELECT max(d) FROM f g WHERE g.label = f.label)")
def maximum_positions(spark, sf_dir):
    return out(agg.maxima(field(spark, sf_dir), "d"), "cc", "vid")


@query(WITH + ORDERS + FIELD + " SELECT label AS cc, arg_max(vid, (d, -vid)) AS vid, max(d) AS value FROM f GROUP BY label")
def segmented_argmax(spark, sf_dir):
    return agg.argmax(field(spark, sf_dir), "d").drop("volume_id")


@query(WITH + ORDERS + FIELD + ", m AS (SELECT * FROM f WHERE d = (SELECT max(d) FROM f g WHERE g.label = f.label)), c AS (SELECT label, CAST(CAST(avg(x) AS FLOAT) AS DOUBLE) AS mx, CAST(CAST(avg(y) AS FLOAT) AS DOUBLE) AS my, CAST(CAST(avg(z) AS FLOAT) AS DOUBLE) AS mz FROM m GROUP BY label) SELECT label AS cc, arg_min(x, ((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz), x, y, z)) AS x, arg_min(y, ((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz), x, y, z)) AS y, arg_min(z, ((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz), x, y, z)) AS z FROM m JOIN c USING (label) GROUP BY label")
def soma_centre(spark, sf_dir):
    return agg.soma_centres(field(spark, sf_dir), "d").drop("volume_id")


@query(WITH + ORDERS + FIELD + " SELECT label AS cc, round(avg(CASE WHEN d % 10 <> 0 THEN d END), 4) AS mean FROM f GROUP BY label")
def mean_finite(spark, sf_dir):
    rows = field(spark, sf_dir).withColumn("d", F.when(F.col("d") % 10 == 0, F.when(F.col("d") % 20 == 0, float("nan")).otherwise(float("inf"))).otherwise(F.col("d").cast("double")))
    return agg.mean_finite(rows, "d").select("cc", F.round("mean", 4).alias("mean"))


@query(WITH + ORDERS + FIELD + " SELECT label AS cc, vid, row_number() OVER (PARTITION BY label ORDER BY d DESC, vid DESC) AS rank FROM f")
def target_ranks(spark, sf_dir):
    return out(agg.ranked(field(spark, sf_dir), "d"), "cc", "vid", "rank")


@query(WITH + ORDERS + FIELD + " SELECT label AS cc, arg_max(vid, (d, vid)) AS vid FROM f WHERE vid % 3 <> 0 GROUP BY label")
def next_alive_target(spark, sf_dir):
    return out(agg.next_targets(agg.ranked(field(spark, sf_dir), "d").withColumn("alive", F.col("vid") % 3 != 0)), "cc", "vid")


@query(WITH + ORDERS + FIELD + " SELECT label AS cc, count(*) AS removed FROM f WHERE d <= 50 GROUP BY label")
def removed_per_label(spark, sf_dir):
    f = field(spark, sf_dir)
    return out(agg.removed_per_label(f, f.where("d > 50")), "cc", "removed")


@query(WITH + ORDERS + FIELD + ", o AS (SELECT vid, label AS owner FROM f WHERE d > 20), s AS (SELECT vid, 1 + vid % 3 AS cc FROM f WHERE d > 60) SELECT cc, owner, count(*) AS voxels FROM s JOIN o USING (vid) WHERE cc <> owner GROUP BY cc, owner")
def filling_owners(spark, sf_dir):
    f = field(spark, sf_dir)
    filled = f.where("d > 60").select("volume_id", "vid", (1 + F.col("vid") % 3).alias("cc"))
    return out(joins.ownership(filled, f.where("d > 20").select("volume_id", "vid", "cc")), "cc", "owner", "voxels")


# components


CC_STATS = ", n AS (SELECT cc, any_value(label) AS label, min(root) AS root, count(*) AS voxels, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM comp GROUP BY cc) SELECT cc, CAST(label AS BIGINT) AS label, root, voxels, lo_x, hi_x, lo_y, hi_y, lo_z, hi_z FROM n WHERE voxels > 2"


@query(WITH + ORDERS + f", {ORDER_ROOTS}" + CC_STATS)
def component_stats(spark, sf_dir):
    """Pieces of each label above the dust threshold, with their boxes."""
    v = order_voxels(spark, sf_dir)
    return pipeline.component_stats(v, order_volume(spark, v), dust_threshold=2).drop("volume_id")


@query(WITH + SPECKLES + f", {ROOTS} SELECT vid, CAST(label AS BIGINT) AS label, root, cc FROM comp")
def connected_components(spark, sf_dir):
    return out(cc.connected_components(src.speckles(spark), cube(spark, 24)), "vid", "label", "root", "cc")


@query(WITH + SPECKLES + f", {ROOTS} SELECT vid, CAST(label AS BIGINT) AS label, root, cc FROM comp")
def connected_components_blocks(spark, sf_dir):
    """The same, cut into blocks of 7 voxels a side."""
    return out(cc.connected_components(src.speckles(spark), cube(spark, 24), block=7), "vid", "label", "root", "cc")


def graph_cells(spark) -> DataFrame:
    """All voxels of a small volume with permitted steps by arithmetic; background among them."""
    label = F.expr("CASE WHEN (x * 5 + y * 3 + z) % 4 = 0 THEN 0 ELSE 1 + x div 3 END")
    cells = spark.range(6 * 5 * 4).select(F.lit(0).cast("long").alias("volume_id"), F.col("id").alias("vid"), (F.col("id") % 6).alias("x"), F.expr("(id div 6) % 5").alias("y"), F.expr("id div 30").alias("z"))
    return cells.withColumns({"label": label.cast("long"), "graph_bits": ((F.col("vid") * 2654435 + 12345) * 7919) % 67108864})


GRAPH_CELLS = "vox AS (SELECT *, CASE WHEN (x * 5 + y * 3 + z) % 4 = 0 THEN 0 ELSE 1 + x // 3 END AS label, ((vid * 2654435 + 12345) * 7919) % 67108864 AS bits FROM (SELECT i AS vid, i % 6 AS x, (i // 6) % 5 AS y, i // 30 AS z FROM range(120) r(i)))"


@query(
    WITH + GRAPH_CELLS + f", {STEPS}, e AS (SELECT a.vid AS a, b.vid AS b FROM vox a, off JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE b.vid < a.vid AND (a.bits >> bit) & 1 = 1), nb AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    "t(id, root) USING KEY (id) AS (SELECT vid, vid FROM vox UNION SELECT nb.b, min(t.root) FROM t JOIN nb ON nb.a = t.id JOIN recurring.t r ON r.id = nb.b WHERE t.root < r.root GROUP BY nb.b) SELECT vid, root, dense_rank() OVER (ORDER BY root) AS cc FROM vox JOIN t ON id = vid WHERE label > 0"
)
def graph_components(spark, sf_dir):
    """Components over the permitted steps of a connectivity graph."""
    return out(cc.graph_connected_components(graph_cells(spark), cube(spark, 0, sides=(6, 5, 4)), block=4), "vid", "root", "cc")


@query(WITH + TUBES + ", f AS (SELECT 0 AS face, x AS u, y AS v, label FROM vox WHERE z = 2), nb AS MATERIALIZED (SELECT a.u + 24 * a.v AS a, b.u + 24 * b.v AS b FROM f a JOIN f b ON a.label = b.label AND abs(a.u - b.u) <= 1 AND abs(a.v - b.v) <= 1), t(id, root) USING KEY (id) AS (SELECT u + 24 * v, u + 24 * v FROM f UNION SELECT nb.b, min(t.root) FROM t JOIN nb ON nb.a = t.id JOIN recurring.t r ON r.id = nb.b WHERE t.root < r.root GROUP BY nb.b) SELECT u, v, root FROM f JOIN t ON id = u + 24 * v")
def face_components(spark, sf_dir):
    """Patches on the first plane that holds foreground, taken as a face."""
    plane = src.small_tubes(spark).where("z = 2").select("volume_id", F.lit(0).cast("long").alias("face"), F.col("x").alias("u"), F.col("y").alias("v"), "label")
    return cc.face_components(plane).select("u", "v", (F.col("patch.u") + 24 * F.col("patch.v")).alias("root"))


GRAPH = "e AS (SELECT DISTINCT l_orderkey AS e0, 1000000000 + l_partkey AS e1 FROM lineitem)"


@query(WITH + GRAPH + ", nb AS MATERIALIZED (SELECT e0 AS a, e1 AS b FROM e UNION SELECT e1, e0 FROM e), t(id, root) USING KEY (id) AS (SELECT DISTINCT a, a FROM nb UNION SELECT nb.b, min(t.root) FROM t JOIN nb ON nb.a = t.id JOIN recurring.t r ON r.id = nb.b WHERE t.root < r.root GROUP BY nb.b) SELECT id AS vidx, root AS part FROM t")
def skeleton_components(spark, sf_dir):
    return out(cc.skeleton_components(graph_edges(spark, sf_dir)), "vidx", "part")


@query(WITH + HOLLOW + ", inner_ AS (SELECT i % 15 AS x, (i // 15) % 15 AS y, i // 225 AS z FROM range(3375) r(i)) SELECT x + 15 * (y + 15 * z) AS vid FROM inner_ WHERE x BETWEEN 3 AND 11 AND y BETWEEN 3 AND 11 AND z BETWEEN 3 AND 11 AND NOT EXISTS (SELECT 1 FROM vox WHERE vox.x = inner_.x AND vox.y = inner_.y AND vox.z = inner_.z)")
def void_voxels(spark, sf_dir):
    return out(cc.void_voxels(src.hollow_box(spark), cube(spark, 15), block=6), "vid")


#: Background of the hollow box that no walk over faces leads out of.
VOIDS = """, cell AS (SELECT i % 15 AS x, (i // 15) % 15 AS y, i // 225 AS z, i AS vid FROM range(3375) r(i)),
empty AS (SELECT * FROM cell WHERE NOT EXISTS (SELECT 1 FROM vox WHERE vox.vid = cell.vid AND vox.label = 42)),
outside(vid, x, y, z) USING KEY (vid) AS (SELECT vid, x, y, z FROM empty WHERE x IN (0, 14) OR y IN (0, 14) OR z IN (0, 14) UNION SELECT e.vid, e.x, e.y, e.z FROM outside o JOIN empty e ON abs(e.x - o.x) + abs(e.y - o.y) + abs(e.z - o.z) = 1 LEFT JOIN recurring.outside r ON r.vid = e.vid WHERE r.vid IS NULL),
inside AS (SELECT * FROM empty WHERE vid NOT IN (SELECT vid FROM outside))"""


@query(WITH + HOLLOW + VOIDS + " SELECT (SELECT count(*) FROM vox WHERE label = 42) + (SELECT count(*) FROM inside) AS voxels, 1 + (SELECT count(*) FROM vox WHERE label <> 42 AND vid NOT IN (SELECT vid FROM inside)) AS components")
def filled_holes(spark, sf_dir):
    """The box with a core: filling the shell's void paints the core over."""
    found = cc.connected_components(src.hollow_box(spark), cube(spark, 15))
    return morphology.filled_components(found, cube(spark, 15)).agg(F.count("*").alias("voxels"), F.count_distinct("cc").alias("components"))


# distances


EDT = ", bg AS (SELECT i % 24 AS x, (i // 24) % 24 AS y, i // 576 AS z FROM range(13824) r(i)), al AS MATERIALIZED (SELECT bg.*, coalesce(c.cc, 0) AS cc FROM bg LEFT JOIN comp c USING (x, y, z))"


@query(WITH + SPECKLES + f", {ROOTS}{EDT} SELECT a.vid, CAST(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS BIGINT) AS d2 FROM comp a JOIN al b ON b.cc <> a.cc AND abs(a.x-b.x) <= 4 AND abs(a.y-b.y) <= 4 AND abs(a.z-b.z) <= 4 GROUP BY a.vid")
def edt_sq(spark, sf_dir):
    found = cc.connected_components(src.speckles(spark), cube(spark, 24))
    return distance.squared_edt(found, cube(spark, 24)).select("vid", F.col("d2").cast("long").alias("d2"))


@query(WITH + TUBES + f", {ROOTS}{EDT} SELECT cc, CAST(max(d2) AS BIGINT) AS d2 FROM (SELECT a.vid, a.cc, least(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), any_value(least(a.x+1, a.y+1, a.z+1, 24-a.x, 24-a.y, 24-a.z))**2) AS d2 FROM comp a JOIN al b ON b.cc <> a.cc AND abs(a.x-b.x) <= 6 AND abs(a.y-b.y) <= 6 AND abs(a.z-b.z) <= 6 GROUP BY a.vid, a.cc) GROUP BY cc")
def edt_sq_black_border(spark, sf_dir):
    found = cc.connected_components(src.small_tubes(spark), cube(spark, 24))
    return distance.squared_edt(found, cube(spark, 24), True).groupBy("cc").agg(F.max("d2").cast("long").alias("d2"))


@query(WITH + TUBES + f", {ROOTS}{EDT} SELECT cc, CAST(max(d2) AS BIGINT) AS d2 FROM (SELECT a.vid, a.cc, min(4*(a.x-b.x)*(a.x-b.x) + 9*(a.y-b.y)*(a.y-b.y) + 25*(a.z-b.z)*(a.z-b.z)) AS d2 FROM comp a JOIN al b ON b.cc <> a.cc AND abs(a.x-b.x) <= 9 AND abs(a.y-b.y) <= 9 AND abs(a.z-b.z) <= 9 GROUP BY a.vid, a.cc) GROUP BY cc")
def max_inscribed(spark, sf_dir):
    """Greatest squared distance to the surface of each component, with spacing 2, 3, 5."""
    volumes = cube(spark, 24, aniso=(2.0, 3.0, 5.0))
    found = cc.connected_components(src.small_tubes(spark), volumes)
    return distance.squared_edt(found, volumes).groupBy("cc").agg(F.max("d2").cast("long").alias("d2"))


@query(WITH + TUBES + ", bg AS (SELECT a.vid, a.x AS ax, i AS x FROM vox a, range(-1, 25) r(i) WHERE NOT EXISTS (SELECT 1 FROM vox b WHERE b.x = i AND b.y = a.y AND b.z = a.z AND b.label = a.label)) SELECT vid, CAST(min(abs(x - ax)) AS FLOAT) AS d FROM bg GROUP BY vid")
def edt_lines(spark, sf_dir):
    """Distances along x alone."""
    return out(distance.line_edt(src.small_tubes(spark), (1.0, 1.0, 1.0), 1), "vid", "d")


SSSP = ", s(id, d) USING KEY (id) AS (SELECT vid, 0.0::DOUBLE FROM comp WHERE vid = root UNION SELECT nb.b, min(s.d + nb.w) FROM s JOIN nb ON nb.a = s.id LEFT JOIN recurring.s r ON r.id = nb.b WHERE r.d IS NULL OR s.d + nb.w < r.d - 1e-12 GROUP BY nb.b)"


def daf(spark) -> DataFrame:
    found = cc.connected_components(src.small_tubes(spark), cube(spark, 24))
    return found.join(distance.component_field(found, "daf", (1.0, 1.0, 1.0)).drop("volume_id", "cc"), "vid")


@query(WITH + TUBES + f", {ROOTS}{SSSP} SELECT id AS vid, round(d, 2) AS dist FROM s")
def geodesic_daf(spark, sf_dir):
    return daf(spark).select("vid", F.round(F.col("dist").cast("double"), 2).alias("dist"))


@query(WITH + TUBES + f", {ROOTS}{SSSP} SELECT id AS vid, round(d, 4) AS dist FROM s WHERE id IN (SELECT vid FROM comp WHERE label = 1 AND z > 18)")
def geodesic_rounds(spark, sf_dir):
    """The same by rounds of joins, for components that fit in no task."""
    ball = src.small_tubes(spark).where("label = 1")
    found = distance.geodesic(ball, cube(spark, 24), ball.orderBy("vid").limit(1))
    return found.join(ball.where("z > 18").select("vid"), "vid", "left_semi").select("vid", F.round("dist", 4).alias("dist"))


@query(WITH + TUBES + f", {ROOTS}{SSSP} SELECT cc, round(max(d), 2) AS dist, count(*) AS reached FROM s JOIN comp ON id = vid GROUP BY cc")
def farthest_voxel(spark, sf_dir):
    return daf(spark).groupBy("cc").agg(F.round(F.max("dist").cast("double"), 2).alias("dist"), F.count("*").alias("reached"))


@query(WITH + TUBES + f", {ROOTS}, g AS (SELECT vid, cc, 1.0 + (x + y + z) % 5 AS dbf, (x * 3 + y + z) % 40 AS daf FROM comp), m AS (SELECT cc, max(dbf) AS a, max(daf) AS b FROM g GROUP BY cc) SELECT vid, round(100000 * pow(1 - dbf / pow(a, 1.01), 4) + daf / b, 4) AS pdrf FROM g JOIN m USING (cc)")
def pdrf_field(spark, sf_dir):
    found = cc.connected_components(src.small_tubes(spark), cube(spark, 24)).select("vid", "cc", (1.0 + (F.col("x") + F.col("y") + F.col("z")) % 5).alias("dbf"), ((F.col("x") * 3 + F.col("y") + F.col("z")) % 40).alias("daf"))
    top = found.groupBy("cc").agg(F.max("dbf").alias("a"), F.max("daf").alias("b"))
    return found.join(top, "cc").select("vid", F.round(penalty("dbf", "daf", "a", "b", 100000.0, 4), 4).alias("pdrf"))


@query(WITH + TUBES + ", src(n, sx, sy, sz) AS (VALUES (1, 2, 18, 3), (2, 12, 19, 3), (3, 21, 20, 4)), tube AS (SELECT * FROM vox WHERE z <= 4 AND label = 2), d AS (SELECT vid, n, (sqrt(3.0) - sqrt(2.0)) * least(abs(x-sx), abs(y-sy), abs(z-sz)) + (sqrt(2.0) - 1) * (abs(x-sx) + abs(y-sy) + abs(z-sz) - least(abs(x-sx), abs(y-sy), abs(z-sz)) - greatest(abs(x-sx), abs(y-sy), abs(z-sz))) + greatest(abs(x-sx), abs(y-sy), abs(z-sz)) AS w FROM tube, src) SELECT vid, CAST(arg_max(n, (-round(w, 5), n)) AS BIGINT) AS source FROM d GROUP BY vid")
def feature_map_geodesic(spark, sf_dir):
    """Nearest of three sources in a box, where walks over steps have a closed form."""
    tube = src.small_tubes(spark).where("z <= 4 AND label = 2")
    points = spark.createDataFrame([(0, 2, 2, 18, 3), (0, 2, 12, 19, 3), (0, 2, 21, 20, 4)], "volume_id long, label long, x long, y long, z long")
    return out(distance.nearest_source(tube, points, (1.0, 1.0, 1.0)), "vid", "source")


BARS = shapes.bar_sql() + """, f AS (SELECT 0 AS face, x AS u, y AS v, label, x, y, z FROM vox WHERE z = 0 UNION ALL SELECT 1, x, y, label, x, y, z FROM vox WHERE z = 11 UNION ALL SELECT 2, x, z, label, x, y, z FROM vox WHERE y = 0 UNION ALL SELECT 3, x, z, label, x, y, z FROM vox WHERE y = 19 UNION ALL SELECT 4, y, z, label, x, y, z FROM vox WHERE x = 0 UNION ALL SELECT 5, y, z, label, x, y, z FROM vox WHERE x = 29),
around AS (SELECT range % 34 - 2 AS u, range // 34 - 2 AS v FROM range(816)),
deep AS (SELECT f.*, (SELECT min((f.u-a.u)*(f.u-a.u) + (f.v-a.v)*(f.v-a.v)) FROM around a WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.face = f.face AND g.label = f.label AND g.u = a.u AND g.v = a.v)) AS d2, avg(u) OVER (PARTITION BY face, label) AS mu, avg(v) OVER (PARTITION BY face, label) AS mv FROM f),
number AS (SELECT label, dense_rank() OVER (ORDER BY min(vid)) AS cc FROM vox GROUP BY label)"""


@query(WITH + BARS + " SELECT cc, CAST(face AS BIGINT) AS face, arg_min(x, (-d2, (u-mu)*(u-mu) + (v-mv)*(v-mv))) AS x, arg_min(y, (-d2, (u-mu)*(u-mu) + (v-mv)*(v-mv))) AS y, arg_min(z, (-d2, (u-mu)*(u-mu) + (v-mv)*(v-mv))) AS z FROM deep JOIN number USING (label) GROUP BY cc, face")
def border_face_targets(spark, sf_dir):
    """Where bars meet the volume's faces: the pixel farthest from the rim, the nearest to the patch's centroid on ties."""
    volumes = shapes.size(spark, shapes.BAR_SHAPE)
    return morphology.border_targets(cc.connected_components(shapes.bars(spark), volumes), volumes).select("cc", "face", "x", "y", "z")


@query(WITH + TUBES + ", p AS (SELECT x AS u, y AS v, label FROM vox WHERE z = 20), bg AS (SELECT i % 26 - 1 AS u, i // 26 - 1 AS v FROM range(676) r(i)) SELECT label AS patch_label, CAST(max(d2) AS BIGINT) AS d2, count(*) AS pixels, CAST(sum(u) AS BIGINT) AS sum_u, CAST(sum(v) AS BIGINT) AS sum_v FROM (SELECT p.u, p.v, p.label, min((p.u-bg.u)*(p.u-bg.u) + (p.v-bg.v)*(p.v-bg.v)) AS d2 FROM p, bg WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.u = bg.u AND q.v = bg.v AND q.label = p.label) GROUP BY p.u, p.v, p.label) GROUP BY label")
def border_face_maxima(spark, sf_dir):
    """Patches of one plane: greatest distance to the rim, pixels, sums of coordinates."""
    plane = src.small_tubes(spark).where("z = 20").withColumns({"z": F.lit(0).cast("long"), "cc": F.col("label")})
    d = distance.squared_edt(plane, cube(spark, 0, sides=(24, 24, 1)), False).select("vid", "x", "y", "cc", "d2", "volume_id")
    pixels = d.select("volume_id", F.lit(0).alias("face"), F.col("cc").alias("patch"), F.col("x").alias("u"), F.col("y").alias("v"), "d2")
    return agg.face_patches(pixels).select(F.col("patch").alias("patch_label"), F.col("d2").cast("long").alias("d2"), "pixels", "sum_u", "sum_v")


# joins in space


NEAREST = f"{ORDERS}, {POINTS}, m AS (SELECT qid, arg_min((x, y, z), ((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz), x, y, z)) AS p FROM q JOIN vox USING (label) GROUP BY qid)"


@query(WITH + NEAREST + " SELECT qid, coalesce(p[1], -1) AS x, coalesce(p[2], -1) AS y, coalesce(p[3], -1) AS z FROM q LEFT JOIN m USING (qid)")
def nearest_label_voxel(spark, sf_dir):
    v = order_voxels(spark, sf_dir)
    return out(joins.nearest_label_voxels(point_queries(spark, sf_dir, v), v), "qid", "x", "y", "z")


@query(WITH + NEAREST + " SELECT p[1] AS x, p[2] AS y, p[3] AS z, arg_max(tag, (label, tag)) AS tag FROM q JOIN m USING (qid) GROUP BY p")
def synapse_targets(spark, sf_dir):
    v = order_voxels(spark, sf_dir)
    return joins.synapse_targets(point_queries(spark, sf_dir, v), v)


@query(WITH + ORDERS + ", g AS (SELECT vec_id, vec_id % 64 - 64 AS x, vec_id % 7 AS y, vec_id % 50 AS z FROM embeddings) SELECT vec_id, coalesce(CAST(label AS BIGINT), 0) AS label FROM g LEFT JOIN vox ON vox.x = g.x + 64 AND vox.y = g.y AND vox.z = g.z")
def manual_targets(spark, sf_dir):
    """Targets by coordinates, some of them counted from the end."""
    v = order_voxels(spark, sf_dir)
    t = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("volume_id"), "vec_id", (F.col("vec_id") % 64 - 64).alias("x"), (F.col("vec_id") % 7).alias("y"), (F.col("vec_id") % 50).alias("z"))
    return joins.assign_targets(t, v, order_volume(spark, v)).select("vec_id", F.coalesce("label", F.lit(0)).cast("long").alias("label"))


@query(WITH + POLY + " SELECT a.label, a.vidx AS a, b.vidx AS b, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM vert a JOIN vert b ON a.label = b.label AND a.vidx % 4 < b.vidx % 4 WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) < 36")
def radius_join_pairs(spark, sf_dir):
    v, _ = polylines(spark, sf_dir)
    return out(joins.radius_pairs(v.withColumn("part", F.col("vidx") % 4), 6.0), "label", "a", "b", "d2")


@query(WITH + POLY + ", d AS (SELECT a.label, a.vidx % 4 AS pa, b.vidx % 4 AS pb, a.vidx AS a, b.vidx AS b, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM vert a JOIN vert b ON a.label = b.label AND a.vidx % 4 < b.vidx % 4) SELECT label, pa, pb, arg_min(a, (d2, a, b)) AS a, arg_min(b, (d2, a, b)) AS b, min(d2) AS d2 FROM d WHERE d2 < 36 GROUP BY label, pa, pb")
def nearest_between_parts(spark, sf_dir):
    v, _ = polylines(spark, sf_dir)
    return joins.nearest_between_parts(v.withColumn("part", F.col("vidx") % 4), 6.0).drop("volume_id")


def nested_cube(spark) -> DataFrame:
    """A core inside a solid box, touching it on all sides."""
    return src.generated(spark, (9, 9, 9), F.expr("CASE WHEN x BETWEEN 3 AND 5 AND y BETWEEN 3 AND 5 AND z BETWEEN 3 AND 5 THEN 2 WHEN x BETWEEN 1 AND 7 AND y BETWEEN 1 AND 7 AND z BETWEEN 1 AND 6 THEN 1 ELSE 0 END"))


NESTED = generated_sql("vox", 9, "WHEN x BETWEEN 3 AND 5 AND y BETWEEN 3 AND 5 AND z BETWEEN 3 AND 5 THEN 2 WHEN x BETWEEN 1 AND 7 AND y BETWEEN 1 AND 7 AND z BETWEEN 1 AND 6 THEN 1")
RAYS_SQL = """, ray AS (SELECT * FROM (VALUES ('x', 1, 1, 0, 0), ('x', -1, -1, 0, 0), ('y', 1, 0, 1, 0), ('y', -1, 0, -1, 0), ('z', 1, 0, 0, 1), ('z', -1, 0, 0, -1)) r(axis, direction, dx, dy, dz)),
seen AS (SELECT c.vid AS cid, axis, direction, n, coalesce(o.label, 0) AS label FROM (SELECT * FROM vox WHERE label = 2) c, ray, range(1, 9) s(n) LEFT JOIN vox o ON o.x = c.x + n * dx AND o.y = c.y + n * dy AND o.z = c.z + n * dz),
hit AS (SELECT cid, axis, direction, arg_min(label, n) AS label FROM seen WHERE label <> 2 GROUP BY cid, axis, direction)"""


@query(WITH + NESTED + RAYS_SQL + " SELECT axis, CAST(direction AS INTEGER) AS direction, count(*) AS hits FROM hit WHERE label = 1 GROUP BY axis, direction")
def enclosing_rays(spark, sf_dir):
    """What six rays from every voxel of a core meet first."""
    v = nested_cube(spark)
    centres = v.where("label = 2").select("volume_id", F.col("vid").alias("cid"), "x", "y", "z", "label")
    return joins.first_hits(v, centres).where("label = 1").groupBy("axis", "direction").agg(F.count("*").alias("hits"))


@query(WITH + NESTED + RAYS_SQL + ", votes AS (SELECT cid, count(*) FILTER (label > 0) AS rays, count(*) FILTER (label = 1) AS ones FROM hit GROUP BY cid) SELECT CAST(CASE WHEN rays >= 3 AND rays - ones <= (CASE WHEN rays > 3 THEN 1 ELSE 0 END) THEN 1 ELSE 2 END AS BIGINT) AS owner, count(*) AS centres FROM votes GROUP BY 1")
def ray_votes(spark, sf_dir):
    v = nested_cube(spark)
    centres = v.where("label = 2").select("volume_id", F.col("vid").alias("cid"), "x", "y", "z", "label")
    return agg.ray_votes(joins.first_hits(v, centres), centres).groupBy("owner").agg(F.count("*").alias("centres"))


# graphs


@query(WITH + POLY + " SELECT e.label, round(sum(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))), 4) AS cable, count(*) AS edges FROM edge e JOIN vert a ON a.label = e.label AND a.vidx = e0 JOIN vert b ON b.label = e.label AND b.vidx = e1 GROUP BY e.label")
def cable_length(spark, sf_dir):
    return agg.cable_lengths(*polylines(spark, sf_dir)).select("label", F.round("cable", 4).alias("cable"), "edges")


CUT = ", cut AS (SELECT * FROM edge WHERE e0 % 10 <> 9), part AS (SELECT label, e0 // 10 AS p, sum(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS cable FROM cut e JOIN vert a USING (label) JOIN vert b USING (label) WHERE a.vidx = e0 AND b.vidx = e1 GROUP BY label, e0 // 10)"


@query(WITH + POLY + CUT + " SELECT label, CAST(sum(n) AS BIGINT) AS edges, count(*) AS parts FROM (SELECT label, e0 // 10 AS p, count(*) AS n FROM cut GROUP BY label, e0 // 10) JOIN part USING (label, p) WHERE cable > 500 GROUP BY label")
def dust_survivors(spark, sf_dir):
    """Polylines cut into parts of ten vertices; parts of short cable go."""
    v, e = polylines(spark, sf_dir)
    _, kept = post.remove_dust(v, e.where("e0 % 10 <> 9"), 500)
    parts = cc.skeleton_components(kept).groupBy("label").agg(F.count_distinct("part").alias("parts"))
    return kept.groupBy("label").agg(F.count("*").alias("edges")).join(parts, "label").select("label", "edges", "parts")


@query(WITH + GRAPH + " SELECT vidx, count(*) AS degree FROM (SELECT e0 AS vidx FROM e UNION ALL SELECT e1 FROM e) GROUP BY vidx")
def vertex_degree(spark, sf_dir):
    return out(agg.degrees(graph_edges(spark, sf_dir)), "vidx", "degree")


@query(WITH + POLY + " SELECT label, count(*) FILTER (d = 1) AS terminals, count(*) FILTER (d >= 3) AS branches, count(*) AS vertices FROM (SELECT label, vidx, count(*) AS d FROM (SELECT label, e0 AS vidx FROM edge UNION ALL SELECT label, e1 FROM edge) GROUP BY label, vidx) GROUP BY label")
def branch_counts(spark, sf_dir):
    return agg.branch_counts(polylines(spark, sf_dir)[1]).drop("volume_id")


COMBS = POLY + ", " + shapes.COMB_GRAPH


def comb_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return shapes.comb_graph(polylines(spark, sf_dir)[0])


LOOPS = ", chord AS (SELECT s.label, s.vidx FROM spine s WHERE s.vidx % 20 = 5 AND s.vidx + 11 < n), bypassed AS (SELECT label, vidx + d AS vidx FROM chord, range(1, 10) r(d))"


def chords(vertices: DataFrame) -> DataFrame:
    """Edges past nine vertices of the spine, where one goes on beyond."""
    spine = vertices.where("vidx < 1000000")
    ends = spine.groupBy("volume_id", "label").agg(F.max("vidx").alias("last"))
    return spine.join(ends, ["volume_id", "label"]).where("vidx % 20 = 5 AND vidx + 10 < last").select("volume_id", "label", F.col("vidx").alias("e0"), (F.col("vidx") + 10).alias("e1"))


@query(WITH + COMBS + " SELECT label, vidx AS a, 1000000 + vidx * 10 + long AS b, CAST(long AS DOUBLE) AS cable FROM roots UNION ALL SELECT label, 0, min(vidx), CAST(10 * min(vidx) AS DOUBLE) FROM roots GROUP BY label UNION ALL SELECT label, max(vidx), any_value(n) - 1, CAST(10 * (any_value(n) - 1 - max(vidx)) AS DOUBLE) FROM roots GROUP BY label")
def terminal_branches(spark, sf_dir):
    """Combs end in their teeth and the two ends of the spine."""
    return out(post.terminal_branches(*comb_graph(spark, sf_dir)), "label", "a", "b", "cable")


@query(WITH + GRAPH + ", nb AS MATERIALIZED (SELECT e0 AS a, e1 AS b FROM e UNION SELECT e1, e0 FROM e), t(id, root) USING KEY (id) AS (SELECT DISTINCT a, a FROM nb UNION SELECT nb.b, min(t.root) FROM t JOIN nb ON nb.a = t.id JOIN recurring.t r ON r.id = nb.b WHERE t.root < r.root GROUP BY nb.b) SELECT (SELECT count(*) FROM e) - count(*) + count(DISTINCT root) AS loops FROM t")
def loop_counts(spark, sf_dir):
    e = graph_edges(spark, sf_dir)
    return post.loop_counts(e.select("volume_id", "label", F.col("e0").alias("vidx")), e).select("loops")


FRAGMENTS = ", half AS (SELECT 0 AS f, label, vidx, x, y, z, radius FROM vert WHERE vidx <= 20 UNION ALL SELECT 1, label, vidx, x, y, z, radius + 10 FROM vert WHERE vidx >= 10)"


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each polyline as two fragments that share vertices 10 to 20; the second has other radii."""
    v, e = polylines(spark, sf_dir)
    a, b = v.where("vidx <= 20").withColumn("fragment", F.lit(0)), v.where("vidx >= 10").withColumns({"fragment": F.lit(1), "radius": F.col("radius") + 10})
    ea, eb = e.where("e1 <= 20").withColumn("fragment", F.lit(0)), e.where("e0 >= 10").withColumn("fragment", F.lit(1))
    return a.unionByName(b), ea.unionByName(eb)


@query(WITH + POLY + " SELECT label, row_number() OVER (PARTITION BY label ORDER BY x, y, z) - 1 AS vidx, x, y, z, CASE WHEN vidx <= 20 THEN radius ELSE radius + 10 END AS radius FROM vert")
def merge_fragments(spark, sf_dir):
    return out(setops.merge_fragments(*halves(spark, sf_dir))[0], "label", "vidx", "x", "y", "z", "radius")


@query(WITH + POLY + " SELECT label, e0, e1 FROM edge")
def merge_fragment_edges(spark, sf_dir):
    """x is the vertex's number, so the merged edges are the polyline's."""
    return out(setops.merge_fragments(*halves(spark, sf_dir))[1], "label", "e0", "e1")


@query(WITH + POLY + ", p AS (SELECT label, x // 3 AS x, vidx FROM vert), d AS (SELECT DISTINCT label, x FROM p) SELECT label, count(*) - 1 AS edges FROM d GROUP BY label HAVING count(*) > 1")
def consolidate_edges(spark, sf_dir):
    """Vertices rounded to a third of their places: a chain over the distinct ones is left."""
    v, e = polylines(spark, sf_dir)
    rounded = v.withColumns({"x": F.expr("x div 3"), "y": F.lit(0).cast("long"), "z": F.lit(0).cast("long")})
    return setops.consolidated(rounded, e)[1].groupBy("label").agg(F.count("*").alias("edges"))


@query(WITH + POLY + ", e2 AS (SELECT * FROM edge WHERE e0 % 4 = 0), u AS (SELECT label, e0 AS vidx FROM e2 UNION SELECT label, e1 FROM e2) SELECT label, count(*) AS vertices, (SELECT count(*) FROM e2 WHERE e2.label = u.label) AS edges FROM u GROUP BY label")
def prune_unused(spark, sf_dir):
    v, e = polylines(spark, sf_dir)
    v, e = filters.prune_unused(v, e.where("e0 % 4 = 0"))
    return v.groupBy("label").agg(F.count("*").alias("vertices")).join(e.groupBy("label").agg(F.count("*").alias("edges")), "label").select("label", "vertices", "edges")


@query(WITH + POLY + ", k2 AS (SELECT label, vidx, row_number() OVER (PARTITION BY label ORDER BY vidx) - 1 AS n FROM vert WHERE vidx % 5 <> 0) SELECT e.label, a.n AS e0, b.n AS e1 FROM edge e JOIN k2 a ON a.label = e.label AND a.vidx = e0 JOIN k2 b ON b.label = e.label AND b.vidx = e1")
def select_vertices(spark, sf_dir):
    return out(filters.select_vertices(*polylines(spark, sf_dir), F.col("vidx") % 5 != 0)[1], "label", "e0", "e1")


@query(WITH + POLY + ", i AS (SELECT * FROM vert WHERE x BETWEEN 5 AND 40 AND y BETWEEN 0 AND 100 AND z BETWEEN 0 AND 3) SELECT i.label, count(*) AS vertices, (SELECT count(*) FROM edge e JOIN i a ON a.label = e.label AND a.vidx = e.e0 JOIN i b ON b.label = e.label AND b.vidx = e.e1 WHERE e.label = i.label) AS edges FROM i GROUP BY i.label")
def crop_fragment(spark, sf_dir):
    v, e = filters.crop(*polylines(spark, sf_dir), (5, 0, 0), (40, 100, 3))
    return v.groupBy("label").agg(F.count("*").alias("vertices")).join(e.groupBy("label").agg(F.count("*").alias("edges")), "label", "left").select("label", "vertices", F.coalesce("edges", F.lit(0)).alias("edges"))


@query(WITH + POLY + " SELECT v.label, v.vidx AS vidx, CAST(v.vidx * 2 AS BIGINT) AS attribute FROM vert v")
def gathered_attributes(spark, sf_dir):
    """Attributes follow vertices to their new numbers."""
    v, _ = polylines(spark, sf_dir)
    attributes = v.select("volume_id", "label", "vidx", (F.col("vidx") * 2).alias("attribute"))
    return out(post.gathered(v.withColumn("source", F.col("vidx")), attributes, ["attribute"]), "label", "vidx", "attribute")


@query(WITH + POLY + ", n AS (SELECT label, count(*) AS v, count(*) - 1 AS e FROM vert GROUP BY label) SELECT label, v AS vertices, e AS edges, CAST(coalesce(sum(v) OVER w, 0) AS BIGINT) AS v_off, CAST(coalesce(sum(e) OVER w, 0) AS BIGINT) AS e_off FROM n WINDOW w AS (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def packed_offsets(spark, sf_dir):
    return src.packed(*polylines(spark, sf_dir)).select("label", F.size("vertices").cast("long").alias("vertices"), F.size("edges").cast("long").alias("edges"), "v_off", "e_off")


@query(WITH + POLY + " SELECT label, vidx, x, y, z FROM vert")
def packed_round_trip(spark, sf_dir):
    return out(src.unpacked(src.packed(*polylines(spark, sf_dir)))[0], "label", "vidx", "x", "y", "z")


@query(WITH + POLY + ", s AS (SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS slot FROM vert) SELECT slot, label, CAST(sum(x) AS DOUBLE) AS total, count(*) AS shown, CAST(60 AS BIGINT) AS width FROM s WHERE slot < 8 AND vidx < 60 GROUP BY slot, label")
def padded_export(spark, sf_dir):
    rows = src.padded(polylines(spark, sf_dir)[0], 8, 60)
    return rows.select("slot", "label", F.aggregate("xs", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("shown"), F.size("xs").cast("long").alias("width"))


@query(WITH + POLY + ", r AS (SELECT label, y, vidx AS i FROM vert UNION ALL SELECT label, y, -vidx - 1 FROM vert WHERE vidx < 4), a AS (SELECT * FROM (SELECT label, i, avg(y) OVER (PARTITION BY label ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS y FROM r) WHERE i >= 0), b0 AS (SELECT label, y, row_number() OVER (PARTITION BY label ORDER BY i DESC) - 1 AS i, i AS vidx FROM a), b AS (SELECT label, y, i, vidx FROM b0 UNION ALL SELECT label, y, -i - 1, vidx FROM b0 WHERE i < 4) SELECT label, vidx, round(y, 3) AS y FROM (SELECT label, i, vidx, avg(y) OVER (PARTITION BY label ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS y FROM b) WHERE i >= 0")
def path_moving_average(spark, sf_dir):
    v, _ = polylines(spark, sf_dir)
    return agg.smoothed_path(v.select("volume_id", "label", "vidx", F.col("y").cast("double").alias("y")), 5, ("y",)).select("label", "vidx", F.round("y", 3).alias("y"))


@query(WITH + POLY + ", t AS (SELECT label, vidx, lead(y) OVER w - y AS d FROM vert WINDOW w AS (PARTITION BY label ORDER BY vidx)) SELECT label, vidx, coalesce(d, lag(d) OVER (PARTITION BY label ORDER BY vidx)) AS ty FROM t")
def path_tangent(spark, sf_dir):
    return out(agg.path_tangents(polylines(spark, sf_dir)[0]), "label", "vidx", "ty")


@query(WITH + POLY + " SELECT label, vidx FROM (SELECT *, max(vidx) OVER (PARTITION BY label) AS m FROM vert) WHERE vidx % 7 = 6 OR vidx = 0 OR vidx = m")
def path_step(spark, sf_dir):
    return out(agg.every_step(polylines(spark, sf_dir)[0], 7), "label", "vidx")


@query(WITH + POLY + " SELECT label, vidx FROM (SELECT *, max(vidx) OVER (PARTITION BY label) AS m FROM vert) WHERE vidx % 6 = 0 OR vidx = m")
def skeleton_downsample(spark, sf_dir):
    return out(post.downsampled(*polylines(spark, sf_dir), 6), "label", "vidx")


@query(WITH + COMBS + " SELECT p.label, p.vidx, CAST(p.vidx * 3 + CASE WHEN r.vidx IS NULL THEN 0 ELSE 5 END AS DOUBLE) AS area FROM point p LEFT JOIN roots r ON r.label = p.label AND r.vidx = p.vidx")
def branch_means(spark, sf_dir):
    """Two paths with other areas: where a tooth branches off, the mean counts, elsewhere the first path."""
    v, e = comb_graph(spark, sf_dir)
    areas = v.select("volume_id", "label", "vidx", F.explode(F.array(F.lit(0), F.lit(1))).alias("path")).withColumn("area", (F.col("vidx") * 3 + F.col("path") * 10).cast("double"))
    return out(agg.branch_means(areas, e), "label", "vidx", "area")


# tracing


TRACE = {**DEFAULT_TEASAR_PARAMS, "const": 2}


def traced(spark) -> tuple[DataFrame, DataFrame]:
    return pipeline.skeletonize(shapes.combs(spark), shapes.size(spark, shapes.COMB_SHAPE), TRACE, dust_threshold=0)


def shown(vertices: DataFrame, *more: str) -> DataFrame:
    """Vertices with whole numbers as places and radii."""
    return vertices.select(*more, "label", "vidx", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "z", "radius")])


SHOWN = "label, vidx, x, y, z, CAST(1 AS BIGINT) AS radius"


@query(WITH + shapes.comb_sql() + f" SELECT {SHOWN} FROM {shapes.comb_kept()}")
def skeleton_vertices(spark, sf_dir):
    """Combs: the spine, and the teeth that reach beyond what the spine's path takes along; all radii are 1."""
    return shown(traced(spark)[0])


@query(WITH + shapes.comb_sql() + f" SELECT {SHOWN} FROM {shapes.comb_kept()}")
def skeleton_one_tree(spark, sf_dir):
    """The same along the parents of one tree, without rails."""
    return shown(pipeline.skeletonize(shapes.combs(spark), shapes.size(spark, shapes.COMB_SHAPE), TRACE, dust_threshold=0, fix_branching=False)[0])


@query(WITH + shapes.comb_sql() + f" SELECT label, count(*) AS vertices, count(*) - 1 AS edges, CAST(0 AS BIGINT) AS loops FROM {shapes.comb_kept()} GROUP BY label")
def skeletons_are_trees(spark, sf_dir):
    v, e = traced(spark)
    size = v.groupBy("label").agg(F.count("*").alias("vertices")).join(e.groupBy("label").agg(F.count("*").alias("edges")), "label")
    return size.join(post.loop_counts(v, e).select("label", "loops"), "label").select("label", "vertices", "edges", "loops")


@query(WITH + shapes.comb_sql() + f" SELECT label, count(*) AS inside, CAST(0 AS BIGINT) AS outside FROM {shapes.comb_kept()} GROUP BY label")
def skeletons_stay_inside(spark, sf_dir):
    v, _ = traced(spark)
    inside = shapes.combs(spark).select("label", *[F.col(a).cast("float").alias(a) for a in "xyz"]).withColumn("in", F.lit(1))
    return v.join(inside, ["label", "x", "y", "z"], "left").groupBy("label").agg(F.count("in").alias("inside"), F.count_if(F.col("in").isNull()).alias("outside"))


@query("SELECT CAST(t.range * 3 + l.range + 1 AS BIGINT) AS label, true AS traced FROM range(27) t, range(3) l")
def skeletonize_tiled(spark, sf_dir):
    """120 voxels a side: 81 components, the unit of throughput."""
    v, e = pipeline.skeletonize(src.tiled_warm_up(spark, 3), cube(spark, 120), TRACE, dust_threshold=100)
    size = v.groupBy("label").agg(F.count("*").alias("v")).join(e.groupBy("label").agg(F.count("*").alias("e")), "label")
    return size.select("label", ((F.col("v") > 20) & (F.col("e") == F.col("v") - 1)).alias("traced"))


TWICE = (
    ", s1(id, d) USING KEY (id) AS (SELECT vid, 0.0::DOUBLE FROM comp WHERE vid = root UNION SELECT nb.b, min(s1.d + nb.w) FROM s1 JOIN nb ON nb.a = s1.id LEFT JOIN recurring.s1 r ON r.id = nb.b WHERE r.d IS NULL OR s1.d + nb.w < r.d - 1e-9 GROUP BY nb.b), "
    "far AS (SELECT cc, arg_max(id, (round(d, 3), -id)) AS start FROM s1 JOIN comp ON vid = id GROUP BY cc), "
    "s2(id, d) USING KEY (id) AS (SELECT start, 0.0::DOUBLE FROM far UNION SELECT nb.b, min(s2.d + nb.w) FROM s2 JOIN nb ON nb.a = s2.id LEFT JOIN recurring.s2 r ON r.id = nb.b WHERE r.d IS NULL OR s2.d + nb.w < r.d - 1e-9 GROUP BY nb.b)"
)


@query(WITH + shapes.comb_sql() + f", {ROOTS}{TWICE} SELECT comp.cc, start AS root, arg_max(id, (round(d, 3), -id)) AS target, CAST(1 AS BIGINT) AS maximum, false AS soma, count(*) AS valid FROM s2 JOIN comp ON vid = id JOIN far ON far.cc = comp.cc GROUP BY comp.cc, start")
def trace_preparation(spark, sf_dir):
    """Combs: the root is the farthest voxel from the first one, the target the farthest from the root."""
    volumes = shapes.size(spark, shapes.COMB_SHAPE)
    found = distance.with_dbf(cc.connected_components(shapes.combs(spark), volumes), volumes)
    return pipeline.prepared(found, volumes, TRACE).select("cc", "root", "target", F.col("maximum").cast("long").alias("maximum"), "soma", "valid")


@query(WITH + COMBS + LOOPS + ", kept AS (SELECT label, vidx FROM point ANTI JOIN bypassed USING (label, vidx) WHERE vidx < 1000000 OR 1 + (((vidx - 1000000) // 10) * 3 + label) % 7 > 4) SELECT label, count(*) AS vertices, count(*) - 1 AS edges FROM kept GROUP BY label")
def postprocess_tree(spark, sf_dir):
    """Combs with chords, gaps in the spine and a far speck of dust: one tree each, without bypassed vertices and ticks."""
    v, e = comb_graph(spark, sf_dir)
    speck = v.where("vidx IN (0, 1)").withColumns({"x": (F.col("vidx") - 5000).cast("float"), "vidx": F.col("vidx") + 900000})
    dust = speck.groupBy("volume_id", "label").agg(F.lit(900000).cast("long").alias("e0"), F.lit(900001).cast("long").alias("e1"))
    ends = v.where("vidx < 1000000").groupBy("volume_id", "label").agg(F.max("vidx").alias("last"))
    cut = e.join(ends, ["volume_id", "label"]).where("e0 % 40 <> 38 OR e1 > 1000000 OR e1 = last").select(*e.columns)  # a lone vertex would be no part
    v, e = post.postprocess(v.unionByName(speck), cut.unionByName(chords(v)).unionByName(dust), 5, 4.5)
    return v.groupBy("label").agg(F.count("*").alias("vertices")).join(e.groupBy("label").agg(F.count("*").alias("edges")), "label").select("label", "vertices", "edges")


@query(WITH + shapes.comb_sql() + ", " + shapes.comb_sql("vox2", 3) + f" SELECT CAST(0 AS BIGINT) AS volume_id, {SHOWN} FROM {shapes.comb_kept()} UNION ALL SELECT 1, {SHOWN} FROM {shapes.comb_kept('vox2', 3)}")
def skeletonize_batch(spark, sf_dir):
    """Two volumes of combs with other teeth."""
    samples = [(shapes.size(spark, shapes.COMB_SHAPE), shapes.combs(spark, factor)) for factor in (7, 3)]
    return shown(pipeline.skeletonize_batch(samples, TRACE, dust_threshold=0)[0], "volume_id")


@query(WITH + shapes.comb_sql() + f" SELECT {SHOWN} FROM {shapes.comb_kept()}")
def skeletonize_chunked(spark, sf_dir):
    """Combs cut into three chunks give the skeletons of the whole."""
    return shown(pipeline.skeletonize_chunked(shapes.combs(spark), shapes.size(spark, shapes.COMB_SHAPE), (20, 20, 12), TRACE)[0])


@query(WITH + shapes.PIPE_SKELETONS + " SELECT label, row_number() OVER (PARTITION BY label ORDER BY x, y, z) - 1 AS vidx, x, CAST(y AS BIGINT) AS y, CAST(z AS BIGINT) AS z, CAST(radius AS BIGINT) AS radius FROM line")
def skeletonize_whole(spark, sf_dir):
    """Pipes, hollow or with a core, with holes filled: the middle lines of solid bars."""
    return shown(pipeline.skeletonize(shapes.pipes(spark), shapes.size(spark, shapes.PIPE_SHAPE), TRACE, dust_threshold=0, fill_holes=True, fix_avocados=True)[0])


@query(WITH + TUBES + ", p AS (SELECT * FROM vox WHERE z BETWEEN 16 AND 19 AND x BETWEEN 16 AND 19) SELECT y, CAST(16.0 AS DOUBLE) AS area FROM p GROUP BY y")
def cross_section(spark, sf_dir):
    """A straight line along a square tube: every section is the square."""
    line = spark.range(2, 22).select(F.lit(0).cast("long").alias("volume_id"), F.lit(2).cast("long").alias("label"), (F.col("id") - 2).alias("vidx"), F.lit(17).cast("float").alias("x"), F.col("id").cast("float").alias("y"), F.lit(17).cast("float").alias("z"), F.lit(1).cast("float").alias("radius"))
    areas = analysis.cross_sectional_area(src.small_tubes(spark).where("x BETWEEN 16 AND 19 AND z BETWEEN 16 AND 19"), cube(spark, 24), line, src.polyline_edges(line))
    return areas.select((F.col("vidx") + 2).alias("y"), F.col("area").cast("double").alias("area"))


@query(WITH + TUBES + ", p AS (SELECT * FROM vox WHERE z BETWEEN 16 AND 19 AND x BETWEEN 16 AND 19) SELECT CAST(CASE WHEN y <= 11 THEN 1 ELSE 2 END AS BIGINT) AS feature, count(*) AS voxels FROM p GROUP BY 1")
def oversegment(spark, sf_dir):
    """A tube split between two vertices at its ends; the voxels midway go to the second."""
    ends = spark.createDataFrame([(0, 2, 0, 17.0, 2.0, 17.0, 1.0), (0, 2, 1, 17.0, 21.0, 17.0, 1.0)], "volume_id long, label long, vidx long, x float, y float, z float, radius float")
    tube = src.small_tubes(spark).where("x BETWEEN 16 AND 19 AND z BETWEEN 16 AND 19")
    features, _ = analysis.oversegment(tube, ends, src.polyline_edges(ends), (1.0, 1.0, 1.0))
    return features.groupBy("feature").agg(F.count("*").alias("voxels"))


@query(WITH + TUBES + f", {ROOTS}{EDT}, on_ AS (SELECT a.*, sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS d FROM (SELECT * FROM comp WHERE label = 1 AND x = 8 AND y = 8 AND z BETWEEN 4 AND 22) a JOIN al b ON b.cc <> a.cc GROUP BY ALL) SELECT x, y, z, round(d, 4) AS radius FROM on_")
def connect_points(spark, sf_dir):
    """Through a ball and along its stem: the middle line, with the distances to the surface."""
    v, _ = analysis.connect_points(src.small_tubes(spark).where("label = 1"), cube(spark, 24), (8, 8, 4), (8, 8, 22))
    return v.select(*[F.col(a).cast("long").alias(a) for a in "xyz"], F.round(F.col("radius").cast("double"), 4).alias("radius"))


@query(WITH + TUBES + f", {ROOTS}{EDT}, path AS (SELECT a.x, a.y, a.z, a.cc, 1.5 * sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) + 2 AS reach FROM (SELECT * FROM comp WHERE label = 1 AND x = 8 AND y = 8 AND z BETWEEN 12 AND 20) a JOIN al b ON b.cc <> a.cc GROUP BY a.x, a.y, a.z, a.cc) SELECT cc, vid FROM comp c WHERE EXISTS (SELECT 1 FROM path p WHERE p.cc = c.cc AND sqrt((p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y) + (p.z-c.z)*(p.z-c.z)) < reach)")
def invalidated_voxels(spark, sf_dir):
    """What a path along a stem takes out of the ball and the stem, which both lie open to it."""
    volumes = cube(spark, 24)
    found = distance.with_dbf(cc.connected_components(src.small_tubes(spark), volumes), volumes)
    path = found.where("label = 1 AND x = 8 AND y = 8 AND z BETWEEN 12 AND 20")
    return morphology.invalidated(found, path, 1.5, 2.0, (1.0, 1.0, 1.0)).select("cc", "vid")


@query(WITH + POLY + ", c AS (SELECT e.label, sum(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS cable FROM edge e JOIN vert a ON a.label = e.label AND a.vidx = e0 JOIN vert b ON b.label = e.label AND b.vidx = e1 GROUP BY e.label) SELECT label FROM c WHERE cable <= 5000")
def within_cable_length(spark, sf_dir):
    return out(agg.within_cable(*polylines(spark, sf_dir), 5000), "label")


@query(WITH + ORDERS + " SELECT label, CASE WHEN count(*) < 10000 THEN 'S' WHEN count(*) < 100000 THEN 'M' WHEN count(*) < 1000000 THEN 'L' ELSE 'XL' END AS size_class FROM vox GROUP BY label")
def size_classes(spark, sf_dir):
    return out(agg.size_class(agg.box_stats(order_voxels(spark, sf_dir), "label")), "label", "size_class")


@query(
    WITH + generated_sql("vox", 9, "WHEN true THEN 1") + ", cost AS (SELECT *, CASE WHEN z = 0 THEN 0 ELSE 1 + (x * 7 + y * 5 + z * 3) % 11 END AS c FROM vox), nb AS MATERIALIZED (SELECT a.vid AS a, b.vid AS b, b.c AS w FROM cost a JOIN cost b ON abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.z-b.z) <= 1 AND a.vid <> b.vid AND b.z > 0 AND a.z > 0), "
    "s(id, d) USING KEY (id) AS (SELECT vid, 0::DOUBLE FROM vox WHERE x = 4 AND y = 4 AND z = 4 UNION SELECT nb.b, min(s.d + nb.w) FROM s JOIN nb ON nb.a = s.id LEFT JOIN recurring.s r ON r.id = nb.b WHERE r.d IS NULL OR s.d + nb.w < r.d GROUP BY nb.b) SELECT min(d) AS cost, CAST(0 AS BIGINT) AS last_z FROM s JOIN vox ON vid = id WHERE z = 1"
)
def railroad_path(spark, sf_dir):
    """The cheapest path from the middle of a costly cube to a plane of rails: its cost, and where it ends."""
    cells = src.generated(spark, (9, 9, 9), F.lit(1)).withColumns({"cc": F.col("label"), "cost": F.expr("CASE WHEN z = 0 THEN 0 ELSE 1 + (x * 7 + y * 5 + z * 3) % 11 END").cast("double")})
    start = spark.createDataFrame([(0, 1, 4 + 9 * (4 + 9 * 4))], "volume_id long, cc long, target long")
    path = paths.railroads(cells, start).join(cells.select("vid", "z", "cost"), "vid")
    return path.agg(F.sum(F.when(F.col("i") > 0, F.col("cost"))).alias("cost"), F.max_by("z", "i").alias("last_z"))


@query(
    WITH + TUBES + ", ball AS (SELECT *, 1 + (x * 7 + y * 5 + z * 3) % 11 AS c FROM vox WHERE label = 1), nb AS MATERIALIZED (SELECT a.vid AS a, b.vid AS b, b.c AS w FROM ball a JOIN ball b ON abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.z-b.z) <= 1 AND a.vid <> b.vid), "
    "s(id, d) USING KEY (id) AS (SELECT min(vid), 0::DOUBLE FROM ball UNION SELECT nb.b, min(s.d + nb.w) FROM s JOIN nb ON nb.a = s.id LEFT JOIN recurring.s r ON r.id = nb.b WHERE r.d IS NULL OR s.d + nb.w < r.d GROUP BY nb.b) SELECT d AS cost, (SELECT min(vid) FROM ball) AS source, id AS target, true AS adjacent FROM s WHERE id = (SELECT max(vid) FROM ball)"
)
def backtrace_path(spark, sf_dir):
    """A path through the parents of an entry-cost field is a cheapest one, in steps of one voxel."""
    ball = src.small_tubes(spark).where("label = 1").withColumns({"cc": F.col("label"), "cost": (1 + (F.col("x") * 7 + F.col("y") * 5 + F.col("z") * 3) % 11).cast("double")})
    tree = distance.component_field(ball, "entry", (1.0, 1.0, 1.0))
    goal = ball.groupBy("volume_id", "cc").agg(F.max("vid").alias("target"))
    path = paths.backtraces(tree, goal).join(ball.select("vid", "x", "y", "z", "cost"), "vid")
    step = F.expr("greatest(abs(x - lag(x) OVER (ORDER BY i)), abs(y - lag(y) OVER (ORDER BY i)), abs(z - lag(z) OVER (ORDER BY i)))")  # one path
    return path.withColumn("step", step).agg(F.sum(F.when(F.col("i") > 0, F.col("cost"))).alias("cost"), F.min_by("vid", "i").alias("source"), F.max_by("vid", "i").alias("target"), F.bool_and(F.expr("step IS NULL OR step = 1")).alias("adjacent"))


@query(WITH + shapes.comb_sql() + f", number AS (SELECT label, dense_rank() OVER (ORDER BY min(vid)) AS cc FROM vox GROUP BY label) SELECT cc, x, y, z FROM {shapes.comb_kept()} JOIN number USING (label)")
def traced_components(spark, sf_dir):
    volumes = shapes.size(spark, shapes.COMB_SHAPE)
    found = distance.with_dbf(cc.connected_components(shapes.combs(spark), volumes), volumes)
    v, _ = paths.traces(found, TRACE, (1.0, 1.0, 1.0))
    return v.select(F.col("label").alias("cc"), *[F.col(a).cast("long").alias(a) for a in "xyz"])


@query(WITH + HOLLOW + VOIDS + ", solid AS (SELECT 1 AS cc, x, y, z FROM vox WHERE label = 42 UNION ALL SELECT 1, x, y, z FROM inside UNION ALL SELECT 2, x, y, z FROM vox WHERE label = 77), deep AS (SELECT s.cc, sqrt(min((s.x-c.x)*(s.x-c.x) + (s.y-c.y)*(s.y-c.y) + (s.z-c.z)*(s.z-c.z))) AS d FROM solid s, cell c WHERE NOT EXISTS (SELECT 1 FROM solid o WHERE o.cc = s.cc AND o.x = c.x AND o.y = c.y AND o.z = c.z) GROUP BY s.cc, s.x, s.y, s.z) SELECT CAST(cc AS BIGINT) AS cc, max(d) > 4 AS soma, max(d) AS deepest, CASE cc WHEN 1 THEN (SELECT count(*) FROM inside) ELSE 0 END AS filled FROM deep GROUP BY cc")
def soma_flags(spark, sf_dir):
    """A hollow box is filled and then deep enough; its core is not.  With scale 1 the radius is the greatest depth."""
    volumes = cube(spark, 15)
    found = distance.with_dbf(cc.connected_components(src.hollow_box(spark), volumes), volumes)
    own = morphology.soma_flags(found, volumes, 0.5, 4.0, 1.0, 0.0)
    return own.join(found.groupBy("cc").agg(F.max("dbf").cast("double").alias("shallow")), "cc").select("cc", "soma", F.when(F.col("soma"), F.col("radius")).otherwise(F.col("shallow")).alias("deepest"), "filled")


@query(WITH + generated_sql("vox", 15, "WHEN x BETWEEN 4 AND 10 AND y BETWEEN 4 AND 10 AND z BETWEEN 4 AND 10 THEN 2 WHEN x BETWEEN 1 AND 13 AND y BETWEEN 1 AND 13 AND z BETWEEN 1 AND 13 THEN 1") + " SELECT CAST(1 AS BIGINT) AS cc, vid FROM vox")
def repaired_components(spark, sf_dir):
    """A core that its surroundings enclose becomes part of them."""
    v = src.generated(spark, (15, 15, 15), F.expr("CASE WHEN x BETWEEN 4 AND 10 AND y BETWEEN 4 AND 10 AND z BETWEEN 4 AND 10 THEN 2 WHEN x BETWEEN 1 AND 13 AND y BETWEEN 1 AND 13 AND z BETWEEN 1 AND 13 THEN 1 ELSE 0 END"))
    volumes = cube(spark, 15)
    found = distance.with_dbf(cc.connected_components(v, volumes), volumes)
    return morphology.repaired(found, volumes, 5.0).select("cc", "vid")


@query(WITH + HOLLOW + VOIDS + " SELECT CAST(1 AS BIGINT) AS cc, x, y, z FROM inside")
def filled_masks(spark, sf_dir):
    """The voids of the shell alone; the core has none."""
    found = cc.connected_components(src.hollow_box(spark), cube(spark, 15))
    return morphology.filled_masks(found).where("added").select("cc", "x", "y", "z")


@query(WITH + GRAPH_CELLS + ", d AS (WITH fine AS (SELECT 2 * x + dx AS x, 2 * y + dy AS y, 2 * z + dz AS z, label > 0 AND (dx + dy + dz <> 1 OR (bits >> (CASE WHEN dx = 1 THEN 0 WHEN dy = 1 THEN 2 ELSE 4 END)) & 1 = 1) AS free FROM vox, range(2) a(dx), range(2) b(dy), range(2) c(dz)) SELECT vid, sqrt(min((2*v.x-f.x)*(2*v.x-f.x) + (2*v.y-f.y)*(2*v.y-f.y) + (2*v.z-f.z)*(2*v.z-f.z))) / 2 AS raw FROM (SELECT * FROM vox WHERE label > 0) v, fine f WHERE NOT free GROUP BY vid) SELECT vid, round(raw, 5) AS dbf FROM d")
def graph_distances(spark, sf_dir):
    """Distances where forbidden steps over faces are walls half a voxel away, on a grid of twice the resolution."""
    cells = graph_cells(spark).join(cube(spark, 0, sides=(6, 5, 4)).select("ax", "ay", "az"))  # one row
    return distance.graph_dbf(cells).where("label > 0").select("vid", F.round(F.col("dbf").cast("double"), 5).alias("dbf"))


@query(WITH + COMBS + " SELECT label, CAST(0 AS BIGINT) AS leaf, max(n) AS vertices FROM spine GROUP BY label UNION ALL SELECT label, 1000000 + vidx * 10 + long, n - vidx + long FROM roots")
def path_decomposition(spark, sf_dir):
    """Combs as paths from the far end of the spine to its near end and to the tip of every tooth."""
    found = post.path_decomposition(*comb_graph(spark, sf_dir))
    return found.groupBy("label", "path").agg(F.min_by("vidx", "i").alias("leaf"), F.count("*").alias("vertices")).select("label", "leaf", "vertices")


@query(WITH + POLY + " SELECT label, count(*) - 1 AS edges FROM vert GROUP BY label")
def join_close_components(spark, sf_dir):
    """Polylines cut into parts of ten vertices are joined to one piece again."""
    v, e = polylines(spark, sf_dir)
    last = v.groupBy("label").agg(F.max("vidx").alias("last"))
    cut = e.join(last, "label").where("e0 % 10 <> 9 OR e1 = last").select(*e.columns)  # a lone vertex would be no part
    _, links = post.join_close_components(v, cut)
    return links.groupBy("label").agg(F.count("*").alias("edges"))


@query(WITH + COMBS + " SELECT label, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM point WHERE vidx < 1000000 OR 1 + (((vidx - 1000000) // 10) * 3 + label) % 7 > 4")
def remove_ticks(spark, sf_dir):
    """Of combs, the teeth of up to 4 vertices go."""
    v, e = post.remove_ticks(*comb_graph(spark, sf_dir), 4.5)
    return v.select("label", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(WITH + COMBS + LOOPS + " SELECT label, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM point ANTI JOIN bypassed USING (label, vidx)")
def remove_loops(spark, sf_dir):
    """Combs with chords: of each loop the side of more vertices goes."""
    v, e = comb_graph(spark, sf_dir)
    v, e = post.remove_loops(v, e.unionByName(chords(v)))
    return v.select("label", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(WITH + POLY + " SELECT volume_id, label, count(*) AS vertices FROM vert, (SELECT CAST(range AS BIGINT) AS volume_id FROM range(2)) GROUP BY volume_id, label")
def combined_batches(spark, sf_dir):
    """Two batches side by side; equal labels stay apart by volume."""
    v, e = polylines(spark, sf_dir)
    return setops.combined([(v, e), (v, e)])[0].groupBy("volume_id", "label").agg(F.count("*").alias("vertices"))


@query(WITH + SPECKLES + f", {ROOTS} SELECT vid, root, cc FROM comp")
def slab_components(spark, sf_dir):
    """A volume that a stream brings in slabs of six planes: the components of the whole."""
    base = streamed(spark, src.speckles(spark), 6, 24)
    slabs = SlabComponents(spark, cube(spark, 24), f"{base}/labelled")
    stream = slabs.from_stream(f"{base}/in")
    stream.awaitTermination()
    return out(slabs.finish(), "vid", "root", "cc")


@query(WITH + POLY + " SELECT DISTINCT x // 5 AS x, y // 40 AS y, z FROM vert")
def distinct_points(spark, sf_dir):
    v, _ = polylines(spark, sf_dir)
    rounded = v.withColumns({"x": F.expr("x div 5"), "y": F.floor(F.col("y") / 40)})
    return out(agg.distinct_points(rounded), "x", "y", "z")


@query(WITH + ORDERS + FIELD + " SELECT vid, CASE WHEN d % 5 = 0 THEN CAST('Infinity' AS FLOAT) ELSE CAST(d AS FLOAT) END AS dbf FROM f")
def normalised_distances(spark, sf_dir):
    """Foreground without a distance counts as infinitely deep."""
    rows = field(spark, sf_dir).withColumn("dbf", F.when(F.col("d") % 5 == 0, 0).otherwise(F.col("d")).cast("float"))
    return out(morphology.normalised_distances(rows), "vid", "dbf")


@query(WITH + POLY + ", s AS (SELECT label % 3 AS label, label AS part, vidx FROM vert) SELECT label, row_number() OVER (PARTITION BY label ORDER BY part, vidx) - 1 AS vidx, part * 1000000 + vidx AS was FROM s")
def same_label(spark, sf_dir):
    """Skeletons of components that share a label are numbered on, part after part."""
    v, _ = polylines(spark, sf_dir)
    parts = v.select("volume_id", (F.col("label") % 3).alias("label"), F.col("label").alias("part"), "vidx", (F.col("label") * 1000000 + F.col("vidx")).alias("was"))
    return out(setops.same_label(parts), "label", "vidx", "was")


@query(WITH + ORDERS + " SELECT label FROM (SELECT DISTINCT label FROM vox) WHERE label NOT IN (SELECT 1 + s_nationkey % 2 FROM supplier)")
def repair_candidates(spark, sf_dir):
    """Labels found but not settled yet."""
    found = order_voxels(spark, sf_dir).select("label").distinct()
    settled = table(spark, sf_dir, "supplier").select((1 + F.col("s_nationkey") % 2).cast("long").alias("label")).distinct()
    return setops.candidates(found, settled)


@query("SELECT x0, y0, z0, CAST(x0 * 16 AS DOUBLE) AS px, CAST(y0 * 16 AS DOUBLE) AS py, CAST(z0 * 40 AS DOUBLE) AS pz FROM (SELECT range AS x0 FROM range(0, 199, 63)), (SELECT range AS y0 FROM range(0, 99, 31)), (SELECT range AS z0 FROM range(0, 49, 49))")
def physical_origins(spark, sf_dir):
    return out(filters.physical_origins(src.iter_chunks(spark, (200, 100, 50), (64, 32, 50)), (16, 16, 40)), "x0", "y0", "z0", "px", "py", "pz")


@query(WITH + TUBES + ", p AS (SELECT * FROM vox WHERE z BETWEEN 16 AND 19 AND x BETWEEN 16 AND 19) SELECT x, y, z, y - 2 AS vidx FROM p")
def section_planes(spark, sf_dir):
    """A straight line along a square tube: every voxel lies in the section of the vertex in its plane."""
    line = spark.range(2, 22).select(F.lit(0).cast("long").alias("volume_id"), F.lit(2).cast("long").alias("label"), (F.col("id") - 2).alias("vidx"), F.lit(17).cast("float").alias("x"), F.col("id").cast("float").alias("y"), F.lit(17).cast("float").alias("z"), F.lit(1).cast("float").alias("radius"))
    tube = src.small_tubes(spark).where("x BETWEEN 16 AND 19 AND z BETWEEN 16 AND 19")
    return out(analysis.section_planes(tube, cube(spark, 24), line, src.polyline_edges(line)), "x", "y", "z", "vidx")


def streamed(spark, rows: DataFrame, height: int, depth: int) -> str:
    """A folder of files with ``height`` planes each."""
    base = f"{shared_base(spark)}/slabs-{uuid.uuid4().hex}"
    for low in range(0, depth, height):
        rows.where(F.col("z").between(low, low + height - 1)).coalesce(1).select(*[c.split()[0] for c in VOXELS.split(", ")]).write.mode("append").parquet(f"{base}/in")
    return base


@query(WITH + TUBES + f", {ROOTS}{EDT} SELECT a.vid, CAST(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS BIGINT) AS d2 FROM comp a JOIN al b ON b.cc <> a.cc AND abs(a.x-b.x) <= 6 AND abs(a.y-b.y) <= 6 AND abs(a.z-b.z) <= 6 GROUP BY a.vid")
def slab_distances(spark, sf_dir):
    """Distances of a volume that a stream brings in slabs."""
    base = streamed(spark, src.small_tubes(spark), 5, 24)
    slabs = SlabDistances(spark, cube(spark, 24), f"{base}/planes")
    slabs.from_stream(f"{base}/in").awaitTermination()
    return slabs.finish().select("vid", F.round(F.col("dbf") * F.col("dbf")).cast("long").alias("d2"))


@query(WITH + shapes.comb_sql() + f" SELECT {SHOWN} FROM {shapes.comb_kept()}")
def slab_skeletons(spark, sf_dir):
    """Skeletons of a volume that a stream brings in slabs."""
    base = streamed(spark, shapes.combs(spark), 4, shapes.COMB_SHAPE[2])
    slabs = SlabSkeletons(spark, shapes.size(spark, shapes.COMB_SHAPE), f"{base}/parts")
    for stream in slabs.from_stream(f"{base}/in"):
        stream.awaitTermination()
    return shown(slabs.finish(TRACE, 0)[0])


@query(WITH + POLY + " SELECT label, count(*) AS vertices, (SELECT count(*) FROM edge e WHERE e.label = i.label AND e.e0 >= 5 AND e.e1 <= 40) AS edges FROM vert i WHERE x BETWEEN 5 AND 40 GROUP BY label")
def fused_fragments(spark, sf_dir):
    """Overlapping halves of each polyline cut to a box and merged."""
    v, e = halves(spark, sf_dir)
    v, e = setops.fused(v, e, (5, -100000, -1), (40, 100000, 99))
    return v.groupBy("label").agg(F.count("*").alias("vertices")).join(e.groupBy("label").agg(F.count("*").alias("edges")), "label").select("label", "vertices", "edges")


@query(WITH + POLY + " SELECT label, vidx, CAST(x * 16 AS DOUBLE) AS px, CAST(y * 16 AS DOUBLE) AS py, CAST(z * 40 AS DOUBLE) AS pz, CAST(x AS DOUBLE) AS bx FROM vert")
def spaces(spark, sf_dir):
    """Vertices in physical units, and back in voxels."""
    v, _ = polylines(spark, sf_dir)
    size = cube(spark, 1, aniso=(16.0, 16.0, 40.0))
    there = setops.in_space(v, size, "physical")
    back = setops.in_space(there.withColumns({f"p{a}": F.col(a).cast("double") for a in "xyz"}), size, "voxel")
    return back.select("label", "vidx", "px", "py", "pz", F.col("x").cast("double").alias("bx"))


@query(WITH + POLY + ", n AS (SELECT label, count(*) AS v, dense_rank() OVER (ORDER BY label) - 1 AS i FROM vert GROUP BY label), o AS (SELECT label, v, i, CAST(coalesce(sum(v) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM n) SELECT label, off - (SELECT min(off) FROM o WHERE i BETWEEN 2 AND 5) AS v_off, v AS vertices FROM o WHERE i BETWEEN 2 AND 5")
def packed_slice(spark, sf_dir):
    rows = src.row_view(src.packed(*polylines(spark, sf_dir)), 2, 6)
    return rows.select("label", F.col("v_off").cast("long").alias("v_off"), F.size("vertices").cast("long").alias("vertices"))


@query(WITH + POLY + ", g AS (SELECT label, vidx, row_number() OVER (ORDER BY label, vidx) - 1 AS g FROM vert) SELECT e.label, a.g AS g0, b.g AS g1 FROM edge e JOIN g a ON a.label = e.label AND a.vidx = e0 JOIN g b ON b.label = e.label AND b.vidx = e1")
def global_edges(spark, sf_dir):
    """Edges for an export with one list of vertices."""
    return out(src.global_edges(src.packed(*polylines(spark, sf_dir))), "label", "g0", "g1")


@query(WITH + shapes.comb_sql() + f", n AS (SELECT label, count(*) AS v FROM {shapes.comb_kept()} GROUP BY label) SELECT label, v AS vertices, v - 1 AS edges, CAST(coalesce(sum(v) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v_off FROM n")
def skeletonize_packed(spark, sf_dir):
    """Skeletons as one row each, with offsets."""
    rows = src.packed(*traced(spark))
    return rows.select("label", F.size("vertices").cast("long").alias("vertices"), F.size("edges").cast("long").alias("edges"), "v_off")


@query(WITH + TUBES + ", bg AS (SELECT i % 26 - 1 AS x, i // 26 - 1 AS y FROM range(676) r(i)) SELECT a.vid, CAST(min((a.x-bg.x)*(a.x-bg.x) + (a.y-bg.y)*(a.y-bg.y)) AS BIGINT) AS d2 FROM vox a, bg WHERE a.z IN (3, 8, 17) AND NOT EXISTS (SELECT 1 FROM vox b WHERE b.x = bg.x AND b.y = bg.y AND b.z = a.z AND b.label = a.label) GROUP BY a.vid")
def edt_planes(spark, sf_dir):
    """Distances within planes."""
    rows = distance.line_edt(src.small_tubes(spark).where("z IN (3, 8, 17)"), (1.0, 1.0, 1.0), 2)
    return rows.select("vid", F.round(F.col("d") * F.col("d")).cast("long").alias("d2"))


@query(WITH + TUBES + ", lo AS (SELECT * FROM vox WHERE z < 12), hi AS (SELECT x, y, z - 12 AS z, x + 24 * (y + 24 * (z - 12)) AS vid, label FROM vox WHERE z >= 12), both_ AS (SELECT 0 AS volume_id, * FROM lo UNION ALL SELECT 1, * FROM hi), cell AS (SELECT i % 24 AS x, (i // 24) % 24 AS y, i // 576 AS z FROM range(6912) r(i)) SELECT CAST(a.volume_id AS BIGINT) AS volume_id, a.vid, CAST(min((a.x-c.x)*(a.x-c.x) + (a.y-c.y)*(a.y-c.y) + (a.z-c.z)*(a.z-c.z)) AS BIGINT) AS d2 FROM both_ a JOIN cell c ON abs(a.x-c.x) <= 6 AND abs(a.y-c.y) <= 6 AND abs(a.z-c.z) <= 6 WHERE NOT EXISTS (SELECT 1 FROM both_ b WHERE b.volume_id = a.volume_id AND b.x = c.x AND b.y = c.y AND b.z = c.z AND b.label = a.label) GROUP BY a.volume_id, a.vid")
def edt_stack(spark, sf_dir):
    """A stack of independent samples: no distance reaches from one into the next."""
    rows = src.small_tubes(spark)
    halves_ = rows.where("z < 12").unionByName(rows.where("z >= 12").withColumns({"volume_id": F.lit(1).cast("long"), "z": F.col("z") - 12})).withColumn("vid", flat_index("x", "y", "z", F.lit(24), F.lit(24)))
    volumes = cube(spark, 0, sides=(24, 24, 12)).unionByName(cube(spark, 0, sides=(24, 24, 12)).withColumn("volume_id", F.lit(1).cast("long")))
    return distance.squared_edt(halves_, volumes, key="label").select("volume_id", "vid", F.col("d2").cast("long").alias("d2"))


@query(WITH + shapes.comb_sql() + " SELECT label, vid FROM vox WHERE y = 4")
def trace_first_path(spark, sf_dir):
    """With a limit of two paths (the spine's and one tooth's), the spine is there and one end beside it."""
    v, _ = pipeline.skeletonize(shapes.combs(spark), shapes.size(spark, shapes.COMB_SHAPE), {**TRACE, "max_paths": 2}, dust_threshold=0)
    rows = v.where("y = 4").select("label", *[F.col(a).cast("long").alias(a) for a in "xyz"])
    return rows.select("label", flat_index("x", "y", "z", F.lit(48), F.lit(20)).alias("vid"))


@query(WITH + shapes.star_sql() + ", mid AS (SELECT *, sqrt((x-24)*(x-24) + (y-24)*(y-24) + (z-24)*(z-24)) AS far FROM vox), body AS (SELECT sqrt(min((a.x-24)*(a.x-24) + (a.y-24)*(a.y-24) + (a.z-24)*(a.z-24))) AS deep FROM (SELECT i % 48 AS x, (i // 48) % 48 AS y, i // 2304 AS z, i AS vid FROM range(110592) r(i)) a ANTI JOIN vox USING (vid)) SELECT x, y, z, round(CASE WHEN far = 0 THEN deep ELSE 1 END, 4) AS radius FROM mid, body WHERE far = 0 OR far > deep + 1")
def skeleton_of_a_body(spark, sf_dir):
    """A cell body becomes its middle, and its arms begin where its radius (scale 1, const 1) ends."""
    params = {**TRACE, "soma_detection_threshold": 5, "soma_acceptance_threshold": 5.5, "soma_invalidation_scale": 1, "soma_invalidation_const": 1}
    v, _ = pipeline.skeletonize(shapes.star(spark), cube(spark, 48), params, dust_threshold=0)
    return v.select(*[F.col(a).cast("long").alias(a) for a in "xyz"], F.round(F.col("radius").cast("double"), 4).alias("radius"))


#: Parameters and spacing of the published runs, but for the chunking.
PUBLISHED = {"scale": 1.5, "const": 300, "pdrf_exponent": 4, "pdrf_scale": 100000, "soma_detection_threshold": 1100, "soma_acceptance_threshold": 3500, "soma_invalidation_scale": 1.0, "soma_invalidation_const": 300}


@query(WITH + shapes.DENSE_SKELETONS + " SELECT label, CAST(x * 16 AS BIGINT) AS x, CAST(y * 16 AS BIGINT) AS y, CAST(z * 40 AS BIGINT) AS z, CAST(radius * 16 AS BIGINT) AS radius FROM line")
def skeletonize_dense(spark, sf_dir):
    """A dense volume, 120 voxels a side, with the parameters of the published runs."""
    v, _ = pipeline.skeletonize(shapes.dense_bars(spark), cube(spark, shapes.DENSE_SIDE, aniso=(16.0, 16.0, 40.0)), PUBLISHED, dust_threshold=1000)
    return v.select("label", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "z", "radius")])


def tube_line(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A square tube, and a straight line along it as vertices and edges."""
    tube = src.small_tubes(spark).where("x BETWEEN 16 AND 19 AND z BETWEEN 16 AND 19")
    line = spark.range(2, 22).select(F.lit(0).cast("long").alias("volume_id"), F.lit(2).cast("long").alias("label"), (F.col("id") - 2).alias("vidx"), F.lit(17).cast("float").alias("x"), F.col("id").cast("float").alias("y"), F.lit(17).cast("float").alias("z"), F.lit(1).cast("float").alias("radius"))
    return tube, line, src.polyline_edges(line)


PASSES = TUBES + ", p AS (SELECT y, count(*) AS n FROM vox WHERE z BETWEEN 16 AND 19 AND x BETWEEN 16 AND 19 GROUP BY y)"


@query(WITH + PASSES + " SELECT y, CAST(CASE WHEN y % 3 = 0 THEN 99 ELSE n END AS DOUBLE) AS area FROM p")
def section_multipass(spark, sf_dir):
    """A second pass measures the vertices that a first one left at 0, and leaves all others."""
    tube, line, edges = tube_line(spark)
    first = line.select("volume_id", "label", "vidx", F.when(F.col("y") % 3 == 0, 99.0).otherwise(0.0).cast("float").alias("area"), F.lit(0).cast("long").alias("contacts"))
    areas = analysis.cross_sectional_area(tube, cube(spark, 24), line, edges, previous=first, multipass=True)
    return areas.select((F.col("vidx") + 2).alias("y"), F.col("area").cast("double").alias("area"))


@query(WITH + PASSES + " SELECT y, CAST(n AS DOUBLE) AS area, CAST(0 AS BIGINT) AS contacts FROM p")
def section_repair(spark, sf_dir):
    """Sections cut short by a crop at x = 17 touch its face; a second pass over the whole volume measures them again."""
    tube, line, edges = tube_line(spark)
    crop = tube.where("x <= 17").withColumn("vid", F.expr("x + 18 * (y + 24 * z)"))
    first = analysis.cross_sectional_area(crop, cube(spark, 0, sides=(18, 24, 24)), line, edges)
    areas = analysis.cross_sectional_area(tube, cube(spark, 24), line, edges, previous=first, repair_contacts=True)
    return areas.select((F.col("vidx") + 2).alias("y"), F.col("area").cast("double").alias("area"), "contacts")
