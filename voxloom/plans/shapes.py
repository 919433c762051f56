"""Shapes whose skeletons are known: volumes of combs and pipes, and comb graphs from a table, in Spark and in SQL.

A comb is one voxel thick: a spine with teeth of several lengths.  Tracing keeps the spine and every tooth that is longer
than what a path takes along, so the skeleton follows from the lengths.  A pipe is a bar of three voxels a side, hollow or
with a core; filled, its skeleton is the middle line and two corners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.schemas import VOLUMES
from voxloom.sources import volumes as src

COMB_SHAPE, PIPE_SHAPE, BAR_SHAPE = (48, 20, 12), (44, 14, 10), (30, 20, 12)
#: Where teeth stand, and their length by place and label; a tooth of ``KEPT`` voxels or more is traced (scale 1.5, const 2).
TEETH, KEPT = "x % 6 = 3 AND x BETWEEN 15 AND 33", 4


def _cells(shape: tuple[int, int, int], case: str) -> str:
    sx, sy, sz = shape
    return f"(SELECT *, CAST(CASE {case} ELSE 0 END AS BIGINT) AS label FROM (SELECT i AS vid, i % {sx} AS x, (i // {sx}) % {sy} AS y, i // {sx * sy} AS z FROM range({sx * sy * sz}) r(i)))"


def comb_case(factor: int) -> str:
    """Labels 1 to 3 in the planes z = 3, 6, 9."""
    return f"WHEN z IN (3, 6, 9) AND ((y = 4 AND x BETWEEN 2 AND 45) OR ({TEETH} AND y BETWEEN 5 AND 4 + (x * {factor} + (z // 3) * 5) % 11)) THEN z // 3"


def combs(spark: SparkSession, factor: int = 7, volume_id: int = 0) -> DataFrame:
    return src.generated(spark, COMB_SHAPE, F.expr(f"CASE {comb_case(factor).replace('//', 'div')} ELSE 0 END"), volume_id)


def comb_sql(name: str = "vox", factor: int = 7) -> str:
    return f"{name} AS (SELECT * FROM {_cells(COMB_SHAPE, comb_case(factor))} WHERE label <> 0)"


def comb_kept(name: str = "vox", factor: int = 7) -> str:
    """SQL: the voxels of ``name`` on the skeleton."""
    return f"(SELECT *, row_number() OVER (PARTITION BY label ORDER BY x, y, z) - 1 AS vidx FROM {name} WHERE y = 4 OR (x * {factor} + label * 5) % 11 >= {KEPT})"


#: A hollow pipe with label 5, and one with label 6 around a core with label 7.
PIPE_CASE = (
    "WHEN x BETWEEN 2 AND 40 AND y BETWEEN 3 AND 5 AND z BETWEEN 3 AND 5 THEN CASE WHEN y = 4 AND z = 4 AND x BETWEEN 3 AND 39 THEN 0 ELSE 5 END "
    "WHEN x BETWEEN 4 AND 30 AND y BETWEEN 9 AND 11 AND z BETWEEN 4 AND 6 THEN CASE WHEN y = 10 AND z = 5 AND x BETWEEN 5 AND 29 THEN 7 ELSE 6 END"
)
#: SQL: the skeletons of the filled pipes.
PIPE_SKELETONS = """p(label, lo, hi, y0, z0) AS (VALUES (CAST(5 AS BIGINT), 2, 40, 3, 3), (6, 4, 30, 9, 4)),
line AS (SELECT label, CAST(x AS BIGINT) AS x, y0 + CASE WHEN x = lo THEN 0 WHEN x = hi THEN 2 ELSE 1 END AS y, z0 + CASE WHEN x = lo THEN 0 WHEN x = hi THEN 2 ELSE 1 END AS z, CASE WHEN x IN (lo, hi) THEN 1 ELSE 2 END AS radius FROM p, range(50) r(x) WHERE x BETWEEN lo AND hi)"""


def pipes(spark: SparkSession) -> DataFrame:
    return src.generated(spark, PIPE_SHAPE, F.expr(f"CASE {PIPE_CASE} ELSE 0 END"))


def pipe_sql(name: str = "vox") -> str:
    return f"{name} AS (SELECT * FROM {_cells(PIPE_SHAPE, PIPE_CASE)} WHERE label <> 0)"


#: Bars through the volume, whose cross sections have an odd number of voxels a side: each meets two faces.
BAR_CASE = (
    "WHEN y BETWEEN 2 AND 4 AND z BETWEEN 2 AND 4 THEN 1 WHEN y BETWEEN 8 AND 12 AND z BETWEEN 2 AND 4 THEN 2 "
    "WHEN x BETWEEN 10 AND 12 AND z BETWEEN 8 AND 10 THEN 3 WHEN x BETWEEN 20 AND 26 AND y BETWEEN 15 AND 17 THEN 4"
)


def bars(spark: SparkSession) -> DataFrame:
    return src.generated(spark, BAR_SHAPE, F.expr(f"CASE {BAR_CASE} ELSE 0 END"))


def bar_sql(name: str = "vox") -> str:
    return f"{name} AS (SELECT * FROM {_cells(BAR_SHAPE, BAR_CASE)} WHERE label <> 0)"


#: Bars along z, three voxels wide and one apart, that touch no face of 120 voxels a side: 841 labels, 52 % of the voxels.
DENSE_SIDE = 120
DENSE_CASE = "WHEN x % 4 > 0 AND y % 4 > 0 AND x < 116 AND y < 116 AND z BETWEEN 1 AND 118 THEN 1 + (x // 4) + 29 * (y // 4)"
#: SQL: their skeletons: the middle line, and a corner at each end.
DENSE_SKELETONS = """line AS (SELECT CAST(1 + p + 29 * q AS BIGINT) AS label, 4 * p + 1 + m AS x, 4 * q + 1 + m AS y, z, CASE WHEN m = 1 THEN 2 ELSE 1 END AS radius
    FROM (SELECT p, q, z, CASE z WHEN 1 THEN 0 WHEN 118 THEN 2 ELSE 1 END AS m FROM range(29) a(p), range(29) b(q), range(1, 119) c(z)))"""


def dense_bars(spark: SparkSession) -> DataFrame:
    return src.generated(spark, (DENSE_SIDE,) * 3, F.expr(f"CASE {DENSE_CASE.replace('//', 'div')} ELSE 0 END"))


#: A ball with six arms of one voxel, 48 a side: a cell body and its branches.
STAR_SIDE, STAR_CASE = 48, "WHEN (x-24)*(x-24) + (y-24)*(y-24) + (z-24)*(z-24) <= 36 THEN 1 WHEN (x BETWEEN 2 AND 45 AND y = 24 AND z = 24) OR (y BETWEEN 2 AND 45 AND x = 24 AND z = 24) OR (z BETWEEN 2 AND 45 AND x = 24 AND y = 24) THEN 1"


def star(spark: SparkSession) -> DataFrame:
    return src.generated(spark, (STAR_SIDE,) * 3, F.expr(f"CASE {STAR_CASE} ELSE 0 END"))


def star_sql(name: str = "vox") -> str:
    return f"{name} AS (SELECT * FROM {_cells((STAR_SIDE,) * 3, STAR_CASE)} WHERE label <> 0)"


def size(spark: SparkSession, shape: tuple[int, int, int], volume_id: int = 0) -> DataFrame:
    return spark.createDataFrame([(volume_id, *shape, 1.0, 1.0, 1.0)], VOLUMES)


#: SQL: ``comb`` graphs over the polylines ``vert``: a spine of spacing 10 and, at two places in twenty (but for the last
#: nine vertices), teeth of 1 to 7 vertices of spacing 1.
COMB_GRAPH = """spine AS (SELECT v.label, v.vidx, n, 1 + (v.vidx * 3 + v.label) % 7 AS long FROM vert v JOIN (SELECT label, count(*) AS n FROM vert GROUP BY label) USING (label)),
roots AS (SELECT * FROM spine WHERE vidx % 20 IN (2, 17) AND vidx <= n - 10),
tooth AS (SELECT label, vidx, n, long, j FROM roots, (SELECT range AS j FROM range(1, 8)) WHERE j <= long),
point AS (SELECT label, vidx, vidx * 10 AS x, 0 AS y FROM spine UNION ALL SELECT label, 1000000 + vidx * 10 + j, vidx * 10, j FROM tooth)"""


def comb_graph(polylines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the comb graphs; a tooth's vertices have numbers above a million."""
    counts = polylines.groupBy("volume_id", "label").agg(F.count("*").alias("n"))
    spine = polylines.join(counts, ["volume_id", "label"]).select("volume_id", "label", "vidx", "n", (1 + (F.col("vidx") * 3 + F.col("label")) % 7).alias("long"))
    tooth = spine.where("vidx % 20 IN (2, 17) AND vidx <= n - 10").withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("long"))))
    name = F.expr("1000000 + vidx * 10 + j")
    place = lambda x, y: [x.cast("float").alias("x"), y.cast("float").alias("y"), F.lit(0).cast("float").alias("z"), F.lit(6).cast("float").alias("radius")]
    vertices = spine.select("volume_id", "label", "vidx", *place(F.col("vidx") * 10, F.lit(0))).unionByName(tooth.select("volume_id", "label", name.alias("vidx"), *place(F.col("vidx") * 10, F.col("j"))))
    edges = src.polyline_edges(polylines).unionByName(tooth.select("volume_id", "label", F.when(F.col("j") == 1, F.col("vidx")).otherwise(name - 1).alias("e0"), name.alias("e1")))
    return vertices, edges
