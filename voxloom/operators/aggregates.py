"""Aggregates of components and skeletons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The box of an id without voxels.
EMPTY_LOW, EMPTY_HIGH = (1 << 31) - 1, -1


def box_stats(voxels: DataFrame, key: str = "cc", *more: Column) -> DataFrame:
    """Bounding box and voxel count of each component, and ``more`` of it; partial sums are made before the shuffle."""
    return voxels.groupBy("volume_id", key).agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("voxels"), F.min("vid").alias("root"), *more)


def dense_boxes(voxels: DataFrame, key: str, count: int) -> DataFrame:
    """The same for all ids 0 to ``count``; an id without voxels has an empty box and count 0."""
    stats = box_stats(voxels, key)
    ids = voxels.sparkSession.range(count + 1).withColumnRenamed("id", key)
    keys = voxels.select("volume_id").distinct().join(ids)
    rows = keys.join(stats, ["volume_id", key], "left")
    lows = {f"lo_{a}": F.coalesce(f"lo_{a}", F.lit(EMPTY_LOW)).cast("long") for a in "xyz"}
    highs = {f"hi_{a}": F.coalesce(f"hi_{a}", F.lit(EMPTY_HIGH)).cast("long") for a in "xyz"}
    return rows.withColumns({**lows, **highs, "voxels": F.coalesce("voxels", F.lit(0)).cast("long")}).drop("root")


def merged_boxes(parts: DataFrame, key: str = "cc") -> DataFrame:
    """Boxes of slabs put together."""
    return parts.groupBy("volume_id", key).agg(*[F.min(f"lo_{a}").alias(f"lo_{a}") for a in "xyz"], *[F.max(f"hi_{a}").alias(f"hi_{a}") for a in "xyz"], F.sum("voxels").cast("long").alias("voxels"), F.min("root").alias("root"))


def background_count(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    held = voxels.groupBy("volume_id").agg(F.count("*").alias("n"))
    return volumes.join(held, "volume_id", "left").select("volume_id", (F.col("sx") * F.col("sy") * F.col("sz") - F.coalesce("n", F.lit(0))).alias("background"))


def label_range(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("volume_id").agg(F.min("label").alias("least"), F.max("label").alias("greatest"), F.count_distinct("label").alias("labels"))


def field_summary(voxels: DataFrame, field: str = "dbf", key: str = "cc") -> DataFrame:
    """(greatest, valid, first): NaN counts for nothing."""
    value = F.when(F.isnan(F.col(field).cast("double")), None).otherwise(F.col(field))
    return voxels.groupBy("volume_id", key).agg(F.max(value).alias("greatest"), F.count("*").alias("valid"), F.min("vid").alias("first"))


def maxima(voxels: DataFrame, field: str = "dbf", key: str = "cc") -> DataFrame:
    """The voxels with the greatest value of their component: joined with the maxima, so no component is sorted."""
    top = voxels.groupBy("volume_id", key).agg(F.max(field).alias("__top"))
    return voxels.join(top, ["volume_id", key]).where(F.col(field) == F.col("__top")).drop("__top")


def argmax(voxels: DataFrame, field: str, key: str = "cc") -> DataFrame:
    """(vid, value): the greatest finite value, the least index on ties."""
    rows = voxels.where(F.col(field).isNotNull() & ~F.isnan(F.col(field).cast("double")) & (F.abs(F.col(field).cast("double")) < float("inf")))
    return rows.groupBy("volume_id", key).agg(F.max_by(F.struct(F.col("vid"), F.col(field).alias("value")), F.struct(F.col(field), -F.col("vid"))).alias("m")).select("volume_id", key, "m.vid", "m.value")


def soma_centres(voxels: DataFrame, field: str = "dbf", key: str = "cc") -> DataFrame:
    """Of a component's maxima, the one nearest their mean; the first in the order of (x, y, z) on ties."""
    top = maxima(voxels, field, key)
    mean = top.groupBy("volume_id", key).agg(*[F.avg(a).cast("float").cast("double").alias(f"m{a}") for a in "xyz"])
    cost = sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in "xyz"), F.lit(0.0))
    return top.join(mean, ["volume_id", key]).groupBy("volume_id", key).agg(F.min_by(F.struct("x", "y", "z"), F.struct(cost.alias("cost"), "x", "y", "z")).alias("p")).select("volume_id", key, "p.x", "p.y", "p.z")


def mean_finite(voxels: DataFrame, field: str, key: str = "cc") -> DataFrame:
    value = F.col(field).cast("double")
    return voxels.groupBy("volume_id", key).agg(F.avg(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)).alias("mean"))


def first_voxels(voxels: DataFrame, key: str = "label") -> DataFrame:
    return voxels.groupBy("volume_id", key).agg(F.min("vid").alias("first"))


def edges_with_ends(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the coordinates of both ends: x0, y0, z0, x1, y1, z1."""
    keys = ["volume_id", "label"]
    out = edges
    for e in ("e0", "e1"):
        out = out.join(vertices.select(*keys, F.col("vidx").alias(e), *[F.col(a).alias(f"{a}{e[1]}") for a in "xyz"]), [*keys, e])
    return out


def edge_length() -> object:
    return F.sqrt(sum(((F.col(f"{a}0") - F.col(f"{a}1")).cast("double") * (F.col(f"{a}0") - F.col(f"{a}1")).cast("double") for a in "xyz"), F.lit(0.0)))


def cable_lengths(vertices: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """Summed length of edges of each skeleton, and of further keys of the edges (such as the part)."""
    return edges_with_ends(vertices, edges).groupBy("volume_id", "label", *more).agg(F.sum(edge_length()).alias("cable"), F.count("*").alias("edges"))


def within_cable(vertices: DataFrame, edges: DataFrame, most: float) -> DataFrame:
    """Skeletons whose cable is no longer than ``most``: (volume_id, label, cable)."""
    return cable_lengths(vertices, edges).where(F.col("cable") <= most).select("volume_id", "label", "cable")


def size_class(stats: DataFrame) -> DataFrame:
    """Components by voxels: S below 10,000, M below 100,000, L below 1,000,000, else XL."""
    n = F.col("voxels")
    return stats.withColumn("size_class", F.when(n < 10_000, "S").when(n < 100_000, "M").when(n < 1_000_000, "L").otherwise("XL"))


def degrees(edges: DataFrame) -> DataFrame:
    """(volume_id, label, vidx, degree)."""
    return edges.select("volume_id", "label", F.explode(F.array("e0", "e1")).alias("vidx")).groupBy("volume_id", "label", "vidx").agg(F.count("*").alias("degree"))


def branch_counts(edges: DataFrame) -> DataFrame:
    """Ends and branch points of each skeleton."""
    return degrees(edges).groupBy("volume_id", "label").agg(F.count_if(F.col("degree") == 1).alias("terminals"), F.count_if(F.col("degree") >= 3).alias("branches"), F.count("*").alias("vertices"))


def face_patches(pixels: DataFrame) -> DataFrame:
    """Per patch of a face: greatest distance, first pixel in the order of (v, u), sums of coordinates, pixels."""
    return pixels.groupBy("volume_id", "face", "patch").agg(F.max("d2").alias("d2"), F.min(F.struct("v", "u")).alias("first"), F.sum("u").cast("long").alias("sum_u"), F.sum("v").cast("long").alias("sum_v"), F.count("*").alias("pixels"))


def ray_votes(hits: DataFrame, centres: DataFrame) -> DataFrame:
    """(volume_id, cid, owner): the label that most rays meet, or the centre's own if under three rays hit or they disagree."""
    votes = hits.groupBy("volume_id", "cid", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("volume_id", "cid").agg(F.sum("n").alias("rays"), F.max("n").alias("most"), F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("winner"))
    agree = (F.col("rays") >= 3) & (F.col("rays") - F.col("most") <= F.when(F.col("rays") > 3, 1).otherwise(0))
    return centres.join(best, ["volume_id", "cid"], "left").select("volume_id", "cid", F.when(agree, F.col("winner")).otherwise(F.col("label")).alias("owner"))


def distinct_points(points: DataFrame) -> DataFrame:
    return points.select("volume_id", "x", "y", "z").distinct()


def branch_means(areas: DataFrame, edges: DataFrame) -> DataFrame:
    """One area a vertex: the mean over paths at branch points, else the first path's."""
    return areas.join(degrees(edges), ["volume_id", "label", "vidx"]).groupBy("volume_id", "label", "vidx").agg(F.when(F.max("degree") >= 3, F.avg("area")).otherwise(F.min_by("area", "path")).alias("area"))


def removed_per_label(before: DataFrame, after: DataFrame, key: str = "cc") -> DataFrame:
    """How many voxels of each component went."""
    gone = before.select("volume_id", key, "vid").join(after.select("volume_id", "vid"), ["volume_id", "vid"], "left_anti")
    return gone.groupBy("volume_id", key).agg(F.count("*").alias("removed"))


def ranked(voxels: DataFrame, field: str, key: str = "cc") -> DataFrame:
    """Order of tracing targets: the field from high to low, the index from high to low on ties.  Voxels are sorted among
    those of equal value only; where a value starts comes from a sum over the component's distinct values."""
    of = ["volume_id", key, field]
    counts = voxels.groupBy(*of).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("volume_id", key).orderBy(F.col(field).desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(*of).orderBy(F.col("vid").desc()))
    same = reduce(lambda x, y: x & y, [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in of])
    joined = voxels.withColumn("__within", within).alias("v").join(starts.alias("s"), same)
    return joined.select("v.*", (F.col("__start") + F.col("__within")).cast("long").alias("rank")).drop("__within")


def next_targets(ranked_voxels: DataFrame, key: str = "cc") -> DataFrame:
    """The first voxel in that order that is still alive."""
    return ranked_voxels.where("alive").groupBy("volume_id", key).agg(F.min_by("vid", "rank").alias("vid"))


def run_starts(voxels: DataFrame, key: str = "label") -> DataFrame:
    """The first voxel of each run of equal ids in the order of the index; a gap in the stored voxels ends a run."""
    before = voxels.select("volume_id", (F.col("vid") + 1).alias("vid"), F.col(key).alias("__k"))
    return voxels.join(before, ["volume_id", "vid"], "left").where(F.col("__k").isNull() | (F.col("__k") != F.col(key))).select(*voxels.columns)


def smoothed_path(path: DataFrame, window: int, values: tuple[str, ...] = ("x", "y", "z"), keys: tuple[str, ...] = ("volume_id", "label")) -> DataFrame:
    """Trailing means over ``window`` rows of a path mirrored at its ends, forward and then backward."""

    def once(df: DataFrame, order: str) -> DataFrame:
        df = df.withColumn("__i", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.expr(order))) - 1).cast("long"))
        # a row and its mirror image stay in their task
        both = F.when(F.col("__i") < window - 1, F.array(F.col("__i"), -F.col("__i") - 1)).otherwise(F.array("__i"))
        frame = Window.partitionBy(*keys).orderBy("__i").rowsBetween(-(window - 1), 0)
        out = df.withColumn("__i", F.explode(both)).withColumns({v: F.avg(v).over(frame) for v in values})
        return out.where("__i >= 0").drop("__i")

    if window < 2:
        return path
    return once(once(path, "vidx"), "-vidx")


def path_tangents(path: DataFrame, keys: tuple[str, ...] = ("volume_id", "label")) -> DataFrame:
    """Differences to the next vertex; the last repeats."""
    order = Window.partitionBy(*keys).orderBy("vidx")
    ahead = path.withColumns({f"t{a}": F.lead(a).over(order) - F.col(a) for a in "xyz"})
    return ahead.withColumns({f"t{a}": F.coalesce(f"t{a}", F.lag(f"t{a}").over(order)) for a in "xyz"})


def every_step(path: DataFrame, step: int, keys: tuple[str, ...] = ("volume_id", "label")) -> DataFrame:
    """Every ``step``-th vertex, and both ends."""
    whole = Window.partitionBy(*keys)
    last = path.withColumn("__last", F.max("vidx").over(whole))
    return last.where((F.col("vidx") % step == step - 1) | (F.col("vidx") == 0) | (F.col("vidx") == F.col("__last"))).drop("__last")
