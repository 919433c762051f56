"""Joins in space: neighbours, nearest voxels, vertices within a radius, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from voxloom.operators.filters import with_steps


def neighbour_pairs(voxels: DataFrame, volumes: DataFrame, same_label: bool = True, bits: str | None = None) -> DataFrame:
    """(volume_id, vid, nvid, k, bit): voxels one step apart, of one label unless told otherwise.  An equi join on the
    computed index; steps out of the volume are dropped before it."""
    asked = with_steps(voxels, volumes, bits).select("volume_id", "vid", "nvid", "k", "bit", "label")
    other = voxels.select("volume_id", F.col("vid").alias("nvid"), F.col("label").alias("nlabel"))
    found = asked.join(other, ["volume_id", "nvid"])
    return (found.where("label = nlabel") if same_label else found).select("volume_id", "vid", "nvid", "k", "bit")


def neighbour_bits(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """(volume_id, vid, bits, degree): which steps lead to the same label."""
    pairs = neighbour_pairs(voxels, volumes)
    return pairs.groupBy("volume_id", "vid").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit AS int))")).alias("bits"), F.count("*").alias("degree"))


def assign_targets(targets: DataFrame, voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Targets with the voxel they lie on and its label (null on background).  Negative coordinates count from the end
    once; outside the volume is an error when the row is read."""
    rows = targets.join(volumes.select("volume_id", "sx", "sy", "sz"), "volume_id")
    for a in "xyz":
        wrapped = F.when(F.col(a) < 0, F.col(a) + F.col(f"s{a}")).otherwise(F.col(a))
        inside = (wrapped >= 0) & (wrapped < F.col(f"s{a}"))
        rows = rows.withColumn(f"w{a}", F.when(inside, wrapped).otherwise(F.raise_error(F.lit("a target lies outside the volume")).cast("long")))
    rows = rows.withColumn("vid", F.expr("wx + sx * (wy + sy * wz)"))
    return rows.join(voxels.select("volume_id", "vid", "label"), ["volume_id", "vid"], "left").select(*targets.columns, "vid", "label")


def nearest_label_voxels(queries: DataFrame, voxels: DataFrame, sides: tuple[int, ...] = (128, 8)) -> DataFrame:
    """Each query with the nearest voxel of its label: x, y, z (-1 where the label is absent); ties go to the least
    (x, y, z).

    Voxels are summed up to boxes on grids of falling sides (each a divisor of the one before).  A query meets the boxes of
    its label, keeps those that could hold its nearest voxel (their least distance is no more than the best box's
    greatest), goes on to the smaller boxes inside them, and meets voxels only at the end."""
    cell = lambda a, side: F.floor(F.col(a) / side)
    square = lambda d: sum((d[a] * d[a] for a in "xyz"), F.lit(0.0))
    near, inside = queries.select("qid", "label", "cx", "cy", "cz"), []
    for side in sides:
        boxes = voxels.groupBy("label", *[cell(a, side).alias(f"g{a}") for a in "xyz"]).agg(*[f(a).alias(f"{a}{n}") for a in "xyz" for n, f in ((0, F.min), (1, F.max))])
        if inside:
            boxes = boxes.withColumns({f"p{a}": F.floor(F.col(f"{a}0") / inside[-1]) for a in "xyz"})
        met = near.join(boxes, ["label", *(["px", "py", "pz"] if inside else [])])
        gap = {a: F.greatest(F.col(f"{a}0") - F.col(f"c{a}"), F.col(f"c{a}") - F.col(f"{a}1"), F.lit(0.0)) for a in "xyz"}
        far = {a: F.greatest(F.abs(F.col(f"c{a}") - F.col(f"{a}0")), F.abs(F.col(f"c{a}") - F.col(f"{a}1"))) for a in "xyz"}
        bounds = met.select("qid", "label", "cx", "cy", "cz", *[F.col(f"g{a}").alias(f"p{a}") for a in "xyz"], square(gap).alias("low"), square(far).alias("high"))
        best = bounds.groupBy("qid").agg(F.min("high").alias("best"))
        near = bounds.join(best, "qid").where(F.col("low") <= F.col("best") + 1e-9).drop("low", "high", "best")
        inside.append(side)
    held = voxels.select("label", "x", "y", "z", *[cell(a, sides[-1]).alias(f"p{a}") for a in "xyz"])
    d2 = sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0))
    found = near.join(held, ["label", "px", "py", "pz"]).groupBy("qid").agg(F.min_by(F.struct("x", "y", "z"), F.struct(d2.alias("d"), "x", "y", "z")).alias("p"))
    absent = F.lit(-1).cast("long")
    return queries.join(found, "qid", "left").select(*queries.columns, *[F.coalesce(f"p.{a}", absent).alias(a) for a in "xyz"])


def synapse_targets(queries: DataFrame, voxels: DataFrame) -> DataFrame:
    """(x, y, z, tag): the voxels nearest to tagged points; of several tags at one voxel the last (by label, then tag)."""
    found = nearest_label_voxels(queries, voxels).where("x >= 0")
    return found.groupBy("x", "y", "z").agg(F.max_by("tag", F.struct("label", "tag")).alias("tag"))


def radius_pairs(vertices: DataFrame, radius: float, part: str = "part", with_parts: bool = False) -> DataFrame:
    """(volume_id, label, a, b, d2): vertices of different parts of a label that are nearer than ``radius``; a cell of a
    grid with that side meets the cells around it."""
    cell = {a: F.floor(F.col(a) / radius) for a in "xyz"}
    rows = vertices.select("volume_id", "label", F.col("vidx"), F.col(part).alias("part"), "x", "y", "z", *[c.alias(f"g{a}") for a, c in cell.items()])
    around = rows
    for a in "xyz":
        around = around.withColumn(f"g{a}", F.explode(F.array(*[F.col(f"g{a}") + d for d in (-1, 0, 1)])))
    left = around.select("volume_id", "label", "gx", "gy", "gz", F.col("vidx").alias("a"), F.col("part").alias("pa"), *[F.col(c).alias(f"{c}a") for c in "xyz"])
    right = rows.select("volume_id", "label", "gx", "gy", "gz", F.col("vidx").alias("b"), F.col("part").alias("pb"), *[F.col(c).alias(f"{c}b") for c in "xyz"])
    d2 = sum(((F.col(f"{c}a") - F.col(f"{c}b")) * (F.col(f"{c}a") - F.col(f"{c}b")) for c in "xyz"), F.lit(0))
    pairs = left.join(right, ["volume_id", "label", "gx", "gy", "gz"]).where("pa < pb").withColumn("d2", d2)
    return pairs.where(F.col("d2") < radius * radius).select("volume_id", "label", "a", "b", "d2", *(["pa", "pb"] if with_parts else []))


def nearest_between_parts(vertices: DataFrame, radius: float, part: str = "part") -> DataFrame:
    """The closest vertices of each two parts within the radius: (volume_id, label, pa, pb, a, b, d2)."""
    keys = ["volume_id", "label", "pa", "pb"]
    # the least of each cell's pairs is found where the cells meet; only those are shuffled
    return radius_pairs(vertices, radius, part, True).groupBy(*keys).agg(F.min(F.struct("d2", "a", "b")).alias("m")).select(*keys, "m.a", "m.b", "m.d2")


def ownership(filled: DataFrame, owners: DataFrame) -> DataFrame:
    """How many of a filling's voxels belong to other components: (cc, owner, voxels)."""
    rows = filled.select("volume_id", "vid", F.col("cc").alias("filler")).join(owners.select("volume_id", "vid", "cc"), ["volume_id", "vid"])
    return rows.where("cc <> filler").groupBy("volume_id", F.col("filler").alias("cc"), F.col("cc").alias("owner")).agg(F.count("*").alias("voxels"))


def first_hits(voxels: DataFrame, centres: DataFrame) -> DataFrame:
    """(volume_id, cid, axis, direction, label): the first other label that each of six rays from a centre meets before
    background; rays downward don't look at coordinate 0.

    Runs of foreground along a ray are found by the distance to the centre: a voxel n steps away is seen only if all n
    voxels up to it are foreground."""
    out = None
    for axis in "xyz":
        others = [a for a in "xyz" if a != axis]
        line = centres.select("volume_id", "cid", *[F.col(a).alias(f"c{a}") for a in "xyz"], F.col("label").alias("own"))
        on = line.join(voxels, (line.volume_id == voxels.volume_id) & (F.col(f"c{others[0]}") == F.col(others[0])) & (F.col(f"c{others[1]}") == F.col(others[1]))).drop(voxels.volume_id)
        step = on.withColumn("n", F.abs(F.col(axis) - F.col(f"c{axis}"))).withColumn("direction", F.when(F.col(axis) >= F.col(f"c{axis}"), 1).otherwise(-1)).where(f"direction = 1 OR {axis} > 0")
        order = Window.partitionBy("volume_id", "cid", "direction").orderBy("n")
        seen = step.where("n > 0").withColumn("rank", F.row_number().over(order)).where("rank = n AND label <> own")
        hit = seen.groupBy("volume_id", "cid", "direction").agg(F.min_by("label", "n").alias("label")).withColumn("axis", F.lit(axis))
        out = hit if out is None else out.unionByName(hit)
    return out.select("volume_id", "cid", "axis", "direction", "label")
