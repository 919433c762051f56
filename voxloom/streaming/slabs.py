"""Components, distances and skeletons of a volume that arrives slab by slab.

Every slab (one micro-batch of voxels) is labelled on its own; only its voxels on the first and last plane are kept to
meet its neighbours.  When the stream has ended, the planes give the seams, and the components come out as if the volume
had been there at once: the same roots and the same numbers.  Distances take the passes along x and y within a slab, and the one
along z when all planes are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.operators.components import labelled, numbered
from voxloom.operators.distance import axis_pass, depth
from voxloom.operators.filters import with_steps
from voxloom.params import TeasarParams
from voxloom.plans.fixpoint import components, reliable
from voxloom.plans.pipeline import traced_fields, united
from voxloom.schemas import VOXELS


class SlabComponents:
    """Collects slabs into tables under ``folder`` (shared by driver and executors), and joins them at the end."""

    def __init__(self, spark: SparkSession, volumes: DataFrame, folder: str) -> None:
        self.spark, self.volumes, self.folder = spark, volumes, folder

    def add(self, slab: DataFrame, batch: int) -> None:
        """Labels one slab; a batch that is run again replaces what it wrote before."""
        local = labelled(slab, self.volumes).withColumnRenamed("root", "local").withColumn("slab", F.lit(batch).cast("long"))
        local.write.mode("overwrite").parquet(f"{self.folder}/slab={batch}")

    def from_stream(self, path: str, files_per_batch: int = 1):
        """A query that reads files of voxels as they come, each as a slab; the caller waits for it and stops it."""
        stream = self.spark.readStream.schema(VOXELS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        run = lambda df, batch: None if df.isEmpty() else self.add(df, batch)
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{self.folder}-log").trigger(availableNow=True).start()

    def finish(self) -> DataFrame:
        """Voxels with ``root`` and ``cc``."""
        rows = self.spark.read.parquet(self.folder).select("volume_id", "vid", "x", "y", "z", "label", "local", F.col("slab").cast("long").alias("slab"))
        planes = rows.groupBy("volume_id", "slab").agg(F.min("z").alias("low"), F.max("z").alias("high"))
        walls = rows.join(planes, ["volume_id", "slab"]).where("z = low OR z = high").drop("low", "high")
        asked = with_steps(walls, self.volumes).where("nvid < vid")
        other = walls.select("volume_id", F.col("vid").alias("nvid"), F.col("label").alias("nlabel"), F.col("local").alias("nlocal"), F.col("slab").alias("nslab"))
        seams = asked.join(other, ["volume_id", "nvid"]).where("label = nlabel AND slab <> nslab").select("volume_id", "local", "nlocal").distinct()
        number = lambda c: F.struct("volume_id", F.col(c).alias("vid"))
        roots = components(seams.select(number("local").alias("a"), number("nlocal").alias("b")))
        found = roots.select("node.volume_id", F.col("node.vid").alias("local"), F.col("root.vid").alias("root"))
        joined = rows.join(found, ["volume_id", "local"], "left").withColumn("root", F.coalesce("root", "local"))
        return numbered(joined.select("volume_id", "vid", "x", "y", "z", "label", "root"))


class SlabDistances(SlabComponents):
    """Collects slabs with their distances in the planes; ``finish`` gives voxels with ``dbf``.  Components of one label
    never touch, so the distance to another label is that to another component."""

    def add(self, slab: DataFrame, batch: int) -> None:
        rows = slab.select("volume_id", "vid", "x", "y", "z", F.col("label").alias("cc"))
        for axis in (0, 1):
            rows = axis_pass(rows, self.volumes, axis)
        rows.write.mode("overwrite").parquet(f"{self.folder}/slab={batch}")

    def finish(self) -> DataFrame:
        rows = self.spark.read.parquet(self.folder).drop("slab")
        return axis_pass(rows, self.volumes, 2).select("volume_id", "vid", "x", "y", "z", F.col("cc").alias("label"), depth().alias("dbf"))


class SlabSkeletons:
    """Components and distances of slabs, traced when the stream has ended: the skeletons of the whole volume."""

    def __init__(self, spark: SparkSession, volumes: DataFrame, folder: str) -> None:
        self.volumes = volumes
        self.parts = SlabComponents(spark, volumes, f"{folder}/components"), SlabDistances(spark, volumes, f"{folder}/distances")

    def from_stream(self, path: str, files_per_batch: int = 1) -> list:
        return [part.from_stream(path, files_per_batch) for part in self.parts]

    def finish(self, teasar_params=None, dust_threshold: float = 1000, fix_branching: bool = True, fix_borders: bool = True) -> tuple[DataFrame, DataFrame]:
        """(vertices, edges), as ``pipeline.skeletonize`` gives them."""
        found, distances = (part.finish() for part in self.parts)
        found = reliable(found)
        measured = found.join(distances.select("volume_id", "vid", "dbf"), ["volume_id", "vid"])
        return united(traced_fields(found, measured, self.volumes, TeasarParams.of(teasar_params), dust_threshold, fix_branching, fix_borders))
