"""The engine on Spark: equal results by every route, and the catalogue against DuckDB."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from voxloom.kernels.volume import skeletonize_volume
from voxloom.operators import analysis, components as cc, distance, filters, joins, morphology, postprocess as post
from voxloom.params import DEFAULT_TEASAR_PARAMS, TeasarParams
from voxloom.plans import catalogue, fixpoint, pipeline
from voxloom.plans.fixpoint import components, distances, iterate
from voxloom.schemas import TARGETS, VOLUMES
from voxloom.sources import volumes as src
from voxloom.streaming.slabs import SlabComponents
from tests.test_kernels import speckles, three_boxes

TRACE = {**DEFAULT_TEASAR_PARAMS, "const": 2}
DATA = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def vertex_set(v):
    return sorted((r.label, r.x, r.y, r.z, r.radius) for r in v.collect())


@pytest.fixture(scope="module")
def boxes(spark):
    volumes, voxels = src.volume(spark, three_boxes())
    return volumes.cache(), voxels.cache()


@pytest.fixture(scope="module")
def traced(spark, boxes):
    volumes, voxels = boxes
    v, e = pipeline.skeletonize(voxels, volumes, TRACE, dust_threshold=0)
    return v.cache(), e.cache()


def test_spark_and_kernel_trace_alike(traced):
    want = sorted((label, *map(float, p), float(r)) for label, s in skeletonize_volume(three_boxes(), TeasarParams.of(TRACE), dust_threshold=0) for p, r in zip(s.vertices, s.radii))
    assert vertex_set(traced[0]) == want and traced[1].count() == len(want) - 3


def test_order_and_partitions_do_not_matter(spark, boxes, traced):
    volumes, voxels = boxes
    shuffled = voxels.orderBy(F.xxhash64("vid")).repartition(5)
    assert vertex_set(pipeline.skeletonize(shuffled, volumes, TRACE, dust_threshold=0)[0]) == vertex_set(traced[0])


def test_whole_volume_route_is_the_same(boxes, traced):
    volumes, voxels = boxes
    assert vertex_set(pipeline.skeletonize(voxels, volumes, TRACE, dust_threshold=0, fill_holes=True)[0]) == vertex_set(traced[0])


def test_ids_dust_and_targets(spark, boxes):
    volumes, voxels = boxes
    assert {r.label for r in pipeline.skeletonize(voxels, volumes, TRACE, dust_threshold=100, object_ids=[3, 7])[0].collect()} == {7}
    assert pipeline.skeletonize(voxels, volumes, TRACE, dust_threshold=24 * 20 * 16)[0].isEmpty()
    targets = spark.createDataFrame([(0, "before", 0, 15, 6, 5), (0, "after", 0, -3, 6, 5)], TARGETS)
    v, e = pipeline.skeletonize(voxels, volumes, TRACE, dust_threshold=0, targets=targets)
    assert {(7, 15.0, 6.0, 5.0)} <= {(r.label, r.x, r.y, r.z) for r in v.collect()}
    assert {r.loops for r in post.loop_counts(v, e).collect()} == {0}
    with pytest.raises(ValueError, match="columns"):
        pipeline.skeletonize(voxels, volumes, TRACE, targets=targets.drop("ord"))


def test_batch_is_each_alone(spark, boxes, traced):
    other = src.volume(spark, np.pad(np.ones((9, 4, 4), np.uint8), 2))
    v, _ = pipeline.skeletonize_batch([boxes, other], TRACE, dust_threshold=0)
    assert vertex_set(v.where("volume_id = 0")) == vertex_set(traced[0])
    assert vertex_set(v.where("volume_id = 1")) == vertex_set(pipeline.skeletonize(other[1], other[0], TRACE, dust_threshold=0)[0])


def test_chunks_join_to_one_piece(boxes):
    volumes, voxels = boxes
    v, e = pipeline.skeletonize_chunked(voxels, volumes, (12, 20, 16), TRACE)
    assert {r.label for r in v.collect()} == {3, 7, 9}
    parts = cc.skeleton_components(e).groupBy("label").agg(F.count_distinct("part").alias("n"))
    assert {r.n for r in parts.collect()} == {1}
    cleaned = pipeline.skeletonize_chunked(voxels, volumes, (12, 20, 16), TRACE, dust=3, tick=2)
    assert {r.loops for r in post.loop_counts(*cleaned).collect()} == {0}


def test_blocks_do_not_matter_for_components(spark):
    volumes, voxels = src.volume(spark, speckles())
    whole = rows(cc.connected_components(voxels, volumes), "vid", "cc")
    assert rows(cc.connected_components(voxels, volumes, block=5), "vid", "cc") == whole


def test_slabs_give_the_same_components(spark, tmp_path):
    volumes, voxels = src.volume(spark, speckles())
    for k, low in enumerate(range(0, 16, 5)):
        voxels.where(f"z >= {low} AND z < {low + 5}").coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    collected = SlabComponents(spark, volumes, str(tmp_path / "slabs"))
    q = collected.from_stream(str(tmp_path / "in/*"))
    q.awaitTermination(120)
    assert q.exception() is None
    q.stop()
    assert rows(collected.finish(), "vid", "cc") == rows(cc.connected_components(voxels, volumes), "vid", "cc")


def test_sources(spark):
    with pytest.raises(ValueError, match="axes"):
        src.as_volume(np.zeros((2, 2, 2, 2)))
    with pytest.raises(ZeroDivisionError):
        src.as_volume(np.array([1.25, 1.5]))
    assert src.as_volume(np.array([True, False])).shape == (2, 1, 1) and src.as_volume(np.array([np.nan, np.inf])).ravel().tolist() == [-(1 << 63), (1 << 63) - 1]
    assert src.chunk_side((100, 300, 5000), 4, 24 << 30)[:2] == (100, 300)
    assert src.iter_chunks(spark, (5, 5, 5), (5, 5, 5)).count() == 1
    assert src.budget_bytes("2") == 2 << 20
    for bad in ("0", "nan", "-3", "inf", "x"):
        with pytest.raises(ValueError):
            src.budget_bytes(bad)
    fortran = np.asfortranarray(three_boxes())
    assert rows(src.volume(spark, fortran)[1], "vid", "label") == rows(src.volume(spark, three_boxes())[1], "vid", "label")


def test_ids_are_checked():
    assert filters.checked_ids([3, 1, 3]) == [1, 3]
    with pytest.raises(OverflowError):
        filters.checked_ids([300], 0, 255)


def test_targets_outside_are_errors(spark, boxes):
    t = spark.createDataFrame([(0, "before", 0, 99, 0, 0)], TARGETS)
    with pytest.raises(Exception, match="outside"):
        joins.assign_targets(t, boxes[1], boxes[0]).collect()


def test_nearest_points(spark):
    volumes, voxels = src.volume(spark, np.array([1, 1, 0, 0, 0, 0, 2, 2]).reshape(8, 1, 1))
    q = spark.createDataFrame([(0, 1, 0.5, 0.0, 0.0, 3), (1, 3, 0.5, 0.0, 0.0, 1), (2, 2, 9.0, 5.0, 5.0, 1)], "qid long, label long, cx double, cy double, cz double, tag long")
    assert rows(joins.nearest_label_voxels(q, voxels), "qid", "x", "y", "z") == [(0, 0, 0, 0), (1, -1, -1, -1), (2, 7, 0, 0)]
    assert rows(joins.synapse_targets(q, voxels), "x", "y", "z", "tag") == [(0, 0, 0, 3), (7, 0, 0, 1)]


def test_graph_distances(spark):
    volumes, voxels = src.volume(spark, np.array([1, 1, 0, 2, 2]).reshape(5, 1, 1))
    cells = spark.createDataFrame([(0, i, i, 0, 0, lab, 0, 1.0, 1.0, 1.0) for i, lab in enumerate([1, 1, 0, 2, 2])], "volume_id long, vid long, x long, y long, z long, label long, graph_bits long, ax double, ay double, az double")
    assert rows(distance.graph_dbf(cells), "vid", "dbf") == [(0, 0.5), (1, 0.5), (2, 0.0), (3, 0.5), (4, 0.5)]


def test_sections_and_parcels(spark):
    volumes, voxels = src.volume(spark, np.full((13, 15, 17), 7))
    line = spark.createDataFrame([(0, 7, i, float(i), 7.0, 8.0, 1.0) for i in range(13)] + [(0, 8, 0, 0.0, 0.0, 0.0, 1.0), (0, 8, 1, 1.0, 0.0, 0.0, 1.0)], "volume_id long, label long, vidx long, x float, y float, z float, radius float")
    edges = src.polyline_edges(line)
    got = analysis.cross_sectional_area(voxels, volumes, line, edges).collect()
    assert {r.area for r in got if r.label == 7} == {255.0} and {r.area for r in got if r.label == 8} == {-1.0}
    assert analysis.section_planes(voxels, volumes, line.where("label = 7"), edges.where("label = 7")).count() == 13 * 15 * 17
    features, segments = analysis.oversegment(voxels, line.where("label = 7"), edges.where("label = 7"), (1.0, 1.0, 1.0))
    assert features.agg(F.max("feature")).first()[0] == 13 and segments.where("segment IS NULL").isEmpty()


def test_repair_and_somata(spark):
    v = np.zeros((15, 15, 15), int)
    v[1:14, 1:14, 1:14], v[4:11, 4:11, 4:11] = 1, 2
    volumes, voxels = src.volume(spark, v)
    found = distance.with_dbf(cc.connected_components(voxels, volumes), volumes)
    fixed = morphology.repaired(found, volumes, 5)
    assert rows(fixed.groupBy("cc").count(), "cc", "count") == [(1, 13**3)]
    flags = rows(morphology.soma_flags(found, volumes, 1.5, 3, 2, 1), "cc", "soma", "radius")
    assert flags == [(1, True, 15.0), (2, True, 9.0)]
    assert morphology.filled_masks(found).where("added").count() == 7**3


def test_fixpoints(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    want = sorted([(i, 0) for i in range(41)] + [(100, 100), (101, 100)])
    assert rows(components(chain), "node", "root") == want
    assert components(chain.where("a < 0")).isEmpty()
    pairs = chain.selectExpr("struct(0 AS v, a AS n) AS a", "struct(0 AS v, b AS n) AS b")
    assert {r.root.n for r in components(pairs).collect()} == {0, 100}
    monkeypatch.setattr(fixpoint, "HELD_EDGES", 3)  # most of the work is left to the joins
    assert rows(components(chain.repartition(5)), "node", "root") == want
    weighted = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0)], "a long, b long, w double")
    assert rows(distances(weighted, spark.createDataFrame([(0,)], "node long")), "node", "dist") == [(0, 0.0), (1, 2.0), (2, 1.0)]
    halved = iterate(spark.createDataFrame([(64,)], "n long"), lambda d: d.selectExpr("n div 2 AS n"), lambda a, b: a.first() != b.first())
    assert halved.first().n == 0


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS FROM '{DATA}/{name}.parquet'")
    return con


def written(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    theirs = sorted(tuple(map(written, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert sorted(tuple(map(written, r)) for r in df.select(*columns).collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_have_rows(spark, name):
    assert not catalogue.queries()[name](spark, DATA).isEmpty()


def test_join_close_components_takes_every_label(spark, monkeypatch):
    joined, taken = catalogue.post.join_close_components, []
    monkeypatch.setattr(catalogue.post, "join_close_components", lambda v, e: taken.append((v, e)) or joined(v, e))
    catalogue.join_close_components(spark, DATA)
    labels = lambda df: {r.label for r in df.select("label").distinct().collect()}
    v, e = catalogue.polylines(spark, DATA)
    assert labels(taken[0][0]) == labels(v) and labels(taken[0][1]) == labels(e) and max(labels(v)) > 5


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """In a copy without the subpackage, with and without the pipeline that imports it."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; import sys; q = e.queries(); s = e.oracle_sql(); sys.exit(not (len(q) > 90 and set(s) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1') for n in q)))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for name in (None, "corpus_pipeline.py"):
        if name and (tmp_path / "copy" / name).exists():
            (tmp_path / "copy" / name).unlink()
        assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True).returncode == 0


def test_a_volume_needs_its_size(spark):
    assert spark.createDataFrame([(0, 1, 1, 1, 1.0, 1.0, 1.0)], VOLUMES).count() == 1
