"""What keeps tasks small on larger tables: numbers instead of structs, rows instead of nested lists, tasks that follow the input."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from voxloom.kernels import graph as g
from voxloom.operators import postprocess as post
from voxloom.plans import catalogue, fixpoint
from voxloom.plans.fixpoint import components

DATA = "/root/testdata/sf0.001"


def test_nodes_become_numbers(spark, monkeypatch):
    """Structs of integers are contracted as single numbers, unless their ranges are too wide for one."""
    monkeypatch.setattr(fixpoint, "HELD_NUMBERS", 4)  # most of the work is left to the joins
    seen, contracted = [], fixpoint._contracted
    monkeypatch.setattr(fixpoint, "_contracted", lambda now, rounds: seen.append(dict(now.dtypes)["a"]) or contracted(now, rounds))
    chain = spark.range(-20, 20).select((F.col("id") % 3).alias("v"), (F.col("id") * 7 % 41).alias("p"), ((F.col("id") + 3) * 7 % 41).alias("q"))
    want = {}
    for v in (-2, -1, 0, 1, 2):
        near = [(r.p, r.q) for r in chain.where(F.col("v") == v).collect()]
        root = {n: n for e in near for n in e}
        for _ in near:
            for a, b in near:
                root[a] = root[b] = min(root[a], root[b])
        want |= {(v, n): r for n, r in root.items()}
    for wide in (1, 1 << 60):
        node = lambda c: F.struct((F.col("v") * wide).alias("v"), F.col(c).alias("n"))  # noqa: B023, E731
        found = components(chain.select(node("p").alias("a"), node("q").alias("b"))).collect()
        assert len(found) == len(want) and {(r.node.v // wide, r.node.n): r.root.n for r in found} == want
    assert seen[0] == "bigint" and seen[1].startswith("struct")


def test_one_skeleton_at_a_time(spark):
    """Kernels get rows of one skeleton after another, across batches, and no list of all its vertices is ever a value."""
    at = [F.col("id").cast("float").alias("x"), F.lit(0.0).cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"), F.lit(1.0).cast("float").alias("radius")]
    v = spark.range(300).select(F.lit(0).cast("long").alias("volume_id"), (F.col("id") % 30).alias("label"), (100 - F.col("id")).alias("vidx"), *at)
    e = v.where("vidx > -170").select("volume_id", "label", F.col("vidx").alias("e0"), (F.col("vidx") - 30).alias("e1"))
    lone = v.limit(1).withColumn("label", F.lit(99).cast("long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = post.each_skeleton(v.unionByName(lone), e, lambda names, s: {"vidx": [names[0]], "n": [len(names)], "cable": [g.cable_length(s)]}, "volume_id long, label long, vidx long, n long, cable double")
        got = {r.label: (r.vidx, r.n, r.cable) for r in found.collect()}
        assert "collect_list" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: (100 - k - 270, 10, 270.0) for k in range(30)} | {99: (100 - lone.first().x, 1, 0.0)}


def plan(name: str, spark) -> str:
    return catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_tasks_follow_the_input(spark):
    """No product of partitions, no ranking of all vertices in one task, one exchange for all windows over a path, and
    partitions of a fixed number before lineitem's rows are told apart."""
    assert "CartesianProduct" not in plan("spaces", spark)
    assert "dense_rank(label" not in plan("padded_export", spark)
    assert plan("path_moving_average", spark).count("Exchange hashpartitioning(label") == 1
    for name in ("vertex_degree", "blocks_of_one_label", "nearest_label_voxel"):
        assert "REPARTITION_BY_NUM" in plan(name, spark)


def test_contraction_follows_its_rows(spark, monkeypatch):
    """A round's tasks follow its rows and are not merged for being small in bytes; the session's settings stay."""
    monkeypatch.setattr(fixpoint, "TASK_ROWS", 10)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes")
    before, seen, keep = [spark.conf.get(n) for n in names], [], fixpoint.reliable
    monkeypatch.setattr(fixpoint, "reliable", lambda df, rows=None: seen.append((keep(df, rows), rows)) or seen[-1][0])
    monkeypatch.setattr(fixpoint, "HELD_NUMBERS", 4)
    found = components(spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r.root for r in found.collect()} == {0} and found.count() == 201
    dealt_out = [(len(df.inputFiles()), rows) for df, rows in seen if rows]
    assert len(dealt_out) > 3 and max(files for files, _ in dealt_out) > 8
    assert [spark.conf.get(n) for n in names] == before


def test_loops_are_counted_without_a_hot_key(spark):
    """Repeated, mirrored and empty edges count once or not at all; parts are told by their roots."""
    rows = [(0, 1, 1, 2), (0, 1, 2, 1), (0, 1, 2, 3), (0, 1, 3, 1), (0, 1, 3, 1), (0, 1, 9, 9), (0, 1, 5, 6), (0, 2, 1, 2), (1, 1, 7, 8)]
    e = spark.createDataFrame(rows, "volume_id long, label long, e0 long, e1 long")
    found = post.loop_counts(e.select("volume_id", "label", F.col("e0").alias("vidx")), e)
    assert {(r.volume_id, r.label): r.loops for r in found.collect()} == {(0, 1): 1, (0, 2): 0, (1, 1): 0}
    assert "count(distinct" not in found._jdf.queryExecution().toString().lower()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_components_are_ranked_in_ranges(spark, monkeypatch):
    """No task ranks all components of a volume, and the numbers are those of the SQL."""
    import duckdb

    from voxloom.operators import components as cc

    monkeypatch.setattr(cc, "TASK_ROWS", 5)
    ranges, keep = [], cc.reliable
    monkeypatch.setattr(cc, "reliable", lambda df: ranges.append(keep(df)) or ranges[-1] if "__range" in df.columns else keep(df))
    found = catalogue.queries()["component_stats"](spark, DATA)
    assert len(ranges) == 1 and ranges[0].select("__range").distinct().count() > 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{DATA}/lineitem.parquet'")
    want = con.execute(catalogue.oracle_sql()["component_stats"]).fetchall()
    named = found.select("cc", "label", "root", "voxels", "lo_x", "hi_x", "lo_y", "hi_y", "lo_z", "hi_z")
    assert sorted(map(tuple, named.collect())) == sorted(want) and len(want) > 5
    many = spark.range(1000).select((F.col("id") % 3).alias("volume_id"), (F.col("id") * 7919 % 10007).alias("root"))
    rows = sorted((r.volume_id, r.root, r.cc) for r in cc.ranked(many).collect())
    assert [r[2] for r in rows] == [*range(1, 335), *range(1, 334), *range(1, 334)]


@pytest.mark.parametrize("held", [1 << 19, 9])
def test_dust_goes_in_one_exchange(spark, monkeypatch, held):
    """Skeletons are cleaned whole, across batches, without a contraction; those above ``HELD_ROWS`` by joins, and the
    outcome is the same.  An edge to no vertex has no length, but connects; one from a vertex to itself is no part."""
    joined, keep = [], post.skeleton_components
    monkeypatch.setattr(post, "skeleton_components", lambda edges: joined.append({r.label for r in edges.select("label").distinct().collect()}) or keep(edges))
    monkeypatch.setattr(post, "HELD_ROWS", held)
    monkeypatch.setattr(post, "BATCH_ROWS", 3)
    names = {1: [10, 20, 30, 40, 50, 60], 2: [-5, 7, 9], 3: [1, 2], 4: [0]}
    v = [(0, k, n, float(n), 0.0, None if n == 60 else 0.0, 1.5, f"{k}/{n}") for k, some in names.items() for n in some]
    e = [(0, 1, 30, 20), (0, 1, 40, 30), (0, 1, 30, 20), (0, 1, 50, 60), (0, 1, 10, 10), (0, 2, -5, 8), (0, 2, 8, 9), (0, 2, 7, 9), (0, 3, 1, 2), (0, 5, 1, 99)]
    v = spark.createDataFrame(v, "volume_id long, label long, vidx long, x double, y double, z double, radius double, tag string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        kept, links = post.remove_dust(v, spark.createDataFrame(e, "volume_id long, label long, e0 long, e1 long"), 1.5)
        assert kept.columns == v.columns
        assert sorted((r.label, r.vidx, r.tag) for r in kept.collect()) == [(1, 0, "1/20"), (1, 1, "1/30"), (1, 2, "1/40"), (2, 0, "2/-5"), (2, 1, "2/7"), (2, 2, "2/9")]
        assert sorted((r.label, r.e0, r.e1) for r in links.collect()) == [(1, 1, 0), (1, 1, 0), (1, 2, 1), (2, 1, 2)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert joined == ([] if held > 9 else [{1}])


def test_complete_stars_take_no_part_in_rounds(spark, monkeypatch):
    """What a task completes is not contracted again, unless another task's numbers reach there; roots are those of a walk."""
    assert sorted(fixpoint.alone([(7, 0, 9), (8, 8, 20), (9, 12, 12)])) == [(7, 0, 7), (8, 13, 20)]
    assert fixpoint.alone([(1, 0, 5), (2, 0, 5)]) == [] and fixpoint.alone([]) == []
    monkeypatch.setattr(fixpoint, "HELD_NUMBERS", 64)
    seen, contracted = [], fixpoint._contracted
    monkeypatch.setattr(fixpoint, "_contracted", lambda now, rounds: seen.append(now.count()) or contracted(now, rounds))
    pairs = [(n, n + 1) for n in range(-500, 1500) if n % 10 != 9]
    far = [(3, 700), (703, 1201), (5, 5), (8, 7), (8, 7)]
    for edges, most in ((pairs, 0.2), (pairs + far, 0.9), (pairs + [(-490, 1490)], 1), ([(n, 5000 - n) for n in range(0, 2000, 3)], 1.1)):
        root = {n: n for e in edges if e[0] != e[1] for n in e}
        while any(root[a] != root[b] for a, b in edges):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        found = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(found) == len(root) and {r.node: r.root for r in found} == root
        assert seen.pop() <= most * len(edges)
