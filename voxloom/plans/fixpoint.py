"""Loops of DataFrame steps with cut lineage, and components of a graph."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from voxloom.kernels.grid import sequential_components
from voxloom.operators.grouped import TASK_ROWS

#: Edges that a task holds at once while it shortens chains before the joins.
HELD_EDGES = 1 << 17
#: The same where nodes are numbers.
HELD_NUMBERS = 1 << 20


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a session that runs in one process may do
    without, and gets a temporary folder."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="voxloom-")


@contextmanager
def tasks_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plans that run meanwhile shuffle into a task for every ``TASK_ROWS`` of ``rows``, and scan files as small: tasks
    aren't merged, since numbers compress so well that one would hold millions of rows.  Joins may still be split."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    own = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "4m"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def reliable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.  Cuts the lineage, and survives lost executors.  If it is known
    how many ``rows`` its shuffles get, tasks follow them."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_base(spark)}/voxloom-{uuid.uuid4().hex}"
    with tasks_of(spark, rows) if rows is not None else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], bool], rounds: int = 1000) -> DataFrame:
    """Applies ``step`` until ``changed(before, after)`` is false."""
    now = reliable(state)
    for _ in range(rounds):
        new = reliable(step(now))
        if not changed(now, new):
            return new
        now = new
    raise RuntimeError("the loop did not settle")


def settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b) are stars: no node has an edge to and one from it, or two to it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(0).alias("to")), F.struct(F.col("b").alias("n"), F.lit(1).alias("to")))).alias("e"))
    return ends.groupBy("e.n").agg(F.sum("e.to").alias("to"), F.min("e.to").alias("least")).where("to > 1 OR (to = 1 AND least = 0)").isEmpty()


def shortened(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: each task replaces every ``HELD_EDGES`` of its edges by stars around the least
    nodes that these edges alone connect."""
    arrow = to_arrow_schema(edges.select("a", "b").schema)
    names = [f.name for f in kind.fields] if isinstance(kind := edges.schema["a"].dataType, StructType) else None
    plain = lambda n: tuple(n.values()) if names else n
    shown = lambda n: dict(zip(names, n)) if names else n

    def stars(pairs: list[tuple]) -> pa.RecordBatch:
        parent: dict = {}

        def find(n):
            while (up := parent.setdefault(n, n)) != n:
                parent[n] = n = parent[up]
            return n

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        linked = [(root, n) for n in parent if (root := find(n)) != n]
        return pa.RecordBatch.from_arrays([pa.array([shown(x[i]) for x in linked], arrow[i].type) for i in (0, 1)], schema=arrow)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append((plain(row["a"]), plain(row["b"])))
                if len(held) >= HELD_EDGES:
                    yield stars(held)
                    held = []
        yield stars(held)

    return edges.select("a", "b").mapInArrow(run, edges.select("a", "b").schema)


def starred(edges: DataFrame) -> DataFrame:
    """(a, b, top, chunk) for edges (a, b) of numbers: each task replaces every ``HELD_NUMBERS`` of its edges, a chunk, by
    stars around the least nodes that these edges alone connect; the least nodes are rows of their own (a = b).  ``top`` is
    the star's greatest node."""
    arrow = pa.schema([(c, pa.int64()) for c in ("a", "b", "top", "chunk")])

    def stars(held: list[pa.RecordBatch], chunk: int):
        a, b = (np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = sequential_components(len(nodes), place[: len(a)], place[len(a) :])
        top = np.zeros(len(nodes), np.int64)
        np.maximum.at(top, root, np.arange(len(nodes)))
        for some in np.array_split(np.arange(len(nodes)), len(nodes) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes[root[some]], nodes[some], nodes[top[root[some]]], np.full(len(some), chunk))], schema=arrow)

    def run(batches):
        held, rows, chunk = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD_NUMBERS:
                yield from stars(held, chunk)
                held, rows, chunk = [], 0, chunk + 1
        if rows:
            yield from stars(held, chunk)

    return edges.select("a", "b").mapInArrow(run, "a long, b long, top long, chunk long")


def alone(chunks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(chunk, first, last): the longest run of numbers that lies within this chunk's (chunk, low, high) and no other's."""
    ends = sorted([(low, True, c) for c, low, _ in chunks] + [(high + 1, False, c) for c, _, high in chunks])
    best, open_now = {}, set()
    for (at, opens, c), (until, _, _) in zip(ends, ends[1:]):
        (open_now.add if opens else open_now.remove)(c)
        if len(open_now) == 1 and until > at:
            (only,) = open_now
            best[only] = max(best.get(only, (0, 0, 0)), (until - at, at, until - 1))
    return [(c, first, last) for c, (_, first, last) in best.items()]


def packing(edges: DataFrame, names: list[str]) -> tuple[int, list[tuple[str, int, int]] | None]:
    """How many rows ``edges`` has, and (field, least value, range) of every field of its nodes, structs of integers, if
    their values fit together into one number that keeps the order."""
    ends = [F.min(F.least(f"a.{n}", f"b.{n}")).alias(f"lo_{n}") for n in names] + [F.max(F.greatest(f"a.{n}", f"b.{n}")).alias(f"hi_{n}") for n in names]
    found = edges.agg(F.count("*").alias("rows"), *ends, F.count_if(F.expr(" OR ".join(f"{e}.{n} IS NULL" for e in "ab" for n in names))).alias("nulls")).first()
    if not found["rows"] or found["nulls"]:
        return found["rows"], None
    fields = [(n, found[f"lo_{n}"], found[f"hi_{n}"] - found[f"lo_{n}"] + 1) for n in names]
    return found["rows"], fields if math.prod(size for _, _, size in fields) < 1 << 63 else None


def packed(node: str, fields: list[tuple[str, int, int]]) -> Column:
    """A struct as one number, in the same order."""
    out = F.lit(0).cast("long")
    for name, low, size in fields:
        out = out * F.lit(size) + (F.col(f"{node}.{name}") - F.lit(low))
    return out


def unpacked(node: str, fields: list[tuple[str, int, int]]) -> Column:
    out, rest = [], F.col(node)
    for name, low, size in reversed(fields):
        out.insert(0, (F.pmod(rest, F.lit(size)) + F.lit(low)).cast("long").alias(name))
        rest = F.call_function("div", rest, F.lit(size))
    return F.struct(*out)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the component's least node.

    Alternates two contractions (large star, small star), so rounds grow with the logarithm of the longest chain.  Nodes
    that are structs of integers become single numbers where their ranges allow it: those are hashed instead of sorted.
    Edges are dealt by ranges first, so that what lies close together is contracted within a task; what is complete there
    takes no part in the rounds.
    The least neighbours are a table of their own, so that the join with them may be split where a node has very many
    edges."""
    kind = edges.schema["a"].dataType
    names = [f.name for f in kind.fields] if isinstance(kind, StructType) and all(isinstance(f.dataType, LongType) for f in kind.fields) else []
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not names and not isinstance(kind, LongType):
        return _contracted(reliable(shortened(pairs.distinct())), rounds)
    raw = reliable(pairs)
    rows, fields = packing(raw, names) if names else (raw.count(), None)
    if names and not fields:
        return _contracted(reliable(shortened(raw.distinct()), rows), rounds)
    if fields:
        raw = raw.select(packed("a", fields).alias("a"), packed("b", fields).alias("b"))
    tasks = max(raw.sparkSession.sparkContext.defaultParallelism, -(-rows // HELD_NUMBERS))
    stars = reliable(starred(raw.repartitionByRange(tasks, "a", "b").sortWithinPartitions("a", "b")))
    roots = _closed_apart(stars, rounds)
    return roots.select(unpacked("node", fields).alias("node"), unpacked("root", fields).alias("root")) if fields else roots


def _closed_apart(stars: DataFrame, rounds: int) -> DataFrame:
    """(node, root) from ``starred``: a star between numbers that no other chunk reaches is a whole component.  Only the
    others are contracted."""
    chunks = [tuple(r) for r in stars.groupBy("chunk").agg(F.min("a"), F.max("top")).collect()]  # a row for HELD_NUMBERS edges
    marked = stars.withColumn("closed", F.lit(False))
    if own := alone(chunks):
        reach = stars.sparkSession.createDataFrame(own, "chunk long, first long, last long")
        marked = stars.join(F.broadcast(reach), "chunk", "left").withColumn("closed", F.coalesce(F.expr("a >= first AND top <= last"), F.lit(False)))
    closed = marked.where("closed")
    if not own or closed.isEmpty():
        return _contracted(stars.where("a <> b").select("a", "b"), rounds)
    rest = _contracted(reliable(marked.where("NOT closed AND a <> b").select("a", "b")), rounds)
    return closed.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(rest)


def _contracted(now: DataFrame, rounds: int) -> DataFrame:
    for _ in range(rounds):
        rows = 2 * now.count()
        with tasks_of(now.sparkSession, rows):
            done = settled(now)
        if done:
            roots = reliable(now.select("a").distinct(), rows)
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = reliable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), rows)
        large = reliable(both.join(least, "a").where("b > a AND m <> b").select(F.col("m").alias("a"), "b").distinct(), rows)
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        now = reliable(large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct(), rows)
    raise RuntimeError("components did not settle")


def distances(edges: DataFrame, sources: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(node, dist) of every node that a path of the edges (a, b, w) reaches from the sources (node): each round relaxes
    the edges of nodes that came nearer."""
    dist = reliable(sources.select("node", F.lit(0.0).alias("dist"), F.lit(True).alias("new")))
    for _ in range(rounds):
        offers = dist.where("new").join(edges, F.col("node") == F.col("a")).groupBy("b").agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        merged = dist.join(offers, dist.node == offers.b, "full").select(F.coalesce("node", "b").alias("node"), F.least("dist", "offer").alias("dist"), F.coalesce(F.col("offer") < F.col("dist"), F.col("dist").isNull()).alias("new"))
        dist = reliable(merged)
        if dist.where("new").isEmpty():
            return dist.select("node", "dist")
    raise RuntimeError("distances did not settle")
