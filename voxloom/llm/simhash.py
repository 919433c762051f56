"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has 64 bits, the majority of its shingles' hashes.  To find all pairs of fingerprints within radius r,
2^(r+1) - 1 bit masks are made from one map m of bit positions to non-zero vectors of r+1 bits: mask v keeps position i
if <m(i), v> is odd (over GF(2)).  Any r differing positions are orthogonal to some non-zero v, so a pair within the radius collides under the mask
of that v, with certainty (covering LSH).

Plan: fingerprint all documents (one Arrow pass), collapse copies to distinct fingerprints with the least id, and deal
them under each mask to cells by their masked key, packed, so that a cell has about ``CELL_POINTS`` of them whatever the
table's size.  A kernel sorts a cell and walks the runs of equal keys; inside a run it links by pivots, splits what
they leave by further masked bits, and emits a spanning forest, never all pairs.  The forest's components are found by
alternating star contraction with written rounds, over nodes that carry their least id; only fingerprints that have
links take part.  Tables that meet keys of many rows (copies, hubs) are written first, so that Spark may split the join.

Where documents count as near at larger radii (``keep_first``), unrelated fingerprints of 64 bits would begin to meet
by chance; there each has 32 more bits, and a link also needs ``SIMILARITY`` of all 96 bits to agree.

Defined results: null or blank text has fingerprint zero, linked like any other; fewer words than a shingle: the whole
sequence; repeated rows share a fingerprint; a null id never becomes a component's id unless all its ids are null;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxloom.llm import bloom
from voxloom.llm.common import arrow_map, shared_dir, texts_as_bytes, written
from voxloom.plans.fixpoint import components as graph_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: For ``keep_first``: words of a shingle, radius in the first 64 bits, share of all bits that agree, and the further bits.
NEAR_SHINGLE, NEAR_RADIUS, SIMILARITY, MORE_BITS = 5, 8, 0.8, 32
#: Fingerprints of a cell, and of a task's packed rows.
CELL_POINTS, PACKED_POINTS = 1 << 21, 1 << 16
POINT = np.dtype([("fp", "<u8"), ("more", "<u4")])


def mixed(h: np.ndarray) -> np.ndarray:
    """Other bits of the same hashes."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, "<u8")
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([hashed(joined, SEED)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


@lru_cache(maxsize=16)
def masks(radius: int = RADIUS, bits: int = 64, turn: int = 0) -> list[int]:
    """The covering family.  Positions get the powers of x modulo a polynomial of degree radius+1 over GF(2), which are
    non-zero; of all polynomials, one whose masks keep the most bits at least (the next best ones for further turns)."""
    size = radius + 1
    choose = np.array([[v >> k & 1 for k in range(size)] for v in range(1, 1 << size)], np.int64)
    ranked = []
    for low in range(1, 1 << size, 2):
        powers = [1]
        while len(powers) < bits:
            up = powers[-1] << 1
            powers.append(up ^ (low | 1 << size) if up >> size else up)
        kept = choose @ np.array([[x >> k & 1 for x in powers] for k in range(size)], np.int64) & 1
        ranked.append((-int(kept.sum(axis=1).min()), low, kept))
    kept = sorted(ranked, key=lambda r: r[:2])[turn][2]
    return [sum(1 << i for i in np.flatnonzero(row).tolist()) for row in kept]


def away(points: np.ndarray, p, radius: int, limit: int) -> np.ndarray:
    """Distances to ``p``, such that 1 is as far as a link reaches: the greater of the parts of the radius in the first 64
    bits and of the limit in all bits."""
    first = np.bitwise_count(points["fp"] ^ p["fp"]).astype(np.int64)
    return np.maximum(first / radius, (first + np.bitwise_count(points["more"] ^ p["more"])) / limit)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): the order of the keys, and where each run of equal ones begins in it, and the end."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])


def forest(points: np.ndarray, radius: int = RADIUS, limit: int = 96, pivots: int = 64, few: int = 512, depth: int = 0) -> list[tuple[int, int]]:
    """Links (indices) that connect all points with a chain of steps within reach: exact, without listing pairs.

    Each pivot links everything near it.  A point needs no pivot of its own if all that could be near it (by the
    triangle inequality from the pivot) is in its component already.  What remains after a few pivots is compared with
    all points, if it is little; else a further covering family splits the points, and only runs of several components
    are looked at.
    """
    n = len(points)
    parent = np.arange(n)
    links: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((i, j))

    done = np.zeros(n, bool)
    for _ in range(min(n, pivots)):
        open_ = np.flatnonzero(~done)
        if not len(open_):
            return links
        p = int(open_[0])
        far = away(points, points[p], radius, limit)
        near = far <= 1
        for i in np.flatnonzero(near).tolist():
            link(p, i)
        clear = float(far[~near].min()) if not near.all() else 1e9  # nothing between 1 and this distance
        done |= near & (far < clear - 1 - 1e-9)
        done[p] = True
    rest = np.flatnonzero(~done).tolist()
    if len(rest) <= few or depth >= 3:
        for p in rest:
            for i in np.flatnonzero(away(points, points[p], radius, limit) <= 1).tolist():
                link(p, i)
        return links
    for mask in masks(radius, turn=depth + 1):
        order, bounds = runs(points["fp"] & np.uint64(mask))
        roots = np.array([find(i) for i in range(n)])[order]
        several = np.minimum.reduceat(roots, bounds[:-1]) != np.maximum.reduceat(roots, bounds[:-1])
        for k in np.flatnonzero(several).tolist():
            own = order[bounds[k] : bounds[k + 1]]
            for i, j in forest(points[own], radius, limit, pivots, few, depth + 1):
                link(int(own[i]), int(own[j]))
    return links


def cell_links(points: np.ndarray, mask: int, radius: int, limit: int) -> np.ndarray:
    """Pairs of rows of ``points`` that link each run of equal masked keys."""
    if len(points) < 2:
        return np.empty((0, 2), np.int64)
    order, bounds = runs(points["fp"] & np.uint64(mask))
    sizes = np.diff(bounds)
    heads = bounds[:-1][sizes == 2]  # most runs of several have two: all these at once
    one, two = points[order[heads]], points[order[heads + 1]]
    first = np.bitwise_count(one["fp"] ^ two["fp"]).astype(np.int64)
    near = (first <= radius) & (first + np.bitwise_count(one["more"] ^ two["more"]) <= limit)
    found = [np.stack([order[heads[near]], order[heads[near] + 1]], axis=1)]
    for k in np.flatnonzero(sizes > 2).tolist():
        own = order[bounds[k] : bounds[k + 1]]
        if linked := forest(points[own], radius, limit):
            found.append(own[np.array(linked)])
    return np.concatenate(found)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, more) of every whole text and the ``keep`` columns (longs); fp and more hold unsigned bits in longs."""

    def kernel(batch):
        hashes = [shingle_hashes(t, shingle) for t in texts_as_bytes(batch.column(1))]
        fps = np.array([majority(h) for h in hashes], np.uint64)
        more = np.array([majority(mixed(h)) if keep else 0 for h in hashes], np.uint64) & np.uint64((1 << MORE_BITS) - 1)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64)), "more": pa.array(more.view(np.int64))} | {c: batch.column(2 + i) for i, c in enumerate(keep)}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    return arrow_map(rows, kernel, ", ".join(["doc_id long, fp long, more long", *[f"{c} long" for c in keep]]), "text")


def links(distinct: DataFrame, count: int, radius: int = RADIUS, limit: int = 96) -> DataFrame:
    """(a_fp, a_more, b_fp, b_more): links between ``count`` distinct fingerprints (fp, more) that span every chain of
    steps within the radius and the limit."""
    family = masks(radius)
    spread = max(1, -(-count // CELL_POINTS))  # cells of a mask

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> Iterator[pa.RecordBatch]:
            points = np.concatenate(held)
            for v, mask in enumerate(family):
                part = mixed(points["fp"] & np.uint64(mask)) % np.uint64(spread)
                order, bounds = runs(part)
                cells = part[order[bounds[:-1]]].astype(np.int64) * len(family) + v
                blobs = [points[order[a:b]].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(blobs, pa.binary())], ["cell", "points"])

        for batch in batches:
            points = np.empty(batch.num_rows, POINT)
            points["fp"], points["more"] = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1))
            held.append(points)
            if sum(map(len, held)) >= PACKED_POINTS:
                yield from packed()
                held = []
        if any(map(len, held)):
            yield from packed()

    def walk(table: pa.Table) -> pa.Table:
        points = np.concatenate([np.frombuffer(x.as_buffer(), POINT) for x in table["points"]])
        pairs = cell_links(points, family[table["cell"][0].as_py() % len(family)], radius, limit)
        ends = [points[pairs[:, k]] for k in (0, 1)]
        flip = (ends[0]["fp"] > ends[1]["fp"]) | ((ends[0]["fp"] == ends[1]["fp"]) & (ends[0]["more"] > ends[1]["more"]))
        low, high = np.where(flip, ends[1], ends[0]), np.where(flip, ends[0], ends[1])
        return pa.table({f"{n}_{c}": e[c].astype(np.uint64).view(np.int64) for n, e in (("a", low), ("b", high)) for c in ("fp", "more")})

    # as many tasks as there are full cells' worth of points, or shuffle partitions, if more
    tasks = max(-(-count * len(family) // CELL_POINTS), int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = distinct.select("fp", "more").mapInArrow(deal, "cell long, points binary").repartition(tasks, "cell")
    return cells.groupBy("cell").applyInArrow(walk, "a_fp long, a_more long, b_fp long, b_more long").distinct()


def rooted(prints: DataFrame, folder: str, radius: int = RADIUS, limit: int = 96) -> DataFrame:
    """``prints`` (doc_id, fp, more and others) with ``root``: the least (without an id, id, fp, more) that links reach."""
    distinct = written(prints.groupBy("fp", "more").agg(F.min("doc_id").alias("first")), "distinct", folder)
    found = written(links(distinct, distinct.count(), radius, limit), "links", folder)
    node = F.struct(F.col("first").isNull().alias("none"), "first", "fp", "more")
    end = lambda n: distinct.select(F.col("fp").alias(f"{n}_fp"), F.col("more").alias(f"{n}_more"), node.alias(n))
    edges = found.join(end("a"), ["a_fp", "a_more"]).join(end("b"), ["b_fp", "b_more"]).select("a", "b")
    roots = graph_components(edges).select(F.col("node.fp").alias("fp"), F.col("node.more").alias("more"), "root")
    own = distinct.withColumn("own", node).join(roots, ["fp", "more"], "left").select("fp", "more", F.coalesce("root", "own").alias("root"))
    # copies may be a third of all rows: their fingerprint's row is in a table of its own, so the join may be split
    return prints.join(written(own, "roots", folder), ["fp", "more"])


def components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the least id reachable by links within the radius."""
    folder = shared_dir(docs.sparkSession)
    prints = written(fingerprints(docs, shingle, (), id_col, text_col), "fingerprints", folder)
    return rooted(prints, folder, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("root.first").alias("component_id"))


def keep_first(docs: DataFrame, radius: int = NEAR_RADIUS, similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """``docs`` with one row of each component of near duplicates: of those with the least id (or of all, if none has
    one), one of the component's least fingerprint.  Links as above, over fingerprints of five-word shingles."""
    folder, names = shared_dir(docs.sparkSession), docs.columns
    # rows are told apart by two hashes of id and text; columns go by number, so that none clashes with names used here
    safe = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    id_col, text_col = (f"__c{names.index(c)}" for c in ("doc_id", "text"))
    keyed = safe.withColumns({"k1": F.xxhash64(id_col, text_col), "k2": F.hash(text_col, id_col).cast("long")})
    prints = written(fingerprints(keyed, shingle, ("k1", "k2"), id_col, text_col), "fingerprints", folder)
    marked = rooted(prints, folder, radius, int((64 + MORE_BITS) * (1 - similarity)))
    stays = F.col("doc_id").eqNullSafe(F.col("root.first")) & (F.col("fp") == F.col("root.fp")) & (F.col("more") == F.col("root.more"))
    rows = written(marked.select("k1", "k2", "root", stays.alias("stays")).groupBy("k1", "k2", "root", "stays").agg(F.count("*").alias("n")), "marked", folder)
    # of several texts that could stay, one; rows to drop, and rows that stand more than once, are special: all others
    # skip the join, and their texts the shuffle
    best = rows.where("stays").groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("best"), F.count("*").alias("texts"))
    several = best.where("texts > 1").select("best", F.col("root").alias("r"))  # only where ids are not unique
    chosen = rows.where("stays").join(several, F.col("root") == F.col("r"), "left").select("k1", "k2", "n", (F.col("best").isNull() | (F.col("best") == F.struct("k1", "k2"))).alias("__stays"))
    fates = chosen.union(rows.where("NOT stays").select("k1", "k2", "n", F.lit(False)))
    special = written(fates.where("n > 1 OR NOT __stays").select("k1", "k2", "__stays"), "fates", folder)
    tested = bloom.mark(keyed, F.col("k1"), bloom.build(special, F.col("k1"), special.count()))
    exact = tested.where("__hit").join(special, ["k1", "k2"], "left").where("coalesce(__stays, true)").dropDuplicates(["k1", "k2"]).select(*safe.columns)
    return tested.where("NOT __hit").select(*safe.columns).unionByName(exact).toDF(*names)
