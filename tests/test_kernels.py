"""Kernels against fixed expectations, brute force and invariants."""

from __future__ import annotations

import heapq

import numpy as np
import pytest

from voxloom.kernels import geodesic as geo, graph as g, grid, section, volume as vol
from voxloom.kernels.edt import edt, graph_edt, squared_edt
from voxloom.kernels.trace import Skeleton, consolidate, prepare, soma_centre, target_order, trace
from voxloom.params import DEFAULT_TEASAR_PARAMS, TeasarParams, check_anisotropy

f32 = np.float32
PARAMS = TeasarParams.of({**DEFAULT_TEASAR_PARAMS, "const": 2})


def speckles(side: int = 16) -> np.ndarray:
    x, y, z = np.indices((side,) * 3)
    return np.where((7919 * x + 104729 * y + 1299709 * z + 31 * x * y + 17 * y * z + 13 * x * z) % 97 < 14, 1 + (5 * x + 3 * y + 7 * z) % 2, 0)


def three_boxes() -> np.ndarray:
    v = np.zeros((24, 20, 16), np.uint8)
    v[2:22, 6:12, 5:11], v[4:8, 2:18, 12:15], v[10:14, 14:18, 2:4] = 7, 9, 3
    return v


def skeleton(points, edges, radii=1) -> Skeleton:
    return Skeleton(np.array(points, f32), np.array(edges, np.int64).reshape(-1, 2), np.broadcast_to(np.asarray(radii, f32), (len(points),)).copy())


def test_steps_are_all_and_opposite():
    assert len({tuple(o) for o in grid.OFFSETS.tolist()}) == 26 and (grid.OFFSETS[grid.OPPOSITE] == -grid.OFFSETS).all()
    assert sorted(grid.GRAPH_BITS) == list(range(26)) and sorted(grid.JOIN_RANK.tolist()) == list(range(26))


def test_small_line():
    labels = np.array([1, 1, 0, 0, 0, 0, 2, 2]).reshape(8, 1, 1)
    ids, roots = grid.label_components(labels)
    assert ids.ravel().tolist() == [1, 1, 0, 0, 0, 0, 2, 2] and roots.tolist() == [0, 6]
    assert edt(ids).ravel().tolist() == [2, 1, 0, 0, 0, 0, 1, 2]
    nothing = np.zeros(labels.shape, np.int64)
    ids, names, first = vol.graph_components(labels, nothing)
    assert ids.ravel().tolist() == [1, 2, 0, 0, 0, 0, 3, 4] and names == [1, 1, 2, 2] and first == [0, 1, 6, 7]
    assert graph_edt(labels, nothing).ravel().tolist() == [0.5, 0.5, 0, 0, 0, 0, 0.5, 0.5]


def test_components_by_flood():
    v = speckles()
    ids, roots = grid.label_components(v)
    seen = np.zeros(v.shape, int)
    order = [tuple(p) for p in grid.unravel(np.arange(v.size), v.shape).tolist()]
    count = 0
    for p in order:
        if v[p] and not seen[p]:
            count += 1
            stack = [p]
            seen[p] = count
            while stack:
                q = stack.pop()
                for o in grid.OFFSETS.tolist():
                    n = tuple(a + b for a, b in zip(q, o))
                    if all(0 <= a < s for a, s in zip(n, v.shape)) and v[n] == v[p] and not seen[n]:
                        seen[n] = count
                        stack.append(n)
    assert (ids == seen).all() and len(roots) == count


@pytest.mark.parametrize("border", [False, True])
@pytest.mark.parametrize("spacing", [(1, 1, 1), (2, 3, 5)])
def test_edt_by_brute_force(border, spacing):
    ids, _ = grid.label_components(speckles(9))
    got = squared_edt(ids, spacing, border)
    wide = np.pad(ids, 1, constant_values=0) if border else ids
    shift = 1 if border else 0
    cells = np.argwhere(np.ones(wide.shape))
    values = wide[tuple(cells.T)]
    w = np.array(spacing, float)
    for p in np.argwhere(ids):
        other = cells[values != ids[tuple(p)]]
        assert np.isclose(got[tuple(p)], (((other - (p + shift)) * w) ** 2).sum(axis=1).min(), rtol=1e-6)


def test_open_border_of_one_label_is_infinite():
    assert np.isinf(squared_edt(np.ones((3, 3, 3), int))).all()
    assert edt(np.ones((3, 3, 3), int), black_border=True)[1, 1, 1] == 2


def test_traced_boxes():
    found = dict(vol.skeletonize_volume(three_boxes(), PARAMS, dust_threshold=0))
    want = {
        3: ([(10, 14, 2), (11, 15, 3), (12, 16, 3), (13, 17, 3)], [1] * 4),
        7: ([(2, 6, 5), (3, 7, 6), (4, 8, 7), *[(x, 9, 8) for x in range(5, 20)], (20, 10, 9), (21, 11, 10)], [1, 2, *[3] * 16, 2, 1]),
        9: ([(4, 2, 12), (5, 3, 13), *[(6, y, 13) for y in range(4, 17)], (7, 17, 14)], [1, *[2] * 14, 1]),
    }
    assert list(found) == [3, 7, 9]
    for label, (points, radii) in want.items():
        s = found[label]
        assert [tuple(p) for p in s.vertices.tolist()] == points and s.radii.tolist() == radii
        assert s.edges.tolist() == [[i, i + 1] for i in range(len(points) - 1)]


def test_traced_boxes_with_graph():
    v = three_boxes()
    bits = np.zeros(v.shape, np.int64)
    at = np.argwhere(v)
    for k, o in enumerate(grid.OFFSETS):
        n = at + o
        ok = ((n >= 0) & (n < v.shape)).all(axis=1)
        same = np.zeros(len(at), bool)
        same[ok] = v[tuple(n[ok].T)] == v[tuple(at[ok].T)]
        bits[tuple(at[same].T)] |= 1 << grid.GRAPH_BITS[k]
    found = vol.skeletonize_volume(v, PARAMS, dust_threshold=0, graph=bits)
    assert [label for label, _ in found] == [3, 7, 9]
    assert {float(r) for _, s in found for r in s.radii} <= {0.5, 1.5, 2.5}


def test_soma_is_one_tree():
    x = np.indices((72, 72, 72)) - 36
    ball = (x**2).sum(axis=0) <= 144
    for a in range(3):
        b, c = (i for i in range(3) if i != a)
        ball |= (abs(x[b]) <= 2) & (abs(x[c]) <= 2) & (abs(x[a]) <= 34)
    params = TeasarParams.of({"scale": 1.5, "const": 3, "pdrf_scale": 100000, "pdrf_exponent": 4, "soma_detection_threshold": 8, "soma_acceptance_threshold": 10, "soma_invalidation_scale": 1.0, "soma_invalidation_const": 2})
    ((_, s),) = vol.skeletonize_volume(ball.astype(np.uint8), params, dust_threshold=0)
    assert len(s.edges) == len(s.vertices) - 1 and len(g.components(s)) == 1
    assert [36, 36, 36] in s.vertices.tolist() and (abs(s.vertices - 36) > 30).any(axis=1).sum() >= 6


@pytest.mark.parametrize("branching", [True, False])
def test_invariants_of_tracing(branching):
    v = speckles(12) * 0
    rng = np.random.default_rng(5)
    for label in (1, 2, 3):
        p = rng.integers(3, 17, 3)
        for _ in range(60):
            p = np.clip(p + rng.integers(-1, 2, 3), 2, 17)
            v.resize((20, 20, 20), refcheck=False)
            v[tuple(slice(a - 1, a + 2) for a in p)] = label
    ids, roots = grid.label_components(v)
    dbf = edt(ids)
    names = v.ravel(order="F")[roots]
    found = vol.skeletonize_volume(v, PARAMS, dust_threshold=10, fix_branching=branching)
    assert found
    for label, s in found:
        at = tuple(s.vertices.astype(int).T)
        assert (v[at] == label).all() and np.allclose(s.radii, dbf[at])
        assert (abs(s.vertices[s.edges[:, 0]] - s.vertices[s.edges[:, 1]]).max(axis=1) == 1).all()
    assert {label for label, _ in found} <= set(names.tolist())


def test_every_voxel_is_invalidated():
    v = three_boxes() == 7
    where = np.argwhere(v)
    ready = prepare(where, edt(v.astype(int))[v], PARAMS, (1, 1, 1))
    alive = np.ones(len(where), bool)
    for path in trace(ready, PARAMS, (1, 1, 1)):
        geo.invalidate(ready.voxels, alive, ready.dbf, path, PARAMS.scale, PARAMS.const, (1, 1, 1))
    assert not alive.any()


def test_railroads():
    cells = grid.Voxels.of(np.argwhere(np.ones((9, 9, 9))))
    cost = np.ones(729, f32)
    cost[cells.coords[:, 2] == 0] = 0
    path = geo.railroad(cells, cost, cells.find((4, 4, 4)))
    assert [tuple(p) for p in cells.coords[path].tolist()] == [(4, 4, 4), (3, 3, 3), (2, 2, 2), (1, 1, 1), (1, 1, 0)]
    assert geo.railroad(cells, cost, cells.find((3, 3, 0))) == [cells.find((3, 3, 0))]
    cost[(cells.coords[:, 2] == 2)] = np.inf
    assert geo.railroad(cells, cost, cells.find((4, 4, 4))) == []


def test_rails_are_joined_in_order():
    cells = grid.Voxels.of(np.argwhere(np.ones((5, 5, 5))))
    rank = grid.JOIN_RANK
    rng = np.random.default_rng(3)
    for _ in range(60):
        rails = rng.choice(26, rng.integers(1, 6), replace=False)
        cost = np.full(125, 1, f32)
        for k in rails:
            cost[cells.find(grid.OFFSETS[k] + 2)] = 0
        path = geo.railroad(cells, cost, cells.find((2, 2, 2)))
        assert path[1:] == [cells.find(grid.OFFSETS[min(rails, key=lambda k: rank[k])] + 2)]  # noqa: B023


def test_fields_by_plain_search():
    ids, _ = grid.label_components(speckles(14))
    counts = np.bincount(ids.ravel())
    where = np.argwhere(ids == counts[1:].argmax() + 1)
    cells = grid.Voxels.of(where)
    weights = grid.step_weights((4, 4, 40))
    dist = geo.edge_distances(cells, 0, (4, 4, 40))
    best, heap = {0: f32(0)}, [(0.0, 0)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for k, v in enumerate(cells.near[u].tolist()):
            if v >= 0 and (c := f32(f32(d) + weights[k])) < best.get(v, np.inf):
                best[v] = c
                heapq.heappush(heap, (float(c), v))
    assert dist.tolist() == [float(best[i]) for i in range(len(where))]
    cost = np.linspace(1, 2, len(where)).astype(f32)
    entry = geo.entry_distances(cells, cost, 0)
    parent = geo.parents(cells, entry, 0)
    for v in range(1, len(where)):
        assert entry[parent[v]] < entry[v] and geo.walk_back(parent, v, 0)[0] == 0


def test_freespace_is_the_open_walk():
    cells = grid.Voxels.of(np.argwhere(np.ones((7, 7, 7))))
    direct = geo.freespace(cells.coords - cells.coords[0], (1.0, 2.0, 3.0))
    assert np.allclose(direct, geo.edge_distances(cells, 0, (1.0, 2.0, 3.0)), rtol=1e-6)


def test_orders_and_centres():
    assert target_order(np.array([1, 5, np.inf, 5, 0], f32)).tolist() == [3, 1, 0, 4, 2]
    assert soma_centre(np.array([[0, 0, 0], [4, 0, 0], [2, 0, 0], [2, 1, 0]]), np.array([3, 3, 3, 1])) == 2
    assert geo.farthest(np.array([1, np.inf, 7, 7])) == 2


def test_consolidation():
    s, rows = consolidate(np.array([[1, 0, 0], [0, 0, 0], [1, 0, 0], [9, 9, 9]], f32), np.array([[0, 1], [1, 2], [0, 2]]), np.array([5, 6, 7, 8], f32))
    assert s.vertices.tolist() == [[0, 0, 0], [1, 0, 0]] and s.edges.tolist() == [[0, 1]] and s.radii.tolist() == [6, 5] and rows.tolist() == [1, 0]
    assert not len(consolidate(np.zeros((2, 3)), np.empty((0, 2)), np.zeros(2))[0].vertices)


def test_voids_and_holes():
    shell = np.zeros((15, 15, 15), int)
    shell[2:13, 2:13, 2:13] = 42
    shell[3:12, 3:12, 3:12] = 0
    shell[6:9, 6:9, 6:9] = 77
    solid = np.where(np.pad(np.ones((11, 11, 11), bool), 2), 42, 0)
    ids, roots = grid.label_components(shell)
    filled, added = vol.fill_all_holes(ids, len(roots))
    assert added == 9**3 and ((filled == 1) == (solid == 42)).all()
    assert grid.fill_voids(shell == 42)[1] == 9**3
    one, two = (vol.skeletonize_volume(x, PARAMS, dust_threshold=0, fill_holes=True) for x in (shell, solid))
    assert [label for label, _ in one] == [label for label, _ in two] == [42] and one[0][1].vertices.tolist() == two[0][1].vertices.tolist()


def test_nested_component_goes_to_its_surroundings():
    v = np.zeros((15, 15, 15), int)
    v[1:14, 1:14, 1:14], v[4:11, 4:11, 4:11] = 1, 2
    ids, _ = grid.label_components(v)
    fixed, _, rounds = vol.fix_avocados(ids, edt(ids), 5, (1, 1, 1))
    assert rounds >= 1 and len(np.unique(fixed)) == 2 and (fixed[v > 0] == fixed[1, 1, 1]).all()


def test_border_targets_match_across_a_cut():
    v = np.zeros((20, 9, 9), int)
    v[:, 3:6, 2:7] = 4
    whole = vol.border_targets(grid.label_components(v)[0], (1, 1, 1))
    left, right = (vol.border_targets(grid.label_components(p)[0], (1, 1, 1)) for p in (v[:11], v[10:]))
    assert whole == {1: [(0, 4, 5), (19, 4, 5)]}  # of three equal pixels, the one past the middle
    assert (10, 4, 5) in left[1] and (0, 4, 5) in right[1]


def test_targets_wrap_once():
    assert vol.wrapped([(-1, 0, 2)], (5, 5, 5)) == [(4, 0, 2)]
    with pytest.raises(ValueError, match="outside"):
        vol.wrapped([(-6, 0, 0)], (5, 5, 5))


def test_join_and_postprocess():
    s = skeleton([(0, 0, 0), (1, 0, 0), (5, 0, 0), (11, 0, 0)], [(0, 1), (2, 3)], 100)
    assert g.join_close([s]).edges.tolist() == [[0, 1], [1, 2], [2, 3]] == g.postprocess(s, 0, 0).edges.tolist()
    assert not len(g.postprocess(s, 1000, 0).vertices)
    s = skeleton([(0, 0, 0), (1, 0, 0), (10, 0, 0), (11, 0, 0), (1, 0, 0)], [(2, 3), (3, 4), (0, 1)], [1, 1, 2, 2, 5])
    joined = g.join_close([s])
    assert joined.edges.tolist() == [[0, 1], [1, 3], [2, 3]] and joined.radii.tolist() == [1, 5, 2, 2]
    apart = skeleton([(0, 0, 0), (1, 0, 0), (9, 0, 0), (10, 0, 0)], [(0, 1), (2, 3)])
    assert len(g.join_close([apart], radius=3).edges) == 2 and len(g.join_close([apart], restrict_by_radius=True).edges) == 2
    with pytest.raises(ValueError, match="above 0"):
        g.join_close([apart], radius=0)


def test_loops_open():
    ring = [(np.cos(t) * 9, np.sin(t) * 9, 0) for t in np.linspace(0, 2 * np.pi, 12, endpoint=False)]
    closed = [(i, (i + 1) % 12) for i in range(12)]
    tails = [(20, 0, 0), (-20, 0, 0), (0, 20, 0)]
    for n in range(4):
        s = skeleton([*ring, *tails[:n]], [*closed, *[(12 + i, at) for i, at in zip(range(n), (0, 6, 3))]])
        out = g.remove_loops(s)
        assert len(out.edges) == (0 if n == 0 else len(out.vertices) - len(g.components(out)))
    rng = np.random.default_rng(1)
    for _ in range(15):
        points = rng.random((14, 3)) * 30
        edges = {tuple(sorted(rng.choice(14, 2, replace=False).tolist())) for _ in range(22)}
        out = g.remove_loops(skeleton(points, sorted(edges), 5))
        assert len(out.edges) == len(out.vertices) - len(g.components(out))


def test_ticks_go_shortest_first():
    points = [(x, 0, 0) for x in range(11)] + [(5, 1, 0), (5, 2, 0), (8, 1, 0)]
    s = skeleton(points, [*[(i, i + 1) for i in range(10)], (5, 11), (11, 12), (8, 13)])
    assert len(g.remove_ticks(s, 0).vertices) == 14
    assert len(g.remove_ticks(s, 1.5).vertices) == 13 and len(g.remove_ticks(s, 2.5).vertices) == 11
    line = skeleton(points[:11], [(i, i + 1) for i in range(10)])
    assert len(g.remove_ticks(line, 1000).vertices) == 11


def test_paths_and_thinning():
    points = [(x, 0, 0) for x in range(9)] + [(4, y, 0) for y in range(1, 4)]
    s = skeleton(points, [*[(i, i + 1) for i in range(8)], (4, 9), (9, 10), (10, 11)])
    found = g.paths(s)
    assert sorted(len(p) for p in found) == [8, 9] and len({p[-1] for p in found}) == 1
    assert set(g.thinned(s, 3)) >= {0, 4, 8, 11}


def test_sections_of_a_block():
    line = skeleton([(x, 7, 8) for x in range(13)], [(x, x + 1) for x in range(12)])
    areas, contacts = section.section_areas(np.ones((13, 15, 17), bool), line, (1, 1, 1))
    assert (areas == 255).all() and contacts.tolist() == [61, *[60] * 11, 62]


def test_plane_areas_against_sampling():
    rng = np.random.default_rng(0)
    for n in [*rng.normal(size=(4, 3)), np.array([1, 1, 0]), np.array([0, -2, 1])]:
        n = n / np.linalg.norm(n)
        a = section.box_sections(np.array([[-0.5, -1, -2.0]]), np.array([[0.5, 1, 2.0]]), np.zeros(3), n)[0]
        u = np.cross(n, [0.3, -0.2, 0.9])
        u /= np.linalg.norm(u)
        q = (rng.random((200_000, 2)) - 0.5) * 8
        inside = (abs(q[:, :1] * u + q[:, 1:] * np.cross(n, u)) <= [0.5, 1, 2]).all(axis=1)
        assert abs(a - inside.mean() * 64) < 0.15


def test_point_to_point():
    cells = np.indices((7, 7, 7)) - 3
    s = section.connect_points((cells**2).sum(axis=0) <= 6, (1, 2, 2), (5, 4, 4), (1.1, 1.3, 1.7))
    path = [[5, 4, 4], [4, 3, 3], [3, 3, 3], [2, 3, 3], [1, 2, 2]]
    assert (s.vertices == np.multiply(path, f32([1.1, 1.3, 1.7]), dtype=f32)).all()
    assert s.radii.tolist() == f32([1.100000023841858, 2.200000047683716, 3.3000001907348633, 2.200000047683716, 1.100000023841858]).tolist()
    two = np.zeros((5, 5, 5), bool)
    two[0], two[4] = True, True
    with pytest.raises(ValueError, match="disconnected"):
        section.connect_points(two, (0, 0, 0), (4, 0, 0), (1, 1, 1))
    with pytest.raises(ValueError, match="outside"):
        section.connect_points(two, (0, 0, 0), (5, 0, 0), (1, 1, 1))


def test_sections_along_a_bent_path():
    labels = np.zeros((12, 10, 4), np.uint32)
    labels[1:11, 1:4], labels[1:11, 6:9], labels[8:11, 1:9] = 7, 7, 7
    s = section.connect_points(labels, (2, 2, 1), (2, 7, 2), (4, 4, 40))
    path = [[2, 7, 2], *[[x, 7, 1] for x in range(3, 9)], *[[9, y, 1] for y in (6, 5, 4, 3)], *[[x, 2, 1] for x in range(8, 1, -1)]]
    assert (s.vertices == np.multiply(path, f32([4, 4, 40]), dtype=f32)).all() and (s.radii == 8).all()
    s.vertices = np.array(path, f32)
    areas, contacts = section.section_areas(labels > 0, s, (4, 4, 40))
    assert (areas[[2, 3, 4, 5]] == 1920).all() and contacts.max() <= 63


def test_parcels():
    _, owner = section.parcels(np.argwhere(np.ones((5, 1, 1))), np.array([[0, 0, 0], [4, 0, 0]]), (1, 1, 1))
    assert owner.tolist() == [1, 1, 2, 2, 2]


def test_smoothing_matches_plain_means():
    rng = np.random.default_rng(2)
    path = rng.random((9, 3))
    mirrored = np.concatenate([path[::-1], path])
    want = np.array([mirrored[9 + i - 3 : 9 + i + 1].mean(axis=0) for i in range(9)])
    assert np.allclose(section.moving_average(path, 4), want)


def test_parameters():
    assert TeasarParams.of({"scale": 2}).const == 10 and TeasarParams.of(None).scale == 1.5
    with pytest.raises(ValueError, match="unknown"):
        TeasarParams.of({"scales": 1})
    with pytest.raises(ValueError, match="odd"):
        TeasarParams.of({"pdrf_exponent": 3})
    with pytest.raises(ValueError, match="above 0"):
        check_anisotropy((1, 0, 1))
