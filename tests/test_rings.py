"""Triangles around points: exact turns, cocircular neighbours, and many points at once against one at a time."""

import time
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from arborel.operators import mesh


def plain_ring(centre, around):
    """The hull of the images under inversion, one point at a time, in floats."""
    d = around - centre
    _, axes = np.linalg.eigh(d.T @ d)
    flat = d @ axes[:, 1:]
    q = flat / (flat**2).sum(axis=1)[:, None]
    order = np.lexsort((q[:, 1], q[:, 0]))

    def half(points):
        chain = []
        for p in points:
            while len(chain) > 1 and (q[chain[-1]][0] - q[chain[-2]][0]) * (q[p][1] - q[chain[-2]][1]) - (q[chain[-1]][1] - q[chain[-2]][1]) * (q[p][0] - q[chain[-2]][0]) <= 0:
                chain.pop()
            chain.append(int(p))
        return chain

    hull = half(order)[:-1] + half(order[::-1])[:-1]
    return {(a, b) for a, b in zip(hull, hull[1:] + hull[:1]) if q[a][0] * q[b][1] - q[a][1] * q[b][0] > 0}


def loose(pairs):
    return {frozenset(p) for p in pairs}


near_one = st.one_of(st.integers(-3, 3).map(float), st.floats(-4, 4), st.sampled_from([0.1, 0.2, 0.3, 1e-200, 0.1 + 2**-55, 1 / 3, 1e-17]))


@settings(max_examples=400, deadline=None)
@given(st.lists(near_one, min_size=6, max_size=6))
def test_turns_are_exact(v):
    a, b, c = np.array(v).reshape(3, 1, 2)
    ax, ay, bx, by, cx, cy = map(Fraction, v)
    want = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    assert mesh.turns(a, b, c)[0] == (want > 0) - (want < 0)


def test_turns_on_nearly_straight_lines():
    rng = np.random.default_rng(1)
    a, s = rng.random((3000, 2)), rng.random((3000, 1))
    b = a + 0.1
    c = a + s * (b - a) + np.round(rng.normal(size=(3000, 2))) * 2.0**-53
    got = mesh.turns(a, b, c)
    for i in range(3000):
        (ax, ay), (bx, by), (cx, cy) = (tuple(map(Fraction, map(float, p[i]))) for p in (a, b, c))
        want = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        assert got[i] == (want > 0) - (want < 0)
    assert {-1, 0, 1} == set(got.tolist())


def test_grids_give_whole_fans_in_any_order():
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    ring = np.array([(i, j, 0.0) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    for step, spun, moved in ((1.0, False, 0.0), (0.1, False, 0.3), (1.0, True, 0.0), (0.1, True, 7.7)):
        at = (step * ring) @ (turn if spun else np.eye(3)) + moved
        centre = np.full(3, moved)
        seen = set()
        for _ in range(20):
            order = rng.permutation(8)
            pairs = mesh.one_ring(centre, at[order])
            pairs = [(int(order[a]), int(order[b])) for a, b in pairs]
            # a fan goes once around the centre: each neighbour in it starts one triangle and ends one
            firsts, seconds = [a for a, _ in pairs], [b for _, b in pairs]
            assert sorted(firsts) == sorted(seconds) and len(set(firsts)) == len(firsts) and 4 <= len(pairs) <= 8
            angles = [np.arccos(np.clip((at[a] - centre) @ (at[b] - centre) / np.linalg.norm(at[a] - centre) / np.linalg.norm(at[b] - centre), -1, 1)) for a, b in pairs]
            assert abs(sum(angles) - 2 * np.pi) < 1e-9
            seen.add(frozenset(pairs))
        assert len(seen) == 1
        if step == 1.0 and not spun:
            # cocircular corners of the unit grid are left out
            assert len(pairs) == 4


def test_many_points_at_once_and_five_times_faster():
    rng = np.random.default_rng(3)
    n, k = 20_000, 8
    centre, around = rng.random((n, 3)), rng.random((n * k, 3))
    began = time.perf_counter()
    row, i, j = mesh.one_rings(centre, around, np.full(n, k))
    batched = time.perf_counter() - began
    got = {}
    for r, a, b in zip(row.tolist(), i.tolist(), j.tolist()):
        got.setdefault(r, []).append((a - r * k, b - r * k))
    began = time.perf_counter()
    want = [plain_ring(centre[r], around[r * k : (r + 1) * k]) for r in range(n // 10)]
    single = 10 * (time.perf_counter() - began)
    assert all(loose(got.get(r, [])) == loose(want[r]) for r in range(n // 10))
    assert batched < single / 5, (batched, single)


def test_uneven_counts_equal_points_and_lines():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 40, 300)
    centre, around = rng.random((300, 3)), rng.random((counts.sum(), 3))
    row, i, j = mesh.one_rings(centre, around, counts)
    begin = np.cumsum(counts) - counts
    for r in range(300):
        own = around[begin[r] : begin[r] + counts[r]]
        want = plain_ring(centre[r], own) if counts[r] > 1 else set()
        assert loose((a - begin[r], b - begin[r]) for a, b in zip(i[row == r], j[row == r])) == loose(want)
    assert mesh.one_ring(np.zeros(3), np.zeros((5, 3))) == [] and mesh.one_ring(np.zeros(3), np.empty((0, 3))) == []
    line = np.array([[-1.0, 0, 0], [1.0, 0, 0], [2.0, 0, 0]])
    assert mesh.one_ring(np.zeros(3), line) == []
    square = np.array([[1.0, 0, 0], [0, 1.0, 0], [-1.0, 0, 0], [0, -1.0, 0]])
    twice = mesh.one_ring(np.zeros(3), np.concatenate([square, square, np.zeros((1, 3))]))
    assert len(twice) == 4 and {frozenset((a % 4, b % 4)) for a, b in twice} == {frozenset(p) for p in ((0, 1), (1, 2), (2, 3), (3, 0))}


def test_covers_do_not_depend_on_the_order_of_triangles():
    rng = np.random.default_rng(6)
    p = rng.random((40, 3))
    tris = []
    for i in range(40):
        near = np.argsort(((p - p[i]) ** 2).sum(axis=1))[1:9]
        tris += [(i, int(near[a]), int(near[b])) for a, b in mesh.one_ring(p[i], p[near])]
    corners, lengths = mesh.tufted_cover(np.array(tris), p)
    for _ in range(3):
        again = mesh.tufted_cover(rng.permutation(np.array(tris)), p)
        assert (again[0] == corners).all() and (again[1] == lengths).all()
