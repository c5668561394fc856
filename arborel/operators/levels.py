"""A preconditioner on two levels for the least squares of one plant in a task.

Points are halved into small blocks of near ones. Errors inside a block go by the inverse of the
block's part of the matrix, those that are even over many points by the inverse of the matrix
between whole groups of them. Both are sums over the sparse rows; the product matrix is never
laid out. Rounds of conjugate gradients then hardly grow with a step's weights, as they do with
the diagonal alone.
"""

from __future__ import annotations

import numpy as np

#: Points of a block, least points of a group, most groups (a power of two), pairs of entries that are summed at a time.
BLOCK, EVEN, MOST, PAIRS = 64, 16, 2048, 1 << 21
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _halved(at: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows of at in sets of up to `most` that lie near each other."""
    done, work = [], [np.arange(len(at))]
    while work:
        rows = work.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        half = len(rows) // 2
        rows = rows[np.argpartition(at[rows, np.ptp(at[rows], axis=0).argmax()], half)]
        work += [rows[:half], rows[half:]]
    return done


def _numbers(sets: list[np.ndarray], n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int64)
    out[np.concatenate(sets)] = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return out


def _even(at: np.ndarray, rows: Entries, own: Entries):
    """r -> the correction that is constant on groups."""
    n = len(at)
    groups = _halved(at, max(EVEN, -(-n // MOST)))
    m, group = len(groups), _numbers(groups, n)
    key, held = np.unique(rows[0] * m + group[rows[1]], return_inverse=True)
    value, row, col = np.bincount(held, rows[2], len(key)), key // m, key % m
    # an entry meets those of its row: as many pairs as the square of a row's groups
    begin = np.searchsorted(row, np.arange(n + 1))
    meets = np.diff(begin)[row]
    dense = np.bincount(group[own[0]] * m + group[own[1]], own[2], m * m)
    ends, start = np.cumsum(meets), 0
    while start < len(key):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        size = meets[start:end]
        left = np.repeat(np.arange(start, end), size)
        right = np.repeat(begin[row[start:end]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        dense += np.bincount(col[left] * m + col[right], value[left] * value[right], m * m)
        start = end
    inverse = np.linalg.inv(dense.reshape(m, m))
    inverse = (inverse + inverse.T) / 2

    def correct(r: np.ndarray) -> np.ndarray:
        return (inverse @ np.stack([np.bincount(group, r[:, c], m) for c in range(r.shape[1])], axis=1))[group]

    return correct


def _inside(at: np.ndarray, diagonal: np.ndarray, rows: Entries, own: Entries):
    """r -> the correction of each block by itself."""
    n = len(at)
    blocks = _halved(at, BLOCK)
    m, block, width = len(blocks), _numbers(blocks, n), max(map(len, blocks))
    flat, place = np.full((m, width), -1), np.empty(n, dtype=np.int64)
    for b, members in enumerate(blocks):
        flat[b, : len(members)], place[members] = members, np.arange(len(members))
    flat = flat.ravel()
    real = flat >= 0
    size = np.sqrt(diagonal)
    dense = np.zeros((m, width, width))
    order = np.argsort(block[rows[1]], kind="stable")
    i, j, v = rows[0][order], rows[1][order], (rows[2] / size[rows[1]])[order]
    begin = np.searchsorted(block[j], np.arange(m + 1))
    for b in range(m):
        some = slice(begin[b], begin[b + 1])
        names, row = np.unique(i[some], return_inverse=True)
        part = np.zeros((len(names), width))
        part[row, place[j[some]]] = v[some]
        dense[b] = part.T @ part
    i, j, v = (c[block[own[0]] == block[own[1]]] for c in own)
    np.add.at(dense, (block[i], place[i], place[j]), v / (size[i] * size[j]))
    # places that no point takes, and a trace of hold for blocks at the edge of double precision
    dense.reshape(m, -1)[:, :: width + 1] += np.where(real, 1e-10, 1.0).reshape(m, width)
    inverse = np.linalg.inv(dense)
    inverse = (inverse + inverse.transpose(0, 2, 1)) / 2

    def correct(r: np.ndarray) -> np.ndarray:
        scaled, out = np.zeros((m * width, r.shape[1])), np.empty_like(r)
        scaled[real] = (r / size[:, None])[flat[real]]
        out[flat[real]] = np.matmul(inverse, scaled.reshape(m, width, -1)).reshape(m * width, -1)[real]
        return out / size[:, None]

    return correct


def two_levels(at: np.ndarray, diagonal: np.ndarray, rows: Entries, own: Entries):
    """r -> roughly A^-1 r, for A = R^T R + S with the entries (i, j, value) of R and of S, symmetric and positive definite, and A's diagonal.

    at are the places of the unknowns; entries at one place of R must be summed, those of S add
    up. None where the matrix has no such inverse in double precision.
    """
    try:
        with np.errstate(all="ignore"):
            inside, even = _inside(at, diagonal, rows, own), _even(at, rows, own)
    except np.linalg.LinAlgError:
        return None
    return lambda r: inside(r) + even(r)
