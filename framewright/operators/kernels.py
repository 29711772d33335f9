"""Numpy kernels for whole frames; each also has a relational or brute-force twin in the tests or the SQL."""

from __future__ import annotations

import numpy as np

FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
EIGHT = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def label(values: np.ndarray, connectivity: int) -> np.ndarray:
    """Component of equal neighbours for every cell: the raster index of its first cell."""
    h, w = values.shape
    lab = np.arange(h * w).reshape(h, w)
    steps = FOUR if connectivity == 4 else EIGHT
    while True:
        new = lab.copy()
        for dy, dx in steps:
            a = (slice(max(dy, 0), h + min(dy, 0)), slice(max(dx, 0), w + min(dx, 0)))
            b = (slice(max(-dy, 0), h + min(-dy, 0)), slice(max(-dx, 0), w + min(-dx, 0)))
            same = values[a] == values[b]
            new[a] = np.where(same, np.minimum(new[a], new[b]), new[a])
        new = new.ravel()[new]  # jump to the label's own label
        if (new == lab).all():
            return lab
        lab = new


def dilate(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    h, w = mask.shape
    out = np.zeros_like(mask)
    for dy, dx in offsets:
        a = (slice(max(dy, 0), h + min(dy, 0)), slice(max(dx, 0), w + min(dx, 0)))
        b = (slice(max(-dy, 0), h + min(-dy, 0)), slice(max(-dx, 0), w + min(-dx, 0)))
        out[a] |= mask[b]
    return out


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton by parallel thinning in two alternating half steps."""
    m = np.pad(mask.astype(bool), 1)
    while True:
        gone = False
        for half in (0, 1):
            n, ne, e, se, s, sw, w, nw = (np.roll(m, (dy, dx), (0, 1)) for dy, dx in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)))
            c = (~n & (ne | e)).astype(int) + (~e & (se | s)) + (~s & (sw | w)) + (~w & (nw | n))
            n1 = (nw | n).astype(int) + (ne | e) + (se | s) + (sw | w)
            n2 = (n | ne).astype(int) + (e | se) + (s | sw) + (w | nw)
            few = np.minimum(n1, n2)
            side = ((s | sw | ~nw) & w) if half else ((n | ne | ~se) & e)
            drop = m & (c == 1) & (few >= 2) & (few <= 3) & ~side
            if drop.any():
                m &= ~drop
                gone = True
        if not gone:
            return m[1:-1, 1:-1]


def outline(mask: np.ndarray) -> list[list[tuple[float, float]]]:
    """Closed border of every 8-connected component, as cell centres (x, y), clockwise from its first cell."""
    h, w = mask.shape
    lab = label(mask.astype(int), 8)
    inside = lambda y, x, k: 0 <= y < h and 0 <= x < w and mask[y, x] and lab[y, x] == k
    ring = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
    out = []
    for k in np.unique(lab[mask]):
        y, x = divmod(int(k), w)
        path, facing = [(y, x)], 0
        first = None
        while True:
            for turn in range(8):
                d = (facing + 6 + turn) % 8
                ny, nx = y + ring[d][0], x + ring[d][1]
                if inside(ny, nx, k):
                    break
            else:
                break
            if first == ((y, x), d):
                path.pop()
                break
            first = first or ((y, x), d)
            y, x, facing = ny, nx, d
            path.append((y, x))
        out.append([(px + 0.5, py + 0.5) for py, px in path])
    return out


def simplify(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Indices kept by recursive splitting at the farthest point from the chord."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1 : b], points[b] - points[a]
        size = float(np.hypot(*d))
        far = np.abs(d[0] * (p[:, 1] - points[a, 1]) - d[1] * (p[:, 0] - points[a, 0])) / size if size else np.hypot(*(p - points[a]).T)
        k = int(far.argmax())
        if far[k] > epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def mutual_distances(p: np.ndarray, q: np.ndarray, limit: float = np.inf) -> np.ndarray:
    """(a, b): mean distance to the nearest point, both ways averaged, of strokes ``p`` (a, points, 2) and ``q`` (b, points, 2).

    Points that are NaN are missing. Where two strokes' boxes are at least ``limit`` apart, so is every
    point, and the result is infinite without a look at them. Coordinates in thousandths are multiplied
    as whole numbers, which is exact; the others' distances are subtracted coordinate by coordinate.
    """
    out = np.full((len(p), len(q)), np.inf)
    if not out.size:
        return out
    with np.errstate(invalid="ignore"):
        k, l = np.rint(p * 1000), np.rint(q * 1000)
        whole = all((x / 1000 == y).all() and np.abs(x).max(initial=0) < 1 << 24 for x, y in ((k, p), (l, q)))
    near = np.ones(out.shape, bool)
    if limit < np.inf:
        low, high = (lambda s: np.fmin.reduce(s, axis=1)), (lambda s: np.fmax.reduce(s, axis=1))
        gap = np.maximum(0, np.maximum(low(p)[:, None] - high(q), low(q) - high(p)[:, None]))
        near = ~(np.sqrt((gap * gap).sum(axis=2)) >= limit)
    rows, columns = (16, 256) if whole else (8, 32)
    for a in range(0, len(p), rows):
        some = np.flatnonzero(near[a : a + rows].any(axis=0))
        for b in range(0, len(some), columns):
            at = some[b : b + columns]
            out[a : a + rows, at] = _whole_distances(k[a : a + rows], l[at]) / 1000 if whole else _plain_distances(p[a : a + rows], q[at])
    out[~near] = np.inf
    return out


def _whole_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """|p|^2 + |q|^2 - 2pq as a product of matrices, a point of ``p`` against all of ``q`` at a time."""
    (a, n, _), (b, m, _) = p.shape, q.shape
    left = np.concatenate([p, (p * p).sum(axis=2, keepdims=True), np.ones((a, n, 1))], axis=2).transpose(1, 0, 2).copy()
    right = np.concatenate([-2 * q, np.ones((b, m, 1)), (q * q).sum(axis=2, keepdims=True)], axis=2).transpose(2, 1, 0).reshape(4, m * b)
    forth, back, d = np.empty((n, a, b)), np.full((a, m * b), np.inf), np.empty((a, m * b))
    for i in range(n):
        np.matmul(left[i], right, out=d)
        np.minimum(back, d, out=back)
        np.minimum.reduce(d.reshape(a, m, b), axis=1, out=forth[i])
    return (np.sqrt(forth).mean(axis=0) + np.sqrt(back).reshape(a, m, b).mean(axis=1)) / 2


def _plain_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = np.sqrt(((p[:, None, :, None] - q[None, :, None]) ** 2).sum(axis=4))
    forth, back = np.fmin.reduce(d, axis=3), np.fmin.reduce(d, axis=2)
    mean = lambda v: np.nansum(v, axis=2) / np.where((n := (~np.isnan(v)).sum(axis=2)) > 0, n, np.nan)
    return (mean(forth) + mean(back)) / 2


def assign(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """One-to-one pairs of the smallest total cost, to six places, among those under ``limit``; as many as possible, ties to smaller indices.

    Ties are settled within the costs while these fit 64 bits, which holds for a hundred strokes at
    costs of 20; in larger tables the order of the search settles them, the same on every run.
    """
    if not cost.size:
        return []
    with np.errstate(invalid="ignore"):
        ok = cost < limit
    c = np.where(ok, np.rint(np.where(ok, cost, 0) * 1e6), -1).astype(np.int64)
    return assign_whole(c)


def assign_whole(c: np.ndarray) -> list[tuple[int, int]]:
    """``assign`` of whole costs; negative ones are no pairs.

    Rows bid for columns first, those left over take the shortest augmenting path; all in integers, so
    that prices are exact. Missing pairs cost more than all others together.
    """
    if len(c) > c.shape[1]:
        return sorted((i, j) for j, i in assign_whole_rows(c.T, True))
    return assign_whole_rows(c, False)


def assign_whole_rows(c: np.ndarray, turned: bool) -> list[tuple[int, int]]:
    rows, columns = np.flatnonzero((c >= 0).any(axis=1)), np.flatnonzero((c >= 0).any(axis=0))
    if not len(rows):
        return []
    if len(rows) > len(columns):
        return sorted((int(rows[i]), int(columns[j])) for j, i in assign_whole_rows(c[np.ix_(rows, columns)].T, not turned))
    full = c if (len(rows), len(columns)) == c.shape else c[np.ix_(rows, columns)]
    n, m = full.shape
    gaps, top = bool((full < 0).any()), int(full.max())
    none = n * top + 1 if gaps else top
    scale = n * n * m + 1
    if (none + 1) * scale * 2 * (n + 2) >= 1 << 62:
        scale = 1

    order = (lambda i: i + np.arange(m) * n) if turned else (lambda i: i * m + np.arange(m))

    def row(i: int) -> np.ndarray:
        x = full[i].astype(np.int64)
        if scale == 1:
            return np.where(x < 0, none, x) if gaps else x
        return np.where(x < 0, none * scale, x * scale + order(i))

    far = np.iinfo(np.int64).max
    v, owner, mine = np.zeros(m, np.int64), np.full(m, -1), np.full(n, -1)
    free = list(range(n))
    for _ in range(2):  # bids: a row takes its best column at a price that leaves it as good as the second best
        todo, free, left = free[::-1], [], 8 * n
        while todo:
            i = todo.pop()
            if m == 1 or left <= 0:
                free.append(i)
                continue
            left -= 1
            r = row(i) - v
            j = int(r.argmin())
            first, r[j] = int(r[j]), far
            other = int(r.argmin())
            more = int(r[other]) - first
            if more:
                v[j] -= more
            elif owner[j] >= 0:
                j = other
            last, owner[j], mine[i] = int(owner[j]), i, j
            if last >= 0:
                mine[last] = -1
                (todo if more else free).append(last)
    for start in sorted(free):
        low, way, open_ = np.full(m, far), np.full(m, -1), np.ones(m, bool)
        done, i, at, j = [], start, 0, -1
        while True:
            r = row(i) - v  # the owner of a column is as good as its price: its reduced cost there is zero
            r += at - (int(r[j]) if j >= 0 else 0)
            better = (r < low) & open_
            low[better] = r[better]
            way[better] = j
            left = np.where(open_, low, far)
            j = int(left.argmin())
            at = int(left[j])
            if owner[j] >= 0:
                same = np.flatnonzero((left == at) & (owner < 0))
                j = int(same[0]) if len(same) else j
            open_[j] = False
            if owner[j] < 0:
                break
            done.append(j)
            i = int(owner[j])
        if done:
            v[done] -= at - low[done]
        while j >= 0:
            k = int(way[j])
            i = start if k < 0 else int(owner[k])
            owner[j], mine[i] = i, j
            j = k
    return [(int(rows[i]), int(columns[j])) for i, j in enumerate(mine) if full[i, j] >= 0]
