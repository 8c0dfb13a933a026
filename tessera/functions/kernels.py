"""Numeric algorithms on one group's arrays, for use in grouped pandas functions.

A group is one region, pair or gene: what one of these sees is bounded by the molecules over it, not by the table."""

from __future__ import annotations

import numpy as np


def modularity(labels: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, resolution: float = 1.0) -> float:
    total = weight.sum()
    if not total:
        return 0.0
    inside = weight[labels[src] == labels[dst]].sum() / total
    degree = np.bincount(src, weight, len(labels)) + np.bincount(dst, weight, len(labels))
    shares = np.bincount(labels, degree) / (2 * total)
    return float(inside - resolution * (shares**2).sum())


def communities(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, *, resolution: float = 1.0, seed: int = 0, rounds: int = 30) -> np.ndarray:
    """Labels 0.. of a partition by repeated local moves, a split of every community into its connected parts, and
    aggregation, until modularity no longer rises."""
    rng, labels = np.random.default_rng(seed), np.arange(n)
    best = modularity(labels, src, dst, weight, resolution)
    for _ in range(rounds):
        names, small = np.unique(labels, return_inverse=True)
        coarse = _moves(len(names), small[src], small[dst], weight, resolution, rng)
        refined = _moves(n, src, dst, weight, resolution, rng, coarse[small])
        found = _connected(n, src, dst, refined)
        got = modularity(found, src, dst, weight, resolution)
        if got <= best + 1e-12:
            break
        labels, best = found, got
    return np.unique(labels, return_inverse=True)[1]


def _moves(n, src, dst, weight, resolution, rng, start=None):
    near: list[dict[int, float]] = [{} for _ in range(n)]
    loops = np.zeros(n)
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist()):
        if a == b:
            loops[a] += w
        else:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    degree = np.array([sum(x.values()) for x in near]) + 2 * loops
    total = degree.sum() / 2
    labels = np.arange(n) if start is None else start.copy()
    held = np.bincount(labels, degree, max(n, labels.max() + 1 if n else 1))
    queue, waiting = list(rng.permutation(n)), np.ones(n, bool)
    while queue and total > 0:
        v = int(queue.pop(0))
        waiting[v] = False
        own = labels[v]
        held[own] -= degree[v]
        links: dict[int, float] = {}
        for u, w in near[v].items():
            links[labels[u]] = links.get(labels[u], 0.0) + w
        gain = {c: w - resolution * degree[v] * held[c] / (2 * total) for c, w in sorted(links.items())}
        gain.setdefault(own, -resolution * degree[v] * held[own] / (2 * total))
        new = max(gain, key=lambda c: (gain[c], c == own))
        if gain[new] <= gain[own] + 1e-12:
            new = own
        labels[v] = new
        held[new] += degree[v]
        if new != own:
            for u in near[v]:
                if labels[u] != new and not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
    return labels


def _connected(n, src, dst, labels):
    parent = np.arange(n)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(src.tolist(), dst.tolist()):
        if labels[a] == labels[b]:
            parent[find(a)] = find(b)
    return np.array([find(x) for x in range(n)])


#: Distances that are worked at together, so that they stay in the processor's caches.
_NEAR = 1 << 16


def _strips(x: np.ndarray, y: np.ndarray):
    step = max(1, _NEAR // max(1, len(y)))
    return [slice(low, low + step) for low in range(0, len(x), step)]


def manhattan(x: np.ndarray, y: np.ndarray, has_x: np.ndarray, has_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all rows of ``x`` from all of ``y``, and which are null; ``has_x``, ``has_y``: components that are there.

    Components are added in order, so that equal vectors have equal distances, from either side."""
    whole, columns = has_x.all() and has_y.all(), np.ascontiguousarray(y.T)
    out, none = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), bool)
    with np.errstate(invalid="ignore", over="ignore"):
        for s in _strips(x, y):
            total, any_ = out[s], np.zeros(out[s].shape, bool)
            each = np.empty(total.shape)
            for k in range(x.shape[1]):
                np.subtract(x[s, k, None], columns[k], out=each)
                np.abs(each, out=each)
                if not whole:
                    both = has_x[s, k, None] & has_y[:, k]
                    each[~both] = 0
                    any_ |= both
                total += each
            if not whole:
                none[s] = ~any_
    return out, none


def correlation_distance(x: np.ndarray, y: np.ndarray, has_x: np.ndarray, has_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One minus the correlation of all rows of ``x`` with all of ``y``, over common components; not a number if one of the
    two is constant there.  Null as in :func:`manhattan`."""
    out, none = np.ones((len(x), len(y))), np.zeros((len(x), len(y)), bool)
    whole = has_x.all() and has_y.all()
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        a, b = _standard(x, has_x), np.ascontiguousarray(_standard(y, has_y).T)
        for s in _strips(x, y):
            each = np.empty(out[s].shape)
            for k in range(len(b)):
                np.multiply(a[s, k, None], b[k], out=each)
                out[s] -= each
        for i in () if whole else range(len(x)):  # vectors that have other components
            at = np.flatnonzero((has_x[i] != has_y).any(axis=1))
            both = has_x[i] & has_y[at]
            none[i, at] = ~both.any(axis=1)
            u, v = _standard(np.broadcast_to(x[i], both.shape), both), _standard(y[at], both)
            out[i, at] = 1 - _total(u * v)
        none |= ~has_x.any(axis=1)[:, None] & ~has_y.any(axis=1)
    return np.maximum(out, 0.0), none


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of rows in order, so that zeros at their ends do not change them."""
    return np.cumsum(x, axis=1)[:, -1]


def _standard(x: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and length 1 over the components that are there, 0 elsewhere; not a number where a row is constant."""
    centred = np.where(has, x - (_total(np.where(has, x, 0)) / has.sum(axis=1))[:, None], 0)
    flat = np.where(has, x, -np.inf).max(axis=1) == np.where(has, x, np.inf).min(axis=1)
    return centred / np.where(flat, np.nan, np.sqrt(_total(centred * centred)))[:, None]


def least(d: np.ndarray, none: np.ndarray, own: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns, values and whether these are null of the ``k`` least of each row, ties by column: numbers, then what is
    not a number, then null ones.  What ``own`` marks is left out."""
    k, n = min(k, d.shape[1]), len(d)
    own = np.zeros(d.shape, bool) if own is None else own
    at, lines = np.empty((n, k), np.int64), np.arange(n)
    if k <= 16 and np.isfinite(d).all() and not none.any():
        left = np.where(own, np.inf, d)
        for c in range(k):
            at[:, c] = left.argmin(axis=1)
            left[lines, at[:, c]] = np.inf
        # a row whose others are used up finds its own columns, or some column again
        ok = np.arange(k) < np.minimum(k, (~own).sum(axis=1))[:, None]
    else:
        at = np.lexsort((d, none, own))[:, :k]
        ok = ~np.take_along_axis(own, at, axis=1)
    r, c = np.repeat(lines, k)[ok.ravel()], at[ok]
    return r, c, d[r, c], none[r, c]


#: Rows of a side of a tile of screened pairs; of so many pairs one may be left, and this many in any case; with more, every
#: distance is computed, with so many rows of a side.
_TILE, _LEFT, _FEW, _SIDE = 2048, 16, 1 << 16, 1024


def _rough_correlation(p: np.ndarray, q: np.ndarray):
    """Rough points of both sides, a function of these that gives rough values of all pairs, how far one may be from its exact
    value, and a function that gives the exact value of a distance in the same measure: minus the correlation."""
    return p.astype(np.float32), q.astype(np.float32), lambda a, b: -a @ b.T, (p.shape[1] + 8) * 2.0**-23, lambda d: d - 1


def _exact_correlation(p: np.ndarray, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of some pairs, from points in columns."""
    out = np.ones(len(r))
    for u, v in zip(p, q):
        out -= u.take(r) * v.take(c)
    return np.maximum(out, 0.0)


def _sound_correlation(x: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        p = _standard(x, has)
    return p, has.all(axis=1) & np.isfinite(p).all(axis=1)


def _rough_manhattan(p: np.ndarray, q: np.ndarray):
    """As :func:`_rough_correlation`, in whole steps; nothing if rows are too near for steps."""
    low, width = np.minimum(p.min(axis=0), q.min(axis=0)), p.shape[1]
    kind = np.uint16 if width <= 256 else np.uint32
    span, most = (np.maximum(p.max(axis=0), q.max(axis=0)) - low).sum(), float(np.iinfo(kind).max)
    if not 1e-280 < span < 1e300:
        return None
    steps = (most - 2 * width) / span  # no distance is more than the last number but one
    (a, off_a), (b, off_b) = ((np.rint(z).astype(kind), np.abs(z - np.rint(z)).sum(axis=1).max()) for z in ((p - low) * steps, (q - low) * steps))

    def values(a, b):
        out, columns = np.zeros((len(a), len(b)), kind), np.ascontiguousarray(b.T)
        for s in _strips(a, b):
            total, each = out[s], np.empty(out[s].shape, kind)
            for k in range(width):
                np.minimum(a[s, k, None], columns[k], out=each)
                total += each
            # |u - v| = u + v - 2 min(u, v), where overflows cancel out
            np.multiply(total, kind(2), out=each)
            np.subtract(a[s].sum(axis=1, dtype=kind)[:, None] + columns.sum(axis=0, dtype=kind), each, out=total)
        return out

    return a, b, values, off_a + off_b + most * (width + 16) * 2.0**-51, lambda d: d * steps


def _exact_manhattan(p: np.ndarray, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r))
    for u, v in zip(p, q):
        out += np.abs(u.take(r) - v.take(c))
    return out


def _sound_manhattan(x: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x, has.all(axis=1) & (np.abs(x) < 1e290).all(axis=1)


#: By kernel: points and which of them can be screened, rough values of all pairs, exact values of some.
_SCREENS = {
    correlation_distance: (_sound_correlation, _rough_correlation, _exact_correlation),
    manhattan: (_sound_manhattan, _rough_manhattan, _exact_manhattan),
}


def _turned(x: np.ndarray) -> np.ndarray:
    """The transpose, by strips that stay in the processor's caches."""
    out = np.empty(x.shape[::-1], x.dtype)
    for i in range(0, len(x), 64):
        for j in range(0, x.shape[1], 256):
            out[j : j + 256, i : i + 64] = x[i : i + 64, j : j + 256].T
    return out


def _low(rough: np.ndarray, own: np.ndarray | None, k: int, error: float, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs that can be among the ``k`` least of their row, if values are off by ``error`` at most
    and no exact value over ``most`` is wanted."""
    whole = np.issubdtype(rough.dtype, np.integer)
    top = np.iinfo(rough.dtype).max if whole else np.inf
    if own is not None:
        rough[own] = top
    k, most = min(k, rough.shape[1]), most + error
    if not np.isfinite(most).all():
        most = np.minimum(most, np.partition(rough, k - 1, axis=1)[:, k - 1].astype(float) + 2 * error)
    most = np.minimum(np.ceil(most), top - 1).astype(rough.dtype) if whole else np.nextafter(np.minimum(most, 1e38).astype(rough.dtype), rough.dtype.type(np.inf))
    return np.divmod(np.flatnonzero(rough <= most[:, None]), rough.shape[1])


class _Best:
    """The ``k`` least pairs of each row so far, ties by column."""

    def __init__(self, rows: int, k: int):
        self.value, self.column, self.k = np.full((rows, k), np.inf), np.full((rows, k), -1), k

    def add(self, r: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        """``r`` in order."""
        at = np.unique(r)
        held = self.column[at] >= 0
        r = np.concatenate([np.repeat(at, held.sum(axis=1)), r])
        c, d = np.concatenate([self.column[at][held], c]), np.concatenate([self.value[at][held], d])
        order = np.lexsort((c, d, r))
        r = r[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, place, order = (z[place < self.k] for z in (r, place, order))
        self.value[r, place], self.column[r, place] = d[order], c[order]

    def piece(self, way: int) -> tuple:
        r, at = np.nonzero(self.column >= 0)
        return way, r, self.column[r, at], self.value[r, at], np.zeros(len(r), bool)


def _screened(screen, p: np.ndarray, q: np.ndarray, names: np.ndarray | None, k: int, whole) -> list:
    """As :func:`closest`, by the exact values of the few pairs that rough ones leave; what leaves many is handed to ``whole``."""
    _, rough, exact = screen
    everything, both = (np.arange(len(p)), np.arange(len(q))), names is None
    if (found := rough(p, q)) is None:
        whole(*everything)
        return []
    a, b, values, error, measure = found
    columns = [np.ascontiguousarray(z.T) for z in (p, q)]
    best = [_Best(len(z), min(k, len(o))) for z, o in ((p, q), (q, p))[: 1 + both]]
    for i in range(0, len(p), _TILE):
        for j in range(0, len(q), _TILE):
            s, t = slice(i, i + _TILE), slice(j, j + _TILE)
            rough, own, few = values(a[s], b[t]), names[s, None] == names[t] if names is not None else None, []
            for way in range(1 + both):
                r, c = _low(_turned(rough) if way else rough, own, k, error, measure(best[way].value[t if way else s, -1]))
                few.append((r, c) if len(r) <= max(_FEW, rough.size // _LEFT) else None)
            if None in few:
                whole(everything[0][s], everything[1][t])
                continue
            for way, (r, c) in enumerate(few):
                r, c = (r + j, c + i) if way else (r + i, c + j)
                best[way].add(r, c, exact(columns[way], columns[1 - way], r, c))
    return [z.piece(way) for way, z in enumerate(best)]


def closest(distance, x: np.ndarray, y: np.ndarray, has_x: np.ndarray, has_y: np.ndarray, names: np.ndarray | None, k: int) -> list[tuple]:
    """Pieces (0, rows of ``x``, rows of ``y``, values, nulls) and (1, rows of ``y``, rows of ``x``, ...) that hold, for each row,
    the ``k`` least of the other block as :func:`least` gives them, and other pairs at times.

    With ``names`` both blocks are one, equal names are no pair, and there are pieces of the first kind only.  Rows without gaps
    are screened by rough values with a known error, where ``distance`` has them; exact values decide.  Other rows are
    compared by ``distance`` with all."""
    screen, alone, out = _SCREENS.get(distance), names is not None, []
    (p, fit_x), (q, fit_y) = (screen[0](*z) if screen else (z[0], np.zeros(len(z[0]), bool)) for z in ((x, has_x), (y, has_y)))
    of_x, of_y = ([np.flatnonzero(f), np.flatnonzero(~f)] for f in (fit_x, fit_y))

    def whole(a, b, both):
        for i in range(0, len(a), _SIDE):
            for j in range(0, len(b), _SIDE):
                s, t = a[i : i + _SIDE], b[j : j + _SIDE]
                d, none = distance(x[s], y[t], has_x[s], has_y[t])
                own = names[s][:, None] == names[t] if alone else None
                for way in range(1 + both):
                    r, c, *found = least(d.T, none.T, None if own is None else own.T, k) if way else least(d, none, own, k)
                    out.append((0 if alone else way, *((t[r], s[c]) if way else (s[r], t[c])), *found))

    for i, a in enumerate(of_x):
        for j, b in enumerate(of_y):
            if len(a) and len(b) and not (alone and i > j):
                if i + j == 0:
                    found = _screened(screen, p[a], q[b], names[a] if alone else None, k, lambda s, t: whole(a[s], b[t], not alone))
                    out += [(way, *((b[r], a[c]) if way else (a[r], b[c])), *rest) for way, r, c, *rest in found]
                else:
                    whole(a, b, not alone or i != j)
    return out


def ward(points: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) of minimal-variance clustering on squared distances; new clusters count from n.

    Chains of nearest neighbours among centres: no more is held than the points, and the work is their square."""
    n, d = points.shape
    centre = points - points.mean(axis=0)
    size, norm, first, alive = np.ones(n), (centre * centre).sum(axis=1), np.arange(n), np.ones(n, bool)
    found, chain = [], []
    for left in range(n, 1, -1):
        if 2 * left < len(alive):
            keep = np.flatnonzero(alive)
            place = np.zeros(len(alive), np.int64)
            place[keep] = np.arange(len(keep))
            chain = place[chain].tolist()
            centre, size, norm, first, alive = (v[keep] for v in (centre, size, norm, first, alive))
        while True:
            if not chain:
                chain = [int(alive.argmax())]
            a = chain[-1]
            # squared distances by one product; those that rounding leaves in doubt are made anew
            weight, both = 2 * size * size[a] / (size + size[a]), norm + norm[a]
            about, slack = weight * (both - 2 * (centre @ centre[a])), weight * both * (1e-15 * (d + 8))
            other = alive.copy()
            other[a] = False
            near = np.flatnonzero(other & (about - slack <= (about + slack)[other].min()))
            exact = weight[near] * ((centre[near] - centre[a]) ** 2).sum(axis=1)
            best = exact.min()
            if len(chain) > 1 and (exact[near == chain[-2]] == best).any():
                break
            chain.append(int(near[exact.argmin()]))
        b, a = chain.pop(), chain.pop()
        found.append((first[a], first[b], best))
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[a] += size[b]
        norm[a] = centre[a] @ centre[a]
        first[a] = min(first[a], first[b])
        alive[b] = False
    out, parent, of, many = [], list(range(n)), list(range(n)), [1] * n

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, (a, b, height) in enumerate(sorted(found, key=lambda m: m[2])):
        a, b = find(int(a)), find(int(b))
        if many[a] < many[b]:
            a, b = b, a
        out.append((min(of[a], of[b]), max(of[a], of[b]), np.sqrt(height), many[a] + many[b]))
        parent[b], of[a], many[a] = a, n + step, many[a] + many[b]
    return np.array(out).reshape(-1, 4)


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    root = np.arange(2 * n)
    for step in range(n - k - 1, -1, -1):
        root[merges[step, :2].astype(int)] = root[n + step]
    _, at, labels = np.unique(root[:n], return_index=True, return_inverse=True)
    order = np.empty(len(at), int)
    order[np.argsort(at)] = np.arange(len(at))  # clusters count in the order of their first points
    return order[labels]


def cluster_sums(points: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The sum of each point's distances from the points of each cluster, some points at a time."""
    points = points - points.mean(axis=0)
    norm, of = (points * points).sum(axis=1), np.eye(labels.max() + 1)[labels]
    out, step = np.empty(of.shape), max(1, (1 << 20) // len(points))
    for low in range(0, len(points), step):
        some = points[low : low + step]
        both = norm[low : low + step, None] + norm
        d = both - 2 * (some @ points.T)
        i, j = np.nonzero(d <= 1e-6 * both)  # the product is not exact for near points
        for at in np.array_split(np.arange(len(i)), 1 + len(i) * points.shape[1] // (1 << 21)):
            d[i[at], j[at]] = ((some[i[at]] - points[j[at]]) ** 2).sum(axis=1)
        out[low : low + step] = np.sqrt(d) @ of
    return out


def silhouette(points: np.ndarray, labels: np.ndarray, sums: np.ndarray | None = None) -> float:
    """The mean silhouette; ``sums``: :func:`cluster_sums`, where it is known."""
    sums = cluster_sums(points, labels) if sums is None else sums
    k = labels.max() + 1
    counts = np.bincount(labels, minlength=k)
    own = counts[labels]
    a = np.where(own > 1, sums[np.arange(len(labels)), labels] / np.maximum(own - 1, 1), 0)
    means = sums / counts
    means[np.arange(len(labels)), labels] = np.inf
    b = means.min(axis=1)
    return float(np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def conditional_odds_ratio(neither: int, first: int, second: int, joint: int) -> float:
    """Maximum-likelihood odds ratio of a 2x2 table given its margins; 0 or inf at the ends of the support."""
    m, k, n = joint + first, joint + second, neither + first + second + joint
    low, high = max(0, m + k - n), min(m, k)
    if low == high:
        return float("nan")
    if joint == low:
        return 0.0
    if joint == high:
        return float("inf")
    x = np.arange(low, high + 1)
    lf = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    base = -(lf[x] + lf[m - x] + lf[k - x] + lf[n - m - k + x])
    a, b = -50.0, 50.0
    for _ in range(200):
        t = (a + b) / 2
        p = base + x * t
        p = np.exp(p - p.max())
        if (x * p).sum() / p.sum() < joint:
            a = t
        else:
            b = t
    return float(np.exp((a + b) / 2))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, *, steps: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, log likelihood and standard errors of a binomial regression by reweighted least squares."""
    beta, before = np.zeros(x.shape[1]), -np.inf
    for _ in range(steps):
        eta = np.clip(x @ beta, -30, 30)
        p = 1 / (1 + np.exp(-eta))
        w = np.maximum(n * p * (1 - p), 1e-10)
        info = x.T @ (x * w[:, None])
        beta = beta + np.linalg.lstsq(info, x.T @ (y - n * p), rcond=None)[0]
        eta = np.clip(x @ beta, -30, 30)
        value = float((y * eta - n * np.log1p(np.exp(eta))).sum())
        if abs(value - before) < 1e-10 * (abs(value) + 1):
            break
        before = value
    return beta, value, np.sqrt(np.diag(np.linalg.pinv(info)))


def breslow_day(tables: np.ndarray) -> tuple[float, int]:
    """Heterogeneity statistic of odds ratios over strata (rows neither, first, second, joint) and its degrees of freedom."""
    d, b, c, a = (tables[:, k].astype(float) for k in range(4))
    n = a + b + c + d
    ok = (n > 0) & ((a + b) * (c + d) * (a + c) * (b + d) > 0)
    a, b, c, d, n = (v[ok] for v in (a, b, c, d, n))
    if len(n) < 2 or not (b * c / n).sum():
        return float("nan"), 0
    ratio, m, k = (a * d / n).sum() / (b * c / n).sum(), a + b, a + c
    qa, qb, qc = 1 - ratio, n - m - k + ratio * (m + k), -ratio * m * k
    expected = np.where(abs(qa) < 1e-12, -qc / qb, (-qb + np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0))) / np.where(abs(qa) < 1e-12, 1, 2 * qa))
    v = 1 / (1 / expected + 1 / (m - expected) + 1 / (k - expected) + 1 / (n - m - k + expected))
    return float(((a - expected) ** 2 / v).sum()), len(n) - 1


def topics(counts: np.ndarray, k: int, *, steps: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Poisson factors by multiplicative updates: row loadings that add up to one, and topics that add up to one."""
    rng = np.random.default_rng(seed)
    l, f = rng.random((counts.shape[0], k)) + 0.1, rng.random((k, counts.shape[1])) + 0.1
    for _ in range(steps):
        l *= (counts / np.maximum(l @ f, 1e-12)) @ f.T / np.maximum(f.sum(axis=1), 1e-12)
        f *= l.T @ (counts / np.maximum(l @ f, 1e-12)) / np.maximum(l.sum(axis=0), 1e-12)[:, None]
    scale = f.sum(axis=1)
    l = l * scale
    return l / np.maximum(l.sum(axis=1, keepdims=True), 1e-12), f / np.maximum(scale[:, None], 1e-12)


def local_peaks(curve: np.ndarray, *, distance: int = 20, prominence: float = 0.01) -> np.ndarray:
    """Indices of local maxima (plateaus by their middle), the higher first within ``distance``, then by prominence."""
    n, at, i = len(curve), [], 1
    while i < n - 1:
        if curve[i] > curve[i - 1]:
            j = i
            while j + 1 < n and curve[j + 1] == curve[i]:
                j += 1
            if j + 1 < n and curve[j + 1] < curve[i]:
                at.append((i + j) // 2)
            i = j
        i += 1
    kept: list[int] = []
    for p in sorted(at, key=lambda p: (-curve[p], p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        sides = []
        for step in (-1, 1):
            j, low = p, curve[p]
            while 0 <= j + step < n and curve[j + step] <= curve[p]:
                j += step
                low = min(low, curve[j])
            sides.append(low)
        if curve[p] - max(sides) >= prominence:
            out.append(p)
    return np.array(out, int)


def representative_sites(start: np.ndarray, end: np.ndarray, p: np.ndarray, matrix: np.ndarray, *, share: float = 0.8, centre: float = 2.0) -> np.ndarray:
    """Greedy choice by p value: a site goes if a chosen one of another matrix overlaps it by ``share`` of both with
    centres within ``centre``.  What a site that went overlaps does not matter.  Indices of the sites that stay."""
    kept: list[int] = []
    for i in np.lexsort((start, p)).tolist():
        if not any(matrix[i] != matrix[j] and (o := min(end[i], end[j]) - max(start[i], start[j])) >= share * (end[i] - start[i]) and o >= share * (end[j] - start[j]) and abs(start[i] + end[i] - start[j] - end[j]) <= 2 * centre for j in kept):
            kept.append(i)
    return np.array(sorted(kept), int)
