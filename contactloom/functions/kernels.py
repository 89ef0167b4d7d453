"""Small numeric helpers for grouped functions; each works on one group's arrays."""

from __future__ import annotations

import numpy as np


def isotonic_decreasing(y: np.ndarray) -> np.ndarray:
    """Least-squares fit that never rises, by pooling neighbours."""
    sums, sizes = [], []
    for v in y:
        sums.append(float(v))
        sizes.append(1)
        while len(sums) > 1 and sums[-2] * sizes[-1] < sums[-1] * sizes[-2]:
            s, n = sums.pop(), sizes.pop()
            sums[-1] += s
            sizes[-1] += n
    return np.repeat(np.array(sums) / np.array(sizes), sizes) if sums else np.zeros(0)


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, means of ties."""
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def trend_is_unclear(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the 95 % interval of Spearman's rho (Fisher's z) holds 0."""
    if len(x) <= 3 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return False
    rho = np.corrcoef(ranks(x), ranks(y))[0, 1]
    if abs(rho) >= 1:
        return False
    z = np.arctanh(rho) + np.array([-1.96, 1.96]) / np.sqrt(len(x) - 3)
    return bool(z[0] < 0 < z[1])


def huber_line(x: np.ndarray, y: np.ndarray, epsilon: float = 1.35, rounds: int = 100) -> tuple[float, float, float]:
    return huber_fit(x, y, epsilon, rounds)[:3]


def weighted_line(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope and intercept of the weighted least-squares line; level where all x are one."""
    total = w.sum()
    mx, my = (w @ x) / total, (w @ y) / total
    dx = x - mx
    spread = (w * dx) @ dx
    slope = (w * dx) @ (y - my) / spread if spread > 1e-300 else 0.0
    return np.array([slope, my - slope * mx])


def huber_fit(x: np.ndarray, y: np.ndarray, epsilon: float = 1.35, rounds: int = 100) -> tuple[float, float, float, int]:
    """Slope, intercept and R2 of the inliers of a robust line, by reweighting with the scale re-estimated; and how many
    inliers there are."""
    w, beta, scale = np.ones(len(x)), np.zeros(2), 1.0
    for _ in range(rounds):
        new = weighted_line(x, y, w)
        r = np.abs(y - new[0] * x - new[1])
        scale = max(1.4826 * float(np.median(r)), 1e-12)
        w = np.minimum(1.0, epsilon * scale / np.maximum(r, 1e-300))
        if np.abs(new - beta).max() < 1e-10:
            beta = new
            break
        beta = new
    left = y - beta[0] * x - beta[1]
    inside = np.abs(left) <= epsilon * scale
    kept = y[inside]
    total = float(((kept - kept.mean()) ** 2).sum()) if len(kept) else 0.0
    return float(beta[0]), float(beta[1]), 1 - float((left[inside] ** 2).sum()) / total if total > 0 else 0.0, int(inside.sum())


def without_flat_start(x: np.ndarray, y: np.ndarray) -> int:
    """Where a falling trend of y sets in: the first run of falling steps of the monotone fit that fills more than half of
    the way to the next run. It must leave at least seven tenths of the points, else the first falling step, else 0."""
    rising = bool(len(x) > 1 and np.ptp(x) > 0 and np.ptp(y) > 0 and np.corrcoef(ranks(x), ranks(y))[0, 1] >= 0)
    fit = -isotonic_decreasing(-y) if rising else isotonic_decreasing(y)
    falls = np.flatnonzero(np.diff(fit) < 0)
    if not len(falls):
        return 0
    firsts = falls[np.flatnonzero(np.diff(falls, prepend=-2) > 1)]
    lasts = falls[np.flatnonzero(np.diff(falls, append=len(y) + 2) > 1)]
    dense = (lasts - firsts + 1)[:-1] / np.diff(firsts) > 0.5
    start = int(firsts[np.argmax(dense)]) if dense.any() else 0
    for at in (start, int(falls[0])):
        if at <= 0.3 * len(y):
            return at
    return 0


def best_line(distance: np.ndarray, x: np.ndarray, y: np.ndarray, least: int = 5) -> tuple[float, float]:
    """Slope and R2 of the robust line of larger R2: of all points, or of those after a flat start. 0 and 0 where fewer
    than `least` points are inliers."""
    start = without_flat_start(distance, y)
    found = []
    for at in (0, start):
        slope, _, r2, inside = huber_fit(x[at:], y[at:])
        found.append((slope, r2) if inside >= least else (0.0, 0.0))
    return max(found, key=lambda f: f[1])


def smoothed_square(window: np.ndarray, sigma: float) -> list[float] | None:
    """A square matrix, given row by row, blurred along both sides and scaled to 0..1."""
    side, reach = int(np.sqrt(len(window))), int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    at = np.arange(side)[:, None] + np.arange(-reach, reach + 1)
    at = np.mod(at, 2 * side)
    at = np.where(at < side, at, 2 * side - 1 - at)  # mirrored at the edges
    weights = np.zeros((side, side))
    np.add.at(weights, (np.arange(side)[:, None], at), k / k.sum())
    out = weights @ window.reshape(side, side) @ weights.T
    low, high = out.min(), out.max()
    return ((out - low) / (high - low)).ravel().tolist() if high > low else None


def log_normal_density(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * variances) + (x[:, None] - means) ** 2 / variances)


def state_sums(x: np.ndarray, means: np.ndarray, variances: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One sequence's expected counts of a Gaussian hidden Markov model: weight, sum and sum of squares by state, and
    transitions."""
    logs = log_normal_density(x, means, variances)
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    n, k = e.shape
    alpha, beta = np.empty((n, k)), np.ones((n, k))
    for t in range(n):
        a = e[t] * (np.full(k, 1 / k) if t == 0 else alpha[t - 1] @ transitions)
        alpha[t] = a / a.sum()
    for t in range(n - 2, -1, -1):
        b = transitions @ (e[t + 1] * beta[t + 1])
        beta[t] = b / b.sum()
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    pairs = alpha[:-1, :, None] * transitions * (e[1:] * beta[1:])[:, None, :]
    pairs /= np.maximum(pairs.sum(axis=(1, 2), keepdims=True), 1e-300)
    return p.sum(axis=0), p.T @ x, p.T @ (x * x), pairs.sum(axis=0)


def likeliest_states(x: np.ndarray, means: np.ndarray, variances: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    logs, moves = log_normal_density(x, means, variances), np.log(np.maximum(transitions, 1e-300))
    back, score = np.zeros(logs.shape, int), logs[0]
    for t in range(1, len(x)):
        step = score[:, None] + moves
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + logs[t]
    path = [int(score.argmax())]
    for t in range(len(x) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def mixture_logs(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Log of weight times density by value, state and part."""
    with np.errstate(divide="ignore"):
        return np.log(weights) - 0.5 * (np.log(2 * np.pi * variances) + (x[:, None, None] - means) ** 2 / variances)


def chain_sums(x: np.ndarray, moves: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """One sequence's expected counts of a chain that begins in state 0 and ends by a move to the state past the last:
    its log-likelihood, the moves by state, and weight, sum and sum of squares by state and part, in one row. Zeros where
    the chain can't make the sequence."""
    logs = mixture_logs(x, weights, means, variances)
    top = logs.max(axis=2, keepdims=True)
    e = (top + np.log(np.exp(logs - top).sum(axis=2, keepdims=True)))[:, :, 0]
    n, k = e.shape
    with np.errstate(divide="ignore"):
        inner, last = np.log(moves[:, :k]), np.log(moves[:, k])
    alpha, beta = np.full((n, k), -np.inf), np.full((n, k), -np.inf)  # logs throughout: values may be far from all means
    alpha[0, 0], beta[-1] = e[0, 0], last
    for t in range(1, n):
        alpha[t] = e[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + inner, axis=0)
    for t in range(n - 2, -1, -1):
        beta[t] = np.logaddexp.reduce(inner + (e[t + 1] + beta[t + 1])[None], axis=1)
    whole = np.logaddexp.reduce(alpha[-1] + last)
    if not np.isfinite(whole):
        return np.zeros(1 + moves.size + 3 * means.size)
    p = np.exp(alpha + beta - whole)
    pairs = np.exp(alpha[:-1, :, None] + inner + (e[1:] + beta[1:])[:, None, :] - whole).sum(axis=0)
    counts = np.concatenate([pairs, p[-1][:, None]], axis=1)
    part = p[:, :, None] * np.exp(logs - e[:, :, None])
    held = [part.sum(axis=0), (part * x[:, None, None]).sum(axis=0), (part * (x * x)[:, None, None]).sum(axis=0)]
    return np.concatenate([[whole], counts.ravel(), *(h.ravel() for h in held)])


def likeliest_chain(x: np.ndarray, moves: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """The likeliest states of such a chain; none where it can't make the sequence."""
    logs = mixture_logs(x, weights, means, variances)
    top = logs.max(axis=2)
    e = top + np.log(np.exp(logs - top[:, :, None]).sum(axis=2))
    with np.errstate(divide="ignore"):
        steps, last = np.log(moves[:, :-1]), np.log(moves[:, -1])
    score = np.where(np.arange(e.shape[1]) == 0, e[0], -np.inf)
    back = np.zeros(e.shape, int)
    for t in range(1, len(x)):
        way = score[:, None] + steps
        back[t] = way.argmax(axis=0)
        score = way.max(axis=0) + e[t]
    score = score + last
    if not np.isfinite(score.max()):
        return np.zeros(0, int)
    path = [int(score.argmax())]
    for t in range(len(x) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


def widest_arcs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of values the arc of its circle that stands out most: between the lowest and the highest of the sums
    S[0..n-1] of what comes before a place, centred. Its statistic is (S[j] - S[i])^2 * n / (k (n - k)), for the k = j - i
    values in the arc, which is the squared difference of means inside and outside up to the common variance."""
    n = rows.shape[1]
    s = np.zeros(rows.shape)
    np.cumsum((rows - rows.mean(axis=1, keepdims=True))[:, :-1], axis=1, out=s[:, 1:])
    ends = np.sort(np.stack([s.argmin(axis=1), s.argmax(axis=1)]), axis=0)
    k = np.maximum(ends[1] - ends[0], 1)
    gap = np.take_along_axis(s, ends[1][:, None], 1)[:, 0] - np.take_along_axis(s, ends[0][:, None], 1)[:, 0]
    return gap * gap * n / (k * np.maximum(n - k, 1)), ends[0], ends[1]


def segments(x: np.ndarray, shuffles: int, p: float, inner_p: float, rng: np.random.Generator, least: int = 5, together: int = 64) -> list[tuple[int, int]]:
    """Circular binary segmentation: [start, end) pieces. An arc splits its piece where at most a part p of `shuffles`
    shuffled orders has a statistic as large; shuffles are drawn `together` rows at a time and end when too many have.
    Arc ends that leave fewer than `least` values beside them are moved to the piece's edge."""
    whole, pieces = [(0, len(x), p)], []
    while whole:
        lo, hi, level = whole.pop()
        part, n = x[lo:hi], hi - lo
        if n < least or np.ptp(part) == 0:
            pieces.append((lo, hi))
            continue
        (found,), (i,), (j,) = widest_arcs(part[None, :])
        allowed, above, drawn = int(np.floor(shuffles * level)), 0, 0
        while drawn < shuffles and above <= allowed:
            rows = min(together, shuffles - drawn)
            above += int((widest_arcs(rng.permuted(np.tile(part, (rows, 1)), axis=1))[0] >= found).sum())
            drawn += rows
        cuts = sorted({0, n, *(c for c in (int(i), int(j)) if least <= c <= n - least)})
        if above > allowed or len(cuts) == 2:
            pieces.append((lo, hi))
        else:
            whole += [(lo + c, lo + d, inner_p) for c, d in zip(cuts[:-1], cuts[1:], strict=True)]
    return sorted(pieces)


def merged_spans(x: np.ndarray, cuts: list[int], least: int, apart: float, most_zeros: float = 0.8) -> list[tuple[int, int]]:
    """Spans between cuts (ascending places in x), put together from the left: the span so far takes the next one where
    either is shorter than `least`, or where neither is mostly zeros and the log2 of their nonzero medians differ by less
    than `apart`."""
    zeros = lambda v: np.mean(v == 0) > most_zeros
    level = lambda v: np.log2(np.median(v[v != 0]))
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if out:
            start, end = out[-1]
            left, right = x[start:end], x[a:b]
            if min(len(left), len(right)) < least or not (zeros(left) or zeros(right) or abs(level(left) - level(right)) >= apart):
                out[-1] = (start, b)
                continue
        out.append((a, b))
    return out


def pair_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places i of a and i + d of b are both set, for d from 0 on; a and b are masks of one length."""
    n = len(a)
    size = 1 << max(1, (2 * n - 1).bit_length())
    found = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)[:n]
    return np.rint(found).astype(np.int64)


def correlated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places x of a and y of b are both set, for y - x from 1 - len(a) to len(b) - 1."""
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length() if n > 1 else 1
    return np.rint(np.fft.irfft(np.fft.rfft(a[::-1], size) * np.fft.rfft(b, size), size)[:n]) if size > 1 else np.array([a[0] * b[0]])


def neighbours(at: np.ndarray, radius: float) -> list[np.ndarray]:
    """For each point the points within the radius, itself included, by cells as wide as the radius."""
    cells: dict[tuple[int, int], list[int]] = {}
    home = np.floor(at / radius).astype(int)
    for k, (a, b) in enumerate(home.tolist()):
        cells.setdefault((a, b), []).append(k)
    out: list[np.ndarray] = [np.zeros(0, int)] * len(at)
    for (a, b), own in cells.items():
        near = np.array([k for x in (a - 1, a, a + 1) for y in (b - 1, b, b + 1) for k in cells.get((x, y), ())])
        close = ((at[own][:, None] - at[near][None]) ** 2).sum(axis=2) <= radius * radius
        for k, row in zip(own, close, strict=True):
            out[k] = near[row]
    return out


def grown_clusters(i: np.ndarray, j: np.ndarray, value: np.ndarray, radius: float) -> list[tuple[int, list[int]]]:
    """(seed, members) by row number: seeds by falling value; a cluster takes the rows linked to it (chains of steps up to
    the radius) that lie within its growing centroid's reach, until none is added; the seed counts twice in the centroid.
    Rows linked to none are alone."""
    n = len(i)
    at = np.stack([i, j], axis=1).astype(float)
    near = neighbours(at, radius)
    group = np.full(n, -1)
    for k in range(n):  # what chains of steps link
        if group[k] < 0:
            group[k], todo = k, [k]
            while todo:
                for m in near[todo.pop()].tolist():
                    if group[m] < 0:
                        group[m] = k
                        todo.append(m)
    by_group: dict[int, np.ndarray] = {int(g): np.flatnonzero(group == g) for g in np.unique(group)}
    free, out = np.ones(n, bool), []
    for seed in np.lexsort((-j, -i, -value)).tolist():
        if not free[seed]:
            continue
        rest = by_group[int(group[seed])]
        rest = rest[free[rest] & (rest != seed)]
        members, center, reach = [seed], at[seed], radius
        while len(rest):
            inside = np.sqrt(((at[rest] - center) ** 2).sum(axis=1)) <= reach
            if not inside.any():
                break
            members += rest[inside].tolist()
            rest = rest[~inside]
            center = np.rint((at[members].sum(axis=0) + at[seed]) / (len(members) + 1))
            reach = np.rint(np.sqrt(((at[members] - center) ** 2).sum(axis=1)).max()) + radius
        free[members] = False
        out.append((seed, sorted(members)))
    return out


def summits(x: np.ndarray, height: float, apart: int) -> np.ndarray:
    """Places of local maxima of at least this height, the middle of flat tops; of two less than `apart` from each other
    the higher stays, of equals the later."""
    edges = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(x)]])
    inner = (starts > 0) & (ends < len(x))
    starts, ends = starts[inner], ends[inner]
    tops = (x[starts] > x[starts - 1]) & (x[starts] > x[ends % len(x)]) & (x[starts] >= height)
    at = (starts[tops] + ends[tops] - 1) // 2
    kept = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if kept[k]:
            close = np.abs(at - at[k]) < apart
            close[k] = False
            kept &= ~close
    return at[kept]


def foot(x: np.ndarray, top: int, reach: int) -> tuple[float, float]:
    """Where a peak's sides come down to its lower shoulder's level: the larger of the least values on either side, up to
    where the peak is overtopped or `reach` places away. Between two places on a line."""
    sides = []
    for step in (-1, 1):
        stop, low = top, top
        for k in range(top, max(top - reach, 0) - 1 if step < 0 else min(top + reach, len(x) - 1) + 1, step):
            if x[k] > x[top]:
                break
            stop, low = k, k if x[k] < x[low] else low
        sides.append((stop, low))
    level = max(x[sides[0][1]], x[sides[1][1]])
    out = []
    for step, (_, low) in zip((-1, 1), sides, strict=True):
        k = top
        while k != low and x[k] > level:
            k += step
        out.append(k - step * (level - x[k]) / (x[k - step] - x[k]) if x[k] < level else float(k))
    return out[0], out[1]


def pile_anchors(places: np.ndarray, height: int, apart: int, reach: int) -> list[tuple[int, int, int]]:
    """(summit, lo, hi), hi included: stretches of places where calls pile up. Peaks of the number of calls go by falling
    height and later place first; one whose foot meets an anchor widens it, the first that it meets."""
    first = int(places.min())
    x = np.bincount(places - first)
    tops = summits(x, height, apart)
    anchors: dict[int, list[int]] = {}
    owner: dict[int, int] = {}
    for top in tops[np.lexsort((-tops, -x[tops]))].tolist():
        lo, hi = (int(np.rint(v)) for v in foot(x, top, reach))
        met = next((owner[b] for b in range(lo, hi + 1) if b in owner), None)
        if met is None:
            anchors[met := top] = [lo, hi]
        else:
            lo, hi = anchors[met] = [min(lo, anchors[met][0]), max(hi, anchors[met][1])]
        for b in range(lo, hi + 1):
            owner[b] = met
    return sorted((first + top, first + lo, first + hi) for top, (lo, hi) in anchors.items())


def anchored_clusters(i: np.ndarray, j: np.ndarray, value: np.ndarray, radius: int, height: int, reach: int) -> list[tuple[int, list[int]]]:
    """(seed, members): clusters of the calls in each rectangle of an anchor of i and one of j, then of the calls that are in
    none of these. A call alone in its rectangle is one of its own, and may be a member of a later cluster."""
    free, out = np.ones(len(i), bool), {}

    def take(rows: np.ndarray, alone: bool) -> None:
        for seed, members in grown_clusters(i[rows], j[rows], value[rows], radius):
            if len(members) > 1:
                free[rows[members]] = False
            if len(members) > 1 or alone:
                out.setdefault(int(rows[seed]), rows[members].tolist())

    if len(i):
        columns = pile_anchors(j, height, radius, reach)
        for _, a, b in pile_anchors(i, height, radius, reach):
            inside = (i >= a) & (i <= b)
            for _, c, d in columns:
                if len(rows := np.flatnonzero(inside & (j >= c) & (j <= d))):
                    take(rows, len(rows) == 1)
        take(np.flatnonzero(free), True)
    return sorted(out.items())


def quasi_newton(f, x: np.ndarray, rounds: int = 200, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """A minimum of f, which gives value and gradient, by steps from the last `memory` differences of gradients; a step is
    halved until it lowers f enough."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, rho in reversed(steps):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if steps:
            s, y, rho = steps[-1]
            q *= 1 / (rho * (y @ y))
        else:
            q *= 1 / max(float(np.linalg.norm(g)), 1.0)
        for (s, y, rho), alpha in zip(steps, reversed(alphas), strict=True):
            q += (alpha - rho * (y @ q)) * s
        slope, size = -float(g @ q), 1.0
        if slope >= 0:
            q, slope, steps = g / max(float(np.linalg.norm(g)), 1.0), -float(g @ g) / max(float(np.linalg.norm(g)), 1.0), []
        for _ in range(40):
            new = x - size * q
            now, h = f(new)
            if np.isfinite(now) and now <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - x, h - g
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / float(s @ y))]
        done = value - now <= tolerance * max(abs(value), abs(now), 1.0) * 1e-3
        x, value, g = new, now, h
        if done:
            break
    return x


def contact_likelihood(x: np.ndarray, i: np.ndarray, j: np.ndarray, count: np.ndarray, alpha: float, beta: float) -> tuple[float, np.ndarray]:
    """The negative log-likelihood of counts that are Poisson about beta d^alpha, for places x row by row, up to what
    doesn't depend on them, and its gradient."""
    at = x.reshape(-1, 3)
    diff = at[i] - at[j]
    d2 = np.maximum((diff * diff).sum(axis=1), 1e-18)
    mean = beta * d2 ** (alpha / 2)
    pull = (alpha * (mean - count) / d2)[:, None] * diff
    grad = np.stack([np.bincount(i, pull[:, k], len(at)) - np.bincount(j, pull[:, k], len(at)) for k in range(3)], axis=1)
    return float((mean - count * np.log(mean)).sum()), grad.ravel()


def best_scale(d: np.ndarray, count: np.ndarray, alpha: float) -> float:
    return float(count.sum() / max((d**alpha).sum(), 1e-300))


def best_exponent(d: np.ndarray, count: np.ndarray, alpha: float, low: float = -100.0, high: float = 0.01, rounds: int = 60) -> float:
    """The likeliest exponent at the likeliest scale: where counts and expected counts have the same mean log distance."""
    logs = np.log(d)

    def excess(a: float) -> float:
        e = a * logs
        w = np.exp(e - e.max())
        return float((count * logs).sum() / count.sum() - (w * logs).sum() / w.sum())

    lo, hi = max(low, alpha - 20), min(high, alpha + 20)
    for _ in range(rounds):  # the mean log distance of expected counts rises with the exponent
        middle = (lo + hi) / 2
        lo, hi = (middle, hi) if excess(middle) > 0 else (lo, middle)
    return (lo + hi) / 2


def scaled_paths(wish: np.ndarray) -> np.ndarray:
    """Places in space by classical scaling of the shortest paths over wished distances (infinite where there is none)."""
    d = wish.copy()
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        np.minimum(d, d[:, k, None] + d[None, k], out=d)
    d = np.where(np.isfinite(d), d, np.nanmax(np.where(np.isfinite(d), d, np.nan)) * 2)
    d2 = d * d
    gram = -0.5 * (d2 - d2.mean(axis=0) - d2.mean(axis=1)[:, None] + d2.mean())
    values, vectors = np.linalg.eigh(gram)
    return vectors[:, -3:] * np.sqrt(np.maximum(values[-3:], 1e-12))


def coordinates(i: np.ndarray, j: np.ndarray, count: np.ndarray, n: int, alpha: float = -3.0, turns: int = 5, rounds: int = 300) -> np.ndarray:
    """n places in space from which counts are likeliest, if they are Poisson about beta distance^alpha: started by classical
    scaling, then exponent and scale, and places, in turn. Their mean step is 1.1."""
    if n < 4:
        return np.outer(np.arange(n), [1.1, 0, 0])
    wish = np.full((n, n), np.inf)
    wish[i, j] = wish[j, i] = (count / count.mean()) ** (1 / alpha)
    x = scaled_paths(wish)
    x += 1e-3 * np.abs(x).max() * np.sin(np.arange(3 * n).reshape(n, 3) * 1.7)  # no two places alike
    for _ in range(turns):
        d = np.sqrt(np.maximum(((x[i] - x[j]) ** 2).sum(axis=1), 1e-18))
        alpha = best_exponent(d, count, alpha)
        beta = best_scale(d, count, alpha)
        old, x = x, quasi_newton(lambda v, a=alpha, b=beta: contact_likelihood(v, i, j, count, a, b), x.ravel(), rounds).reshape(n, 3)
        if np.abs(x - old).max() < 1e-4 * np.abs(x).max():
            break
    step = np.sqrt((np.diff(x, axis=0) ** 2).sum(axis=1)).mean()
    return (x - x.mean(axis=0)) / max(step, 1e-12) * 1.1


def match_once(a: np.ndarray, b: np.ndarray, tolerance: float) -> list[tuple[int, int]]:
    """Pairs of rows (p1, p2): each row of a, in order, with the row of b nearest to it, if that is within min(a fifth of
    |p1 - p2|, tolerance) and no row before took it."""
    taken, out = set(), []
    for k, (p1, p2) in enumerate(a):
        d = np.hypot(b[:, 0] - p1, b[:, 1] - p2) if len(b) else np.zeros(0)
        best = int(d.argmin()) if len(d) else -1
        if best >= 0 and d[best] <= min(abs(p1 - p2) * 0.2, tolerance) and best not in taken:
            taken.add(best)
            out.append((k, best))
    return out


def stretches(flags: np.ndarray, seed: int = 2, gap: int = 1, least: int = 5) -> list[tuple[int, int]]:
    """[start, end) of runs of true values: seeds of `seed` or more, joined over gaps up to `gap`, of `least` or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
    runs = [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= seed]
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if b - a >= least]


def blurred(matrix: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """A matrix blurred by a Gaussian along both sides, cut at four sigmas, edges mirrored."""
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    for axis in (0, 1):
        n = matrix.shape[axis]
        at = np.mod(np.arange(-reach, n + reach), 2 * n)
        wide = np.take(matrix, np.where(at < n, at, 2 * n - 1 - at), axis)
        matrix = sum(w * np.take(wide, np.arange(d, d + n), axis) for d, w in enumerate(k / k.sum()))
    return matrix


#: Rows and columns with contacts that a block needs for bounds (fixed value).
LEAST_FILLED = 10


def sign_stretches(rows: np.ndarray) -> tuple[list[tuple[int, int]], float]:
    """Stretches of one sign of the first principal component of the rows' blurred correlations, and the component's share
    of the variance."""
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.corrcoef(rows)
    if not np.isfinite(c).all():
        return [], 0.0
    c = blurred(c)
    c = c - c.mean(axis=0)
    values, vectors = np.linalg.eigh(c @ c.T)
    pc = vectors[:, -1] * np.sqrt(max(values[-1], 0))
    return sorted(stretches(pc >= 0) + stretches(pc <= 0)), float(values[-1] / max(values.sum(), 1e-300))


def induced_bounds(inter: np.ndarray) -> tuple[int, int, float, float]:
    """(up, down, up_share, down_share) of contacts between the rows before a junction and the columns after it: the row
    from which and the column up to which, not included, they are induced by the junction. These are the outermost
    stretches next to it of one sign, seen from the junction; the ends of the block where it is too empty."""
    rows, columns = np.flatnonzero(inter.sum(axis=1)), np.flatnonzero(inter.sum(axis=0))
    up, down, shares = 0, inter.shape[1] - 1, [0.0, 0.0]
    if min(len(rows), len(columns)) >= LEAST_FILLED:
        filled = inter[np.ix_(rows, columns)]
        found, shares[0] = sign_stretches(filled)
        if found:
            up = int(rows[found[-1][0]])
        found, shares[1] = sign_stretches(filled.T)
        if found:
            down = int(columns[found[0][1] - 1])
    return up, down, *shares


def block_bounds(matrix: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of one sign of the first principal component of a block's correlated rows, smoothed."""
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.nan_to_num(np.corrcoef(matrix))
    c = blurred(c)
    c = c - c.mean(axis=0)
    pc = np.linalg.eigh(c @ c.T)[1][:, -1]
    return sorted(stretches(pc > 0) + stretches(pc < 0))
