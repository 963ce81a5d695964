"""Robust estimation from matches with outliers: hypotheses in stacks, a sequential test, local optimisation.

Hypotheses come in blocks: the samples of a block are drawn at once and solved by one stacked decomposition. A block is
held against the points in a fixed random order, part by part; after each part Wald's sequential probability ratio
test gives up the hypotheses that are likelier bad than good by a factor of ODDS, so most see few points. A new best
one is refitted to its inliers while their number grows (local optimisation). Rounds end when a better sample
would have been met with a probability of SURE, given the share of inliers of the best so far.

All randomness is seeded by the caller, so results depend on the points alone.
"""

from __future__ import annotations

import numpy as np

#: Odds against a hypothesis at which it is dropped, share of points that fit a bad one, least share of inliers
#: looked for, certainty of the end, hypotheses of the first and of later blocks, points of the parts.
ODDS, CHANCE, SHARE, SURE, FIRST, BLOCK, PART = 1000.0, 0.05, 0.2, 0.9999, 12, 96, 48
#: Blocks screened together at most; steps of the quick solution, distance to its limit at which it is taken, and
#: the threshold it is held against, as a multiple.
TOGETHER, STEPS, CLOSE, WIDER = 6, 16, 1e-9, 1.1
#: Points of a sample that is held against all cameras, samples drawn together, chance of a wrong verdict at each look,
#: the squared threshold it is held against, as a multiple, the share of samples below which too many would be needed.
HELD, LOOK, RARE, SLACK, SCARCE = 8, 512, 1e-9, 1.5, 1 / 512
#: Inliers of a fundamental matrix at least.
LEAST = 27


def picks(rng: np.random.Generator, n: int, size: int, count: int) -> np.ndarray:
    """count samples of ``size`` different ones of n."""
    if n < 4 * size:
        return rng.random((count, n)).argsort(1)[:, :size]
    got, bad, (i, j) = rng.integers(0, n, (count, size)), np.arange(count), np.triu_indices(size, 1)
    while True:
        bad = bad[(got[bad][:, i] == got[bad][:, j]).any(1)]
        if not len(bad):
            return got
        got[bad] = rng.integers(0, n, (len(bad), size))


def survivors(models: np.ndarray, errors, n: int, order: np.ndarray, threshold: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the models that pass the sequential test, and their inliers (models, n)."""
    alive, fits = np.arange(len(models)), np.zeros((len(models), 0), bool)
    odds = np.zeros(len(models))
    inside, outside = np.log(CHANCE / share), np.log((1 - CHANCE) / (1 - min(share, 0.99)))
    for at in range(0, n, PART):
        own = errors(models[alive], order[at : at + PART]) < threshold
        odds = odds + own.sum(1) * inside + (~own).sum(1) * outside
        good = odds < np.log(ODDS)
        alive, odds, fits = alive[good], odds[good], np.concatenate([fits, own], 1)[good]
        if not len(alive):
            break
    back = np.empty(n, int)
    back[order] = np.arange(n)
    return alive, fits[:, back] if len(alive) else np.zeros((0, n), bool)


def consensus(n: int, size: int, solve, errors, refit, seed: int, rounds: int, threshold: float, tested: bool = True, screen=None) -> tuple[np.ndarray | None, np.ndarray, int]:
    """(model, inliers, hypotheses drawn). solve(samples) gives stacked models, errors(models, points) the errors
    (models, points), refit(inliers) one model. tested: with the sequential test. screen(samples, order, share) tells which
    samples' models may pass that test: it spares solving the others and changes no result. Blocks are screened
    together, ever more of them while no end is in sight."""
    rng, best, model = np.random.default_rng(seed), np.zeros(n, bool), None
    order, drawn, need = rng.permutation(n), 0, rounds
    every, ahead, together = np.arange(n), [], 1
    screen = screen if tested else None
    while drawn < min(need, rounds):
        if not ahead:
            at, held = drawn, None
            while at < rounds and len(ahead) < together:
                ahead.append(picks(rng, n, size, min(BLOCK if at else FIRST, rounds - at)))
                at += len(ahead[-1])
            together = min(2 * together, TOGETHER) if screen else 1
        share = max(SHARE, best.mean())
        if held != share:  # the test of what was drawn ahead holds for one share
            samples, block, held, now = np.concatenate(ahead), np.repeat(np.arange(len(ahead)), [len(a) for a in ahead]), share, 0
            if screen:
                may = screen(samples, order, share)
                samples, block = samples[may], block[may]
                if may.mean() > 0.5:  # most are solved anyway
                    screen = None
            models = solve(samples)
            kept, fits = survivors(models, errors, n, order, threshold, share) if tested else (np.arange(len(models)), errors(models, every) < threshold)
            models, block = models[kept], block[kept]
        drawn += len(ahead.pop(0))
        own = np.flatnonzero(block == now)
        now += 1
        if not len(own):
            continue
        top = own[fits[own].sum(1).argmax()]
        if fits[top].sum() <= best.sum():
            continue
        best, model = fits[top], models[top]
        while best.sum() >= size:
            again = refit(best)
            own = errors(again[None], every)[0] < threshold
            if own.sum() <= best.sum():
                break
            best, model = own, again
        hit = best.mean() ** size
        need = 0 if hit >= SURE else int(np.ceil(np.log(1 - SURE) / np.log1p(-hit))) if hit > 0 else rounds
    return model, best, drawn


def normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stacked points (h, n, 2) as (h, n, 3), centered and scaled, and the matrices (h, 3, 3) that do it."""
    c = p.mean(1)
    s = np.sqrt(2) / np.maximum(1e-12, np.linalg.norm(p - c[:, None], axis=2).mean(1))
    t = np.zeros((len(p), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = s
    t[:, :2, 2], t[:, 2, 2] = -s[:, None] * c, 1
    return np.concatenate([p, np.ones((*p.shape[:2], 1))], 2) @ t.transpose(0, 2, 1), t


def eight_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fundamental matrices (h, 3, 3) of unit length from stacked matches (h, n, 2), by the normalised linear method."""
    (x, ta), (y, tb) = normalised(a), normalised(b)
    rows = np.einsum("hni,hnj->hnij", y, x).reshape(*a.shape[:2], 9)
    f = np.linalg.svd(rows, full_matrices=a.shape[1] < 9)[2][:, -1].reshape(-1, 3, 3)
    u, s, v = np.linalg.svd(f)
    s[:, 2] = 0
    f = tb.transpose(0, 2, 1) @ (u * s[:, None] @ v) @ ta
    return f / np.maximum(1e-300, np.linalg.norm(f, axis=(1, 2)))[:, None, None]


def epipolar_errors(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(models, points): the larger of the two point-line distances of matches of rows (n, 3)."""
    l2, l1 = a @ f.transpose(0, 2, 1), b @ f
    d = np.abs((l2 * b).sum(2))
    return np.maximum(d / np.maximum(1e-12, np.hypot(l2[..., 0], l2[..., 1])), d / np.maximum(1e-12, np.hypot(l1[..., 0], l1[..., 1])))


def fundamental_of(a: np.ndarray, b: np.ndarray, seed: int, rounds: int = 1024, threshold: float = 4.0, least: int = LEAST, tested: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """(F, inliers) of matches a, b (n, 2), F None with fewer than ``least`` inliers."""
    if len(a) < max(8, least):
        return None, np.zeros(len(a), bool)
    x, y = (np.hstack([p, np.ones((len(p), 1))]) for p in (a, b))
    refit = lambda own: eight_points(a[own][None], b[own][None])[0]
    f, own, _ = consensus(len(a), 8, lambda s: eight_points(a[s], b[s]), lambda m, at: epipolar_errors(m, x[at], y[at]), refit, seed, rounds, threshold, tested)
    return (f, own) if f is not None and own.sum() >= least else (None, own)


def projections(xy: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Projection matrices (h, 3, 4) of stacked points (h, n, 2) and (h, n, 3), by the linear method."""
    h = np.concatenate([x, np.ones((*x.shape[:2], 1))], 2)
    z = np.zeros_like(h)
    rows = np.concatenate([np.concatenate([h, z, -xy[..., :1] * h], 2), np.concatenate([z, h, -xy[..., 1:] * h], 2)], 1)
    return np.linalg.svd(rows, full_matrices=rows.shape[1] < 12)[2][:, -1].reshape(-1, 3, 4)


def eliminated(m: np.ndarray) -> np.ndarray:
    """Triangular factors, in one array, of symmetric positive matrices (k, k, h)."""
    m = m.copy()
    for j in range(len(m) - 1):
        m[j + 1 :, j] /= m[j, j]
        m[j + 1 :, j + 1 :] -= m[j + 1 :, None, j] * m[None, j, j + 1 :]
    return m


def solved(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions (k, c, h) for right sides b (k, c, h) by the factors."""
    y = b.copy()
    for j in range(len(m) - 1):
        y[j + 1 :] -= m[j + 1 :, j, None] * y[j]
    for j in range(len(m) - 1, -1, -1):
        y[j] /= m[j, j]
        y[:j] -= m[:j, j, None] * y[j]
    return y


def products(z: np.ndarray, uv: np.ndarray) -> np.ndarray:
    """(n, 64): the products of coordinates z (4, n) of each point, also times u, v and u u + v v of uv (2, n)."""
    both = z[:, None] * z
    return np.stack([both, both * uv[0], both * uv[1], both * (uv**2).sum(0)]).reshape(64, -1).T.copy()


def summed(sums: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """The products (4, 4, 4, h), summed over each sample's points."""
    total = sums[samples[:, 0]]
    for j in range(1, samples.shape[1]):
        total += sums[samples[:, j]]
    return np.ascontiguousarray(total.T).reshape(4, 4, 4, -1)


def hopeless(xy: np.ndarray, x: np.ndarray, least: int, seed: int, threshold: float) -> bool:
    """Whether no projection matrix at all has ``least`` points within the threshold, wrong in less than one case of 10^7.

    A camera with so many would hold a known share of all samples of HELD points. Some camera may hold a sample only if, the
    first two rows of the matrix eliminated, the algebraic residual can be as small for some third row as points within
    the threshold allow: where residual less allowance is positive definite no camera does. Samples
    are drawn until far fewer can be held than the share demands (Chernoff's bound), or not. Not told for images of few points,
    of which the share is small."""
    n = len(x)
    share = float(np.prod([(least - i) / (n - i) for i in range(HELD)])) if HELD <= least <= n else 0.0
    if share < SCARCE:
        return False
    rng, drawn, fit, i = np.random.default_rng(seed), 0, 0, np.arange(4)
    z = np.hstack([(x - x.mean(0)) / max(1e-12, x.std()), np.ones((n, 1))]).T
    far = max(1e-12, (xy - xy.mean(0)).std())
    sums, allowed = products(z, ((xy - xy.mean(0)) / far).T), SLACK * (threshold / far) ** 2
    while drawn * share < -2 * np.log(RARE):
        k, hu, hv, w = summed(sums, picks(rng, n, HELD, LOOK))
        with np.errstate(all="ignore"):
            f = eliminated(k)
            eu, ev, w = solved(f, hu), solved(f, hv), w - allowed * k
            for j in range(4):
                w = w - hu[:, None, j] * eu[None, j] - hv[:, None, j] * ev[None, j]
            sound = f[i, i].min(0) > 1e-8 * f[i, i].max(0)  # points in a plane tell nothing
            fit += int((~(sound & (eliminated(w)[i, i] > 0).all(0))).sum())
        drawn += LOOK
        due = share * drawn
        if fit > due + 3 * np.sqrt(due):
            return False
        if fit < due and fit - due - (fit * np.log(fit / due) if fit else 0) < np.log(RARE):
            return True
    return False


class Screen:
    """Which samples of an image's correspondences have a projection matrix that may pass the sequential test.

    The matrix of ``projections`` is the eigenvector of the least eigenvalue of A'A, whose blocks are sums over the sample's
    points of products of their coordinates; it comes from inverse iteration, all samples at once, in scaled coordinates.
    A sample is refused only if the steps have come within CLOSE of their limit and the test gives up the matrix even
    with a WIDER threshold, which leaves it no fewer inliers. All others are solved as ever, so results are the same."""

    def __init__(self, xy: np.ndarray, x: np.ndarray, threshold: float):
        self.xy, self.h, self.threshold = xy, np.hstack([x, np.ones((len(x), 1))]), threshold
        middle, far, self.wide = x.mean(0), max(1e-12, x.std()), max(1e-12, np.abs(xy).max())
        self.back = np.linalg.inv(np.block([[far * np.eye(3), middle[:, None]], [np.zeros((1, 3)), 1]]))
        z, uv = (self.h @ self.back.T).T, xy.T / self.wide
        self.sums = products(z, uv)

    def matrices(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(projection matrices (h, 3, 4), which of them are close to their limit)."""
        k, hu, hv, w = summed(self.sums, samples)
        k = eliminated(k)
        eu, ev = solved(k, hu), solved(k, hv)
        for j in range(4):
            w = w - hu[:, None, j] * eu[None, j] - hv[:, None, j] * ev[None, j]
        w = eliminated(w)
        metric, weight = self.back @ self.back.T, np.array([self.wide**2, self.wide**2, 1.0])[:, None]
        q, out, moved = np.ones((4, 3, len(samples))), np.zeros((len(samples), 3, 4)), np.full(len(samples), np.inf)
        left, close = np.arange(len(samples)), np.zeros(len(samples), bool)
        for step in range(STEPS):
            b = (metric @ q.reshape(4, -1)).reshape(q.shape) * weight
            z = solved(k, b[:, :2])
            last = solved(w, b[:, 2:] + ((hu * z[:, 0]).sum(1) + (hv * z[:, 1]).sum(1))[:, None])
            new = np.concatenate([z + np.stack([(eu * last[:, 0]).sum(1), (ev * last[:, 0]).sum(1)], 1), last], 1)
            new *= np.sign((new * q).sum((0, 1))) / np.sqrt((new**2).sum((0, 1)))
            move = np.sqrt(((new - q) ** 2).sum((0, 1)))
            rate = move / moved
            q, moved = new, move
            done = (move * rate < CLOSE * (1 - rate)) & (rate < 0.95) if step > 1 else np.zeros(len(left), bool)
            if done.any():
                close[left[done]] = True
                out[left[done]] = q[:, :, done].T
                left, q, moved = left[~done], q[:, :, ~done], moved[~done]
                k, w, hu, hv, eu, ev = (a[:, :, ~done] for a in (k, w, hu, hv, eu, ev))
            if not len(left):
                break
        return out * np.array([self.wide, self.wide, 1.0])[:, None] @ self.back, close

    def __call__(self, samples: np.ndarray, order: np.ndarray, share: float) -> np.ndarray:
        may = np.ones(len(samples), bool)
        with np.errstate(all="ignore"):
            p, close = self.matrices(samples)
            at = np.flatnonzero(close)
            kept, _ = survivors(p[at], lambda m, i: projection_errors(m, self.xy[i], self.h[i]), len(order), order, WIDER * self.threshold, share)
        may[at] = False
        may[at[kept]] = True
        return may


def projection_errors(p: np.ndarray, xy: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(models, points): distances of points h (n, 4), projected, to xy."""
    q = (p.reshape(-1, 4) @ h.T).reshape(len(p), 3, len(h))
    w = np.where(np.abs(q[:, 2]) < 1e-12, 1e-12, q[:, 2])
    return np.sqrt((q[:, 0] / w - xy[:, 0]) ** 2 + (q[:, 1] / w - xy[:, 1]) ** 2)


def projection_of(xy: np.ndarray, x: np.ndarray, seed: int, rounds: int = 4096, threshold: float = 4.0, tested: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """(P, inliers) of an image's correspondences."""
    h = np.hstack([x, np.ones((len(x), 1))])
    refit = lambda own: projections(xy[own][None], x[own][None])[0]
    p, own, _ = consensus(len(xy), 6, lambda s: projections(xy[s], x[s]), lambda m, at: projection_errors(m, xy[at], h[at]), refit, seed, rounds, threshold, tested, Screen(xy, x, threshold))
    return p, own
