"""Numeric kernels on numpy arrays, and their grouped DataFrame forms.

Written from the published methods: direct linear transform and Gauss-Newton for triangulation and
resection, robust estimation (vistrack.functions.robust, seeded by the group's id) for fundamental
matrices and poses. Groups are one track, one pair or one image, never larger.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistrack.functions import geometry, robust
from vistrack.session import join_checked, parts_for, stored

MAX_ERROR, MIN_ANGLE, PI = 5.0, 2.0, 3.1416


def fundamental(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """F of two 3x4 projections with unit Frobenius norm: x2' F x1 = 0."""
    center = np.linalg.svd(p1)[2][-1]
    e = p2 @ center
    cross = np.array([[0, -e[2], e[1]], [e[2], 0, -e[0]], [-e[1], e[0], 0]])
    f = cross @ p2 @ np.linalg.pinv(p1)
    return f / np.linalg.norm(f)


def invert_distortion(k1: float, k2: float, radius: float, degree: int = 5, samples: int = 20) -> np.ndarray:
    """Coefficients (constant first) of r as a polynomial in r (1 + k1 r^2 + k2 r^4)."""
    r = np.linspace(0, radius, samples)
    d = r * (1 + k1 * r**2 + k2 * r**4)
    return np.linalg.lstsq(np.vander(d, degree + 1, increasing=True), r, rcond=None)[0]


def undistort(xy: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    r = np.linalg.norm(xy, axis=1)
    s = np.where(r > 0, np.polynomial.polynomial.polyval(r, coefficients) / np.maximum(r, 1e-300), 1.0)
    return xy * s[:, None]


def straighten(xy: np.ndarray, k1, k2, rounds: int = 20) -> np.ndarray:
    """Points without distortion: the radius solved by Newton's method, all points at once."""
    d = np.linalg.norm(xy, axis=1)
    r = d.copy()
    for _ in range(rounds):
        r2 = r * r
        slope = 1 + 3 * k1 * r2 + 5 * k2 * r2 * r2
        r = r - (r * (1 + k1 * r2 + k2 * r2 * r2) - d) / np.where(np.abs(slope) < 1e-6, 1.0, slope)
    return xy * np.where(d > 0, r / np.maximum(d, 1e-300), 1.0)[:, None]


def project(r: np.ndarray, t: np.ndarray, f, k1, k2, x: np.ndarray) -> np.ndarray:
    """Image points of x (n x 3) by cameras r (n x 3 x 3), t (n x 3)."""
    c = np.einsum("nij,nj->ni", r, x) + t
    p = -c[:, :2] / np.where(c[:, 2:] == 0, 1e-12, c[:, 2:])
    r2 = (p**2).sum(1)
    return p * (f * (1 + k1 * r2 + k2 * r2**2))[:, None]


def triangulate_many(xy: np.ndarray, r: np.ndarray, t: np.ndarray, f: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, RMS errors, in front of all, largest ray angles in degrees) of g tracks of n observations:
    xy (g, n, 2), r (g, n, 3, 3), t (g, n, 3), the rest (g, n). Tracks with a value that is not finite
    get NaN and are not in front."""
    g, n = f.shape

    def residuals(x: np.ndarray, on: np.ndarray) -> np.ndarray:
        """(tracks, 2n) of the tracks ``on``."""
        flat = project(r[on].reshape(-1, 3, 3), t[on].reshape(-1, 3), f[on].ravel(), k1[on].ravel(), k2[on].ravel(), np.repeat(x, n, 0))
        return flat.reshape(len(on), 2 * n) - xy[on].reshape(len(on), 2 * n)

    x = np.full((g, 3), np.nan)
    with np.errstate(all="ignore"):
        norm = straighten((xy / f[..., None]).reshape(-1, 2), k1.ravel(), k2.ravel()).reshape(g, n, 2)
        m = np.concatenate([r, t[..., None]], 3)
        rows = (norm[..., None] * m[:, :, 2:3] + m[:, :, :2]).reshape(g, 2 * n, 4)
        on = np.flatnonzero(np.isfinite(rows).all((1, 2)))
        h = np.linalg.svd(rows[on], full_matrices=n < 2)[2][:, -1]
        x[on] = h[:, :3] / np.where(np.abs(h[:, 3:]) > 1e-12, h[:, 3:], 1e-12)
        for _ in range(10):  # Gauss-Newton on the reprojection error, of the tracks that still move
            base = residuals(x[on], on)
            jac = np.stack([residuals(x[on] + 1e-6 * np.eye(3)[k], on) - base for k in range(3)], 2) / 1e-6
            sound = np.isfinite(base).all(1) & np.isfinite(jac).all((1, 2))
            on, base, jac = on[sound], base[sound], jac[sound]
            if not len(on):
                break
            step = -np.einsum("gij,gj->gi", np.linalg.pinv(jac, rcond=2 * n * np.finfo(float).eps), base)
            x[on] += step
            on = on[np.abs(step).max(1) >= 1e-10]
        every = np.arange(g)
        err = np.sqrt((residuals(x, every) ** 2).sum(1) / n)
        front = ((np.einsum("gnij,gj->gni", r, x) + t)[..., 2] <= 0).all(1)
        rays = x[:, None] + np.einsum("gnji,gnj->gni", r, t)
        rays /= np.linalg.norm(rays, axis=2)[..., None]
        least, some = np.full(g, 1.0), max(1, BLOCK // max(1, g * n))
        for i in range(0, n, some):
            least = np.minimum(least, np.einsum("gik,gjk->gij", rays[:, i : i + some], rays).min((1, 2)))
    return x, err, front, np.degrees(np.arccos(np.clip(least, -1, 1))) * np.pi / PI


def triangulate(xy: np.ndarray, r: np.ndarray, t: np.ndarray, f: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, float, bool, float]:
    """The same of one track."""
    x, err, front, angle = triangulate_many(*(np.asarray(v)[None] for v in (xy, r, t, f, k1, k2)))
    return x[0], float(err[0]), bool(front[0]), float(angle[0])


TRACK = "track long, x double, y double, z double, n long, err double, front boolean, angle double"
#: Observations, and cosines of ray pairs, that one numpy call holds.
CHUNK, BLOCK = 100_000, 2_000_000


def triangulate_tracks(obs: DataFrame, cameras: DataFrame, max_error: float = MAX_ERROR, min_angle: float | None = MIN_ANGLE, keep_all: bool = False) -> DataFrame:
    """One row per track of obs (track, view, x, y) with cameras (view, f, k1, k2, r[9], t[3]).

    Kept: more than one view, RMS error within max_error, in front of all cameras and, unless None,
    an angle of at least min_angle degrees. keep_all returns all, for their errors.

    Observations of cameras without r or t, or without a camera, do not count. Tracks are gathered by
    one aggregation, and numpy takes tracks of equal length together. A null or infinite coordinate
    gives its track an error of NaN, which no limit admits.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            size = b.column(1).value_lengths().to_numpy().astype(np.int64)
            first, o = np.cumsum(size) - size, b.column(1).flatten()
            one = {c: o.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "f", "k1", "k2")}
            r = o.field("r").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
            t = o.field("t").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            xy = np.stack([one["x"], one["y"]], 1)
            x, err, front, angle = np.empty((len(size), 3)), np.empty(len(size)), np.empty(len(size), bool), np.empty(len(size))
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                for i in range(0, len(own), max(1, CHUNK // n)):
                    some = own[i : i + max(1, CHUNK // n)]
                    at = first[some][:, None] + np.arange(n)
                    x[some], err[some], front[some], angle[some] = triangulate_many(xy[at], r[at], t[at], one["f"][at], one["k1"][at], one["k2"][at])
            cols = [b.column(0), *map(pa.array, (x[:, 0], x[:, 1], x[:, 2], size, err, front, angle))]
            yield pa.RecordBatch.from_arrays(cols, names=["track", "x", "y", "z", "n", "err", "front", "angle"])

    number = [F.col(c).cast("double").alias(c) for c in ("x", "y", "f", "k1", "k2")]
    placed = obs.join(cameras.where("r IS NOT NULL AND t IS NOT NULL"), "view")
    one = F.struct("view", *number, *(F.col(c).cast("array<double>").alias(c) for c in ("r", "t")))
    gathered = placed.groupBy(F.col("track").cast("long").alias("track")).agg(F.sort_array(F.collect_list(one)).alias("o")).where(F.size("o") > 1)
    found = gathered.mapInArrow(run, TRACK)
    if keep_all:
        return found
    found = found.where(f"NOT isnan(err) AND err <= {max_error} AND front")
    return found if min_angle is None else found.where(f"angle >= {min_angle}")


def point_errors(points: DataFrame, obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """(track, n, err, front) of given points (track, x, y, z): RMS distance in the image of their observations
    (track, view, x, y) to the projections by the cameras, as column expressions; front: in front of all. Null errors
    for points in a camera plane."""
    p = points.select("track", *[F.col(c).cast("double").alias(f"p{c}") for c in "xyz"])
    seen = obs.join(p, "track").join(cameras.where("r IS NOT NULL AND t IS NOT NULL").select("view", "f", "k1", "k2", "r", "t"), "view")
    at = lambda c, n: [F.get(c, F.lit(i)) for i in range(n)]
    x, y, front = geometry.project(at("r", 9), at("t", 3), F.col("f"), F.col("k1"), F.col("k2"), [F.col("px"), F.col("py"), F.col("pz")])
    d = seen.select("track", front.alias("front"), ((x - F.col("x")) ** 2 + (y - F.col("y")) ** 2).alias("d"))
    return d.groupBy("track").agg(F.count("*").alias("n"), F.when(F.count("d") == F.count("*"), F.sqrt(F.avg("d"))).alias("err"), F.bool_and("front").alias("front"))


#: Pairs with enough matches that are broadcast at most (two ids each).
PAIRS = 1_000_000


def estimate_fundamental(matches: DataFrame, **options) -> DataFrame:
    """(a, b, n, f[9], inliers) per pair of n matches (a, b, xa, ya, xb, yb); pairs without an F drop out. Matches with a
    coordinate that is not finite do not count as inliers. A pair is estimated whole (vistrack.functions.robust); pairs
    that cannot have as many inliers as an F needs are told by a count and never gathered."""

    def run(table):
        import pyarrow as pa

        a, b = table["a"][0].as_py(), table["b"][0].as_py()
        m = np.stack([table[c].to_numpy(zero_copy_only=False) for c in ("xa", "ya", "xb", "yb")], 1)
        m = m[np.isfinite(m).all(1)]
        m = m[np.lexsort(m.T[::-1])]
        f, own = robust.fundamental_of(m[:, :2], m[:, 2:], a * 1_000_003 + b, **options)
        rows = [{"a": a, "b": b, "f": f.ravel().tolist(), "inliers": int(own.sum())}] if f is not None else []
        return pa.Table.from_pylist(rows, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("f", pa.list_(pa.float64())), ("inliers", pa.int64())]))

    at = [F.col(c).cast("double").alias(c) for c in ("xa", "ya", "xb", "yb")]
    some = matches.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), *at)
    sound = ~F.greatest(*(F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)) for c in ("xa", "ya", "xb", "yb")))
    counts = some.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(sound).alias("sound"))
    counts = stored(counts.where(F.col("sound") >= max(8, options.get("least", robust.LEAST))).select("a", "b", "n"), "fundamental-pairs")
    large = join_checked(some, counts.select("a", "b"), ["a", "b"], "left_semi", limit=PAIRS)
    found = large.groupBy("a", "b").applyInArrow(run, "a long, b long, f array<double>, inliers long")
    return found.join(counts, ["a", "b"]).select("a", "b", "n", "f", "inliers")


def projection_dlt(xy: np.ndarray, x: np.ndarray) -> np.ndarray:
    return robust.projections(xy[None], x[None])[0]


def decompose(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K (positive focal lengths, K[2,2] = 1), R (proper) and t with a camera that looks down -z."""
    m = p[:, :3] * np.sign(np.linalg.det(p[:, :3]))
    p = p * np.sign(np.linalg.det(p[:, :3]))
    q, u = np.linalg.qr(np.flipud(m).T)
    k, r = np.fliplr(np.flipud(u.T)), np.flipud(q.T)
    s = np.diag(np.sign(np.diag(k)))
    k, r = k @ s, s @ r
    t = np.linalg.solve(k, p[:, 3])
    turn = np.diag([1.0, -1.0, -1.0])  # from +z with y down to -z with y up
    return k / k[2, 2], turn @ r, turn @ t


def _rodrigues(w: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(w)
    if a < 1e-12:
        return np.eye(3)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]]) / a
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def refine_camera(xy: np.ndarray, x: np.ndarray, r: np.ndarray, t: np.ndarray, f: float, k1: float = 0.0, k2: float = 0.0, rounds: int = 20) -> tuple:
    """Fit camera parameters, drop points whose error reaches clamp(2.4 * 95th percentile, 8, 16), until
    no more drop. Returns r, t, f, k1, k2 and the mask of points kept."""
    keep = np.ones(len(xy), bool)

    def residual(p, own):
        rr = _rodrigues(p[:3]) @ r
        n = int(own.sum())
        return (project(np.repeat(rr[None], n, 0), np.repeat((t + p[3:6])[None], n, 0), f + p[6] * f, k1 + p[7], k2 + p[8], x[own]) - xy[own]).ravel()

    p = np.zeros(9)
    for _ in range(rounds):
        damp = 1e-3
        res = residual(p, keep)
        for _ in range(15):
            jac = np.stack([(residual(p + 1e-6 * np.eye(9)[i], keep) - res) / 1e-6 for i in range(9)], 1)
            step = np.linalg.solve(jac.T @ jac + damp * np.diag(np.maximum(1e-9, (jac**2).sum(0))), -jac.T @ res)
            new = residual(p + step, keep)
            if (new**2).sum() < (res**2).sum():
                done = (res**2).sum() - (new**2).sum() < 1e-9 * (1 + (res**2).sum())
                p, res, damp = p + step, new, damp / 5
                if done:
                    break
            else:
                damp *= 10
        err = np.linalg.norm(residual(p, np.ones(len(xy), bool)).reshape(-1, 2), axis=1)
        own = np.sort(err[keep])
        limit = min(16.0, max(8.0, 2.4 * own[min(len(own) - 1, round(0.95 * len(own)))]))
        now = keep & (err < limit)
        if now.sum() == keep.sum() or now.sum() < 6:
            break
        keep = now
    return _rodrigues(p[:3]) @ r, t + p[3:6], f + p[6] * f, k1 + p[7], k2 + p[8], keep


def register(xy: np.ndarray, x: np.ndarray, seed: int, rounds: int = 4096, threshold: float = 4.0, least: int = 12) -> dict | None:
    """Camera of one image from 2D-3D correspondences, None if fewer than half or ``least`` agree, focal
    lengths differ by 1.4 or more, or a tenth of the points lies behind."""
    if len(xy) < 9:
        return None
    flip = xy * np.array([1.0, -1.0])  # y down for the linear camera
    if robust.hopeless(flip, x, max(6, least, -(-len(xy) // 2)), seed, threshold):
        return None
    _, best = robust.projection_of(flip, x, seed, rounds, threshold)
    if best.sum() < max(6, least):
        return None
    k, r, t = decompose(projection_dlt(flip[best], x[best]))
    if max(k[0, 0] / k[1, 1], k[1, 1] / k[0, 0]) >= 1.4:
        return None
    at = np.flatnonzero(best)
    r, t, f, k1, k2, keep = refine_camera(xy[at], x[at], r, t, (k[0, 0] + k[1, 1]) / 2)
    front = ((x[at][keep] @ r.T + t)[:, 2] <= 0).mean()
    if keep.sum() < least or keep.sum() < 0.5 * len(xy) or front < 0.9:
        return None
    return {"f": float(f), "k1": float(k1), "k2": float(k2), "r": r.ravel().tolist(), "t": t.tolist(), "inliers": int(keep.sum())}


def verify_camera(p: np.ndarray, xy: np.ndarray, x: np.ndarray, threshold: float = 16.0, least: int = 12) -> dict | None:
    """A given projection matrix (y down, +z ahead) held against correspondences: camera and mask of the points
    within the threshold, None if fewer than ``least`` or half agree, the focal lengths differ by 1.4 or more,
    or a tenth of the points lies behind."""
    k, r, t = decompose(np.asarray(p, float).reshape(3, 4))
    if not np.isfinite(k).all() or max(k[0, 0] / k[1, 1], k[1, 1] / k[0, 0]) >= 1.4:
        return None
    f = (k[0, 0] + k[1, 1]) / 2
    n = len(x)
    err = np.linalg.norm(project(np.repeat(r[None], n, 0), np.repeat(t[None], n, 0), f, 0.0, 0.0, x) - xy, axis=1)
    keep = err < threshold
    front = ((x[keep] @ r.T + t)[:, 2] <= 0).mean() if keep.any() else 0.0
    if keep.sum() < least or keep.sum() < 0.5 * n or front < 0.9:
        return None
    return {"f": float(f), "r": r.ravel().tolist(), "t": t.tolist(), "inliers": int(keep.sum()), "keep": keep}


def register_images(corr: DataFrame, **options) -> DataFrame:
    """Cameras (view, f, k1, k2, r, t, inliers) of images from corr (view, x, y, px, py, pz)."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["x", "y", "px"])
        got = register(pdf[["x", "y"]].to_numpy(float), pdf[["px", "py", "pz"]].to_numpy(float), int(pdf["view"].iloc[0]), **options)
        cols = ["view", "f", "k1", "k2", "r", "t", "inliers"]
        return pd.DataFrame([{"view": pdf["view"].iloc[0], **got}] if got else [], columns=cols)

    # dealt to a stated number of tasks: an image's points are few bytes and much work, which joining small partitions would not see
    dealt = corr.repartition(parts_for(corr.sparkSession, 0, 1), "view")
    return dealt.groupBy("view").applyInPandas(run, "view long, f double, k1 double, k2 double, r array<double>, t array<double>, inliers long")
