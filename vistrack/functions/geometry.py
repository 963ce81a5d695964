"""Plane and camera geometry as column expressions.

Conventions: a camera looks down its negative z axis; normalised keypoint coordinates have their
origin in the image center, y up; half sizes are truncated to whole numbers in ``normalize`` and exact
in ``to_norm``/``to_image``; angles use 3.1416 for pi.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PI = 3.1416


def half(n: Column) -> Column:
    return F.floor(n / 2)


def normalize(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x - half(w), half(h) - y


def to_norm(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x - w / 2.0, h / 2.0 - y


def to_image(nx: Column, ny: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return nx + w / 2.0, h / 2.0 - ny


def epipolar_line(f: list[float] | Column, x: Column, y: Column, transposed: bool = False) -> tuple[Column, Column, Column]:
    """Coefficients of F (x, y, 1), or of the transposed matrix; F row by row, as numbers or as an array column."""
    entry = (lambda i: F.get(f, F.lit(i))) if isinstance(f, Column) else (lambda i: F.lit(f[i]))
    at = (lambda r, c: entry(3 * c + r)) if transposed else (lambda r, c: entry(3 * r + c))
    return tuple(at(r, 0) * x + at(r, 1) * y + at(r, 2) for r in range(3))


def product(a: Column, b: Column, transposed: bool = False) -> Column:
    """a b of 3x3 matrices as arrays row by row; transposed: a b'."""
    at = (lambda k, j: F.get(b, F.lit(3 * j + k))) if transposed else (lambda k, j: F.get(b, F.lit(3 * k + j)))
    return F.array(*[sum(F.get(a, F.lit(3 * i + k)) * at(k, j) for k in range(3)) for i in range(3) for j in range(3)])


def fundamental(pairs: DataFrame, one: tuple[str, str, str], two: tuple[str, str, str], size: tuple[float, float] | None = None, name: str = "f") -> DataFrame:
    """pairs with the fundamental matrix of two cameras, x2' F x1 = 0, as an array of nine of unit length.

    one and two name the columns focal length, rotation (nine) and translation (three) of the cameras. Coordinates are
    normalised ones (center, y up), or pixels of images of a size (width, height), the same for both. Null if the
    cameras stand in the same place, or a value is missing.
    """
    (f1, r1, t1), (f2, r2, t2) = one, two
    # each step is the explode of one value, which keeps the plan from writing products out at each of their uses
    step = lambda df, c, value: df.select("*", F.explode(F.array(value)).alias(c))
    p = step(pairs, "_r", product(F.col(r2), F.col(r1), transposed=True))
    turned = [sum(F.get("_r", F.lit(3 * i + k)) * F.get(F.col(t1), F.lit(k)) for k in range(3)) for i in range(3)]
    p = step(p, "_t", F.array(*[F.get(F.col(t2), F.lit(i)) - turned[i] for i in range(3)]))
    x, y, z = (F.get("_t", F.lit(i)) for i in range(3))
    o = F.lit(0.0)
    p = step(p, "_e", product(F.array(o, -z, y, z, o, -x, -y, x, o), F.col("_r")))
    # the camera looks down -z: K = diag(-f, -f, 1)
    k = lambda f, i: F.lit(1.0) if i == 2 else -1.0 / F.col(f)
    p, last = step(p, "_n", F.array(*[k(f2, i) * k(f1, j) * F.get("_e", F.lit(3 * i + j)) for i in range(3) for j in range(3)])), "_n"
    if size:
        w, h = size
        shift = F.array(*map(F.lit, (1.0, 0.0, -w / 2, 0.0, -1.0, h / 2, 0.0, 0.0, 1.0)))
        back = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, -w / 2, h / 2, 1.0)))
        p, last = step(step(p, "_s", product(F.col("_n"), shift)), "_p", product(back, F.col("_s"))), "_p"
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v))
    apart = norm("_t") > 1e-9 * (1.0 + norm(t1) + norm(t2))
    p = step(p, "_l", norm(last))
    p = step(p, name, F.when(apart & (F.col("_l") > 0), F.transform(last, lambda v: v / F.col("_l"))))
    return p.drop("_r", "_t", "_e", "_n", "_s", "_p", "_l")


def line_distance(a: Column, b: Column, c: Column, x: Column, y: Column) -> Column:
    """Null for a line without direction."""
    return F.abs(a * x + b * y + c) / F.nullif(F.sqrt(a * a + b * b), F.lit(0.0))


def line_line(l1: tuple, l2: tuple) -> Column:
    """struct(x, y) where two homogeneous lines meet, null for parallels."""
    den = l1[0] * l2[1] - l1[1] * l2[0]
    return F.when(den != 0, F.struct(((l1[1] * l2[2] - l1[2] * l2[1]) / den).alias("x"), ((l1[2] * l2[0] - l1[0] * l2[2]) / den).alias("y")))


def rectangle_edges(w: float, h: float, centered: bool = False) -> list[tuple[float, float, float]]:
    """Lines of the left, right, top and bottom edge."""
    x0, x1, y0, y1 = (-w / 2, w / 2, -h / 2, h / 2) if centered else (0.0, w, 0.0, h)
    return [(1.0, 0.0, -x0), (1.0, 0.0, -x1), (0.0, 1.0, -y0), (0.0, 1.0, -y1)]


def line_rectangle(a: Column, b: Column, c: Column, w: float, h: float) -> Column:
    """Array of the distinct points where a line crosses the edges of (0,0)-(w,h); null unless two."""
    hits = []
    for x in (0.0, float(w)):
        y = -(a * x + c) / b
        hits.append(F.when((b != 0) & y.between(0.0, float(h)), F.struct(F.lit(x).alias("x"), y.alias("y"))))
    for y in (0.0, float(h)):
        x = -(b * y + c) / a
        hits.append(F.when((a != 0) & x.between(0.0, float(w)), F.struct(x.alias("x"), F.lit(y).alias("y"))))
    found = F.array_distinct(F.filter(F.array(*hits), lambda p: p.isNotNull()))
    return F.when(F.size(found) == 2, found)


def clip_line(a: Column, b: Column, c: Column, w: float, h: float) -> Column:
    """struct(x0, y0, x1, y1): the part of a line inside (0,0)-(w,h), of any slope; null if there is none."""
    n2 = F.nullif(a * a + b * b, F.lit(0.0))
    n = F.sqrt(n2)
    off = (a * (w / 2) + b * (h / 2) + c) / n2
    px, py, dx, dy = F.lit(w / 2) - off * a, F.lit(h / 2) - off * b, -b / n, a / n
    tiny = 1e-12

    def span(p: Column, d: Column, top: float) -> tuple[Column, Column]:
        across = F.abs(d) > tiny
        one, two = -p / F.nullif(d, F.lit(0.0)), (F.lit(top) - p) / F.nullif(d, F.lit(0.0))
        inside = p.between(0.0, top)
        return (F.when(across, F.least(one, two)).when(inside, F.lit(-1e300)).otherwise(1e300), F.when(across, F.greatest(one, two)).when(inside, F.lit(1e300)).otherwise(-1e300))

    (lx, hx), (ly, hy) = span(px, dx, float(w)), span(py, dy, float(h))
    lo, hi = F.greatest(lx, ly), F.least(hx, hy)
    return F.when(n2.isNotNull() & (lo <= hi), F.struct((px + lo * dx).alias("x0"), (py + lo * dy).alias("y0"), (px + hi * dx).alias("x1"), (py + hi * dy).alias("y1")))


def intrinsics(f: Column) -> Column:
    """K of a camera, row by row; the camera looks down -z, which project_guarded divides by."""
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(f, zero, zero, zero, f, zero, zero, zero, one)


def translation(r: Column, position: Column) -> Column:
    """t = -R position, for R as an array of nine."""
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: -(F.get(r, 3 * i) * F.get(position, F.lit(0)) + F.get(r, 3 * i + 1) * F.get(position, F.lit(1)) + F.get(r, 3 * i + 2) * F.get(position, F.lit(2))))


def projection_matrix(f: Column, r: Column, t: Column) -> Column:
    """P = K [R | t], row by row."""
    row = lambda i, s: [s * F.get(r, F.lit(3 * i + j)) for j in range(3)] + [s * F.get(t, F.lit(i))]
    return F.array(*row(0, f), *row(1, f), *row(2, F.lit(1.0)))


def project_guarded(p: Column, f: Column, k1: Column, k2: Column, at: list) -> tuple[Column, Column, Column]:
    """(x, y, ok) of a point by P. Radial terms are left out where they extrapolate badly: beyond a squared
    radius of 8 or with a negative factor. ok: in front. All null in the camera plane."""
    x, y, depth = pinhole(p, at)
    return *guarded(x, y, f, k1, k2), F.when(x.isNotNull(), depth < 0)


def pinhole(p: Column, at: list) -> tuple[Column, Column, Column]:
    """(x, y, depth) of a point by P without radial terms; x and y are null in the camera plane."""
    v = [sum(F.get(p, F.lit(4 * i + j)) * at[j] for j in range(3)) + F.get(p, F.lit(4 * i + 3)) for i in range(3)]
    return -v[0] / F.nullif(v[2], F.lit(0.0)), -v[1] / F.nullif(v[2], F.lit(0.0)), v[2]


def guarded(x: Column, y: Column, f: Column, k1: Column, k2: Column) -> tuple[Column, Column]:
    """x and y with the radial terms where they do not extrapolate badly. x and y are written out at each of their uses:
    over many rows let them be columns."""
    r2 = (x * x + y * y) / (f * f)
    factor = 1.0 + k1 * r2 + k2 * r2 * r2
    plain = (k1 == 0) & (k2 == 0)
    bad = ~plain & ((r2 > 8.0) | (factor < 0.0))
    s = F.when(plain | bad, 1.0).otherwise(factor)
    return x * s, y * s


def angle(ax: list[Column], bx: list[Column]) -> Column:
    """Angle in degrees of two rays."""
    dot = sum(p * q for p, q in zip(ax, bx, strict=True))
    n1, n2 = F.sqrt(sum(p * p for p in ax)), F.sqrt(sum(q * q for q in bx))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (n1 * n2)))) * 180.0 / PI


def rotate(r: list, p: list) -> list[Column]:
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] for i in range(3)]


def project(r: list, t: list, f: Column, k1: Column, k2: Column, p: list, distort: bool = True) -> tuple[Column, Column, Column]:
    """(x, y, in front): normalised image coordinates of a point; null behind or in the camera plane."""
    cam = [a + b for a, b in zip(rotate(r, p), t, strict=True)]
    front = cam[2] <= 0
    px, py = -cam[0] / F.nullif(cam[2], F.lit(0.0)), -cam[1] / F.nullif(cam[2], F.lit(0.0))
    r2 = px * px + py * py
    s = f * (1 + k1 * r2 + k2 * r2 * r2) if distort else f
    return s * px, s * py, front


def undistort(x: Column, y: Column, coefficients: Column) -> tuple[Column, Column]:
    """Normalised point through an inverse distortion polynomial in the radius (array, constant first)."""
    r = F.sqrt(x * x + y * y)
    poly = F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda a, c: a * r + c)
    s = F.when(r > 0, poly / r).otherwise(1.0)
    return x * s, y * s


def fisheye(x: Column, y: Column, cx: float, cy: float, rad: float, degrees: float, focal: float) -> tuple[Column, Column]:
    """Equidistant fisheye point to the pinhole point of a given focal length."""
    dx, dy = x - cx, y - cy
    r = F.sqrt(dx * dx + dy * dy)
    theta = F.lit(0.5 * degrees * 3.141592653589793 / 180) * r / rad
    s = F.when(r > 0, F.lit(focal) * F.tan(theta) / r).otherwise(0.0)
    return dx * s, dy * s
