"""Image and pose geometry as column functions.  Quaternions are scalar-first; poses map the first camera to the second."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


# ---------------------------------------------------------------- images
def resize(height: Column, width: Column, longest: int, only_down: bool = False) -> tuple[Column, Column, Column]:
    """(height, width, scale) after fitting the long edge; sizes are truncated, a limit of 0 or less changes nothing."""
    edge = F.greatest(height, width)
    scale = F.lit(longest).cast("double") / edge
    same = F.lit(longest <= 0) | (F.lit(only_down) & (edge <= longest))
    fit = lambda x: F.when(same, x).otherwise((x * scale).cast("int"))
    return fit(height), fit(width), F.when(same, F.lit(1.0)).otherwise(scale)


def pad(size: Column, patch: int) -> Column:
    return (F.floor((size + (patch - 1)) / patch) * patch).cast("int")


def scaled_intrinsics(f: Column, size: Column, scale: Column) -> tuple[Column, Column]:
    """Focal length and principal point of one axis: the centre is half of the truncated scaled size."""
    return f * scale, F.floor((size * scale).cast("int") / 2)


def angle_bin(distance: Column, edges: Sequence[float]) -> Column:
    """Number of the half-open bin ``[edge, next edge)``; null outside."""
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out = F.when((distance >= low) & (distance < high), i).otherwise(out)
    return out


def sub_bin(distance: Column, low: Column, width: float = 5.0) -> Column:
    return F.floor((distance - low) / width).cast("int")


def inverse_depth(raw: Column, unit: float = 655.35) -> Column:
    return F.when(raw != 0, F.lit(unit) / raw)


def patch_centre(index: Column, columns: int, patch: int) -> tuple[Column, Column]:
    return (index % columns + 0.5) * patch, (F.floor(index / columns) + 0.5) * patch


def nearest_pixel(x: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor(x + 0.5))).cast("int")


def back_project(x: Column, y: Column, depth: Column, focal: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    return (x - width / 2) / focal * depth, (y - height / 2) / focal * depth, depth


# ---------------------------------------------------------------- rotations
def dot3(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def unit_quaternion(q: Vector) -> list[Column]:
    """Divided by its norm; the identity for a zero quaternion."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return [F.when(n > 0, x / n).otherwise(F.lit(1.0 if i == 0 else 0.0)) for i, x in enumerate(q)]


def conjugate(q: Vector) -> list[Column]:
    return [q[0], -q[1], -q[2], -q[3]]


def multiply(p: Vector, q: Vector) -> list[Column]:
    a, b, c, d = p
    w, x, y, z = q
    return [a * w - b * x - c * y - d * z, a * x + b * w + c * z - d * y, a * y - b * z + c * w + d * x, a * z + b * y - c * x + d * w]


def canonical(q: Vector, eps: float = 1e-15) -> list[Column]:
    """The sign for which the first component that is not about 0 is positive."""
    sign = F.lit(1.0)
    for x in q[::-1]:
        sign = F.when(F.abs(x) > eps, F.signum(x)).otherwise(sign)
    return [x * sign for x in q]


def rotation(q: Vector) -> list[list[Column]]:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quaternion(r: Sequence[Vector]) -> list[Column]:
    """Quaternion of a rotation matrix, from the largest of trace and diagonal."""
    t = r[0][0] + r[1][1] + r[2][2]

    def branch(i: int) -> list[Column]:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = 2 * F.sqrt(F.greatest(F.lit(0.0), 1 + r[i][i] - r[j][j] - r[k][k]))
        out: list = [None] * 4
        out[0], out[1 + i], out[1 + j], out[1 + k] = F.try_divide(r[k][j] - r[j][k], s), s / 4, F.try_divide(r[j][i] + r[i][j], s), F.try_divide(r[k][i] + r[i][k], s)
        return out

    s = 2 * F.sqrt(F.greatest(F.lit(0.0), 1 + t))
    first = [s / 4, F.try_divide(r[2][1] - r[1][2], s), F.try_divide(r[0][2] - r[2][0], s), F.try_divide(r[1][0] - r[0][1], s)]
    by = [branch(i) for i in range(3)]
    pick = lambda n: F.when(t > 0, first[n]).when((r[0][0] > r[1][1]) & (r[0][0] > r[2][2]), by[0][n]).when(r[1][1] > r[2][2], by[1][n]).otherwise(by[2][n])
    return [pick(n) for n in range(4)]


def apply(r: Sequence[Vector], v: Vector) -> list[Column]:
    return [dot3(row, v) for row in r]


def relative_pose(q1: Vector, t1: Vector, q2: Vector, t2: Vector) -> tuple[list[Column], list[Column]]:
    """Pose from camera 1 to camera 2: ``q2 q1*`` and ``t2 - R12 t1``."""
    q = multiply(q2, conjugate(q1))
    moved = apply(rotation(q), t1)
    return q, [b - m for b, m in zip(t2, moved, strict=True)]


def rotation_error(q: Vector, p: Vector) -> Column:
    """Degrees between two unit quaternions' rotations."""
    trace = F.lit(0.0)
    for a, b in zip(rotation(q), rotation(p), strict=True):
        trace = trace + dot3(a, b)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def translation_error(t: Vector, s: Vector) -> Column:
    """Degrees between two directions, whatever their sign; null for a zero vector."""
    size = F.sqrt(dot3(t, t)) * F.sqrt(dot3(s, s))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot3(t, s), size)))))
    return F.when(size > 0, F.least(angle, 180 - angle))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)


def pose_error(rotation_: Column, translation: Column, failed: float = 180.0) -> Column:
    """The larger error; what is missing or not finite counts as failed before that."""
    return F.greatest(*(F.when(finite(x), x).otherwise(F.lit(failed)) for x in (rotation_, translation)))


# ---------------------------------------------------------------- epipolar geometry
def sampson(x1: Column, y1: Column, x2: Column, y2: Column, r: Sequence[Vector], t: Vector, eps: float = 1e-12) -> Column:
    """Squared Sampson residual of calibrated points under ``[t]x R``; infinite where the denominator vanishes."""
    skew = [[F.lit(0.0), -t[2], t[1]], [t[2], F.lit(0.0), -t[0]], [-t[1], t[0], F.lit(0.0)]]
    e = [[sum((skew[i][k] * r[k][j] for k in range(1, 3)), skew[i][0] * r[0][j]) for j in range(3)] for i in range(3)]
    one = F.lit(1.0)
    line = apply(e, [x1, y1, one])
    back = [e[0][j] * x2 + e[1][j] * y2 + e[2][j] for j in range(2)]
    top = x2 * line[0] + y2 * line[1] + line[2]
    below = line[0] * line[0] + line[1] * line[1] + back[0] * back[0] + back[1] * back[1]
    return F.when(below > eps, top * top / F.greatest(below, F.lit(eps))).otherwise(F.lit(math.inf))


def in_front(x1: Column, y1: Column, x2: Column, y2: Column, r: Sequence[Vector], t: Vector, nearest: float = 0.01) -> Column:
    """Whether two viewing rays meet in front of both cameras, at least ``nearest`` away: depths by least squares of ``d1 R a + t = d2 b``."""
    a, b = apply(r, [x1, y1, F.lit(1.0)]), [x2, y2, F.lit(1.0)]
    aa, ab, bb, at, bt = dot3(a, a), dot3(a, b), dot3(b, b), dot3(a, t), dot3(b, t)
    det = aa * bb - ab * ab
    return F.coalesce((F.try_divide(ab * bt - bb * at, det) > nearest) & (F.try_divide(aa * bt - ab * at, det) > nearest), F.lit(False))


def threshold_scale(f1: Column, f2: Column) -> Column:
    """Pixels to calibrated units, by the mean of the inverse focal lengths."""
    return 0.5 * (1 / f1 + 1 / f2)


# ---------------------------------------------------------------- lenses
def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _lens(p: Column, k: Column) -> Column:
    """Struct (x, y, xx, xy, yx, yy): where a lens with eight coefficients takes a calibrated point, and the derivatives there."""
    c = lambda i: F.element_at(k, i + 1)  # noqa: E731  k1, k2, p1, p2, k3, k4, k5, k6
    x, y = p["x"], p["y"]

    def bent(s: Column) -> Column:
        radial, slope, r2 = s["top"] / s["below"], (s["dtop"] - s["top"] / s["below"] * s["dbelow"]) / s["below"], s["r2"]
        cross = 2 * x * y * slope + 2 * c(2) * x + 2 * c(3) * y
        return F.struct(
            (x * radial + 2 * c(2) * x * y + c(3) * (r2 + 2 * x * x)).alias("x"),
            (y * radial + c(2) * (r2 + 2 * y * y) + 2 * c(3) * x * y).alias("y"),
            (radial + 2 * x * x * slope + 2 * c(2) * y + 6 * c(3) * x).alias("xx"),
            cross.alias("xy"),
            cross.alias("yx"),
            (radial + 2 * y * y * slope + 6 * c(2) * y + 2 * c(3) * x).alias("yy"),
        )

    def parts(r2: Column) -> Column:
        """Numerator and denominator of the radial factor, and their derivatives by the squared radius."""
        return F.struct(
            r2.alias("r2"),
            (1 + r2 * (c(0) + r2 * (c(1) + r2 * c(4)))).alias("top"),
            (1 + r2 * (c(5) + r2 * (c(6) + r2 * c(7)))).alias("below"),
            (c(0) + r2 * (2 * c(1) + 3 * r2 * c(4))).alias("dtop"),
            (c(5) + r2 * (2 * c(6) + 3 * r2 * c(7))).alias("dbelow"),
        )

    return _let(_let(x * x + y * y, parts), bent)


def _coefficients(distortion: Column) -> Column:
    """Eight coefficients: those of a model with none or four are filled up with zeros."""
    zero = F.lit(0.0)
    have = F.transform(F.coalesce(distortion, F.array().cast("array<double>")), lambda x: x.cast("double"))
    return F.concat(have, F.slice(F.array(*[zero] * 8), 1, F.greatest(F.lit(0), 8 - F.size(have))))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def project(x: Column, y: Column, fx: Column, fy: Column, cx: Column, cy: Column, distortion: Column | None = None) -> Column:
    """Struct (x, y): the pixel of a calibrated point under a camera with none, four (k1, k2, p1, p2) or eight (k3 to k6 too) coefficients."""
    if distortion is None:
        return _point(fx * x + cx, fy * y + cy)
    seen = _let(_coefficients(distortion), lambda k: _let(_point(x, y), lambda p: _lens(p, k)))
    return F.when(F.coalesce(F.size(distortion), F.lit(0)) <= 0, _point(fx * x + cx, fy * y + cy)).otherwise(_let(seen, lambda s: _point(fx * s["x"] + cx, fy * s["y"] + cy)))


def unproject(x: Column, y: Column, fx: Column, fy: Column, cx: Column, cy: Column, distortion: Column | None = None, steps: int = 12) -> Column:
    """Struct (x, y): the calibrated point of a pixel, the inverse of ``project``.

    A distorted point is the fixed point of Newton's step on the lens equation, from the undistorted place on; a few steps reach the last digits where the lens does not fold.
    Null where the camera is null or has another number of coefficients.
    """
    plain = _point((x - cx) / fx, (y - cy) / fy)
    if distortion is None:
        return plain

    def step(p: Column, seen: Column, k: Column) -> Column:
        def moved(s: Column) -> Column:
            ex, ey, det = s["x"] - seen["x"], s["y"] - seen["y"], s["xx"] * s["yy"] - s["xy"] * s["yx"]
            return F.when(F.abs(det) > 1e-12, _point(p["x"] - (s["yy"] * ex - s["xy"] * ey) / det, p["y"] - (s["xx"] * ey - s["yx"] * ex) / det)).otherwise(p)

        return _let(_lens(p, k), moved)

    def solved(k: Column) -> Column:
        return _let(plain, lambda seen: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), seen, lambda p, _: step(p, seen, k)))

    n = F.coalesce(F.size(distortion), F.lit(0))
    return F.when(n <= 0, plain).when(n.isin(4, 8), _let(_coefficients(distortion), solved))


def adaptive_iterations(ratios: Sequence[Column], confidence: float, least: int, most: int) -> Column:
    """Iterations until an all-inlier sample is drawn with the given confidence."""
    p = F.lit(1.0)
    for r in ratios:
        p = p * r
    needed = F.ceil(F.try_divide(F.lit(math.log(1 - confidence)), F.ln(1 - p)))
    return F.when(p >= 1, F.lit(least)).when(p <= 0, F.lit(most)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), needed))).cast("long")
