"""Column builders for poses, quaternions, cameras and distances; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def affine(r: list[Column], t: list[Column], p: list[Column]) -> list[Column]:
    """World point of ``p`` under the row-major 3x3 ``r`` and translation ``t``."""
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def quaternion(r: list[Column]) -> list[Column]:
    """(x, y, z, w) of a row-major rotation, by the largest of trace and diagonal."""
    trace = r[0] + r[4] + r[8]
    case = F.when(trace > 0, 0).when((r[0] > r[4]) & (r[0] > r[8]), 1).when(r[4] > r[8], 2).otherwise(3)
    root = F.sqrt(F.greatest(F.lit(0.0), F.when(case == 0, trace + 1).when(case == 1, 1 + r[0] - r[4] - r[8]).when(case == 2, 1 + r[4] - r[0] - r[8]).otherwise(1 + r[8] - r[0] - r[4]))) * 2
    big, s = root / 4, F.nullif(root, F.lit(0.0))
    parts = {
        "x": [(r[7] - r[5]) / s, big, (r[1] + r[3]) / s, (r[2] + r[6]) / s],
        "y": [(r[2] - r[6]) / s, (r[1] + r[3]) / s, big, (r[5] + r[7]) / s],
        "z": [(r[3] - r[1]) / s, (r[2] + r[6]) / s, (r[5] + r[7]) / s, big],
        "w": [big, (r[7] - r[5]) / s, (r[2] - r[6]) / s, (r[3] - r[1]) / s],
    }
    return [F.when(case == 0, v[0]).when(case == 1, v[1]).when(case == 2, v[2]).otherwise(v[3]) for v in parts.values()]


def canonical(q: list[Column]) -> list[Column]:
    """The same rotation with w >= 0."""
    return [F.when(q[3] < 0, -c).otherwise(c) for c in q]


def angle_degrees(a: list[Column], b: list[Column]) -> Column:
    """Angle between two unit quaternions in degrees."""
    dot = F.abs(sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0]))
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), dot)))


def scaled_intrinsics(k: list[Column], size: tuple[Column, Column], new: tuple[Column, Column]) -> list[Column]:
    """fx, fy, cx, cy for another image size; null where a factor is above 5 or below 0.2."""
    sx, sy = new[0] / size[0], new[1] / size[1]
    ok = sx.between(0.2, 5.0) & sy.between(0.2, 5.0)
    return [F.when(ok, c * s) for c, s in zip(k, (sx, sy, sx, sy))]


def projected(p: list[Column], fx: Column, fy: Column) -> tuple[Column, Column, Column]:
    """(u, v, visible) of a camera-space point that looks down -z; u and v run over [0, 1] in the image."""
    w = F.nullif(-p[2], F.lit(0.0))
    u, v = (fx * p[0] / w + 1) / 2, (1 - fy * p[1] / w) / 2
    return u, v, F.coalesce((p[2] < 0) & u.between(0.0, 1.0) & v.between(0.0, 1.0), F.lit(False))


def clamped(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def l2_normalized(v: Column) -> Column:
    """A vector over its length, to which 1e-8 is added so that a zero vector stays one."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x)) + 1e-8
    return F.transform(v, lambda x: x / n)


def hamming_words(a: Column, b: Column) -> Column:
    """Different bits of two descriptors held as arrays of longs of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def mean_brightness(pixels: Column) -> Column:
    return F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.nullif(F.size(pixels), F.lit(0))


def laplacian_variance(pixels: Column, width: Column, height: Column, every: int = 2) -> Column:
    """How sharp a grey image (an array of rows, one after the other) is: the variance of the absolute four-neighbour Laplacian at
    every ``every``-th pixel from the third to the third-last row and column.  Images without such a pixel have 100."""
    across = F.sequence(F.lit(0), F.floor((width - 5) / every).cast("int"))
    down = F.sequence(F.lit(0), F.floor((height - 5) / every).cast("int"))
    at = lambda i: F.get(pixels, i.cast("int")).cast("double")

    def edge(i: Column) -> Column:
        return F.abs(4 * at(i) - at(i - 1) - at(i + 1) - at(i - width) - at(i + width))

    places = F.flatten(F.transform(down, lambda y: F.transform(across, lambda x: (y * every + 2) * width + x * every + 2)))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).alias("n"))
    add = lambda a, e: F.struct((a["s"] + e).alias("s"), (a["q"] + e * e).alias("q"), (a["n"] + 1).alias("n"))
    found = F.aggregate(F.transform(places, edge), zero, add, lambda a: a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"]))
    return F.when((width >= 5) & (height >= 5), found).when(pixels.isNotNull(), F.lit(100.0))


def resized_nearest(values: Column, width: Column, height: Column, new_width: Column, new_height: Column) -> Column:
    """A grid of values (an array of rows) in another size, each place with the value of the nearest place before it."""
    x = F.transform(F.sequence(F.lit(0), new_width - 1), lambda i: F.least(F.floor(i * width / new_width), width - 1))
    row = lambda j: F.transform(x, lambda i: F.get(values, (F.least(F.floor(j * height / new_height), height - 1) * width + i).cast("int")))
    return F.flatten(F.transform(F.sequence(F.lit(0), new_height - 1), row))


def rgb(y: Column, u: Column, v: Column) -> list[Column]:
    """Red, green and blue of a video pixel, 0 to 255."""
    parts = [y + 1.402 * (v - 128), y - 0.344136 * (u - 128) - 0.714136 * (v - 128), y + 1.772 * (u - 128)]
    return [clamped(F.round(c), 0.0, 255.0).cast("int") for c in parts]


def valid_intrinsics(k: list[Column]) -> Column:
    """Whether all of fx, fy, cx, cy, width and height are positive."""
    out = F.lit(True)
    for c in k:
        out = out & F.coalesce(c > 0, F.lit(False))
    return out


def turned_by_gyro(samples: Column) -> Column:
    """Orientation (x, y, z, w) after gyroscope samples: an array of structs (t, x, y, z) in seconds and radians a second.

    Each sample turns by its rate over the time since the one before; the first only starts the clock.
    """
    zero = F.struct(F.lit(None).cast("double").alias("t"), *[F.lit(v).alias(n) for n, v in zip("xyzw", (0.0, 0.0, 0.0, 1.0))])

    def step(q: Column, s: Column) -> Column:
        dt = F.coalesce(s["t"] - q["t"], F.lit(0.0))
        a, b, c = (s[n] * dt / 2 for n in "xyz")
        # yaw (rate x), pitch (rate y) and roll (rate z) as one quaternion
        sa, sb, sc, ca, cb, cc = F.sin(a), F.sin(b), F.sin(c), F.cos(a), F.cos(b), F.cos(c)
        e = [cc * sb * ca + sc * cb * sa, cc * cb * sa - sc * sb * ca, sc * cb * ca - cc * sb * sa, cc * cb * ca + sc * sb * sa]
        x, y, z, w = (q[n] for n in "xyzw")
        p = [w * e[0] + x * e[3] + y * e[2] - z * e[1], w * e[1] - x * e[2] + y * e[3] + z * e[0], w * e[2] + x * e[1] - y * e[0] + z * e[3], w * e[3] - x * e[0] - y * e[1] - z * e[2]]
        n = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2] + p[3] * p[3])
        return F.struct(s["t"].alias("t"), *[(c / n).alias(k) for c, k in zip(p, "xyzw")])

    return F.aggregate(F.array_sort(samples), zero, step, lambda q: F.array(*[q[n] for n in "xyzw"]))
