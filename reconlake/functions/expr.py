"""Column functions: hashes and ids, depth codes, cameras, rigid transforms, triangles. Nulls in give nulls out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def hash_rank(seed: str, *keys) -> Column:
    """hex SHA-256 of seed and keys joined by slashes; its order is a reproducible shuffle."""
    return F.sha2(F.concat_ws("/", F.lit(seed), *[_c(k).cast("string") for k in keys]), 256)


def stable_seed(purpose: str, key) -> Column:
    """unsigned 64-bit seed of purpose and key, as DECIMAL(20,0)."""
    return F.conv(F.substring(hash_rank(purpose, key), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_uniform(seed: str, *keys) -> Column:
    """a double in [0, 1) from the first 52 bits of the hash."""
    return F.conv(F.substring(hash_rank(seed, *keys), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def hash_index(n, seed: str, *keys) -> Column:
    """A whole number in [0, n) from the first 32 bits of the hash."""
    return F.pmod(F.conv(F.substring(hash_rank(seed, *keys), 1, 8), 16, 10).cast("bigint"), _c(n))


def hash_normal(seed: str, *keys) -> Column:
    """A standard normal draw (Box-Muller over two hash draws)."""
    u, v = hash_uniform(seed + "/u", *keys), hash_uniform(seed + "/v", *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def metric_prior(seed: str, key, nominal, spread: float = 0.2) -> Column:
    """a nominal size times a factor drawn within 1 - spread and 1 + spread, fixed by the key."""
    return _c(nominal) * (1 - spread + 2 * spread * hash_uniform(seed, key))


def selection_digest(*parts) -> Column:
    """SHA-256 of the parts separated by NUL characters."""
    return F.sha2(F.concat_ws("\0", *[_c(p).cast("string") for p in parts]), 256)


def target_id(scene, image, gt) -> Column:
    """zero-padded scene, image and instance as one id."""
    return F.format_string("%06d_%06d_%06d", _c(scene).cast("long"), _c(image).cast("long"), _c(gt).cast("long"))


def parse_id(col) -> Column:
    """struct of the three numbers of a target id; null where it has another form."""
    parts = F.split(_c(col), "_")
    good = _c(col).rlike("^[0-9]+_[0-9]+_[0-9]+$")
    return F.when(good, F.struct(*[F.get(parts, F.lit(k)).cast("long").alias(n) for k, n in enumerate(("scene_id", "image_id", "gt_id"))]))


def sanitize_id(col) -> Column:
    """runs of other characters than letters, digits, dot, underscore and dash become one underscore; ends lose dots, underscores and dashes."""
    return F.regexp_replace(F.regexp_replace(F.trim(_c(col)), "[^A-Za-z0-9_.-]+", "_"), "^[._-]+|[._-]+$", "")


def encode_depth(metres, limit: float = 10.0) -> Column:
    """16-bit code of a depth up to `limit` metres; half to even."""
    return F.rint(_c(metres) * 65535 / limit).cast("int")


def decode_depth(code, limit: float = 10.0) -> Column:
    return _c(code) * limit / 65535


def sensor_depth(raw, scale_mm) -> Column:
    """metres of a sensor's raw value at scale_mm millimetres a unit."""
    return _c(raw) * _c(scale_mm) / 1000


def quantisation_error(metres, limit: float = 10.0) -> Column:
    return F.abs(_c(metres) - decode_depth(encode_depth(metres, limit), limit))


def project(x, y, z, fx, fy, cx, cy) -> tuple[Column, Column]:
    """pixel of a camera point (+X right, +Y up, visible at z < 0); null where it isn't in front."""
    depth = -_c(z)
    front = depth > 0
    return F.when(front, _c(cx) + _c(fx) * _c(x) / depth), F.when(front, _c(cy) - _c(fy) * _c(y) / depth)


def unproject(u, v, depth, fx, fy, cx, cy) -> Vec:
    """camera point of a pixel at a depth."""
    d = _c(depth)
    return (_c(u) - _c(cx)) * d / _c(fx), (_c(cy) - _c(v)) * d / _c(fy), -d


def pixel_of(p) -> Column:
    """Nearest pixel: floor(p + 0.5)."""
    return F.floor(_c(p) + 0.5)


def transform_points(m: list, x, y, z) -> Vec:
    """m holds the rows r11 r12 r13 t1, r21 ... of a target-from-source transform."""
    p = [_c(x), _c(y), _c(z)]
    m = [_c(v) for v in m]
    return tuple(m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3))


def compose(a: list, b: list) -> list[Column]:
    """the transform that applies b, then a."""
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    out = []
    for i in range(3):
        for j in range(4):
            v = a[4 * i] * b[j] + a[4 * i + 1] * b[4 + j] + a[4 * i + 2] * b[8 + j]
            out.append(v + a[4 * i + 3] if j == 3 else v)
    return out


def invert_rigid(m: list) -> list[Column]:
    """inverse of a rotation with translation."""
    m = [_c(v) for v in m]
    out = []
    for i in range(3):
        r = [m[4 * j + i] for j in range(3)]
        out += [*r, -(r[0] * m[3] + r[1] * m[7] + r[2] * m[11])]
    return out


def determinant(m: list) -> Column:
    """Of the 3 x 3 part of a 12-value transform."""
    a, b, c, _, d, e, f, _, g, h, i, _ = [_c(v) for v in m]
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _gram(m: list) -> list[list[Column]]:
    m = [_c(v) for v in m]
    col = [[m[4 * r + c] for r in range(3)] for c in range(3)]
    return [[sum((col[i][k] * col[j][k] for k in range(1, 3)), col[i][0] * col[j][0]) for j in range(3)] for i in range(3)]


def is_rigid(m: list, tol: float = 1e-6) -> Column:
    """rows are orthonormal within tol and the determinant is positive; null coefficients are not rigid."""
    g = _gram(m)
    off = F.greatest(*[F.abs(g[i][j] - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)])
    return F.coalesce((off <= tol) & (determinant(m) > 0), F.lit(False))


def rotation_correction(m: list) -> Column:
    """largest change of a coefficient in one step towards the nearest rotation, R (I - R'R) / 2; null for reflections."""
    r = [_c(v) for v in m]
    g = _gram(m)
    e = [[(1.0 if i == j else 0.0) - g[i][j] for j in range(3)] for i in range(3)]
    step = [F.abs(r[4 * i] * e[0][j] + r[4 * i + 1] * e[1][j] + r[4 * i + 2] * e[2][j]) / 2 for i in range(3) for j in range(3)]
    return F.when(determinant(m) > 0, F.greatest(*step))


def quat_to_matrix(w, x, y, z) -> list[Column]:
    """nine coefficients, by rows, of the rotation of a quaternion of any length but zero."""
    w, x, y, z = map(_c, (w, x, y, z))
    s = 2 / (w * w + x * x + y * y + z * z)
    return [1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y), s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x), s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y)]


def matrix_to_quat(r: list) -> Column:
    """struct w, x, y, z with w >= 0 of nine coefficients, by the largest of the four squares."""
    a, b, c, d, e, f, g, h, i = [_c(v) for v in r]
    squares = [1 + a + e + i, 1 + a - e - i, 1 - a + e - i, 1 - a - e + i]
    top = F.greatest(*squares)
    ways = [(squares[0], h - f, c - g, d - b), (h - f, squares[1], b + d, c + g), (c - g, b + d, squares[2], f + h), (d - b, c + g, f + h, squares[3])]
    out = None
    for s, q in zip(squares, ways):
        sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
        one = F.struct(*[(sign * v / (2 * F.sqrt(top))).alias(n) for v, n in zip(q, "wxyz")])
        out = F.when(s == top, one) if out is None else out.when(s == top, one)
    return out


def cross(a: Vec, b: Vec) -> Vec:
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(_c(p) - _c(q) for p, q in zip(a, b))


def norm(a: Vec) -> Column:
    a = [_c(v) for v in a]
    return F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])


def tri_area2(a: Vec, b: Vec, c: Vec) -> Column:
    """twice a triangle's area."""
    return norm(cross(minus(b, a), minus(c, a)))


def tri_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    """unit normal; null for degenerate triangles (twice the area up to 1e-14)."""
    n, size = cross(minus(b, a), minus(c, a)), tri_area2(a, b, c)
    return tuple(F.when(size > 1e-14, v / size) for v in n)


def fscore(p, r) -> Column:
    """harmonic mean, 0 where both are 0."""
    p, r = _c(p), _c(r)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.when((p + r).isNotNull(), F.lit(0.0)))


def json_at(col, path: str) -> Column:
    """the text at a JSON pointer such as /a/0/b; null where there is none."""
    steps = "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in path.strip("/").split("/"))
    return F.get_json_object(_c(col), "$" + steps)


def fmt(col, kind: str = "percent") -> Column:
    """a metric as text: percent and percentage points with two decimals, millimetres with three; undefined is N/D."""
    factor, digits = {"percent": (100, 2), "pp": (100, 2), "mm": (1000, 3)}[kind]
    return F.when(_c(col).isNotNull(), F.format_string(f"%.{digits}f", _c(col).cast("double") * factor)).otherwise("N/D")


def depth_guide(depth, near: float, far: float) -> Column:
    """grey 255 at `near` down to 0 at `far`; missing depth is 0."""
    d = _c(depth)
    return F.when(d > 0, F.rint(255 * (far - F.least(F.greatest(d, F.lit(near)), F.lit(far))) / (far - near))).otherwise(0).cast("int")


def camera_from_projection(p00, p11, p20, p21, width, height) -> Column:
    """pinhole struct fx, fy, cx, cy of a renderer's projection coefficients."""
    w, h = _c(width), _c(height)
    return F.struct((_c(p00) * w / 2).alias("fx"), (_c(p11) * h / 2).alias("fy"), ((1 - _c(p20)) * w / 2 - 0.5).alias("cx"), ((1 + _c(p21)) * h / 2 - 0.5).alias("cy"))
