"""Vector expressions over ARRAY columns: all JVM-side, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), size))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def normalised(v: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: F.try_divide(x, n))).otherwise(doubles(v))


def project(v: Column, rows: Sequence[Sequence[float]]) -> Column:
    """Matrix times vector; the matrix is a literal of the plan."""
    return F.transform(F.array(*[F.array(*map(F.lit, map(float, r))) for r in rows]), lambda r: dot(r, v))


def softmax(logits: Column) -> Column:
    """Logits and exponentials are bound to lambdas' variables, so neither is made again for each element."""
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    exps = lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    shares = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
    return once(logits, lambda z: once(exps(z), shares))


def info_nce(q: Column, positive: Column, negatives: Column, tau: float = 0.07) -> Column:
    """-log of the positive's share of exp(similarity / tau)."""
    p = dot(q, positive) / tau
    ns = F.transform(negatives, lambda n: dot(q, n) / tau)
    top = F.greatest(p, F.coalesce(F.array_max(ns), p))
    total = F.aggregate(ns, F.exp(p - top), lambda s, x: s + F.exp(x - top))
    return F.log(total) + top - p


def parse_vector(text: Column) -> Column:
    """"[a, b]" or "a,b" to an array of doubles; empty parts are skipped, a bad part or no part at all gives null."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.trim(text), r"^\[|\]$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    values = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(parts) > 0) & F.forall(values, lambda x: x.isNotNull()), values)


def rotate_left(v: Column, n: int) -> Column:
    return F.concat(F.slice(v, F.lit(n + 1), F.greatest(F.size(v) - n, F.lit(0))), F.slice(v, 1, n))


def conflicting(v: Column, shift: float) -> Column:
    """The opposite vector, shifted: a head that contradicts the others."""
    return F.transform(doubles(v), lambda x: -x + F.lit(shift))


def noisy(v: Column, sigma: float, key: Column, share: float = 1.0, seed: int = 3) -> Column:
    """Uniform noise of +-sigma on a share of the entries, from MD5 of seed, key and place: the same on every retry, in any engine."""

    def changed(x: Column, i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string")).cast("binary"))
        unit = lambda at: F.conv(F.substring(digest, at, 10), 16, 10).cast("bigint") / float(1 << 40)
        return F.when(unit(1) < share, x + (unit(11) * 2 - 1) * sigma).otherwise(x)

    return F.transform(doubles(v), changed)
