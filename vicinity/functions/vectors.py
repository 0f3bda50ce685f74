"""Vector Column expressions on ``ARRAY<FLOAT|DOUBLE>``.

Per-row O(dim) work only; products between many vectors are blocked numpy
kernels in :mod:`vicinity.operators.similarity`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm_sq(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(a) -> Column:
    """x / ||x||; the zero vector stays zero (as torch normalize with eps).

    The squared norm is the accumulator of one ``aggregate`` whose finish step
    scales the array, so the norm is computed once per row, not per element.
    """
    v = _c(a).cast("array<double>")
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x,
                       lambda acc: F.transform(v, lambda x: F.when(acc > 0, x / F.sqrt(acc)).otherwise(x)))


def to_double(a) -> Column:
    return _c(a).cast("array<double>")


def hashed_token_vector(token) -> Column:
    """Hashed token vector: 8 dimensions from md5 bytes 0-7, centred, L2 normalised.

    component i = (byte_i - 127.5) / 127.5; the oracle uses the same formula.
    Prefer :func:`with_hashed_vectors`, which computes the md5 once per row.
    """
    return hashed_components(F.md5(_c(token)))


def hashed_components(md5_hex) -> Column:
    h = _c(md5_hex)
    raw = F.array(*[(F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("double") - 127.5) / 127.5
                    for i in range(8)])
    return l2_normalize(raw)


def with_hashed_vectors(df, token: str = "token", out: str = "vec"):
    """Add ``out`` = hashed vector of ``token`` with scalar (code-generated) expressions:
    md5 once, eight component columns, one norm column, then the array."""
    comps = [f"_hc{i}" for i in range(8)]
    d = df.withColumn("_md5", F.md5(F.col(token)))
    d = d.select("*", *[((F.conv(F.substring("_md5", 2 * i + 1, 2), 16, 10).cast("double") - 127.5) / 127.5)
                        .alias(c) for i, c in enumerate(comps)])
    d = d.withColumn("_hn", F.sqrt(sum((F.col(c) * F.col(c) for c in comps[1:]), F.col(comps[0]) * F.col(comps[0]))))
    vec = F.array(*[F.when(F.col("_hn") > 0, F.col(c) / F.col("_hn")).otherwise(F.col(c)) for c in comps])
    return d.withColumn(out, vec).drop("_md5", "_hn", *comps)


def hashed_token_vector_sql(token_expr: str) -> str:
    """DuckDB form of :func:`hashed_token_vector` (un-normalised components)."""
    comps = ", ".join(
        f"((('0x' || substr(md5({token_expr}), {2 * i + 1}, 2))::INTEGER - 127.5) / 127.5)" for i in range(8))
    return f"[{comps}]"
