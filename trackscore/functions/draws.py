"""Random numbers as column expressions.

A draw is a function of its key and place alone (the digest is the counter), so neither
order nor partitioning nor a repeated task changes it, and SQL can draw the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws that one SHA-256 gives: 52 bits of each quarter make a uniform number, two of them two normal ones.
PER_DIGEST = 4
BITS = 52


def _uniform(digest: Column, quarter: int) -> Column:
    """A number inside (0, 1)."""
    return (F.conv(F.substring(digest, 1 + 16 * quarter, 13), 16, 10).cast("double") + 0.5) / float(1 << BITS)


def _normals(digest: Column) -> Column:
    """Four standard normal numbers by Box-Muller."""
    out = []
    for quarter in (0, 2):
        radius = F.sqrt(-2.0 * F.ln(_uniform(digest, quarter)))
        angle = _uniform(digest, quarter + 1) * F.lit(6.283185307179586)
        out += [radius * F.cos(angle), radius * F.sin(angle)]
    return F.array(*out)


def normal_draws(key: Column, width: Column | int) -> Column:
    """ARRAY<DOUBLE> of ``width`` standard normal draws: draw d is number d % 4 of SHA-256(key:d//4)."""
    width = F.lit(width) if isinstance(width, int) else width
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(width, F.lit(1)) - 1) / PER_DIGEST).cast("int"))
    digests = F.transform(blocks, lambda b: F.sha2(F.concat(key, F.lit(":"), b.cast("string")), 256))
    return F.slice(F.flatten(F.transform(digests, _normals)), F.lit(1), width)


def normal_draw_sql(key: str, dim: str) -> str:
    """Draw ``dim`` of ``normal_draws`` in SQL."""
    digest = f"sha256({key} || ':' || CAST({dim} // {PER_DIGEST} AS VARCHAR))"

    def uniform(quarter: str) -> str:
        return f"((CAST('0x' || substr({digest}, CAST(1 + 16 * ({quarter}) AS BIGINT), 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / {float(1 << BITS)}::DOUBLE)"

    pair = f"({dim} % {PER_DIGEST}) // 2 * 2"
    radius = f"sqrt(-2.0::DOUBLE * ln({uniform(pair)}))"
    angle = f"({uniform(pair + ' + 1')} * 6.283185307179586::DOUBLE)"
    return f"({radius} * CASE WHEN {dim} % 2 = 0 THEN cos({angle}) ELSE sin({angle}) END)"
