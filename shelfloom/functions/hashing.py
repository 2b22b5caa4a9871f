"""Content digests and Hamming distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE = 1 << 20


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def sample_hash(content: Column, size: Column, n: int = SAMPLE) -> Column:
    """Digest of the size, the first ``n`` and, over 2n bytes, the last ``n``."""
    head = F.substring(content, 1, n)
    tail = F.when(size > 2 * n, F.substring(content, -n, n)).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.unhex(F.lpad(F.hex(size), 16, "0")), head, tail), 256)


def sampled_bytes(size: Column, n: int = SAMPLE) -> Column:
    return F.least(size, F.lit(2 * n).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def similarity_pct(distance: Column, bits: int) -> Column:
    """Share of equal bits in percent, one decimal half to even; 90 if unknown."""
    return F.coalesce(F.bround(F.greatest(F.lit(0.0), (F.lit(bits) - distance) / F.lit(float(bits)) * 100), 1), F.lit(90.0))


def sign_words(vector: Column, length: int = 64) -> Column:
    """One 64-bit word: a bit per component, set where it is positive, the
    first component highest. A vector of another length raises an error."""
    bits = F.transform(vector, lambda v: F.when(v > 0, F.lit("1")).otherwise(F.lit("0")))
    word = F.array(F.conv(F.array_join(bits, ""), 2, -10).cast("long"))
    return F.when(vector.isNull() | (F.size(vector) == length), word).otherwise(F.raise_error(F.lit(f"a vector of {length} components was expected")))


def threshold_of(base: Column, side: Column) -> Column:
    """``config.scaled_threshold`` of columns: in proportion to 64 bits, half to even; a base of 0 is 5."""
    known = F.greatest(F.lit(1), F.when(F.coalesce(base, F.lit(0)) == 0, F.lit(5)).otherwise(base))
    scaled = F.greatest(F.lit(1), F.bround(known * side * side / F.lit(64.0), 0).cast("int"))
    return F.when(side == 8, known).otherwise(scaled).cast("int")
