"""The item hash: bytes of the UTF-8 string, sign-extended, folded by xor, multiply and shift in 32 bits.

The fold is sequential in a string's bytes but independent between strings, so a batch is folded byte column by byte
column: over Arrow's string buffers, all strings' first bytes in one array operation, then all second ones.
That costs a few nanoseconds a byte, and no distinct items have to be found first. ``hash_sql`` is the same as an SQL expression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplier and shift that features of other installations use too.
MULTIPLIER, SHIFT = 0x5BD1E995, 15
_WORD = 0xFFFFFFFF


def hash_sql(w: str, seed: int) -> str:
    """Spark SQL for the hash of string expression ``w``; a bigint from 0 to 2**32 - 1."""
    m = f"(((h ^ CASE WHEN b > 127 THEN b + 4294967040 ELSE b END) * {MULTIPLIER}) & 4294967295)"
    plain = f"transform(sequence(1, char_length({w})), i -> cast(ascii(substring({w}, i, 1)) AS bigint))"
    coded = f"transform(sequence(1, octet_length({w})), i -> cast(conv(substring(hex({w}), 2 * i - 1, 2), 16, 10) AS bigint))"
    data = f"CASE WHEN octet_length({w}) = char_length({w}) THEN {plain} ELSE {coded} END"  # ASCII alone is the common and much cheaper case
    return f"CASE WHEN {w} = '' THEN cast({seed} AS bigint) ELSE aggregate({data}, cast({seed} AS bigint), (h, b) -> {m} ^ shiftright({m}, {SHIFT})) END"


#: With fewer strings than this left, bytes are folded one string at a time.
_FEW = 4


def folded(strings: pa.Array, seeds: tuple[int, ...]) -> np.ndarray:
    """The hashes of strings, a row for each seed, as unsigned 32-bit numbers; nulls have those of the empty string."""
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    n = len(strings)
    at = np.frombuffer(offsets, np.int64, n + 1, strings.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.int8) if data is not None else np.zeros(0, np.int8)
    sizes = np.diff(at)
    if strings.null_count:
        sizes = np.where(strings.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    order = np.argsort(-sizes, kind="stable")  # the longest first, so that those with a j-th byte are a prefix
    starts, sizes = at[:-1][order], sizes[order]
    h = np.repeat(np.array(seeds, np.uint32)[:, None], n, axis=1)
    j, left = 0, int(np.count_nonzero(sizes))
    while left >= _FEW:
        x = h[:, :left]
        x ^= data[starts[:left] + j].astype(np.int32).view(np.uint32)
        x *= np.uint32(MULTIPLIER)
        x ^= x >> np.uint32(SHIFT)
        j += 1
        left = int(np.searchsorted(-sizes, -j))
    for k in range(left):
        rest = data[starts[k] + j : starts[k] + sizes[k]].astype(np.int64) & 0xFFFFFFFF
        for s in range(len(seeds)):
            y = int(h[s, k])
            for b in rest.tolist():
                y = ((y ^ b) * MULTIPLIER) & 0xFFFFFFFF
                y ^= y >> SHIFT
            h[s, k] = y
    out = np.empty_like(h)
    out[:, order] = h
    return out


def _nulls_of(strings: pa.Array) -> np.ndarray:
    return strings.is_null().to_numpy(zero_copy_only=False)


def hash_column(w: str | Column, seed: int) -> Column:
    """The hash of a string column; a bigint from 0 to 2**32 - 1, null for null."""

    @F.arrow_udf("long")
    def fold(strings: pa.Array) -> pa.Array:
        return pa.array(folded(strings, (seed,))[0].astype(np.int64), mask=_nulls_of(strings))

    return fold(w)


def hash_code(w: str | Column) -> Column:
    """The hash with seed 0 in the lower 32 bits, the lowest bit of that with seed 1 above them; null for null."""

    @F.arrow_udf("long")
    def fold(strings: pa.Array) -> pa.Array:
        first, second = folded(strings, (0, 1)).astype(np.int64)
        return pa.array(first | (second & 1) << 32, mask=_nulls_of(strings))

    return fold(w)


def bucket_and_sign(code: Column, dim: int | Column) -> tuple[Column, Column]:
    """A ``hash_code``'s feature and the sign with which it counts there."""
    return (code.bitwiseAND(F.lit(_WORD)) % dim).cast("long"), F.when(code <= _WORD, 1.0).otherwise(-1.0)


def hash_of(text: str, seed: int) -> int:
    """The same in Python, for tests and single values."""
    h = seed
    for b in text.encode():
        h = ((h ^ (b + 0xFFFFFF00 if b > 127 else b)) * MULTIPLIER) & 0xFFFFFFFF
        h ^= h >> SHIFT
    return h


#: The multipliers of MurmurHash3's 64-bit finaliser (Appleby, public domain).
FINALISER = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_HALF = 0xFFFF


def _let(value: Column, f) -> Column:
    """``f(value)``, with the value computed once."""
    return F.transform(F.array(value), f)[0]


def _low_product(a: Column, c: int) -> Column:
    """The low 32 bits of the product of two 32-bit words; no step exceeds a bigint, so ANSI mode has nothing to object to."""
    upper = (F.shiftright(a, 16) * c).bitwiseAND(F.lit(_HALF))
    return (a.bitwiseAND(F.lit(_HALF)) * c + F.shiftleft(upper, 16)).bitwiseAND(F.lit(_WORD))


def _product(w: Column, c: int) -> Column:
    """A 64-bit number, as a struct of two 32-bit words, times a constant, modulo 2**64."""
    upper, lower = c >> 32, c & _WORD
    below, above = w["lo"].bitwiseAND(F.lit(_HALF)) * lower, F.shiftright(w["lo"], 16) * lower

    def joined(t: Column) -> Column:
        low = t["below"] + F.shiftleft(t["above"].bitwiseAND(F.lit(_HALF)), 16)
        high = F.shiftright(low, 32) + F.shiftright(t["above"], 16) + t["rest"]
        return F.struct(high.bitwiseAND(F.lit(_WORD)).alias("hi"), low.bitwiseAND(F.lit(_WORD)).alias("lo"))

    rest = _low_product(w["hi"], lower) + _low_product(w["lo"], upper)
    return _let(F.struct(below.alias("below"), above.alias("above"), rest.alias("rest")), joined)


def _folded(w: Column) -> Column:
    """The number xor itself shifted right by 33 bits."""
    return F.struct(w["hi"].alias("hi"), w["lo"].bitwiseXOR(F.shiftright(w["hi"], 1)).alias("lo"))


def integer_hash(x: Column) -> Column:
    """The finaliser's low 32 bits, signed, of an integer id."""
    w = F.struct(F.shiftrightunsigned(x.cast("long"), 32).alias("hi"), x.cast("long").bitwiseAND(F.lit(_WORD)).alias("lo"))
    for c in FINALISER:
        w = _let(_let(w, _folded), lambda v: _product(v, c))  # noqa: B023  called at once
    low = _let(w, _folded)["lo"]
    return F.when(low > 0x7FFFFFFF, low - 0x100000000).otherwise(low)


def integer_bucket_and_sign(x: Column, dim: int) -> tuple[Column, Column]:
    """An integer id's feature and the sign with which it counts there."""
    h = integer_hash(x)
    return (F.abs(h) % dim).cast("long"), F.when(h >= 0, 1.0).otherwise(-1.0)
