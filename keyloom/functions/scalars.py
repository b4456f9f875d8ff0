"""Numbers, ranges and key slots as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 16384
SLOTS_PER_PARTITION = 4


def render_double(x: Column) -> Column:
    """A float as text; whole numbers below 1e17 without a fraction, infinities as inf and -inf."""
    whole = (F.floor(x).cast("double") == x) & (F.abs(x) < 1e17)
    return (
        F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
        .when(whole, F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))
    )


def index_bounds(start: int, stop: int, size: Column) -> tuple[Column, Column]:
    """0-based inclusive bounds of an index range; negatives count from the end, empty if low > high."""
    low = F.lit(start) if start >= 0 else F.greatest(size + F.lit(start), F.lit(0))
    high = F.least(F.lit(stop), size - 1) if stop >= 0 else size + F.lit(stop)
    return low, high


def score_bound(text: str) -> tuple[float, bool]:
    """The value of a score bound, and whether it is exclusive: ``5``, ``(5``, ``-inf``, ``+inf``."""
    exclusive = text.startswith("(")
    value = float(text[1:] if exclusive else text)
    if value != value:
        raise ValueError("min or max is not a float")
    return value, exclusive


def score_between(score: Column, low: str, high: str) -> Column:
    (a, a_open), (b, b_open) = score_bound(low), score_bound(high)
    return ((score > a) if a_open else (score >= a)) & ((score < b) if b_open else (score <= b))


def lex_between(member: Column, low: str, high: str) -> Column:
    """Bounds ``-``, ``+``, ``[text`` and ``(text``, compared by bytes."""
    test = F.lit(True)
    for bound, lower in ((low, True), (high, False)):
        if bound in "-+" and len(bound) == 1:
            if (bound == "+") == lower:
                return F.lit(False)
            continue
        if bound[:1] not in "[(":
            raise ValueError("min or max not valid string range item")
        value = F.lit(bound[1:])
        strict = bound[0] == "("
        test &= (member > value if strict else member >= value) if lower else (member < value if strict else member <= value)
    return test


def hash_tag(key: Column) -> Column:
    """What of a key is hashed: the text in its first ``{...}`` unless that is empty."""
    inner = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(inner != "", inner).otherwise(key)


def _crc16_step(crc: Column, byte: Column) -> Column:
    """One byte of CRC-16 (polynomial 0x1021, initial 0), bit by bit in closed form."""
    x = F.shiftright(crc, 8).bitwiseXOR(byte).bitwiseAND(F.lit(0xFF))
    x = x.bitwiseXOR(F.shiftright(x, 4))
    out = F.shiftleft(crc, 8).bitwiseXOR(F.shiftleft(x, 12)).bitwiseXOR(F.shiftleft(x, 5)).bitwiseXOR(x)
    return out.bitwiseAND(F.lit(0xFFFF))


def crc16(text: Column) -> Column:
    digits = F.hex(text.cast("binary"))
    at = F.sequence(F.lit(1), F.octet_length(text).cast("int"))
    codes = F.when(F.octet_length(text) > 0, F.transform(at, lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(codes, F.lit(0), _crc16_step)


def keyslot(key: Column) -> Column:
    return crc16(hash_tag(key)) % SLOTS


def partition_id(key: Column) -> Column:
    return F.shiftright(keyslot(key), 2)

