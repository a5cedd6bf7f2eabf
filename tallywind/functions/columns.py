"""Predicates, boolean algebra, arithmetic and mathematics on columns.

NULL is absence and propagates; NaN is a value that compares as in IEEE 754:
every comparison with it is false but `ne`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def _lit(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def present(x: Column, is_float: bool) -> Column:
    """x, with NaN as NULL."""
    return F.when(~F.isnan(x), x) if is_float else x


# comparisons with a scalar


def gt(x: Column, k: Any, is_float: bool = False) -> Column:
    return ((x > _lit(k)) & ~F.isnan(x)) if is_float else x > _lit(k)


def ge(x: Column, k: Any, is_float: bool = False) -> Column:
    return ((x >= _lit(k)) & ~F.isnan(x)) if is_float else x >= _lit(k)


def lt(x: Column, k: Any, is_float: bool = False) -> Column:
    if isinstance(k, float) and k != k:
        return F.when(x.isNotNull(), F.lit(False))
    return x < _lit(k)


def le(x: Column, k: Any, is_float: bool = False) -> Column:
    if isinstance(k, float) and k != k:
        return F.when(x.isNotNull(), F.lit(False))
    return x <= _lit(k)


def eq(x: Column, k: Any, is_float: bool = False) -> Column:
    return ((x == _lit(k)) & ~F.isnan(x)) if is_float else x == _lit(k)


def ne(x: Column, k: Any, is_float: bool = False) -> Column:
    return ((x != _lit(k)) | F.isnan(x)) if is_float else x != _lit(k)


def between(x: Column, lo: Any, hi: Any, inclusive: str = "both", is_float: bool = False) -> Column:
    """Within bounds: `both`, `left`, `right` or `neither` of them inclusive; NaN is in no interval."""
    if inclusive not in ("both", "left", "right", "neither"):
        raise ValueError(f"inclusive: {inclusive!r}")
    low = ge(x, lo, is_float) if inclusive in ("both", "left") else gt(x, lo, is_float)
    high = le(x, hi, is_float) if inclusive in ("both", "right") else lt(x, hi, is_float)
    return low & high


def isin(x: Column, values: Sequence[Any]) -> Column:
    """Whether x is one of the values; absent ones in the list are ignored, an absent x gives NULL; NaN equals NaN."""
    values = [v for v in values if v is not None]
    return x.isin(values) if values else F.when(x.isNotNull(), F.lit(False))


# three-valued logic


def land(a: Column, b: Column) -> Column:
    return a & b


def lor(a: Column, b: Column) -> Column:
    return a | b


def lxor(a: Column, b: Column) -> Column:
    return a != b


def lnot(a: Column) -> Column:
    return ~a


# choice


def where(x: Column, cond: Column, other: Any = None) -> Column:
    """x where cond is true, else other; an absent cond counts as false."""
    return F.when(cond, x).otherwise(_lit(other))


def mask(x: Column, cond: Column, other: Any = None) -> Column:
    """other where cond is true, else x; an absent cond counts as false."""
    return F.when(cond, _lit(other)).otherwise(x)


def ifelse(cond: Column, a: Any, b: Any) -> Column:
    return F.when(cond, _lit(a)).otherwise(_lit(b))


def fillna(x: Column, value: Any) -> Column:
    """value where x is absent; NaN stays."""
    return F.coalesce(x, _lit(value))


def combine_first(x: Column, y: Column) -> Column:
    return F.coalesce(x, y)


# arithmetic


def add(a: Column, b: Any) -> Column:
    return a + _lit(b)


def sub(a: Column, b: Any) -> Column:
    return a - _lit(b)


def mul(a: Column, b: Any) -> Column:
    return a * _lit(b)


def _wrapped(plain: Column, exact: Column) -> Column:
    """A 64-bit result; where it overflows (plain is NULL), the exact one modulo 2**64."""
    half, whole = F.lit(str(2**63)).cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)")
    return F.coalesce(plain, (F.pmod(exact.cast("decimal(38,0)") + half, whole) - half).cast("bigint"))


def add_long(a: Column, b: Any) -> Column:
    """Whole numbers; beyond 64 bits the sum wraps around."""
    b = _lit(b)
    return _wrapped(F.try_add(a, b), a.cast("decimal(20,0)") + b.cast("decimal(20,0)"))


def sub_long(a: Column, b: Any) -> Column:
    b = _lit(b)
    return _wrapped(F.try_subtract(a, b), a.cast("decimal(20,0)") - b.cast("decimal(20,0)"))


def mul_long(a: Column, b: Any) -> Column:
    """The factors' high and low halves are multiplied apart, so that no intermediate result leaves 38 digits."""
    b = _lit(b)
    high = F.shiftright(b, 32).cast("decimal(20,0)")
    low = b.bitwiseAND(F.lit(2**32 - 1)).cast("decimal(20,0)")
    x, whole = a.cast("decimal(20,0)"), F.lit(str(2**64)).cast("decimal(38,0)")
    return _wrapped(F.try_multiply(a, b), F.pmod((x * high).cast("decimal(38,0)"), F.lit(str(2**32)).cast("decimal(38,0)")) * F.lit(str(2**32)).cast("decimal(20,0)") + F.pmod((x * low).cast("decimal(38,0)"), whole))


def div(a: Column, b: Any) -> Column:
    """True division as a double; NULL where the divisor is 0."""
    return F.try_divide(a.cast("double"), _lit(b).cast("double"))


def floordiv(a: Column, b: Any) -> Column:
    """Whole-number division that cuts towards zero; NULL where the divisor is 0."""
    return F.call_function("div", a, F.nullif(_lit(b).cast("long"), F.lit(0).cast("long")))


def absolute(x: Column) -> Column:
    return F.abs(x)


def round_half_away(x: Column, digits: int = 0, is_float: bool = True) -> Column:
    """Rounded half away from zero in binary arithmetic (1.005 to two digits is 1.0); whole numbers only change below the point."""
    if not is_float:
        if digits >= 0:
            return x
        if digits <= -19:
            raise ValueError("a 64-bit number has no such digit")
        return F.round(x, digits)
    scale = 10.0**digits
    grown = x * F.lit(scale)
    done = F.when(x < 0, F.call_function("ceil", (grown - 0.5).cast("double")).cast("double")).otherwise(F.call_function("floor", (grown + 0.5).cast("double")).cast("double")) / F.lit(scale)
    # beyond 2**52 a double has no fraction, and floor would leave the range of a long
    return F.when(F.isnan(x) | (F.abs(grown) >= 2.0**52), x).otherwise(done)


def clip(x: Column, lo: Any = None, hi: Any = None) -> Column:
    """x within bounds; NaN and NULL stay."""
    if lo is not None and hi is not None and not isinstance(lo, Column) and not isinstance(hi, Column) and lo > hi:
        raise ValueError("the lower bound is above the upper one")
    out = F.when(x < _lit(lo), _lit(lo)) if lo is not None else F.when(F.lit(False), x)
    if hi is not None:
        nan = F.isnan(x.cast("double"))
        out = out.when((x > _lit(hi)) & ~nan, _lit(hi))
    return out.otherwise(x)


# mathematics: doubles; domain errors give NaN


def sin(x: Column) -> Column:
    return F.sin(x.cast("double"))


def cos(x: Column) -> Column:
    return F.cos(x.cast("double"))


def tan(x: Column) -> Column:
    return F.tan(x.cast("double"))


def exp(x: Column) -> Column:
    return F.exp(x.cast("double"))


def log(x: Column) -> Column:
    """Natural logarithm: NaN below 0, minus infinity at 0."""
    x = x.cast("double")
    return F.when(x < 0, F.lit(NAN)).when(x == 0, F.lit(-INF)).otherwise(F.log(x))


def sqrt(x: Column) -> Column:
    return F.sqrt(x.cast("double"))
