"""Exact fixed-point formatting of doubles, as Python's ``f"{x:.Nf}"`` does.

Spark's ``format_string`` and decimal casts round from the shortest decimal
form (2.675 → 2.68); Python rounds the exact binary value half-to-even
(2.675 → 2.67, 0.125 → 0.12). This rebuilds the exact value from mantissa
and exponent with integer arithmetic, all JVM-side. Intermediate values are
bound once through one-element ``transform`` lambdas so the expression tree
stays small.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a lambda binding)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _shr(a, b):
    return F.call_function("shiftright", a, b)


def _shl(a, b):
    return F.call_function("shiftleft", a, b)


def format_fixed(x, digits: int = 2) -> Column:
    """Python-equal ``%.{digits}f`` for finite doubles below 2**52 / 10**digits."""
    scale = 10 ** digits
    two = F.lit(2.0)

    def stage1(v):  # v: double
        a = F.abs(v)
        e0 = F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0)))).cast("int")
        return F.struct(v.alias("v"), a.alias("a"), e0.alias("e0"))

    def stage2(s):  # exponent e with 2^e <= a < 2^(e+1); log2 may be off by one
        ratio = s["a"] / F.pow(two, s["e0"].cast("double"))
        e = F.when(ratio >= 2, s["e0"] + 1).when(ratio < 1, s["e0"] - 1).otherwise(s["e0"])
        return F.struct(s["v"].alias("v"), s["a"].alias("a"), e.alias("e"))

    def stage3(s):  # exact value * 10^digits = n / 2^sh
        sh = F.lit(52) - s["e"]
        m = (s["a"] * F.pow(two, sh.cast("double"))).try_cast("long")  # 2^52 <= m < 2^53, exact (NULL when tiny)
        return F.struct(s["v"].alias("v"), s["a"].alias("a"), sh.alias("sh"), (m * F.lit(scale)).alias("n"))

    def stage4(s):
        sc = F.least(F.greatest(s["sh"], F.lit(1)), F.lit(62))
        q = _shr(s["n"], sc)
        rem = s["n"] - _shl(q, sc)
        half = _shl(F.lit(1).cast("long"), sc - 1)
        up = (rem > half) | ((rem == half) & ((q % 2) == 1))
        r = (F.when(s["a"] == 0, F.lit(0).cast("long"))
             .when(s["sh"] > 62, F.lit(0).cast("long"))
             .when(s["sh"] <= 0, _shl(s["n"], F.least(-s["sh"], F.lit(10))))
             .otherwise(q + F.when(up, 1).otherwise(0)))
        return F.struct(s["v"].alias("v"), r.alias("r"))

    def render(s):
        whole = F.floor(s["r"] / F.lit(scale)).cast("long").cast("string")
        sign = F.when(s["v"].cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))  # -0.0 too
        if digits == 0:
            return F.concat(sign, whole)
        frac = F.lpad((s["r"] % F.lit(scale)).cast("string"), digits, "0")
        return F.concat(sign, whole, F.lit("."), frac)

    v = _col(x).cast("double")
    out = _let(_let(_let(_let(_let(v, stage1), stage2), stage3), stage4), render)
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(out)
