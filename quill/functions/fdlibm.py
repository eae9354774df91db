"""``log`` and ``exp`` with the bits that Spark's expressions give.

Spark takes them from Java's ``StrictMath``, which is fdlibm; the C library that Python uses may differ in the last
bit.  Sums of few small counts often lie exactly on a nucleus' edge, where one bit decides whether a token is kept."""

from __future__ import annotations

import functools
import math
import struct

_LN2_HI, _LN2_LO = 6.93147180369123816490e-01, 1.90821492927058770002e-10
_INV_LN2 = 1.44269504088896338700e+00
_L1, _L2, _L3, _L4 = 6.666666666666735130e-01, 3.999999999940941908e-01, 2.857142874366239149e-01, 2.222219843214978396e-01
_L5, _L6, _L7 = 1.818357216161805012e-01, 1.531383769920937332e-01, 1.479819860511658591e-01
_P1, _P2, _P3 = 1.66666666666666019037e-01, -2.77777777770155933842e-03, 6.61375632143793436117e-05
_P4, _P5 = -1.65339022054652515390e-06, 4.13813679705723846039e-08


def _high(x: float) -> int:
    return struct.unpack("<q", struct.pack("<d", x))[0] >> 32


@functools.lru_cache(1 << 16)
def log(x: float) -> float:
    """Natural logarithm of a positive, finite number."""
    k = 0
    if _high(x) < 0x00100000:  # subnormal
        k, x = -54, x * 18014398509481984.0
    bits = struct.unpack("<q", struct.pack("<d", x))[0]
    hx = bits >> 32
    k += (hx >> 20) - 1023
    hx &= 0xFFFFF
    i = (hx + 0x95F64) & 0x100000
    x = struct.unpack("<d", struct.pack("<q", (hx | (i ^ 0x3FF00000)) << 32 | bits & 0xFFFFFFFF))[0]
    k += i >> 20
    f, dk = x - 1.0, float(k)
    if 0xFFFFF & (2 + hx) < 3:
        if f == 0.0:
            return dk * _LN2_HI + dk * _LN2_LO if k else 0.0
        r = f * f * (0.5 - 0.33333333333333333 * f)
        return dk * _LN2_HI - ((r - dk * _LN2_LO) - f) if k else f - r
    s = f / (2.0 + f)
    z = s * s
    w = z * z
    r = z * (_L1 + w * (_L3 + w * (_L5 + w * _L7))) + w * (_L2 + w * (_L4 + w * _L6))
    if (hx - 0x6147A) | (0x6B851 - hx) > 0:
        half = 0.5 * f * f
        return dk * _LN2_HI - ((half - (s * (half + r) + dk * _LN2_LO)) - f) if k else f - (half - s * (half + r))
    return dk * _LN2_HI - ((s * (f - r) - dk * _LN2_LO) - f) if k else f - s * (f - r)


@functools.lru_cache(1 << 16)
def exp(x: float) -> float:
    """Exponential of a number up to 0 (or one whose exponential is finite)."""
    if x < -7.45133219101941108420e+02:
        return 0.0
    hx = _high(x) & 0x7FFFFFFF
    k, hi, lo = 0, x, 0.0
    if hx > 0x3FD62E42:
        if hx < 0x3FF0A2B2:
            k = -1 if x < 0 else 1
            hi, lo = x - k * _LN2_HI, k * _LN2_LO
        else:
            k = int(_INV_LN2 * x + math.copysign(0.5, x))
            hi, lo = x - k * _LN2_HI, k * _LN2_LO
        x = hi - lo
    elif hx < 0x3E300000:
        return 1.0 + x
    t = x * x
    c = x - t * (_P1 + t * (_P2 + t * (_P3 + t * (_P4 + t * _P5))))
    if not k:
        return 1.0 - ((x * c) / (c - 2.0) - x)
    return math.ldexp(1.0 - ((lo - (x * c) / (2.0 - c)) - hi), k)
