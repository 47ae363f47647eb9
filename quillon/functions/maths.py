"""Mathematical functions, decimal strings of any length and random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.strings import col

MAX = 2_147_483_647


def _one(f):
    return lambda c: f(col(c).cast("double"))


acos, atan, cos, deg2rad, exp, sin, sqrt, tan = (_one(f) for f in (F.acos, F.atan, F.cos, F.radians, F.exp, F.sin, F.sqrt, F.tan))


def abs_(c) -> Column:
    return F.abs(col(c))


def atan2(y, x) -> Column:
    return F.atan2(col(y).cast("double"), col(x).cast("double"))


def ceil(c) -> Column:
    return F.ceil(col(c)).cast("double")


def floor(c) -> Column:
    return F.floor(col(c)).cast("double")


def round_(c, digits: int = 0) -> Column:
    return F.round(col(c).cast("double"), digits)


def fmod(x, y) -> Column:
    """The remainder with the dividend's sign; null by zero."""
    return F.when(col(y) != 0, col(x).cast("double") % col(y).cast("double"))


def log(c, base: float | None = None) -> Column:
    return F.log(col(c).cast("double")) if base is None else F.log(base, col(c).cast("double"))


def pi() -> Column:
    return F.pi()


def pow_(a, b) -> Column:
    return F.pow(col(a), col(b))


def min_(*args) -> Column:
    return F.array_min(col(args[0])) if len(args) == 1 else F.least(*map(col, args))


def max_(*args) -> Column:
    return F.array_max(col(args[0])) if len(args) == 1 else F.greatest(*map(col, args))


def base_convert(c, source: int, target: int) -> Column:
    return F.lower(F.conv(col(c).cast("string"), source, target))


def decbin(c) -> Column:
    return F.bin(col(c).cast("bigint"))


def dechex(c) -> Column:
    return F.lower(F.hex(col(c).cast("bigint")))


def hexdec(c) -> Column:
    return F.conv(F.nullif(F.regexp_replace(col(c), "[^0-9A-Fa-f]", ""), F.lit("")), 16, 10).cast("bigint")


def rand(low: int | None = None, high: int | None = None, seed: int | None = None, key: Column | None = None) -> Column:
    """A whole number in [low, high], 0 to MAX without bounds; with a key it is a hash of key and seed, the same in every run."""
    low, high = (0, MAX) if low is None else (low, high if high is not None else MAX)
    span = high - low + 1
    if key is not None:
        return F.lit(low) + F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed or 0}"))), 1, 15), 16, 10).cast("bigint"), F.lit(span))
    return (F.lit(low) + F.floor(F.rand(seed) * span)).cast("bigint")


mt_rand = rand


def srand(seed: int):
    """rand with that seed."""
    return lambda low=None, high=None, key=None: rand(low, high, seed, key)


mt_srand = srand


def getrandmax() -> Column:
    return F.lit(MAX)


mt_getrandmax = getrandmax


def _digits(text: str) -> tuple[int, int]:
    """A decimal string as (whole number, digits after the point); 0 for what isn't one."""
    t = text.strip()
    sign, t = (-1, t[1:]) if t[:1] == "-" else (1, t[1:] if t[:1] == "+" else t)
    whole, _, part = t.partition(".")
    if not (whole + part).isdigit() or not (whole + part).isascii():
        return 0, 0
    return sign * int(whole + part), len(part)


def _written(n: int, digits: int) -> str:
    t = str(abs(n)).rjust(digits + 1, "0")
    out = f"{t[:-digits]}.{t[-digits:]}" if digits else t
    return "-" + out if n < 0 else out


def _at(n: int, digits: int, want: int) -> int:
    """n with digits after the point cut (towards zero) or filled to want."""
    return n * 10 ** (want - digits) if want >= digits else (abs(n) // 10 ** (digits - want)) * (1 if n >= 0 else -1)


def decimal(op: str, a: str, b: str, scale: int = 0) -> str | None:
    """a op b of decimal strings, cut to scale digits after the point: add sub mul div mod pow comp."""
    (x, p), (y, q) = _digits(a), _digits(b)
    if op in ("add", "sub", "comp"):
        n = max(p, q)
        if op == "comp":
            x, y = _at(_at(x, p, min(p, scale)), min(p, scale), scale), _at(_at(y, q, min(q, scale)), min(q, scale), scale)
            return str((x > y) - (x < y))
        x, y = _at(x, p, n), _at(y, q, n)
        return _written(_at(x + y if op == "add" else x - y, n, scale), scale)
    if op == "mul":
        return _written(_at(x * y, p + q, scale), scale)
    if op == "pow":
        e = _at(y, q, 0)
        if e >= 0:
            return _written(_at(x**e, p * e, scale), scale)
        return None if x == 0 else decimal("div", "1", _written(x**-e, p * -e), scale)
    if y == 0:
        return None
    if op == "mod":
        x, y = _at(x, p, 0), _at(y, q, 0)
        return None if y == 0 else str((abs(x) % abs(y)) * (1 if x >= 0 else -1))
    top = abs(x) * 10 ** (q + scale)
    n = top // (abs(y) * 10**p)
    return _written(n if (x >= 0) == (y >= 0) else -n, scale)


def _bc(op: str, kind: str = "string"):
    def run(a, b, scale: int | None = None) -> Column:
        digits = _scale[0] if scale is None else scale
        exact = F.udf(lambda x, y: None if x is None or y is None else decimal(op, x, y, digits), "string", useArrow=True)
        out = exact(col(a).cast("string"), col(b).cast("string"))
        return out.cast(kind) if kind != "string" else out

    return run


_scale = [0]


def bcscale(digits: int) -> None:
    """The scale of later calls that give none."""
    _scale[0] = digits


bcadd, bcsub, bcmul, bcdiv, bcmod, bcpow = (_bc(op) for op in ("add", "sub", "mul", "div", "mod", "pow"))
bccomp = _bc("comp", "int")


NAMES = {
    **{n: globals()[n] for n in "decbin dechex hexdec srand rand getrandmax mt_srand mt_rand mt_getrandmax acos atan atan2 base_convert ceil cos deg2rad exp floor fmod log pi sin sqrt tan bcscale bcdiv bcmod bcpow bcadd bcsub bcmul bccomp".split()},
    "min": min_, "max": max_, "abs": abs_, "pow": pow_, "round": round_,
}
