"""Machine-integer semantics as SQL text, for Spark and for any other engine whose dialect is given.

Values are unsigned numbers below 2^w in BIGINT, for widths up to 32; poison is a boolean beside the value, never NULL.
"""

from __future__ import annotations

from dataclasses import dataclass


class Unsupported(ValueError):
    """An operation or width that has no translation."""


@dataclass(frozen=True)
class Dialect:
    """How an engine writes what engines write in different ways."""

    xor: str = "({a} ^ {b})"
    shl: str = "shiftleft({a}, cast({b} as int))"
    shr: str = "shiftright({a}, cast({b} as int))"
    div: str = "({a} div {b})"
    count: str = "cast(bit_count({a}) as bigint)"


SPARK = Dialect()
DUCKDB = Dialect(xor="xor({a}, {b})", shl="({a} << {b})", shr="({a} >> {b})", div="({a} // {b})", count="cast(bit_count({a}) as bigint)")

#: Comparisons: the symbol, and whether they compare as signed numbers.
COMPARE = {"eq": ("=", False), "ne": ("<>", False)} | {f"{s}{o}": (c, s == "s") for s in "us" for o, c in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))}
BINARY = ("add", "sub", "mul", "and", "or", "xor", "shl", "lshr", "ashr", "udiv", "urem", "sdiv", "srem")
SHIFTS = ("shl", "lshr", "ashr")


def number(v: int) -> str:
    return f"cast({v} as bigint)"


class Words:
    """Operations at one width in one dialect; arguments and results are SQL texts of values."""

    def __init__(self, width: int, dialect: Dialect = SPARK) -> None:
        if not 1 <= width <= 32:
            raise Unsupported(f"width {width}")
        self.w, self.d = width, dialect
        self.top, self.half, self.full = number(2**width - 1), number(2 ** (width - 1)), number(2**width)

    def wrap(self, a: str) -> str:
        return f"({a} & {self.top})"

    def signed(self, a: str) -> str:
        return f"({a} - case when {a} >= {self.half} then {self.full} else {number(0)} end)"

    def size(self, a: str) -> str:
        return f"(case when {a} >= {self.half} then {self.full} - {a} else {a} end)"

    def shift(self, kind: str, a: str, b: str) -> str:
        return getattr(self.d, kind).format(a=a, b=f"least({b}, {number(self.w - 1)})")

    def op(self, name: str, *args: str) -> str:
        """The value of an operation."""
        if name in COMPARE:
            return f"(case when {self.test(name, *args)} then {number(1)} else {number(0)} end)"
        if (rule := getattr(self, f"_{name}", None)) is None:
            raise Unsupported(name)
        return f"({rule(*args)})"

    def test(self, name: str, a: str, b: str) -> str:
        symbol, signed = COMPARE[name]
        return f"({self.signed(a)} {symbol} {self.signed(b)})" if signed else f"({a} {symbol} {b})"

    def _add(self, a: str, b: str) -> str:
        return self.wrap(f"({a} + {b})")

    def _sub(self, a: str, b: str) -> str:
        return self.wrap(f"({a} - {b})")

    def _mul(self, a: str, b: str) -> str:
        if self.w <= 31:
            return self.wrap(f"({a} * {b})")
        low, high = f"(({a} & 65535) * {b})", f"(({self.d.shr.format(a=a, b=16)} * {b}) & 65535)"
        return self.wrap(f"({low} + {high} * 65536)")

    def _neg(self, a: str) -> str:
        return self.wrap(f"({self.full} - {a})")

    def _not(self, a: str) -> str:
        return f"{self.top} - {a}"

    def _and(self, a: str, b: str) -> str:
        return f"{a} & {b}"

    def _or(self, a: str, b: str) -> str:
        return f"{a} | {b}"

    def _xor(self, a: str, b: str) -> str:
        return self.d.xor.format(a=a, b=b)

    def _shl(self, a: str, b: str) -> str:
        return f"case when {b} >= {self.w} then {number(0)} else {self.wrap(self.shift('shl', a, b))} end"

    def _lshr(self, a: str, b: str) -> str:
        return f"case when {b} >= {self.w} then {number(0)} else {self.shift('shr', a, b)} end"

    def _ashr(self, a: str, b: str) -> str:
        return f"case when {a} < {self.half} then {self.shift('shr', a, b)} else {self.top} - {self.shift('shr', f'({self.top} - {a})', b)} end"

    def _udiv(self, a: str, b: str) -> str:
        return f"case when {b} = 0 then {self.top} else {self.d.div.format(a=a, b=f'greatest({b}, {number(1)})')} end"

    def _urem(self, a: str, b: str) -> str:
        return f"case when {b} = 0 then {a} else {a} % greatest({b}, {number(1)}) end"

    def _sdiv(self, a: str, b: str) -> str:
        q = self.d.div.format(a=self.size(a), b=f"greatest({self.size(b)}, {number(1)})")
        apart = f"({a} >= {self.half}) <> ({b} >= {self.half})"
        return f"case when {b} = 0 then case when {a} < {self.half} then {self.top} else {number(1)} end when {apart} then {self.wrap(f'({self.full} - {q})')} else {self.wrap(q)} end"

    def _srem(self, a: str, b: str) -> str:
        r = f"({self.size(a)} % greatest({self.size(b)}, {number(1)}))"
        return f"case when {b} = 0 then {a} when {a} >= {self.half} then {self.wrap(f'({self.full} - {r})')} else {r} end"

    def _umin(self, a: str, b: str) -> str:
        return f"least({a}, {b})"

    def _umax(self, a: str, b: str) -> str:
        return f"greatest({a}, {b})"

    def _smin(self, a: str, b: str) -> str:
        return self.wrap(f"least({self.signed(a)}, {self.signed(b)})")

    def _smax(self, a: str, b: str) -> str:
        return self.wrap(f"greatest({self.signed(a)}, {self.signed(b)})")

    def _abs(self, a: str) -> str:
        return self.wrap(self.size(a))

    def _ctpop(self, a: str) -> str:
        return self.d.count.format(a=a)

    def _cttz(self, a: str) -> str:
        return f"case when {a} = 0 then {number(self.w)} else {self.d.count.format(a=f'(({a} & ({self.full} - {a})) - 1)')} end"

    def _ctlz(self, a: str) -> str:
        steps = [f"case when {a} >= {number(2**i)} then 1 else 0 end" for i in range(self.w)]
        return f"{number(self.w)} - ({' + '.join(steps)})"

    def _bswap(self, a: str) -> str:
        if self.w % 8:
            raise Unsupported(f"bytes of {self.w} bits")
        n = self.w // 8
        return " + ".join(f"({self.d.shr.format(a=a, b=8 * i)} & 255) * {number(256 ** (n - 1 - i))}" for i in range(n))

    def _bitreverse(self, a: str) -> str:
        return " + ".join(f"({self.d.shr.format(a=a, b=i)} & 1) * {number(2 ** (self.w - 1 - i))}" for i in range(self.w))

    def _uadd_sat(self, a: str, b: str) -> str:
        return f"least({a} + {b}, {self.top})"

    def _usub_sat(self, a: str, b: str) -> str:
        return f"greatest({a} - {b}, {number(0)})"

    def _clamped(self, a: str) -> str:
        return self.wrap(f"least(greatest({a}, {number(-(2 ** (self.w - 1)))}), {number(2 ** (self.w - 1) - 1)})")

    def _sadd_sat(self, a: str, b: str) -> str:
        return self._clamped(f"{self.signed(a)} + {self.signed(b)}")

    def _ssub_sat(self, a: str, b: str) -> str:
        return self._clamped(f"{self.signed(a)} - {self.signed(b)}")

    def _fshl(self, a: str, b: str, c: str) -> str:
        n = f"({c} % {self.w})"
        return f"case when {n} = 0 then {a} else {self.wrap(self.shift('shl', a, n))} | {self.d.shr.format(a=b, b=f'({self.w} - {n})')} end"

    def _fshr(self, a: str, b: str, c: str) -> str:
        n = f"({c} % {self.w})"
        return f"case when {n} = 0 then {b} else {self.wrap(self.shift('shl', a, f'({self.w} - {n})'))} | {self.d.shr.format(a=b, b=n)} end"

    def poison(self, name: str, flags: frozenset[str], a: str, b: str) -> list[str]:
        """Conditions under which an operation with flags makes poison of its own."""
        out = []
        value = self.op(name, a) if name in ("abs", "ctlz", "cttz") else self.op(name, a, b)
        low, high = number(-(2 ** (self.w - 1))), number(2 ** (self.w - 1) - 1)
        exact = {"add": f"({a} + {b})", "sub": f"({a} - {b})", "mul": f"({a} * {b})"}
        in_signs = {k: f"({self.signed(a)} {o} {self.signed(b)})" for k, o in (("add", "+"), ("sub", "-"), ("mul", "*"))}
        for flag in sorted(flags):
            if flag == "nuw" and name in exact:
                out.append(f"({a} < {b})" if name == "sub" else f"({exact[name]} > {self.top})")
            elif flag == "nsw" and name in in_signs:
                out.append(f"({in_signs[name]} not between {low} and {high})")
            elif flag in ("nuw", "nsw") and name == "shl":
                out += [f"({b} >= {self.w})", f"({self.op('lshr' if flag == 'nuw' else 'ashr', value, b)} <> {a})"]
            elif flag == "exact" and name in ("lshr", "ashr"):
                out.append(f"({self.op('shl', value, b)} <> {a})")
            elif flag == "exact" and name in ("udiv", "sdiv"):
                out.append(f"({b} <> 0 and {self.op('urem' if name == 'udiv' else 'srem', a, b)} <> 0)")
            elif flag == "disjoint" and name == "or":
                out.append(f"(({a} & {b}) <> 0)")
            elif flag == "inrange" and name in SHIFTS:
                out.append(f"({b} >= {self.w})")
            elif flag == "nomin" and name == "abs":
                out.append(f"({a} = {self.half})")
            elif flag == "nozero" and name in ("ctlz", "cttz"):
                out.append(f"({a} = 0)")
            else:
                raise Unsupported(f"{flag} on {name}")
        return out
