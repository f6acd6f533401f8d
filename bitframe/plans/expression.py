"""Expression trees over machine integers, compiled to a value and a poison condition.

A tree is a variable's name, a number, or a tuple: an operation, its arguments, and last a string of flags if it has any. ``select``,
``poison``, ``zext``, ``sext`` and ``trunc`` are written ("select", test, a, b), ("poison", a) and ("zext", width, a).
With ``strict``, shifts by the width or more are poison without a flag, as instructions have it.
"""

from __future__ import annotations

from typing import NamedTuple

from ..functions.words import BINARY, COMPARE, SHIFTS, SPARK, Dialect, Unsupported, Words, number


FLAGS = frozenset({"nsw", "nuw", "exact", "disjoint", "inrange", "nomin", "nozero"})
DIVISIONS = ("udiv", "urem", "sdiv", "srem")


class Pair(NamedTuple):
    """SQL texts of a value and of when it is poison, and the value's width."""

    value: str
    poison: str
    width: int


def _any(*conditions: str) -> str:
    real = list(dict.fromkeys(c for c in conditions if c != "false"))
    return " or ".join(f"({c})" for c in real) if real else "false"


def _parts(tree: tuple) -> tuple[str, list, frozenset[str]]:
    """Operation, arguments and flags of a tuple."""
    name, *args = tree
    last = args[-1] if args else None
    if isinstance(last, str) and last.split() and set(last.split()) <= FLAGS:
        return name, args[:-1], frozenset(last.split())
    return name, args, frozenset()


def renamed(tree: object, suffix: str) -> object:
    """The tree with a suffix to all its variables."""
    if isinstance(tree, str):
        return tree + suffix
    if isinstance(tree, int):
        return tree
    name, args, flags = _parts(tree)
    kept = args[:1] if name in ("zext", "sext", "trunc") else []
    return (name, *kept, *(renamed(x, suffix) for x in args[len(kept) :]), *([" ".join(sorted(flags))] if flags else []))


def undefined(tree: object, width: int, dialect: Dialect = SPARK, poisonable: frozenset[str] = frozenset(), strict: bool = False) -> str:
    """SQL text of when evaluating a tree is undefined: a division by zero or by poison, or of the least number by minus one, anywhere in it."""
    if not isinstance(tree, tuple):
        return "false"
    name, args, _ = _parts(tree)
    kids = args[1:] if name in ("zext", "sext", "trunc") else args
    own = [undefined(x, width, dialect, poisonable, strict) for x in kids]
    if name in DIVISIONS:
        a, b = (compiled(x, width, dialect, poisonable, strict) for x in kids)
        words = Words(b.width, dialect)
        own += [f"({b.value}) = 0", b.poison]
        own += [f"({a.value}) = {words.half} and ({b.value}) = {words.top}"] if name in ("sdiv", "srem") else []
    return _any(*own)


def compiled(tree: object, width: int, dialect: Dialect = SPARK, poisonable: frozenset[str] = frozenset(), strict: bool = False) -> Pair:
    """Compile a tree; variables in ``poisonable`` have a boolean column <name>_poison."""
    if isinstance(tree, str):
        return Pair(tree, f"{tree}_poison" if tree in poisonable else "false", width)
    if isinstance(tree, int):
        if not 0 <= tree < 2**width:
            raise Unsupported(f"{tree} in {width} bits")
        return Pair(number(tree), "false", width)
    name, args, flags = _parts(tree)
    sub = lambda x, w=width: compiled(x, w, dialect, poisonable, strict)
    if name == "poison":
        return Pair(sub(args[0]).value, "true", width)
    if name == "freeze":  # ("freeze", x, choice): the choice, a variable of its own, where x is poison
        inner, choice = sub(args[0]), sub(args[1])
        return Pair(f"(case when {inner.poison} then {choice.value} else {inner.value} end)", "false", inner.width)
    if name == "select":
        test, a, b = (sub(x) for x in args)
        chosen = f"case when {test.value} <> 0 then {{}} else {{}} end"
        arm = "false" if a.poison == b.poison == "false" else chosen.format(a.poison, b.poison)
        return Pair(f"({chosen.format(a.value, b.value)})", _any(test.poison, arm), a.width)
    if name in ("zext", "sext", "trunc"):
        to, inner = args[0], sub(args[1])
        if (to <= inner.width) != (name == "trunc") or to == inner.width:
            raise Unsupported(f"{name} from {inner.width} to {to}")
        words = Words(to, dialect)
        value = inner.value if name == "zext" else words.wrap(inner.value if name == "trunc" else Words(inner.width, dialect).signed(inner.value))
        return Pair(value, inner.poison, to)
    parts = [sub(x) for x in args]
    w = parts[0].width
    if any(p.width != w for p in parts):
        raise Unsupported(f"{name} of different widths")
    words = Words(w, dialect)
    values = [p.value for p in parts]
    flags = flags | {"inrange"} if strict and name in SHIFTS else flags
    own = words.poison(name, flags, values[0], values[-1]) if flags else []
    return Pair(words.op(name, *values), _any(*(p.poison for p in parts), *own), w)


def variables(tree: object) -> list[str]:
    """Names in a tree, sorted."""
    if isinstance(tree, str):
        return [tree]
    if isinstance(tree, int):
        return []
    _, args, _ = _parts(tree)
    return sorted({v for x in args for v in variables(x)})


__all__ = ["BINARY", "COMPARE", "Pair", "compiled", "renamed", "undefined", "variables"]
