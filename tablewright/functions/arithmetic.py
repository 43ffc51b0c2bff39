"""Arithmetic with the division rules of numpy, inside ANSI Spark.

``/`` never raises: n/0 is plus or minus infinity and 0/0 is missing. ``//`` rounds
down and ``%`` takes the sign of the divisor.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.errors import TransformError
from tablewright.functions.values import BOOL, FLOAT, INT, NULL, TEXT, Value

_MOST_BITS = 63
_NEGATIVE_POWER = "Whole numbers cannot be raised to a negative whole power"


def binary(op: str, left: Value, right: Value) -> Value:
    if op == "+" and {left.kind, right.kind} <= {TEXT, NULL}:
        return Value(F.concat(left.column.cast("string"), right.column.cast("string")), TEXT)
    if left.kind == right.kind == BOOL and op == "-":
        raise TransformError("Cannot subtract conditions")
    return _BINARY[op](left.number(), right.number())


def negative(value: Value) -> Value:
    number = value.number()
    return Value(-number.column, number.kind, *([-value.constant] if _plain(value) else []))


def power_of_ten(digits: int) -> float:
    return float(10**digits)


def round_half_even(value: Value, digits: int) -> Value:
    """Round as numpy does: scale, round to even, scale back."""
    if value.kind in (INT, BOOL) and digits >= 0:
        return value.number()
    number = value.clean().cast("double")
    scale = power_of_ten(abs(digits))
    if digits >= 0:
        rounded = F.rint(number * scale) / scale if digits else F.rint(number)
    else:
        rounded = F.rint(number / scale) * scale
    return Value(rounded.cast("bigint"), INT) if value.kind == INT else Value(rounded, FLOAT)


def _plus(a: Value, b: Value) -> Value:
    return _wide(a, b, a.column + b.column)


def _minus(a: Value, b: Value) -> Value:
    return _wide(a, b, a.column - b.column)


def _times(a: Value, b: Value) -> Value:
    return _wide(a, b, a.column * b.column)


def _wide(a: Value, b: Value, result: Column) -> Value:
    return Value(result, INT if a.kind == b.kind == INT else FLOAT)


def _divide(a: Value, b: Value) -> Value:
    n, d = a.column.cast("double"), b.column.cast("double")
    if _plain(b) and b.constant:
        return Value(n / d, FLOAT)
    # pow(0.0, -1) is +inf and pow(-0.0, -1) is -inf; 0 * inf is NaN, which is missing.
    return Value(F.when(d == 0, n * F.pow(d, F.lit(-1.0))).otherwise(n / d), FLOAT)


def _floor_divide(a: Value, b: Value) -> Value:
    if a.kind == b.kind == INT and _plain(b) and b.constant:
        quotient = F.call_function("div", a.column, b.column)
        rest = a.column % b.column
        short = (rest != 0) & ((rest < 0) != (b.column < 0))
        return Value(F.when(short, quotient - 1).otherwise(quotient), INT)
    # Not floor(n / d): the quotient may round up to the next whole number first.
    n, d = a.column.cast("double"), b.column.cast("double")
    rest = _modulo(Value(n, FLOAT), Value(d, FLOAT)).column
    exact = F.rint((n - rest) / d)
    return Value(F.when(d == 0, n * F.pow(d, F.lit(-1.0))).otherwise(exact), FLOAT)


def _modulo(a: Value, b: Value) -> Value:
    if a.kind == b.kind == INT and _plain(b) and b.constant:
        n, d, kind = a.column, b.column, INT
    else:
        n, d, kind = a.column.cast("double"), b.column.cast("double"), FLOAT
    rest = F.when(d == 0, F.lit(None)).otherwise(n % d)
    return Value(F.when((rest != 0) & ((rest < 0) != (d < 0)), rest + d).otherwise(rest), kind)


def _power(a: Value, b: Value) -> Value:
    if not a.kind == b.kind == INT:
        return Value(F.pow(a.column.cast("double"), b.column.cast("double")), FLOAT)
    if _plain(b) and b.constant < 0:
        raise TransformError(_NEGATIVE_POWER)
    if _plain(b) and b.constant <= _MOST_BITS:
        powers = [power for k, power in enumerate(_squares(a.column)) if b.constant >> k & 1]
        one = F.when(a.column.isNotNull(), F.lit(1).cast("bigint"))
        result = reduce(F.try_multiply, powers) if powers else one
    else:
        result = _whole_power(a.column, b.column)
    failed = a.column.isNotNull() & b.column.isNotNull() & result.isNull()
    return Value(result, INT, failed=failed, reason="a power does not fit 64 bits, or its exponent is negative")


def _whole_power(base: Column, exponent: Column) -> Column:
    """Square and multiply in BIGINT; NULL where the result does not fit or the exponent is negative.

    A square only counts where the exponent has its bit. Beyond 63 only 0, 1 and -1 have
    powers that fit.
    """
    one = F.lit(1).cast("bigint")
    small = reduce(
        F.try_multiply,
        [F.when(F.shiftright(exponent, k).bitwiseAND(1) == 1, power).otherwise(one) for k, power in enumerate(_squares(base))],
    )
    unit = F.when(exponent % 2 == 0, F.abs(base)).otherwise(base)
    within = F.when(exponent <= _MOST_BITS, small).when(base.between(-1, 1), unit)
    return F.when(base.isNotNull() & (exponent >= 0), within)


def _squares(base: Column) -> Iterator[Column]:
    """The column to the powers 1, 2, 4, 8, 16 and 32; NULL where they do not fit."""
    power = base.cast("bigint")
    for _ in range(_MOST_BITS.bit_length()):
        yield power
        power = F.try_multiply(power, power)


_BINARY: dict[str, Callable[[Value, Value], Value]] = {
    "+": _plus,
    "-": _minus,
    "*": _times,
    "/": _divide,
    "//": _floor_divide,
    "%": _modulo,
    "**": _power,
}


def _plain(value: Value) -> bool:
    return value.is_constant and isinstance(value.constant, (int, float))


# Function names in expressions and the Spark functions they stand for.
_MATH = {
    "sqrt": F.sqrt,
    "exp": F.exp,
    "expm1": F.expm1,
    "log": F.ln,
    "log1p": F.log1p,
    "log10": F.log10,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "arcsinh": F.asinh,
    "arccosh": F.acosh,
    "arctanh": F.atanh,
}
# Where a logarithm is minus infinity; Spark answers NULL there.
_POLES = {"log": 0, "log10": 0, "log1p": -1}
MATH_FUNCTIONS = {*_MATH, "abs", "floor", "ceil", "arctan2"}


def math_function(name: str, arguments: list[Value]) -> Value:
    if len(arguments) != (2 if name == "arctan2" else 1):
        raise TransformError(f"Wrong number of arguments for {name}()")
    numbers = [argument.number() for argument in arguments]
    x = numbers[0].column
    if name == "abs":
        return Value(F.abs(x), numbers[0].kind)
    if name == "arctan2":
        return Value(F.atan2(*(number.column.cast("double") for number in numbers)), FLOAT)
    x = x.cast("double")
    if name in ("floor", "ceil"):
        # Rounded in double: floor() to BIGINT would fail beyond its range.
        whole = F.rint(x)
        shifted = F.when(whole > x, whole - 1) if name == "floor" else F.when(whole < x, whole + 1)
        return Value(shifted.otherwise(whole), FLOAT)
    result = _MATH[name](x)
    if name in _POLES:
        result = F.when(x == _POLES[name], F.lit(-math.inf)).otherwise(result)
    return Value(result, FLOAT)
