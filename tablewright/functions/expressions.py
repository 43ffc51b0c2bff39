"""Expression texts as Spark columns.

A text is read by Python's own ``ast`` and each node becomes a column. Only the
operators, functions and methods in the tables below exist; nothing is evaluated as
Python. Columns are written ``alias.column``, ``alias__column``, ``deriv.name`` or,
in the target table, by their plain name.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TransformError
from tablewright.functions import aggregates, arithmetic, casts
from tablewright.functions.compare import between, compare, is_in, is_missing
from tablewright.functions.text import WHITESPACE, java_pattern, regexp_replace
from tablewright.functions.values import (
    BOOL,
    FLOAT,
    INT,
    NULL,
    TEXT,
    TIME,
    Mask,
    Value,
    as_kind,
    as_mask,
    as_value,
    column_value,
    common_kind,
    literal,
)
from tablewright.names import field, to_physical_column

Operand = Value | Mask

# Constructs that are refused before anything is read.
_FORBIDDEN = (r"\.\s*__", r";", r"(?i)\bimport\b", r"(?i)\beval\b", r"(?i)\bexec\b")

_BINARY: dict[type[ast.AST], str] = {
    ast.Add: "+",
    ast.Sub: "-",
    ast.Mult: "*",
    ast.Div: "/",
    ast.FloorDiv: "//",
    ast.Mod: "%",
    ast.Pow: "**",
}
_COMPARISONS: dict[type[ast.AST], str] = {
    ast.Eq: "==",
    ast.NotEq: "!=",
    ast.Lt: "<",
    ast.LtE: "<=",
    ast.Gt: ">",
    ast.GtE: ">=",
}
_ARITHMETIC_METHODS = {
    "add": "+",
    "sub": "-",
    "mul": "*",
    "div": "/",
    "truediv": "/",
    "floordiv": "//",
    "mod": "%",
    "pow": "**",
}
_COMPARE_METHODS = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_CONSTANTS: dict[str, Any] = {"inf": float("inf"), "Inf": float("inf"), "nan": None, "NaT": None}
_REQUIRED = object()


def check_safety(text: str) -> None:
    for pattern in _FORBIDDEN:
        if re.search(pattern, text):
            raise TransformError(f"Unsafe expression rejected: {text}", phase="expressions", expression=text)


def dotted_names(text: str) -> list[tuple[str, str]]:
    """Every ``word.word`` an expression starts a reference with; none if unreadable."""
    try:
        tree = _parse(text)
    except (SyntaxError, tokenize.TokenError):
        return []
    return [
        (node.value.id, node.attr)
        for node in ast.walk(tree)
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name)
    ]


@dataclass(frozen=True)
class Failure:
    """A column of a frame that is true where an expression has no result although it should."""

    owner: str
    column: str
    expression: str
    reason: str


def evaluate(
    frame: DataFrame, text: str, *, phase: str, failures: list[Failure] | None = None, owner: str = ""
) -> tuple[DataFrame, Operand]:
    """The column an expression stands for, and the frame it belongs to.

    The frame is the given one, or that frame with helper columns joined to it. Rows that
    an expression fails for are missing values, and a column that tells them is added to
    the frame and to ``failures``, for a gate to count. Without that list such a row stops
    the job where its value is asked for.
    """
    check_safety(text)
    try:
        reader = _Reader(frame)
        operand = reader.read(_parse(text))
    except TransformError as error:
        error.expression = error.expression or text
        error.phase = error.phase or phase
        raise
    except (SyntaxError, tokenize.TokenError) as problem:
        raise TransformError(
            f"Expression cannot be read: {text}", phase=phase, expression=text
        ) from problem
    if not reader.failed:
        return reader.frame, operand
    failed = reduce(lambda a, b: a | b, (F.coalesce(value.failed, F.lit(False)) for value in reader.failed))
    reason = ", ".join(dict.fromkeys(value.reason for value in reader.failed))
    if failures is None:
        return reader.frame, _stopping(operand, failed, f"{reason}: {text}")
    name = f"__failed{len(failures)}"
    while name in reader.frame.columns:
        name = "_" + name
    failures.append(Failure(owner, name, text, reason))
    return reader.frame.withColumn(name, failed), operand


def _stopping(operand: Operand, failed: Column, message: str) -> Operand:
    """The operand, with an error raised for rows that failed."""

    def checked(column: Column) -> Column:
        return F.when(failed, F.raise_error(F.lit(message))).otherwise(column)

    if isinstance(operand, Mask):
        return Mask(checked(operand.holds), checked(operand.fails))
    return Value(checked(operand.column), operand.kind, nan_free=operand.nan_free)


def _parse(text: str) -> ast.expr:
    """Read a text; ``&`` and ``|`` bind like ``and`` and ``or``, backticks quote names."""
    quoted = re.compile(r"""('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|`([^`]+)`""")
    text = quoted.sub(lambda m: m[1] if m[1] else f"__column__({m[2]!r})", text)
    words = {"&": "and", "|": "or"}
    tokens = [
        (tokenize.NAME, words[token.string]) if token.string in words else (token.type, token.string)
        for token in tokenize.generate_tokens(io.StringIO(text.strip()).readline)
    ]
    return ast.parse(tokenize.untokenize(tokens).strip(), mode="eval").body


class _Reader:
    """Turns the nodes of one expression into columns of one frame."""

    def __init__(self, frame: DataFrame) -> None:
        self.frame = frame
        self.failed: list[Value] = []
        self.names = set(frame.columns)
        self.helpers = 0

    def read(self, node: ast.AST) -> Operand:
        for kind, reading in self._NODES.items():
            if isinstance(node, kind):
                return reading(self, node)
        raise TransformError(f"Not supported in expressions: {type(node).__name__}")

    def value(self, node: ast.AST) -> Value:
        return as_value(self.read(node))

    def _constant(self, node: ast.Constant) -> Operand:
        return literal(node.value)

    def _name(self, node: ast.Name) -> Operand:
        if node.id in self.names:
            return column_value(self.frame, node.id)
        if node.id in _CONSTANTS:
            return literal(_CONSTANTS[node.id])
        raise TransformError(f"Column not found: {node.id}", column=node.id)

    def _attribute(self, node: ast.Attribute) -> Operand:
        inner = node.value
        if isinstance(inner, ast.Name) and inner.id not in self.names:
            return self.column(to_physical_column(inner.id, node.attr))
        if isinstance(inner, ast.Attribute) and inner.attr == "dt" and self._is_accessor(inner):
            return self._date_part(self.value(inner.value), node.attr)
        raise TransformError(f"Unknown attribute: {node.attr}")

    def column(self, physical: str) -> Value:
        if physical not in self.names:
            raise TransformError(f"Column not found: {physical}", column=physical)
        return column_value(self.frame, physical)

    def _is_accessor(self, node: ast.Attribute) -> bool:
        """Whether ``x.str`` or ``x.dt`` is an accessor and not the column ``x__str``."""
        inner = node.value
        return not (
            isinstance(inner, ast.Name)
            and inner.id not in self.names
            and to_physical_column(inner.id, node.attr) in self.names
        )

    def _binary(self, node: ast.BinOp) -> Operand:
        operator = _BINARY.get(type(node.op))
        if operator is None:
            raise TransformError(f"Unknown operator: {type(node.op).__name__}")
        return self._noted(arithmetic.binary(operator, self.value(node.left), self.value(node.right)))

    def _unary(self, node: ast.UnaryOp) -> Operand:
        operand = self.read(node.operand)
        if isinstance(node.op, ast.USub):
            return arithmetic.negative(as_value(operand))
        if isinstance(node.op, ast.UAdd):
            return as_value(operand).number()
        if isinstance(node.op, ast.Invert) and isinstance(operand, Value) and operand.kind == INT:
            return Value(F.bitwise_not(operand.column), INT)
        return ~as_mask(operand)

    def _junction(self, node: ast.BoolOp) -> Operand:
        parts = [self.read(part) for part in node.values]
        both = isinstance(node.op, ast.And)
        if all(isinstance(part, Value) and part.kind == INT for part in parts):
            result = parts[0].column
            for part in parts[1:]:
                result = result.bitwiseAND(part.column) if both else result.bitwiseOR(part.column)
            return Value(result, INT)
        mask = as_mask(parts[0])
        for part in parts[1:]:
            mask = mask & as_mask(part) if both else mask | as_mask(part)
        return mask

    def _comparison(self, node: ast.Compare) -> Operand:
        sides = [node.left, *node.comparators]
        masks = [self._pair(a, op, b) for a, op, b in zip(sides, node.ops, sides[1:])]
        result = masks[0]
        for mask in masks[1:]:
            result = result & mask
        return result

    def _pair(self, left: ast.AST, op: ast.cmpop, right: ast.AST) -> Mask:
        if isinstance(right, (ast.List, ast.Tuple)):
            member = is_in(self.value(left), self._literals(right))
            if isinstance(op, (ast.In, ast.Eq)):
                return member
            if isinstance(op, (ast.NotIn, ast.NotEq)):
                return ~member
        if type(op) not in _COMPARISONS:
            raise TransformError("in and not in need a list of literals")
        return compare(_COMPARISONS[type(op)], self.value(left), self.value(right))

    def _literals(self, node: ast.AST) -> list[Any]:
        try:
            found = ast.literal_eval(node)
        except ValueError as problem:
            raise TransformError("A list of literals is needed") from problem
        return list(found) if isinstance(found, (list, tuple, set)) else [found]

    def _call(self, node: ast.Call) -> Operand:
        if isinstance(node.func, ast.Name):
            return self._function(node.func.id, node)
        if not isinstance(node.func, ast.Attribute):
            raise TransformError("Only named functions can be called")
        method, target = node.func.attr, node.func.value
        arguments = _Arguments(self, node, method)
        if isinstance(target, ast.Attribute) and target.attr == "str" and self._is_accessor(target):
            subject = self.value(target.value)
            if subject.kind not in (TEXT, NULL):
                raise TransformError(f".str applies to text, not to {subject.kind} values")
            return arguments.done(_choose(_TEXT_METHODS, method)(arguments, subject.column.cast("string")))
        if isinstance(target, ast.Attribute) and target.attr == "dt" and self._is_accessor(target):
            return arguments.done(self._date_part(self.value(target.value), method))
        return arguments.done(self._method(method, self.read(target), arguments))

    def _function(self, name: str, node: ast.Call) -> Operand:
        if name == "__column__":
            return self._quoted(ast.literal_eval(node.args[0]))
        if name not in arithmetic.MATH_FUNCTIONS:
            raise TransformError(f"Unknown function: {name}")
        return arithmetic.math_function(name, [self.value(argument) for argument in node.args])

    def _quoted(self, name: str) -> Value:
        if name in self.names:
            return column_value(self.frame, name)
        alias, _, column = name.partition(".")
        return self.column(to_physical_column(alias, column) if column else name)

    def _method(self, name: str, operand: Operand, arguments: _Arguments) -> Operand:
        value = as_value(operand)
        if name in _ARITHMETIC_METHODS:
            return self._noted(arithmetic.binary(_ARITHMETIC_METHODS[name], value, arguments.value("other")))
        if name in _COMPARE_METHODS:
            return compare(_COMPARE_METHODS[name], value, arguments.value("other"))
        if name in aggregates.AGGREGATES:
            options: dict[str, Any] = {}
            if name == "quantile":
                options["probability"] = arguments.plain("q", 0.5)
            if name in ("std", "var"):
                arguments.skip("axis")
                arguments.skip("skipna")
                options["ddof"] = arguments.plain("ddof", 1)
            return aggregates.aggregate(self.frame, name, value, **options)
        if name == "rank":
            return self._rank(value, arguments)
        if name == "astype":
            return self._cast(value, arguments.plain("dtype"))
        return _choose(_METHODS, name)(arguments, value)

    def _rank(self, value: Value, arguments: _Arguments) -> Value:
        arguments.skip("axis")
        method, percent = arguments.plain("method", "average"), arguments.plain("pct", False)
        name = self._helper_name()
        self.frame = aggregates.add_rank(self.frame, value, name, method, percent)
        return column_value(self.frame, name)

    def _helper_name(self) -> str:
        self.helpers += 1
        while f"__helper{self.helpers}" in self.frame.columns:
            self.helpers += 1
        return f"__helper{self.helpers}"

    def _stored(self, value: Value) -> Value:
        """The value as a column of the frame, for a formula that mentions it often."""
        name = self._helper_name()
        self.frame = self.frame.withColumn(name, value.clean())
        return Value(field(name), value.kind, nan_free=True)

    def _cast(self, value: Value, target: Any) -> Value:
        wanted = {"int": "int64", "float": "float64", "string": "str", "object": "str"}.get(target, target)
        if wanted in ("bool", "boolean"):
            return Value(as_kind(value, BOOL), BOOL)
        if wanted not in casts.CAST_KINDS:
            raise TransformError(f"Unknown type: {target}")
        value = self._stored(value)
        if wanted == casts.INT64 and value.kind == FLOAT:
            whole = casts.truncated(value.column)
            return self._noted(Value(whole, INT, failed=whole.isNull(), reason=f"cannot cast to {target}"))
        result = casts.cast(self.frame, value, wanted, name=self._helper_name())
        self.frame = result.frame
        failed = None
        if not result.required or value.kind == TEXT:
            failed = result.failed(value.clean(), result.column)
        return self._noted(Value(result.column, casts.CAST_KINDS[wanted], failed=failed, reason=f"cannot cast to {target}"))

    def _noted(self, value: Value) -> Value:
        """The value, with the rows it fails for kept in mind."""
        if value.failed is None:
            return value
        self.failed.append(value)
        return replace(value, failed=None, reason="")

    def _date_part(self, value: Value, name: str) -> Value:
        if value.kind != TIME:
            raise TransformError(f".dt applies to timestamps, not to {value.kind} values")
        part = _choose(_DATE_PARTS, name)(value.column)
        if name in ("date", "normalize"):
            return Value(part.cast("timestamp_ntz"), TIME)
        return Value(part, TEXT if name in ("day_name", "month_name") else INT)

    _NODES: dict[type[ast.AST], Callable[[_Reader, Any], Operand]] = {
        ast.Constant: _constant,
        ast.Name: _name,
        ast.Attribute: _attribute,
        ast.BinOp: _binary,
        ast.UnaryOp: _unary,
        ast.BoolOp: _junction,
        ast.Compare: _comparison,
        ast.Call: _call,
    }


class _Arguments:
    """The arguments of one call, taken in order or by name."""

    def __init__(self, reader: _Reader, node: ast.Call, name: str) -> None:
        self.reader = reader
        self.name = name
        self.positional = list(node.args)
        self.named = {keyword.arg: keyword.value for keyword in node.keywords}

    def _take(self, key: str, default: Any) -> ast.AST | Any:
        if key in self.named:
            return self.named.pop(key)
        if self.positional:
            return self.positional.pop(0)
        if default is _REQUIRED:
            raise TransformError(f"{self.name}() needs the argument '{key}'")
        return default

    def operand(self, key: str, default: Any = _REQUIRED) -> Operand:
        found = self._take(key, default)
        return self.reader.read(found) if isinstance(found, ast.AST) else found

    def value(self, key: str, default: Any = _REQUIRED) -> Value:
        return as_value(self.operand(key, default))

    def plain(self, key: str, default: Any = _REQUIRED) -> Any:
        found = self._take(key, default)
        if not isinstance(found, ast.AST):
            return found
        if isinstance(found, ast.Name):
            return found.id
        try:
            return ast.literal_eval(found)
        except ValueError as problem:
            raise TransformError(f"{self.name}() needs a literal for '{key}'") from problem

    def skip(self, key: str) -> None:
        self.named.pop(key, None)

    def done(self, result: Operand) -> Operand:
        if self.positional or self.named:
            raise TransformError(f"Too many arguments for {self.name}()")
        return result


def _choose(table: dict[str, Any], name: str) -> Any:
    if name not in table:
        raise TransformError(f"Unknown method: {name}")
    return table[name]


def _select(condition: Column, yes: Value, no: Value) -> Value:
    kind = common_kind([yes, no], phase="expressions", what="A condition's result")
    if kind == NULL:
        return Value(F.lit(None), NULL, None)
    return Value(F.when(condition, as_kind(yes, kind)).otherwise(as_kind(no, kind)), kind)


def _where(a: _Arguments, v: Value) -> Operand:
    return _select(as_mask(a.operand("cond")).holds, v, a.value("other", literal(None)))


def _mask(a: _Arguments, v: Value) -> Operand:
    return _select(as_mask(a.operand("cond")).holds, a.value("other", literal(None)), v)


def _fill(a: _Arguments, v: Value) -> Operand:
    other = a.value("value" if a.name == "fillna" else "other")
    return _select(v.present(), v, other)


def _replace(a: _Arguments, v: Value) -> Operand:
    wanted = a._take("to_replace", _REQUIRED)
    return _select(is_in(v, a.reader._literals(wanted)).holds, a.value("value"), v)


def _clip(a: _Arguments, v: Value) -> Operand:
    result = v
    for key, op in (("lower", "<"), ("upper", ">")):
        bound = a.value(key, literal(None))
        if bound.kind != NULL:
            result = _select(compare(op, result, bound).holds, bound, result)
    return result


_METHODS: dict[str, Callable[[_Arguments, Value], Operand]] = {
    "where": _where,
    "mask": _mask,
    "fillna": _fill,
    "combine_first": _fill,
    "replace": _replace,
    "clip": _clip,
    "isna": lambda a, v: is_missing(v),
    "isnull": lambda a, v: is_missing(v),
    "notna": lambda a, v: ~is_missing(v),
    "notnull": lambda a, v: ~is_missing(v),
    "isin": lambda a, v: is_in(v, a.plain("values")),
    "between": lambda a, v: between(v, a.value("left"), a.value("right"), a.plain("inclusive", "both")),
    "abs": lambda a, v: arithmetic.math_function("abs", [v]),
    "round": lambda a, v: arithmetic.round_half_even(v, a.plain("decimals", 0)),
}


def _text(column: Column) -> Value:
    return Value(column, TEXT)


def _condition(column: Column) -> Mask:
    return Mask(column, ~F.coalesce(column, F.lit(False)))


def _searched(a: _Arguments, text: Column, template: str) -> Operand:
    pattern = str(a.plain("pat"))
    flags = "" if a.plain("case", True) else "(?iu)"
    a.skip("flags")
    a.skip("na")
    if not a.plain("regex", True):
        if flags:
            return _condition(F.contains(F.lower(text), F.lit(pattern.lower())))
        return _condition(F.contains(text, F.lit(pattern)))
    return _condition(text.rlike(flags + template % java_pattern(pattern)))


def _substitute(a: _Arguments, text: Column) -> Operand:
    pattern, replacement = str(a.plain("pat")), str(a.plain("repl"))
    if a.plain("regex", False):
        return _text(regexp_replace(text, pattern, replacement))
    if not pattern:
        raise TransformError("str.replace() needs a text to look for")
    return _text(F.replace(text, F.lit(pattern), F.lit(replacement)))


def _affix(a: _Arguments, text: Column) -> Operand:
    wanted = a.plain("pat")
    test = text.startswith if a.name == "startswith" else text.endswith
    options = [test(option) for option in ([wanted] if isinstance(wanted, str) else wanted)]
    a.skip("na")
    result = options[0]
    for option in options[1:]:
        result = result | option
    return _condition(result)


def _strip(a: _Arguments, text: Column) -> Operand:
    characters = F.lit(a.plain("to_strip", None) or WHITESPACE)
    trim = {"strip": F.btrim, "lstrip": F.ltrim, "rstrip": F.rtrim}[a.name]
    return _text(trim(text, characters))


def _title(a: _Arguments, text: Column) -> Operand:
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return _text(F.array_join(F.transform(runs, F.initcap), ""))


def _zero_fill(a: _Arguments, text: Column) -> Operand:
    width = int(a.plain("width"))
    sign = F.regexp_extract(text, r"^[+-]", 0)
    digits = F.substring(text, F.length(sign) + 1, F.length(text))
    filled = F.concat(sign, F.lpad(digits, F.lit(width) - F.length(sign), F.lit("0")))
    return _text(F.when(F.length(text) >= width, text).otherwise(filled))


def _slice(a: _Arguments, text: Column) -> Operand:
    start, stop = a.plain("start", None), a.plain("stop", None)
    length = F.length(text)

    def place(at: int | None, default: Column) -> Column:
        if at is None:
            return default
        return F.lit(at) if at >= 0 else F.greatest(length + at, F.lit(0))

    first, last = place(start, F.lit(0)), place(stop, length)
    return _text(F.substring(text, first + 1, F.greatest(last - first, F.lit(0))))


_TEXT_METHODS: dict[str, Callable[[_Arguments, Column], Operand]] = {
    "upper": lambda a, t: _text(F.upper(t)),
    "lower": lambda a, t: _text(F.lower(t)),
    "len": lambda a, t: Value(F.length(t), INT),
    "strip": _strip,
    "lstrip": _strip,
    "rstrip": _strip,
    "contains": lambda a, t: _searched(a, t, "%s"),
    "match": lambda a, t: _searched(a, t, "^(?:%s)"),
    "fullmatch": lambda a, t: _searched(a, t, r"\A(?:%s)\z"),
    "startswith": _affix,
    "endswith": _affix,
    "replace": _substitute,
    "title": _title,
    "zfill": _zero_fill,
    "slice": _slice,
}

_DATE_PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year,
    "month": F.month,
    "day": F.day,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "dayofweek": F.weekday,
    "weekday": F.weekday,
    "dayofyear": F.dayofyear,
    "quarter": F.quarter,
    "date": F.to_date,
    "normalize": F.to_date,
    "day_name": lambda c: F.date_format(c, "EEEE"),
    "month_name": lambda c: F.date_format(c, "MMMM"),
}
