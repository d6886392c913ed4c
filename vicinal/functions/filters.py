"""Metadata filters: a JSON-like expression compiled once to a Catalyst predicate.

Every leaf is two-valued: what cannot be compared is false, and negations negate that. Missing fields equal null, but only
``$exists`` tells them apart. Numbers and booleans compare with one another, strings only with strings. An ordering between
unlike types is false. Whole numbers are compared exactly, however large. Patterns of ``$regex`` run in Java's dialect, with named
groups, classes and ``\\Z`` written as Python has them read likewise; one that does not compile is false.
"""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Callable, Mapping
from decimal import Decimal
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"
_WHOLE = r"(?i)^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\([0-9]+, ?0\))$"
#: Whole numbers of at most so many digits are compared as decimals.
_DIGITS = 38


class VariantField:
    """A key of a VARIANT column of metadata. Keys are literal: a dot in a key is part of it."""

    def __init__(self, metadata: Column, key: str):
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        self.path = f"$['{quoted}']"
        self.value = F.try_variant_get(metadata, self.path, "variant")
        self.kind = F.schema_of_variant(self.value)

    def _get(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", kind)

    def present(self) -> Column:
        return self.value.isNotNull()

    def is_null(self) -> Column:
        return self.value.isNull() | F.is_variant_null(self.value)

    def text(self) -> Column:
        return F.when(self.kind == "STRING", self._get("string"))

    def number(self) -> Column:
        return F.when(self.kind == "BOOLEAN", self._get("boolean").cast("double")).when(self.kind.rlike(_NUMBER), self._get("double"))

    def whole(self) -> Column:
        return F.when(self.kind.rlike(_WHOLE), self._get(f"decimal({_DIGITS},0)"))

    def items(self) -> Column:
        return F.when(self.kind.startswith("ARRAY"), self._get("array<variant>"))

    def same(self, value: Any) -> Column:
        if isinstance(value, (list, dict)):
            return F.to_json(self.value) == json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        return _equals(self, value)


class VariantItem(VariantField):
    """An element of a metadata list."""

    def __init__(self, value: Column):
        self.value = value
        self.kind = F.schema_of_variant(value)


class TypedField:
    """A real column, compared as what it is, so that Catalyst can push the predicate into the scan."""

    def __init__(self, column: Column, kind: str):
        self.column, self.type = column, kind

    def present(self) -> Column:
        return self.column.isNotNull()

    def is_null(self) -> Column:
        return self.column.isNull()

    def text(self) -> Column:
        return self.column if self.type == "string" else F.lit(None).cast("string")

    def number(self) -> Column:
        if self.type == "boolean":
            return self.column.cast("int")
        return self.column if self.type != "string" and not self.type.startswith("array") else F.lit(None).cast("double")

    def whole(self) -> Column | None:
        return None if self.type in ("double", "float", "boolean") or self.type.startswith("decimal") and not self.type.endswith(",0)") else self.number()

    def items(self) -> Column | None:
        return self.column if self.type.startswith("array") else None

    def same(self, value: Any) -> Column:
        return _equals(self, value)


Field = VariantField | TypedField
Resolver = Callable[[str], Field | None]


def variant_resolver(metadata: Column) -> Resolver:
    """Fields of a VARIANT (or JSON string, via ``parse_json``) column."""
    return lambda key: VariantField(metadata, key)


def column_resolver(df) -> Resolver:
    """Fields that are top-level columns of ``df``; others are missing."""
    kinds = dict(df.dtypes)
    return lambda key: TypedField(F.col(f"`{key}`"), kinds[key]) if key in kinds else None


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _as_is(c: Column) -> Column:
    """Leaves of a predicate that is not negated: null drops a row as false does, and plain comparisons reach the scan."""
    return c


def _equals(field: Field, value: Any) -> Column:
    if value is None:
        return field.is_null()
    if isinstance(value, str):
        return field.text() == value
    if isinstance(value, (bool, int, float)):
        return _compared(field, "==", value)
    return F.lit(False)


_COMPARE: dict[str, Callable[[Any, Any], Any]] = {"==": operator.eq, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def _compared(field: Field, op: str, value: bool | int | float) -> Column:
    """A number of the field against ``value``, exactly: whole numbers as such, others as doubles against what ``value`` rounds to."""
    if isinstance(value, float) and not value.is_integer():
        return _COMPARE[op](field.number(), F.lit(value))
    exact = int(value)
    small = abs(exact) < 2**63
    try:
        rounded = float(exact)
    except OverflowError:
        rounded = math.inf if exact > 0 else -math.inf
    near = rounded if not math.isinf(rounded) else exact + (1 if exact > 0 else -1)
    if near == exact:
        double = _COMPARE[op](field.number(), F.lit(rounded))
    elif op == "==":
        double = field.number().isNotNull() & F.lit(False)
    else:  # no double equals it: one is above if it is above, or is, what rounding down gave
        strict = "$gt" if op in ("$gt", "$gte") else "$lte"
        loose = "$gte" if op in ("$gt", "$gte") else "$lt"
        double = _COMPARE[strict if near < exact else loose](field.number(), F.lit(rounded))
    whole = field.whole()
    if whole is None:
        return double
    if isinstance(field, TypedField):  # the column as it is, so that the predicate can reach the scan
        return _COMPARE[op](whole, F.lit(exact if small else Decimal(exact)))
    if len(str(abs(exact))) > _DIGITS:
        fits = F.lit({"==": False, "$gt": exact < 0, "$gte": exact < 0, "$lt": exact > 0, "$lte": exact > 0}[op])
        return F.when(whole.isNotNull(), fits).otherwise(double)
    return F.when(whole.isNotNull(), _COMPARE[op](whole, F.lit(Decimal(exact)))).otherwise(double)


def _order(field: Field, op: str, value: Any, wrap: Callable[[Column], Column]) -> Column:
    if isinstance(value, str):
        return wrap(_COMPARE[op](field.text(), F.lit(value)))
    return wrap(_compared(field, op, value)) if isinstance(value, (bool, int, float)) else F.lit(False)


def _element(field: Field, value: Any) -> Callable[[Column], Column]:
    """Whether an element of the field's list equals ``value``."""
    if isinstance(field, TypedField):
        return lambda x: _equals(TypedField(x, field.type[6:-1]), value)
    return lambda x: VariantItem(x).same(value)


def _contains(field: Field, value: Any, wrap: Callable[[Column], Column]) -> Column:
    parts = []
    if (items := field.items()) is not None:
        parts.append(wrap(F.exists(items, _element(field, value))))
    if isinstance(value, str):
        parts.append(wrap(F.contains(field.text(), F.lit(value))))
    return _any(parts)


def java_pattern(pattern: str) -> str:
    """``pattern`` in Java's dialect: named groups get plain names, a bracket or && within a class is itself, and ``\\Z`` is the very end."""
    out, names, at, inside = [], {}, 0, False
    while at < len(pattern):
        rest, taken = pattern[at:], 1
        if rest[0] == "\\":
            taken = 2
            out.append("\\z" if rest[:2] == "\\Z" and not inside else rest[:2])
        elif inside:
            taken = 2 if rest[:2] == "&&" else 1
            out.append("&\\&" if taken == 2 else "\\[" if rest[0] == "[" else rest[0])
            inside = rest[0] != "]"
        elif rest[0] == "[":
            start = "[^" if rest[:2] == "[^" else "["
            taken, inside = len(start), True
            out.append(start)
            if rest[taken : taken + 1] == "]":  # the first one of a class stands for itself
                taken += 1
                out.append("\\]")
        elif rest[:4] in ("(?P<", "(?P=") and (end := rest.find(">" if rest[3] == "<" else ")")) > 0:
            name = names.setdefault(rest[4:end], f"g{len(names) + 1}")
            taken = end + 1
            out.append(f"(?<{name}>" if rest[3] == "<" else f"\\k<{name}>")
        else:
            out.append(rest[0])
        at += taken
    return "".join(out)


def _compiles(pattern: str) -> bool:
    """Whether the engine that will run the pattern takes it."""
    jvm = SparkContext._active_spark_context._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def _regex(field: Field, pattern: Any, wrap: Callable[[Column], Column]) -> Column:
    if not isinstance(pattern, str) or not _compiles(java := java_pattern(pattern)):
        return F.lit(False)
    return wrap(field.text().rlike(java))


def _operator(field: Field, op: str, value: Any, wrap: Callable[[Column], Column]) -> Column:
    match op:
        case "$eq":
            return wrap(field.same(value))
        case "$ne":
            return ~_false(field.same(value))
        case "$gt" | "$gte" | "$lt" | "$lte":
            return _order(field, op, value, wrap)
        case "$in":
            return _any([wrap(field.same(v)) for v in value]) if isinstance(value, (list, tuple, set)) else F.lit(False)
        case "$nin":
            return ~_any([_false(field.same(v)) for v in value]) if isinstance(value, (list, tuple, set)) else F.lit(False)
        case "$exists":
            return field.present() if value else ~field.present()
        case "$contains":
            return _contains(field, value, wrap)
        case "$all":
            if not isinstance(value, (list, tuple, set)) or (items := field.items()) is None:
                return F.lit(False)
            return wrap(items.isNotNull() & _all([wrap(F.exists(items, _element(field, v))) for v in value]))
        case "$regex":
            return _regex(field, value, wrap)
        case _:  # unknown operators never match
            return F.lit(False)


def _condition(field: Field | None, condition: Any, wrap: Callable[[Column], Column]) -> Column:
    field = field if field is not None else TypedField(F.lit(None).cast("string"), "string")
    if not isinstance(condition, Mapping):
        return wrap(field.same(condition))
    return _all([_operator(field, op, value, wrap) for op, value in condition.items()])


def compile_filter(expr: Mapping[str, Any] | None, resolve: Resolver | Column, two_valued: bool = False) -> Column:
    """The predicate of a filter expression; ``resolve`` is a resolver or the VARIANT metadata column.

    As it stands it is made for ``filter``, where null counts as false. With ``two_valued`` it is never null.
    """
    if isinstance(resolve, Column):
        resolve = variant_resolver(resolve)
    wrap = _false if two_valued else _as_is
    branch = lambda v, two: compile_filter(v, resolve, two) if isinstance(v, Mapping) else F.lit(False)
    parts = []
    for key, value in (expr or {}).items():
        listed = isinstance(value, (list, tuple))
        match key:
            case "$and":
                parts.append(_all([branch(v, two_valued) for v in value]) if listed else F.lit(False))
            case "$or":
                parts.append(_any([branch(v, two_valued) for v in value]) if listed else F.lit(False))
            case "$nor":
                parts.append(~_any([branch(v, True) for v in value]) if listed else F.lit(False))
            case "$not":
                parts.append(~branch(value, True) if isinstance(value, Mapping) else F.lit(False))
            case _:
                parts.append(_condition(resolve(key), value, wrap))
    return _all(parts)


def parse_metadata(text: str | None) -> dict[str, Any]:
    """A JSON object, or ``key=value, key=value`` with booleans and numbers recognised; a bare word is true."""
    text = (text or "").strip()
    if not text:
        return {}
    if text.startswith("{"):
        found = json.loads(text)
        if not isinstance(found, dict):
            raise ValueError("metadata must be an object")
        return found
    out: dict[str, Any] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, eq, value = part.partition("=")
        out[key.strip()] = _scalar(value.strip()) if eq else True
    return out


def _scalar(text: str) -> Any:
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_vector(text: str) -> list[float]:
    """A JSON list or comma-separated numbers."""
    text = text.strip()
    return [float(x) for x in (json.loads(text) if text.startswith("[") else filter(None, (p.strip() for p in text.split(","))))]
