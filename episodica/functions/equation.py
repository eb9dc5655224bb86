"""Arithmetic answers. Checks on the text run in the JVM; only survivors are evaluated in Python."""

from __future__ import annotations

import ast
import math
import operator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Answer tag, permitted characters and tolerance.
ANSWER = r"(?d)<answer>(.*?)</answer>"
ALLOWED = r"^[\d+\-*/().\s]+$"
TOLERANCE = 1e-5
#: Integer powers above so many bits are not computed. As a whole answer they are unequal to any target; inside a larger
#: expression the answer stays undecided and its reward is null.
MAX_BITS = 1_000_000

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv,
           ast.FloorDiv: operator.floordiv}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


class Undecided(Exception):
    """A power too large to compute."""


def _power(base, exponent):
    whole = isinstance(base, int) and isinstance(exponent, int)
    if whole and exponent > 0 and abs(base) > 1 and exponent * math.log2(abs(base)) > MAX_BITS:
        raise Undecided
    return base ** exponent


def _value(node):
    match node:
        case ast.Expression(body=body):
            return _value(body)
        case ast.Constant(value=int() | float() as number):
            return number
        case ast.UnaryOp(op=op, operand=operand) if type(op) in _UNARY:
            return _UNARY[type(op)](_value(operand))
        case ast.BinOp(op=ast.Pow(), left=left, right=right):
            return _power(_value(left), _value(right))
        case ast.BinOp(op=op, left=left, right=right) if type(op) in _BINARY:
            return _BINARY[type(op)](_value(left), _value(right))
    raise ValueError("not arithmetic")


def arithmetic_value(text: str | None) -> float | None:
    """Value of an arithmetic expression: None when it has none, infinity beyond doubles, NaN when it is undecided."""
    if text is None:
        return None
    try:
        tree = ast.parse(text, mode="eval")
        return float(_value(tree))
    except Undecided:
        return math.inf if _huge(tree.body) else math.nan
    except Exception:
        return None


def _huge(node) -> bool:
    """Is an undecided expression a power, or a tower of powers, beyond all doubles?"""
    match node:
        case ast.BinOp(op=ast.Pow(), left=left, right=right):
            try:
                if abs(_value(left)) <= 1:
                    return False
            except Exception:
                return False
            try:
                return _value(right) > 0
            except Undecided:
                return _huge(right)
    return False


@F.arrow_udf(T.DoubleType())
def _evaluate(expressions: pa.Array) -> pa.Array:
    return pa.array([arithmetic_value(e) for e in expressions.to_pylist()], pa.float64())


def answer_of(completion: Column) -> Column:
    """The stripped text inside the first answer tag; empty when there is none."""
    return F.btrim(F.regexp_extract(completion, ANSWER, 1), F.lit(" \t\r\n\x0b\f"))


def equation_candidate(completion: Column, nums: Column) -> Column:
    """The answer when it uses exactly the given numbers and only permitted characters, else NULL."""
    answer = answer_of(completion)
    used = F.array_sort(F.transform(F.regexp_extract_all(answer, F.lit(r"(\d+)"), F.lit(1)),
                                    lambda n: n.try_cast("bigint")))
    return F.when((used == F.array_sort(nums.cast("array<bigint>"))) & answer.rlike(ALLOWED), answer)


def reward_equation(completion: Column, target: Column, nums: Column) -> Column:
    """1.0 when the answer uses the numbers exactly once each and equals the target, else 0.0; null if undecided."""
    value = _evaluate(equation_candidate(completion, nums))
    return F.when(F.isnan(value), F.lit(None).cast("double")).when(F.abs(value - target) < TOLERANCE, 1.0).otherwise(0.0)
