"""Expression strings in Python syntax, translated to native columns.

The grammar: names, numbers, strings, ``+ - * / // % **``, comparisons (also chained),
``& | ^ ~`` as logic on comparisons and as bits on numbers, ``and or not``, ``where(c, a, b)``
and the names of the element-wise functions.  An assignment ``a = expr`` names its result.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.elementwise import BINARY, UNARY, divide, floor_divide, mod

_OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: divide, ast.FloorDiv: floor_divide, ast.Mod: mod, ast.Pow: F.pow, ast.LShift: BINARY["left_shift"], ast.RShift: BINARY["right_shift"]}
_BITS = {ast.BitAnd: ("bitwiseAND", lambda a, b: a & b), ast.BitOr: ("bitwiseOR", lambda a, b: a | b), ast.BitXor: ("bitwiseXOR", lambda a, b: a != b)}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def _logical(node: ast.AST) -> bool:
    """True if the node is a truth value by its form."""
    if isinstance(node, ast.UnaryOp):
        return isinstance(node.op, ast.Not) or _logical(node.operand)
    if isinstance(node, ast.BinOp):
        return type(node.op) in _BITS and _logical(node.left) and _logical(node.right)
    return isinstance(node, ast.Compare | ast.BoolOp) or isinstance(node, ast.Constant) and isinstance(node.value, bool)


def translate(text: str, column: Callable[[str], Column] = F.col) -> tuple[str | None, Column]:
    """The name assigned (or None) and the column of an expression string."""
    tree = ast.parse(text.strip(), mode="exec").body
    if len(tree) != 1:
        raise SyntaxError(f"one expression is expected: {text!r}")
    name, node = None, tree[0]
    if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
        name = node.targets[0].id
    elif not isinstance(node, ast.Expr):
        raise SyntaxError(f"not an expression: {text!r}")

    def of(n: ast.AST) -> Column:
        match n:
            case ast.Name():
                return column(n.id)
            case ast.Attribute(value=ast.Name(id=table)):
                return column(f"{table}.{n.attr}")
            case ast.Constant():
                return F.lit(n.value)
            case ast.UnaryOp(op=ast.USub()):
                return -of(n.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return of(n.operand)
            case ast.UnaryOp(op=ast.Not()):
                return ~of(n.operand)
            case ast.UnaryOp(op=ast.Invert()):
                return ~of(n.operand) if _logical(n.operand) else F.bitwise_not(of(n.operand))
            case ast.BoolOp():
                parts = [of(v) for v in n.values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(n.op, ast.And) else out | p
                return out
            case ast.BinOp() if type(n.op) in _BITS:
                method, logic = _BITS[type(n.op)]
                a, b = of(n.left), of(n.right)
                return logic(a, b) if _logical(n.left) and _logical(n.right) else getattr(a, method)(b)
            case ast.BinOp() if type(n.op) in _OPERATORS:
                return _OPERATORS[type(n.op)](of(n.left), of(n.right))
            case ast.Compare():
                sides = [of(n.left), *map(of, n.comparators)]
                out = None
                for k, op in enumerate(n.ops):
                    one = _COMPARE[type(op)](sides[k], sides[k + 1])
                    out = one if out is None else out & one
                return out
            case ast.Call(func=ast.Name(id="where"), args=[c, a, b]):
                return F.when(of(c), of(a)).otherwise(of(b))
            case ast.Call(func=ast.Name(id=f), args=[a]) if f in UNARY:
                return UNARY[f](of(a))
            case ast.Call(func=ast.Name(id=f), args=[a, b]) if f in BINARY:
                return BINARY[f](of(a), of(b))
        raise SyntaxError(f"not supported in an expression: {ast.unparse(n)}")

    return name, of(node.value)
