"""Errors of compiling and of evaluating, with the numeric codes that callers switch on."""

from __future__ import annotations


class ExpressionError(ValueError):
    """An expression or a kernel is refused; ``position`` is the place in the text, if known."""

    code = -3

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message if position is None else f"{message} (at {position})")
        self.position = position


class SyntaxRefused(ExpressionError):
    code = -2


class VariableRefused(ExpressionError):
    """Too many variables, an unknown one, or a shape that is none."""


class VariablesMixed(VariableRefused):
    """Some variables have a type and others none."""

    code = -6


class VariableUntyped(VariableRefused):
    """Neither the variable nor the output has a type."""

    code = -7


class TypeRefused(ExpressionError):
    code = -8


class ReductionRefused(ExpressionError):
    code = -5


class ComplexRefused(ExpressionError):
    code = -4


class EvaluationError(RuntimeError):
    """Evaluation cannot go on, as with a step of zero or a loop beyond its limit."""

    code = -5


class BindingError(EvaluationError):
    """The columns at hand do not match the variables compiled for."""

    code = -4
