"""The built-in specification: a small statement language."""

from __future__ import annotations

from functools import lru_cache

from glyphmill.spec.artifact import Runtime, load
from glyphmill.spec.byteset import DIGIT, IDENT_CONTINUE, IDENT_START, NEWLINE, WHITESPACE
from glyphmill.spec.compiler import compile_spec
from glyphmill.spec.dsl import Spec
from glyphmill.spec.pattern import literal, many, many1, none_of, one_of

# Kinds of the operators and keywords, in order.
OPERATORS = {
    "arrow": "->", "eqEq": "==", "eq": "=", "plus": "+", "minus": "-", "star": "*", "slash": "/",
    "lParen": "(", "rParen": ")", "lBrace": "{", "rBrace": "}", "colon": ":", "comma": ",",
}
KEYWORDS = {
    "func": "kwFunc", "let": "kwLet", "return": "kwReturn", "if": "kwIf", "else": "kwElse", "true": "kwTrue", "false": "kwFalse",
}


def builtin_spec() -> Spec:
    spec = Spec("statements.v0")
    spec.skip("ws", many1(one_of(WHITESPACE)))
    spec.skip("lineComment", literal("//") + many(none_of(NEWLINE)))
    ident = spec.identifier("ident", one_of(IDENT_START) + many(one_of(IDENT_CONTINUE)))
    spec.token("int", many1(one_of(DIGIT)))
    for kind, text in OPERATORS.items():
        spec.token(kind, literal(text))
    spec.keywords(ident, KEYWORDS)
    return spec


@lru_cache
def builtin_artifact() -> dict:
    return compile_spec(builtin_spec(), generator="glyphmill")


@lru_cache
def builtin() -> Runtime:
    return load(builtin_artifact())
