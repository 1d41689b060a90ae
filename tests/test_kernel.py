import random

import numpy as np
import pytest
from scalar_model import lex, pages

from glyphmill.plans.arrow import paged
from glyphmill.plans.kernel import Kernel, line_starts, page_cuts
from glyphmill.spec.artifact import load
from glyphmill.spec.builtin import builtin, builtin_artifact
from glyphmill.spec.byteset import DIGIT, IDENT_CONTINUE, LETTER, LOWER, NEWLINE, UPPER, ByteSet
from glyphmill.spec.compiler import Options as CompileOptions
from glyphmill.spec.compiler import compile_spec
from glyphmill.spec.dsl import Spec
from glyphmill.spec.pattern import alt, at_least, literal, many, many1, none_of, one_of, times


def run(runtime, sources: list[bytes], automata=False):
    """(tokens, errors) of each source, each as one page."""
    used = [x for x in sources if x]
    data = np.frombuffer(b"".join(used), dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in used]))).astype(np.int64)
    r = Kernel(runtime, automata)(data, bounds)
    out = [([], []) for _ in used]
    for p, *t in zip(r.page, r.start, r.end, r.rule, r.kind, r.skip):
        out[p][0].append((int(t[0] - bounds[p]), int(t[1] - bounds[p]), int(t[2]), int(t[3]), bool(t[4])))
    for p, a, b in zip(r.error_page, r.error_start, r.error_end):
        out[p][1].append((int(a - bounds[p]), int(b - bounds[p])))
    found = iter(out)
    return [next(found) if x else ([], []) for x in sources]


def literals(rules: dict[str, int]):
    """A runtime of literals with given ranks."""
    s = Spec("literals")
    for text in rules:
        s.token(text, literal(text))
    a = compile_spec(s)
    ranked = [r | {"priorityRank": rank} for r, rank in zip(a["rules"], rules.values())]
    return load(a | {"rules": ranked})


@pytest.mark.parametrize(
    ("text", "kinds", "errors"),
    [
        ("let total=7*(rate+1)", "kwLet ws ident eq int star lParen ident plus int rParen", []),
        ("return{a:b,c}", "kwReturn lBrace ident colon ident comma ident rBrace", []),
        ("// one // two\n//three\r\nif", "lineComment ws lineComment kwIf", [(22, 23)]),
        ("a-->b==-1", "ident minus arrow ident eqEq minus int", []),
        ("?#", "", [(0, 2)]),
        ("77ab7_ 8", "int int ws int", [(2, 4), (5, 6)]),
        ("x/// \t/", "ident lineComment", []),
        ("/", "slash", []),
        ("ü=ß", "eq", [(0, 2), (3, 5)]),
        ("", "", []),
    ],
)
def test_goldens(text, kinds, errors):
    ((tokens, found),) = run(builtin(), [text.encode()])
    assert " ".join(builtin().kinds[t[3]] for t in tokens) == kinds and found == errors


@pytest.mark.parametrize(
    ("text", "rules", "tokens", "errors"),
    [
        ("===", {"==": 0, "=": 1}, [(0, 2), (2, 3)], []),
        ("===>", {"==": 0, "=>": 0, "=": 1}, [(0, 2), (2, 4)], []),
        ("---->", {"--": 0, "->": 0, "-": 1}, [(0, 2), (2, 4)], [(4, 5)]),
        ("/==", {"/=": 0, "==": 0, "=": 1}, [(0, 2), (2, 3)], []),
        ("////x", {"///": 0, "//": 1, "/": 2, "x": 0}, [(0, 3), (3, 4), (4, 5)], []),
        ("aaaaX", {"aaaa": 0, "aaX": 9, "X": 0}, [(0, 4), (4, 5)], []),
        ("abcbcY", {"abc": 0, "cbc": 0, "Y": 0}, [(0, 3), (5, 6)], [(3, 5)]),
    ],
)
def test_overlapping_literals(text, rules, tokens, errors):
    ((found, bad),) = run(literals(rules), [text.encode()])
    assert [(t[0], t[1]) for t in found] == tokens and bad == errors


def rich():
    s = Spec("rich")
    s.skip("ws", many1(one_of(ByteSet.of(" \n"))))
    s.token("long", at_least(one_of(DIGIT), 3))
    s.token("name", one_of(LETTER) + many(one_of(IDENT_CONTINUE)))
    s.token("hash", literal("#") + many(none_of(NEWLINE)))
    s.token("num", one_of(DIGIT) + times(one_of(DIGIT | UPPER), 0, 9) + literal("."))
    s.token("ab", alt(literal("ab"), literal("abc"), literal("b1")))
    s.token("arrow", literal("->"))
    s.token("wide", literal("0123456789abc"))
    s.keywords("name", {"ab": "kwAb", "abc": "kwAbc"})
    return load(compile_spec(s, CompileOptions(window_bytes=1)))


@pytest.mark.parametrize("automata", [False, True])
def test_random_sources_against_the_scalar_model(automata):
    rng = random.Random(0xC0FFEE + automata)
    pieces = ["let", "if", " ", "//", "\n", "=", "==", "->", "-", ">", "@", "é", "1", "a", "_", "abc", "ab", "b1", "#", ".", "A", "42", "12345", "{", "\r\n", "0123456789abc"]
    sources = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 24))).encode() for _ in range(600)]
    for runtime in (builtin(), rich()):
        assert run(runtime, sources, automata) == [lex(runtime, x, automata) for x in sources]


def test_automata_only_run_in_their_profile():
    s = Spec("aa")
    s.token("pair", alt(literal("aa"), literal("bb")))
    r = load(compile_spec(s, CompileOptions(window_bytes=1)))
    assert run(r, [b"aa"], True)[0][0] == [(0, 2, 0, 0, False)]
    assert run(r, [b"aa"], False) == [([], [(0, 2)])]


def test_window_rules_never_match():
    s = Spec("w")
    s.token("pair", alt(literal("ab"), literal("cd")))
    assert run(load(compile_spec(s)), [b"abcd"], True) == [([], [(0, 4)])]


def test_pages_do_not_see_each_other():
    r = builtin()
    assert run(r, [b"ab", b"cd", b"/", b"/x"]) == [lex(r, x) for x in (b"ab", b"cd", b"/", b"/x")]


def test_keywords_of_the_later_table():
    a = builtin_artifact()
    second = a["keywordRemaps"][0] | {"entries": [{"lexeme": list(b"let"), "tokenKindID": 21}]}
    r = load(a | {"keywordRemaps": [a["keywordRemaps"][0], second]})
    assert run(r, [b"let"])[0][0][0][3] == 21


def test_invariants():
    rng = random.Random(0xD1CE)
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789_ A!?"
    for _ in range(80):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))).encode()
        ((tokens, errors),) = run(builtin(), [x])
        spans = sorted([(a, b) for a, b, *_ in tokens] + errors)
        assert all(p[1] <= q[0] for p, q in zip(spans, spans[1:])) and sum(b - a for a, b in spans) == len(x)
        assert all(p[1] < q[0] for p, q in zip(errors, errors[1:]))


def test_a_run_of_a_whole_page():
    x = b"a" * 65536
    assert [t[:2] for t in run(builtin(), [x])[0][0]] == [(0, 65536)]


@pytest.mark.parametrize(
    ("data", "starts"),
    [
        (b"", [0]), (b"a", [0]), (b"abc", [0]), (b"a\n", [0, 2]), (b"a\r\n", [0, 3]), (b"\n\n\n", [0, 1, 2, 3]), (b"a\nb\nc", [0, 2, 4]),
        (b"a\r\nb", [0, 3]), (b"a\rb", [0, 2]), (b"a\nb\r\nc\rd", [0, 2, 5, 7]), (b"\0\n\0", [0, 2]), ("é\n".encode(), [0, 3]),
        (b"a\n" + b"b" * 200, [0, 2]), (b"\r", [0, 1]), (b"\r\r\n", [0, 1, 3]),
    ],
)
def test_line_starts(data, starts):
    assert line_starts(np.frombuffer(data, dtype=np.uint8)).tolist() == starts


@pytest.mark.parametrize(
    ("starts", "size", "target", "ends"),
    [([0], 0, 64, [0]), ([0, 2, 4], 5, 64, [4, 5]), ([0, 2, 4], 4, 64, [4]), ([0, 5, 10], 14, 8, [5, 10, 14]), ([0], 200, 64, [200])],
)
def test_page_cuts(starts, size, target, ends):
    assert page_cuts(np.array(starts), size, target).tolist() == ends


def test_random_pages_against_the_scalar_model():
    rng = random.Random(0xCAFEBABE)
    for _ in range(100):
        x = bytes(rng.choice(b"ab\n\r\0") for _ in range(rng.randint(0, 400)))
        target = rng.randint(1, 127)
        p = paged(np.frombuffer(x, dtype=np.uint8), np.array([0, len(x)]), target)
        assert list(zip(p.start.tolist(), (p.start + p.size).tolist())) == pages(x, target)
        assert p.number.tolist() == list(range(len(p.start))) and p.lines.sum() == len(line_starts(np.frombuffer(x, dtype=np.uint8))) - 1


def test_lower_letters_only_start_at_runs():
    s = Spec("r")
    s.token("low", at_least(one_of(LOWER), 2))
    assert run(load(compile_spec(s)), [b"aBcdE"])[0] == ([(2, 4, 0, 0, False)], [(0, 2), (4, 5)])


def test_one_page():
    from glyphmill.plans.arrow import Options
    from glyphmill.plans.page import PageResult, Token, lex_page

    assert lex_page(b"==", 1).tokens() == [Token(6, 0, 0, 1)] and lex_page(b"==", 0) == PageResult([], [])
    r = lex_page(b"let @\n" + b"\0" * 10, 6, base=100)
    assert r.tokens() == [Token(18, 0, 100, 103)] and r.error_spans == [(4, 5)] and r.rule_ids == [2] and r.rows(3) == [r.packed[0], 0, 0]
    assert [t.flags for t in lex_page(b"let x", options=Options(emit_skip=True)).tokens()] == [0, 1, 0]
    s = Spec("aa")
    s.token("pair", alt(literal("aa"), literal("bb")))
    automaton = load(compile_spec(s, CompileOptions(window_bytes=1)))
    assert len(lex_page(b"aa", runtime=automaton, options=Options(profile="v1-fallback")).packed) == 1
    assert lex_page(b"aa", runtime=automaton).error_spans == [(0, 2)]
