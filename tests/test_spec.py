import json

import pytest

from glyphmill.spec import artifact as A
from glyphmill.spec import byteset as B
from glyphmill.spec.builtin import builtin, builtin_artifact, builtin_spec
from glyphmill.spec.compiler import Options, SpecError, byte_classes, class_sets, compile_spec, normalize_spec, validate
from glyphmill.spec.dsl import Spec
from glyphmill.spec.pattern import (
    EMPTY, NEVER, Either, Literal, OneOf, Repeat, accepts, alt, at_least, byte, derivative, literal, many, many1, maybe, none_of, normalize,
    one_of, times,
)


def codes(spec, options=None):
    with pytest.raises(SpecError) as e:
        compile_spec(spec, options)
    return [d.code for d in e.value.diagnostics]


def test_byte_sets():
    assert B.DIGIT.members() == list(range(48, 58)) and len(B.LETTER) == 52
    assert 65 in B.UPPER and 65 not in B.LOWER and B.LOWER <= B.LETTER and not B.LETTER <= B.LOWER
    assert len(~B.NEWLINE) == 255 and not (B.DIGIT & B.LETTER) and (B.DIGIT | B.LETTER) <= B.IDENT_CONTINUE
    assert B.ByteSet.from_json(B.WHITESPACE.to_json()) == B.WHITESPACE == B.ByteSet.of(" \t\n\r")
    assert B.ByteSet().with_byte(7).members() == [7] and not B.ByteSet()


def test_normal_form():
    a, b = literal("a"), literal("b")
    assert normalize(a + b + literal("")) == Literal(b"ab")
    assert normalize(literal("")) == EMPTY and normalize(one_of(B.ByteSet())) == NEVER
    assert normalize(a + one_of(B.ByteSet())) == NEVER
    assert normalize(alt(b, a, b, alt(a))) == Either((Literal(b"a"), Literal(b"b")))
    assert normalize(times(a, 1)) == Literal(b"a") and normalize(times(a, 0)) == EMPTY
    assert normalize(many(literal(""))) == EMPTY and normalize(many1(one_of(B.ByteSet()))) == NEVER
    assert normalize((a + b) + (a + b)).key == "l[97,98,97,98]" and normalize(at_least(b, 2)).key == "r(l[98],2,*)"
    assert normalize(byte(7)) == Literal(b"\x07")
    with pytest.raises(ValueError):
        normalize(times(a, 2, 1))
    with pytest.raises(UnicodeEncodeError):
        literal("é")


def test_properties_and_acceptance():
    p = normalize(maybe(literal("a")) + one_of(B.DIGIT) + times(literal("xy"), 1, 3))
    assert (p.props.nullable, p.props.least, p.props.most) == (False, 3, 8)
    assert p.props.first == B.DIGIT | B.ByteSet.of("a")
    assert normalize(many(literal("a"))).props.nullable and normalize(many1(literal("a"))).props.most is None
    assert accepts(p, b"a1xyxy") and accepts(p, b"1xy") and not accepts(p, b"a1x") and not accepts(p, b"1xyxyxyxy")
    assert derivative(Literal(b"ab"), 97) == Literal(b"b") and derivative(OneOf(B.DIGIT), 97) == NEVER
    assert derivative(Repeat(Literal(b"ab"), 2, 2), 97).key == "l[98,97,98]"


def test_builtin_artifact():
    a = builtin_artifact()
    assert len(a["rules"]) == 17 and len(a["classes"]) == 17 and len(a["classSets"]) == 17
    assert a["classSets"][1]["classes"] == [1, 2] and a["classSets"][10]["classes"] == [10, 14] and a["classSets"][14]["classes"] == [14]
    assert [k["name"] for k in a["tokenKinds"]][17:] == ["kwFunc", "kwLet", "kwReturn", "kwIf", "kwElse", "kwTrue", "kwFalse"]
    assert a["rules"][1]["plan"] == {"kind": "runPrefixed", "prefix": [47, 47], "bodyClassSetID": 0, "stopClassSetID": None}
    lexemes = [bytes(e["lexeme"]) for e in a["keywordRemaps"][0]["entries"]]
    assert lexemes == sorted(lexemes) and len(lexemes) == 7 and a["keywordRemaps"][0]["maxKeywordLength"] == 6
    assert "maxWidth" not in a["rules"][0] and a["rules"][4]["maxWidth"] == 2
    assert A.decode(A.encode(a)) == a and json.loads(A.pretty(a)) == a


def test_hash_leaves_out_the_generator():
    one, two = compile_spec(builtin_spec(), generator="x"), compile_spec(builtin_spec(), generator="y")
    assert one["specHashHex"] == two["specHashHex"] and one != two
    other = builtin_spec()
    other.token("at", literal("@"))
    assert compile_spec(other)["specHashHex"] != one["specHashHex"]


def test_classes_tell_all_sets_apart():
    spec = validate(normalize_spec(builtin_spec()))
    classes = byte_classes(spec)
    assert [m[0] for m in classes.members] == sorted(m[0] for m in classes.members)
    assert sorted(b for m in classes.members for b in m) == list(range(256))
    for c, i in class_sets(spec, classes).items():
        assert list(c) == sorted(set(c)) and i >= 0


def test_diagnostics():
    s = Spec("a")
    s.token("x", many(literal("a")))
    assert codes(s) == ["LEX001"]
    s = Spec("a")
    s.token("x", literal("a"))
    s.token("x", literal("b"))
    assert codes(s) == ["LEX002"]
    s = Spec("a")
    i = s.identifier("id", many1(one_of(B.LETTER)))
    s.keywords(i, [("if", "k1"), ("if", "k2"), ("do", "k1"), ("a1", "k3")])
    assert sorted(codes(s)) == ["LEX003", "LEX004", "LEX005"]
    s = Spec("a")
    s.token("x", times(one_of(B.DIGIT), 70000))
    assert codes(s, Options(window_bytes=100_000)) == ["LEX006", "LEX006"]
    s = Spec("a")
    i = s.identifier("id", many1(one_of(B.LETTER)))
    s.keywords(i, {"a" * 256: "k"})
    assert codes(s) == ["LEX007"]


def test_diagnostics_stand_in_order_of_place():
    s = Spec("a")
    s.token("x", maybe(literal("a")))
    s.token("x", maybe(literal("b")))
    with pytest.raises(SpecError) as e:
        compile_spec(s)
    assert [d.code for d in e.value.diagnostics] == ["LEX001", "LEX001", "LEX002"]
    assert e.value.diagnostics[0].place.line + 1 == e.value.diagnostics[1].place.line
    assert e.value.diagnostics[2].other == e.value.diagnostics[0].place


@pytest.mark.parametrize(
    ("pattern", "kind"),
    [
        (literal("ab"), "literal"),
        (many1(one_of(B.DIGIT)), "runClassRun"),
        (at_least(one_of(B.DIGIT), 3), "runClassRun"),
        (one_of(B.LETTER) + many(one_of(B.IDENT_CONTINUE)), "runHeadTail"),
        (literal("#") + many(none_of(B.NEWLINE)), "runPrefixed"),
        (one_of(B.DIGIT) + many(one_of(B.LETTER)), "fallback"),
        (alt(literal("ab"), literal("cd")), "localWindow"),
        (one_of(B.DIGIT), "localWindow"),
        (alt(literal("ab"), literal("cd")) + many(literal("x")), "fallback"),
    ],
)
def test_plans_by_shape(pattern, kind):
    s = Spec("a")
    s.token("x", pattern)
    assert compile_spec(s)["rules"][0]["plan"]["kind"] == kind


def test_automaton_table():
    s = Spec("a")
    s.token("x", alt(literal("ab"), literal("cd")))
    rule = compile_spec(s, Options(window_bytes=1))["rules"][0]
    p = rule["plan"]
    assert (p["startState"], p["stateCount"], p["acceptingStates"]) == (1, 5, [4]) and p["transitions"][: p["classCount"]] == [0] * p["classCount"]
    assert len(p["transitions"]) == p["stateCount"] * p["classCount"]
    with pytest.raises(ValueError, match="states"):
        compile_spec(s, Options(window_bytes=1, states=2))
    with pytest.raises(ValueError, match="automata"):
        compile_spec(s, Options(window_bytes=1, automata=False))


def test_loading():
    a = builtin_artifact()
    with pytest.raises(A.ArtifactError) as e:
        A.load(a | {"byteToClass": a["byteToClass"][:-1]})
    assert e.value.code == "invalid-byte-to-class-size"
    with pytest.raises(A.ArtifactError) as e:
        A.load(a | {"rules": []})
    assert e.value.code == "empty-rules"
    with pytest.raises(ValueError, match="unknown rule plan"):
        A.decode(A.encode(a | {"rules": [a["rules"][0] | {"plan": {"kind": "other"}}]}))
    s = Spec("a")
    s.token("x", alt(literal("ab"), literal("cd")))
    b = compile_spec(s, Options(window_bytes=1))
    rule = b["rules"][0]
    for change, code in (
        ({"transitions": []}, "fallback-transition-count"), ({"startState": 9}, "fallback-start-state"),
        ({"transitionRowStride": 1}, "fallback-stride-mismatch"), ({"acceptingStates": [7]}, "fallback-state-out-of-range"),
    ):
        with pytest.raises(A.ArtifactError) as e:
            A.load(b | {"rules": [rule | {"plan": rule["plan"] | change}]})
        assert e.value.code == code
    with pytest.raises(A.ArtifactError) as e:
        A.load(b | {"rules": [{k: v for k, v in rule.items() if k != "maxWidth"}]})
    assert e.value.code == "fallback-width-missing"


def test_capabilities():
    assert A.capabilities(builtin_artifact(), A.V0) == A.capabilities(builtin_artifact(), A.V1) == []
    s = Spec("a")
    s.token("x", alt(literal("ab"), literal("cd")))
    window = compile_spec(s)
    assert [d.reason for d in A.capabilities(window, A.V0)] == [d.reason for d in A.capabilities(window, A.V1)] == ["localWindow-present"]
    auto = compile_spec(s, Options(window_bytes=1))
    assert [d.reason for d in A.capabilities(auto, A.V0)] == ["missing-table"]
    assert [d.reason for d in A.capabilities(auto, A.V1)] == ["max-lookahead-mismatch"]
    s.token("long", literal("0123456789"))
    auto = compile_spec(s, Options(window_bytes=1))
    assert A.capabilities(auto, A.V1) == []
    rule = auto["rules"][0]
    wide = auto | {"rules": [rule | {"plan": rule["plan"] | {"stateCount": 200}}]}
    found = A.capabilities(wide, A.V1)
    assert [d.reason for d in found] == ["missing-table", "state-cap-exceeded"]
    assert found[1].message(A.V1) == (
        "artifact-capability-error: unsupported fallback for runtime profile v1-fallback ruleID=0 name=x reason=state-cap-exceeded"
    )
    many_classes = auto | {"rules": [rule | {"plan": rule["plan"] | {"classCount": 129}}]}
    assert "class-cap-exceeded" in [d.reason for d in A.capabilities(many_classes, A.V1)]
    assert [d.reason for d in A.capabilities(auto | {"rules": [rule | {"maxWidth": 1}]}, A.V1)] == ["width-exceeded"]


def test_later_keyword_table_wins():
    a = builtin_artifact()
    first = a["keywordRemaps"][0]
    second = first | {"entries": [{"lexeme": list(b"let"), "tokenKindID": 99}]}
    r = A.load(a | {"keywordRemaps": [first, second]})
    assert r.keywords()[2, b"let"] == 99 and r.keywords()[2, b"func"] == 17
    short = first | {"maxKeywordLength": 3}
    assert (2, b"func") not in A.load(a | {"keywordRemaps": [short]}).keywords()
    assert builtin().kinds[18] == "kwLet"
