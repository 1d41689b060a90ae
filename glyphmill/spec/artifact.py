"""The compiled form of a specification: canonical JSON, its hash, and the checks on loading it.

Artifacts are plain JSON values, so a stored artifact is the format itself.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

FORMAT_VERSION = 1
U8, U16 = 255, 65535
#: Left out of the semantic hash.
_UNHASHED = ("formatVersion", "generatorVersion", "specHashHex")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def pretty(value: object) -> str:
    return json.dumps(value, sort_keys=True, indent=2, separators=(",", " : "), ensure_ascii=False)


def semantic_hash(artifact: dict) -> str:
    payload = {k: v for k, v in artifact.items() if k not in _UNHASHED}
    return hashlib.sha256(canonical(payload).encode()).hexdigest()


def encode(artifact: dict) -> str:
    return canonical(artifact)


_PLAN_KEYS = {
    "literal": {"bytes"},
    "runClassRun": {"bodyClassSetID", "minLength"},
    "runHeadTail": {"headClassSetID", "tailClassSetID"},
    "runPrefixed": {"prefix", "bodyClassSetID", "stopClassSetID"},
    "localWindow": {"maxWidth"},
    "fallback": {"stateCount", "classCount", "transitionRowStride", "startState", "acceptingStates", "transitions"},
}


def decode(text: str) -> dict:
    """An artifact from JSON; unknown plans are errors."""
    artifact = json.loads(text)
    for rule in artifact["rules"]:
        plan = rule["plan"]
        if plan.get("kind") not in _PLAN_KEYS:
            raise ValueError(f"unknown rule plan kind: {plan.get('kind')}")
        missing = _PLAN_KEYS[plan["kind"]] - set(plan) - {"stopClassSetID"}
        if missing:
            raise ValueError(f"rule {rule['ruleID']}: plan lacks {', '.join(sorted(missing))}")
    return artifact


class ArtifactError(ValueError):
    """An artifact that can't be run; ``code`` names why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    kind_id: int
    skip: bool
    family: str
    rank: int
    least: int
    most: int | None
    plan: dict


class Runtime:
    """An artifact ready to run: tables by byte and by rule."""

    def __init__(self, artifact: dict):
        lut = artifact["byteToClass"]
        if len(lut) != 256:
            raise ArtifactError("invalid-byte-to-class-size", f"byteToClass has {len(lut)} entries, not 256")
        if not artifact["rules"]:
            raise ArtifactError("empty-rules", "the artifact has no rules")
        self.artifact = artifact
        self.hash = artifact["specHashHex"]
        self.lut = bytes(lut)
        self.sets = {s["classSetID"]["rawValue"]: frozenset(s["classes"]) for s in artifact["classSets"]}
        self.kinds = {k["tokenKindID"]: k["name"] for k in artifact["tokenKinds"]}
        self.rules = [
            Rule(r["ruleID"], r["name"], r["tokenKindID"], r["mode"] == "skip", r["family"], r["priorityRank"], r["minWidth"], r.get("maxWidth"), r["plan"])
            for r in artifact["rules"]
        ]
        for r in self.rules:
            if r.plan["kind"] == "fallback":
                self._check_automaton(r)

    def _check_automaton(self, r: Rule) -> None:
        p = r.plan
        if r.most is None:
            raise ArtifactError("fallback-width-missing", f"rule {r.id}: an automaton needs a greatest width")
        if p["transitionRowStride"] != p["classCount"]:
            raise ArtifactError("fallback-stride-mismatch", f"rule {r.id}: row stride {p['transitionRowStride']} for {p['classCount']} classes")
        if len(p["transitions"]) != p["stateCount"] * p["transitionRowStride"]:
            raise ArtifactError("fallback-transition-count", f"rule {r.id}: {len(p['transitions'])} transitions for {p['stateCount']} states")
        if p["startState"] >= p["stateCount"]:
            raise ArtifactError("fallback-start-state", f"rule {r.id}: start state {p['startState']}")
        if any(s >= p["stateCount"] for s in (*p["acceptingStates"], *p["transitions"])):
            raise ArtifactError("fallback-state-out-of-range", f"rule {r.id}: a state beyond {p['stateCount']}")

    def bytes_of_set(self, set_id: int) -> list[int]:
        """The bytes whose class is in a class set."""
        classes = self.sets[set_id]
        return [b for b in range(256) if self.lut[b] in classes]

    def keyword_tables(self) -> list[dict]:
        return self.artifact["keywordRemaps"]

    def keywords(self) -> dict[tuple[int, bytes], int]:
        """(base rule, lexeme) to kind; of two tables the later one wins."""
        return {
            (t["baseRuleID"], bytes(e["lexeme"])): e["tokenKindID"]
            for t in self.keyword_tables()
            for e in t["entries"]
            if len(e["lexeme"]) <= t["maxKeywordLength"]
        }


def load(artifact: dict | str) -> Runtime:
    return Runtime(decode(artifact) if isinstance(artifact, str) else artifact)


# Which artifacts a profile can run.

V0, V1 = "v0", "v1-fallback"
_STATES, _CLASSES = 128, 128


@dataclass(frozen=True)
class CapabilityDiagnostic:
    rule_id: int
    rule_name: str
    family: str
    reason: str

    def message(self, profile: str | None = None) -> str:
        of = f" for runtime profile {profile}" if profile else ""
        return f"artifact-capability-error: unsupported {self.family}{of} ruleID={self.rule_id} name={self.rule_name} reason={self.reason}"


def _sound(p: dict) -> bool:
    states = p["stateCount"]
    return (
        states > 0 and p["classCount"] > 0 and p["transitionRowStride"] == p["classCount"] and p["startState"] < states
        and len(p["transitions"]) == states * p["transitionRowStride"]
        and all(s < states for s in (*p["acceptingStates"], *p["transitions"]))
    )


def capabilities(artifact: dict, profile: str = V0) -> list[CapabilityDiagnostic]:
    """What keeps an artifact from running under a profile; empty if nothing does."""
    kinds = {k["tokenKindID"] for k in artifact["tokenKinds"]}
    lookahead = artifact["runtimeHints"]["maxDeterministicLookaheadBytes"]
    out, states = [], 0
    for r in artifact["rules"]:
        reasons = []
        if not r["name"] or r["tokenKindID"] not in kinds:
            reasons.append("missing-table")
        if r["family"] == "localWindow":
            reasons.append("localWindow-present")
        elif r["family"] == "fallback":
            p = r["plan"]
            if profile == V0 or p["kind"] != "fallback":
                reasons.append("missing-table")
            else:
                most = r.get("maxWidth") or 0
                states += p["stateCount"]
                reasons += [
                    reason
                    for reason, holds in (
                        ("missing-table", not _sound(p)),
                        ("class-cap-exceeded", p["classCount"] > _CLASSES),
                        ("width-exceeded", most == 0 or most < r["minWidth"]),
                        ("max-lookahead-mismatch", most > lookahead),
                        ("state-cap-exceeded", states > _STATES),
                    )
                    if holds
                ]
        out += [CapabilityDiagnostic(r["ruleID"], r["name"], r["family"], x) for x in reasons]
    return out
