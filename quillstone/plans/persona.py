"""Personas: selectors as data, parsed and checked as a whole before they compile.

A persona that breaks one rule is refused altogether, so no sender is ever
half-migrated to a bad rule set.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from quillstone.functions import patterns, values
from quillstone.operators import geometry

#: Limits, closed vocabularies, and fields that operations supply.
MOST_BYTES, MOST_EXAMPLES = 64 << 10, 3
MORE_REGIONS = ("label-block", "same-cell", "last-table-row")
SCANLINE_FIELDS = ("total_printed", "account_number", "invoice_number", "due_date")
DERIVED_ONLY = ("amount_payable", "payable_basis", "document_identity", "identity_basis", "carried_balance")
SUPPLIED = {"resolve_bill_to_alias": "bill_to_name", "resolve_vendor_alias": "vendor_name"}


class PersonaError(ValueError):
    """A persona that breaks a rule; ``rule`` names it (V1 to V14, or ``shape``)."""

    def __init__(self, rule: str, message: str):
        super().__init__(f"{rule}: {message}")
        self.rule = rule


@dataclass(frozen=True)
class Persona:
    sender_fingerprint: str
    doc_type: str
    status: str = "active"
    selectors: tuple[Mapping, ...] = ()
    ops: tuple[str, ...] = ()
    examples: tuple[Mapping, ...] = ()
    raw: str = field(default="", compare=False)


def parse_persona(text: str) -> Persona:
    """A persona from JSON; a bare ``adjust`` becomes a list, column order is kept."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise PersonaError("shape", f"not JSON: {e}") from e
    if not isinstance(data, dict) or not all(isinstance(data.get(k), str) and data[k] for k in ("sender_fingerprint", "doc_type")):
        raise PersonaError("shape", "a persona is an object with sender_fingerprint and doc_type")
    if data.get("status", "active") not in ("draft", "active"):
        raise PersonaError("shape", "status is draft or active")
    out = []
    for s in data.get("field_selectors", ()):
        if not isinstance(s, dict) or not (("field" in s) ^ ("row_group" in s) ^ bool(s.get("scanline"))):
            raise PersonaError("shape", "a selector is a field, a row group or a scan line")
        s = dict(s)
        if isinstance(s.get("adjust"), str):
            s["adjust"] = [s["adjust"]]
        out.append(s)
    return Persona(data["sender_fingerprint"], data["doc_type"], data.get("status", "active"), tuple(out), tuple(data.get("ops", ())), tuple(data.get("few_shot_examples", ())), text)


def _narrows(region: str | None) -> bool:
    return region is not None and region != "any-page"


def _captured(pattern: str) -> str:
    """The text of a pattern's group, or of the whole pattern."""
    m = re.search(r"(?<!\\)\((?!\?)((?:\\.|[^()\\])*)\)", pattern)
    return m[1] if m else pattern


def _fixed(pattern: str) -> bool:
    return pattern not in patterns.REGISTRY and not re.search(r"[\[\].*+?{}|\\]", _captured(pattern))


def _bare_digits(pattern: str) -> bool:
    return pattern not in patterns.REGISTRY and bool(re.fullmatch(r"\^?\(?(?:\\d|\[0-9\]|[0-9]|\{[0-9, ]*\}|[-. ?,])+\)?\$?", pattern))


def validate_persona(p: Persona, *, registered: Sequence[str], required: Sequence[str] = (), derived_only: Sequence[str] = DERIVED_ONLY) -> Persona:
    """Check the rules V1 to V14 in order; the first that fails is raised."""
    plain = [s for s in p.selectors if "field" in s]
    groups = [s for s in p.selectors if "row_group" in s]
    scans = [s for s in p.selectors if s.get("scanline")]
    named = [x for s in (*plain, *groups) for x in ([s.get("pattern")] if "field" in s else s.get("columns", {}).values())]

    def refuse(rule: str, bad, message: str) -> None:
        found = [x for x in bad if x is not None]
        if found:
            raise PersonaError(rule, f"{message}: {found[0]}")

    refuse("V1", (s["field"] for s in plain if s["field"] not in (*registered, *derived_only)), "field not registered")
    refuse("V2", (a for s in p.selectors for a in s.get("adjust", ()) if a not in values.VALUE_OPS), "unknown operation")
    known = (*geometry.REGIONS, *MORE_REGIONS)
    refuse("V3", (r for s in p.selectors if (r := s.get("region")) and r not in known and not re.fullmatch(r"page:[1-9]\d*", r)), "unknown region")
    for x in named:
        if x not in patterns.REGISTRY:
            try:
                patterns.compile_restricted(x or "")
            except patterns.PatternError as e:
                raise PersonaError("V4", f"{x!r}: {e}") from e
    said = [s["anchor"].lower() for s in plain if s.get("anchor")]
    refuse("V5", (s["field"] for s in plain if s.get("anchor") and said.count(s["anchor"].lower()) > 1 and not s.get("region")), "anchor shared without a region")
    refuse("V6", (s["field"] for s in plain if _bare_digits(s["pattern"]) and not _narrows(s.get("region"))), "bare digits anywhere")
    refuse("V7", (a.get("field") for s in scans for a in s.get("asserts", ()) if a.get("field") not in SCANLINE_FIELDS), "a scan line cannot assert")
    refuse("V8", (s["row_group"] for s in groups if "sub_group" in (s.get("sub_group") or {})), "nested sub-groups")
    refuse("V9", (s["row_group"] for s in groups if (n := s.get("row_count")) is not None and not (isinstance(n, dict) and n.get("min") != n.get("max"))), "row_count is not a range")
    refuse("V10", (s["field"] for s in plain if s["field"] in derived_only), "derived, never extracted")
    refuse("V11", (f"{len(p.raw.encode())} bytes" for _ in (0,) if len(p.raw.encode()) > MOST_BYTES), "too large")
    refuse("V12", (f"{len(p.examples)} examples" for _ in (0,) if len(p.examples) > MOST_EXAMPLES), "too many")
    refuse("V12", (e.get("document_id", "example") for e in p.examples if "flattened_annotations" in e.get("tags", ())), "example from an annotated document")
    covered = {s["field"] for s in plain} | {f for op, f in SUPPLIED.items() if op in p.ops}
    if p.status != "draft":
        refuse("V13", (f for f in required if f not in covered and f not in derived_only), "required field not covered")
    refuse("V14", (s["field"] for s in plain if _fixed(s["pattern"]) and not s.get("anchor") and not _narrows(s.get("region"))), "fixed text anywhere")
    literal = {_captured(s["pattern"]).lower(): s["field"] for s in plain if _fixed(s["pattern"])}
    refuse("V14", (s["field"] for s in plain if s.get("anchor", "").rstrip(":").lower() in literal), "an anchor that restates a captured value")
    return p


def undeclared_risk_fields(p: Persona, declared: Sequence[str], required: Sequence[str] = (), derived_only: Sequence[str] = DERIVED_ONLY) -> list[str]:
    """Declared optional fields that nothing reads, in declared order."""
    covered = {s.get("field") for s in p.selectors} | {f for op, f in SUPPLIED.items() if op in p.ops}
    return [f for f in declared if f not in required and f not in derived_only and f not in covered]
