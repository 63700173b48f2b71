"""Analysis specs: strict, hashable declarations of a cohort, its variables and analyses."""

from __future__ import annotations

import hashlib
import hmac
import json
from dataclasses import dataclass

from lodestat.operators.frame import COMPARE

AGGREGATES = ("first", "last", "mean", "min", "max", "count", "slope", "time_to_first_event")
PURPOSES = ("research", "statistics", "quality_registry")
LINKAGES = ("shared_guid", "none")
#: What each kind of analysis must (True) or may (False) say beside its kind.
ANALYSES = {
    "describe": {"vars": True}, "histogram": {"var": True, "bins": False}, "frequency": {"vars": True}, "crosstab": {"row": True, "col": True},
    "correlation": {"vars": True, "method": False}, "compare_groups": {"vars": True}, "over_time": {"var": True, "bin_days": True, "range_days": True},
    "completeness": {}, "linear_regression": {"outcome": True, "predictors": True},
}
NAMES = {"ge": ">=", "gt": ">", "le": "<=", "lt": "<", "eq": "==", "ne": "!="}


class SpecError(ValueError):
    """A spec that says something unknown, too little, or what does not fit together."""


def _only(given: dict, known: dict[str, bool], where: str) -> None:
    if extra := sorted(set(given) - set(known)):
        raise SpecError(f"{where}: unknown {', '.join(extra)}")
    if lacking := sorted(k for k, must in known.items() if must and k not in given):
        raise SpecError(f"{where}: missing {', '.join(lacking)}")


def declared(purpose: str | None, projects: list[str] | None = None) -> tuple[str, list[str]]:
    """The purpose of a read and its projects, each once; an error without a known purpose, and for research without a project."""
    if purpose not in PURPOSES:
        raise SpecError(f"purpose: one of {', '.join(sorted(PURPOSES))}")
    named = list(dict.fromkeys(p.strip() for p in projects or [] if p and p.strip()))
    if purpose == "research" and not named:
        raise SpecError("research needs a project")
    return purpose, named


@dataclass(frozen=True)
class AnalysisSpec:
    title: str
    purpose: str
    sources: tuple[str, ...]
    include: tuple[dict, ...]
    variables: tuple[dict, ...]
    analyses: tuple[dict, ...]
    linkage: str = "shared_guid"
    index_event: str | None = None
    groups: tuple[dict, ...] = ()
    allow_overlapping_groups: bool = False
    spec_version: int = 1

    @classmethod
    def parse(cls, text: str | dict) -> AnalysisSpec:
        given = json.loads(text) if isinstance(text, str) else dict(text)
        _only(given, dict.fromkeys(("title", "purpose", "sources", "cohort", "variables", "analyses"), True) | dict.fromkeys(("spec_version", "linkage", "index_event", "groups", "allow_overlapping_groups"), False), "spec")
        _only(given["cohort"], {"include": True}, "cohort")
        index = given.get("index_event")
        if index is not None:
            _only(index, {"observation": True}, "index_event")
        groups = []
        for g in given.get("groups", []):
            _only(g, {"name": True, "where": True}, "group")
            where = {v: {NAMES.get(op, op): x for op, x in ops.items()} for v, ops in g["where"].items()}
            groups.append({"name": g["name"], "where": where})
        spec = cls(
            given["title"], given["purpose"], tuple(given["sources"]), tuple(given["cohort"]["include"]), tuple(given["variables"]), tuple(given["analyses"]), given.get("linkage", "shared_guid"),
            index and index["observation"], tuple(groups), given.get("allow_overlapping_groups", False), given.get("spec_version", 1),
        )
        spec._check()
        return spec

    def _check(self) -> None:
        if self.spec_version != 1 or self.purpose not in PURPOSES or self.linkage not in LINKAGES:
            raise SpecError("unknown version, purpose or linkage")
        if not self.sources or len(set(self.sources)) < len(self.sources):
            raise SpecError("sources: one or more, each once")
        if not self.include or not self.analyses:
            raise SpecError("a cohort criterion and an analysis are needed")
        for c in self.include:
            _only(c, {"observation": True, "op": True, "value": True}, "criterion")
            if NAMES.get(c["op"], c["op"]) not in COMPARE:
                raise SpecError(f"criterion: unknown op {c['op']}")
        names = [v.get("name") for v in self.variables]
        if len(set(names)) < len(names):
            raise SpecError("variables: a name is used twice")
        for v in self.variables:
            flat = str(v.get("from", "")).startswith(("demographics.", "meta."))
            _only(v, {"name": True, "from": True} | ({} if flat else {"agg": True, "window_days": False}), f"variable {v.get('name')}")
            if not flat and v["agg"] not in AGGREGATES:
                raise SpecError(f"variable {v['name']}: unknown aggregate {v['agg']}")
            if v.get("window_days") and self.index_event is None:
                raise SpecError(f"variable {v['name']}: a window needs an index event")
        for g in self.groups:
            for v, ops in g["where"].items():
                if v not in names or not set(ops) <= set(COMPARE):
                    raise SpecError(f"group {g['name']}: unknown variable or comparison")
        for a in self.analyses:
            kind = a.get("kind")
            if kind not in ANALYSES:
                raise SpecError(f"unknown analysis {kind}")
            _only(a, {"kind": True} | ANALYSES[kind], kind)
            used = [*a.get("vars", []), *a.get("predictors", []), *(a[k] for k in ("var", "row", "col", "outcome") if k in a)]
            if unknown := sorted(set(used) - set(names)):
                raise SpecError(f"{kind}: unknown variable {', '.join(unknown)}")
            if kind == "compare_groups" and len(self.groups) < 2:
                raise SpecError("compare_groups: two groups or more are needed")
            if kind == "over_time" and self.index_event is None:
                raise SpecError("over_time: an index event is needed")

    def canonical(self) -> str:
        """JSON with sorted keys, without white space, with all defaults."""
        whole = dict(self.__dict__)
        return json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)

    def stated(self) -> dict:
        """What `parse` makes the same spec of."""
        out = json.loads(self.canonical())
        out["cohort"] = {"include": out.pop("include")}
        out["index_event"] = self.index_event and {"observation": self.index_event}
        return out

    def digest(self) -> str:
        return "sha256:" + hashlib.sha256(self.canonical().encode()).hexdigest()

    def sign(self, secret: bytes) -> str:
        if len(secret) < 32:
            raise ValueError("a signing secret has 32 bytes or more")
        return hmac.new(secret, self.canonical().encode(), "sha256").hexdigest()

    def verified(self, secret: bytes, signature: str) -> bool:
        return hmac.compare_digest(self.sign(secret), signature)
