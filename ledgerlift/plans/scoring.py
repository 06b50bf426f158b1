"""Precision and recall of proposers against the findings that the bytes prove."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import ProposerError
from ..operators.rules import Finding
from .adjudicate import Adjudication

#: Hypothesis kinds whose finding has another code.
CODES = {"PACKED_NOT_PACKED": "INVALID_PACKED"}


@dataclass
class Run:
    model: str
    confirmed: int = 0
    inert: int = 0
    refuted: int = 0
    untestable: int = 0
    matched: set = field(default_factory=set)
    missed: set = field(default_factory=set)
    error: str = ""
    seconds: float = 0.0

    @property
    def proposals(self) -> int:
        return self.confirmed + self.inert + self.refuted + self.untestable

    @property
    def precision(self) -> float | None:
        """None where nothing was testable."""
        return _share(self.confirmed + self.inert, self.refuted)

    @property
    def recall(self) -> float | None:
        """None where there is nothing to find."""
        return _share(len(self.matched), len(self.missed))


def _share(good: int, bad: int) -> float | None:
    return good / (good + bad) if good + bad else None


def truth(findings: list[Finding]) -> set[tuple[str, str]]:
    return {(f.field, f.code) for f in findings if f.severity in ("critical", "warn")}


def score(model: str, judged: list[Adjudication], known: set[tuple[str, str]]) -> Run:
    n = {v: sum(a.verdict == v for a in judged) for v in ("CONFIRMED", "INERT", "REFUTED", "UNTESTABLE")}
    hit = {(a.hypothesis.field, CODES.get(a.hypothesis.kind, a.hypothesis.kind)) for a in judged if a.verdict == "CONFIRMED"}
    return Run(model, n["CONFIRMED"], n["INERT"], n["REFUTED"], n["UNTESTABLE"], known & hit, known - hit)


def compare(models: list[str], samples: int, once: Callable[[str], list[Adjudication]], known: set[tuple[str, str]]) -> list[Run]:
    runs = []
    for model in models:
        for _ in range(samples):
            try:
                began = time.monotonic()
                run = score(model, once(model), known)
                run.seconds = time.monotonic() - began
                runs.append(run)
            except ProposerError as e:
                runs.append(Run(model, error=str(e)))
    return runs


# Columns of the table: heading, what of a run, and how its mean is written.
_COLUMNS = [
    ("precision", lambda r: r.precision, ".0%"),
    ("recall", lambda r: r.recall, ".0%"),
    ("proposals", lambda r: r.proposals, ".1f"),
    ("confirmed", lambda r: r.confirmed, ".1f"),
    ("refuted", lambda r: r.refuted, ".1f"),
    ("seconds", lambda r: r.seconds, ".1f"),
]


def means(runs: list[Run]) -> dict[str, dict]:
    """For each model its runs that went through, and the means over those in which a figure is defined."""
    found = {}
    for model in dict.fromkeys(r.model for r in runs):
        ok = [r for r in runs if r.model == model and not r.error]
        row = {"runs": len(ok)}
        for name, value, _ in _COLUMNS:
            held = [v for r in ok if (v := value(r)) is not None]
            row[name] = sum(held) / len(held) if held else None
        found[model] = row
    return found


def report(runs: list[Run]) -> str:
    """The means, and every run, as JSON."""
    each = [{"model": r.model, "precision": r.precision, "recall": r.recall, "matched": sorted(r.matched), "missed": sorted(r.missed), "seconds": r.seconds, "error": r.error} for r in runs]
    return json.dumps({"models": means(runs), "runs": each}, indent=2)


def table(runs: list[Run]) -> str:
    """Means of each model over its runs that went through; n/a where none is defined."""
    out = [f"{'model':<40} {'runs':>4}" + "".join(f" {name:>9}" for name, _, _ in _COLUMNS)]
    for model, row in means(runs).items():
        cells = ("n/a" if row[name] is None else format(row[name], style) for name, _, style in _COLUMNS)
        out.append(f"{model:<40} {row['runs']:>4}" + "".join(f" {c:>9}" for c in cells))
    return "\n".join(out)
