"""Command line: layout, scan, decode, explain, plan, emit, read-scan, resolve, benchmark."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from . import copybook
from .errors import CopybookError, CriticalFindings, LayoutError, LayoutMismatch, PlanError, ProposerError, VariableRecordError, VisionError
from .functions import codepages
from .functions.decoders import Reading
from .operators import extract, profile, rules
from .plans import adjudicate, plan, render, resolve, scoring, vision
from .sources import partial_view_note, read_records


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _layout(a):
    found = copybook.parse_file(a.copybook, a.record)
    found.record_bytes = a.record_bytes
    return found


def _records(a, layout):
    return read_records(_session(), a.data, layout.record_length(), a.recfm, a.limit)


def _reading(a) -> Reading:
    if not codepages.known(a.encoding):
        raise LayoutError(f"no code page {a.encoding}")
    return Reading(a.encoding, a.float_format, a.binary_byteorder)


def _replies(path: str | None):
    """A proposer that replays a file; without one there is no model to ask."""
    if path is None:
        raise ProposerError("no proposer is configured: give a file of replies")
    return lambda _: Path(path).read_text(encoding="utf-8")


def _layout_cmd(a) -> int:
    print(render.layout_table(_layout(a)))
    return 0


def _measure(a):
    layout = _layout(a)
    try:
        records = _records(a, layout)
    except LayoutMismatch as e:
        if note := partial_view_note(layout):
            e.notes.append(note)
            e.args = (f"{e}\n  - {note}",)
        raise
    return layout, records


def _scan(a) -> int:
    layout, records = _measure(a)
    found = rules.evaluate(layout, profile.scan(records, layout, _reading(a)), _reading(a))
    print("\n\n".join(map(str, found)) or "no findings")
    return int(any(f.severity == "critical" for f in found))


def _decode(a) -> int:
    layout, records = _measure(a)
    try:
        _, missing = extract.extract(records, layout, a.out, _reading(a), a.force, as_text=a.text)
    except CriticalFindings as e:
        print("\n\n".join(map(str, e.findings)), "\nnothing was written; --force decodes all the same", sep="\n")
        return 2
    print(f"wrote {a.out}", *(f"  {name}: {n:,} empty" for name, n in missing.items()), sep="\n")
    return 0


def _explain(a) -> int:
    layout, records = _measure(a)
    stats = profile.scan(records, layout, _reading(a))
    question = adjudicate.prompt(Path(a.copybook).read_text(errors="replace"), adjudicate.profile(layout, stats))
    if a.save_prompt:
        Path(a.save_prompt).write_text(question)
    hypotheses = adjudicate.propose(_replies(a.hypotheses), question, a.samples)
    if a.save_hypotheses:
        Path(a.save_hypotheses).write_text(json.dumps({"hypotheses": [vars(h) for h in hypotheses]}, indent=1))
    print("\n\n".join(map(str, adjudicate.adjudicate(hypotheses, layout, stats, records, _reading(a)))))
    return 0


def _plan(a) -> int:
    found = plan.build(_layout(a), a.table, a.encoding)
    text = json.dumps(found, indent=2, ensure_ascii=False)
    Path(a.out).write_text(text) if a.out else print(text)
    for q in plan.open_decisions(found):
        print(f"open: [{q['kind']}] {q['id']}: {q['question']}", file=sys.stderr)
    return int(bool(plan.open_decisions(found)))


def _emit(a) -> int:
    make = {"ddl": render.postgres_ddl, "jsonschema": render.json_schema, "loader": render.loader_script, "spark": lambda p: ";\n".join(render.spark_ddl(p))}[a.format]
    print(make(json.loads(Path(a.plan).read_text())))
    return 0


def _read_scan(a) -> int:
    blocks = _replies(a.blocks)
    read = lambda _: json.loads(blocks(""))
    r = vision.reconstruct(read, Path(a.image).read_bytes(), os.path.getsize(a.data) if a.data else None, a.declares, a.attempts)
    print(r.copybook, r.error, *(f"[{'ok' if ok else 'NO'}] {what}: {why}" for what, ok, why in r.checks), sep="\n")
    if r.proved and a.out:
        Path(a.out).write_text(r.copybook)
    return int(not r.proved)


def _resolve(a) -> int:
    found = json.loads(Path(a.plan).read_text())
    a.copybook = a.copybook or found["source"]["copybook"]
    if not os.path.exists(a.copybook):
        print(f"no copybook {a.copybook}", file=sys.stderr)
        return 2
    layout, records = _measure(a)
    verdicts = resolve.adjudicate(resolve.propose(_replies(a.resolutions), found, Path(a.copybook).read_text(errors="replace")), layout, records, a.encoding or found["source"]["encoding"])
    print("\n\n".join(map(str, verdicts)))
    if a.apply:
        Path(a.plan).write_text(json.dumps(resolve.apply(found, verdicts, a.model), indent=2, ensure_ascii=False))
    return 0


def _benchmark(a) -> int:
    layout, records = _measure(a)
    stats = profile.scan(records, layout, _reading(a))
    known = scoring.truth(rules.evaluate(layout, stats, _reading(a)))
    once = lambda path: adjudicate.adjudicate(adjudicate.propose(_replies(path), ""), layout, stats, records, _reading(a))
    text = scoring.table(scoring.compare(a.models.split(","), a.samples, once, known))
    Path(a.out).write_text(text + "\n") if a.out else print(text)
    return 0


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerlift")
    commands = top.add_subparsers(required=True)

    def command(name, run, copybook_=True, data=False):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if copybook_:
            p.add_argument("copybook")
        if data:
            p.add_argument("data")
            readings(p)
        p.add_argument("--record")
        p.add_argument("--record-bytes", type=int)
        return p

    def readings(p, page="cp037"):
        p.add_argument("--encoding", default=page)
        p.add_argument("--limit", type=int)
        p.add_argument("--recfm", choices=("auto", "fixed", "vb"), default="auto")
        p.add_argument("--binary-byteorder", choices=("big", "little"), default="big")
        p.add_argument("--float-format", choices=("hfp", "ieee", "ieee-le"), default="hfp")

    command("layout", _layout_cmd)
    command("scan", _scan, data=True)
    p = command("decode", _decode, data=True)
    p.add_argument("-o", "--out", default="out.parquet")
    p.add_argument("--force", action="store_true")
    p.add_argument("--text", action="store_true", help="numbers as strings")
    p = command("explain", _explain, data=True)
    p.add_argument("--hypotheses")
    p.add_argument("--save-prompt")
    p.add_argument("--save-hypotheses")
    p.add_argument("--samples", type=int, default=1)
    p = command("plan", _plan)
    p.add_argument("-o", "--out")
    p.add_argument("--table")
    p.add_argument("--encoding", default="cp037")
    p = command("emit", _emit, copybook_=False)
    p.add_argument("plan")
    p.add_argument("--format", choices=("ddl", "jsonschema", "loader", "spark"), default="ddl")
    p = command("read-scan", _read_scan, copybook_=False)
    p.add_argument("image")
    p.add_argument("--blocks")
    p.add_argument("--data")
    p.add_argument("--declares", type=int)
    p.add_argument("--attempts", type=int, default=1)
    p.add_argument("-o", "--out")
    p = command("resolve", _resolve, copybook_=False)
    p.add_argument("plan")
    p.add_argument("--data", required=True)
    p.add_argument("--copybook")
    readings(p, None)
    p.add_argument("--resolutions")
    p.add_argument("--model", default="replies")
    p.add_argument("--apply", action="store_true")
    p = command("benchmark", _benchmark, data=True)
    p.add_argument("--models", required=True, help="files of replies, one a proposer, with commas between")
    p.add_argument("--samples", type=int, default=3)
    p.add_argument("-o", "--out")
    return top


def main(args: list[str] | None = None) -> int:
    """Exit codes: 0; 1 critical findings, open decisions or nothing proved; 2 refused; 3 no proposer."""
    a = _parser().parse_args(args)
    try:
        return a.run(a)
    except (LayoutMismatch, VariableRecordError, CopybookError, LayoutError, FileNotFoundError, PermissionError) as e:
        print(e, file=sys.stderr)
        return 2
    except (PlanError, VisionError) as e:
        print(e, file=sys.stderr)
        return 1
    except ProposerError as e:
        print(e, file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
