"""Command line: python -m faultline STAGE|all --root DIR [--config FILE] [--source FILE ...] [--limit N] [--restart]."""

from __future__ import annotations

import argparse

from faultline.plans.pipeline import STAGES, Run, run_stages
from faultline.session import local_session
from faultline.settings import load_settings
from faultline.sources.jsonl import reset
from faultline.sources.ports import DryRun, HttpService


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="faultline")
    parser.add_argument("stage", choices=[*(name for name, _ in STAGES), "all", "progress"])
    parser.add_argument("--root", required=True)
    parser.add_argument("--config")
    parser.add_argument("--source", action="append", default=[])
    parser.add_argument("--limit", type=int)
    parser.add_argument("--restart", action="store_true", help="forget earlier extraction results")
    parser.add_argument("--dry-run", action="store_true", help="answer questions and fuse names without a service")
    parser.add_argument("--progress-output")
    said = parser.parse_args(argv)
    settings, spark = load_settings(said.config), local_session()
    connect = DryRun if said.dry_run else (lambda service=settings.service: HttpService(service))
    run = Run(spark, settings, said.root, said.source, connect, said.limit, said.progress_output, None if said.dry_run else connect)
    if said.stage == "progress":
        print(f"{run.load('results').count() if run.has('results') else 0} of {run.load('cases').count()} cases have results")
        return 0
    if said.restart:
        reset(spark, *(f"{said.root}/{n}" for n in ("nodes", "edges", "votes", "results", "held")))
    for step in run_stages(run, [s for s in STAGES if said.stage in ("all", s[0])]):
        print(f"{step['name']}: {step['seconds']} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
