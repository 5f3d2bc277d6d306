"""Command line: generate, clean, score, view, list-templates."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from sftloom.operators import profile
from sftloom.plans import config, pipeline, prompts
from sftloom.plans.clients import Client, HttpClient, StubClient
from sftloom.sources import readers, writers


def client(c: config.App) -> Client:
    """A service's client where one is configured, else the offline stub."""
    url, key = c.api.base_url or os.environ.get("MODEL_BASE_URL", ""), c.api.api_key or os.environ.get("MODEL_API_KEY", "")
    return HttpClient(url, key, c.api.model) if url else StubClient()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sftloom", description=__doc__)
    sub = parser.add_subparsers(dest="verb", required=True)
    for verb in ("generate", "clean", "score", "view"):
        p = sub.add_parser(verb)
        p.add_argument("file")
        p.add_argument("-c", "--config")
        p.add_argument("-o", "--output")
    sub.choices["generate"].add_argument("--count", type=int)
    sub.choices["generate"].add_argument("--dry-run", action="store_true")
    view = sub.choices["view"]
    view.add_argument("-n", "--samples", type=int, default=0)
    view.add_argument("-q", "--similarity", action="store_true")
    view.add_argument("-j", "--json", action="store_true")
    sub.add_parser("list-templates")
    args = parser.parse_args(argv)
    if args.verb == "list-templates":
        print("\n".join(prompts.templates()))
        return 0
    config.load_environment()
    spark = SparkSession.builder.getOrCreate()
    given = args.file if args.verb == "generate" else args.config
    settings = config.from_yaml(given) if given and not given.endswith(".json") else config.from_dict(json.load(open(given, encoding="utf-8"))) if given else config.App()
    if args.verb == "generate":
        settings.count, settings.dry_run = args.count or settings.count, args.dry_run or settings.dry_run
        settings.output.path = args.output or settings.output.path
        pipeline.run(pipeline.Context(spark, settings, client(settings)), observer=pipeline.LogObserver())
        return 0
    rows = readers.read_samples(spark, args.file, settings.cleaner.field_map)
    if args.verb == "clean":
        writers.write_cleaned(pipeline.clean_rows(rows, settings.cleaner), args.output or writers.derived_path(args.file, "cleaned"), "overwrite")
    elif args.verb == "score":
        settings.scoring.enabled = True
        ctx = pipeline.Context(spark, settings, client(settings))
        writers.write_cleaned(pipeline.score(readers.scorable(rows), ctx), args.output or writers.scored_path(args.file), "overwrite")
    else:
        errors = readers.parse_errors(readers.read_lines(spark, args.file)).first().parse_errors
        found = pipeline.inspect(rows, errors, args.similarity)
        print(json.dumps(found, ensure_ascii=False, default=str) if args.json else pipeline.render(found, args.file))
        if args.samples:
            profile.preview(rows, args.samples).show(args.samples, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
