"""Command line: scrape, prepare, retry, export, models. Global flags may stand before or after the verb."""

from __future__ import annotations

import argparse
import logging

from gristmill.settings import TEMPLATES, Settings
from gristmill.sources.sinks import new_log, prune_logs, route_logs


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    d = Settings()
    whole = argparse.ArgumentParser(prog="gristmill", description="Training data from source repositories.")
    common = argparse.ArgumentParser(add_help=False, argument_default=argparse.SUPPRESS)
    for p, suppress in ((whole, False), (common, True)):
        for flag, kind, default in (("--max-file-size", int, d.max_file_size), ("--data-dir", str, d.data_dir), ("--repos-dir", str, d.repos_dir), ("--max-log-files", int, d.max_log_files), ("--backend", str, d.backend), ("--base-url", str, d.base_url), ("--model", str, d.model), ("--local-model", str, d.local_model), ("--local-batch", int, d.local_batch), ("--lanes-per-host", int, d.lanes_per_host)):
            p.add_argument(flag, type=kind, default=argparse.SUPPRESS if suppress else default)
    verbs = whole.add_subparsers(dest="command", required=True)
    s = verbs.add_parser("scrape", parents=[common], help="clone or update the listed repositories")
    s.add_argument("--list", default="repos.txt")
    for name in ("prepare", "retry"):
        v = verbs.add_parser(name, parents=[common], help="generate pairs" if name == "prepare" else "work again on failed files")
        v.add_argument("--max-tokens", type=int, default=d.max_tokens)
        v.add_argument("--temperature", type=float, default=d.temperature)
        v.add_argument("--files-in-flight", type=int, default=d.files_in_flight)
        v.add_argument("--model-tasks", type=int, default=d.model_tasks)
        v.add_argument("--memo-days", type=float, default=d.memo_days, help="use results of earlier runs for so many days; 0: never")
        v.add_argument("--batch-files", type=int, default=d.batch_files, help="with --by-repo: files for each commit; 0: a repository")
        v.add_argument("--by-repo", action="store_true", help="one commit for each repository; a stopped run goes on where it was")
    e = verbs.add_parser("export", parents=[common], help="write conversations in a template")
    e.add_argument("--template", choices=TEMPLATES, required=True)
    e.add_argument("--output-file", required=True)
    e.add_argument("--one-file", action="store_true")
    m = verbs.add_parser("models", parents=[common], help="list local model folders, tell about one, or remove one")
    m.add_argument("--cache", default="~/.cache/huggingface/hub")
    m.add_argument("--info", metavar="NAME", help="files and sizes of one model")
    m.add_argument("--remove", metavar="NAME")
    m.add_argument("--yes", action="store_true", help="remove without asking")
    return whole.parse_args(argv)


def settings_of(a: argparse.Namespace) -> Settings:
    known = {k: v for k, v in vars(a).items() if k in Settings.__dataclass_fields__}
    return Settings(**known)


def main(argv: list[str] | None = None) -> int:
    import os

    from pyspark.sql import SparkSession

    from gristmill.plans import pipeline
    from gristmill.sources.files import model_cache, model_files, remove_model

    a = parse(argv)
    s = settings_of(a)
    logs = os.path.join(s.data_dir, "logs")
    route_logs(new_log(logs), logging.INFO if a.command == "scrape" else logging.ERROR)
    spark = SparkSession.builder.appName("gristmill").getOrCreate()
    prune_logs(spark, logs, s.max_log_files)
    if a.command == "scrape":
        print(pipeline.scrape(spark, s, a.list))
    elif a.command in ("prepare", "retry"):
        getattr(pipeline, a.command)(spark, s).groupBy("success").count().show()
    elif a.command == "export":
        pipeline.export(spark, s, a.template, a.output_file, one_file=a.one_file)
    elif a.remove:
        return 0 if remove_model(os.path.expanduser(a.cache), a.remove, (lambda q: True) if a.yes else lambda q: input(q).strip().lower() in ("y", "yes")) else 1
    elif a.info:
        model_files(spark, os.path.expanduser(a.cache), a.info).show(1000, truncate=False)
    else:
        model_cache(spark, os.path.expanduser(a.cache)).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
