"""Command line: translate, config, providers, models, version."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Sequence
from dataclasses import fields
from pathlib import Path

from quirelight.functions.messages import MESSAGES, message
from quirelight.operators import settings as S

VERSION = "0.2"
# Flags and the settings that they change.
FLAGS = {
    "to": "target_language", "code": "target_code", "from": "source_language", "from-code": "source_code", "provider": "provider", "model": "model", "base-url": "base_url", "effort": "effort",
    "chunk": "chunk_chars", "max-segments": "max_segments", "max-tokens": "max_tokens", "attempts": "attempts", "context": "context_chars", "timeout": "timeout_seconds", "rpm": "requests_per_minute",
    "style": "style_notes", "about": "about", "titles": "translate_titles", "salvage": "salvage_pass", "format": "format",
}


def _flag(value: str) -> bool:
    if value.lower() in ("1", "t", "true", "yes"):
        return True
    if value.lower() in ("0", "f", "false", "no"):
        return False
    raise argparse.ArgumentTypeError(f"not true or false: {value!r}")


def parser() -> argparse.ArgumentParser:
    kinds = {f.name: type(f.default) for f in fields(S.Settings)}
    top = argparse.ArgumentParser(prog="quirelight")
    top.add_argument("--settings", default=os.path.expanduser("~/.config/quirelight/settings.json"))
    top.add_argument("--lang", default="", choices=["", *MESSAGES])
    commands = top.add_subparsers(dest="command")
    run = commands.add_parser("translate")
    run.add_argument("book")
    for flag, name in FLAGS.items():
        run.add_argument(f"--{flag}", dest=name, type=_flag if kinds[name] is bool else kinds[name], default=None)
    run.add_argument("-o", "--output", default="")
    run.add_argument("--chapters", default="")
    run.add_argument("--glossary-file", default="")
    run.add_argument("--no-resume", action="store_true")
    run.add_argument("--retry", action="store_true")
    run.add_argument("--quiet", action="store_true")
    commands.add_parser("config")
    commands.add_parser("providers")
    commands.add_parser("models")
    commands.add_parser("version")
    return top


def settings_of(given: argparse.Namespace) -> tuple[S.Settings, str | None]:
    """Settings of the file with the flags over them."""
    from dataclasses import replace

    own, error = S.load(given.settings) if os.path.exists(given.settings) else (S.Settings(), None)
    flags = {name: getattr(given, name) for name in FLAGS.values() if getattr(given, name, None) is not None}
    if getattr(given, "glossary_file", ""):
        flags["glossary"] = Path(given.glossary_file).read_text(encoding="utf-8").strip()
    if getattr(given, "no_resume", False):
        flags["resume"] = False
    return replace(own, **flags), error


def main(arguments: Sequence[str] | None = None, spark=None, transport=None) -> int:
    given = parser().parse_args(arguments)
    say = lambda key, *args: print(message(key, given.lang or "en", *args), file=sys.stderr)
    settings, error = settings_of(given)
    if error:
        say("settings.ignored", error)
    if given.command == "version":
        print(VERSION)
    elif given.command == "providers":
        rank = lambda s: (0 if s[0] == S.SERVICES[0][0] else 1 if s[5] else 2 if s[6] else 3)
        for s in sorted(S.SERVICES, key=rank):
            print(f"{s[0]}\t{s[1]}\t{s[3]}")
    elif given.command == "config":
        S.save(settings, given.settings)
        print(given.settings)
    elif given.command == "models":
        from quirelight.operators.services import build

        for name in build(settings, transport=transport).models():
            print(name)
    elif given.command == "translate":
        return _translate(given, settings, say, spark, transport)
    else:
        parser().print_help()
        return 2
    return 0


def _translate(given: argparse.Namespace, settings: S.Settings, say, spark, transport) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quirelight.operators import books, reports
    from quirelight.operators.cache import Store
    from quirelight.operators.services import build
    from quirelight.sources import epub

    wrong = settings.problem()
    if wrong:
        say("settings.wrong", wrong)
        return 2
    output = Path(given.output) if given.output else S.output_path(given.book, settings)
    S.check_writable(output)  # before anything is spent
    spark = spark or SparkSession.builder.appName("quirelight").getOrCreate()
    work = os.path.join(os.path.dirname(os.path.abspath(given.settings)), "runs")
    found = epub.books(spark, given.book)
    head = epub.packages(found).first()
    if head is None or head.error:
        print(head.error if head else given.book, file=sys.stderr)
        return 1
    if not given.quiet:
        say("run.head", head.title or "-", settings.target_language, settings.model or settings.provider)
    began = time.time()
    run = books.translate(found, lambda: build(settings, transport=transport), f"{work}/last", settings, store=Store(spark, f"{work}/store"), retry=given.retry, spec=given.chapters)
    if settings.format == "txt":
        pieces = books.texts(found, run.changed).orderBy("k").toLocalIterator()
        output.write_text("".join(p.piece for p in pieces), encoding="utf-8")
    else:
        output.write_bytes(bytes(run.books.first().content))
    total = run.totals.first()
    if not given.quiet:
        say("run.totals", total.translated, total.segments, total.pending)
        say("run.calls", total.usable, total.attempted, total.cached)
        say("run.usage", total.input, total.output) if total.input is not None else say("run.unreported")
        problems, remarks = reports.split(run.notes)
        for key, found_notes in (("run.notes", problems), ("run.remarks", remarks)):
            n = found_notes.count()
            if n:
                say(key, n)
                for r in found_notes.orderBy("doc_id", "seg").limit(20).collect():
                    print(f"  {r.doc_id} {r.seg if r.seg >= 0 else ''} {r.message}", file=sys.stderr)
                if n > 20:
                    say("run.more", n - 20)
        print(f"{time.time() - began:.0f}s", file=sys.stderr)
    print(output)
    failed = run.states.where(F.col("status").isin("failed", "pending")).select("title", "error").collect()
    if failed:
        say("run.failed", len(failed), "; ".join(f"{r.title} ({r.error})" for r in failed))
        return 1
    if total.segments > 0 and total.translated == 0:
        say("run.none")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
