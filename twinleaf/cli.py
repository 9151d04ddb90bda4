"""Command line: init, doctor, inspect, freeze-glossary, build, apply-review. Exit code 0 or 2."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .scaffold import doctor, init_project


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("twinleaf").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def provider_from(env: dict[str, str], args):
    """A provider from TRANSLATE_ settings; missing ones are an error that names them."""
    from .sources.model import Provider

    names = ("TRANSLATE_BASE_URL", "TRANSLATE_API_KEY", "TRANSLATE_MODEL")
    if absent := [n for n in names if not env.get(n, "").strip()]:
        raise ValueError("missing settings: " + ", ".join(absent))
    return Provider(env[names[0]], env[names[1]], env.get("TRANSLATE_PROTOCOL", "anthropic"), env.get("TRANSLATE_AUTH", "bearer"), env.get("TRANSLATE_PATH_PREFIX", "/v1"), env[names[2]], args.max_output_tokens, args.concurrency, args.timeout, args.max_retries)


def _init(args) -> int:
    print(f"wrote {len(init_project(args.destination))} files")
    return 0


def _doctor(args) -> int:
    checks = doctor(args.project_root, args.env_file)
    for name, ok, detail in checks:
        print(f"[{'OK' if ok else 'FAIL'}] {name}: {detail}")
    return 0 if all(ok for _, ok, _ in checks) else 2


def _levels(args) -> tuple[int, ...]:
    return tuple(args.chapter_level or (1,))


def _inspect(args) -> int:
    from .plans.build import inspect_book

    found = inspect_book(_spark(), str(args.source), args.book_slug, _levels(args), args.target_words, args.context_blocks, args.max_output_tokens)
    print(json.dumps(found, ensure_ascii=False, indent=2))
    return 0


def _freeze(args) -> int:
    from .plans.build import freeze_glossary

    print("version", freeze_glossary(_spark(), args.root, args.domain, args.book, args.output, args.author))
    return 0


def _build(args) -> int:
    from .plans.build import build_book
    from .sources import files, model

    if args.snapshot is None and not args.allow_empty_glossary:
        raise ValueError("a build is bound to a frozen glossary: pass --snapshot (or --allow-empty-glossary for a trial)")
    spark = _spark()
    provider = provider_from(files.read_env(args.env_file), args)
    snapshot = files.read_snapshot(spark, args.snapshot) if args.snapshot else None
    cards = model.chapter_cards(spark, str(args.chapter_cards)) if args.chapter_cards else None
    notes = files.read_annotations(spark, *args.image_annotations) if args.image_annotations else None
    style = Path(args.style_card).read_text(encoding="utf-8")
    report = build_book(spark, str(args.source), args.build_root, provider, style, snapshot, args.book_slug, cards, args.target_words, args.context_blocks, args.chapter, _levels(args), notes)
    print(f"{report.book}: {report.done}/{report.chunks} chunks, cost ${report.cost:.6f}, {'ok' if report.ok else 'blocked'}")
    if args.publish_to:
        if not report.ok:
            raise files.PublicationBlocked("the build is not ok")
        order = {r["chapter"]: i for i, r in enumerate(json.loads(x) for x in (report.folder / "chunks.jsonl").read_text(encoding="utf-8").splitlines())}
        pages = sorted((p for p in (report.folder / "chapters").glob("*.md")), key=lambda p: order.get(p.stem, 0))
        made = spark.createDataFrame([(p.stem, i, p.read_text(encoding="utf-8")) for i, p in enumerate(pages)], "chapter string, first_seq long, markdown string")
        images = args.images_dir or Path(args.source).with_name(Path(args.source).stem + "-images")
        facts = {"模型": provider.model, "术语快照": str(args.snapshot or "none"), "构建目录": str(report.folder)}
        print("published", files.publish(made, spark.createDataFrame([], "chapter string, ok boolean"), args.publish_to, args.folder_name or report.book, args.book_title or report.book, facts, images))
    return 0 if report.ok else 2


def _review(args) -> int:
    from .plans.build import apply_review

    print("revised blocks:", apply_review(_spark(), args.build_dir, args.input))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinleaf", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flags, more in options:
            p.add_argument(*flags.split(), **more)
        return p

    path, many = {"type": Path}, {"action": "append"}
    plan = [
        ("source", path), ("--book-slug", {}), ("--chapter-level", {**many, "type": int, "choices": range(1, 7)}), ("--target-words", {"type": int, "default": 1500}),
        ("--context-blocks", {"type": int, "default": 2}), ("--max-output-tokens", {"type": int, "default": 8192}),
    ]
    command("init", _init, ("destination", {**path, "nargs": "?", "default": Path(".")}))
    command("doctor", _doctor, ("--project-root", {**path, "default": Path(".")}), ("--env-file", {**path, "default": Path(".env")}))
    command("inspect", _inspect, *plan)
    command("freeze-glossary", _freeze, ("--root", {**path, "default": Path("glossary")}), ("--domain", {"required": True}), ("--book", {"required": True}), ("--author", many), ("--output", {**path, "required": True}))
    command(
        "build", _build, *plan, ("--env-file", {**path, "default": Path(".env")}), ("--build-root", {**path, "default": Path("build")}), ("--style-card", {**path, "default": Path("style-card.md")}),
        ("--snapshot", path), ("--allow-empty-glossary", {"action": "store_true"}), ("--chapter-cards", path), ("--chapter", many), ("--concurrency", {"type": int, "default": 2}),
        ("--timeout", {"type": int, "default": 180}), ("--max-retries", {"type": int, "default": 4}), ("--publish-to", path), ("--folder-name", {}), ("--book-title", {}),
        ("--images-dir", path), ("--image-annotations", {**many, **path}),
    )
    command("apply-review", _review, ("--build-dir", {**path, "required": True}), ("--input", {**path, "required": True}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (ValueError, RuntimeError, FileExistsError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
