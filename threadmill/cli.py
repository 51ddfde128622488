"""Command lines over the Python API: ``python -m threadmill.cli archive ...`` and ``... slice ...``.

Exit codes of archive: 0 done, 1 no --out, 2 input missing, 3 nothing found, 4 bad date; of slice: 0, 2, 3 no images, 4 none succeeded.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt
import functools
import json
import os
import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.images import kernels, png, slicer
from threadmill.operators import dedup, filters, stats
from threadmill.session import saved, session
from threadmill.sinks import threads as sinks
from threadmill.sinks.files import file_system, put
from threadmill.sources.export_reader import discover, list_files, read_archive
from threadmill.streaming import incremental

#: What a configuration file may set, and what it is otherwise.
CONFIG = {"formats": ["md"], "self_name": None, "stats": False, "copy_media": False, "incremental": False, "time_zone": "UTC", "verbose": False, "quiet": False}
#: Other names of settings.
ALIASES = {"output_formats": "formats", "generate_stats": "stats", "copy_attachments": "copy_media"}
#: Where a configuration and a page's template are looked for, in the working folder and then at home.
CONFIG_FILES = (".threadmill.json", "~/.threadmill.json")
TEMPLATE_FILES = ("templates/thread.html", "~/.config/threadmill/templates/thread.html")


def first_file(paths) -> str | None:
    """The text of the first of the files that is there."""
    for p in map(os.path.expanduser, paths):
        if os.path.isfile(p):
            with open(p, encoding="utf-8") as f:
                return f.read()
    return None


def load_config(path: str | None = None) -> dict:
    """The settings of a file (JSON, or YAML where its reader is installed), or of the first one found, over the defaults."""
    if path and not os.path.isfile(path):
        raise FileNotFoundError(path)
    found = first_file([path] if path else CONFIG_FILES)
    if found is None:
        return dict(CONFIG)
    try:
        given = json.loads(found)
    except ValueError:
        import yaml

        given = yaml.safe_load(found) or {}
    return CONFIG | {name: v for k, v in given.items() if (name := ALIASES.get(k, k)) in CONFIG}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadmill")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("archive", help="read exports; write threads, an index and statistics")
    a.add_argument("--input", nargs="+", required=True)
    a.add_argument("--out")
    for fmt in ("csv", "json", "html"):
        a.add_argument(f"--{fmt}", action="store_true")
    a.add_argument("--limit", type=int)
    a.add_argument("--after")
    a.add_argument("--before")
    a.add_argument("--before-inclusive-day", action="store_true")
    for flag in ("dry-run", "stats", "copy-media", "merge", "incremental", "cache-stats", "clear-cache", "keep-good-files", "case-sensitive", "verbose", "quiet"):
        a.add_argument(f"--{flag}", action="store_true")
    a.add_argument("--search")
    a.add_argument("--self-name")
    a.add_argument("--config", help="a JSON file (default: .threadmill.json here or at home)")
    a.add_argument("--template", help="an HTML page for threads (default: templates/thread.html here or in ~/.config/threadmill)")
    a.add_argument("--save-config", help="write the defaults there and stop")
    a.add_argument("--store", help="folder of incremental runs (default: OUT/_store)")
    s = sub.add_parser("slice", help="cut tall images into slices")
    s.add_argument("--input")
    s.add_argument("--out", required=True)
    s.add_argument("--selftest", action="store_true", help="slice made-up pictures below OUT/_selftest and check what comes out")
    s.add_argument("--recursive", action="store_true")
    s.add_argument("--preset", choices=sorted(slicer.PRESETS))
    for f in dataclasses.fields(slicer.SliceConfig):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            s.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        else:
            s.add_argument(flag, type=int if f.name == "output_dpi" else type(f.default), default=None)
    return p


def _exists(path):
    system, p = file_system(path)
    return system.get_file_info(p).type.name != "NotFound"


def archive(args) -> int:
    if args.save_config:
        put(*args.save_config.rsplit("/", 1) if "/" in args.save_config else (".", args.save_config), json.dumps(CONFIG, indent=2))
        return 0
    config = load_config(args.config)
    template = first_file([args.template] if args.template else TEMPLATE_FILES)
    say = (lambda *x: None) if args.quiet or config["quiet"] else print
    store = args.store or (f"{args.out}/_store" if args.out else None)
    if args.clear_cache:
        if store and _exists(store):
            system, p = file_system(store)
            system.delete_dir(p)
        return 0
    if not args.search and not args.out:
        say("--out is needed")
        return 1
    if missing := [p for p in args.input if not _exists(p)]:
        say(f"not found: {', '.join(missing)}")
        return 2
    try:
        after, before = filters.parse_date(args.after), filters.parse_date(args.before)
    except filters.BadDate as e:
        say(e)
        return 4
    spark = session(time_zone=config["time_zone"])
    if args.cache_stats:
        print(incremental.stats_of(spark, store).first().asDict())
        return 0
    if args.dry_run:
        files = functools.reduce(DataFrame.unionByName, [list_files(spark, p, p, seq) for seq, p in enumerate(args.input)])
        rows = discover(files).select("source_seq", "standalone", "thread_key").distinct().orderBy("source_seq", "standalone", "thread_key")
        for r in (rows.limit(args.limit) if args.limit else rows).toLocalIterator():
            print("FILE" if r.standalone else "DIR ", r.thread_key)
        return 0
    if args.incremental or config["incremental"]:
        for seq, path in enumerate(args.input):
            say(incremental.update(spark, path, store, path, seq))
        threads, messages = incremental.current(spark, store)
        messages = filters.in_date_range(messages, after, before, args.before_inclusive_day)
    else:
        a = read_archive(spark, [(p, p) for p in args.input], args.limit, after, before, args.keep_good_files, args.before_inclusive_day)
        threads, messages = a.threads, a.messages
        if not args.search:
            for r in a.rejects.toLocalIterator():
                say(f"rejected: {r.path}: {r.error}")
            if args.verbose or config["verbose"]:
                for r in a.fixes.toLocalIterator():
                    say(f"repaired: {r.path}: {', '.join(r.fixes)}")
    if args.search:
        report = filters.search_report(messages, args.search, case_sensitive=args.case_sensitive).join(threads.select("thread_key", "title", "thread_seq"), "thread_key")
        for r in report.orderBy(F.desc("n_matches"), "thread_seq", "rank").toLocalIterator():
            if r["rank"] == 1:
                print(f"{r.title}: {r.n_matches} matches" + (f", {r.n_more} more than shown" if r.n_more else ""))
            print(f"  {r.dt_iso} {r.sender}: {r.preview}")
        return 0
    if args.merge:
        threads, messages = dedup.merge(threads, messages)
    messages = saved(messages)
    threads = saved(dedup.thread_ids(threads.join(messages.select("thread_key").distinct(), "thread_key", "left_semi")))
    if threads.isEmpty():
        say("no threads found")
        return 3
    for r in dedup.duplicate_groups(threads).toLocalIterator():
        say(f"same participants ({r.participants}): {r.n_threads} threads")
    now = dt.datetime.now().isoformat(timespec="seconds")
    wanted = ["md"] + [f for f in ("csv", "json", "html") if getattr(args, f) or f in config["formats"]]
    for fmt in wanted:
        done = sinks.write_threads(messages, threads, f"{args.out}/threads_{fmt}", fmt, args.self_name or config["self_name"], template).agg(F.count("*").alias("n")).first()
        say(f"{done.n} {fmt} files")
    sinks.write_index(messages, threads, args.out, now)
    if args.stats or config["stats"]:
        sinks.write_dashboard(messages, threads, args.out, now)
        stats.thread_statistics(messages, threads).write.mode("overwrite").parquet(f"{args.out}/statistics")
    if args.copy_media or config["copy_media"]:
        done = sinks.copy_media(messages, threads, {p: p for p in args.input}, f"{args.out}/media").where("copied").count()
        say(f"{done} media files copied")
    return 0


def selftest(out: str) -> int:
    """Slices light, dark, skew and repeating made-up pictures; 0 if all is as it should be."""
    page = np.full((5500, 900, 3), 255, np.uint8)
    rng = np.random.default_rng(7)
    for y in range(60, 5400, 40):
        page[y:y + 20, 90:int(rng.integers(500, 800))] = 40
    pictures = {"light": page, "dark": 255 - page, "skew": kernels.rotate(page, 1.25), "repeat": np.concatenate([page[:1600], page[:1600], page[1600:4000]])}
    for name, img in pictures.items():
        put(f"{out}/_selftest", f"{name}.png", png.encode(img))
    spark = session()
    images = slicer.read_images(spark, f"{out}/_selftest")
    full = dict(auto_crop=True, auto_chunk=True, auto_contrast=True)
    ways = {
        "full": slicer.SliceConfig(**full, denoise=True, deskew=True, batch_size=15), "binarize": slicer.SliceConfig(**full, binarize=True),
        "jpeg": slicer.SliceConfig(upscale=1.0, out_format="jpeg"), "dedupe": slicer.SliceConfig(upscale=1.0, overlap=0, dedupe=True, dedupe_mad_threshold=1.5)}
    bad = []
    for way, cfg in ways.items():
        slices = saved(slicer.slice_images(images, cfg))
        slicer.write_slices(slices, f"{out}/_selftest/{way}", cfg).write.format("noop").mode("overwrite").save()
        total = slicer.totals(slices).first()
        print(f"{way}: {total.kept} slices kept, {total.skipped} skipped")
        if total.failed or total.ok != len(pictures) or (total.skipped > 0) != (way == "dedupe"):
            bad.append(way)
    print(f"failed: {', '.join(bad)}" if bad else "all is well")
    return 4 if bad else 0


def slice_(args) -> int:
    if args.selftest:
        return selftest(args.out)
    if not args.input or not _exists(args.input):
        return 2
    given = {f.name: v for f in dataclasses.fields(slicer.SliceConfig) if (v := getattr(args, f.name)) is not None}
    if given.get("out_format") == "jpg":  # the files' ending is taken for the format's name
        given["out_format"] = "jpeg"
    cfg = dataclasses.replace(slicer.PRESETS[args.preset] if args.preset else slicer.SliceConfig(), **given)  # flags go before the preset's settings
    spark = session()
    images = slicer.read_images(spark, args.input, args.recursive)
    slices = saved(slicer.slice_images(images, cfg))
    total = slicer.totals(slices).first()
    if not total.ok and not total.failed:
        return 3
    slicer.write_slices(slices, args.out, cfg).write.format("noop").mode("overwrite").save()
    for r in slices.where("error is not null").select("path", "error").toLocalIterator():
        print(f"failed: {r.path}: {r.error}")
    print(f"{total.ok} images, {total.kept} slices kept, {total.skipped} skipped, {total.failed} failed")
    return 0 if total.ok else 4


def main(argv=None) -> int:
    args = parser().parse_args(argv)
    return archive(args) if args.command == "archive" else slice_(args)


if __name__ == "__main__":
    sys.exit(main())
