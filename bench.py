"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the median seconds of RUNS warm runs each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from threadmill.images import png, slicer  # noqa: E402
from threadmill.plans.archive_queries import QUERIES  # noqa: E402

RUNS = 3
HEADLINE = (
    "messages_per_sender", "thread_summary", "per_month", "per_hour", "most_active_day", "top_sender", "longest_message", "text_stats", "response_time", "date_divider", "date_range", "search_ci",
    "search_report_top3", "dashboard_grouping_sets", "top20_senders", "dedup_first_wins", "duplicate_groups", "merge_union", "attachments_by_type", "batch_pack", "slice_windows", "slugify",
    "unique_thread_id", "clean_whitespace", "mojibake_roundtrip", "hamming_pairs", "unified_index")


def page(height=15_000, width=1080, line=34):
    """A tall picture with gray bars in the place of text lines."""
    img = np.full((height, width, 3), 255, np.uint8)
    for y in range(100, height - 100, line):
        img[y:y + line // 2, 80:width - 180] = 60
    return img


def seconds(f) -> float:
    f()
    took = []
    for _ in range(RUNS):
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took), 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: seconds(lambda f=QUERIES[name]: f(spark, sf_dir).write.format("noop").mode("overwrite").save()) for name in HEADLINE}
    img = page()
    plain = slicer.SliceConfig(upscale=1.0)
    for name, cfg in {"slice_plain": plain, "slice_deskew": slicer.SliceConfig(upscale=1.0, deskew=True)}.items() | {f"slice_{k}": v for k, v in slicer.PRESETS.items()}.items():
        took[name] = seconds(lambda cfg=cfg: slicer.slice_image("/page.png", img, cfg))
    with tempfile.TemporaryDirectory() as at:  # from files to slices in Spark: decoding, the way to Python and back, encoding
        for k in range(int(cpus)):
            with open(f"{at}/{k}.png", "wb") as f:
                f.write(png.encode(img, level=1))
        took["slice_files_fast"] = seconds(lambda: slicer.slice_images(slicer.read_images(spark, at), slicer.PRESETS["fast"]).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "sum of median seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
