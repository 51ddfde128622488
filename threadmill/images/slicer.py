"""The slicer: tall images become overlapping, de-duplicated slices. An image is a row, and the unit of parallel work.

Images come from Spark's image source, are handed to Python one at a time (they can have hundreds of MB), and leave as a row
for each slice. An image that fails gives one row with its error instead, so one bad file stops nothing.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.images import jpeg, kernels, png
from threadmill.sinks.files import put, write_files

SUFFIXES = ("png", "jpg", "jpeg", "webp")
#: Formats that can be written, and what their files' names end in.
ENDINGS = {"png": "png", "jpeg": "jpg"}


# The settings' names and defaults.
@dataclass(frozen=True)
class SliceConfig:
    chunk_h: int = 1600
    overlap: int = 120
    upscale: float = 1.5
    crop_left: int = 0
    crop_right: int = 0
    crop_top: int = 0
    crop_bottom: int = 0
    contrast: float = 1.0
    out_format: str = "png"
    auto_crop: bool = False
    auto_crop_pad: int = 12
    auto_chunk: bool = False
    auto_chunk_target_lines: int = 38
    auto_chunk_min: int = 1000
    auto_chunk_max: int = 2200
    auto_contrast: bool = False
    auto_contrast_strength: float = 1.25
    auto_brightness: float = 1.05
    denoise: bool = False
    deskew: bool = False
    deskew_max_deg: float = 2.0
    deskew_step_deg: float = 0.25
    deskew_fast: bool = False
    binarize: bool = False
    dedupe: bool = False
    dedupe_hamming: int = 4
    dedupe_thumb: int = 64
    dedupe_mad_threshold: float = 2.0
    manifest: bool = True
    batch_size: int = 0
    make_prompt: bool = True
    prompt_lang: str = "pl"
    output_dpi: int | None = None
    save_debug: bool = False
    jpg_quality: int = 92

    def __post_init__(self):
        if self.out_format not in ENDINGS or not 1 <= self.jpg_quality <= 100:
            raise kernels.SliceError("slices are written as png or jpeg, of a quality from 1 to 100")


# What the presets set besides the defaults.
PRESETS = {
    "fast": SliceConfig(overlap=100, upscale=1.0, dedupe=True, output_dpi=150),
    "balanced": SliceConfig(auto_crop=True, auto_chunk=True, auto_contrast=True, dedupe=True, output_dpi=300),
    "quality": SliceConfig(overlap=150, upscale=2.0, auto_crop=True, auto_chunk=True, auto_contrast=True, deskew=True, deskew_fast=True, dedupe=True, output_dpi=300),
}

SLICES = ("path string, image_key string, error string, index int, skipped boolean, duplicate_of_index int, file string, dhash string, width int, height int, "
          "sha256 string, batch int, meta string, stage string, content binary")


def prepare(img: np.ndarray, cfg: SliceConfig):
    """(image ready to be cut, chunk height, facts about each step, [(stage, image)] for debugging)."""
    shown = [("00_original", img)]
    meta: dict = {"source_size": {"w": int(img.shape[1]), "h": int(img.shape[0])}}
    img, meta["manual_crop_box"] = kernels.margin_crop(img, cfg.crop_left, cfg.crop_top, cfg.crop_right, cfg.crop_bottom)
    if cfg.auto_crop:
        img, meta["auto_crop_box"], meta["auto_crop_reason"] = kernels.auto_crop(img, cfg.auto_crop_pad)
        shown.append(("01_crop", img))
    img = kernels.upscale(img, cfg.upscale)
    shown.append(("02_upscale", img))
    if cfg.deskew:
        angle = kernels.skew_angle_two_stage(img, cfg.deskew_max_deg) if cfg.deskew_fast else kernels.skew_angle(img, cfg.deskew_max_deg, cfg.deskew_step_deg)
        img, meta["deskew_angle_deg"] = kernels.rotate(img, angle), angle
        shown.append(("03_deskew", img))
    img, meta["dark_mode"], meta["enhanced"] = kernels.enhance(img, cfg.auto_contrast, cfg.auto_contrast_strength, cfg.auto_brightness, cfg.denoise, cfg.contrast)
    if meta["enhanced"]:
        shown.append(("04_enhance", img))
    if cfg.binarize:
        img, meta["binarize_otsu_threshold"] = kernels.binarize(img)
        shown.append(("05_binarize", img))
    height = cfg.chunk_h
    if cfg.auto_chunk:
        meta["line_height"] = line = kernels.line_height(img)
        height = kernels.chunk_height(line, cfg.auto_chunk_target_lines, cfg.auto_chunk_min, cfg.auto_chunk_max, cfg.chunk_h)
    meta["chunk_h"] = height
    return img, height, meta, shown if cfg.save_debug else []


def cut(img: np.ndarray, height: int, cfg: SliceConfig):
    """Slices in order, each compared with the last one kept: dicts with index, image, dhash, duplicate_of."""
    kept = None
    for i, (top, bottom) in enumerate(kernels.slices(len(img), height, cfg.overlap), 1):
        part = img[top:bottom]
        h, thumb = kernels.dhash(part), kernels.thumbnail(part, cfg.dedupe_thumb)
        same = (cfg.dedupe and kept is not None and kernels.hamming64(kept[0], h) <= cfg.dedupe_hamming
                and kernels.mean_abs_diff(kept[1], thumb) <= cfg.dedupe_mad_threshold)
        if not same:
            kept = (h, thumb)
        yield {"index": i, "image": part, "dhash": f"{h & ((1 << 64) - 1):016x}", "duplicate_of": i - 1 if same else None}


def slice_image(path: str, img: np.ndarray, cfg: SliceConfig) -> list[dict]:
    """The rows of one image."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    key = f"{stem}-{hashlib.sha256(path.encode()).hexdigest()[:8]}"
    ready, height, meta, shown = prepare(img, cfg)
    rows = []
    for s in cut(ready, height, cfg):
        row = {"path": path, "image_key": key, "index": s["index"], "skipped": s["duplicate_of"] is not None, "duplicate_of_index": s["duplicate_of"], "dhash": s["dhash"],
               "width": s["image"].shape[1], "height": s["image"].shape[0], "meta": json.dumps(meta), "stage": "slice"}
        if not row["skipped"]:
            data = jpeg.encode(s["image"], cfg.jpg_quality, cfg.output_dpi) if cfg.out_format == "jpeg" else png.encode(s["image"], cfg.output_dpi)
            row |= {"file": f"{stem}_{s['index']:03d}.{ENDINGS[cfg.out_format]}", "content": data, "sha256": hashlib.sha256(data).hexdigest()}
        rows.append(row)
    if cfg.batch_size > 0:
        for n, row in enumerate(sorted((r for r in rows if not r["skipped"]), key=lambda r: r["file"])):
            row["batch"] = n // cfg.batch_size + 1
    for name, image in shown:
        data = png.encode(image)
        rows.append({"path": path, "image_key": key, "index": 0, "skipped": False, "file": f"debug/{name}.png", "content": data, "sha256": hashlib.sha256(data).hexdigest(),
                     "width": image.shape[1], "height": image.shape[0], "meta": json.dumps(meta), "stage": name})
    return rows


def read_images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, height, width, channels and data (BGR or gray) of each image; those that can't be decoded have no data."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)  # a raster can have hundreds of MB
    glob = "*.{" + ",".join(x for s in SUFFIXES for x in (s, s.upper())) + "}"
    df = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path)
    return df.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def slice_images(images: DataFrame, cfg: SliceConfig) -> DataFrame:
    """The slices of images, in the schema SLICES; error is set in the one row of an image that failed."""
    columns = [c.split()[0] for c in SLICES.split(", ")]

    def run(batches):
        for batch in batches:
            for path, h, w, n, data in zip(batch["path"], batch["height"], batch["width"], batch["channels"], batch["data"], strict=True):
                try:
                    if h <= 0 or w <= 0 or not data:
                        raise kernels.SliceError("no image that can be decoded")
                    raw = np.frombuffer(data, np.uint8).reshape(h, w, n)
                    rgb = np.repeat(raw, 3, axis=2) if n == 1 else raw[:, :, 2::-1]
                    rows = slice_image(path, np.ascontiguousarray(rgb), cfg)
                except (kernels.SliceError, ValueError, MemoryError) as e:
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                for row in rows:  # one at a time: contents are large
                    yield pd.DataFrame([row], columns=columns, dtype=object).astype({c: "Int64" for c in ("index", "duplicate_of_index", "width", "height", "batch")})

    return images.select("path", "height", "width", "channels", "data").mapInPandas(run, SLICES)


def totals(slices: DataFrame) -> DataFrame:
    """Images done and failed, slices kept and skipped."""
    return slices.where("stage = 'slice' or error is not null").agg(
        F.count_distinct(F.when(F.col("error").isNull(), F.col("path"))).alias("ok"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("path"))).alias("failed"),
        F.count(F.when(~F.col("skipped"), 1)).alias("kept"), F.count(F.when(F.col("skipped"), 1)).alias("skipped"))


PROMPTS = {
    "en": "These pictures are consecutive parts of one conversation, from top to bottom; neighbours overlap a little. Write out the messages in order, each once, with sender and time where they can be seen.",
    "pl": "Te obrazy to kolejne części jednej rozmowy, od góry do dołu; sąsiednie trochę na siebie zachodzą. Wypisz wiadomości po kolei, każdą raz, z nadawcą i godziną, jeśli są widoczne.",
}


def prompt(names, lang="pl") -> str:
    return PROMPTS.get(lang, PROMPTS["en"]) + "\n\n" + "\n".join(f"- {n}" for n in names) + "\n"


def write_slices(slices: DataFrame, out: str, cfg: SliceConfig) -> DataFrame:
    """Writes files, batches with prompts and manifests below out; a row (path, n_files) for each image.

    ``slices`` is read twice; give it as a written table or a checkpoint. Contents are written where they are; a manifest
    needs only an image's records, without contents.
    """
    made = slices.where("content is not null")
    names = F.concat_ws("/", "image_key", F.when(F.col("batch").isNotNull(), F.format_string("batch_%03d", "batch")), "file")
    write_files(made.select(names.alias("name"), "content"), out)
    bare = slices.where("error is null and stage = 'slice'").drop("content").repartition("image_key").sortWithinPartitions("image_key", "index")
    settings = dataclasses.asdict(cfg)

    def manifests(batches):
        key, rows = None, []

        def finish():
            kept = [r for r in rows if not r.skipped]
            if cfg.manifest:
                meta = json.loads(rows[0].meta)
                whole = {
                    "generated_at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "source": {"file": rows[0].path.rsplit("/", 1)[-1], "path": rows[0].path, "size": meta.pop("source_size")}, "config": settings, "pipeline_meta": meta,
                    "slices": [{"index": int(r.index_), "skipped": bool(r.skipped), "dhash": r.dhash} | ({"duplicate_of_index": int(r.duplicate_of_index)} if r.skipped else {"file": r.file}) for r in rows],
                    "saved_files": [{"file": r.file, "sha256": r.sha256, "batch": None if pd.isna(r.batch) else int(r.batch)} for r in kept],
                    "extra": {"slices_total": len(rows), "slices_kept": len(kept)}}
                put(out, f"{key}/manifest.json", json.dumps(whole, ensure_ascii=False, indent=2).encode())
            if cfg.batch_size > 0 and cfg.make_prompt:
                for b in sorted({int(r.batch) for r in kept}):
                    put(out, f"{key}/batch_{b:03d}/PROMPT.txt", prompt([r.file for r in kept if int(r.batch) == b], cfg.prompt_lang).encode())
            return pd.DataFrame([(rows[0].path, len(kept))], columns=["path", "n_files"]).astype({"path": object})

        for batch in batches:
            for r in batch.rename(columns={"index": "index_"}).itertuples(index=False):
                if r.image_key != key and rows:
                    yield finish()
                    rows = []
                key = r.image_key
                rows.append(r)
        if rows:
            yield finish()

    return bare.mapInPandas(manifests, "path string, n_files long")
