import json

import numpy as np
import pytest

from threadmill.images import kernels as k
from threadmill.images import png, slicer
from threadmill.operators import ranks


def page(h=3000, w=600, line=40, left=60, right=60, dark=False):
    """Gray bars like lines of text."""
    img = np.full((h, w, 3), 20 if dark else 255, np.uint8)
    rng = np.random.default_rng(0)
    for y in range(50, h - 40, line):
        img[y:y + line // 2, left:w - right - int(rng.integers(0, 40))] = 235 if dark else 40
    return img


@pytest.mark.parametrize("h,chunk,overlap,n", [(15, 100, 10, 1), (75000, 1000, 50, 79), (4500, 1000, 0, 5), (1500, 1000, 50, 2), (1000, 1000, 50, 1), (1001, 1000, 999, 2)])
def test_windows(spark, h, chunk, overlap, n):
    got = k.slices(h, chunk, overlap)
    assert len(got) == n and got[0][0] == 0 and got[-1][1] == h
    assert all(b - a == chunk for a, b in got[:-1]) and all(p[1] - q[0] == overlap for p, q in zip(got, got[1:], strict=False))
    df = ranks.windows(spark.createDataFrame([(h,)], "h long"), "h", chunk, overlap).orderBy("index")
    assert [(r.top, r.bottom) for r in df.collect()] == got


def test_bad_windows():
    for chunk, overlap in ((100, 100), (100, -1), (0, 0)):
        with pytest.raises(k.SliceError):
            k.slices(500, chunk, overlap)
    with pytest.raises(k.SliceError):
        k.margin_crop(np.zeros((10, 10, 3), np.uint8), left=600)


def test_resize():
    flat = np.full((37, 53, 3), 91, np.uint8)
    for kind in k.FILTERS:
        assert (k.resize(flat, 80, 20, kind) == 91).all() and k.resize(flat, 80, 20, kind).shape == (20, 80, 3)
    ramp = np.tile(np.arange(256, dtype=np.uint8), (4, 1))
    half = k.resize(ramp, 128, 4)
    assert abs(half[0, 64].astype(float) - 128.5) <= 1 and (np.diff(half[0].astype(int)) >= 0).all()


def test_otsu():
    g = np.array([[10] * 50 + [200] * 50], np.uint8)
    assert k.otsu_threshold(g) == 10
    assert set(np.unique(k.binarize(np.repeat(g[:, :, None], 3, axis=2))[0])) == {0, 255}
    assert k.otsu_threshold(np.full((5, 5), 7, np.uint8)) == 0


def test_dark_crop_lines():
    assert k.is_dark(page(dark=True)) and not k.is_dark(page())
    img, box, why = k.auto_crop(page(left=150, right=200))
    assert why is None and 120 <= box[0] <= 150 and 380 <= box[2] <= 430 and img.shape[1] == box[2] - box[0]
    assert k.auto_crop(np.zeros((100, 100, 3), np.uint8))[2] == "no_edge_energy"
    for dark in (False, True):
        assert abs(k.line_height(page(line=40, dark=dark)) - 40) <= 3
    assert k.line_height(np.full((500, 500, 3), 255, np.uint8)) is None
    assert k.chunk_height(40, 38, 1000, 2200, 1600) == 1520 and k.chunk_height(None, 38, 1000, 2200, 1600) == 1600 and k.chunk_height(100, 38, 1000, 2200, 1600) == 2200


@pytest.mark.parametrize("angle", [-1.5, -0.5, 1.25])
def test_deskew(angle):
    skewed = k.rotate(page(1500, 600), angle)
    assert abs(k.skew_angle(skewed) + angle) <= 0.26
    assert abs(k.skew_angle_two_stage(skewed) + angle) <= 0.15
    back = k.rotate(skewed, k.skew_angle(skewed))
    inner = (slice(100, -100), slice(100, -100))
    assert np.abs(back[inner].astype(int) - page(1500, 600)[inner]).mean() < np.abs(skewed[inner].astype(int) - page(1500, 600)[inner]).mean() / 2


def test_enhance():
    img = page()
    assert k.enhance(img)[0] is img
    out, dark, applied = k.enhance(img, auto=True, denoise=True, manual=1.2)
    assert applied and dark is False and out.std() >= img.std() - 1
    noise = np.full((20, 20), 100, np.uint8)
    noise[5, 5] = 255
    assert (k.median3(noise) == 100).all()


def test_hashes():
    assert [k.hamming64(*x) for x in ((0b1111, 0), (0b1010, 0b1010), (0xFFFF, 0), (-1, 0))] == [4, 0, 16, 64]
    ramp = np.tile(np.linspace(255, 0, 90).astype(np.uint8), (80, 1))
    assert k.dhash(ramp) == -1 and k.dhash(ramp[:, ::-1]) == 0
    assert k.mean_abs_diff(b"\x00\x05", b"\x01\x03") == 1.5 and k.mean_abs_diff(b"", b"") == k.mean_abs_diff(b"a", b"ab") == 1e9


def test_png():
    for img in (page(50, 40), page(50, 40)[:, :, 0]):
        assert (png.decode(png.encode(img, dpi=300)) == img).all()


def test_dedupe_compares_with_the_last_kept():
    top = page(1000, 300)
    img = np.concatenate([top, top, top, page(1000, 300, line=70, dark=True), top])
    cfg = slicer.SliceConfig(chunk_h=1000, overlap=0, upscale=1.0, dedupe=True, batch_size=2)
    rows = slicer.slice_image("/a/x.png", img, cfg)
    assert [r["duplicate_of_index"] for r in rows] == [None, 1, 2, None, None]
    assert [r.get("file") for r in rows] == ["x_001.png", None, None, "x_004.png", "x_005.png"] and [r.get("batch") for r in rows] == [1, None, None, 1, 2]


def test_pipeline(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for folder in ("a", "b"):
        (src / folder).mkdir(parents=True)
        (src / folder / "chat.png").write_bytes(png.encode(page(2500, 400)))
    (src / "a" / "broken.png").write_bytes(b"no image")
    cfg = slicer.SliceConfig(chunk_h=1000, overlap=50, upscale=1.5, auto_crop=True, auto_contrast=True, deskew=True, deskew_fast=True, binarize=True, dedupe=True, batch_size=3, output_dpi=300)
    slices = slicer.slice_images(slicer.read_images(spark, str(src), recursive=True), cfg).cache()
    assert slicer.totals(slices).first().asDict() | {"kept": 0, "skipped": 0} == {"ok": 2, "failed": 1, "kept": 0, "skipped": 0}
    done = slicer.write_slices(slices, str(out), cfg).collect()
    assert len(done) == 2 and len({p.name for p in out.iterdir()}) == 2
    for folder in out.iterdir():
        m = json.loads((folder / "manifest.json").read_text())
        assert len(m["slices"]) == 4 and m["source"]["size"] == {"w": 400, "h": 2500}
        for f in m["saved_files"]:
            img = png.decode((folder / f"batch_{f['batch']:03d}" / f["file"]).read_bytes())
            assert set(np.unique(img)) <= {0, 255}
        assert (folder / "batch_001" / "PROMPT.txt").exists() and not list(folder.rglob("*.part"))


def test_presets():
    assert slicer.PRESETS["quality"].deskew_fast and slicer.PRESETS["fast"].chunk_h == 1600
    with pytest.raises(k.SliceError):
        slicer.SliceConfig(out_format="jpg")


def test_jpeg(spark, tmp_path):
    from threadmill.images import jpeg

    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:123, 0:201]
    images = {"colours": np.stack([x % 256, y % 256, (x + y) % 256], -1).astype(np.uint8), "noise": rng.integers(0, 256, (64, 80, 3)).astype(np.uint8), "flat": np.full((17, 9, 3), 200, np.uint8),
              "gray": (x % 256).astype(np.uint8), "one": np.full((1, 1, 3), 7, np.uint8), "text": page(900, 300)}
    for name, img in images.items():
        for q in (10, 92, 100):
            (tmp_path / f"{name}_{q}.jpg").write_bytes(jpeg.encode(img, q, 150))
    back = {r.origin.rsplit("/", 1)[1][:-4]: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels) for r in spark.read.format("image").load(str(tmp_path)).select("image.*").collect()}
    assert len(back) == 3 * len(images)
    for name, img in images.items():
        off = {q: np.abs((back[f"{name}_{q}"][:, :, 0] if img.ndim == 2 else back[f"{name}_{q}"][:, :, ::-1]).astype(int) - img).mean() for q in (10, 92, 100)}
        assert off[100] < 0.6 and off[92] < 6 and off[100] <= off[92] + 0.5 <= off[10] + 1
    for q in (0, 101):
        with pytest.raises(ValueError):
            jpeg.encode(images["flat"], q)
    with pytest.raises(k.SliceError):
        slicer.SliceConfig(out_format="webp")


def test_huffman_lengths():
    from threadmill.images import jpeg

    for counts in ({5: 3}, {i: 1 for i in range(162)}, {i: int(1.6**i) + 1 for i in range(60)}):
        lengths = jpeg.code_lengths(counts)
        assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1  # a code is left: the one of all ones
        codes = sorted(f"{c:0{lengths[s]}b}" for s, c in jpeg._codes(lengths).items())
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:], strict=False))


def test_slices_as_jpg_and_selftest(spark, tmp_path, capsys):
    from threadmill import cli

    rows = slicer.slice_image("/a/b.png", page(2000, 300), slicer.SliceConfig(upscale=1.0, out_format="jpeg", jpg_quality=80))
    assert [r["file"] for r in rows] == ["b_001.jpg", "b_002.jpg"] and all(r["content"][:3] == b"\xff\xd8\xff" for r in rows)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/p.png").write_bytes(png.encode(page(2000, 300)))
    assert cli.main(["slice", "--input", str(tmp_path / "in"), "--out", str(tmp_path / "jpg"), "--out-format", "jpg", "--jpg-quality", "70", "--upscale", "1"]) == 0
    assert len(list(tmp_path.glob("jpg/*/p_00?.jpg"))) == 2
    assert cli.main(["slice", "--out", str(tmp_path), "--selftest"]) == 0
    assert "all is well" in capsys.readouterr().out and list(tmp_path.glob("_selftest/full/*/batch_001/PROMPT.txt"))
