import json

import numpy as np
import pytest

from framewright.sources import config, frames, logs, sinks


def test_png_codec(spark, tmp_path):
    r = np.random.default_rng(1)
    grey, rgb = r.integers(0, 256, (5, 7)).astype(np.uint8), r.integers(0, 256, (4, 6, 3)).astype(np.uint8)
    assert (frames.decode_png(frames.encode_png(grey))[:, :, 0] == grey).all() and (frames.decode_png(frames.encode_png(rgb)) == rgb).all()
    (tmp_path / "a.png").write_bytes(frames.encode_png(rgb))
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("no frame")
    got = {r.path.rsplit("/", 1)[1]: r for r in frames.read_png_frames(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.png"} and (got["a.png"].h, got["a.png"].w, got["a.png"].channels) == (4, 6, 3)
    assert bytes(got["a.png"].pixels) == rgb.tobytes() and got["b.png"].h is None


def test_png_row_filters():
    import struct
    import zlib

    want = np.array([[10, 20, 30], [12, 25, 29], [90, 80, 70], [5, 6, 7], [200, 100, 50]], np.uint8)
    rows = []
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line = [kind]
        for x in range(3):
            a, b, c = int(want[y, x - 1]) if x else 0, int(want[y - 1, x]) if y else 0, int(want[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            line.append((int(want[y, x]) - [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v))][kind]) % 256)
        rows.append(bytes(line))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (frames.decode_png(data)[:, :, 0] == want).all()


def test_raw_video(spark, tmp_path):
    r = np.random.default_rng(2)
    luma = [r.integers(0, 256, (4, 6)).astype(np.uint8).tobytes() for _ in range(5)]
    path = tmp_path / "v.y4m"
    path.write_bytes(b"YUV4MPEG2 W6 H4 F30:1 C420jpeg\n" + b"".join(b"FRAME\n" + x + bytes(12) for x in luma))
    spark.dataSource.register(frames.RawVideo)
    got = spark.read.format("rawvideo").option("path", str(path)).option("framesPerPartition", "2").load()
    assert got.rdd.getNumPartitions() == 3
    assert [(r.frame, r.h, r.w, bytes(r.luma)) for r in got.orderBy("frame").collect()] == [(i, 4, 6, x) for i, x in enumerate(luma)]


def test_logs(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"frame": 1, "n": 2}\n{"frame": 1, "n"\n[1]\n\n{"frame": 1, "n": 3}\n{"frame": 2, "n": 1}\n')
    log = logs.read_log(spark, str(p), "frame int, n int")
    assert sorted(map(tuple, log.collect())) == [(1, 2), (1, 3), (2, 1)]
    assert sorted((r.frame, r.n) for r in logs.latest(log, ["frame"], "n").collect()) == [(1, 3), (2, 1)]
    logs.append_log(log, str(tmp_path / "out"))
    logs.append_log(log, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6


def test_prompts_and_lists(spark, tmp_path):
    doc = {"format": 1, "frames": [{"frame": 0, "targets": [{"id": 1, "points": [{"x": 1, "y": 2, "label": 1}]}, {"id": 2, "points": [{"x": 99, "y": 2, "label": 0}]}, {"id": 3, "points": [], "box": [5, 5, 2, 8]}, {"id": 1, "points": [{"x": 1, "y": 2, "label": 7}], "box": [1, 1, 2, 2]}]}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    p = logs.read_prompts(spark, str(tmp_path / "p.json"))
    assert sorted(map(tuple, logs.prompt_problems(p, 50, 40).collect())) == [(0, 1, "label"), (0, 1, "repeated"), (0, 2, "empty"), (0, 2, "outside"), (0, 3, "box")]
    (tmp_path / "bad.json").write_text('{"format": "x", "frames": 3}')
    with pytest.raises(Exception):
        logs.read_prompts(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "list.txt").write_text('# clips\n"my clip.mp4" --start 1.5 --end 3\n\nb.mov # later\n')
    assert sorted((r.path, r.start, r.end) for r in logs.read_list(spark, str(tmp_path / "list.txt")).collect()) == [("b.mov", None, None), ("my clip.mp4", 1.5, 3.0)]


def test_config():
    c = config.load('{"quality": {"iou_min": 0.4}}', {"temporal.cut_diff": 0.1})
    assert c.quality.iou_min == 0.4 and c.temporal.cut_diff == 0.1 and c.mode_k == 3
    for text in ('{"quality": {"iou_mim": 1}}', '{"mode_k": 4}', '{"mode_k": 3, "mode_k": 5}', '{"quality": {"area_min": 0.9}}', '{"mode_k": "3"}'):
        with pytest.raises(ValueError):
            config.load(text)
    assert "iou_min" in str(pytest.raises(ValueError, config.load, '{"quality": {"iou_mim": 1}}').value)
    assert config.params_hash(c) == config.params_hash(config.load('{"temporal": {"cut_diff": 0.1}, "quality": {"iou_min": 0.4}}')) != config.params_hash(config.load())


def test_promote_and_pngs(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.promote(spark.range(3), path)
    sinks.promote(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [x.name for x in tmp_path.iterdir()] == ["t"]
    cells = spark.createDataFrame([(0, 1, 2, 200), (0, 0, 0, 999)], "frame int, y int, x int, v int")
    (row,) = sinks.png_frames(cells, "v", 3, 4).collect()
    assert frames.decode_png(bytes(row.png))[:, :, 0].tolist() == [[255, 0, 0, 0], [0, 0, 200, 0], [0, 0, 0, 0]]
    (bits,) = sinks.pack_masks(cells, 3, 4).collect()
    assert np.unpackbits(np.frombuffer(bits.bits, np.uint8))[:12].tolist() == [1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0]


def test_parameters_of_operators():
    from framewright.plans.crop import Crop
    from framewright.plans.vectorize import Lines

    assert config.typed(Lines(), '{"without": [1, 3], "far": 5}') == Lines(without=(1, 3), far=5)
    assert config.typed(Crop(), overrides={"least_band": 4}).least_band == 4
    for bad in ('{"far": "5"}', '{"least_region": 1.5}', '{"without": 3}', '{"fat": 5}', '{"far": true}'):
        with pytest.raises(ValueError, match="fa[rt]|least_region|without"):
            config.typed(Lines(), bad)


def test_arrays(spark, tmp_path):
    from framewright.sources import arrays

    z = np.arange(6, dtype=np.float16).reshape(2, 3)
    np.save(tmp_path / "depth_00003.npy", z)
    np.save(tmp_path / "depth_00004.npy", z[:, :2])
    np.save(tmp_path / "depth_00005.npy", np.where(z == 1, np.nan, z).astype(np.float32))
    np.save(tmp_path / "depth_00006.npy", z.astype(int))
    np.save(tmp_path / "depth_00007.npy", np.array([{}]), allow_pickle=True)
    (tmp_path / "depth_00008.npy").write_bytes(b"x")
    (tmp_path / "depth_00009.npy").write_bytes(b"")  # no row
    (tmp_path / "other.npy").write_bytes(b"\x93NUMPY broken")
    found = arrays.read_arrays(spark, str(tmp_path), shape=(2, 3))
    got = {r.frame: r for r in found.collect()}
    assert {k: r.problem for k, r in got.items()} == {3: None, 4: "shape", 5: "not finite", 6: "kind", 7: "unreadable", 8: "unreadable", None: "unreadable"}
    assert np.frombuffer(bytes(got[3].data), "<f4").tolist() == list(range(6)) and got[5].data is None
    assert [(r.frame, r.y, r.x, r.d) for r in arrays.cells_of(found).orderBy("y", "x").collect()] == [(3, i // 3, i % 3, float(i)) for i in range(6)]
    probs = np.random.default_rng(1).integers(0, 255, (29, 2, 3)).astype(np.uint8)
    np.savez_compressed(tmp_path / "p_1.npz", probs=probs)
    np.savez_compressed(tmp_path / "p_2.npz", a=probs, b=probs)
    got = {r.frame: r for r in arrays.read_arrays(spark, str(tmp_path), "*.npz", "u", (29, 2, 3)).collect()}
    assert bytes(got[1].data) == probs.tobytes() and got[1].shape == [29, 2, 3] and got[2].problem == "member"
    sizes = {r.name: (r.files, r.bytes) for r in arrays.folder_size(spark, {"all": str(tmp_path), "npz": str(tmp_path)}, "*.npz").collect()}
    assert sizes["all"] == (2, sum((tmp_path / f"p_{i}.npz").stat().st_size for i in (1, 2)))


def test_labels(spark, tmp_path):
    from framewright.sources import arrays

    a = np.array([[0, 1], [2, 3]], np.uint8)
    for i, v in enumerate((a, a + 3, a[:1], np.stack([a] * 3, axis=2))):
        (tmp_path / f"g_{i}.png").write_bytes(frames.encode_png(v))
    (tmp_path / "g_4.png").write_bytes(b"x")
    got = {r.frame: r.problem for r in arrays.read_labels(spark, str(tmp_path), 3, (2, 2)).collect()}
    assert got == {0: None, 1: "label", 2: "shape", 3: "channels", 4: "unreadable"}


def test_stroke_documents(spark, tmp_path):
    import hashlib

    from framewright.sources import arrays

    before = None

    def put(name, **change):
        nonlocal before
        i = int(name)
        doc = {"frame_index": i, "width": 8, "height": 6, "source": {"vectorize_hash": "h"}, "prev_sha256": before, "strokes": [{"track_id": 1, "type": "silhouette", "closed": True, "groups": ["background"], "points": [[0.5, 1.5]], "anchor": 0}]} | change
        data = json.dumps(doc).encode()
        (tmp_path / f"frame_{name}.json").write_bytes(data)
        before = hashlib.sha256(data).hexdigest()

    put("00005")
    put("00006")
    put("00007", width=9)
    put("00008", source={"vectorize_hash": "other"})
    put("00009", frame_index=1)
    put("00010", prev_sha256="x")
    put("00011")
    (tmp_path / "frame_00012.json").write_text("{")
    rows = {r.frame: r for r in arrays.read_strokes(spark, str(tmp_path), 8, 6, "h").collect()}
    assert {k: r.problem for k, r in rows.items()} == {5: None, 6: None, 7: "size", 8: "parameters", 9: "frame", 10: "chain", 11: None, 12: "unreadable"}
    assert rows[5].strokes[0].points == [[0.5, 1.5]]
