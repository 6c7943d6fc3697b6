import json
import os
import struct
import zlib
from datetime import datetime, timedelta

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from veridect.operators import calibration as C
from veridect.operators import documents, ml
from veridect.operators.fusion import MODALITY_WEIGHTS
from veridect.session import shared_dir
from veridect.plans.catalog import ORACLES, QUERIES
from veridect.operators.scoring import LinearScorer, score_batches
from veridect.sinks import committed, writers
from veridect.sources import csv_files, images, listing, manifests, tables
from veridect.streaming import fusion, jobs
from veridect.streaming import progress as P


def touch(root, *names, data=b"x"):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as handle:
            handle.write(data)


def names(df, column="path"):
    return sorted(os.path.basename(r[0]) for r in df.select(column).collect())


def test_image_manifest_from_directory(spark, tmp_path):
    touch(tmp_path, "REAL/a.JPG", "REAL/sub/b.jpeg", "my_fakes/c.Png", "my_fakes/d.txt", "other/e.png", "top.PNG", "f.jPg")
    found = manifests.list_files(spark, str(tmp_path))
    assert names(manifests.image_manifest(found)) == ["a.JPG", "b.jpeg", "c.Png", "e.png", "f.jPg", "top.PNG"]
    root = "file:" + str(tmp_path)
    assert names(manifests.flat_image_manifest(found, root)) == ["f.jPg", "top.PNG"]
    assert names(manifests.flat_image_manifest(found, root, uniform_case=True)) == ["top.PNG"]
    labelled = manifests.label_from_dir(found, root)
    got = {os.path.basename(r.path): r.label for r in labelled.collect()}
    assert got == {"a.JPG": "real", "b.jpeg": "real", "c.Png": "fake", "d.txt": "fake", "e.png": None, "top.PNG": None, "f.jPg": None}
    both = {os.path.basename(r.path): (r.label, r.strict_label) for r in manifests.labels_from_dir(found, root).collect()}
    strict = {os.path.basename(r.path): r.label for r in manifests.label_from_dir(found, root, strict=True).collect()}
    assert both == {name: (got[name], strict[name]) for name in got}
    assert strict["a.JPG"] == "real" and strict["c.Png"] is None
    with pytest.raises(Exception, match="no label directory"):
        manifests.require_labels(labelled).collect()


def test_exact_label_directory_wins(spark, tmp_path):
    touch(tmp_path, "fake/x.png", "a_fake_one/y.png", "real/z.png")
    found = manifests.list_files(spark, str(tmp_path))
    got = {os.path.basename(r.path): r.label for r in manifests.label_from_dir(found, "file:" + str(tmp_path)).collect()}
    assert got == {"x.png": "fake", "y.png": None, "z.png": "real"}


def test_audio_manifests(spark, tmp_path):
    base = "named/for-2sec/for-2seconds"
    touch(tmp_path, f"{base}/training/real/a.wav", f"{base}/testing/fake/b.mp3", f"{base}/training/real/deep/c.wav",
          f"{base}/training/real/d.WAV", "short/dev/fake/e.flac", "short/extra/fake/f.wav", "short/train/other/g.wav")
    root = "file:" + str(tmp_path)
    found = manifests.list_files(spark, str(tmp_path))
    got = {(os.path.basename(r.file_path), r.label, r.split, r.source) for r in manifests.audio_manifest(found, f"{root}/named", f"{root}/short").collect()}
    assert got == {("a.wav", "real", "training", "FakeOrReal"), ("b.mp3", "fake", "testing", "FakeOrReal"), ("e.flac", "fake", "validation", "SceneFake")}
    assert len(names(manifests.audio_discovery(found))) == 6
    with pytest.raises(manifests.EmptyManifest):
        manifests.require_rows(manifests.audio_manifest(found, "/none", "/none"), "audio")


def png(width, height, kind):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IEND", b"")


def test_image_headers(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"J" * 14 + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 33, 44, 3) + b"\0" * 20
    touch(tmp_path, "a.png", data=png(7, 9, 6))
    touch(tmp_path, "b.jpg", data=jpeg)
    touch(tmp_path, "c.jpg", data=b"junk")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    meta = images.image_metadata(files)
    got = {os.path.basename(r.path): (r.format, r.mode, r.width, r.height, r.valid) for r in meta.collect()}
    assert got == {"a.png": ("PNG", "RGBA", 7, 9, True), "b.jpg": ("JPEG", "RGB", 44, 33, True), "c.jpg": (None, None, None, None, False)}
    assert tuple(images.invalid_count(meta).first()) == (3, 1)


def test_tree_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Any depth, odd names, empty folders and names that Spark skips; links to folders are left alone."""
    every = ["a.jpg", "d/b c%20ü.png", "d/e/f/g/_hidden.jpg", "d/e/.dot", "d/e/x#y?z.txt", "k=v/part"]
    touch(tmp_path, *every, data=b"12345")
    os.makedirs(tmp_path / "empty" / "inside")
    os.symlink(tmp_path, tmp_path / "d" / "loop")
    monkeypatch.setattr(listing, "BATCH_ENTRIES", 2)
    for root in (str(tmp_path), f"file:{tmp_path}/"):
        got = {(r.path, r.length) for r in listing.list_tree(spark, root).collect()}
        assert got == {(f"{root.rstrip('/')}/{name}", 5) for name in every}
    assert listing.list_tree(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(Exception, match="absent"):
        listing.list_tree(spark, str(tmp_path / "absent")).collect()


def test_headers_by_ranges(spark, tmp_path):
    """A JPEG whose header stands behind a megabyte of other segments costs a few bytes a segment."""
    segment = b"\xff\xe1\xff\xff" + b"\x00" * 65533
    frame = b"\xff\xc2\x00\x0b\x08\x00\x07\x00\x09\x01\x01\x11\x00"
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\x0dIHDR" + struct.pack(">IIBB", 5, 6, 16, 0) + b"\x00" * 500_000
    files = {
        "deep.jpg": b"\xff\xd8" + segment * 16 + b"\xff\xff\xd0" + frame + b"\xff\xd9",
        "p.png": png,
        "short.png": png[:20],
        "cut.jpg": b"\xff\xd8" + segment[:100],
        "text.jpg": b"hello",
        "none": b"",
    }
    for name, data in files.items():
        touch(tmp_path, name, data=data)
    rows = images.read_headers(listing.list_tree(spark, str(tmp_path)), str(tmp_path)).collect()
    got = {os.path.basename(r.path): (r.format, r.mode, r.width, r.height, r.valid) for r in rows}
    assert got == {
        "deep.jpg": ("JPEG", "L", 9, 7, True),
        "p.png": ("PNG", "I;16", 5, 6, True),
        **{n: (None, None, None, None, False) for n in ("short.png", "cut.jpg", "text.jpg", "none")},
    }
    assert max(r.bytes_read for r in rows) <= 26 + 20 * 10
    gone = spark.createDataFrame([(str(tmp_path / "gone"),)], "path string")
    assert images.read_headers(gone, str(tmp_path)).first().valid is False


def test_predictions_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("file,true_label,fake_prob,pred_label,correct\na,fake,0.9,FAKE,True\nb,Real,oops,REAL,true\nc,real,,REAL,1\nd,REAL,0.2,REAL,false\ne,REAL,nan,REAL,x\nf,fake,1e-1,REAL,0\n")
    got = {r.file: (r.true_label, r.fake_prob, r.correct) for r in tables.read_predictions(spark, str(path)).collect()}
    assert got == {"a": ("FAKE", 0.9, True), "d": ("REAL", 0.2, False), "f": ("FAKE", 0.1, False)}


def test_predictions_by_name(spark, tmp_path):
    """Six columns, five in another order and a bare minimum in one folder; records that do not fit are reported."""
    header = "file,true_label,fake_prob,real_prob,pred_label,correct"
    (tmp_path / "a.csv").write_text(f'\ufeff{header}\r\n"x,""1"".jpg",fake,0.9,0.1,FAKE,True\r\nb,real,0.7,0.3,FAKE,False\r\n\r\n')
    (tmp_path / "b.csv").write_text("correct,pred_label,file,extra,fake_prob,true_label\nFalse,REAL,c,1,0.2,fake\nTrue,REAL,d,0.2,real\n")
    (tmp_path / "c.csv").write_text("true_label,correct,fake_prob\nreal,True,0.1,9\nreal,True,0.4\n")
    (tmp_path / "d.csv").write_text("label,prob\nreal,0.1\n")
    (tmp_path / "e.csv").write_text(f'{header}\ne,real,"0.1,0.9,REAL,True\n')
    (tmp_path / "f.csv").write_text("true_label,correct,fake_prob\nreal,True,0.1\nfake_prob,true_label,correct\n0.1,real,True\n")
    (tmp_path / "g.csv").write_text("")
    got = sorted(tuple(r) for r in tables.read_predictions(spark, str(tmp_path)).fillna("-").fillna(-1.0).collect())
    assert got == [
        ("-", "REAL", 0.4, -1.0, "-", True),
        ("b", "REAL", 0.7, 0.3, "FAKE", False),
        ("c", "FAKE", 0.2, -1.0, "REAL", False),
        ('x,"1".jpg', "FAKE", 0.9, 0.1, "FAKE", True),
    ]
    bad = {(os.path.basename(r.file), r.record, r.reason) for r in tables.prediction_files(spark, str(tmp_path)).rejected.collect()}
    none = "no header with true_label, fake_prob, correct"
    assert bad == {
        ("b.csv", "True,REAL,d,0.2,real", "5 cells where the header has 6"),
        ("c.csv", "real,True,0.1,9", "4 cells where the header has 3"),
        ("d.csv", "label,prob", none),
        ("d.csv", "real,0.1", none),
        ("e.csv", 'e,real,"0.1,0.9,REAL,True', "open quote"),
        ("f.csv", "real,True,0.1", "two different headers"),
        ("f.csv", "0.1,real,True", "two different headers"),
    }


def test_written_predictions_read_back(spark, tmp_path):
    rows = spark.createDataFrame([('a "b", c.jpg', "FAKE", 0.5, "REAL", False, "s")], "file string, true_label string, fake_prob double, pred_label string, correct boolean, strategy string")
    writers.write_predictions(rows, str(tmp_path / "p"))
    assert [tuple(r) for r in tables.read_predictions(spark, committed.part_path(spark, str(tmp_path / "p"), "predictions")).collect()] == [('a "b", c.jpg', "FAKE", 0.5, None, "REAL", False)]


def test_plain_records_are_cut_once(spark, tmp_path):
    """Records without quotes are cut as the CSV parser cuts them; the parser stands in the plan once, for the others."""
    odd = ["a", " a , b", ",,", "a,b,", "\t,x", "\x00,b", "#a,b", "\\,b", "é,\u2028", "a;b,'c'", ",a", " ", "a\\,b"]
    df = spark.createDataFrame([(r,) for r in odd], "record string")
    plain = F.transform(F.split("record", ","), lambda c: F.nullif(c, F.lit("")))
    for record, parsed, cut in df.select("record", csv_files._wide(F.col("record"), 4), plain).collect():
        assert (cut + [None] * 4)[:4] == parsed, record
    (tmp_path / "a.csv").write_text("true_label,correct,fake_prob\nreal,True,0.1\nfake,True,n/a\n")
    rows = tables.read_predictions(spark, str(tmp_path))
    assert [tuple(r)[1:3] for r in rows.collect()] == [("REAL", 0.1)]
    assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("from_csv(") == 1


def test_predictions_are_written_where_they_are(spark, tmp_path):
    """Every task writes its own rows: no shuffle brings them together, also with more strategies than open folders."""
    for kinds in (2, writers.OPEN_FOLDERS + 8):
        rows = spark.range(0, 800, 1, 4).select(F.col("id").cast("string").alias("file"), (F.col("id") % kinds).cast("string").alias("strategy"))
        writers.write_predictions(rows, str(tmp_path / str(kinds)))
        root = committed.part_path(spark, str(tmp_path / str(kinds)), "predictions")
        found = spark.read.schema("file string, strategy string").option("header", True).csv(root).withColumn("part", F.input_file_name()).collect()
        assert sorted(int(r.file) for r in found) == list(range(800))
        assert all(int(r.file) % kinds == int(r.strategy) for r in found)
        tasks = {}
        for r in found:
            tasks.setdefault(r.part, set()).add(int(r.file) // 200)
        assert len(tasks) == 4 * kinds and all(len(t) == 1 for t in tasks.values())
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_a_job_that_fails_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "run")
    schema = "filepath string, target int, source_platform string, split string"
    good = spark.createDataFrame([("a", 1, "s", "train"), ("b", 0, "s", "test")], schema)
    assert committed.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        committed.read_part(spark, root, "summary")
    writers.write_run_snapshot(good, root, "split", "target", "source_platform")
    before = sorted(map(str, committed.read_part(spark, root, "summary").collect()))
    broken = good.withColumn("target", F.when(F.col("split") == "test", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("target")))
    with pytest.raises(Exception, match="lost"):
        writers.write_run_snapshot(broken, root, "split", "target", "source_platform")
    assert committed.current(spark, root)["number"] == 1

    def half_way(folder):
        raise RuntimeError("the driver dies between the tables")

    with pytest.raises(RuntimeError):
        committed.commit(spark, root, {"frames": lambda folder: good.limit(1).write.parquet(folder), "summary": half_way})
    assert sorted(map(str, committed.read_part(spark, root, "summary").collect())) == before
    assert committed.read_part(spark, root, "frames").count() == 2
    writers.write_run_snapshot(good.filter("target = 1"), root, "split", "target", "source_platform")
    assert committed.current(spark, root)["number"] == 2 and committed.read_part(spark, root, "frames").count() == 1


def test_failed_rows_are_written_in_the_same_pass(spark, tmp_path):
    """The model sees every good row once, whatever is written and counted."""
    calls = str(tmp_path / "calls")

    class Counting(LinearScorer):
        def score(self, model, rows):
            with open(calls, "a") as out:
                out.write(f"{len(rows)}\n")
            return super().score(model, rows)

    df = spark.createDataFrame([(i, None if i % 5 == 0 else [float(i), 1.0]) for i in range(50)], "id int, features array<double>").repartition(2)
    scored = score_batches(df, Counting([0.1, 0.2]))
    assert writers.write_scored(scored, str(tmp_path / "out")) == {"good": 40, "failed": 10}
    with open(calls) as lines:
        assert sum(map(int, lines)) == 40
    good, failed = writers.read_scored(spark, str(tmp_path / "out"), scored.schema)
    assert good.columns == ["id", "features", "p"] and {r.id for r in good.collect()} == {i for i in range(50) if i % 5}
    assert {r.error for r in failed.collect()} == {"ValueError: NULL in features"} and failed.count() == 10


def test_splits_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("target,note,filepath\n1,n,x\noops,n,y\n,n,z\n0,n\n")
    files = tables.split_files(spark, {"train": str(tmp_path / "a.csv")})["train"]
    assert {tuple(r) for r in files.rows.collect()} == {("x", 1, None, None), ("z", None, None, None)}
    assert {(r.record, r.reason) for r in files.rejected.collect()} == {("oops,n,y", "target is no int: oops"), ("0,n", "2 cells where the header has 3")}


def test_result_shapes(rows):
    data = [
        '{"prediction": "fake", "label": "x", "prob_fake": 0.5}', '{"label": "real", "fake_probability": 0.25, "score": 1}',
        '{"score": "high"}', '{"score": 3}', "{}", '{"prob_fake": null, "score": 0.7}',
        '{"prob_fake":0.5,"score":"high"}', '{"label":"fake","fake_probability":0.25,"score":"high"}', '{"prob_fake": "0.5"}', '{"prob_fake": 1e-2}', "no json",
    ]
    df = rows([(i, d) for i, d in enumerate(data)], "i int, r string")
    got = [(r.prediction, r.prob_fake) for r in tables.coalesce_results(df, "r").orderBy("i").collect()]
    assert got == [("fake", 0.5), ("real", 0.25), ("UNKNOWN", None), ("UNKNOWN", 3.0), ("UNKNOWN", None), ("UNKNOWN", None)] + [
        ("UNKNOWN", 0.5), ("fake", 0.25), ("UNKNOWN", None), ("UNKNOWN", 0.01), ("UNKNOWN", None)
    ]


def test_eval_shards_and_snapshots(spark, tmp_path):
    shards = spark.createDataFrame([(bytearray(b"a"), 1, "m", 5)], "image_data binary, label int, model_name string, extra int")
    shards.write.parquet(str(tmp_path / "s" / "snapshot=a1" / "data"))
    shards.withColumn("label", F.lit(0)).write.parquet(str(tmp_path / "s" / "snapshot=b2" / "data"))
    read = tables.read_eval_shards(spark, str(tmp_path / "s" / "snapshot=a1" / "data"))
    assert read.columns == ["image_data", "label", "model_name"] and read.count() == 1
    shards.limit(0).write.parquet(str(tmp_path / "empty"))
    with pytest.raises(manifests.EmptyManifest):
        tables.read_eval_shards(spark, str(tmp_path / "empty"))
    spark.range(3).write.parquet(str(tmp_path / "t" / "snapshot=2024-01"))
    spark.range(5).write.parquet(str(tmp_path / "t" / "snapshot=2024-02"))
    for name, n in {"001": 1, "002": 2}.items():
        spark.range(n).write.parquet(str(tmp_path / "d" / f"snapshot={name}"))
        spark.range(n).write.parquet(str(tmp_path / "e" / f"snapshot={'12e5' if n == 1 else '34e7'}"))
    assert sorted(tuple(r) for r in tables.read_latest_snapshot(spark, str(tmp_path / "d")).collect()) == [(0, "002"), (1, "002")]
    assert tables.read_latest_snapshot(spark, str(tmp_path / "e")).filter("snapshot = '34e7'").count() == 2
    latest = tables.read_latest_snapshot(spark, str(tmp_path / "t"))
    assert latest.count() == 5


def test_split_files_and_config(spark, tmp_path):
    (tmp_path / "a.csv").write_text("filepath,target,skip_time,source_platform\nx,1,,suno\ny,0,1.5,youtube\n")
    (tmp_path / "b.csv").write_text("filepath,target,skip_time,source_platform\nz,1,2,udio\n")
    got = tables.read_split_files(spark, {"train": str(tmp_path / "a.csv"), "test": str(tmp_path / "b.csv")})
    assert {(r.filepath, r.target, r.skip_time, r.split) for r in got.collect()} == {("x", 1, None, "train"), ("y", 0, 1.5, "train"), ("z", 1, 2.0, "test")}
    (tmp_path / "c.json").write_text('{"temperature": 2.1}')
    assert tables.load_config(str(tmp_path / "c.json")) == {"temperature": 2.1}


def test_report_sinks(spark, tmp_path):
    data = [(i, i % 3 == 0 and 1 or 0, (i % 7) - 3 + (i % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame([(i, y, float(z)) for i, y, z in data], "id int, y int, z double")
    report = C.calibration_report(df)
    counts = spark.range(1).selectExpr("200L as n_samples", "40L as n_val", "160L as n_test")
    writers.write_json(writers.report_frame(report, "repo", "dir", counts), str(tmp_path / "r"))
    writers.write_json(writers.decision_config_frame(spark, report, "repo"), str(tmp_path / "c"))

    def load(folder):
        return [json.loads(line) for f in sorted(os.listdir(folder)) if f.endswith(".json") for line in open(folder / f)]

    (full,), (config,) = load(tmp_path / "r"), load(tmp_path / "c")
    assert full["test_metrics_baseline_t05"]["threshold"] == 0.5 and full["n_test"] == 160
    assert config["temperature"] == full["temperature"] and config["fit_split"] == {"val_ratio": 0.2, "seed": 42}
    assert config["decision_type"] == "sigmoid(logit/temperature) >= threshold"


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


EVENTS = "event_id bigint, job_id bigint, ts timestamp, step string"


def write_files(spark, folder, batches, schema):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return jobs.read_parquet_stream(spark, str(folder), spark.createDataFrame([], schema).schema, files_per_trigger=1)


def bounded(spark, folder, batches, schema, **values):
    write_files(spark, folder, batches, schema)
    return jobs.BoundedInput(spark, str(folder), spark.createDataFrame([], schema).schema, **values)


def test_progress_stream_equals_batch(spark, tmp_path):
    batches = [
        [(1, 7, at(0), "download"), (2, 7, at(5), "frames_done"), (3, 8, at(1), "audio")],
        [(4, 7, at(9), "audio_error"), (5, 8, at(2), "audio_done"), (6, 8, at(2), "asr")],
        [(7, 7, at(3), "frames"), (8, 8, at(8), "complete"), (9, 8, at(9), "text_done")],
    ]
    stream = write_files(spark, tmp_path / "e", batches, EVENTS)
    got = jobs.run_update(P.progress_status(stream), ["job_id", "track"], "t").select("job_id", "track", "status")
    want = P.progress_status(spark.createDataFrame(sum(batches, []), EVENTS)).select("job_id", "track", "status")
    rows = {tuple(r) for r in got.collect()}
    assert rows == {tuple(r) for r in want.collect()}
    assert rows == {(7, "frame", "Done"), (7, "audio", "Error"), (8, "audio", "Done"), (8, "text", "Done")}


def test_job_runs(spark, tmp_path):
    batches = [
        [(1, 7, at(0), "frames"), (2, 7, at(200), "complete"), (3, 8, at(0), "frames"), (4, 8, at(499), "error")],
        [(5, 9, at(100), "frames"), (6, 9, at(399), "frames_done"), (7, 10, at(20_000), "frames")],
        [(8, 9, at(50), "frames"), (9, 10, at(40_000), "frames")],
    ]
    want = {
        (7, at(0), at(200), 2, "finished"), (8, at(0), at(0), 1, "timed_out"), (8, at(499), at(499), 1, "finished"),
        (9, at(50), at(399), 3, "timed_out"), (10, at(20_000), at(20_000), 1, "timed_out"), (10, at(40_000), at(40_000), 1, "timed_out"),
    }
    batch = P.job_sessions(spark.createDataFrame(sum(batches, []), EVENTS))
    assert {(r.job_id, r.started, r.last_event, r.events, r.outcome) for r in batch.collect()} == want
    source = bounded(spark, tmp_path / "e", batches, EVENTS)
    out, run = jobs.run_append(P.job_sessions_stream(source.frame, delay="12 hours"), "t", source)
    assert {(r.job_id, r.started, r.last_event, r.events, r.outcome) for r in out.collect()} == want
    assert run.dropped_late == 0


STREAMS = ["str_progress_fold", "str_job_terminal_stream", "str_score", "str_fuse"]


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_folders_and_end_completely(spark, tmp_path, name):
    """A table as three part files gives what the single file gives, and that is what the oracle gives."""
    for t in ("events", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert compare(spark, str(tmp_path), QUERIES[name], ORACLES[name], connect("/root/testdata/sf0.001")) is None


def test_open_times_do_not_follow_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert compare(spark, "/root/testdata/sf0.001", QUERIES["str_fuse_batch"], ORACLES["str_fuse_batch"]) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_fusing_stream(spark, tmp_path):
    schema = "video_id string, modality string, score double, ts timestamp"
    batches = [
        [("a", "image", 0.9, at(0)), ("a", "audio", 0.8, at(10)), ("b", "image", 0.2, at(5))],
        [("a", "text", 0.7, at(20)), ("a", "image", 0.1, at(15))],
        [("z", "image", 0.5, at(100_000))],
        [("z", "audio", 0.5, at(100_001))],
        [("b", "audio", 1.0, at(6)), ("z", "text", 0.5, at(100_002))],
    ]
    stream = write_files(spark, tmp_path / "r", batches, schema)
    out, run = jobs.run_append(fusion.fuse_results(stream, delay="10 minutes"), "t")
    got = {r.video_id: (r.reason, r.image, r.audio, r.text, r.fused_score) for r in out.collect()}
    assert got["a"] == ("complete", 0.1, 0.8, 0.7, 0.43)
    assert got["b"] == ("timeout", 0.2, None, None, 0.2)
    assert run.dropped_late == 1  # the late audio result of b
    batch = fusion.fuse_results(spark.createDataFrame(batches[0] + batches[1], schema))
    assert {r.video_id: r.fused_score for r in batch.collect()} == {"a": 0.43, "b": 0.2}
    assert set(fusion.MODALITIES) == set(MODALITY_WEIGHTS)


def test_verdicts_leave_early_and_with_errors(spark, tmp_path):
    """Complete videos leave in the micro-batch that completes them, the others wait for the watermark."""
    schema = "video_id string, modality string, score double, error string, ts timestamp"
    batches = [
        [("a", "image", 0.9, None, at(0)), ("b", "image", 0.6, None, at(1)), ("c", "audio", 0.4, None, at(2)), ("e", "text", None, "broken", at(2))],
        [("a", "audio", 0.8, None, at(5)), ("a", "text", None, "no words", at(6)), ("b", "audio", None, "no track", at(4)), ("a", "image", 0.1, None, at(7))],
        [("a", "image", 0.2, None, at(8)), ("c", "image", None, None, at(9)), ("d", "smell", 1.0, None, at(9)), ("e", "audio", None, None, at(9))],
    ]
    stream = write_files(spark, tmp_path / "early", batches, schema)
    seen = []

    def note(batch, number):
        seen.extend((number, r.video_id, r.reason) for r in batch.collect())

    fused = fusion.fuse_results(stream, delay="10 minutes")
    run = fused.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted(seen) == [(1, "a", "complete"), (1, "b", "complete")]

    source = bounded(spark, tmp_path / "all", batches, schema, modality="image")
    out, _ = jobs.run_append(fusion.fuse_results(source.frame, delay="10 minutes"), "t", source)
    batch = fusion.fuse_results(spark.createDataFrame(sum(batches, []), schema))
    columns = ["video_id", "reason", "results", "image", "audio", "text", "image_error", "audio_error", "text_error", "final_label", "fused_score"]
    want = {
        ("a", "complete", 3, 0.9, 0.8, None, None, None, "no words", "FAKE / AI-GENERATED", 0.8625),
        ("b", "complete", 2, 0.6, None, None, None, "no track", "Audio extraction failed", "FAKE / AI-GENERATED", 0.6),
        ("c", "timeout", 2, None, 0.4, None, "No frames extracted", None, "No result in time", "REAL / HUMAN", 0.4),
        ("e", "timeout", 2, None, None, None, "No result in time", "Audio extraction failed", "broken", "UNKNOWN", None),
    }
    assert {tuple(r) for r in out.select(*columns).collect() if r.video_id is not None} == want
    assert {tuple(r) for r in batch.select(*columns).collect()} == want


def test_scoring_stream_equals_batch(spark, tmp_path):
    schema = "doc_id int, text string"
    batches = [[(1, "I like my cat."), (2, "A robust framework.")], [(3, "Plain words, plain text: all (of) it.")]]
    stream = write_files(spark, tmp_path / "d", batches, schema)
    out, _ = jobs.run_append(jobs.score_stream(stream, documents.score_documents).select("doc_id", "ai_score"), "t")
    want = documents.score_documents(spark.createDataFrame(sum(batches, []), schema)).select("doc_id", "ai_score")
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}


def test_training_and_search(spark):
    data = [(i, int(i % 2), [float(i % 2) + (i * 7 % 11) / 20.0, (i * 13 % 17) / 17.0], "validation" if i % 5 == 0 else "training") for i in range(200)]
    df = spark.createDataFrame(data, "id int, y int, v array<double>, split string")
    trials, model = ml.trial_search(df, {"v": ["v"]}, regs=(1e-3, 1e-1), elastic_nets=(0.0,))
    assert len(trials) == 2 and trials[0]["auc"] >= trials[1]["auc"] > 0.9
    scored = ml.predict(model, ml.assemble(df, ["v"]))
    assert scored.filter("(p > 0.5) = (y = 1)").count() > 180


def test_shared_dir_is_used(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
