import hashlib
import json

import builders
import pytest
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.operators import records
from faultline.plans import evalset
from faultline.sources import readers, writers


def test_manifest_round_trip_keeps_nulls(spark, tmp_path):
    rows = [{"image_id": "a", "labels": {"damage_present": False, "area_fracs": {"Crack": 0.5}}}, {"image_id": "b", "captured_on": None}]
    images = builders.images(spark, rows)
    writers.write_manifest(images, str(tmp_path / "m"))
    line = next(json.loads(x) for p in (tmp_path / "m").glob("part*") for x in p.read_text().splitlines() if '"b"' in x)
    assert line["captured_on"] is None and "gsd_mm_per_px" in line
    back = readers.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(back.collect(), key=lambda r: r.image_id) == sorted(images.collect(), key=lambda r: r.image_id)


def test_first_rows_in_manifest_order(spark, tmp_path):
    for name, ids in {"a": "pqr", "b": "stu"}.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"image_id": i}) + "\n" for i in ids))
    images = readers.read_manifest(spark, str(tmp_path), position=True)
    assert [r.image_id for r in records.of_dataset(images, None, 4).collect()] == ["p", "q", "r", "s"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in readers.list_files(spark, str(tmp_path)).collect()) == ["a.jsonl", "b.jsonl"]


def test_blank_lines_are_skipped_and_bad_rows_stop_the_read(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"image_id": "a", "width": 5}\n\n{"image_id": "b", "client_id": null}\n')
    assert readers.read_manifest(spark, str(tmp_path / "m.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"image_id": "a", "width": "wide"}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|malformed"):
        readers.read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()


def test_folder_scan_with_sidecar(spark, tmp_path, png):
    folder = tmp_path / "images"
    (folder / "sub dir").mkdir(parents=True)
    files = {"b.PNG": (40, 30), "a.png": (24, 40), "sub dir/c+d.png": (7, 9)}
    for name, size in files.items():
        (folder / name).write_bytes(png(*size))
    (folder / "notes.txt").write_text("x")
    sidecar = tmp_path / "side.json"
    sidecar.write_text(json.dumps({
        "a.png": {"asset_class": "pv_module", "captured_on": None, "irradiance_wm2": 700.5, "labels": {"damage_present": True, "grade_native": "CoA 2"}},
        "b.PNG": {"image_id": "special"},
    }, indent=1))
    got = readers.scan_folder(spark, str(folder), "steel_coating", sidecar=str(sidecar), source_dataset="d", split="upload", prefix="x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in got.collect()}
    assert {n: (r.width, r.height) for n, r in rows.items()} == {"b.PNG": (40, 30), "a.png": (24, 40), "c+d.png": (7, 9)}
    assert {n: r.image_id for n, r in rows.items()} == {"a.png": "x_00000", "b.PNG": "special", "c+d.png": "x_00002"}
    assert rows["a.png"].sha256 == hashlib.sha256(png(24, 40)).hexdigest()
    assert (rows["a.png"].asset_class, rows["a.png"].irradiance_wm2, rows["a.png"].labels.grade_native) == ("pv_module", 700.5, "CoA 2")
    assert (rows["c+d.png"].asset_class, rows["c+d.png"].split, rows["c+d.png"].labels.grade_native) == ("steel_coating", "upload", None)
    assert set(got.columns) <= set(readers.schemas.struct(readers.schemas.IMAGES).fieldNames())


def test_sidecar_null_wins_over_the_record(spark):
    images = builders.images(spark, [{"image_id": n} for n in "abc"]).withColumn("file_name", F.concat("image_id", F.lit(".jpg")))
    side = spark.createDataFrame(
        [("a.jpg", {"captured_on": None}), ("b.jpg", {"captured_on": "2020-01-01"})], "file_name string, entry map<string,string>"
    )
    got = {r.image_id: r.captured_on for r in readers.merged_with_sidecar(images, side).collect()}
    assert got == {"a": None, "b": "2020-01-01", "c": "2026-09-01"}


def test_dataset_indexes(spark, tmp_path):
    (tmp_path / "i.csv").write_text("name,split,frac\nx,test,0.5\n")
    assert readers.read_csv_index(spark, str(tmp_path / "i.csv"), "name string, split string, frac double").first().frac == 0.5
    (tmp_path / "s.json").write_text(json.dumps({"split": {"a.jpg": "test", "b.jpg": "train", "c.jpg": "test"}, "label": {"a.jpg": "Intact", "b.jpg": "Intact"}}, indent=1))
    assert [tuple(r) for r in readers.read_scene_index(spark, str(tmp_path / "s.json")).collect()] == [("a.jpg", "Intact")]
    spark.range(5).select((F.col("id") * 2).alias("label"), F.lit("bytes").alias("image")).coalesce(1).write.parquet(str(tmp_path / "p"))
    labels = readers.read_label_column(spark, str(tmp_path / "p"))
    assert [(r.row, r.label) for r in labels.orderBy("row").collect()] == [(at, at * 2) for at in range(5)]
    assert "bytes" not in labels._jdf.queryExecution().executedPlan().toString()


def test_rubric_and_label_map_files(spark, tmp_path):
    rubric = {"standard": "T", "asset_label": "thing", "allowed_values": ["a", "b"], "rows": [
        {"value": "a", "criterion": "none", "unified": "S0", "action": "record", "defect": "crack"},
        {"value": "b", "criterion": "some", "unified": "S1", "action": "monitor", "pattern": "spot", "flag": "section_loss"}]}
    (tmp_path / "t.json").write_text(json.dumps(rubric, indent=1))
    rows = readers.read_rubrics(spark, str(tmp_path / "t.json")).orderBy("value").collect()
    assert [(r.rubric_file, r.subject, r.value, r.level, r.flag) for r in rows] == [("t.json", "crack", "a", "S0", None), ("t.json", "spot", "b", "S1", "section_loss")]
    (tmp_path / "m.json").write_text(json.dumps({"note": "n", "map": {"Cell": {"coa": "CoA 2", "s": "S3"}}}))
    assert readers.read_label_map(spark, str(tmp_path / "m.json")).first().attributes == {"coa": "CoA 2", "s": "S3"}


def test_text_functions(spark):
    rows = spark.createDataFrame(
        [("2026:09:01 10:00:00", "Crack=0.1;;Rust=0.2;Crack=0.3;", "Rust;Crack;;Rust", "/d/x.y.jpg"), ("soon", "", "", "plain")],
        "exif string, fracs string, names string, path string",
    )
    got = rows.select(
        text.capture_date(F.col("exif")).alias("d"), text.parse_fractions(F.col("fracs")).alias("f"),
        text.parse_names(F.col("names")).alias("n"), text.file_stem(F.col("path")).alias("s"), text.numbered_id("ir", F.lit(123456)).alias("i"),
    ).collect()
    assert tuple(got[0]) == ("2026-09-01", {"Crack": 0.3, "Rust": 0.2}, ["Crack", "Rust"], "x.y", "ir_123456")
    assert tuple(got[1])[:4] == (None, {}, [], "plain")


def test_digest_ignores_order_but_not_content_or_copies(spark):
    rows = builders.images(spark, [{"image_id": n} for n in "abcd"])
    digest = writers.freeze_digest(rows).first()
    assert writers.freeze_digest(rows.repartition(3).orderBy(F.col("image_id").desc())).first() == digest
    assert writers.freeze_digest(rows.withColumn("width", F.col("width") + 1)).first().digest != digest.digest
    assert writers.freeze_digest(rows.unionByName(rows)).first().digest != digest.digest


def test_evaluation_set_is_written_and_disjoint(spark, tmp_path):
    docs = spark.range(3000).withColumn("name", F.col("id").cast("string"))
    files = docs.select(F.concat("name", F.lit(".jpg")).alias("file_name"), F.concat(F.lit("/f/"), "name").alias("path"), F.sha2("name", 256).alias("sha256"), F.lit(5).alias("width"), F.lit(6).alias("height"))
    kinds = F.concat(F.when(F.col("id") % 2 == 0, "Crack;").otherwise(""), F.when(F.col("id") % 5 == 0, "Rust;").otherwise(""), F.when(F.col("id") % 3 == 0, "Bearing;").otherwise(""))
    index = docs.select("name", kinds.alias("labels"), F.lit("Crack=0.5;").alias("area_fracs"), F.concat("name", F.lit(".jpg")).alias("file_name"))
    concrete = evalset.concrete_set(index, files)
    scene = evalset.scene_set(
        docs.select(F.concat("name", F.lit(".jpg")).alias("file"), F.element_at(F.array(F.lit("Intact"), F.lit("Damaged"), F.lit("Collapsed")), (F.col("id") % 3 + 1).cast("int")).alias("class")), files
    )
    evalset.build_evaluation_set([concrete, scene], str(tmp_path / "eval"))
    evaluation, dev = (readers.read_manifest(spark, str(tmp_path / "eval" / n)) for n in ("eval_v1", "dev"))
    counts = {(r.source_dataset, r["count"]) for r in evaluation.groupBy("source_dataset").count().collect()}
    assert counts == {("dacl10k", 60), ("rescuenet", 40)} and dev.count() == 15 + 8
    assert evaluation.join(dev, "image_id").isEmpty()
    one = evaluation.filter("source_dataset = 'dacl10k' and labels.damage_present").first()
    assert one.labels.area_fracs == {"Crack": 0.5} and one.labels.grade_native is None and one.sha256
    assert len(spark.read.json(str(tmp_path / "eval" / "frozen")).first().digest) == 64
    evalset.write_demo_manifests(dev, dev.select("path").filter("path <> '/f/none'"), str(tmp_path / "demo"), n=3, mixed=2)
    assert readers.read_manifest(spark, str(tmp_path / "demo" / "by_dataset")).count() == 6
    assert readers.read_manifest(spark, str(tmp_path / "demo" / "mixed")).count() == 4


def test_sizes_of_encoded_jpegs(spark, tmp_path, png):
    jvm = spark._jvm
    for name, (width, height) in {"b.JPG": (20, 10), "c.jpeg": (8, 16)}.items():
        picture = jvm.java.awt.image.BufferedImage(width, height, 1)
        assert jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / name)))
    (tmp_path / "a.png").write_bytes(png(5, 6))
    got = readers.scan_folder(spark, str(tmp_path), "bridge_element").collect()
    assert [(r.image_id, r.width, r.height) for r in sorted(got, key=lambda r: r.path)] == [
        ("img_00000", 5, 6), ("img_00001", 20, 10), ("img_00002", 8, 16)
    ]


def test_jpeg_sizes_come_from_the_frame_header(spark, tmp_path):
    def segment(marker, data):
        return bytes([0xFF, marker]) + (len(data) + 2).to_bytes(2) + data

    frame = segment(0xC2, b"\x08" + (480).to_bytes(2) + (640).to_bytes(2) + b"\x03" + bytes(9))
    table = segment(0xC4, bytes(20))  # its marker lies among those of frames
    whole = b"\xff\xd8" + segment(0xE1, b"exif" + bytes(5000)) + table + b"\xff" + frame
    assert readers.jpeg_size(whole) == (640, 480)
    assert [readers.jpeg_size(d) for d in (b"", b"no image", whole[:100], b"\xff\xd8junk and more")] == [None] * 4
    (tmp_path / "a.JPeG").write_bytes(whole)
    (tmp_path / "b.jpg").write_bytes(b"broken")
    (tmp_path / "c.mp4").write_bytes(b"no image")
    got = readers.scan_folder(spark, str(tmp_path), "steel_coating").orderBy("path").collect()
    assert [(r.path[-6:], r.width, r.height) for r in got] == [("a.JPeG", 640, 480), ("/b.jpg", None, None)]


def test_a_folder_scan_reads_each_file_once(spark, tmp_path, png, monkeypatch):
    for n in range(40):
        (tmp_path / f"{n}.png").write_bytes(png(3 + n, 4))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted_hash(content):
        read.add(1)
        return hashlib.sha256(content).hexdigest()

    monkeypatch.setattr(readers, "content_hash", counted_hash)
    got = readers.scan_folder(spark, str(tmp_path), "steel_coating").collect()
    assert len(got) == 40 and read.value == 40


def test_a_folder_is_listed_by_tasks(spark, tmp_path, png, monkeypatch):
    """The driver keeps no list of files: Spark's reader of binary files, which does, is left alone. Names that it passes over are."""
    folder = tmp_path / "a b+é"
    files = ["z.png", "sub/x.JPG", "sub/deep/er/y.jpeg", "k=1/_p=2.png", "sub/deep/n.txt"]
    for name in [*files, ".h.png", "_h.png", "_hid/a.png", ".hid/a.png", "c.png._COPYING_"]:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(png(3, len(name)))
    (folder / "gone.png").symlink_to(folder / "nothing")
    (folder / "empty").mkdir()
    want = sorted(f"{folder}/{name}" for name in files[:4])
    assert sorted(r.path for r in old_image_files(spark, str(folder)).collect()) == want
    monkeypatch.setattr(readers, "FILES_A_TASK", 2)
    monkeypatch.setattr(readers, "NAMES_AT_ONCE", 2)
    for path in (str(folder), f"{folder}/", f"file://{folder}", f"/{folder}"):
        found = readers.image_files(spark, path)
        assert found.inputFiles() == [] or not any(name.endswith("png") for name in found.inputFiles())
        assert sorted(r.path for r in found.collect()) == want
    assert {r.path: bytes(r.content) for r in found.collect()}[f"{folder}/z.png"] == png(3, 5)
    assert sorted(r.path for r in readers.list_files(spark, str(folder)).collect()) == sorted(f"{folder}/{name}" for name in files)
    got = readers.scan_folder(spark, str(folder), "steel_coating").collect()
    assert {r.path: r.image_id for r in got} == {path: f"img_{at:05d}" for at, path in enumerate(sorted(want, key=lambda p: p.split("/")))}
    assert readers.scan_folder(spark, str(folder / "empty"), "steel_coating").collect() == []


def test_a_path_that_is_no_folder_is_left_to_spark(spark, tmp_path, png):
    (tmp_path / "a.png").write_bytes(png(5, 6))
    assert [r.path for r in readers.image_files(spark, str(tmp_path / "a.png")).collect()] == [str(tmp_path / "a.png")]
    assert [r.path for r in readers.image_files(spark, str(tmp_path / "*.png")).collect()] == [str(tmp_path / "a.png")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.scan_folder(spark, str(tmp_path / "none"), "steel_coating").collect()


def old_image_files(spark, folder):
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = read.option("pathGlobFilter", "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}").load(folder)
    return files.withColumn("path", readers._local_path("path"))
