"""Readers, writers, task plans and streams over small folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from boxwright.operators import decisions, instances, lint
from boxwright.plans import tasks
from boxwright.sources import bindings, configs, files, sinks

SF = "/root/testdata/sf0.001"


def test_listing_ignores_case_and_missing_folders(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt", "sub/d.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    root = f"file://{tmp_path}"
    assert [r.name for r in files.files(spark, root).orderBy("name").collect()] == ["a.png", "b.JPG"]
    assert [(r.name, r.stem, r.suffix, r.length) for r in files.files(spark, root, recursive=True).orderBy("name").collect()][2] == ("d.jpeg", "d", ".jpeg", 1)
    assert files.files(spark, f"{root}/none").count() == 0
    with pytest.raises(FileNotFoundError):
        files.files(spark, f"{root}/none", required=True)
    with pytest.raises(FileNotFoundError):
        files.files(spark, root, (".webp",), required=True)


def test_labels_are_read_as_written(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n\n2 0.1 0.2 0.3 0.4 extra\n1 0.5\n0 0 0 1 1\n")
    (folder / "b.txt").write_text("")
    root = f"file://{folder}"
    got = sorted(map(tuple, files.labels(spark, root).collect()))
    assert got == sorted([("a", 0, 0, 0.5, 0.5, 0.1, 0.1), ("a", 2, 2, 0.1, 0.2, 0.3, 0.4), ("a", 4, 0, 0.0, 0.0, 1.0, 1.0)])
    assert [tuple(r) for r in files.label_classes(spark, root).collect()] == [("a", [0, 2, 1])]
    (folder / "c.txt").write_text("label 0 0 0 0\n3 x 0 0 0\n")
    assert files.labels(spark, root, strict=False).filter("stem = 'c'").count() == 2
    with pytest.raises(Exception, match="no number"):
        files.labels(spark, root).collect()
    assert files.labels(spark, f"{root}/none").count() == 0


def test_images_classes_and_colours(spark, tmp_path):
    row = bytes([1, 2, 3, 4, 5, 6]) + b"\0\0"
    bmp = b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + row + row
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.bmp").write_bytes(bmp)
    (tmp_path / "img" / "bad.bmp").write_bytes(b"no image")
    px = files.image_pixels(files.images(spark, f"file://{tmp_path}/img"))
    assert sorted((r.row, r.col, r.b, r.g, r.r) for r in px.collect()) == [(0, 0, 1, 2, 3), (0, 1, 4, 5, 6), (1, 0, 1, 2, 3), (1, 1, 4, 5, 6)]
    (tmp_path / "classes.txt").write_text("bolt\n\n nut \n")
    root = f"file://{tmp_path}"
    assert files.class_names(spark, root, ["object"]) == ["bolt", "nut"] and files.class_names(spark, root, ["x"]) == ["x"]
    (tmp_path / "stats.json").write_text(json.dumps({"Red": {"hsv_min": [0, 10, 20], "hsv_max": [5, 20, 30], "lab_min": [1, 2, 3], "lab_max": [4, 5, 6], "hsv_mean": [2, 15, 25]}}))
    (r,) = files.color_ranges(spark, f"{root}/stats.json", (1,), (1, 2, 3))
    assert (r.low, r.high, r.lab_low, r.lab_high, r.hue, r.chroma) == ((-1, 9, 19), (6, 21, 31), (0, 0, 0), (5, 7, 9), 2, None)
    (tmp_path / "e.csv").write_text("file,label\nX/A.jpg,Red\nb.jpg,\na.jpg,Green\n")
    (tmp_path / "e.json").write_text(json.dumps({"items": [{"image": "A.jpg", "color": "Red"}, {"path": "d/c.jpg", "label": "Blue"}]}))
    assert {r.image: r.color for r in files.expected_colors(spark, f"{root}/e.csv").collect()} == {"a.jpg": "Green"}
    assert {r.image: r.color for r in files.expected_colors(spark, f"{root}/e.json").collect()} == {"a.jpg": "Red", "c.jpg": "Blue"}
    (tmp_path / "m.csv").write_text("epoch, loss\n1,0.5\n2,0.25\n")
    assert files.last_row(spark, f"{root}/m.csv") == {"epoch": "2", "loss": "0.25"} and files.last_row(spark, f"{root}/m.csv", ["loss", "none"]) == {"loss": "0.25"}
    assert files.count_rows(spark, f"{root}/m.csv") == 2 and files.count_rows(spark, f"{root}/none.csv") == 0
    assert files.last_row(spark, f"{root}/none.csv") == {} and files.json_or_none(spark, f"{root}/m.csv") is None and files.json_or_none(spark, f"{root}/e.json")["items"]


def test_reports_are_written(spark, tmp_path):
    root = f"file://{tmp_path}"
    issues = lint.lint_issues(spark, SF)
    sinks.write_lint(issues, f"{root}/lint")
    back = spark.read.option("header", True).csv(f"{root}/lint/issues.csv")
    assert back.columns == ["stem", "issue", "detail"] and back.count() == issues.count()
    summary = spark.read.text(f"{root}/lint/summary.md", wholetext=True).first().value
    assert f"Issues: {issues.count()}" in summary and "- missing_label: " in summary
    d = decisions.color_decisions(spark, SF)
    sinks.write_decisions(d, f"{root}/color")
    assert spark.read.json(f"{root}/color/items.json").count() == d.count()
    assert spark.read.json(f"{root}/color/summary.json").first().total == d.count()
    r, v = instances.position_results_multi(spark, SF), instances.position_verdict_multi(spark, SF)
    sinks.write_positions(r, v, f"{root}/pos", "config", 2.0)
    records = spark.read.json(f"{root}/pos/records.json")
    assert records.count() == v.count() and records.select(F.sum(F.size("results"))).first()[0] == r.count()
    assert files.json_or_none(spark, f"{root}/pos/summary.json")["summary"]["samples"] == v.count()
    a = bindings.annotations(spark, SF)
    sinks.write_labels(a, f"{root}/labels")
    lines = spark.read.option("recursiveFileLookup", True).text(f"{root}/labels")
    assert lines.count() == a.count() and lines.filter(F.size(F.split("value", " ")) != 5).count() == 0
    sinks.write_split(spark.createDataFrame([("a", "train"), ("b", "val")], "stem string, split string"), f"{root}/split")
    assert sorted(p.name for p in (tmp_path / "split").glob("split=*")) == ["split=train", "split=val"]
    assert "nc: 2" in sinks.data_yaml(["a", "b"])


def test_tasks_in_order():
    graph = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"], "x": ["y"], "y": ["x"], "z": ["none"], "deep0": []}
    assert tasks.ordered(graph, ["d", "a"]) == ["a", "b", "c", "d"] and tasks.ordered(graph, ["c", "b"]) == ["a", "c", "b"]
    for bad in ("x", "z", "none"):
        with pytest.raises(ValueError):
            tasks.ordered(graph, [bad])
    chain = {f"t{i}": [f"t{i - 1}"] if i else [] for i in range(5000)}
    assert tasks.ordered(chain, ["t4999"])[0] == "t0"


def test_values_of_configurations():
    assert [tasks.image_size(x) for x in (640, "640", [640], [640, 480], (1, 2, 3), "bad", None, {}, [])] == [[640, 640], [640, 640], [640, 640], [640, 480], [1, 2], None, None, None, None]
    assert tasks.name_list({2: "c", 0: "a", "1": None}) == ["a", "c"] and tasks.name_list(None) == []
    assert (tasks.enabled({"a": None}, "a"), tasks.enabled({"a": {}}, "a"), tasks.enabled({"a": {"enabled": False}}, "a"), tasks.enabled({}, "a")) == (False, True, False, False)
    assert tasks.placeholders({"a": [{"b": "/project/x"}, "y"], "c": 1}) == ["a[0].b"]
    assert tasks.aliases({"Red": ["rot"]}) == {"red": "Red", "rot": "Red"} and tasks.task_key("Train ", {"t": "train"}) == "t"
    for call in (lambda: tasks.require({}, ["a"]), lambda: tasks.positive(0, "n"), lambda: tasks.ratio(2, "r"), lambda: tasks.unique_names(["a", "a"]), lambda: tasks.checked_ratios({"a": 0.5, "b": 0.4})):
        with pytest.raises(ValueError):
            call()
    assert tasks.checked_ratios({"train": 0.8, "val": 0.1, "test": 0.1})["train"] == 0.8


def test_preflight(spark, tmp_path):
    labels = tmp_path / "set" / "train" / "labels"
    labels.mkdir(parents=True)
    (labels / "a.txt").write_text("5 0.5 0.5 0.1 0.1\n")
    config = {"yolo_training": {"class_names": ["a", "b"], "dataset_dir": f"file://{tmp_path}/set", "model": "no.pt", "project": "p", "deploy": {"enabled": True}}, "train_test_split": {"input": {"image_dir": "gone", "label_dir": ""}}, "color_verification": {"color_stats": "gone.json"}}
    got = tasks.preflight(spark, ["yolo_train", "deploy", "color_verification"], config).collect()
    assert [(r.severity, r.task) for r in got] == [("ERROR", "yolo_train"), ("ERROR", "dataset_splitter"), ("WARNING", "yolo_train"), ("ERROR", "color_verification"), ("ERROR", "deploy")]
    assert [(r.severity, r.task) for r in tasks.preflight(spark, ["deploy"], {"yolo_training": {"project": "p"}}).collect()] == [("WARNING", "deploy")] * 2
    assert tasks.preflight(spark, ["qc"], {}).count() == 0


def test_log_stream(spark, tmp_path):
    from boxwright.streaming.logs import epoch_stream, latest_epochs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("1/9 1.2G 3 2 1\nnoise\n2/9 0 2.5 2 1\n")
    (tmp_path / "in" / "b.log").write_text("INFO 7/9 1.2G 1 1 1\n")
    q = latest_epochs(epoch_stream(spark, f"file://{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("epochs").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.file, r.epoch, r.box_loss) for r in spark.table("epochs").collect()) == [("a.log", 2, 2.5), ("b.log", 7, 1.0)]


def test_empty_files_are_listed(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.jpg", ""), ("b c.JPG", ""), ("sub/d%2.png", ""), ("fu ll.png", "x"), ("e.png", "xy")):
        (tmp_path / name).write_text(text)
    got = lambda deep: sorted((r.name, r.length) for r in files.files(spark, f"file://{tmp_path}", recursive=deep).collect())
    assert got(False) == [("a.jpg", 0), ("b c.JPG", 0), ("e.png", 2), ("fu ll.png", 1)]
    assert got(True) == [("a.jpg", 0), ("b c.JPG", 0), ("d%2.png", 0), ("e.png", 2), ("fu ll.png", 1)]
    assert files.files(spark, f"file://{tmp_path}").filter("modified IS NULL").count() == 0


def test_configurations(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "pos.json").write_text(json.dumps({"P": {"A": {"tolerance": 3, "expected_boxes": {"X#1": {"x1": 1, "x2": "9", "cx": 4}, "Y": {"x1": "?"}, "X#0": {}, "Z": 7}}, "B": 5}, "Q": 1}))
    p = configs.positions(spark, f"{root}/pos.json")
    assert [(r.key, r.x1, r.x2, r.ecx, r.area_tolerance, r.enabled, r.mode) for r in p.orderBy("exp_ord").collect()] == [("X#1", 1.0, 9.0, 4.0, 3.0, True, "center"), ("X#0", 0.0, 0.0, None, 3.0, True, "center")]
    with pytest.raises(TypeError):
        configs.position_rows([1])
    assert configs.positions(spark, None).count() == 0
    assert configs.scoped(p, "P", "A").count() == configs.scoped(p, "P", "none").count() == configs.scoped(p).count() == 2
    assert configs.expected_items(spark, None, p) == configs.expected_items(spark, None, p, "P", "A") == {"P": {"A": ["X"]}}
    assert configs.expected_items(spark, None, p, "P", "none", ["a", None]) == {"P": {"none": ["a"]}}
    assert configs.expected_items(spark, {"Z": {}}, p) == {"Z": {}} and configs.expected_items(spark) == {}
    assert configs.overridden(p, "x").first().area_tolerance == 3.0 and configs.overridden(p, "7", "px").first().asDict()["tolerance_unit"] == "px"
    assert configs.detection_config({"conf": 1}, {"steps": 2, "device": 3, "conf": 9}, ["device"], "P") == {"conf": 1, "current_product": "P", "steps": 2}
    assert configs.load(spark, f"{root}/none.yaml", {"a": 1}) == {"a": 1} and configs.mapping(spark, f"{root}/none.yaml") == {} and configs.mapping(spark, {1: 2}) == {"1": 2}
    with pytest.raises(FileNotFoundError):
        configs.load(spark, f"{root}/none.yaml")


def test_runs_and_models(spark, tmp_path):
    root = f"file://{tmp_path}"
    run = tmp_path / "runs" / "train2"
    (run / "weights").mkdir(parents=True)
    (run / "args.yaml").write_text('{"data": "data.json"}')
    (run / "data.json").write_text('{"names": {"1": "b", "0": "a"}}')
    assert sorted(configs.run_class_names(spark, f"{root}/runs/train2")) == ["a", "b"] and configs.run_class_names(spark, f"{root}/no", ["z"]) == ["z"]
    assert configs.existing_weights(spark, f"{root}/runs") is None and configs.existing_weights(spark, f"{root}/no") is None
    for i, name in enumerate(("best.pt", "last.pt")):
        (run / "weights" / name).write_text("w")
        os.utime(run / "weights" / name, (1000 + i, 1000 + i))
    assert configs.existing_weights(spark, f"{root}/runs").endswith("/last.pt") and configs.existing_weights(spark, f"{root}/runs", "other") is None
    assert configs.existing_weights(spark, f"{root}/runs", given=[None, f"{root}/no.pt", f"{root}/runs/train2/args.yaml"]).endswith("args.yaml")
    (tmp_path / "model.json").write_text('{"colors": {"Red": {"samples": 3}, "Blue": {"samples": 4}, "bad": 1}}')
    m = configs.color_model(spark, f"{root}/model.json")
    assert (m["total_samples"], sorted(m["colors"]), m["version"]) == (7, ["Blue", "Red"], 1)
    (tmp_path / "p.json").write_text('{"presets": {"fast": ["a", 1], "bad": 2}}')
    assert configs.presets(spark, [f"{root}/no.json", f"{root}/p.json"], {"d": []}) == {"fast": ["a", "1"]} and configs.presets(spark, [], {"d": []}) == {"d": []}
    w = configs.Watched(f"{root}/p.json", {"old": 1})
    assert w.current(spark) == {"old": 1} == w.current(spark)
    os.utime(tmp_path / "p.json", (4e9, 4e9))
    assert "presets" in w.current(spark) and configs.Watched(f"{root}/no", {"x": 1}).current(spark) == {"x": 1}


def test_label_documents_in_folders(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.XML").write_text("<annotation><filename>a.jpg</filename><object><name>x</name><bndbox><xmin>1.9</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    (tmp_path / "v" / "b.xml").write_text("not xml")
    (tmp_path / "v" / "c.json").write_text('[{"image": "c.jpg", "annotations": [{"label": "y", "coordinates": {"x": 5, "y": 5, "width": 2, "height": 4}}]}]')
    (tmp_path / "v" / "d.json").write_text("{")
    assert [(r.filename, r.label, r.xmin, r.difficult) for r in files.voc(spark, f"{root}/v").collect()] == [("a.jpg", "x", 1, False)]
    assert [(r.image, r.x1, r.y2) for r in files.createml(spark, f"{root}/v").collect()] == [("c.jpg", 4.0, 7.0)]
    assert files.voc(spark, f"{root}/no").count() == files.createml(spark, f"{root}/no").count() == 0


def test_reports_and_records(spark, tmp_path):
    root = f"file://{tmp_path}"
    (tmp_path / "d" / "train" / "images").mkdir(parents=True)
    (tmp_path / "d" / "train" / "images" / "a.jpg").write_text("")
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "results.csv").write_text("epoch, map\n1,0.5\n2,0.6\n")
    (tmp_path / "run" / "results.png").write_text("")
    sinks.write_report(spark, "train", f"{root}/run", f"{root}/d", f"{root}/report", ["results.png", "none.png"])
    text = spark.read.text(f"{root}/report", wholetext=True).first().value
    assert "train=1, val=0, test=0" in text and "- map: 0.6" in text and "![results.png](results.png)" in text and "none.png" not in text
    assert "(No metrics found in results.csv)" in sinks.report("n", "r", "d", {}, {})
    for i in range(2):
        sinks.append_experiment(spark, {"id": i, "paths": (tmp_path,), 3: {"x": None}}, f"{root}/exp")
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(f"{root}/exp").collect()) == [0, 1]
    assert sinks.config_fingerprint({"b": 1, "a": 2}) == sinks.config_fingerprint({"a": 2, "b": 1}) != sinks.config_fingerprint({"a": 3}) and sinks.config_fingerprint({1j: 2}) == sinks.config_fingerprint(object()) == "unknown"
    old, new = (spark.createDataFrame(r, "image string, annotations string") for r in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert sorted(map(tuple, sinks.createml_upsert(old, new).collect())) == [("a", "1"), ("b", "3"), ("c", "4")]
    sinks.write_documents(spark.createDataFrame([("a", "<x>\n</x>")], "stem string, xml string"), "xml", f"{root}/docs")
    assert spark.read.text(f"{root}/docs").first().value == "<x> </x>"
