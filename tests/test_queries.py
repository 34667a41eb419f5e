"""Every relational query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from boxwright.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([float(f"{r[i]:.6f}") + 0.0 if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_greedy_uses_each_side_once(spark):
    got = QUERIES["greedy_match"](spark, SF).collect()
    assert len({(r.image, r.key) for r in got}) == len({(r.image, r.ord) for r in got}) == len(got) > 0


def test_clusters_match_a_plain_loop(spark):
    from boxwright.operators.kernels import clusters

    points = [("a", float(i * 7 % 40 + 200 * (i % 3)), float(i * 13 % 30 + 50 * (i % 2))) for i in range(90)] + [("b", 1.0, 1.0), ("b", 1.0, 2.0)]
    got = {(r["class"], r.cx, r.cy): r["key"] for r in clusters(spark.createDataFrame(points, "class string, cx double, cy double"), {"a": 3, "b": 5}).collect()}
    a = [p[1:] for p in points if p[0] == "a"]
    centre = [sorted(a)[i * 30] for i in range(3)]
    for _ in range(50):
        at = [min(range(3), key=lambda c, p=p: ((p[0] - centre[c][0]) ** 2 + (p[1] - centre[c][1]) ** 2, c)) for p in a]
        groups = [[p for p, c in zip(a, at) if c == i] for i in range(3)]
        centre = [(sum(p[0] for p in g) / len(g), sum(p[1] for p in g) / len(g)) if g else centre[i] for i, g in enumerate(groups)]
    order = sorted(range(3), key=lambda i: centre[i])
    assert {p: got["a", *p] for p in a} == {p: f"a#{order.index(c)}" for p, c in zip(a, at)}
    assert got["b", 1.0, 1.0] == got["b", 1.0, 2.0] == "b#0"


def test_opening_rounds_a_block_and_drops_a_dot(spark):
    from boxwright.operators.kernels import dilate, erode

    block = {8 * y + x for y in range(2, 6) for x in range(2, 6)}
    mask = spark.createDataFrame([(1, p) for p in sorted(block | {63})], "image long, pos int")
    got = {r.pos for r in dilate(erode(mask, 3), 3).collect()}
    assert got == block - {8 * 2 + 2, 8 * 2 + 5, 8 * 5 + 2, 8 * 5 + 5}


def test_summary_of_missing_sources(spark):
    from boxwright.operators.labels import summary

    got = summary(detections=spark.range(3)).first()
    assert (got.color_exists, got.position_exists, got.detection_exists) == (False, False, True)
    assert (got.color_count, got.n_pass, got.samples, got.predictions) == (None, None, None, 3)
    assert summary().first().predictions is None


def test_cleaned_masks_skip_steps_of_size_zero(spark):
    from boxwright.operators.kernels import cleaned

    block = {8 * y + x for y in range(1, 4) for x in range(1, 4)}
    mask = spark.createDataFrame([(1, p) for p in sorted(block | {63})], "image long, pos int")
    same = {r.pos for r in cleaned(mask, 1, 0, 0).collect()}
    large = {r.pos for r in cleaned(mask, 5, 0, 0).collect()}
    wide = {r.pos for r in cleaned(mask, 5, 0, 0, 3).collect()}
    assert same == block | {63} and large == block and wide == block | {8 * i + 2 for i in (0, 4)} | {8 * i + j for i in (1, 2, 3) for j in (0, 4)} | {1, 3, 33, 35}


def test_boxes_of_unturned_images_stay(spark):
    from boxwright.operators.shapes import augmented

    rows = [(s, 0, 1, 0.5, 0.5, 0.2, 0.4) for s in range(20)] + [(99, 0, 1, 1.4, 0.5, 0.2, 0.2), (99, 1, 1, 1.0, 0.5, 0.2, 0.2)]
    got = augmented(spark.createDataFrame(rows, "stem long, line_no int, class_id int, x double, y double, w double, h double"), limit=0.0).collect()
    assert all((round(r.x, 9), round(r.y, 9), round(r.w, 9), round(r.h, 9)) == (0.5, 0.5, 0.2, 0.4) for r in got if r.stem < 99)
    edges = {round(r.x, 9) for r in got if r.stem == 99}
    assert len(got) == 63 and edges <= {0.95, 0.05} and edges


def test_line_errors_read_the_values(spark):
    from boxwright.operators.lint import line_errors

    lines = ["0 0.5 0.5 0.1 0.1", "9 0.5 1.5 0.1 0.1", "x 0.5 0.5 0.1 0.1", "0 0.5 y 0.1 0.1", "1.0 0 0 0 0", "0 0 0", "", "-1 nan 1e-5 -1e-5 -0.0005 z", "7 0 1 1.0 +.5"]
    got = {}
    for r in line_errors(spark.createDataFrame(list(enumerate(lines)), "i int, line string"), 8).collect():
        got.setdefault(r.i, []).append(r.message)
    bad, out = "cannot parse", " out of range [0, 1]"
    assert got == {1: ["invalid class_id 9 (must be 0-7)", f"y=1.5{out}"], 2: [bad], 3: [bad], 4: [bad], 5: ["expected 5 values, got 3"], 7: ["invalid class_id -1 (must be 0-7)", f"x=nan{out}", f"w=-1e-05{out}", f"h=-0.0005{out}"]}


def test_epoch_lines_as_the_reference_reads_them(spark):
    from boxwright.operators.reports import epochs

    lines = ["5/100 3.66G 1.5 2.25 0.75 64 640", "[12:00] INFO 6/100   0   0.000 2 .5", "INFO results saved", "7/100 1G 1.2.3 1 1"]
    got = epochs(spark.createDataFrame([(x,) for x in lines], "line string")).drop("line").collect()
    assert sorted(map(tuple, got)) == [(5, 100, 1.5, 2.25, 0.75), (6, 100, 0.0, 2.0, 0.5)]


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["color_scores", "color_decisions", "color_decision_counts"])
def test_colours_of_images_with_parts_missing(spark, tmp_path, name):
    """Every set of the four embeddings of an image, of every kind, and rows without a number."""
    ids = [4 * image + q for image in range(11 * 15) for q in range(4) if (image // 11 + 1) >> q & 1] + [None, None]
    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest(?::BIGINT[]) AS vec_id, range(64)::FLOAT[] AS embedding, 1 AS label) TO '{tmp_path}/embeddings.parquet'", [ids])
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, str(tmp_path))
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", ["color_scores", "color_decisions", "color_decision_counts"])
def test_colours_of_images_under_zero(spark, tmp_path, name):
    """Every remainder of the kinds, whole images and parts."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range - 133 AS vec_id, range(64)::FLOAT[] AS embedding, 1 AS label FROM range(200)) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, str(tmp_path))
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())
