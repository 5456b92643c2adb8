from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tilewright.functions import naming
from tilewright.operators import catalogue, overlays, splits, training_log
from tilewright.sources import metadata, split_lists


@pytest.mark.parametrize(
    ("name", "stem", "magnification"),
    [
        ("img_001_4x.png", "img_001_4x", "4x"),
        ("/a b/synth_001_10x", "synth_001_10x", "10x"),
        ("img_004_20x.png", "img_004_20x", "unknown"),
        ("img_005_4x_extra.png", "img_005_4x_extra", "unknown"),
        ("", "", "unknown"),
        ("img.v2_4x", "img", "unknown"),
        (".hidden_4x", ".hidden_4x", "4x"),
        ("IMG_4X.png", "IMG_4X", "unknown"),
        ("117 - 9d 3T3_10x.TIFF", "117 - 9d 3T3_10x", "10x"),
    ],
)
def test_names(spark, name, stem, magnification):
    row = spark.createDataFrame([(name,)], "n string").select(naming.stem(F.col("n")), naming.magnification(F.col("n"))).head()
    assert (row[0], row[1]) == (stem, magnification)


def meta(spark, rows):
    return spark.createDataFrame(rows, "image_id string, magnification string, condition string")


def counted(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["magnification"], {}).setdefault(r["split"], 0)
        out[r["magnification"]][r["split"]] += 1
    return out


def test_split_sizes(spark):
    rows = [(f"{m}_{i}", m, None) for m in ("4x", "10x") for i in range(20)]
    got = counted(splits.assign_splits(meta(spark, rows)))
    assert got == {m: {"train": 14, "val": 3, "test": 3} for m in ("4x", "10x")}


def test_real_split_sizes(spark):
    rows = [(f"a{i}", "10x", None) for i in range(14)] + [(f"b{i}", "4x", None) for i in range(7)]
    got = counted(splits.assign_splits(meta(spark, rows)))
    assert got == {"10x": {"train": 10, "val": 2, "test": 2}, "4x": {"train": 5, "val": 1, "test": 1}}


def test_joint_strata_fill_every_split(spark):
    rows = [(f"{m}{c}{i}", m, c) for m in ("4x", "10x") for c in ("x", "y") for i in range(6)]
    assigned = splits.assign_splits(meta(spark, rows))
    assert assigned.select("split", "magnification", "condition").distinct().count() == 12


def test_small_group_falls_back(spark):
    rows = [(f"a{i}", "4x", "x") for i in range(18)] + [("b0", "4x", "y"), ("b1", "4x", "y")]
    assigned = splits.assign_splits(meta(spark, rows))
    assert {r[0] for r in assigned.select("stratum").distinct().collect()} == {"4x"}
    assert assigned.count() == 20


def test_split_does_not_depend_on_partitions(spark):
    rows = [(f"n{i}", "4x" if i % 2 else "10x", None) for i in range(101)]
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, splits.assign_splits(meta(spark, rows)).select("image_id", "split").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
    other = sorted(map(tuple, splits.assign_splits(meta(spark, rows), seed=1).select("image_id", "split").collect()))
    assert other != results[0]


@pytest.mark.parametrize(("train", "val"), [(0.0, 0.1), (1.0, 0.1), (0.5, 0.5), (0.7, -0.1)])
def test_bad_fractions(train, val):
    with pytest.raises(ValueError):
        splits.check_fractions(train, val)


def test_leak(spark):
    lists = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", "b"), ("val", "c")], "split string, image_id string")
    assert [tuple(r) for r in splits.split_leaks(lists).collect()] == [("b", "train,val")]
    with pytest.raises(ValueError, match="b"):
        splits.raise_on_leak(lists)


def test_split_lists_round_trip(spark, tmp_path):
    rows = [(f"n {i}", "4x", None) for i in range(30)]
    assigned = splits.assign_splits(meta(spark, rows))
    folder = str(tmp_path / "splits")
    split_lists.write_splits(assigned, folder)
    back = {(r["split"], r["image_id"]) for r in split_lists.read_splits(spark, folder).collect()}
    assert back == {(r["split"], r["image_id"]) for r in assigned.collect()}
    with pytest.raises(FileExistsError):
        split_lists.write_splits(assigned, folder)
    # What else is in the folder stays, and the older version too.
    (tmp_path / "splits" / "notes.md").write_text("mine")
    split_lists.write_splits(assigned.limit(10), folder, force=True)
    assert (tmp_path / "splits" / "notes.md").read_text() == "mine" and (tmp_path / "splits" / "version=0").is_dir()
    assert split_lists.read_splits(spark, folder).count() == 10


def test_order_over_several_files(spark, tmp_path):
    (tmp_path / "split=train").mkdir()
    (tmp_path / "split=train" / "a.txt").write_text("a\n")
    (tmp_path / "split=train" / "b.txt").write_text("".join(f"b{i}\n" for i in range(50)))
    got = split_lists.read_split(spark, str(tmp_path), "train").orderBy("pos").collect()
    assert [r["image_id"] for r in got] == ["a", *(f"b{i}" for i in range(50))]


def test_empty_split_reads_as_empty(spark, tmp_path):
    """Five names give 4 / 1 / 0."""
    assigned = splits.assign_splits(meta(spark, [(f"n{i}", "4x", None) for i in range(5)]))
    folder = str(tmp_path / "splits")
    split_lists.write_splits(assigned, folder)
    assert split_lists.read_split(spark, folder, "test").count() == 0
    assert split_lists.read_splits(spark, folder).count() == 5
    with pytest.raises(FileNotFoundError):
        split_lists.read_split(spark, folder, "other")


def test_split_list_text_file(spark, tmp_path):
    (tmp_path / "train.txt").write_text("b\n\n a \nb\nc\n")
    got = split_lists.read_split(spark, str(tmp_path), "train").orderBy("pos").collect()
    assert [r["image_id"] for r in got] == ["b", "a", "c"]
    with pytest.raises(FileNotFoundError):
        split_lists.read_split(spark, str(tmp_path), "val")


def test_strict_metadata(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("image_name, magnification,condition\nimg_4x.png,10x, c1\n\n ,4x,\nb.png,20x,q\nb.tif,4x,one\nb.png,10x,two\nshort\n")
    clean, errors = metadata.read_metadata_strict(spark, str(path))
    assert {r["image_id"]: (r["magnification"], r["condition"]) for r in clean.collect()} == {
        "img_4x": ("10x", "c1"),
        "b": ("10x", "two"),
    }
    got = [(r["line_no"], r["error"]) for r in errors.orderBy("line_no").collect()]
    assert [n for n, _ in got] == [4, 5, 8]
    assert "empty image name" in got[0][1] and "20x" in got[1][1] and "malformed" in got[2][1]
    with pytest.raises(ValueError, match="row 4"):
        metadata.raise_on_errors(errors)
    names = spark.createDataFrame([("img_4x.png",), ("z_4x.png",), ("q.png",)], "name string")
    resolved = {r["name"]: r["magnification"] for r in catalogue.resolve_magnification(names, clean).collect()}
    assert resolved == {"img_4x.png": "10x", "z_4x.png": "4x", "q.png": "unknown"}


def test_metadata_header_and_missing_file(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("name,mag\na,4x\n")
    with pytest.raises(ValueError, match="image"):
        metadata.read_metadata_strict(spark, str(bad))
    with pytest.raises(FileNotFoundError):
        metadata.read_metadata_strict(spark, str(tmp_path / "none.csv"))


def test_long_metadata_keeps_line_numbers(spark, tmp_path):
    """A file read in many pieces still counts its lines from the top."""
    path = tmp_path / "big.csv"
    path.write_text("image,magnification\n" + "".join(f"i{n}.png,{'9x' if n % 500 == 0 else '4x'}\n" for n in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        clean, errors = metadata.read_metadata_strict(spark, str(path))
        assert clean.count() == 4990
        assert sorted(r["line_no"] for r in errors.collect()) == [n + 2 for n in range(0, 5000, 500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728b")


def test_merge_and_versions(spark, tmp_path):
    columns = "image string, magnification string, condition string"
    existing = spark.createDataFrame([("first_4x.png", "4x", "ctrl"), ("missing_10x.png", "10x", "")], columns)
    new = catalogue.metadata_rows(spark.createDataFrame([("first_4x.png",), ("second_10x.png",), ("manual.png",)], "name string"))
    merged = {r["image"]: (r["magnification"], r["condition"], r["added"]) for r in catalogue.merge_metadata(existing, new).collect()}
    assert merged == {
        "first_4x.png": ("4x", "ctrl", False),
        "missing_10x.png": ("10x", "", False),
        "second_10x.png": ("10x", "", True),
        "manual.png": ("", "", True),
    }
    assert [r[0] for r in catalogue.stale_rows(existing, new).collect()] == ["missing_10x.png"]
    folder = str(tmp_path / "t")
    metadata.write_metadata(existing, folder)
    with pytest.raises(FileExistsError):
        metadata.write_metadata(existing, folder)
    latest = metadata.read_metadata_lenient(spark, metadata.latest_version(spark, folder))
    metadata.write_metadata(catalogue.merge_metadata(latest, new), folder, mode="update")
    assert metadata.versions(spark, folder) == [0, 1]
    rows = metadata.read_metadata_lenient(spark, metadata.latest_version(spark, folder)).collect()
    assert {r["image"]: r["condition"] for r in rows}["first_4x.png"] == "ctrl" and len(rows) == 4


def test_consistency(spark):
    def side(names):
        return spark.createDataFrame([(n, f"/p/{n}.png") for n in names], "image_id string, path string")

    issues = catalogue.consistency_issues(side("abc"), side("bcd"), side("ae"))
    got = {(r["issue"], r["image_id"]) for r in issues.collect()}
    assert got == {
        ("metadata_without_files", "a"),
        ("metadata_without_files", "e"),
        ("raw_without_mask", "a"),
        ("mask_without_raw", "d"),
    }
    with pytest.raises(ValueError, match="mask_without_raw: 1"):
        catalogue.raise_on_issues(issues)
    assert catalogue.has_pairs(side("ab"), side("b")) and not catalogue.has_pairs(side("a"), side("b"))


def test_pairing_with_a_hot_stem(spark):
    masks = spark.createDataFrame([("hot", f"/m/{i}/hot.png") for i in range(900)] + [(f"s{i}", f"/m/s{i}.png") for i in range(100)], "image_id string, path string")
    raw = spark.createDataFrame([("hot", "/r/a/hot.png"), ("hot", "/r/b/hot.tif"), ("s1", "/r/s1.png")], "image_id string, path string")
    got = catalogue.pair_files(raw, masks).collect()
    assert len(got) == 901
    assert {r["raw_path"] for r in got if r["image_id"] == "hot"} == {"/r/b/hot.tif"}
    assert all(r["duplicate_stem"] == (r["image_id"] == "hot") for r in got)


def pick(samples, k):
    """Plain restatement of the selection rule."""
    by = {m: sorted(n for n, x in samples if x == m) for m in ("4x", "10x", "unknown")}
    half = k // 2
    chosen = [(n, m) for m in ("4x", "10x") for n in by[m][:half]]
    rest = sorted([(n, m) for m in ("4x", "10x") for n in by[m][half:]] + [(n, "unknown") for n in by["unknown"]])
    return sorted(chosen + rest[: max(0, k - len(chosen))])


@pytest.mark.parametrize("k", [0, 1, 3, 4, 7, 50])
def test_overlay_selection(spark, k):
    samples = [(f"n{i * 7 % 23:02d}", ["4x", "10x", "unknown", "20x", "10x"][i % 5]) for i in range(23)]
    df = spark.createDataFrame(samples, "name string, magnification string")
    got = sorted(map(tuple, overlays.select_overlays(df, k).collect()))
    assert got == (pick(samples, k) if k > 0 else [])


def replay(scores, patience):
    best, wait, out, last = -1.0, 0, [], None
    for epoch, value in enumerate(scores, 1):
        improved = value > best
        if improved:
            best, wait, last = value, 0, epoch
        else:
            wait += 1
        out.append((epoch, improved, last))
        if wait >= patience:
            return out, epoch
    return out, None


@pytest.mark.parametrize(("patience", "partitions"), [(1, 6), (2, 5), (4, 9), (4, None)])
def test_early_stop(spark, patience, partitions):
    logs = {
        "a": [0.1, 0.2, 0.2, 0.3, 0.1, 0.1, 0.1, 0.1, 0.9],
        "b": [0.5],
        "c": [-2.0, -2.0, -2.0, 0.4, 0.1, 0.2, 0.3],
        "d": [i / 100 for i in range(60)],
    }
    rows = [(run, e, v) for run, values in logs.items() for e, v in enumerate(values, 1)]
    df = spark.createDataFrame(rows, "run string, epoch bigint, score double")
    got = {}
    for r in training_log.early_stop(df, ["run"], patience=patience, partitions=partitions).collect():
        got.setdefault(r["run"], []).append((r["epoch"], r["improved"], r["last_improved"], r["stop_epoch"]))
    for run, values in logs.items():
        expected, stop = replay(values, patience)
        assert sorted(got[run]) == [(e, i, l, stop) for e, i, l in expected]


def test_log_is_read_by_name(spark, tmp_path):
    from tilewright.sources.runs import read_training_log

    path = tmp_path / "log.csv"
    path.write_text("epoch,dice_class_2,train_loss,dice_class_0\n1,0.2,9.5,0.1\n")
    got = training_log.class_scores_long(read_training_log(spark, str(path)), ["epoch"]).collect()
    assert sorted((r["epoch"], r["class"], r["dice"]) for r in got) == [(1, 0, 0.1), (1, 2, 0.2)]
