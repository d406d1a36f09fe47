"""File formats: volumes, results, splits, metrics."""

import json
import os

import numpy as np
import pytest

from voxquarry.operators import labels as lb
from voxquarry.operators.learning import batch_score
from voxquarry.sources import tables as tb
from voxquarry.sources import volumes as vol


def write_cases(root):
    rng = np.random.default_rng(0)
    made = {}
    for i in range(3):
        folder = root / f"s{i:04d}"
        folder.mkdir(parents=True)
        ct = rng.random((1, 5, 4, 6), dtype=np.float32)
        mask = rng.integers(0, 3, (1, 5, 4, 6)).astype(np.float32)
        np.save(folder / "ct.npy", ct)
        np.save(folder / "mask.npy", mask)
        if i:
            (folder / "text.json").write_text('{"1": "liver mass"}')
        made[folder.name] = (ct[0], mask[0])
    return made


@pytest.mark.parametrize("split", [False, True])
def test_volume_files(spark, tmp_path, split):
    made = write_cases(tmp_path / "npy")
    reader = vol.volume_ingest(spark, str(tmp_path / "npy"))
    if split:  # force several z-ranges per file
        reader = spark.read.format("npy_volume").option("path", str(tmp_path / "npy")).option("kind", "ct").option("bytes_per_task", "200").load()
    rows = reader.collect()
    assert len(rows) == 15
    for r in rows:
        np.testing.assert_allclose(np.array(r.px).reshape(r.h, r.w), made[r.case_id][0][r.z])
    voxels = vol.volume_ingest(spark, str(tmp_path / "npy"), kind="mask", emit="voxels").collect()
    assert len(voxels) == sum(int((m > 0).sum()) for _, m in made.values())
    assert all(made[v.case_id][1][v.z, v.y, v.x] == v.mask_id for v in voxels)


def test_case_scan_and_completeness(spark, tmp_path):
    write_cases(tmp_path / "npy")
    files = tb.case_scan(spark, str(tmp_path / "npy"))
    assert files.count() == 8
    full = lb.case_complete(files, ["ct", "mask", "text"])
    assert sorted(r[0] for r in full.collect()) == ["s0001", "s0002"]


def test_results_round_trip_keeps_commas(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", 1, "raw", 'mass, "large"\nsecond line', 0.123456, 0.5)], "case_id string, mask_id int, mode string, text string, dice double, iou double"
    )
    path = tb.results_write(df, str(tmp_path / "out"), "v1")
    assert path.endswith("out_v1")
    back = tb.results_load(spark, path, "case_id string, mask_id int, text string, dice double, iou double, mode string", "x")
    assert back.first().asDict() == {"case_id": "a", "mask_id": 1, "mode": "raw", "dice_x": 0.1235}


def test_foreign_column_names(spark, tmp_path):
    (tmp_path / "r.csv").write_text('case,mask_id,mode,prompt,dice,gt_pos,pred_pos\ns1,2,raw,"a, b",0.25,3,4\n')
    df = tb.results_load(spark, str(tmp_path / "r.csv"), "case string, mask_id int, mode string, prompt string, dice double, gt_pos int, pred_pos int", "d")
    assert df.first().asDict() == {"case_id": "s1", "mask_id": 2, "mode": "raw", "dice_d": 0.25}


def test_aux_json_holds_a_case(spark):
    """One object per case with all its targets (F2), every number of which comes back."""
    names = ["z1", "y1", "x1", "z2", "y2", "x2", "cz", "cy", "cx", "z_lo", "z_hi", "volume"]
    schema = "case_id bigint, mask_id bigint, existence int, slice_exist array<int>, component_count bigint, " + ", ".join(f"{n} double" for n in names)

    def target(case, mask):
        empty = mask == 3
        return (case, mask, int(not empty), [0, 0 if empty else mask % 2, 0], 0 if empty else mask, *[0.0 if empty else (mask + k) / 64 for k in range(len(names))])

    rows = [target(case, mask) for case in (1, 2) for mask in (10, 3, 2)] + [target(5, 1)]
    aux = spark.createDataFrame(rows, schema).repartition(3)
    docs = tb.aux_to_json(aux)
    found = {r.case_id: json.loads(r.json) for r in docs.collect()}
    assert docs.count() == 3
    assert {c: list(x) for c, x in found.items()} == {1: ["2", "3", "10"], 2: ["2", "3", "10"], 5: ["1"]}
    assert found[2]["10"]["bbox_3d"] == [(10 + k) / 64 for k in range(6)] and found[2]["3"]["existence"] == 0
    back = tb.aux_from_json(docs).select(*aux.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    twice = tb.aux_from_json(tb.aux_to_json(aux.union(aux.where("case_id = 5")))).select(*aux.columns)
    assert sorted(map(tuple, twice.collect())) == sorted([*rows, rows[-1]])


def test_split_list(spark, tmp_path):
    df = spark.createDataFrame([("b",), (" a ",), ("",)], "case_id string")
    tb.write_split_list(df, str(tmp_path / "s"))
    assert sorted(r[0] for r in tb.read_split_list(spark, str(tmp_path / "s")).collect()) == ["a", "b"]


def test_metrics_log_appends(spark, tmp_path):
    for e in range(2):
        tb.metrics_append(spark.createDataFrame([(e, 0.5)], "epoch int, f1 double"), str(tmp_path / "m"))
    assert tb.metrics_read(spark, str(tmp_path / "m"), "epoch int, f1 double").count() == 2


def test_batch_score(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "i int, v array<float>")
    got = batch_score(df, lambda: lambda b: b.sum(axis=1).astype(np.float64), "v", 2, batch_size=3)
    assert {r.i: r.score for r in got.collect()} == {i: i + 1.0 for i in range(10)}


def test_progress_over_arriving_files(spark, tmp_path):
    from voxquarry.streaming.progress import progress, result_stream

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("mode,dice,pred_voxels\nraw,0.5,3\nraw,0.0,0\n")
    stream = progress(result_stream(spark, str(folder), "mode string, dice double, pred_voxels int"), ["mode"])
    q = (
        stream.writeStream.outputMode("complete").format("memory").queryName("progress_rows")
        .option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    try:
        q.processAllAvailable()
        assert spark.table("progress_rows").first().asDict() == {"mode": "raw", "n": 2, "mean": 0.25, "empty": 1}
        (folder / "b.csv").write_text("mode,dice,pred_voxels\nraw,1.0,9\n")
        q.processAllAvailable()
        assert spark.table("progress_rows").first().asDict() == {"mode": "raw", "n": 3, "mean": 0.5, "empty": 1}
    finally:
        q.stop()


def test_volume_pruning(spark, tmp_path):
    """Wanted slices come from a table; other cases' files aren't opened and other slices' bytes not read."""
    made = write_cases(tmp_path / "npy")
    root = str(tmp_path / "npy")
    wanted = [("s0000", 1), ("s0000", 2), ("s0000", 4), ("s0002", 0), ("s0002", 0), ("s0002", 9), ("gone", 1)]
    slices = spark.createDataFrame(wanted, "case_id string, z int")
    for size in (200, 1 << 20):
        got = {(r.case_id, r.z): r.px for r in vol.volume_ingest(spark, root, slices=slices, bytes_per_task=size).collect()}
        assert set(got) == {("s0000", 1), ("s0000", 2), ("s0000", 4), ("s0002", 0)}
        assert all(np.allclose(np.array(px).reshape(4, 6), made[c][0][z]) for (c, z), px in got.items())
    one = vol.volume_ingest(spark, root, cases="case_id = 's0001'")
    other = vol.volume_ingest(spark, root, cases="case_id > 's0001'")
    assert sorted({r.case_id for r in one.union(other).where("z < 3").collect()}) == ["s0001", "s0002"]
    assert vol.volume_ingest(spark, root, cases="case_id = 'none'").count() == 0
    assert vol.volume_ingest(spark, root, slices=slices.where("false")).count() == 0

    def read(**more):
        listing = vol.manifest(spark, root, "ct", **more).stage_path
        reader = vol.NpyVolumeReader({"path": root, "manifest": listing})
        return sum(b.num_rows for p in reader.partitions() for b in reader.read(p)), reader.bytes_read

    slice_bytes = 4 * 6 * 4
    assert read() == (15, 15 * slice_bytes)
    assert read(cases="case_id = 's0002'") == (5, 5 * slice_bytes)
    assert read(slices=slices) == (4, 4 * slice_bytes)
    assert read(slices=slices, cases="case_id = 's0002'") == (1, slice_bytes)


def test_case_documents(spark, tmp_path):
    from voxquarry.sources import documents as dc

    rows = [(f"s{k % 3}", str(k), '{"v": %d}' % k) for k in range(12)] + [("big case", str(k), '{"v": 1}') for k in range(3000)]
    df = spark.createDataFrame(rows, dc.SCHEMA).repartition(7)
    root = str(tmp_path / "docs")
    for _ in range(2):  # written again, they are replaced
        dc.write_documents(df, root, "d.json")
        back = dc.read_documents(spark, root, "d.json", "map<string,struct<v:int>>")
        assert sorted((r.case_id, r.key, r.value.v) for r in back.collect()) == sorted((c, k, int(b[6:-1])) for c, k, b in rows)
    assert sorted(os.listdir(root)) == ["big case", "s0", "s1", "s2"] and os.listdir(f"{root}/s0") == ["d.json"]


@pytest.mark.parametrize("bad", [("s1", "5", None), ("s1", "1", "{}"), ("../out", "1", "{}"), (None, "1", "{}")])
def test_failed_documents_leave_no_file(spark, tmp_path, bad):
    from voxquarry.sources import documents as dc

    rows = [(f"s{k}", "1", "{}") for k in range(20)] + [bad]
    with pytest.raises(Exception):
        dc.write_documents(spark.createDataFrame(rows, dc.SCHEMA), str(tmp_path / "docs"), "d.json")
    assert not [f for _, _, files in os.walk(tmp_path) for f in files]


def test_case_in_several_tasks_leaves_no_file(tmp_path):
    from voxquarry.sources import documents as dc

    writer = dc.CaseDocumentWriter({"path": str(tmp_path), "file": "d.json"})
    messages = [writer.write(iter([("s1", str(k), "{}")])) for k in range(2)]
    with pytest.raises(ValueError):
        writer.commit(messages)
    assert not os.listdir(tmp_path)
