"""What the findings of round 4 showed: hulls of idents with very many frames."""

from __future__ import annotations

import random

import numpy as np
import pytest

from skyplume.jobs import file_jobs
from skyplume.sinks import meshes as mesh_sink
from skyplume.sources import meshes
from skyplume.sources.files import listed, write_files
from tests.test_findings_r03 import plan_of, same_as_sql


def test_heights_of_distant_frames(spark):
    """Heights that lie stretches apart, on either side of their edges, and twice at a frame; no row looks through all that follow it."""
    rng = random.Random(4)
    at = sorted({rng.choice((0, 4095, 4096, 8192, 200_000, 1_000_000)) + rng.randrange(-3, 4) for _ in range(30)})
    known = {"a": {k: float(rng.randrange(100)) for k in at[3:-3]}, "b": {5000: 1.0}, "c": {}}
    heights = [(i, k, z, True) for i, have in known.items() for k, z in have.items()] + [(i, k + 1, 999.0, False) for i in "abc" for k in at]
    asked = [(i, k) for i in "abc" for k in [*at, 5000, 50_000, 600_000, -20_000, 3_000_000]]
    out = meshes.last_confident(spark.createDataFrame(asked, "file string, frame long"), spark.createDataFrame(heights, "file string, frame long, z double, confident boolean"), "file")
    assert "unboundedfollowing" not in plan_of(out).lower()

    def plainly(have, k):
        a, b = max((x for x in have if x <= k), default=None), min((x for x in have if x >= k), default=None)
        if a is None or b is None or a == b:
            return have.get(b if a is None else a)
        return have[a] + (k - a) / (b - a) * (have[b] - have[a])

    got = sorted((r.file, r.frame, r.z) for r in out.collect())
    want = sorted((i, k, plainly(known[i], k)) for i, k in asked)
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(x[2] == pytest.approx(y[2]) if y[2] is not None else x[2] is None for x, y in zip(got, want, strict=True))
    twice = spark.createDataFrame([("a", 7, z, True) for z in (3.0, 5.0, 4.0)], "file string, frame long, z double, confident boolean")
    ends = meshes.last_confident(spark.createDataFrame([("a", 1), ("a", 7), ("a", 9)], "file string, frame long"), twice, "file").collect()
    assert {r.frame: r.z for r in ends} == {1: 3.0, 7: 5.0, 9: 5.0}


def test_files_of_an_ident_are_bounded(spark, tmp_path):
    """16,000 frames of one ident are several files, whose rows are those of the SQL."""
    same_as_sql(spark, tmp_path, "hull_profile", part="SELECT 8 * i AS p_partkey, CAST(i % 50 + 1 AS INTEGER) AS p_size FROM range(16000) r(i)")
    sizes = [n for _, n in listed(file_jobs.hull_files(spark, str(tmp_path)), (".glb",))]
    assert max(sizes) < 5 << 20 and sum(sizes) > 8 << 20


def test_files_begin_with_keys_and_bytes(spark, tmp_path):
    """All meshes of all keys come back from files of any size; lists of other lengths are errors."""
    points, faces = [list(map(float, p)) for p in file_jobs.TETRA[0]], [list(f) for f in file_jobs.TETRA[1]]
    rows = [(f"k{i % 3}.1", f"f{i}", [[x + i for x in p] for p in points], faces[: 4 - i % 2]) for i in range(50)]
    kind = "file string, mesh string, points array<array<double>>, faces array<array<int>>"
    for most in (1, 2000, 1 << 30):
        (folder := tmp_path / str(most)).mkdir()
        write_files(mesh_sink.mesh_files(spark.createDataFrame(rows, kind).repartition(5), "file", most), str(folder))
        back = [(path.name.rsplit(".", 3)[0], *m) for path in folder.glob("*.glb") for m in meshes.meshes(path.read_bytes())]
        assert {(k, n): (len(p), len(f)) for k, n, p, f in back} == {(k, n): (4, len(f)) for k, n, _, f in rows} and len(back) == 50
        assert {n: (p[:, 0].min(), -p[:, 2].max(), p[:, 1].min()) for _, n, p, _ in back} == {n: (float(n[1:]),) * 3 for _, n, _, _ in rows}  # the file is y up
        assert (len(list(folder.glob("*.glb"))) == 50) == (most == 1)
    with pytest.raises(Exception, match="three numbers"):
        mesh_sink.mesh_files(spark.createDataFrame([("a", "f1", [[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]], faces)], kind), "file").collect()


def test_hulls_are_read_once(spark, tmp_path):
    """What the series trusts needs the hulls twice, and an ident's rows do not all meet its one row in a task."""
    points, faces = np.array(file_jobs.BOX[0], float), np.array(file_jobs.BOX[1])
    (tmp_path / "a.glb").write_bytes(mesh_sink.encoded([(f"hull_f{k}", points, faces) for k in range(100)]))
    hulls = meshes.read_meshes(spark, str(tmp_path))
    series = hulls.select("file", "frame").distinct().selectExpr("file", "frame", "if(frame < 50, 'strict', 'no shadow') mode")
    out = meshes.hull_heights(hulls, "file", 10.0, spark.createDataFrame(series.collect(), series.schema))
    assert "MapInArrow" not in plan_of(out) and "_deal" in plan_of(out)
    assert sorted((r.frame, r.confident) for r in out.collect()) == [(k, k < 50) for k in range(100)]
