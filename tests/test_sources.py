"""Readers and writers of mesh, polyline and option files."""

import pytest

from lattica.sources import mesh_files as files


def test_obj_round_trip(spark, tmp_path):
    path = tmp_path / "a.obj"
    path.write_text("# a comment\no thing\nv 0 0 0\nv 1 0 0.5\nv 0 1 0\nvn 0 0 1\nf 1/1/1 2//1 3\nf 1 1 2\n")
    vertices, faces = files.read_obj(spark, str(path))
    assert sorted(tuple(r)[1:] for r in vertices.collect()) == [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.5), (2, 0.0, 1.0, 0.0)]
    assert sorted(tuple(r)[1:] for r in faces.collect()) == [(0, 0, 1, 2), (1, 0, 0, 1)]
    files.write_obj(vertices, faces, str(tmp_path / "out"))
    again, kept = files.read_obj(spark, str(tmp_path / "out"))
    assert again.count() == 3 and [tuple(r)[2:] for r in kept.collect()] == [(0, 1, 2)]
    files.write_ply(vertices, faces, str(tmp_path / "ply"))
    text = [r.value for r in spark.read.text(str(tmp_path / "ply")).collect()]
    assert "element face 1" in text and text[-1] == "3 0 1 2" and len(text) == 9 + 3 + 1
    path.write_text("v 0 0 0\nf 1 1 1 1\n")
    with pytest.raises(Exception, match="not a triangle"):
        files.read_obj(spark, str(path))[1].collect()


def test_materials_polylines_and_options(spark, tmp_path):
    (tmp_path / "m.mtl").write_text("newmtl red\nKa 1 0 0\nNs 5\nmap_Kd red.png\nnewmtl blue\nKd 0 0 1\n")
    rows = {r.name: r for r in files.read_mtl(spark, str(tmp_path / "m.mtl")).collect()}
    assert rows["red"].ka == [1.0, 0.0, 0.0] and rows["red"].ns == 5.0 and rows["red"].map_kd == "red.png" and rows["blue"].kd == [0.0, 0.0, 1.0]
    for name, text in (("p.dat", "0 0\n1 1\n"), ("q.dat", "2 2\n3 3\n4 4\n")):
        (tmp_path / name).write_text(text)
    lines = files.read_polylines(spark, [str(tmp_path / "p.dat"), str(tmp_path / "q.dat")])
    assert sorted((r.label, r.ord, r.fx) for r in lines.collect()) == [(0, 0, 0.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 3.0), (1, 2, 4.0)]
    for folder, text in (("one", "5 5\n"), ("two", "6 6\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "p.dat").write_text(text)
    same = files.read_polylines(spark, [str(tmp_path / "two" / "p.dat"), str(tmp_path / "one" / "p.dat"), str(tmp_path / "p.dat")])
    assert sorted((r.label, r.fx) for r in same.collect()) == [(0, 6.0), (1, 5.0), (2, 0.0), (2, 1.0)]
    files.write_polylines(lines, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 5
    (tmp_path / "o.config").write_text("# c\nGPU false\nLEVEL 7x\nGPU 0\nNAME a b \n")
    options = files.read_options(spark, str(tmp_path / "o.config"))
    assert not files.option_bool(options, "GPU", True) and files.option_int(options, "LEVEL") == 7 and options["NAME"] == "a b" and files.option_bool(options, "MORE", True)
    (tmp_path / "list").write_text("a.dat b.dat\n#no c.dat\n\nlater.dat\n")
    assert files.read_path_list(spark, str(tmp_path / "list")) == ["a.dat", "b.dat", "c.dat"]
    edges = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "ax double, ay double, bx double, by double")
    files.write_edges(edges, str(tmp_path / "edges"))
    assert spark.read.text(str(tmp_path / "edges")).count() == 2


def test_label_meshes(spark, tmp_path):
    tris = spark.createDataFrame([(3, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (3, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0), (5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "label long, ax double, ay double, az double, bx double, by double, bz double, tx double, ty double, tz double")
    files.write_label_meshes(tris, str(tmp_path / "meshes"))
    vertices, faces = files.read_obj(spark, str(tmp_path / "meshes" / "label=3"))
    assert vertices.count() == 4 and sorted(tuple(r)[2:] for r in faces.collect()) == [(0, 2, 1), (2, 3, 1)]
    assert files.read_obj(spark, str(tmp_path / "meshes" / "label=5"))[1].count() == 0
