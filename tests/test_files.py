"""Files written and read again, odd bytes included; releases that readers see whole."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import files, releases


def _put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{path}"


ODD = '﻿sample_id,title,n,published_date\n1,"a ""quoted"", line\nbreak",7,2024-01-02\n2,,NA,2024-01-03\n3,nan,x,2024-01-04\n4,"ž 漢 😀",-2.5,2024-01-05\n'


def test_literal_and_typed_reading(spark, tmp_path):
    path = _put(tmp_path, "odd.csv", ODD)
    rows = files.text_csv(spark, path).orderBy("sample_id").collect()
    assert [tuple(r) for r in rows] == [("1", 'a "quoted", line\nbreak', "7", "2024-01-02"), ("2", "", "NA", "2024-01-03"), ("3", "nan", "x", "2024-01-04"), ("4", "ž 漢 😀", "-2.5", "2024-01-05")]
    typed = files.typed_csv(spark, path, {"n": "double", "title": "string", "sample_id": "int"})
    assert [tuple(r) for r in typed.orderBy("sample_id").collect()] == [(7.0, 'a "quoted", line\nbreak', 1), (None, None, 2), (None, None, 3), (-2.5, "ž 漢 😀", 4)]
    pruned = files.typed_csv(spark, path, {"n": "double"})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<n:string>" in pruned
    with pytest.raises(ValueError, match="missing columns"):
        files.text_csv(spark, path, ["title", "absent"])


def test_lines_that_end_in_two_signs(spark, tmp_path):
    rows = files.text_csv(spark, _put(tmp_path, "two.csv", 'a,b\r\n1,"x\ny"\r\n2,\r\n'))
    assert sorted(map(tuple, rows.collect())) == [("1", "x\ny"), ("2", "")] and rows.columns == ["a", "b"]


def test_uploads(spark, tmp_path):
    path = _put(tmp_path, "up.csv", "﻿title,url\n" + "x" * 600 + ",\n  ,u\nnan,u2\n")
    rows = sorted(map(tuple, files.upload(spark, path).collect()))
    assert rows == [("nan", None, None, "u2", None), ("x" * 500, None, None, None, None)]
    for bad, kw in ((_put(tmp_path, "no.csv", "name\na\n"), {}), (path, {"most_rows": 2}), (path, {"most_bytes": 20})):
        with pytest.raises(ValueError):
            files.upload(spark, bad, **kw)


def test_data_sets(spark, tmp_path):
    good = files.data_set(spark, _put(tmp_path, "set.csv", ODD), ["title"])
    assert str(good.schema["published_date"].dataType) == "DateType()" and good.count() == 4
    with pytest.raises(ValueError, match="missing"):
        files.data_set(spark, _put(tmp_path, "set.csv", ODD), ["symbol"])
    for name, extra, says in (("r.csv", "1,z,1,2024-02-02\n", "repeated key"), ("d.csv", "9,z,1,soon\n", "no date")):
        with pytest.raises(Exception, match=says):
            files.data_set(spark, _put(tmp_path, name, ODD + extra), ["title"]).collect()


def test_artifacts(spark, tmp_path):
    schema = "a int, b array<string>"
    read = lambda name: tuple(files.artifact(spark, f"file://{tmp_path}/{name}", schema).first())
    _put(tmp_path, "ok.json", '{"a": 1,\n "b": ["x"]}')
    _put(tmp_path, "cut.json", '{"a": 1, "b": ["x"')
    _put(tmp_path, "none.json", "")
    _put(tmp_path, "bytes.json", b"\xff\xfe\x00")
    assert read("ok.json")[0] == "READ" and read("ok.json")[1].asDict() == {"a": 1, "b": ["x"]}
    assert read("absent.json") == ("MISSING", None) and read("cut.json") == read("none.json") == read("bytes.json") == ("DAMAGED", None)


def test_graphml(spark, tmp_path):
    head = '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'
    body = '<node id="a"><data key="d0">x &amp; y</data></node><node id="b"/><node id="č"></node><edge source="a" target="b"><data key="d1">1</data></edge><edge source="b" target="č"/>'
    path = _put(tmp_path, "g.graphml", head + body + "</graph></graphml>")
    nodes, edges = files.graphml(spark, path)
    assert {r[0] for r in nodes.collect()} == {"a", "b", "č"} and {tuple(r) for r in edges.collect()} == {("a", "b"), ("b", "č")}
    assert tuple(files.graphml_counts(spark, path).first()) == (3, 2)


def test_releases_are_seen_whole(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    os.mkdir(tmp_path / "out")
    assert releases.current(spark, root) is None
    one = spark.createDataFrame([(1, 'a "q", \nb'), (2, "")], "id int, text string")
    manifest = releases.publish(spark, root, {"rows": one, "same": one}, facts={"version": "1"})
    old = releases.current(spark, root)
    assert old.endswith(manifest["release"]) and manifest["tables"]["rows"]["rows"] == 2
    folder = tmp_path / "out" / manifest["release"] / "rows"
    for f in manifest["tables"]["rows"]["files"]:
        data = (folder / f["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and len(data) == f["bytes"] and (not data or data.startswith(b"\xef\xbb\xbf"))
    assert json.loads((folder.parent / "manifest.json").read_text())["version"] == "1"
    assert sorted(tuple(r) for r in files.text_csv(spark, f"{old}/rows").collect()) == [("1", 'a "q", \nb'), ("2", "")]
    failing = one.withColumn("text", F.when(F.col("id") == 2, F.raise_error(F.lit("broken on purpose"))).otherwise("x"))
    with pytest.raises(Exception, match="broken on purpose"):
        releases.publish(spark, root, {"rows": one, "bad": failing})
    assert releases.current(spark, root) == old and releases.altered(spark, old).count() == 0
    newer = releases.publish(spark, root, {"rows": one.limit(1)}, fmt="parquet")
    assert releases.current(spark, root).endswith(newer["release"])
    changed = next(iter(folder.glob("part-*")))
    changed.write_bytes(b"changed")
    changed.with_name(f".{changed.name}.crc").unlink()
    assert [r["table"] for r in releases.altered(spark, old).collect()] == ["rows"]
    releases.write_text(spark, f"{root}/note.txt", "první\n")
    releases.write_text(spark, f"{root}/note.txt", "druhá\n")
    assert releases.read_text(spark, f"{root}/note.txt") == "druhá\n"
