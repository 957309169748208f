"""Snapshots are read as published, or refused."""

import datetime
import os
import shutil

import pytest

from annalist.sources import snapshots

AT = datetime.datetime(2031, 5, 1)


@pytest.fixture
def made(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    tables = {"a": spark.range(100).repartition(3), "b": spark.createDataFrame([], "x string, y int")}
    snapshots.publish(tables, path, AT)
    return path, tmp_path / "s"


def test_tables_come_back(spark, made):
    tables = snapshots.read(spark, made[0])
    assert sorted(r.id for r in tables["a"].collect()) == list(range(100))
    assert tables["b"].schema.simpleString() == "struct<x:string,y:int>" and tables["b"].count() == 0
    rows = snapshots.manifest(spark, made[0])
    assert {(r.format, r.snapshot_at) for r in rows.collect()} == {(1, AT)} and rows.where("table = 'a'").count() == 3
    with pytest.raises(snapshots.Refused):
        snapshots.publish({"a": spark.range(1)}, made[0], AT)


@pytest.mark.parametrize(("harm", "wrong"), [("missing", "missing"), ("extra", "unknown"), ("changed", "changed"), ("grown", "changed"), ("uncommitted", "no manifest")])
def test_anything_else_is_refused(spark, made, harm, wrong):
    path, folder = made
    file = next(f for f in sorted((folder / "tables/a").iterdir()) if f.name.startswith("part-"))
    file.with_name(f".{file.name}.crc").unlink()  # else the local file system notices first
    if harm == "missing":
        os.remove(file)
    elif harm == "extra":
        shutil.copy(file, file.with_name("part-9" + file.name[6:]))
    elif harm == "changed":
        raw = file.read_bytes()
        file.write_bytes(raw[:-20] + bytes([raw[-20] ^ 1]) + raw[-19:])
    elif harm == "grown":
        file.write_bytes(file.read_bytes() + b"x")
    else:
        os.rename(folder / "manifest", folder / "manifest.written")
    with pytest.raises(snapshots.Refused, match=wrong):
        snapshots.read(spark, path)
    if harm == "changed":  # sizes alone do not show it
        assert set(snapshots.read(spark, path, hashed=False)) == {"a", "b"}
