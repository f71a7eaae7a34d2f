import zipfile

import pytest

from tessera.sources import archives


@pytest.fixture
def session(spark):
    archives.register(spark)
    return spark


def _zip(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)


def test_entries_are_read_by_ranges(session, tmp_path):
    rows = [(f"a/{k:03d}.txt", bytes([k % 251]) * (500 + k)) for k in range(200)]
    _zip(tmp_path / "one.zip", rows, zipfile.ZIP_STORED)
    _zip(tmp_path / "two.jar", [("b/x", b"1"), ("b/x", b"2"), ("b/", b""), ("", b"")])
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "other.txt").write_bytes(b"not read")
    df = session.read.format("archive").option("splitBytes", 20_000).load(str(tmp_path))
    got = [(r["entry"], bytes(r["content"])) for r in df.where("archive like '%one.zip'").collect()]
    assert sorted(got) == rows
    assert sorted((r["entry"], r["size"], bytes(r["content"])) for r in df.where("archive like '%two.jar'").collect()) == [("", 0, b""), ("b/x", 1, b"1"), ("b/x", 1, b"2")]
    reader = archives.ArchiveReader({"path": str(tmp_path / "one.zip"), "splitBytes": "20000"})
    parts = reader.partitions()
    assert len(parts) > 5 and [p.first for p in parts[1:]] == [p.past for p in parts[:-1]] and parts[-1].past == 200
    assert session.read.format("archive").option("content", "false").load(str(tmp_path / "one.zip")).where("content is not null").count() == 0


def test_names_leave_out_partitions(spark, tmp_path):
    _zip(tmp_path / "z.zip", [(f"{'ab'[k > 99]}/{k:03d}", b"x" * 1000) for k in range(200)], zipfile.ZIP_STORED)
    reader = archives.FilteringReader({"path": str(tmp_path / "z.zip"), "splitBytes": "10000"})
    assert len(reader.partitions()) == 20
    left = list(reader.pushFilters([archives.StringStartsWith(("entry",), "b/"), archives.EqualTo(("size",), 3), archives.In(("entry",), ("b/100", "b/199", "a/001"))]))
    assert left == [archives.EqualTo(("size",), 3)] and [(p.first, p.past) for p in reader.partitions()] == [(100, 110), (190, 200)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        archives.register(spark)
        df = spark.read.format("archive").option("splitBytes", "10000").load(str(tmp_path / "z.zip"))
        hit = df.where("entry = 'b/150'")
        assert [r["entry"] for r in hit.collect()] == ["b/150"] and hit.rdd.getNumPartitions() == 1
        assert df.where("entry like 'a/%'").count() == 100 and df.where("entry = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_written_archives_come_back(session, tmp_path):
    path = str(tmp_path / "out")
    df = session.range(57).selectExpr("concat('d/', id) as entry", "if(id % 10 = 3, null, encode(repeat(id, 50), 'UTF-8')) as content").repartition(4)
    df.write.format("archive").mode("append").save(path)
    want = sorted((f"d/{k}", b"" if k % 10 == 3 else str(k).encode() * 50) for k in range(57))
    read = lambda: sorted((r["entry"], bytes(r["content"])) for r in session.read.format("archive").load(path).collect())
    assert read() == want
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(names) == 4 and all(n.startswith("part-") for n in names)
    with zipfile.ZipFile(tmp_path / "out" / names[0]) as z:
        assert z.testzip() is None
    df.limit(3).write.format("archive").mode("overwrite").save(path)
    assert len(read()) == 3


def test_broken_archives_fail_if_told_to(session, tmp_path):
    (tmp_path / "b.zip").write_bytes(b"nothing")
    assert session.read.format("archive").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="zip"):
        session.read.format("archive").option("broken", "fail").load(str(tmp_path)).count()
