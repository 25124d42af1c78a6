import pytest
from pyspark.errors import PySparkException

from symgrain.operators import pattern
from symgrain.sources.frames import register_frames

PATTERN, ORDER = "mid string, n long, col_at array<long>, rows array<long>", "mid string, order array<long>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_frames(spark, tmp_path):
    register_frames(spark)
    some = [("a/b é", 3, [0, 1, 2, 2], [1, 0]), ("empty", 0, [0], []), ("plain", 1, [0, 0], [])]
    path = str(tmp_path / "patterns")
    spark.createDataFrame(some, PATTERN).repartition(2).write.format("frames").mode("append").save(path)
    read = spark.read.format("frames").load(path)
    assert rows(read) == sorted([(*r, None) for r in some], key=str) and read.rdd.getNumPartitions() == 3
    assert not [p for p in (tmp_path / "patterns").iterdir() if p.name.startswith("_")]
    whole = (tmp_path / "patterns" / "plain.frame").read_bytes()
    (tmp_path / "patterns" / "cut.frame").write_bytes(whole[:-3])
    (tmp_path / "patterns" / "long.frame").write_bytes(whole + b"x")
    (tmp_path / "patterns" / "none.frame").write_bytes(b"")
    faults = {r["mid"]: r["fault"] for r in spark.read.format("frames").load(path).where("fault IS NOT NULL").collect()}
    assert faults == {"cut": "cut off before a length", "long": "1 bytes too many", "none": "cut off before n"}
    orders = [("x", [2, 0, 1]), ("y", [])]
    spark.createDataFrame(orders, ORDER).write.format("frames").option("kind", "order").mode("overwrite").save(path)
    assert rows(spark.read.format("frames").option("kind", "order").load(path)) == [(*r, None) for r in orders]


def test_failed_writes_leave_nothing(spark, tmp_path):
    register_frames(spark)
    path = str(tmp_path / "p")
    good = ("kept", 1, [0, 0], [])
    spark.createDataFrame([good], PATTERN).write.format("frames").mode("append").save(path)
    for bad in ([("b", 1, [0, -1], [])], [("c", 1, [0, None], [])], [(None, 0, [0], [])], [("d", 0, [0], []), ("d", 0, [0], [])]):
        with pytest.raises(PySparkException):
            spark.createDataFrame(bad, PATTERN).repartition(2).write.format("frames").mode("overwrite").save(path)
        assert rows(spark.read.format("frames").load(path)) == [(*good, None)]
        assert [p.name for p in (tmp_path / "p").iterdir()] == ["kept.frame"]
    spark.createDataFrame([], PATTERN).write.format("frames").mode("append").save(str(tmp_path / "q"))
    assert spark.read.format("frames").load(str(tmp_path / "q")).count() == spark.read.format("frames").load(str(tmp_path / "absent")).count() == 0


def test_pieces_make_the_same_files(spark, tmp_path):
    """Written by some columns at a time, read whole; and the other way round."""
    register_frames(spark)
    links = [("m/1", 0, x) for x in range(1, 40)] + [("m/1", x, x + 1) for x in range(5, 30)] + [("two", 2, 3)]
    edges = pattern.symmetrize(spark.createDataFrame(links, "mid string, a long, b long")).cache()
    vertices = spark.createDataFrame([("m/1", i) for i in range(45)] + [("two", i) for i in range(600)] + [("bare", 0)], "mid string, id long")
    pieces = pattern.pieces(edges, vertices, 8)
    assert pieces.where("mid = 'm/1'").count() > 5 and pieces.where("size(col_at) > 9").count() == 0
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    pattern.pack(edges, vertices).write.format("frames").mode("append").save(whole)
    sorted_ = pieces.repartition(2, "mid").sortWithinPartitions("mid", "col")
    sorted_.write.format("frames").option("kind", "pieces").mode("append").save(parts)
    names = sorted(p.name for p in (tmp_path / "whole").iterdir())
    assert names == sorted(p.name for p in (tmp_path / "parts").iterdir()) and len(names) == 3
    assert all((tmp_path / "whole" / x).read_bytes() == (tmp_path / "parts" / x).read_bytes() for x in names)
    read = spark.read.format("frames").option("kind", "pieces").load(whole)
    assert read.where("mid = 'two'").count() > 1
    assert rows(pattern.unpack_pieces(read)) == rows(edges.select("mid", "a", "b"))
    spark.createDataFrame([("empty", 0, [0], [])], PATTERN).write.format("frames").mode("append").save(whole)
    data = (tmp_path / "whole" / "two.frame").read_bytes()
    for name, spoilt in {"cut": data[:-3], "long": data + b"x", "none": b"", "starts": data[:16] + data[24:32] + data[16:24] + data[32:40] + b"\x09" + data[41:]}.items():
        (tmp_path / "whole" / f"{name}.frame").write_bytes(spoilt)
    faults = {r["mid"]: r["fault"] for r in spark.read.format("frames").option("kind", "pieces").load(whole).where("fault IS NOT NULL").collect()}
    assert faults == {"cut": "cut off: 2 numbers announced", "long": "1 bytes too many", "none": "cut off before n", "starts": "column starts do not fit"}
    last = pieces.agg({"col": "max"}).first()[0]
    for bad in (sorted_.where("col > 0"), sorted_.where(f"col < {last}"), pieces.coalesce(1).sortWithinPartitions("col", "mid")):
        with pytest.raises(PySparkException):
            bad.write.format("frames").option("kind", "pieces").mode("overwrite").save(parts)
        assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == names
