"""Skipped lines go by their place in each file, whatever they hold."""

from loam import api as t


def test_each_file_loses_its_own_first_lines_and_no_data(spark, tmp_path):
    (tmp_path / "a.csv").write_text("made by x\n1,a\nid,name\n1,a\n2,b\nid,name\n")
    (tmp_path / "b.csv").write_text("made by another tool\n\nid,name\n1,a\nmade by x,\n3,c\n")
    (tmp_path / "c.csv").write_text("short\n")
    files = [str(tmp_path / f"{x}.csv") for x in "abc"]
    got = sorted(tuple(r) for r in t.scan_csv(files, skip=2, na="").to_spark().select("id", "name").collect())
    assert got == sorted([("1", "a"), ("2", "b"), ("id", "name"), ("1", "a"), ("made by x", None), ("3", "c")], key=lambda r: (r[0], r[1] or ""))


def test_a_file_of_many_blocks_is_cut_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\ny\nid,name\n" + "".join(f"{i},n\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted(int(r.id) for r in t.scan_csv(str(tmp_path / "a.csv"), skip=2).to_spark().collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(5000))
