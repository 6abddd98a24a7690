"""ZIP archives: members are tasks, any method, long members, blanks, damage."""

import zipfile

import pytest

from strandline.sources import tables


def test_members_are_read_apart(spark, tmp_path):
    want = []
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"a{a}.zip", "w") as z:
            for m in range(25):
                rows = [(f"k{a}.{m}.{i}", f" v{i} " if i % 3 else "") for i in range(30)]
                text = "key \tvalue\tunused\n" + "".join(f"{k}\t{v}\tx\n" for k, v in rows)
                z.writestr(f"m{m}.txt", text, [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2][m % 3])
                want += [(k, v.strip() or None) for k, v in rows]
            z.writestr("readme.md", "no")
            z.writestr("empty.txt", "key\tvalue\n")
    df = tables.read_zipped(spark, str(tmp_path / "*.zip"), ["value", "key"])
    assert df.columns == ["value", "key"] and sorted((r["key"], r["value"]) for r in df.collect()) == sorted(want)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        sizes = [n for n in tables.zip_members(spark, str(tmp_path / "a0.zip"), r".*\.txt").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sum(sizes) == 26 and len(sizes) > 20  # members, each in a task of its own but for chance


def test_long_and_damaged_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "long.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.txt", "key\n" + "".join(f"é{i}\n" for i in range(200_000)))
    df = tables.read_zipped(spark, str(tmp_path / "long.zip"), ["key"])
    assert df.count() == 200_000 and df.filter("key = 'é199999'").count() == 1
    raw = bytearray((tmp_path / "long.zip").read_bytes())
    at = raw.rindex(b"PK\x01\x02") + 16  # the checksum in the directory
    raw[at] ^= 255
    (tmp_path / "bad.zip").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="CRC"):
        tables.read_zipped(spark, str(tmp_path / "bad.zip"), ["key"]).collect()
