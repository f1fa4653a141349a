"""The data source of zip files."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from gustframe.sources import zipped


def test_members_larger_than_a_batch(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    n = 2 * zipped.BATCH_LINES + 7
    with zipfile.ZipFile(tmp_path / "deep" / "long.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("produkt_long.txt", "".join(f"{i};ä\r\n" for i in range(n)).encode("latin-1"))
        z.writestr("Metadaten.txt", "one\ntwo")
        z.writestr("empty.txt", "")
        z.writestr("wide.txt", "x" * (zipped.BATCH_BYTES + 5) + "\nend")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    (tmp_path / "other.txt").write_text("no zip")
    df = zipped.zip_lines(spark, str(tmp_path))
    got = {r["member"]: tuple(r)[1:] for r in df.groupBy("member").agg(F.count("*"), F.min("line_no"), F.max("line_no"), F.countDistinct("line_no"), F.max(F.length("line"))).collect()}
    assert got == {"produkt_long.txt": (n, 0, n - 1, n, 8), "Metadaten.txt": (2, 0, 1, 2, 3), "wide.txt": (2, 0, 1, 2, zipped.BATCH_BYTES + 5)}
    assert df.rdd.getNumPartitions() == 4  # a partition for each member, the empty one too
    assert df.filter("member = 'produkt_long.txt' and line != concat(line_no, ';ä')").count() == 0

    some = zipped.zip_lines(spark, (tmp_path / "deep" / "long.zip").as_uri(), members="^produkt_")
    assert some.select("member").distinct().collect() == [("produkt_long.txt",)]
    assert some.filter("line_no = 3").first()["line"] == "3;ä"


def test_no_files(spark, tmp_path):
    assert zipped.zip_lines(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        zipped.zip_lines(spark, str(tmp_path / "absent")).count()
