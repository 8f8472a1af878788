"""Archives in many small files, and pages larger than a file."""

from __future__ import annotations

import gzip

from zephyra.llm import archives

SCHEMA = "page_id long, url string, html string"


def rows():
    made = [(i, f"http://a.b/{i}", f"<p>{'page ' * (i % 9)}{i % 13}</p>" * 4) for i in range(60)]
    return made + [(100, None, None), (None, "http://x/ö", "<p>none</p>"), (101, "http://long/", "<p>long</p>" * 5000), (102, "u", "<p>long</p>" * 5000)]


def test_files_of_bounded_size_give_the_same_pages(spark, tmp_path):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(2)
    one, many = (sorted(map(tuple, archives.archive(pages, file_bytes=n).collect()), key=str) for n in (1 << 30, 4000))
    assert one == many and len(one) == 64
    assert {r[4] for r in many if r[0] == 102} == {101}
    path = f"{tmp_path}/arc"
    archives.write_arc(pages, path, 4000)
    files = [gzip.decompress(f.read_bytes()) for f in tmp_path.glob("arc/part-*")]
    assert len(files) > 5
    for data in files:
        found = list(archives.parse_arc(data))
        assert len(data) <= 4200 or len(found) == 1
        assert all(fields.get("Offset", str(offset)) == str(offset) for offset, fields, _ in found)
    assert archives.arc_records(spark, path).count() == 64


def test_no_pages(spark):
    assert archives.archive(spark.createDataFrame([], SCHEMA)).count() == 0
