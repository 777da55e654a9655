"""Payloads go to their archives packed; what is written is what was read, bytes that are no UTF-8 included."""

from pyspark.sql import functions as F

from panelwise.llm import warc


def test_packed_records_round_trip(spark, tmp_path):
    long = "<p>some text of a page</p>" * 80
    pages = spark.createDataFrame([(1, "http://a/x", long), (2, "http://a/y", long), (3, None, None), (4, "http://b/", ""), (None, "http://c", "ü" * 600)], "page_id long, url string, html string") \
        .unionByName(spark.sql("select 5L page_id, 'http://d' url, cast(x'ff00fe0d0a0d0a41' as string) html"))
    index, keepers, files = warc.archive_index(pages)
    packed = warc._packed(pages, keepers, files, "page_id", "url", "html")
    size = packed.agg(F.sum(F.octet_length("packed"))).first()[0]
    assert size < pages.agg(F.sum(F.octet_length("html"))).first()[0] / 4
    assert {r.id for r in packed.where("packed is null").collect()} == {1}
    archives = warc.write_archives(pages, keepers, files, f"{tmp_path}/warc")
    got = {r.id: r for r in warc.read_records(index, archives, with_payload=True).collect()}
    assert len(got) == 6 and got[1].refers_to == 2 and got[1].record_type == "revisit" and got[1].payload_bytes == len(long)
    assert bytes(got[5].payload) == bytes.fromhex("ff00fe0d0a0d0a41") and bytes(got[2].payload) == long.encode() and got[None].payload_bytes == 1200
