"""Raw payloads are stored well compressed."""

import glob

import pyarrow.parquet as pq

from panelwise.sources import raw


def test_bronze_is_written_with_zstd(spark, tmp_path):
    rows = spark.createDataFrame([("Invoice:1", "Invoice", '{"Id": "1"}'), ("Bill:2", "Bill", '{"Id": "2"}')], "record_id string, entity_type string, raw_payload string")
    raw.write_bronze(rows, f"{tmp_path}/bronze")
    files = glob.glob(f"{tmp_path}/bronze/entity_type=*/*.parquet")
    assert len(files) == 2
    assert {pq.ParquetFile(f).metadata.row_group(0).column(1).compression for f in files} == {"ZSTD"}
    assert sorted(r.record_id for r in spark.read.parquet(f"{tmp_path}/bronze").collect()) == ["Bill:2", "Invoice:1"]
