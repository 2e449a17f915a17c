import pyarrow as pa

from riskloom.llm import shared
from riskloom.llm.shared import BATCH, saved, sliced


def test_workers_of_scratch_tables_get_bounded_batches(spark):
    """Rows of 64 kB: 64 MB or 10,000 rows at a time would put all of a partition before a worker at once."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(0, 200, 1, 1).selectExpr("id", "repeat('x', 65536) AS text")
    found = saved(rows.mapInArrow(sizes, "rows long, bytes long")).collect()
    assert sum(r["rows"] for r in found) == 200 and max(r["bytes"] for r in found) <= BATCH + 2 * 65536
    assert spark.conf.get(name) == before
    spark.conf.set(name, "100000")  # a smaller one of the session's holds
    try:
        found = saved(rows.mapInArrow(sizes, "rows long, bytes long")).collect()
    finally:
        spark.conf.set(name, before)
    assert sum(r["rows"] for r in found) == 200 and max(r["rows"] for r in found) <= 3


def test_texts_of_one_slice_at_a_time(monkeypatch):
    asked = []
    monkeypatch.setattr(shared, "raw_texts", lambda column, f=shared.raw_texts: asked.append(len(column)) or f(column))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["aaa", None, "é", "x" * 50, "", "bb"])], names=["id", "text"])
    parts = [(rows.column(0).to_pylist(), texts) for rows, texts in sliced([batch, batch.slice(6)], "text", 5)]
    assert parts == [([0, 1, 2], [b"aaa", b"", "é".encode()]), ([3], [b"x" * 50]), ([4, 5], [b"", b"bb"])] and asked == [3, 1, 2]
