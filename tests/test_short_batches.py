import pyarrow as pa
from pyspark.sql import functions as F
from tidemill.plans.search_queries import texts

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_python_gets_texts_in_short_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "10000")
    try:
        rows, most = texts(spark, "/root/testdata/sf0.01").mapInArrow(sizes, "n long").agg(F.sum("n"), F.max("n")).first()
    finally:
        spark.conf.set(BATCH, before)
    assert rows == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count() > 500 >= most
