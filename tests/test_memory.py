import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from attestra import runtime
from attestra.llm import ngram_jaccard


def test_scratch_tables_have_small_row_groups(spark):
    blob = F.unhex(F.repeat(F.sha2(F.col("id").cast("string"), 512), 64))
    _, path = runtime.materialise(spark.range(0, 6000, 1, 1).select(blob.alias("b")), "groups", "none")
    sizes = []
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(f"{path}/{name}").metadata
            sizes += [meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)]
    runtime.discard(spark, path)
    assert sum(sizes) > 20e6 and max(sizes) < 2 * runtime.ROW_GROUP


def test_postings_come_back_in_small_batches():
    ids = [np.arange(k, k + 3 * ngram_jaccard.BATCH_POSTINGS, dtype="<i8").tobytes() for k in (0, 7)]
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([len(v) // 8 for v in ids]), pa.array(ids, pa.binary())], ["key", "n", "ids"])
    out = list(ngram_jaccard._postings(50, None, False)([rows]))
    n = 3 * ngram_jaccard.BATCH_POSTINGS
    assert max(b.num_rows for b in out) <= ngram_jaccard.BATCH_POSTINGS
    assert sum(b.num_rows for b in out) == 2 * ngram_jaccard._prefix(n, 50)
