"""Writes of typed operations read their table once, and requests that meet on a row go by the last that fits."""

import pytest
from pyspark.sql import functions as F

from quillon.engines import engines

KEY = {"list_id": "array(1)", "object_id": "array(id % 4)"}
ROWS = [([1], [k], k, k, 10 * k) for k in range(4)]
WRITES = {
    "lists.setFlags": {**KEY, "flags": "8 + id"},
    "lists.incrFlags": {**KEY, "flags": "16 << (id DIV 4)"},
    "lists.incrValue": {**KEY, "value": "id"},
    "lists.setListFlags": {"list_id": "array(1)", "flags": "id % 3", "new_flags": "100 + id"},
    "lists.changeListFlagsEx": {"list_id": "array(1)", "xor_mask": "id", "and_mask": "7", "new_or_mask": "64", "new_nand_mask": "1"},
    "lists.deleteSublist": {"list_id": "array(1)", "flags": "id % 3"},
    "lists.deleteList": {"list_id": "array(id)"},
    "lists.addEntry": {"list_id": "array(1)", "object_id": "array(2 + id % 3)", "flags": "id", "value": "id", "date": "0", "text": "'t'"},
    "lists.replaceEntry": {"list_id": "array(1)", "object_id": "array(2 + id % 3)", "flags": "id", "value": "id", "date": "0"},
    "lists.setEntry": {"list_id": "array(1)", "object_id": "array(2 + id % 3)", "flags": "id", "value": "id", "date": "0", "text": "'t'"},
}
FLAGS_VALUES = {
    "lists.setFlags": [(12, 0), (13, 10), (14, 20), (15, 30)],
    "lists.incrFlags": [(48, 0), (49, 10), (50, 20), (51, 30)],
    "lists.incrValue": [(0, 4), (1, 16), (2, 28), (3, 40)],
    "lists.setListFlags": [(106, 0), (107, 10), (105, 20), (3, 30)],
    "lists.changeListFlagsEx": [(64, 0), (64, 10), (66, 20), (66, 30)],
    "lists.deleteSublist": [(3, 30)],
    "lists.deleteList": [],
    "lists.addEntry": [(0, 0), (1, 10), (2, 20), (3, 30), (2, 2)],
    "lists.replaceEntry": [(0, 0), (1, 10), (6, 6), (7, 7)],
    "lists.setEntry": [(0, 0), (1, 10), (6, 6), (7, 7), (5, 5)],
}


@pytest.mark.parametrize("name", sorted(WRITES))
def test_one_read_and_the_last_request(spark, tmp_path, name):
    spark.createDataFrame(ROWS, "list_id array<int>, object_id array<int>, flags int, date int, value bigint").write.parquet(f"{tmp_path}/t")
    e = engines()["lists"](spark, {"entries": spark.read.parquet(f"{tmp_path}/t")})
    e.batch(name, spark.range(8).select(F.col("id").alias("rq"), *(F.expr(x).alias(c) for c, x in WRITES[name].items())))
    now = e.state["entries"]
    assert now._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert [(r.flags, r.value) for r in now.orderBy("object_id").collect()] == FLAGS_VALUES[name]
