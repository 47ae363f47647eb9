"""Functions over long values hold few of them as Python objects at once, and give the same for nulls, empty and bad ones."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.functions import formats as X


def test_few_values_are_held_at_once(spark):
    live = most = 0

    class Text(str):
        def __new__(cls, x):
            nonlocal live, most
            live += 1
            most = max(most, live)
            return super().__new__(cls, x)

        def __del__(self):
            nonlocal live
            live -= 1

    run = X.long_values(lambda x: None if x is None else Text(x + "!"), "string").func
    assert run(pa.array(["a", None, ""] * 1000)).to_pylist() == ["a!", None, "!"] * 1000
    assert most <= X.SLICE
    assert run(pa.array([], pa.string())).type == pa.string()


def test_same_values_over_several_slices(spark):
    df = spark.range(350).coalesce(1).selectExpr("id", "if(id % 7 = 0, null, if(id % 5 = 0, '', concat('a', id, 'é', id))) AS t")
    got = df.select("t", X.preg_replace_callback("/[0-9]+/", lambda m: f"<{m[0]}>", F.col("t")).alias("r"), X.gzuncompress(X.gzcompress(F.col("t"))).cast("string").alias("z"), X.gzdecode(F.col("t")).alias("bad"), F.col("id")).collect()
    assert len(got) == 350
    for t, r, z, bad, i in got:
        assert z == t and bad == (b"" if t == "" else None) and r == (None if t is None else t.replace(str(i), f"<{i}>"))
