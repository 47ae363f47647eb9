"""Typed operations: every one plans on empty tables; commands of the text protocol; batches on one key."""

import pytest
from pyspark.sql import functions as F

from quillon.engines import all_operations, engines
from quillon.engines.base import spark_type
from quillon.engines.protocol import RULES, execute, resolve


@pytest.mark.parametrize("prefix", sorted(engines()))
def test_every_operation_plans(spark, prefix):
    cls = engines()[prefix]
    for name, o in cls.operations.items():
        e = cls(spark, now=10)
        values = {"condition": "height > 0", "query": "sex=1" if prefix == "targ" else "a", "aux_queries": "array('sex=1')"}
        columns = []
        for a, t in o.arguments.items():
            k = spark_type(t)
            columns.append((F.expr(values[a]) if a == "aux_queries" else F.lit(values.get(a, "a" if k == "string" else 1 if k in ("int", "bigint", "double") else None))).cast(k).alias(a))
        out = e.batch(name, spark.range(1).select(F.lit(0).alias("rq"), *columns))
        assert "rq" in out.columns, name
        for t, df in e.state.items():
            assert df.columns == [f.name for f in type(spark.range(1).schema).fromDDL(cls.tables[t].columns)], (name, t)


def test_commands_lead_to_operations():
    names = all_operations()
    assert len(names) == 467
    for engine, rules in RULES.items():
        for r in rules:
            if "*" not in r.operation:
                assert r.operation in names, (engine, r.operation)
    assert resolve("lists", "get", "list154,16#10,2") == ("lists.getListFullLimit", {"list_id": [154], "mode": 16 | 1 << 15, "limit": 10, "offset": 2})
    assert resolve("photo", "get", "new_video7,3") == ("photo.newVideo", {"owner_id": 7, "album_id": 3})
    name, a = resolve("statsx", "incr", "counter5#77#2134C;12;RU;US;3")
    assert name == "statsx.incr" and set(a) == {x.split(":")[0] for x in names[name].split()} and a["section"] == 3 and a["mode"] == 511
    with pytest.raises(ValueError, match="no command"):
        resolve("lists", "get", "nothing")


def test_commands_in_order(spark):
    e = engines()["lists"](spark)
    execute(e, "lists", "set entry5_9", "3,10")
    execute(e, "lists", "incr value5_9", "4")
    execute(e, "lists", "incr flags5_9", "8")
    execute(e, "lists", "set entry5_2:7", "1,1")
    assert [(r["object_id"], r["total"]) for r in execute(e, "lists", "get list5#9").orderBy("pos").collect()] == [([2, 7], 2), ([9], 2)]
    assert execute(e, "lists", "get value5_9").first()["value"] == 14
    assert execute(e, "lists", "get flags5_9").first()["flags"] == 11
    execute(e, "lists", "delete list5,1")
    assert execute(e, "lists", "get count5").first()["n"] == 1


def test_batches_meet_on_a_key(spark):
    e = engines()["memcache"](spark, now=0)
    rows = spark.createDataFrame([(1, "a", 0, 0, "1"), (2, "a", 0, 0, "2"), (3, "b", 0, 0, "x")], "rq long, key string, flags int, delay int, value string")
    assert [r["ok"] for r in e.batch("memcache.add", rows).orderBy("rq").collect()] == [True, False, True]
    assert [r["value"] for r in e.batch("memcache.incr", spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 1), (4, "c", 1)], "rq long, key string, value long")).orderBy("rq").collect()] == [12, 12, None, None]
    e.batch("memcache.set", rows.withColumn("value", F.concat("value", F.lit("!"))))
    assert {r["key"]: r["value"] for r in e.state["values"].collect()} == {"a": "2!", "b": "x!"}
