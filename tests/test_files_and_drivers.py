"""Files, drivers, dumps and functions that no SQL expresses."""

import datetime
import hashlib

from pyspark.sql import functions as F

from quillon.engines import engines
from quillon.functions import all_functions, dates, files, formats, maths, strings
from quillon.operators import counters, diffs
from quillon.sources import drivers, dumps


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    at = f"file://{tmp_path}/a.txt"
    assert sorted(r["line"] for r in files.file(spark, at).collect()) == ["one", "two"]
    assert files.filesize(spark, at).first()["size"] == 8
    assert files.md5_file(spark, at).first()["md5"] == hashlib.md5(b"one\ntwo\n").hexdigest()
    assert files.file_exists(spark, at) and files.copy(spark, at, at + "2") and files.unlink(spark, at) and not files.file_exists(spark, at) and files.file_exists(spark, at + "2")


def test_drivers(spark):
    cache = engines()["memcache"](spark)
    assert drivers.memcached_add(cache, "a", "1") and not drivers.memcached_add(cache, "a", "2") and not drivers.memcached_replace(cache, "b", "2")
    assert drivers.memcached_increment(cache, "a", 4) == 5 and drivers.memcached_decrement(cache, "a", 2) == 3 and drivers.memcached_set(cache, "b", "x")
    assert drivers.rpc_mc_multiget(cache, ["a", "b", "c"]) == {"a": "3", "b": "x"}
    assert drivers.memcached_delete(cache, "a") and drivers.memcached_get(cache, "a") is None and drivers.mc_get_stats(cache) == {"values": 1}
    assert drivers.rpc_tl_query_result(drivers.rpc_tl_query(cache, [("memcache.get", {"key": "b"})]))[0][0]["value"] == "x"
    assert drivers.db_num_rows(drivers.db_query(spark, "SELECT 1 AS x UNION ALL SELECT 2")) == 2 and drivers.db_query_try(spark, "SELEKT") is None
    assert drivers.db_insert_string("t", {"a": 1, "b": "it's"}) == "INSERT INTO t (a, b) VALUES (1, 'it\\'s')"
    assert dumps.query_class("/* x */ UPDATE `users` SET a = 1") == ("write", "users") and dumps.query_class("select * from a.b where 1") == ("read", "a.b")


def test_dump_rows(spark, tmp_path):
    (tmp_path / "d").write_text("1\t5\t6\t1\t4\n2\t5\t\\N\t1\t0\nbroken\n")
    rows = dumps.read_dump(spark, str(tmp_path / "d"), "friends").orderBy("fr_id").collect()
    assert [r["fr_friend_id"] for r in rows] == [None, 6, None] and sum(r["bad"] is not None for r in rows) == 1
    (tmp_path / "s").write_text("3\t8\t100\ta\\nb\\\\c\n")
    assert dumps.read_dump(spark, str(tmp_path / "s"), "status").first()["st_item_text"] == "a\nb\\c"


def test_relative_times():
    now = int(datetime.datetime(2024, 1, 31, 10, 30, tzinfo=datetime.UTC).timestamp())
    at = lambda t: datetime.datetime.fromtimestamp(dates.parse_time(t, now), datetime.UTC).strftime("%Y-%m-%d %H:%M")
    assert at("tomorrow noon") == "2024-02-01 12:00" and at("+1 month") == "2024-03-02 10:30" and at("last monday") == "2024-01-29 00:00" and at("2 days ago") == "2024-01-29 10:30"
    assert at("next friday 15:30") == "2024-02-02 15:30" and at("Wed, 31 Jan 2024 12:00:00 +0200") == "2024-01-31 10:00" and dates.parse_time("nonsense", now) is None


def test_decimals_and_texts(spark):
    assert maths.decimal("div", "1", "3", 5) == "0.33333" and maths.decimal("mul", "-0.5", "0.5", 1) == "-0.2" and maths.decimal("pow", "2", "100") == str(2**100) and maths.decimal("comp", "1.0001", "1", 3) == "0" and maths.decimal("div", "1", "0") is None
    assert one(spark, strings.wordwrap(F.lit("The quick brown fox sat over the lazy dog"), 15, "|"), strings.wordwrap(F.lit("A very long woooooooooooord."), 8, "|", True)) == ["The quick brown|fox sat over|the lazy dog", "A very|long|wooooooo|ooooord."]
    assert one(spark, strings.substr(F.lit("añb"), 1, 2), strings.strrev(F.lit("ab")), strings.stripslashes(F.lit("a\\\\b\\'c")), strings.count_chars(F.lit("aba"), 1)) == ["ñ", "ba", "a\\b'c", {97: 2, 98: 1}]
    assert formats.unserialized(formats.serialized({"a": [1, 2.5, None, True], "b": "é"})) == {"a": [1, 2.5, None, True], "b": "é"}
    assert formats.packed("A3Z4H4v", "a", b"bc", "1f2e", 258) == b"a  bc\0\0\x1f\x2e\x02\x01"
    assert len(all_functions()) > 200


def test_diffs():
    old = bytes(range(256)) * 20
    for new in (old, old[:100] + b"new" + old[90:], b"", b"other", old[3:] + old[:3]):
        assert diffs.patch(old, diffs.diff(old, new)) == new
    assert len(diffs.diff(old, old[:1000] + b"x" + old[1000:])) < 100


def test_saturating_over_runs(spark, monkeypatch):
    monkeypatch.setattr(counters, "RUN", 5)
    rows = [(k, t, ((t * 7 + k) % 10 - 3) / 12.0) for k in range(3) for t in range(0, 80, 3)]
    got = {r["k"]: r["weight"] for r in counters.saturating(spark.createDataFrame(rows, "k int, t int, y double"), ["k"], "y", "t", 40.0, ("y",)).collect()}
    for k in range(3):
        x, was = 0.0, 0
        for _, t, y in (r for r in rows if r[0] == k):
            x, was = x * 2 ** (-(t - was) / 40.0), t
            x = (x + y) / (1 + x * y)
        assert abs(got[k] - x) < 1e-9
