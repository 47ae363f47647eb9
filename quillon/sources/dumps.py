"""Tab-separated dumps of SQL tables, range tables and other outside formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the dumps, in their order.
DUMPS = {
    "friends": "fr_id fr_user_id fr_friend_id fr_confirmed fr_cat",
    "privacy": "mp_id mp_notify_mail mp_event_privacy mp_pm_privacy mp_wall_privacy mp_group_invitations mp_photo_privacy mp_friends_privacy mp_profile_privacy mp_m_privacy mp_h_privacy mp_i_privacy",
    "group_members": "gm_id gm_user_id gm_group_id gm_confirmed gm_who_invited",
    "blacklist": "bl_id bl_owner bl_enemy",
    "votes": "wv_id wv_user wv_option wv_voting wv_sex wv_age wv_status wv_voted",
    "education": "ed_id ed_university ed_faculty ed_graduation ed_city ed_form ed_status ed_chair ed_country ed_user_id ed_prime",
    "schools": "ms_id ms_first_name ms_last_name ms_maiden_name ms_religion ms_school ms_work ms_hometown",
    "addresses": "adr_id adr_type adr_member_id adr_country_id adr_city_id adr_district_id adr_station_id adr_street_id adr_house_id adr_house adr_place_id adr_zipcode adr_commentary adr_since adr_until",
    "inbox": "ib_id ib_from_id ib_to_id ib_to_reply ib_date ib_read_date ib_ip ib_port ib_front ib_ua_hash ib_read_state ib_to_shown ib_replied ib_title ib_message",
    "wall": "wa_id wa_from_id wa_to_id wa_date wa_to_shown wa_ip wa_port wa_front wa_hash wa_message",
    "status": "st_id st_user_id st_created st_item_text",
    "questions": "qu_id qu_owner_id qu_type qu_visibility qu_date qu_message qu_updated qu_num qu_last_post_id qu_last_poster_id qu_new_num",
    "member_fields": "mf_id mf_user_id mf_created mf_text",
}
_TEXT = re.compile(r"_(message|title|text|item_text|first_name|last_name|maiden_name|religion|school|work|hometown|house|commentary|name|description|tags|post|url)$")
_ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r"}


def schema_of(columns: str) -> str:
    """Columns that end like texts are strings, all others whole numbers."""
    return ", ".join(f"{c} {'string' if _TEXT.search(c) else 'bigint'}" for c in columns.split())


def unescaped(c: Column) -> Column:
    r"""\n, \t, \r and \\ of a dump's text as what they stand for."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    table = F.create_map(*(F.lit(x) for k, v in (_ESCAPES | {"\\\\": "\\"}).items() for x in (k, v)))
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def read_dump(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of a dump by its columns (a name in DUMPS, or the columns themselves); \\N is null; rows that don't fit have their line in ``bad``."""
    columns = DUMPS.get(columns, columns)
    schema = schema_of(columns)
    raw = spark.read.schema(schema + ", bad string").option("sep", "\t").option("quote", "").option("escape", "").option("nullValue", "\\N").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").csv(path)
    texts = [c for c in columns.split() if _TEXT.search(c)]
    return raw.withColumns({c: unescaped(F.col(c)) for c in texts}) if texts else raw


def friends_of(dump: DataFrame) -> DataFrame:
    """uid, friend, mask of a friends dump: confirmed rows, the category mask with bit 0 set."""
    return dump.where("fr_confirmed = 1").select(F.col("fr_user_id").cast("int").alias("uid"), F.col("fr_friend_id").cast("int").alias("friend"), F.col("fr_cat").bitwiseOR(F.lit(1)).cast("int").alias("mask"))


def messages_of(dump: DataFrame) -> DataFrame:
    """uid, peer_id, date, flags, text of an inbox dump; flag 1 is unread, 2 replied."""
    flags = F.when(F.col("ib_read_state") == 0, 1).otherwise(0) + F.when(F.col("ib_replied") != 0, 2).otherwise(0)
    return dump.select(F.col("ib_to_id").cast("int").alias("uid"), F.col("ib_from_id").cast("int").alias("peer_id"), F.col("ib_date").cast("int").alias("date"), flags.alias("flags"), F.concat_ws("\t", "ib_title", "ib_message").alias("text"))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """start, end, code of a table of address ranges: ``start,end,code`` as numbers or dotted addresses, or ``address/bits,code``."""
    from quillon.functions.formats import ip2ulong

    cells = F.split(F.regexp_replace("value", '"', ""), ",")
    at = lambda i: F.trim(F.get(cells, F.lit(i)))
    number = lambda c: F.coalesce(F.when(F.rlike(c, F.lit(r"^\d+$")), c.cast("bigint")), ip2ulong(c))
    mask = F.rlike(at(0), F.lit(r"^[\d.]+/\d+$"))
    base, width = ip2ulong(F.substring_index(at(0), "/", 1)), F.pow(F.lit(2.0), 32 - F.substring_index(at(0), "/", -1).cast("int")).cast("bigint")
    start = F.when(mask, base - base % width).otherwise(number(at(0)))
    end = F.when(mask, base - base % width + width - 1).otherwise(number(at(1)))
    rows = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    return rows.select(start.alias("start"), end.alias("end"), F.when(mask, at(1)).otherwise(at(2)).alias("code")).where("start <= end")


def read_jdbc(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", sql).options(**options).load()


_VERB = re.compile(r"^\s*(?:/\*.*?\*/\s*)*([a-z]+)", re.I | re.S)
_TABLE = {"select": r"\bfrom\s+`?([\w.]+)", "insert": r"\binto\s+`?([\w.]+)", "replace": r"\binto\s+`?([\w.]+)", "update": r"\bupdate\s+(?:ignore\s+)?`?([\w.]+)", "delete": r"\bfrom\s+`?([\w.]+)"}


def query_class(sql: str) -> tuple[str, str | None]:
    """read or write, and the first table of an SQL statement: what a proxy routes by."""
    m = _VERB.match(sql)
    verb = m[1].lower() if m else ""
    found = re.search(_TABLE[verb], sql, re.I) if verb in _TABLE else None
    return ("read" if verb in ("select", "show", "describe", "explain") else "write"), found[1] if found else None
