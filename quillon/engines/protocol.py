"""The engines' text protocol: keyed commands as typed operations.

A command is a verb (get, set, add, replace, incr, decr, delete), a key that carries the query, and a value for writes.
Each rule gives a pattern of the key and the operation with its arguments, as expressions over the key's groups (g1, g2,
...), the value (v) and its comma-separated parts (p). Commands run one by one, in order, on an engine's tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from quillon.engines.base import Engine


class Rule(NamedTuple):
    verbs: str
    key: str
    operation: str
    arguments: Callable[[list[str], str], dict]


def ints(text: str) -> list[int]:
    return [int(x) for x in re.split(r"[,:]", text) if x not in ("", None)]


def ids(text: str) -> list[list[int]]:
    """1,2:3 as [[1], [2, 3]]"""
    return [[int(n) for n in x.split(":")] for x in text.split(",") if x]


def _n(text: str | None, default: int = 0) -> int:
    return int(text) if text else default


ID, VEC = r"(-?\d+)", r"(-?\d+(?::-?\d+)*)"


def _rules(*rows: tuple) -> list[Rule]:
    return [Rule(*r) for r in rows]


def _vec(text: str) -> list[int]:
    return [int(x) for x in text.split(":")]


def _entry(g: list[str], v: str) -> dict:
    p = v.split(",")
    return {"list_id": _vec(g[0]), "object_id": _vec(g[1]), "flags": int(p[0]), "value": _n(p[1] if len(p) > 1 else ""), "date": 0}


_ON = lambda g: {"list_id": _vec(g[0]), "object_id": _vec(g[1])}
RULES: dict[str, list[Rule]] = {
    "lists": _rules(
        ("set", rf"entry{VEC}_{VEC}", "lists.setEntry", lambda g, v: _entry(g, v) | {"text": ""}), ("add", rf"entry{VEC}_{VEC}", "lists.addEntry", lambda g, v: _entry(g, v) | {"text": ""}), ("replace", rf"entry{VEC}_{VEC}", "lists.replaceEntry", _entry),
        ("delete", rf"entry{VEC}_{VEC}", "lists.deleteEntry", lambda g, v: _ON(g)), ("get", rf"entry{VEC}_{VEC}", "lists.getEntry", lambda g, v: _ON(g) | {"mode": 0xFFFF}),
        ("set replace", rf"flags{VEC}_{VEC}", "lists.changeFlags", lambda g, v: _ON(g) | dict(zip(("set_flags", "clear_flags"), ints(v) if "," in v else [int(v), -1], strict=True))), ("get", rf"flags{VEC}_{VEC}", "lists.getEntryFlags", lambda g, v: _ON(g)),
        ("incr", rf"flags{VEC}_{VEC}", "lists.incrFlags", lambda g, v: _ON(g) | {"flags": int(v)}), ("decr", rf"flags{VEC}_{VEC}", "lists.decrFlags", lambda g, v: _ON(g) | {"flags": int(v)}),
        ("set replace", rf"value{VEC}_{VEC}", "lists.setValue", lambda g, v: _ON(g) | {"value": int(v)}), ("incr", rf"value{VEC}_{VEC}", "lists.incrValue", lambda g, v: _ON(g) | {"value": int(v)}), ("decr", rf"value{VEC}_{VEC}", "lists.decrValue", lambda g, v: _ON(g) | {"value": int(v)}), ("get", rf"value{VEC}_{VEC}", "lists.getEntryValue", lambda g, v: _ON(g)),
        ("set", rf"text{VEC}_{VEC}", "lists.setEntryText", lambda g, v: _ON(g) | {"text": v}), ("get", rf"text{VEC}_{VEC}", "lists.getEntryText", lambda g, v: _ON(g)), ("get", rf"entry_pos{VEC}_{VEC}", "lists.getEntryPos", lambda g, v: {"list_id": _vec(g[0]), "object": _vec(g[1])}),
        ("get", rf"incr_value\{{?{VEC}\}}?_\{{?{VEC}\}}?_\{{?(\d+)\}}?\+=\{{?(-?\d+)\}}?", "lists.incrValueOrCreate", lambda g, v: _ON(g) | {"flags": int(g[2]), "value": int(g[3])}),
        ("get", rf"list{VEC}(?:,(\d+))?(?:#(-?\d+)(?:,(\d+))?)?", "lists.getListFullLimit", lambda g, v: {"list_id": _vec(g[0]), "mode": _n(g[1]) | 1 << 15, "limit": _n(g[2], 1 << 30), "offset": _n(g[3])}), ("delete", rf"list{VEC}", "lists.deleteList", lambda g, v: {"list_id": _vec(g[0])}),
        ("delete", rf"list{VEC},(\d+)", "lists.deleteSublist", lambda g, v: {"list_id": _vec(g[0]), "flags": int(g[1])}), ("delete", rf"list{VEC},(\d+),(\d+)", "lists.deleteSublistEx", lambda g, v: {"list_id": _vec(g[0]), "xor_mask": int(g[1]), "and_mask": int(g[2])}), ("delete", rf"object{VEC}", "lists.deleteObject", lambda g, v: {"object_id": _vec(g[0])}),
        ("set", rf"listflags{VEC},(\d+)", "lists.setListFlags", lambda g, v: {"list_id": _vec(g[0]), "flags": int(g[1]), "new_flags": int(v)}), ("get", rf"count{VEC}(?:,(\d+))?", "lists.getSublistCount", lambda g, v: {"list_id": _vec(g[0]), "mode": _n(g[1])}), ("get", rf"counts{VEC}", "lists.getSublistsCount", lambda g, v: {"list_id": _vec(g[0])}),
        ("get", rf"sortedlist{VEC},(\d+),(\d+),(\d+)#(\d+)", "lists.sortedListFullLimit", lambda g, v: {"list_id": _vec(g[0]), "xor_mask": int(g[1]), "and_mask": int(g[2]), "mode": int(g[3]) | 1 << 15, "limit": int(g[4])}), ("get", rf"datedistr{VEC},(\d+),(\d+),(\d+),(\d+)", "lists.datedistr", lambda g, v: {"list_id": _vec(g[0]), "mode": int(g[1]), "min_date": int(g[2]), "max_date": int(g[3]), "step": int(g[4])}),
        ("get", rf"intersect{VEC},(\d+):(.*)", "lists.intersect", lambda g, v: {"list_id": _vec(g[0]), "mode": int(g[1]), "object_list": ids(g[2])}), ("get", rf"subtract{VEC},(\d+):(.*)", "lists.subtract", lambda g, v: {"list_id": _vec(g[0]), "mode": int(g[1]), "object_list": ids(g[2])}), ("get", rf"sumlist{VEC},(\d+):(.*)", "lists.sumlist", lambda g, v: {"list_id": _vec(g[0]), "mode": int(g[1]), "object_list": ids(g[2])}),
    ),
    "friends": _rules(
        ("get", r"friends(\d+)_(-?\d+)", "friends.getFriends", lambda g, v: {"uid": int(g[0]), "mask": int(g[1]), "mode": 1}), ("get", r"friendcnt(\d+)_(-?\d+)", "friends.getFriendsCnt", lambda g, v: {"uid": int(g[0]), "mask": int(g[1])}), ("get", r"friend(\d+)_(\d+)", "friends.getFriend", lambda g, v: {"uid": int(g[0]), "id": int(g[1])}),
        ("set add", r"friend(\d+)_(\d+)", "friends.setFriend", lambda g, v: {"uid": int(g[0]), "friend": int(g[1]), "mask": int(v)}), ("replace", r"friend(\d+)_(\d+)", "friends.replaceFriend", lambda g, v: {"uid": int(g[0]), "friend": int(g[1]), "mask": int(v)}), ("delete", r"friend(\d+)_(\d+)", "friends.deleteFriend", lambda g, v: {"uid": int(g[0]), "friend": int(g[1])}),
        ("incr", r"friend(\d+)_(\d+)", "friends.incrFriend", lambda g, v: {"uid": int(g[0]), "friend": int(g[1]), "mask": int(v)}), ("decr", r"friend(\d+)_(\d+)", "friends.decrFriend", lambda g, v: {"uid": int(g[0]), "friend": int(g[1]), "mask": int(v)}), ("set", r"friend_cat(\d+)_(\d+)", "friends.setCatList", lambda g, v: {"uid": int(g[0]), "cat": int(g[1]), "friends": ints(v)}),
        ("delete", r"friend_cat(\d+)_(\d+)", "friends.deleteCat", lambda g, v: {"uid": int(g[0]), "cat": int(g[1])}), ("add", r"friendreq(\d+)_(\d+)", "friends.addFriendReq", lambda g, v: {"uid": int(g[0]), "friend": int(g[1]), "mask": int(v)}), ("set", r"friendreq(\d+)_(\d+)", "friends.setFriendReq", lambda g, v: {"uid": int(g[0]), "friend": int(g[1]), "mask": int(v)}), ("get", r"friendreq(\d+)_(\d+)", "friends.getFriendReq", lambda g, v: {"uid": int(g[0]), "id": int(g[1])}),
        ("delete", r"friendreq(\d+)_(\d+)", "friends.deleteFriendReq", lambda g, v: {"uid": int(g[0]), "friend": int(g[1])}), ("get", r"requests(\d+)#(\d+)", "friends.getReqs", lambda g, v: {"uid": int(g[0]), "limit": int(g[1])}), ("delete", r"requests(\d+)", "friends.deleteReqs", lambda g, v: {"uid": int(g[0])}), ("get", r"recent_friends(\d+)#(\d+)", "friends.getRecentFriends", lambda g, v: {"uid": int(g[0]), "num": int(g[1])}),
        ("set add", r"privacy(\d+)_(.+)", "friends.setPrivacy", lambda g, v: {"uid": int(g[0]), "key": g[1], "text": v}), ("replace", r"privacy(\d+)_(.+)", "friends.replacePrivacy", lambda g, v: {"uid": int(g[0]), "key": g[1], "text": v}), ("delete", r"privacy(\d+)_(.+)", "friends.deletePrivacy", lambda g, v: {"uid": int(g[0]), "key": g[1]}), ("get", r"privacy(\d+)_([^~]+)", "friends.getPrivacy", lambda g, v: {"uid": int(g[0]), "key": g[1]}),
        ("get", r"privacy(\d+)~(\d+):(.+)", "friends.checkPrivacyList", lambda g, v: {"uid": int(g[0]), "test_uid": int(g[1]), "key_list": g[2].split(",")}), ("get", r"common_friends_num(\d+):(.+)", "friends.getCommonFriendsNum", lambda g, v: {"uid": int(g[0]), "users": ints(g[1])}), ("get", r"common_friends(\d+),(\d+)", "friends.getCommonFriends", lambda g, v: {"uid": int(g[0]), "uid2": int(g[1])}), ("delete", r"user(\d+)", "friends.deleteUser", lambda g, v: {"uid": int(g[0])}),
    ),
    "cache": _rules(
        ("get", r"access(\d+):(.+)", "cache.access", lambda g, v: {"cache_id": int(g[0]), "url": g[1]}), ("set", r"file_size(\d+):(.+)", "cache.setFileSize", lambda g, v: {"cache_id": int(g[0]), "url": g[1], "size": int(v)}), ("get", r"file_size(\d+):(.+)", "cache.getFileSize", lambda g, v: {"cache_id": int(g[0]), "url": g[1]}), ("set", r"new_local_copy(\d+):(.+)", "cache.setNewLocalCopy", lambda g, v: {"cache_id": int(g[0]), "global_url": g[1], "local_url": v}),
        ("delete", r"delete_local_copy(\d+):(.+)~(.+)", "cache.deleteLocalCopy", lambda g, v: {"cache_id": int(g[0]), "global_url": g[1], "local_url": g[2]}), ("set", r"yellow_time_remaining(\d+):(.+)~(.+)", "cache.setYellowTimeRemaining", lambda g, v: {"cache_id": int(g[0]), "global_url": g[1], "local_url": g[2], "time": int(v)}), ("get", r"yellow_time_remaining(\d+):(.+)~(.+)", "cache.getYellowTime", lambda g, v: {"cache_id": int(g[0]), "global_url": g[1], "local_url": g[2]}),
        ("get", r"convert(\d+):(.+)", "cache.convert", lambda g, v: {"cache_id": int(g[0]), "url": g[1]}), ("get", r"local_copies(\d+):(.+)", "cache.getLocalCopies", lambda g, v: {"cache_id": int(g[0]), "url": g[1]}), ("get", r"acounter(\d+),(\d+):(.+)", "cache.getAcounter", lambda g, v: {"cache_id": int(g[0]), "t": int(g[1]), "url": g[2]}),
        ("get", r"top_access(\d+),(\d+),(\d+)(?:,(\d+))?(?:,(\d+))?", "cache.getTopAccess", lambda g, v: {"cache_id": int(g[0]), "t": int(g[1]), "limit": int(g[2]), "flags": _n(g[3]), "min_rate": _n(g[4])}), ("get", r"bottom_access(\d+),(\d+),(\d+)(?:,(\d+))?(?:,(\d+))?", "cache.getBottomAccess", lambda g, v: {"cache_id": int(g[0]), "t": int(g[1]), "limit": int(g[2]), "flags": _n(g[3]), "min_rate": _n(g[4])}),
        ("get", r"(top|bottom)_disk(\d+),(\d+),(\d+),(\d+),(\d+),(\d+),(\d+)", "cache.getBottomDisk", lambda g, v: dict(zip(("cache_id", "t", "limit", "flags", "node_id", "server_id", "disk_id"), map(int, g[1:]), strict=True))), ("get", r"detailed_server_stats(\d+)(?:,(\d+))?", "cache.getServerStats", lambda g, v: {"cache_id": int(g[0]), "sorting_flags": _n(g[1])}),
        ("get", r"disable_server(\d+),(\d+),(\d+)", "cache.disableServer", lambda g, v: dict(zip(("cache_id", "node_id", "server_id"), map(int, g), strict=True))), ("get", r"enable_server(\d+),(\d+),(\d+)", "cache.enableServer", lambda g, v: dict(zip(("cache_id", "node_id", "server_id"), map(int, g), strict=True))),
    ),
    "statsx": _rules(
        ("incr", r"counter(\d+)#(\d+)(?:#([12])([1-8])([1-8])([1-8])([A-P]))?(?:;(\d*);?(\w*);?(\w*);?(\d*))?", "statsx.incr", lambda g, v: _visit(g)), ("decr", r"counter(\d+)#(\d+)(?:#([12])([1-8])([1-8])([1-8])([A-P]))?(?:;(\d*);?(\w*);?(\w*);?(\d*))?", "statsx.decr", lambda g, v: _visit(g)), ("incr", r"counter(\d+):(\d+)", "statsx.incrSubcnt", lambda g, v: {"cnt_id": int(g[0]), "subcnt_id": int(g[1])}),
        ("get", r"views(\d+)", "statsx.getViews", lambda g, v: {"cnt_id": int(g[0])}), ("get", r"visitors(\d+)", "statsx.getVisitors", lambda g, v: {"cnt_id": int(g[0])}), ("get", r"counter(\d+)", "statsx.getCounter", lambda g, v: {"cnt_id": int(g[0])}), ("get", r"counter(\d+)@(\d+)", "statsx.getCounterVersion", lambda g, v: {"cnt_id": int(g[0]), "version": int(g[1])}), ("get", r"versions(\d+)", "statsx.getVersions", lambda g, v: {"cnt_id": int(g[0])}),
        ("get", r"monthly_visitors(\d+)", "statsx.getMonthlyVisitors", lambda g, v: {"cnt_id": int(g[0])}), ("get", r"monthly_views(\d+)", "statsx.getMonthlyViews", lambda g, v: {"cnt_id": int(g[0])}), ("get", r"counters_sum(\d+)_(\d+)_(\d+)", "statsx.getCountersSum", lambda g, v: {"cnt_id": int(g[0]), "from": int(g[1]), "to": int(g[2])}),
        ("get", r"enable_counter(\d+)", "statsx.enableCounter", lambda g, v: {"cnt_id": int(g[0])}), ("get", r"disable_counter(\d+)", "statsx.disableCounter", lambda g, v: {"cnt_id": int(g[0])}), ("get", r"set_timezone(\d+)#(-?\d+)", "statsx.setTimezone", lambda g, v: {"cnt_id": int(g[0]), "offset": int(g[1])}),
    ),
    "text": _rules(
        ("add set", r"newmsg(\d+)#(\d+)", "text.sendMessage", lambda g, v: {"uid": int(g[0]), "mode": 0, "flags": 0, "peer_id": 0, "text": v, "kludges": "", "date": 0, "ip": 0, "port": 0, "front": 0, "ua_hash": 0, "legacy_id": 0, "random_id": int(g[1])}), ("get", r"message(\d+)_(\d+)", "text.getMessage", lambda g, v: {"uid": int(g[0]), "local_id": int(g[1]), "flags": 0xFFFFFFF, "max_len": 0}), ("set", r"message_text(\d+)_(\d+)", "text.replaceMessageText", lambda g, v: {"uid": int(g[0]), "local_id": int(g[1]), "new_text": v}),
        ("delete", r"message(\d+)_(\d+)", "text.deleteMessage", lambda g, v: {"uid": int(g[0]), "local_id": int(g[1])}), ("delete", r"first_messages(\d+)_(\d+)", "text.deleteFirstMessages", lambda g, v: {"uid": int(g[0]), "min_local_id": int(g[1])}), ("get", r"flags(\d+)_(\d+)", "text.getMessageFlags", lambda g, v: {"uid": int(g[0]), "local_id": int(g[1])}), ("set", r"flags(\d+)_(\d+)", "text.setMessageFlags", lambda g, v: {"uid": int(g[0]), "local_id": int(g[1]), "flags": int(v)}),
        ("incr", r"flags(\d+)_(\d+)", "text.incrMessageFlags", lambda g, v: {"uid": int(g[0]), "local_id": int(g[1]), "flags": int(v)}), ("decr", r"flags(\d+)_(\d+)", "text.decrMessageFlags", lambda g, v: {"uid": int(g[0]), "local_id": int(g[1]), "flags": int(v)}), ("get", r"topmsglist(\d+)#(-?\d+),(-?\d+)", "text.topMsgList", lambda g, v: {"uid": int(g[0]), "from": int(g[1]), "to": int(g[2])}), ("get", r"peermsglist(\d+)_(-?\d+)#(-?\d+),(-?\d+)", "text.peerMsgList", lambda g, v: {"uid": int(g[0]), "peer": int(g[1]), "from": int(g[2]), "to": int(g[3])}),
        ("get", r"sublist(\d+)_(\d+):(\d+)#(-?\d+),(-?\d+)", "text.sublistShort", lambda g, v: dict(zip(("uid", "and_mask", "or_mask", "from", "to"), map(int, g), strict=True))), ("get", r"search\((\d+),(-?\d+)\)(.*)", "text.search", lambda g, v: {"uid": int(g[0]), "num": int(g[1]), "query": g[2]}), ("get", r"timestamp(\d+)", "text.getTimestamp", lambda g, v: {"uid": int(g[0])}), ("get", r"history(\d+)#(\d+),(\d+)", "text.history", lambda g, v: {"uid": int(g[0]), "timestamp": int(g[1]), "limit": int(g[2])}),
        ("get", r"p_timestamp(\d+)", "text.getPTimestamp", lambda g, v: {"uid": int(g[0])}), ("get", r"p_history(\d+)#(\d+),(\d+)", "text.pHistory", lambda g, v: {"uid": int(g[0]), "timestamp": int(g[1]), "limit": int(g[2])}), ("set", r"online(\d+)", "text.online", lambda g, v: {"uid": int(g[0]), "friends": ints(v)}), ("set", r"offline(\d+)", "text.offline", lambda g, v: {"uid": int(g[0]), "friends": ints(v)}), ("get", r"onlinefriends(\d+)(?:#(\d+))?", "text.onlineFriends", lambda g, v: {"uid": int(g[0]), "mode": _n(g[1])}),
        ("set", r"secret(\d+)", "text.setSecret", lambda g, v: {"uid": int(g[0]), "s": v}), ("get", r"secret(\d+)", "text.getSecret", lambda g, v: {"uid": int(g[0])}), ("delete", r"secret(\d+)", "text.deleteSecret", lambda g, v: {"uid": int(g[0])}), ("get", r"userdata(\d+)", "text.getUserdata", lambda g, v: {"uid": int(g[0])}), ("delete", r"userdata(\d+)", "text.deleteUserdata", lambda g, v: {"uid": int(g[0])}), ("get", r"sublists_types", "text.sublistTypes", lambda g, v: {}), ("get", r"peermsg_type", "text.peermsgType", lambda g, v: {}),
    ),
    "news": _rules(
        ("set add", r"update(\d+)", "news.update", lambda g, v: dict(zip(("id", "type", "user", "group", "owner", "place", "item"), [int(g[0]), *ints(v)], strict=True))), ("delete", r"updates(\d+)", "news.deleteUpdates", lambda g, v: {"id": int(g[0])}), ("set", r"mask(\d+)", "news.setPrivacyMask", lambda g, v: {"id": int(g[0]), "type_mask": int(v)}), ("get", r"mask(\d+)", "news.getPrivacyMask", lambda g, v: {"id": int(g[0])}),
        ("get", r"raw_updates(\d+)\[(\d+),(\d+)\]:(.*)", "news.getRawUpdates", lambda g, v: {"type_mask": int(g[0]), "start_date": int(g[1]), "end_date": int(g[2]), "user_list": ints(g[3])}), ("get", r"updates(\d+)_(\d+),(\d+)_(\d+)>(\d+)#(\d+):(.*)", "news.getGroupedUpdates", lambda g, v: {"type_mask": int(g[0]), "date": int(g[1]), "end_date": int(g[2]), "grouping": int(g[3]), "timestamp": int(g[4]), "limit": int(g[5]), "user_list": ints(g[6])}),
    ),
    "cnews": _rules(
        ("set add", r"comm_update", "cnews.update", lambda g, v: dict(zip(("type", "owner", "place", "user", "group", "item"), ints(v), strict=True))), ("delete", r"comm_updates(\d+)_(-?\d+)_(\d+)", "cnews.deleteUpdates", lambda g, v: dict(zip(("type", "owner", "place"), map(int, g), strict=True))), ("delete", r"comm_update(\d+)_(-?\d+)_(\d+)_(\d+)", "cnews.deleteUpdate", lambda g, v: dict(zip(("type", "owner", "place", "item"), map(int, g), strict=True))), ("get set", r"undelete_comm_update(\d+)_(-?\d+)_(\d+)_(\d+)", "cnews.undeleteUpdate", lambda g, v: dict(zip(("type", "owner", "place", "item"), map(int, g), strict=True))),
        ("get set add", r"add_bookmark_(\d+)_(-?\d+)_(\d+):(\d+)", "cnews.addBookmark", lambda g, v: dict(zip(("type", "owner", "place", "user_id"), map(int, g), strict=True))), ("get delete", r"del_bookmark_(\d+)_(-?\d+)_(\d+):(\d+)", "cnews.delBookmark", lambda g, v: dict(zip(("type", "owner", "place", "user_id"), map(int, g), strict=True))), ("get", r"raw_user_comm_updates\[(\d+),(\d+)\]:(\d+)", "cnews.getRawUserUpdates", lambda g, v: {"type_mask": -1, "start_date": int(g[0]), "end_date": int(g[1]), "user_id": int(g[2])}),
    ),
    "hints": _rules(
        ("get", r"hints(\d+)(?:,(\d+))?#(\d+)\((.*)\)", "hints.getHints", lambda g, v: {"user_id": int(g[0]), "type": _n(g[1]), "limit": int(g[2]), "rating_num": 0, "query": g[3]}), ("set", r"object_text(\d+),(\d+):(\d+)", "hints.setText", lambda g, v: {"user_id": int(g[0]), "type": int(g[1]), "object_id": int(g[2]), "text": v}), ("get", r"object_text(\d+),(\d+):(\d+)", "hints.getObjectText", lambda g, v: {"user_id": int(g[0]), "type": int(g[1]), "object_id": int(g[2])}),
        ("delete", r"object_text(\d+),(\d+):(\d+)", "hints.deleteObject", lambda g, v: {"user_id": int(g[0]), "type": int(g[1]), "object_id": int(g[2])}), ("incr", r"object_rating(\d+),(\d+):(\d+)", "hints.incrementRating", lambda g, v: {"user_id": int(g[0]), "type": int(g[1]), "object_id": int(g[2]), "cnt": int(v), "rating_num": 0}),
    ),
    "isearch": _rules(
        ("set", r"stat(\d+),(\d+)#(\d+)", "isearch.addSearchQuery", lambda g, v: {"user_id": int(g[0]), "type": int(g[1]), "count": int(g[2]), "query": v}), ("get", r"hints\((.*)\)", "isearch.getHints", lambda g, v: {"query": g[0]}), ("get", r"types\((.*)\)", "isearch.getTypes", lambda g, v: {"query": g[0]}), ("get", r"suggestion\((.*)\)", "isearch.getSuggestion", lambda g, v: {"query": g[0]}), ("get", r"top(\d*)", "isearch.getTop", lambda g, v: {"limit": _n(g[0], 10)}), ("get", r"best(\d*)", "isearch.getBest", lambda g, v: {"limit": _n(g[0], 10)}),
        ("set", r"add_black_list", "isearch.addBlackList", lambda g, v: {"query": v}), ("set", r"delete_black_list", "isearch.deleteBlackList", lambda g, v: {"query": v}), ("get", r"black_list", "isearch.getBlackList", lambda g, v: {}), ("get", r"black_list_force", "isearch.forceUpdateBlackList", lambda g, v: {}),
    ),
    "search": _rules(
        ("set", rf"item{VEC}#(\d+),(\d+)", "search.setItem", lambda g, v: {"id": _vec(g[0].replace("_", ":")), "rate": int(g[1]), "sate": int(g[2]), "text": v}), ("delete", rf"item{VEC}", "search.deleteItem", lambda g, v: {"id": _vec(g[0])}), ("set", rf"([a-z])ate{VEC}", "search.setRate", lambda g, v: {"id": _vec(g[1]), "rate_type": "rsdbcfghklmn".index(g[0]), "rate_value": int(v)}), ("incr", rf"([a-z])ate{VEC}", "search.incrRate", lambda g, v: {"id": _vec(g[1]), "rate_type": "rsdbcfghklmn".index(g[0]), "rate_value": int(v)}), ("get", rf"([a-z])ate{VEC}", "search.getRate", lambda g, v: {"id": _vec(g[1]), "rate_type": "rsdbcfghklmn".index(g[0])}),
        ("set", rf"hash{VEC}", "search.setHash", lambda g, v: {"id": _vec(g[0]), "hash": int(v)}), ("get", rf"hash{VEC}", "search.getHash", lambda g, v: {"id": _vec(g[0])}), ("set add", rf"tags{VEC}", "search.addTags", lambda g, v: {"id": _vec(g[0]), "tags": v}), ("delete", r"itemswithhash([0-9a-f]+)", "search.deleteWithHash", lambda g, v: {"hash": int(g[0], 16)}),
        ("get", r"search([A-Za-z?]*)#?(\d*)\((.*)\)", "search.search", lambda g, v: _searched(g)),
    ),
    "targ": _rules(
        ("get", r"disable(\d+)", "targ.adDisable", lambda g, v: {"ad": int(g[0])}), ("get", r"enable(\d+)", "targ.adEnable", lambda g, v: {"ad": int(g[0])}), ("get", r"clicks(\d+)", "targ.adClicks", lambda g, v: {"ad": int(g[0])}), ("get", r"views(\d+)", "targ.adViews", lambda g, v: {"ad": int(g[0])}), ("get", r"money(\d+)", "targ.adMoney", lambda g, v: {"ad": int(g[0])}), ("get", r"ctr(\d+)", "targ.adCtr", lambda g, v: {"ad": int(g[0])}), ("get", r"info(\d+)", "targ.adInfo", lambda g, v: {"ad": int(g[0])}), ("get", r"query(\d+)", "targ.adQuery", lambda g, v: {"ad": int(g[0])}),
        ("get", r"target(\d+)_(\d+)\((.*)\)", "targ.target", lambda g, v: {"mode": 0, "ad": int(g[0]), "cost_per_click": int(g[1]), "discount": 0, "query": g[2]}), ("get", r"search#([RIri]*)(\d+)\((.*)\)", "targ.search", lambda g, v: {"mode": (1 if "r" in g[0].lower() else 0) + (2 if "i" in g[0].lower() else 0) + (4 if g[0].isupper() else 0), "limit": int(g[1]), "user_list": [], "query": g[2]}), ("get", r"prices(\d+)#(\d+)\((.*)\)", "targ.prices", lambda g, v: {"mode": 0, "place": int(g[0]), "and_mask": 0, "xor_mask": 0, "limit": int(g[1]), "user_list": [], "query": g[2]}),
        ("get", r"audience\((.*?)\)((?:;.+)?)", "targ.audience", lambda g, v: {"mode": 0, "user_list": [], "aux_queries": [x for x in g[1].split(";") if x], "query": g[0]}), ("get", r"user_ads(\d+)#(\d+)(?:,(\d+))?", "targ.userAds", lambda g, v: {"uid": int(g[0]), "limit": int(g[1]), "flags": _n(g[2]), "and_mask": 0, "or_mask": 0, "cat_mask": 0}), ("get set", r"user_view(\d+)_(\d+)", "targ.userView", lambda g, v: {"uid": int(g[0]), "ad": int(g[1])}), ("get set", r"user_click(\d+)_(\d+)_(\d+)", "targ.userClick", lambda g, v: {"uid": int(g[0]), "ad": int(g[1]), "price": int(g[2])}),
        ("get", r"recent_views_stats#(\d+)", "targ.recentViewsStats", lambda g, v: {"mode": 0, "limit": int(g[0])}), ("get", r"recent_ad_viewers(\d+)#(\d+)", "targ.recentAdViewers", lambda g, v: {"ad": int(g[0]), "mode": 0, "limit": int(g[1])}), ("set", r"sex(\d+)", "targ.setSex", lambda g, v: {"uid": int(g[0]), "value": int(v)}), ("set", r"birthday(\d+)", "targ.setBirthday", lambda g, v: dict(zip(("uid", "day", "month", "year"), [int(g[0]), *ints(v)], strict=True))), ("set", r"city(\d+)", "targ.setCountryCity", lambda g, v: dict(zip(("uid", "country", "city"), [int(g[0]), *ints(v)], strict=True))), ("set", r"user_groups_add(\d+)", "targ.addUserGroups", lambda g, v: {"uid": int(g[0]), "groups": ints(v)}), ("delete", r"user(\d+)", "targ.deleteUser", lambda g, v: {"uid": int(g[0])}),
    ),
    "photo": _rules(
        ("get", r"new_(photo|audio|video)(\d+),(\d+)", "photo.new*", lambda g, v: {"_": g[0].capitalize(), "owner_id": int(g[1]), "album_id": int(g[2])}), ("get", r"new_album(\d+)", "photo.newAlbum", lambda g, v: {"owner_id": int(g[0])}), ("delete get", r"(?:delete_|del_)?(photo|audio|video)(\d+),(\d+)", "photo.delete*", lambda g, v: {"_": g[0].capitalize(), "owner_id": int(g[1]), "photo_id": int(g[2])}), ("get", r"restore_(photo|audio|video)(\d+),(\d+)", "photo.restore*", lambda g, v: {"_": g[0].capitalize(), "owner_id": int(g[1]), "photo_id": int(g[2])}),
        ("get", r"(photo|audio|video)s(\d+),(\d+)#(\d+),(\d+)(?:\((.*)\))?", "photo.get*s", lambda g, v: {"_": g[0].capitalize(), "owner_id": int(g[1]), "album_id": int(g[2]), "fields_mask": 255, "offset": int(g[3]), "limit": int(g[4]), "is_reverse": False, "condition": g[5] or ""}), ("get", r"(photo|audio|video)s_count(\d+),(\d+)(?:\((.*)\))?", "photo.get*sCount", lambda g, v: {"_": g[0].capitalize(), "owner_id": int(g[1]), "album_id": int(g[2]), "condition": g[3] or ""}), ("get", r"albums_count(\d+)(?:\((.*)\))?", "photo.getAlbumsCount", lambda g, v: {"owner_id": int(g[0]), "condition": g[1] or ""}),
        ("incr", r"increment_(photo|audio|video)_field(\d+),(\d+),(\w+)", "photo.increment*Field", lambda g, v: {"_": g[0].capitalize(), "owner_id": int(g[1]), "photo_id": int(g[2]), "field": g[3], "cnt": int(v)}), ("get", r"rotate_photo(\d+),(\d+),(-?\d+)", "photo.rotatePhoto", lambda g, v: {"owner_id": int(g[0]), "photo_id": int(g[1]), "dir": int(g[2])}), ("get", r"change_(photo|audio|video)_order(\d+),(\d+),(\d+)(_next)?", "photo.change*Order", lambda g, v: {"_": g[0].capitalize(), "owner_id": int(g[1]), "photo_id": int(g[2]), "id_near": int(g[3]), "is_next": bool(g[4])}),
    ),
    "memcache": _rules(
        ("set", r"(.+)", "memcache.set", lambda g, v: {"key": g[0], "flags": 0, "delay": 0, "value": v}), ("add", r"(.+)", "memcache.add", lambda g, v: {"key": g[0], "flags": 0, "delay": 0, "value": v}), ("replace", r"(.+)", "memcache.replace", lambda g, v: {"key": g[0], "flags": 0, "delay": 0, "value": v}), ("incr", r"(.+)", "memcache.incr", lambda g, v: {"key": g[0], "value": int(v)}), ("decr", r"(.+)", "memcache.decr", lambda g, v: {"key": g[0], "value": int(v)}), ("delete", r"(.+)", "memcache.delete", lambda g, v: {"key": g[0]}),
        ("get", r"(.+)\*", "memcache.getWildcard", lambda g, v: {"prefix": g[0]}), ("get", r"(.+)", "memcache.get", lambda g, v: {"key": g[0]}),
    ),
    "storage": _rules(("get", r"volumes", "storage.getVolumes", lambda g, v: {}), ("get", r"check_file(\d+),(\d+),([\d.]+)", "storage.checkFile", lambda g, v: {"volume_id": int(g[0]), "file_size": int(g[1]), "max_disk_used_space_percent": float(g[2])}), ("get", r"file(\d+),(\d+),(-?\d+)", "storage.getFile", lambda g, v: {"volume_id": int(g[0]), "local_id": int(g[1]), "secret": int(g[2])})),
    "random": _rules(("get", r"random(\d+)", "random.random", lambda g, v: {"n": int(g[0])}),),
}


def _visit(g: list[str]) -> dict:
    mode = sum(1 << i for i in range(5) if g[2 + i]) if g[2] else 0
    out = {"cnt_id": int(g[0]), "uid": int(g[1]), "sex": _n(g[2]), "age": _n(g[3]), "marital_status": _n(g[4]), "political_views": _n(g[5]), "section": ord(g[6]) - 64 if g[6] else 0, "city": _n(g[7]), "geoip_country": g[8] or "", "country": g[9] or "", "source": _n(g[10])}
    return out | {"mode": mode | (32 if g[7] else 0) | (64 if g[8] else 0) | (128 if g[9] else 0) | (256 if g[10] else 0)}


def _searched(g: list[str]) -> dict:
    from quillon.engines.search import RATINGS

    flags, rate = 0, 0
    for c in g[0]:
        flags |= {"X": 8192, "P": 16384, "U": 32, "V": 256, "T": 65536, "?": 32768}.get(c, 0)
        if c not in "XPUVT?" and c.lower() in RATINGS:
            flags, rate = flags | 2 | (4 if c.isupper() else 0), RATINGS.index(c.lower())
    return {"flags": flags, "limit": _n(g[1], 100), "rate_type": rate, "restrictions": [], "hash": 0, "use_relevance": 0.0, "opttag_coeff": 0.0, "rate_normalize": [], "priority_normalize": 0.0, "decay": None, "hash_change": 0, "query": g[2]}


def resolve(engine: str, verb: str, key: str, value: str = "") -> tuple[str, dict]:
    """The operation and arguments of a command."""
    for r in RULES[engine]:
        if verb in r.verbs.split() and (m := re.fullmatch(r.key, key, re.S)):
            arguments = r.arguments(list(m.groups()), value)
            name = r.operation.replace("*", arguments.pop("_", ""))
            return name, arguments
    raise ValueError(f"no command {verb} {key}")


def execute(engine: Engine, name: str, command: str, value: str = "") -> DataFrame:
    """``<verb> <key>`` on an engine of that name; writes take their value beside."""
    verb, _, key = command.partition(" ")
    operation, arguments = resolve(name, verb, key, value)
    return engine.call(operation, **arguments)
