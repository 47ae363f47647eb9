"""Binary differences: a patch of copies and inserts that makes one value of another."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 16


def diff(old: bytes, new: bytes, block: int = BLOCK) -> bytes:
    """A patch: C offset length copies from the old value, I length bytes inserts. Blocks of the old value are found by content and matches grown both ways."""
    places: dict[bytes, int] = {}
    for i in range(0, len(old) - block + 1, block):
        places.setdefault(old[i : i + block], i)
    out, held, at = [], bytearray(), 0

    def close() -> None:
        if held:
            out.append(b"I" + struct.pack("<I", len(held)) + bytes(held))
            held.clear()

    while at < len(new):
        i = places.get(new[at : at + block]) if at + block <= len(new) else None
        if i is None:
            held.append(new[at])
            at += 1
            continue
        back = 0
        while back < len(held) and i - back > 0 and old[i - back - 1] == held[-1 - back]:
            back += 1
        if back:
            del held[-back:]
        end = block
        while i + end < len(old) and at + end < len(new) and old[i + end] == new[at + end]:
            end += 1
        close()
        out.append(b"C" + struct.pack("<II", i - back, back + end))
        at += end
    close()
    return b"".join(out)


def patch(old: bytes, changes: bytes) -> bytes:
    out, at = [], 0
    while at < len(changes):
        kind, at = changes[at : at + 1], at + 1
        if kind == b"C":
            i, n = struct.unpack_from("<II", changes, at)
            if i + n > len(old):
                raise ValueError("the patch belongs to another value")
            out.append(old[i : i + n])
            at += 8
        elif kind == b"I":
            (n,) = struct.unpack_from("<I", changes, at)
            out.append(changes[at + 4 : at + 4 + n])
            at += 4 + n
        else:
            raise ValueError("not a patch")
    return b"".join(out)


def _of(f):
    return F.udf(lambda a, b: None if a is None or b is None else f(bytes(a), bytes(b)), "binary", useArrow=True)


def diff_column(old: Column, new: Column) -> Column:
    return _of(diff)(old.cast("binary"), new.cast("binary"))


def patch_column(old: Column, changes: Column) -> Column:
    return _of(patch)(old.cast("binary"), changes)
