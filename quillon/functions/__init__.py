"""The script runtime's functions by name; ``FUNCTIONS["substr"]`` takes and returns Columns.

Not there, as they belong to a web server or another machine: header, setcookie, ob_start, fopen and its family, system,
gethostbynamel, the openssl_ ones, rpc_queue_create and rpc_get. dbQuery and memcached_ ones are in ``quillon.sources``.
"""

from __future__ import annotations

from collections.abc import Callable


def all_functions() -> dict[str, Callable]:
    from quillon.functions import arrays, dates, files, formats, maths, strings

    return strings.NAMES | maths.NAMES | dates.NAMES | arrays.NAMES | formats.NAMES | files.NAMES
