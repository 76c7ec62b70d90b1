"""Keyset paging with opaque cursors."""

from __future__ import annotations

import base64
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import keyset_after

MAX_PAGE, MAX_CURSOR = 100, 4096


def page(rows: DataFrame, order: list[tuple[str, bool]], size: int, after: tuple | None = None) -> DataFrame:
    """The next size + 1 rows in the order ((column, descending), ...) after a key: the extra row says that more follow."""
    if not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page size {size} is not between 1 and {MAX_PAGE}")
    if after is not None:
        rows = rows.where(keyset_after([(F.col(c), v, d) for (c, d), v in zip(order, after)]))
    return rows.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).limit(size + 1)


def encode_cursor(kind: str, key: dict[str, Any], bound: str | None = None) -> str:
    """base64url without padding of the cursor's JSON."""
    text = json.dumps({"kind": kind, "version": 1, "bound": bound, "key": key}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str | None, kind: str, bound: str | None = None) -> dict[str, Any] | None:
    """The key of a cursor of this kind; ValueError for any other text, version, kind or bound album."""
    if cursor is None:
        return None
    if len(cursor) > MAX_CURSOR:
        raise ValueError("cursor is too long")
    try:
        held = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as wrong:
        raise ValueError("cursor cannot be read") from wrong
    if not isinstance(held, dict) or (held.get("kind"), held.get("version"), held.get("bound")) != (kind, 1, bound) or not isinstance(held.get("key"), dict):
        raise ValueError("cursor does not belong here")
    return held["key"]
