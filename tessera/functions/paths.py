"""Target paths: normal form, rules, and conflict keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_COMPONENT, MAX_PATH = 240, 512
# Device names that a component's stem must not be.
DEVICES = ["CON", "PRN", "AUX", "NUL"] + [f"{d}{n}" for d in ("COM", "LPT") for n in range(1, 10)]


def path_parts(path: Column) -> Column:
    """Components without '.' and empty ones."""
    return F.filter(F.split(path, r"[/\\]"), lambda c: (c != "") & (c != "."))


def path_fault(path: Column) -> Column:
    """The first rule that a target path breaks, null for a good one."""
    parts = path_parts(path)
    stem = lambda c: F.upper(F.regexp_replace(F.split_part(c, F.lit("."), F.lit(1)), "[ .]+$", ""))
    return (
        F.when(path.rlike(r"^[A-Za-z]:"), "drive prefix")
        .when(path.rlike(r"^[/\\]"), "absolute")
        .when(F.exists(parts, lambda c: c == ".."), "escapes its root")
        .when(F.size(parts) == 0, "empty")
        .when(F.exists(parts, lambda c: F.length(c) > MAX_COMPONENT), "component too long")
        .when(F.exists(parts, lambda c: c.rlike("[ .]$")), "ends with space or dot")
        .when(F.exists(parts, lambda c: stem(c).isin(DEVICES)), "reserved name")
        .when(F.length(F.array_join(parts, "/")) > MAX_PATH, "too long")
    )


def normal_path(path: Column) -> Column:
    """The path with '/' between its components, null if it breaks a rule."""
    return F.when(path_fault(path).isNull(), F.array_join(path_parts(path), "/"))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def conflict_key(path: Column) -> Column:
    """Equal for paths that differ in case or Unicode form only. All-ASCII paths never reach Python."""
    return F.lower(F.when(path.rlike(r"^\p{ASCII}*$"), path).otherwise(_nfc(path)))
