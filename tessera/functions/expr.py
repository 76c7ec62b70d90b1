"""Scalar expressions: pairs, Hamming lanes, ratios, text and path helpers. All JVM-side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schemas import MATCH_PRIORITY

RECALL_RATIO = 0.12


def pair_low(a: str, b: str) -> Column:
    return F.least(F.col(a), F.col(b))


def pair_high(a: str, b: str) -> Column:
    return F.greatest(F.col(a), F.col(b))


def match_priority(match_type: Column) -> Column:
    """0 for the strongest evidence; unknown types come last."""
    out = F.lit(len(MATCH_PRIORITY))
    for name, rank in MATCH_PRIORITY.items():
        out = F.when(match_type == name, rank).otherwise(out)
    return out


def hamming(a: Column, b: Column) -> Column:
    """Distance of two equally long BIGINT-lane arrays, or of two BIGINTs packed as one-element arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def binary_lanes(hash_: Column, n_bytes: int) -> Column:
    """A binary hash as 64-bit lanes; a short last lane is padded with zero bits."""
    padded = F.rpad(F.hex(hash_), -(-n_bytes // 8) * 16, "0")
    lanes = [
        F.shiftleft(F.conv(F.substring(padded, 16 * k + 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(padded, 16 * k + 9, 8), 16, 10).cast("long"))
        for k in range(-(-n_bytes // 8))
    ]
    return F.array(*lanes)


def recall_radius(bits: int, ratio: float = RECALL_RATIO) -> int:
    import math

    return math.ceil(bits * ratio)


def radius_of(bits: Column, ratio: float = RECALL_RATIO) -> Column:
    """recall_radius() for hashes of each row's own number of bits."""
    return F.ceil(bits * F.lit(ratio)).cast("long")


def similarity(block_ratio: Column, fine_ratio: Column) -> Column:
    """1 less the weighted distance, held in [0, 1]."""
    return F.greatest(F.least(1 - (0.4 * block_ratio + 0.6 * fine_ratio), F.lit(1.0)), F.lit(0.0))


def information_bits(ones: Column, total: int) -> Column:
    return F.least(ones, F.lit(total) - ones)


def hex_lower(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def joined_path(*parts: Column) -> Column:
    """Parts joined by a backslash; null and empty parts are left out."""
    return F.concat_ws("\\", *[F.nullif(p, F.lit("")) for p in parts])


def without_album(path: Column, album: Column) -> Column:
    """The path below its album, for either separator; a path elsewhere stays as it is."""
    rest = F.substring(path, F.length(album) + 2, F.length(path))
    below = F.startswith(path, F.concat(album, F.lit("/"))) | F.startswith(path, F.concat(album, F.lit("\\")))
    return F.when(below, rest).otherwise(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def version_major(text: Column) -> Column:
    """The number before the first dot of the first number in a version text."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("int")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def legacy_state(state: Column) -> Column:
    """The state before an appended ': message'."""
    return F.trim(F.split_part(state, F.lit(":"), F.lit(1)))


def human_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KiB", n / 1024))
        .when(n < 1024**3, F.format_string("%.1f MiB", n / 1024**2))
        .otherwise(F.format_string("%.1f GiB", n / 1024**3))
    )


def keyset_after(columns: list[tuple[Column, object, bool]]) -> Column:
    """True for rows after a key in a mixed-direction order: (column, value, descending) from first to last.

    A row-value comparison cannot mix directions, so the prefixes are spelled out: each step needs equality before it.
    """
    out, equal = F.lit(False), F.lit(True)
    for column, value, descending in columns:
        step = column < F.lit(value) if descending else column > F.lit(value)
        out = out | (equal & step)
        equal = equal & (column == F.lit(value))
    return out


# Redaction. Each rule is one regular expression, applied in this order.
_ASSIGNED = "password|pass|pwd|pgpassword|secret|token|client_key_path"
_CREDENTIALS = r"(?i)(postgres(?:ql)?://)(?!<redacted>@)[^@]*@"
_VALUES = rf"(?i)((?:{_ASSIGNED})[^=:]*[=:])[^\s,;\"]*"
_IMAGE = r"\.(png|jpg|jpeg|webp)$"
# Keys of JSON objects whose values are hidden: secrets, and paths.
SECRET_KEYS = "password|secret|token|key_path"
PATH_KEYS = "_path$|^path$|^root$"


def redacted(text: Column) -> Column:
    """Hides database credentials, assigned secrets and path-like words; runs of blanks become one."""
    out = F.regexp_replace(text, _CREDENTIALS, "$1<redacted>@")
    out = F.regexp_replace(out, _VALUES, "$1<redacted>")

    def word(token: Column) -> Column:
        bare = F.regexp_replace(token, r"^[\"',;]+|[\"',;]+$", "")
        drive = (F.length(bare) > 3) & (F.substring(bare, 2, 1) == ":") & bare.rlike(r"[\\/]")
        image = F.lower(bare).rlike(_IMAGE)
        return F.when(drive | F.startswith(bare, F.lit("\\\\")) | image, F.replace(token, bare, F.lit("<redacted-path>"))).otherwise(token)

    return F.array_join(F.transform(F.filter(F.split(out, r"\s+"), lambda t: t != ""), word), " ")


def redacted_text(text: str) -> str:
    """redacted() for one Python string, by the same rules: for texts inside nested JSON."""
    import re

    out = re.sub(_VALUES, r"\1<redacted>", re.sub(_CREDENTIALS, r"\1<redacted>@", text))
    words = []
    for token in out.split():
        bare = token.strip("\"',;")
        drive = len(bare) > 3 and bare[1] == ":" and ("/" in bare or "\\" in bare)
        words.append(token.replace(bare, "<redacted-path>") if drive or bare.startswith("\\\\") or re.search(_IMAGE, bare.lower()) else token)
    return " ".join(words)


def sanitized_json(text: Column) -> Column:
    """JSON of any depth with the values of secret and path keys hidden and other texts redacted; null where unsound.

    The depth is unknown, so a Pandas UDF walks each text; columns and rows stay with Spark.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        import json
        import re

        def walk(value):
            if isinstance(value, str):
                return redacted_text(value)
            if isinstance(value, list):
                return [walk(v) for v in value]
            if isinstance(value, dict):
                hide = lambda k: "<redacted>" if re.search(SECRET_KEYS, k) else "<redacted-path>" if re.search(PATH_KEYS, k) else None
                return {k: hide(k.lower()) or walk(v) for k, v in value.items()}
            return value

        def one(t):
            try:
                return None if t is None else json.dumps(walk(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return texts.map(one)

    return clean(text)
