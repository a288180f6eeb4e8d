"""Text functions as columns of built-in functions; the few that Spark lacks are Arrow UDFs."""

from __future__ import annotations

import fnmatch
import html
import re
import unicodedata
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"([\p{L}\p{N}_]+)"
_TOKEN = r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(_WORD), F.lit(1))


def tokens(text: Column | str) -> Column:
    """Words and single signs, as they stand."""
    return F.regexp_extract_all(_c(text), F.lit(_TOKEN), F.lit(1))


def spaced_tokens(text: Column | str) -> Column:
    """Tokens with the white space around them: joined again they are the text."""
    return F.regexp_extract_all(_c(text), F.lit(r"(\s*(?:[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])\s*)"), F.lit(1))


def count_tokens(text: Column | str) -> Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0)).cast("long")


def clean_name(name: Column | str) -> Column:
    return F.upper(F.trim(_c(name)))


def clean_type(kind: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.trim(_c(kind))), r"\s+", "_")


def strip_thoughts(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"(?s)<think>.*?</think>\s*", "")


def stable_id(text: Column | str) -> Column:
    return F.substring(F.sha1(_c(text)), 1, 24)


def data_type(path: Column | str) -> Column:
    """A path's kind by its suffix."""
    kinds = {
        "text": "txt md markdown rst log tex html htm", "code": "py js ts java c cpp h go rs rb sh sql scala r", "data": "csv tsv json jsonl yaml yml xml parquet toml",
        "office": "pdf docx doc pptx xlsx", "image": "png jpg jpeg gif webp svg", "audio": "mp3 wav flac ogg", "video": "mp4 mov avi mkv webm",
    }
    suffix = F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("unknown")
    for kind, names in kinds.items():
        out = F.when(suffix.isin(*names.split()), kind).otherwise(out)
    return out


def matches_category(pattern: str, value: Column) -> Column:
    """Equal to the pattern, matched by it as a glob (`*` crosses `/`), or below it as a folder. Null and empty values match nothing."""
    glob = fnmatch.translate(pattern).replace(r"\Z", r"\z").replace("(?s:", "(?s)(?:")
    below = pattern.rstrip("/*")
    found = (value == pattern) | value.rlike("^" + glob) | value.startswith(pattern + "/")
    if below:
        found = found | value.startswith(below + "/")
    return F.coalesce((value != "") & found, F.lit(False))


_UNITS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hr": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800, "month": 30 * 86400, "mo": 30 * 86400, "y": 365 * 86400, "year": 365 * 86400}


def normalize_time(value: str | None, now: datetime | None = None) -> str | None:
    """`now`, `7d`, `2 weeks ago` as ISO text of whole seconds; other values stay as they are."""
    if value is None:
        return None
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?(\s+ago)?\s*", value.lower())
    now = now or datetime.now(timezone.utc)
    if value.strip().lower() == "now":
        delta = 0
    elif m and m[2] in _UNITS:
        delta = int(m[1]) * _UNITS[m[2]]
    else:
        return value
    return (now - timedelta(seconds=delta)).replace(microsecond=0).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro-Winkler with weight 0.1 for a common prefix of at most four characters, at any similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    other = [y for y, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else jaro_winkler_value(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(_c(a), _c(b))


def unescape_name(name: Column | str) -> Column:
    """HTML references decoded, upper case, trimmed."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else html.unescape(s).upper().strip())

    return F.pandas_udf(run, "string")(_c(name))


def slug_value(x: str | None) -> str | None:
    if x is None:
        return None
    ascii_text = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", ascii_text).strip("-")[:60].strip("-")


def slug(title: Column | str) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return x.map(slug_value)

    return F.pandas_udf(run, "string")(_c(title))
