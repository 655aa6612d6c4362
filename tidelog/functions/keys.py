"""Keys and values: limits, glob patterns, sizes, names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_KEY_BYTES = 65_536
MAX_VALUE_BYTES = 67_108_864
ENTRY_OVERHEAD = 48  # bytes that a version costs in memory besides key and value
FILE_ENTRY_OVERHEAD = 24  # bytes that a version costs in a file, by the declared size model


class StoreError(Exception):
    """Base of the errors that callers see."""


class KeyTooLarge(StoreError):
    pass


class ValueTooLarge(StoreError):
    pass


class BadPattern(StoreError):
    pass


class CommandError(StoreError):
    pass


def check_key(key: bytes | str) -> None:
    if len(key.encode() if isinstance(key, str) else key) > MAX_KEY_BYTES:
        raise KeyTooLarge(f"key is larger than {MAX_KEY_BYTES} bytes")


def check_value(value: bytes | str) -> None:
    if len(value.encode() if isinstance(value, str) else value) > MAX_VALUE_BYTES:
        raise ValueTooLarge(f"value is larger than {MAX_VALUE_BYTES} bytes")


def oversized(key: Column, value: Column) -> Column:
    """True for rows that a store refuses."""
    return (F.octet_length(key) > MAX_KEY_BYTES) | (F.coalesce(F.octet_length(value), F.lit(0)) > MAX_VALUE_BYTES)


def user_bytes(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def glob_to_regex(pattern: str) -> str:
    """An anchored Java regex for a path glob: * and ? stop at '/', classes take ranges and ^, a backslash quotes.

    Raises BadPattern for a class that is empty, reversed or open, and for a final backslash.
    """
    special = "\\^$.|?*+()[]{}-&~#"
    quote = lambda c: "\\" + c if c in special else c
    rest, out = list(pattern), ["^"]

    def member() -> str:
        if not rest or rest[0] in "-]":
            raise BadPattern(pattern)
        c = rest.pop(0)
        if c == "\\":
            if not rest:
                raise BadPattern(pattern)
            c = rest.pop(0)
        if not rest:
            raise BadPattern(pattern)
        return c

    while rest:
        c = rest.pop(0)
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if not rest:
                raise BadPattern(pattern)
            out.append(quote(rest.pop(0)))
        elif c == "[":
            negated = bool(rest) and rest[0] == "^"
            if negated:
                rest.pop(0)
            parts: list[str] = []
            while not (rest and rest[0] == "]" and parts):
                low = high = member()
                if rest[0] == "-":
                    rest.pop(0)
                    high = member()
                # A reversed range matches nothing, like an empty class part.
                if low <= high:
                    parts.append(f"{quote(low)}-{quote(high)}")
                else:
                    parts.append("")
            rest.pop(0)
            inside = "".join(parts)
            out.append(f"[{'^' * negated}{inside}]" if inside else "[\\s\\S]" if negated else "(?!)")
        else:
            out.append(quote(c))
    return "(?s)" + "".join(out) + "$"


def matches(key: Column, pattern: str) -> Column:
    return key.cast("string").rlike(glob_to_regex(pattern))


def file_name(number: Column, suffix: str = ".sst") -> Column:
    """Six digits at least, then the suffix."""
    digits = number.cast("string")
    return F.concat(F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits), F.lit(suffix))


def file_number(name: Column, suffix: str = ".sst") -> Column:
    """The number of a strictly named file, else null."""
    digits = F.regexp_extract(name, "^([0-9]{6,})" + suffix.replace(".", "\\.") + "$", 1)
    return F.when(digits != "", digits.try_cast("long"))


def shared_prefix(a: bytes, b: bytes) -> int:
    """Bytes that two keys have in common from the start."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)
