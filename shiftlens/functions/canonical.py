"""Canonical JSON on the JVM, byte-equal to Python's
``json.dumps(obj, sort_keys=True, separators=(",", ":"))`` for strings, integers, NULL, arrays
and objects with fixed keys. ``to_json`` is not used: it neither sorts keys nor escapes
non-ASCII characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRINTABLE_ASCII = r"^[ -~]*\z"   # \z: "$" would also match before a final newline
# fixed values: the short escapes of JSON as (Java regex, Java replacement); backslash goes first
SHORT_ESCAPE_RULES = [(r"\\", r"\\\\"), ('"', r'\\"'), (r"\n", r"\\n"), (r"\r", r"\\r"), (r"\t", r"\\t"),
                      (r"\x08", r"\\b"), (r"\x0c", r"\\f")]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _unicode_escape(ch: Column) -> Column:
    """``\\uxxxx`` (lower-case hex, a surrogate pair above U+FFFF) for one code point."""
    h = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    return F.when(F.length(h) == 8, F.concat(F.lit("\\u"), F.substring(h, 1, 4), F.lit("\\u"), F.substring(h, 5, 4))) \
        .otherwise(F.concat(F.lit("\\u"), h))


def json_str(c) -> Column:
    """A JSON string literal with ASCII-only output (``ensure_ascii``); NULL becomes ``null``.

    The short escapes are native replacements; what is left outside printable ASCII is split into
    printable runs and single code points, and only the code points are escaped one by one."""
    c = _c(c)
    esc = c
    for pattern, repl in SHORT_ESCAPE_RULES:
        esc = F.regexp_replace(esc, pattern, repl)
    pieces = F.regexp_extract_all(esc, F.lit("(?s)[ -~]+|."), 0)
    slow = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[ -~]"), p).otherwise(_unicode_escape(p))), "")
    body = F.when(esc.rlike(PRINTABLE_ASCII), esc).otherwise(slow)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_int(c) -> Column:
    c = _c(c)
    return F.when(c.isNull(), F.lit("null")).otherwise(c.cast("bigint").cast("string"))


def json_str_array(c) -> Column:
    c = _c(c)
    return F.when(c.isNull(), F.lit("null")).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform(c, json_str), ","), F.lit("]")))


def json_raw_array(c) -> Column:
    """An array of already-canonical JSON texts."""
    return F.concat(F.lit("["), F.array_join(_c(c), ","), F.lit("]"))


def json_object(fields: dict[str, Column]) -> Column:
    """``{"k":v,...}`` with keys sorted; values are JSON texts."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def digest(canonical: Column) -> Column:
    """SHA-256 hex of the canonical text's UTF-8 bytes."""
    return F.sha2(canonical, 256)
