"""Line, blank and byte helpers on source text, as column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions.dialect import BLANK

# The Unicode White_Space characters.
WHITE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
NOT_BLANK = r"[^\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

SNIPPET_BYTES = 140
ELLIPSIS = "…"
UNKNOWN_VERSION = "unknown"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A plain column alias may be inlined by the optimizer into a lambda and then be
    computed again for each array element; a lambda variable cannot.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def literal_rows(rows: list, schema: str) -> Column:
    """Plain values as one literal array; the optimizer parses it once for the plan."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<{schema}>")


def trim_blank(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def split_lines(text: Column) -> Column:
    """Split on line feeds only; a carriage return stays on its line."""
    return F.split(text, "\n", -1)


def lines_of_code(text: Column) -> Column:
    """Lines with anything but white space; each match runs to the end of its line."""
    return F.regexp_count(text, F.lit(NOT_BLANK + r"[^\n]*+"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def clip_bytes(text: Column, limit: int = SNIPPET_BYTES) -> Column:
    """At most ``limit`` bytes and an ellipsis; a character on the cut is left out."""
    def cut(n: int) -> Column:
        return F.substring(text.cast("binary"), 1, n).cast("string")

    whole_chars = F.coalesce(
        *[F.try_validate_utf8(cut(limit - k)) for k in range(4)],
        F.make_valid_utf8(cut(limit)),
    )
    return F.when(F.octet_length(text) > limit, F.concat(whole_chars, F.lit(ELLIPSIS))).otherwise(text)


def snippet(lines: Column, line: Column) -> Column:
    """The trimmed and clipped text of 1-based ``line``; empty when out of range."""
    text = F.coalesce(F.get(lines, line - 1), F.lit(""))
    return F.when(F.octet_length(text) <= SNIPPET_BYTES, trim_blank(text)).otherwise(
        let(trim_blank(text), clip_bytes)
    )


def solidity_version(clean: Column) -> Column:
    """Version text of the first pragma in comment-free text.

    The pattern runs on to the end of the text when no semicolon follows, so a text
    with many open pragmas is still read once.
    """
    pragma = rf"pragma{BLANK}++solidity{BLANK}([^;]++)(?:;|\z)"
    return F.when(
        F.contains(clean, F.lit("pragma")) & F.regexp_extract(clean, pragma, 0).endswith(";"),
        trim_blank(F.regexp_extract(clean, pragma, 1)),
    ).otherwise(F.lit(UNKNOWN_VERSION))
