"""Comment removal that keeps line numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings may span lines and may be left open; possessive loops keep the matcher
# from recursing, so long strings and comments are safe.
_DOUBLE = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+(?:"|\\?\z)'
_SINGLE = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\\?\z)"
_LINE = r"//[^\n]*+"
_BLOCK = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)"
_CODE = r"[^\"'/]++|/"

_TOKEN = f"{_DOUBLE}|{_SINGLE}|{_LINE}|{_BLOCK}|{_CODE}"
_STRING_OR_LINE_COMMENT = f"({_DOUBLE}|{_SINGLE})|{_LINE}"


def strip_comments(source: Column) -> Column:
    """Drop ``//`` and ``/* */`` comments, keep strings and every line feed.

    Text without a comment opener is passed through, text without a block comment
    takes one replace; only the rest is cut into tokens.
    """
    def keep(token: Column) -> Column:
        return (
            F.when(token.startswith("//"), F.lit(""))
            .when(token.startswith("/*"), F.regexp_replace(token, r"[^\n]++", ""))
            .otherwise(token)
        )

    tokens = F.regexp_extract_all(source, F.lit(_TOKEN), F.lit(0))
    return (
        F.when(F.contains(source, F.lit("/*")), F.array_join(F.transform(tokens, keep), ""))
        .when(F.contains(source, F.lit("//")), F.regexp_replace(source, _STRING_OR_LINE_COMMENT, "$1"))
        .otherwise(source)
    )
