"""Text column functions (X1-X3).  Regular expressions are written so that the
JVM (java.util.regex) and RE2 read them the same way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, spelled out so
# every regex engine agrees.
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Scripts kept besides letters, digits and '_' when cleaning
# (CJK, Hiragana, Katakana, Arabic, Tamil).
KEPT_SCRIPTS = r"\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{0600}-\x{06FF}\x{0B80}-\x{0BFF}"

PUNCT_RE = r"[^\p{L}\p{N}_" + WS + KEPT_SCRIPTS + r"]"
STRIP_RE = r"^[" + WS + r"]+|[" + WS + r"]+$"
ATTACHMENT_RE = r"!\[[^\n]*?\]\(attachment://[^\n]*?\)"
CHART_DEFAULT = "Here is the generated chart:"


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, STRIP_RE, "")


def preview(c: Column, n: int = 60) -> Column:
    """First ``n`` characters followed by '...'."""
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def strip_attachments(c: Column) -> Column:
    """Drop markdown image links to ``attachment://`` and strip; a reply that
    becomes empty gets the default sentence.  Text without attachments is kept."""
    cleaned = py_strip(F.regexp_replace(c, ATTACHMENT_RE, ""))
    return (F.when(~F.contains(c, F.lit("attachment://")), c)
            .when(F.length(cleaned) == 0, F.lit(CHART_DEFAULT))
            .otherwise(cleaned))


def normalise(c: Column) -> Column:
    """Remove punctuation outside the kept classes, strip, lower-case."""
    return F.lower(py_strip(F.regexp_replace(c, PUNCT_RE, "")))
