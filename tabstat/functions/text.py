"""Text and number cleaning as Column expressions (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MISSING_TEXT_TOKENS

# All Unicode blanks. ``btrim`` with this character set strips
# them without a regex (much cheaper per row).
WS_CHARS = (
    " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Plain decimal number, optional exponent (what the reference's coercion accepts
# for the data it sees). Anything else becomes missing.
NUMBER_RE = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip leading and trailing whitespace (tabs and newlines included). A
    text that begins and ends with a visible ASCII character has none to strip,
    which two comparisons tell; the search of the blanks is for the others."""
    col = _col(c)
    bare = col.between("!", "~") & F.substring(col, -1, 1).between("!", "~")
    return F.when(bare, col).otherwise(F.btrim(col, F.lit(WS_CHARS)))


def known_text(stripped: Column, tokens: tuple[str, ...] = MISSING_TEXT_TOKENS) -> Column:
    """Stripped text; the placeholder words become NULL."""
    return F.when(stripped.isin(list(tokens)), F.lit(None).cast("string")).otherwise(stripped)


def plain_number(stripped: Column) -> Column:
    """Stripped text to double; text that is not a plain decimal number
    becomes NULL.

    The regex guard keeps Java-only forms (``1.5d``, ``0x1p3``) out, and
    ``try_cast`` keeps ANSI mode from failing the job.
    """
    return F.when(stripped.rlike(NUMBER_RE), stripped.try_cast("double"))


def clean_text(c, tokens: tuple[str, ...] = MISSING_TEXT_TOKENS) -> Column:
    """Strip whitespace; the placeholder words become NULL."""
    return known_text(strip_ws(c), tokens)


def coerce_numeric(c) -> Column:
    """Text to double; text that is not a plain decimal number becomes NULL."""
    return plain_number(strip_ws(_col(c).cast("string")))


def missing_tokens_to_null(c, tokens) -> Column:
    """CSV reader missing tokens (list parameter) to NULL."""
    col = _col(c)
    return F.when(col.isin(list(tokens)), F.lit(None).cast("string")).otherwise(col)
