"""Keys in compared form: Unicode NFC, then white space trimmed at both ends."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that count as white space at the ends of a key.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"

#: Characters in these ranges neither change under NFC nor combine with one another:
#: a text without any other character is NFC already and never leaves the JVM.
_NOT_SURELY_NFC = r"[^\x{0}-\x{2FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"


@F.arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    # pyarrow's own utf8_normalize leaves Hangul jamo uncomposed.
    return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


def ascii_only(text: Column) -> Column:
    """Whether each character is one byte: counting is cheaper than a pattern."""
    return F.octet_length(text) == F.length(text)


def nfc(text: Column) -> Column:
    """Unicode NFC. Only texts that may change are sent to Arrow. Null stays null."""
    return F.coalesce(_nfc(F.when(~ascii_only(text) & text.rlike(_NOT_SURELY_NFC), text)), text)


def compared(text: Column) -> Column:
    """The form in which keys are compared: NFC, trimmed. Null stays null."""
    return F.btrim(nfc(text), F.lit(WHITE_SPACE))


def compared_sql(column: str) -> str:
    """The same in DuckDB's SQL."""
    chars = "||".join(f"chr({ord(c)})" for c in WHITE_SPACE)
    return f"trim(nfc_normalize({column}), {chars})"
