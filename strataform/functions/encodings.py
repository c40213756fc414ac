"""Which encoding bytes are written in, told by rules over the bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The byte pairs of the Korean code page (its rows and columns, not which of them are assigned).
CP949 = r"(?:[\x00-\x7f]|[\x81-\xc6][\x41-\x5a\x61-\x7a\x81-\xfe]|[\xc7-\xfd][\xa1-\xfe])*+"
#: The byte sequences of UTF-8, without overlong forms, surrogates and what lies beyond the last code point.
UTF8 = r"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})*+"
CANDIDATES = {"UTF-8": UTF8, "CP949": CP949}


def readable(data: Column, encoding: str) -> Column:
    """Whether bytes are a whole text of the encoding, by an automaton over them; null bytes are null."""
    return F.decode(data, "ISO-8859-1").rlike(rf"(?s)^{CANDIDATES[encoding]}\z")


def verdict(failures: dict[str, Column]) -> Column:
    """The first candidate without failures; UNDETERMINED if all have some."""
    found = F.lit("UNDETERMINED")
    for encoding, count in reversed(failures.items()):
        found = F.when(count == 0, encoding).otherwise(found)
    return found
