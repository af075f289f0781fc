"""String and byte expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hexify(col: Column) -> Column:
    """Bytes as lower-case hex, two digits a byte."""
    return F.lower(F.hex(col))


def dehexify(col: Column) -> Column:
    """Hex text as bytes; NULL for text that is not hex."""
    return F.unhex(col)


def md5_b64_to_hex(col: Column) -> Column:
    """Base64 digest text as hex; NULL for text that is not Base64."""
    return hexify(F.try_to_binary(col, F.lit("base64")))


def utf8(col: Column) -> Column:
    """Bytes as text, with malformed sequences replaced instead of failing the job."""
    return F.make_valid_utf8(col.cast("string"))


def csv_quote(col: Column) -> Column:
    """Double the quotes and wrap the field in quotes."""
    return F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))


def parent_dir(name: Column) -> Column:
    """Directory part of an entry name; empty when there is none."""
    return F.regexp_extract(name, "^(.*)/[^/]+/?$", 1)
