"""Header cleaning, accession extraction and header matching as Spark columns."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accession and structure-id formats of public sequence databases.
ACCESSION = r"\b([A-Z]{2}_\d+(?:\.\d+)?|[A-Z]{3}\d{5,7}(?:\.\d+)?)\b"
STRUCTURE_ID = r"\b([1-9][A-Z0-9]{3})(?:_[A-Z0-9]+)?\b"
# Fixed value: Unicode white space, spelled out because \s is ASCII-only in the JVM.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
UNICODE_SPACE = f"[{WHITE_SPACE}]"


def stripped(text: Column) -> Column:
    """Text without white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def clean_header(header: Column) -> Column:
    """Canonical header: safe brackets, no reserved characters, single underscores."""
    text = F.translate(header, "[]{}", "()()")
    text = F.regexp_replace(text, r'[?*"#%@$/\\]', "_")
    text = F.regexp_replace(stripped(text), UNICODE_SPACE + "+", "_")
    return F.regexp_replace(text, "_+", "_")


def first_token(header: Column) -> Column:
    """Text before the first white space (the record id of a FASTA header)."""
    return F.regexp_extract(header, r"(\S+)", 1)


def accession(header: Column, ignore_case: bool = False) -> Column:
    """First RefSeq/GenBank accession in a header, NULL when there is none."""
    pattern = ("(?i)" if ignore_case else "") + ACCESSION
    return F.nullif(F.regexp_extract(header, pattern, 1), F.lit(""))


def structure_ids(header: Column) -> Column:
    """All four-character structure ids of a header, lower case."""
    found = F.regexp_extract_all(header, F.lit("(?i)" + STRUCTURE_ID), F.lit(1))
    return F.transform(found, F.lower)


def simple_label(header: Column) -> Column:
    """Short node label: accession, else the field after ``|gb|``, else the first token."""
    legacy = F.split_part(F.split_part(header, F.lit("|gb|"), F.lit(2)), F.lit("|"), F.lit(1))
    has_legacy = F.contains(header, F.lit("|gb|"))
    return F.coalesce(accession(header), F.when(has_legacy, legacy), first_token(header))


SAFE_NAME = r'[<>:"/\\|?*]'


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, SAFE_NAME, "_")


def wildcard_match(text: Column, pattern: str) -> Column:
    """Shell-style wildcard over the whole text (``* ? [seq] [!seq]``)."""
    regex = fnmatch.translate(pattern)
    # Inside a set the JVM takes a bare "[" for a nested set.
    regex = re.sub(
        r"(?<!\\)\[(\^?\]?)([^\]]*)\]",
        lambda found: "[" + found[1] + re.sub(r"(?<!\\)\[", r"\\[", found[2]) + "]",
        regex,
    )
    # The JVM searches anywhere in the text, so both ends are anchored (\z is its absolute end).
    return text.rlike(r"\A" + regex.removesuffix(r"\Z").removesuffix(r"\z") + r"\z")


def header_contains(header: Column, text: str) -> Column:
    """Case-insensitive substring or whole-header wildcard match."""
    lowered, target = F.lower(header), text.lower()
    return F.contains(lowered, F.lit(target)) | wildcard_match(lowered, target)
