"""Sequence and aligned-residue cleaning as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from simloom.functions.headers import UNICODE_SPACE

# Accepted residue codes and the 20 standard residues.
RESIDUES = "ACDEFGHIKLMNPQRSTVWYBZJXUO"
STANDARD_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
GAP_CHARACTERS = "-."

_VALID = f"[{RESIDUES}]"
_CORE = f"{_VALID}.*{_VALID}|{_VALID}"

# Symbols an embedding model accepts; everything else becomes X.
MODEL_ALPHABETS = {
    "esm": "ACDEFGHIKLMNPQRSTVWYXBZUO.-",
    "ankh": "ACDEFGHIKLMNPQRSTVWYXBZUO",
    "protbert": "ACDEFGHIKLMNPQRSTVWYX",
    "prostt5": "ACDEFGHIKLMNPQRSTVWYX",
}


def clean_sequence(sequence: Column) -> Column:
    """Upper-case, trim to the outermost residues and mask inner invalid symbols with X."""
    core = F.regexp_extract(F.upper(sequence), _CORE, 0)
    return F.regexp_replace(core, f"[^{RESIDUES}]", "X")


def stripped_symbols(sequence: Column) -> Column:
    """Array of the symbols trimmed from both ends (all of them if no residue is valid)."""
    upper = F.upper(sequence)
    core = F.regexp_extract(upper, _CORE, 0)
    start = F.when(core == "", F.length(upper) + 1).otherwise(F.instr(upper, core))
    head = F.substring(upper, F.lit(1), start - 1)
    tail = F.substring(upper, start + F.length(core), F.length(upper))
    return symbols(F.concat(head, tail))


def masked_symbols(sequence: Column) -> Column:
    """Array of the invalid symbols inside the core that :func:`clean_sequence` masks."""
    core = F.regexp_extract(F.upper(sequence), _CORE, 0)
    return symbols(F.regexp_replace(core, _VALID, ""))


def symbols(text: Column) -> Column:
    """Characters of a text as an array (empty for an empty text)."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def clean_aligned(sequence: Column) -> Column:
    """Position-preserving cleanup of an aligned sequence: dots are gaps, illegal is X."""
    text = F.regexp_replace(sequence, UNICODE_SPACE, "")
    # One symbol stays one column, so upper-casing must not expand any (all 26 letters are codes).
    text = F.translate(text, "ıſ.", "IS-")
    return F.upper(F.regexp_replace(text, "[^A-Za-z-]", "X"))


def clean_for_model(sequence: Column, model: str) -> Column:
    """Core of a sequence in the alphabet of one embedding model family."""
    core = F.regexp_extract(F.upper(sequence), _CORE, 0)
    return F.regexp_replace(core, f"[^{MODEL_ALPHABETS[model]}]", "X")


def standard_codes(sequence: Column) -> Column:
    """Standard residues as 0..19 and every other symbol as -1."""
    return F.transform(
        symbols(F.upper(sequence)), lambda c: F.instr(F.lit(STANDARD_RESIDUES), c) - 1
    )
