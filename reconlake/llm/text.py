"""Byte-level words that several contracts share.

Only A-Z are lower-cased and only ASCII white space separates, so that every
engine with byte or code point classes finds the same words.
"""

from __future__ import annotations

import re

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def space_words(text: str | None) -> list[bytes]:
    """Words of `[^\\x20\\x09-\\x0D]+`; bytes.split() splits at exactly these six bytes."""
    return utf8(text).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters."""
    return ALNUM.findall(utf8(text).lower())
