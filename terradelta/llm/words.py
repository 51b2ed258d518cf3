"""Word rules shared by the operators. All work on UTF-8 bytes, where code points above 127 are bytes above 127."""

from __future__ import annotations

#: Lower-cases A-Z and turns every other ASCII character that is neither letter nor digit into a space.
_TERMS = bytes(
    c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32
    for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_TERMS).split()


def tokens(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.lower().split()
