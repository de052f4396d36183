"""Words of a text in a form that ignores case, punctuation, spacing, markup and character form."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"<[^<>]{1,300}>")
_HIDDEN = re.compile(r"[\x00\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_MARKS = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_ENTITY = re.compile(r"&#?\w{2,8};")
_MARKED = re.compile(r"\[/?[a-z]{1,8}(?:=[^\]]{0,200})?\]|\]\([^)\s]{1,300}\)")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower-case text without markup, hidden characters and accents, in compatibility form."""
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "[" in text:
        text = _MARKED.sub(" ", text)
    if not text.isascii() or "\x00" in text:
        text = _HIDDEN.sub("", text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.casefold()


def words(text: str | None) -> list[str]:
    """Words in order; null and empty texts have none."""
    return _WORD.findall(fold(text)) if text else []
