"""Words of a text, compared without case, accents, presentation forms, invisible characters, punctuation and markup."""

from __future__ import annotations

import html
import re
import sys
import unicodedata

INLINE = r"b|i|u|s|em|strong|span|a|sup|sub|mark|font|small|code|tt|del|ins|abbr|q|cite|wbr"
_INLINE_TAG = re.compile(rf"</?(?:{INLINE})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-z!][^<>]*>", re.I)
_LINK = re.compile(r"\]\([^()\s]*\)")
_SOFT = "­"
# marks, format characters and controls that are not white space, from their Unicode categories
_UNSEEN = {
    c: None
    for c in range(sys.maxunicode + 1)
    if (k := unicodedata.category(chr(c))) in ("Mn", "Me", "Cf") or k == "Cc" and not chr(c).isspace() or c in (0x115F, 0x1160, 0x3164, 0xFFA0)
}
_UNSEEN_BUT_SOFT = {c: v for c, v in _UNSEEN.items() if chr(c) != _SOFT}
_LINE_END = re.compile(r"(?<=\w)[-‐­][ \t]*(?:\r\n|\r|\n)[ \t>]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in their compared form; null and empty texts have none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "](" in text:
        text = _LINK.sub("] ", text)
    if text.isascii():
        text = text.translate(_ASCII_UNSEEN) if _ASCII_CONTROL.search(text) else text
        return _WORD.findall(_LINE_END.sub("", text).lower())
    text = unicodedata.normalize("NFKD", text).translate(_UNSEEN_BUT_SOFT)
    text = _LINE_END.sub("", text).replace(_SOFT, "")
    return _WORD.findall(unicodedata.normalize("NFKD", text.casefold()).translate(_UNSEEN))


_ASCII_UNSEEN = {c: None for c in range(128) if c in _UNSEEN}
_ASCII_CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]")
