"""Words of a text with layout, case, markup, escapes and character variants taken away."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ո": "n", "ɡ": "g", "ⅼ": "l",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "χ": "x",
    "ı": "i", "ø": "o", "đ": "d", "ł": "l",
}
_LOOKALIKES = str.maketrans(LOOKALIKES)
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20f0]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_UNICODE_ESCAPE = re.compile(r"\\+(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))")
_ESCAPE = re.compile(r"\\+[abfnrtv0\"'/]")
_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011]\s*\n[\s>#*/|;-]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_ASCII = {c: chr(c).lower() if chr(c).isalnum() else " " for c in range(128)}


def _char(match: re.Match) -> str:
    code = int(match[1] or match[2] or match[3], 16)
    return chr(code) if 32 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else " "


def words(text: str) -> list[str]:
    """The words of ``text`` in order."""
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(" ", _UNICODE_ESCAPE.sub(_char, text))
    if "%20" in text:
        text = _PERCENT.sub(lambda m: chr(int(m[1], 16)), text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))).casefold().translate(_LOOKALIKES)
        if "-\n" in text or "\u2010" in text or "\u2011" in text:
            text = _BROKEN.sub("", text)
        return _WORD.findall(text)
    if "-\n" in text or "-\r" in text:
        text = _BROKEN.sub("", text)
    return text.translate(_ASCII).split()
