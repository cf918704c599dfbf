"""Texts reduced to plain words: what a reader sees, whatever the characters are."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin letters, as pairs.
LOOKALIKES = (
    "аa вb сc еe нh іi јj кk мm оo рp ѕs тt уy хx ԁd ԛq ԝw һh ӏl "
    "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT УY ХX "
    "αa βb εe ηn ιi κk νv οo ρp τt υu χx γy ωw "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
    "ıi ɡg ɑa ɩi ʟl ɴn ʀr ʏy øo Øo łl Łl đd Đd"
)


class Fold(dict):
    """For str.translate: compatibility forms taken apart, marks and invisible characters
    dropped, look-alikes of Latin letters replaced. Filled as characters come."""

    def __init__(self):
        super().__init__({ord(p[0]): p[1] for p in LOOKALIKES.split()})

    def __missing__(self, code: int):
        c = chr(code)
        if code < 128:
            out = c
        elif unicodedata.category(c) in ("Cf", "Mn", "Me", "Co", "Cn"):
            out = None
        elif c in "  \x85":
            out = "\n"
        else:
            parts = [p for p in unicodedata.normalize("NFKD", c) if unicodedata.category(p) not in ("Mn", "Me", "Cf")]
            out = "".join(self.get(ord(p), p) or "" for p in parts)
        self[code] = out
        return out


FOLD = Fold()
BLOCK_TAG = re.compile(r"<\s*/?\s*(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|pre|a|img)\b[^<>]*>", re.I)
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
BROKEN = re.compile(r"(?<=[^\W\d_])[-­]\s*\n[\s>|*#]*(?=[^\W\d_])")
ASCII_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """The text without markup and invisible characters, look-alikes replaced, words broken by
    a hyphen at a line's end joined; case, punctuation and white space stay."""
    if "&" in text and ";" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = text.translate(FOLD)
    if "<" in text:
        text = TAG.sub("", BLOCK_TAG.sub(" ", text))
    if "-\n" in text or "- \n" in text or "-\r" in text:
        text = BROKEN.sub("", text)
    return text


def words(text: str) -> list[str]:
    """Lower-case words (letters and digits) of a text."""
    text = folded(text)
    if text.isascii():
        return text.encode().translate(ASCII_WORDS).decode().split()
    return WORD.findall(text.lower())
