"""Arrow-batched functions for what the JVM's expressions lack: Unicode forms, folding, HTML text, mojibake."""

from __future__ import annotations

import html
import sys
import unicodedata
from collections.abc import Callable
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

from . import text as T

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
HIDDEN = ("script", "style", "noscript")


def _mapped(f: Callable[[str], str], needs: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """A function of the texts that need it: only these are sent to Python, for all others the second column counts."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return lambda c, otherwise: F.coalesce(run(F.when(needs(c), c)), otherwise)


def beyond_ascii(c: Column) -> Column:
    return F.length(c) != F.octet_length(c)


#: Blocks of frequent letters and marks, in which the characters that a function leaves alone make few ranges.
BLOCKS = ((0x80, 0x17F), (0x370, 0x3FF), (0x400, 0x45F), (0x2010, 0x2023), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _beyond(plain: Callable[[str], bool]) -> Callable[[Column], Column]:
    """Whether a text has a character outside ASCII and the plain ones of BLOCKS."""
    ranges, last = [], -2
    for low, high in BLOCKS:
        for i in range(low, high + 1):
            if plain(chr(i)):
                if i == last + 1:
                    ranges[-1][1] = i
                else:
                    ranges.append([i, i])
                last = i
    # ranges are tried one by one, so the rest of the pattern sees no ASCII
    outside = r"[^\x00-\x7f](?<![" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "])"
    return lambda c: beyond_ascii(c) & c.rlike(outside)


@cache
def _changed_by(form: str) -> Callable[[Column], Column]:
    """Whether a form may change a text: all characters are as they were, and none composes or changes places with another."""
    pairs = (unicodedata.decomposition(chr(i)) for i in range(sys.maxunicode + 1))
    second = {chr(int(d.split()[1], 16)) for d in pairs if " " in d and not d.startswith("<")}
    return _beyond(lambda x: unicodedata.normalize(form, x) == x and not unicodedata.combining(x) and x not in second)


@cache
def _folded_apart() -> Callable[[Column], Column]:
    """Whether folding a text may differ from lower case with sharp s as ss; that of a capital sigma depends on its place."""
    return _beyond(lambda x: x == "ß" or (x.casefold() == x.lower() and x not in "Σİ"))


def normalize(c: Column, form: str = "NFKC") -> Column:
    """A Unicode normal form; texts that it can't change stay in the JVM."""
    if form not in FORMS:
        raise ValueError(f"unknown Unicode form {form!r}: one of {', '.join(FORMS)} is wanted")
    return _mapped(lambda t: unicodedata.normalize(form, t), _changed_by(form))(c, c)


def casefold(c: Column) -> Column:
    """Full Unicode case folding; texts for which it is lower case with sharp s as ss stay in the JVM."""
    return _mapped(str.casefold, _folded_apart())(c, T.fold(c))


class _Text(HTMLParser):
    """Collects text outside hidden elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden and self.hidden.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(text: str, separator: str = "\n") -> str:
    """The text nodes of markup, joined by the separator; a text without angle brackets is only unescaped."""
    if "<" not in text and ">" not in text:
        return html.unescape(text)
    parser = _Text()
    parser.feed(text)
    parser.close()
    return html.unescape(separator.join(parser.parts))


def remove_html(c: Column, paragraphs: bool = True) -> Column:
    """The text of markup; texts without an angle bracket or an ampersand stay in the JVM."""
    separator = "\n" if paragraphs else " "
    return _mapped(lambda t: html_text(t, separator), lambda x: x.contains("<") | x.contains(">") | x.contains("&"))(c, c)


def repaired(text: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read again, as long as that gives valid text; curly marks as they are."""
    for _ in range(3):
        if text.isascii():
            return text
        for codec in ("cp1252", "latin-1"):
            try:
                again = text.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            break
        else:
            return text
        if again == text:
            return text
        text = again
    return text


def repair_encoding(c: Column) -> Column:
    return _mapped(repaired, beyond_ascii)(c, c)
