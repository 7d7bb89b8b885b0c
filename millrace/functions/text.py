"""Column functions on text: white space, words, sentences, lines, n-grams and cleaning.

All of them stay in the JVM. White space means the characters that Unicode calls so, with the separators 1C to 1F;
a word character is a letter, a number or the underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Character classes in the regex dialect of the JVM.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: All characters of SPACE, and the class of all but the plain space.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER_SPACE = r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
INLINE_SPACE = r"[\t\x0b\x0c\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]+(?:['’\-][\p{L}\p{N}_]+)*"
SENTENCE_END = r"(?<=[.!?])[\"')\]]*\s+"
URL = r"(?i)(?<![\p{L}\p{N}_])(?:https?://|www\.)[^\s]+"
EMAIL = r"(?i)(?<![\p{L}\p{N}_])[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}(?![\p{L}\p{N}_])"
PROSE = r".,;:!?'’\"\-–—()\[\]{}/%"


def let(df: DataFrame, **named: Column) -> DataFrame:
    """Add columns behind a generator: the optimiser then can't copy their expressions into lambdas that use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in named.items())))))


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(c, F.lit(SPACES))


def squash(c: Column) -> Column:
    """Runs of white space as one space, none at the ends. Single spaces, which are most, are no matches."""
    return F.trim(F.regexp_replace(c, rf"{OTHER_SPACE}{SPACE}*|\x20{SPACE}+", " "))


def fold(c: Column) -> Column:
    """Lower case, with sharp s as ss. See functions.arrow.casefold for the full Unicode folding."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(SPACE.replace("[", "[^", 1))


def words(c: Column) -> Column:
    """Runs of word characters with inner apostrophes and hyphens."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def space_words(c: Column) -> Column:
    """Runs of anything but white space."""
    s = squash(c)
    return F.when(s == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(s, " "))


def sentences(c: Column) -> Column:
    """Pieces of the flattened text after each full stop, exclamation or question mark; closing quotes and brackets go."""
    return F.filter(F.transform(F.split(squash(c), SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def lines(c: Column) -> Column:
    """Lines without their outer white space; blank ones are left out."""
    return F.filter(F.transform(F.split(c, LINE_END), strip), lambda s: s != "")


def ngrams(words_column: str, n: int) -> Column:
    """Runs of n neighbours of an array column, joined by spaces; none if it is shorter."""
    return F.expr(f"case when size({words_column}) < {n} then cast(array() as array<string>) else transform(sequence(0, size({words_column}) - {n}), i -> array_join(slice({words_column}, i + 1, {n}), ' ')) end")


def repeated(sorted_items: str) -> Column:
    """How many items of a sorted array column have an equal neighbour: all copies of values that occur more than once."""
    s = sorted_items
    return F.expr(f"case when size({s}) < 2 then 0 else size(filter(sequence(0, size({s}) - 1), i -> {s}[i] = get({s}, i - 1) or {s}[i] = get({s}, i + 1))) end")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to six digits, ties to even; zero if whole is zero."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part.cast("double") / whole, 6))


def strip_controls(c: Column) -> Column:
    """Without control characters other than tab, newline and carriage return."""
    return F.regexp_replace(c, r"[\p{Cc}&&[^\n\r\t]]", "")


def normalize_spacing(c: Column, paragraphs: bool = True) -> Column:
    """Unix line ends, single inner spaces, stripped lines, two newlines at most; no space before punctuation.

    The last rule removes newlines as well. paragraphs=False flattens the text to one line.
    """
    c = F.regexp_replace(c, r"\r\n?", "\n")
    if paragraphs:
        c = F.regexp_replace(c, f"{INLINE_SPACE}+", " ")
        c = F.regexp_replace(F.regexp_replace(c, r"(?m)^ +| +$", ""), r"\n{3,}", "\n\n")
    else:
        c = squash(c)
    return strip(F.regexp_replace(c, f"{SPACE}+([,.;:!?])", "$1"))


def flatten_line(c: Column) -> Column:
    """One line of a plain-text corpus."""
    return squash(c)
