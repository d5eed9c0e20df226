"""Text normal forms and phrase tests, all JVM-side.

Three views of one text are used throughout:

* the text itself, for plain substring tests and lengths;
* ``fold``: every non-ASCII word character becomes ``_``, every non-ASCII digit ``7`` (a digit no
  pattern spells out) and every blank other than a newline a space. Character for character the
  same length, and plain ASCII ``\\b \\w \\d \\s`` then mean what their Unicode forms mean;
* ``spaced``: the words of the folded text with single spaces around them and a mark for every run
  of punctuation, so that a whole-word phrase test is one ``contains``.

There are some 300 phrase tests per page, too many to scan the text for each. One hash intersection
of the page's words with the words of all phrases (``seen_words``) answers nearly all of them; the
text is scanned only for phrases of several words whose longest word is on the page.
"""

from __future__ import annotations

from collections.abc import Iterable
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftpage.functions import vocab

# Characters that count as blank: the Unicode White_Space set plus the four ASCII separators.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK_CLASS = (
    r"\t\n\x0B\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
MARK = "\x01"


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def flat(text: Column) -> Column:
    """Every blank but the newline as a plain space; the length stays.

    By patterns, as ``translate`` looks up each character of the text and most texts have none to change.
    """
    plain = F.regexp_replace(text, r"[\t\x0B\f\r\x1c\x1d\x1e\x1f]", " ")
    other = f"[[^\\x00-\\x7F]&&[{BLANK_CLASS}]]"
    return F.when(is_ascii(text), plain).otherwise(F.regexp_replace(plain, other, " "))


def fold_flat(text: Column) -> Column:
    wide = F.regexp_replace(text, r"[[^\x00-\x7F]&&\p{Nd}]", "7")
    wide = F.regexp_replace(wide, r"[[^\x00-\x7F]&&[\p{L}\p{N}]]", "_")
    return F.when(is_ascii(text), text).otherwise(wide)


def fold(text: Column) -> Column:
    return fold_flat(flat(text))


#: A run of neither word characters nor blanks, and the blanks after it. Single characters make one table, ranges a chain of tests.
MARKED = f"[^{ascii_letters}{digits}_ \\t\\n\\x0B\\f\\r]++\\s*+"


def spaced(folded: Column) -> Column:
    marked = F.regexp_replace(folded, MARKED, f" {MARK} ")
    # a single space stays as it is and costs nothing
    return F.concat(F.lit(" "), F.regexp_replace(marked, r"\s{2,}+|[\t\n\x0B\f\r]", " "), F.lit(" "))


def pivot(phrase: str) -> str:
    """The word looked up for a phrase: its longest one."""
    return max(phrase.split(), key=len)


VOCABULARY = tuple(sorted({pivot(phrase) for words in vocab.WORD_LISTS for phrase in words}))


def seen_words(spaced_text: Column) -> Column:
    """The words of the vocabulary that occur in the text."""
    wanted = F.expr("array(" + ", ".join(f"'{word}'" for word in VOCABULARY) + ")")
    return F.array_intersect(F.split(spaced_text, " "), wanted)


def _word_test(column: str, phrase: str) -> str:
    word = pivot(phrase)
    if word not in VOCABULARY:
        raise ValueError(f"phrase outside the word lists: {phrase}")
    test = f"array_contains({column}_seen, '{word}')"
    return test if word == phrase else f"({test} and contains({column}, ' {phrase} '))"


def has_word(column: str, phrases: Iterable[str]) -> Column:
    """True when one of the phrases occurs as whole words, words parted by blanks only.

    ``column`` names a ``spaced`` text; its ``seen_words`` are in ``<column>_seen``.
    """
    return F.expr(" or ".join(_word_test(column, phrase) for phrase in phrases))


def count_words(column: str, groups: Iterable[Iterable[str]]) -> Column:
    """How many groups have at least one of their phrases in the text."""
    tests = (" or ".join(_word_test(column, phrase) for phrase in group) for group in groups)
    return F.expr(" + ".join(f"int({test})" for test in tests))


def _part_test(column: str, kinds: str | None, part: str) -> str:
    whole = f"contains({column}, '{part}')"
    if kinds is None:
        return whole
    near = f"contains({kinds}, '{pivot(part)}')"
    return near if pivot(part) == part else f"({near} and {whole})"


def has_text(column: str, parts: Iterable[str]) -> Column:
    """True when one of the parts occurs anywhere, also inside a word."""
    return F.expr(" or ".join(_part_test(column, None, part) for part in parts))


def count_text(column: str, parts: Iterable[str], kinds: str) -> Column:
    """How many of the parts occur at least once.

    ``kinds`` names the different words of the text in one string; it is shorter than the text, and
    a part without blanks is in the text exactly if it is in there.
    """
    return F.expr(" + ".join(f"int({_part_test(column, kinds, part)})" for part in parts))


def text_length_of(column: str, parts: Iterable[str], kinds: str) -> Column:
    """Sum of the lengths of the parts that occur at least once."""
    return F.expr(
        " + ".join(f"if({_part_test(column, kinds, part)}, {len(part)}, 0)" for part in parts)
    )


def words(text: Column) -> Column:
    """Blank-separated words, no empty ones."""
    return flat_words(flat(text))


def flat_words(text: Column) -> Column:
    return F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), "")


def distinct_letter_words(kinds: Column) -> Column:
    """Number of words made of letters only in a ``word_kinds`` string."""
    return F.regexp_count(F.concat(F.lit(" "), kinds), F.lit(r" [a-zA-Z\p{L}]++(?=\z| )"))


def word_kinds(word_list: Column) -> Column:
    """The different words in one string."""
    return F.array_join(F.array_distinct(word_list), " ")


def number_words(word_list: Column) -> Column:
    """Number of words that are a plain figure, with or without a dollar sign."""
    line = F.concat(F.lit(" "), F.array_join(word_list, " "))
    return F.regexp_count(line, F.lit(r" \$?+[\p{Nd},]++\.?+\p{Nd}*+(?=\z| )"))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part``; 0 for an empty part."""
    gone = F.length(text) - F.length(F.replace(text, part))
    return F.when(F.length(part) > 0, (gone / F.length(part)).cast("int")).otherwise(F.lit(0))
