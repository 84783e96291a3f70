"""Text expressions. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped or split into words.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# A word is a run of anything but white space; a token is a run of letters, marks and
# digits, or one other visible character.
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]+"
WORD_PART_PATTERN = r"(?U)[\p{L}\p{M}\p{N}]"
TOKEN_PATTERN = r"(?U)[\p{L}\p{M}\p{N}]+|[^\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip_text(c: Column | str) -> Column:
    """Remove Unicode white space at both ends. Looks at the ends only, unlike a regular expression."""
    return F.btrim(text_or_empty(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return strip_text(c) == ""


def has_text(c: Column | str) -> Column:
    """True when not null and not the empty string; white space counts as text."""
    return text_or_empty(c) != ""


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(WORD_PATTERN), F.lit(0))


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(TOKEN_PATTERN), F.lit(0))


def first_tokens(c: Column | str, n: int) -> Column:
    """The first ``n`` tokens. The text is read no further than the end of the last of them."""
    one = r"[\s\x1c-\x1f]*+(?:[\p{L}\p{M}\p{N}]++|[^\s\x1c-\x1f])"
    return tokens(F.regexp_extract(text_or_empty(c), rf"(?U)^(?:{one}){{0,{n}}}+", 0))


# Encoders that need only the first tokens ask for them this way.
tokens.first = first_tokens


def word_count(c: Column | str) -> Column:
    return F.size(words(c)).cast("bigint")


def token_count(c: Column | str) -> Column:
    return F.size(tokens(c)).cast("bigint")


def token_word_ratio(c: Column | str) -> Column:
    """Tokens per white-space word; NULL for a text without words."""
    return F.try_divide(token_count(c).cast("double"), word_count(c).cast("double"))


def preview_text(c: Column | str, length: int = 80) -> Column:
    """The first ``length`` code points, always followed by an ellipsis."""
    return F.concat(F.substring(text_or_empty(c), 1, length), F.lit("..."))


def preview_list(c: Column | str, length: int = 15) -> Column:
    """The first ``length`` elements in brackets, with an ellipsis only when some were left out."""
    c = col(c)
    shown = F.array_join(F.slice(c, 1, length).cast("array<string>"), ", ")
    return F.concat(F.lit("["), shown, F.lit("]"), F.when(F.size(c) > length, "...").otherwise(""))
