"""Text expressions, Column in and Column out, all inside whole-stage codegen.

The character classes follow Python's Unicode-aware ``\\w``, ``\\s`` and ``\\d``; Java's own
shorthands are ASCII only, so the classes are written out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions import stopwords

# The bodies of the Unicode character classes.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x0b\p{Z}\x1c-\x1f\x85"

# One-word contractions that the Penn Treebank convention splits in two.
CONTRACTIONS = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"))


def collapse_whitespace(text: Column) -> Column:
    """Every run of white space becomes one space; the ends are not trimmed.

    A lone space is left alone, so that ordinary text is hardly rewritten at all.
    """
    return F.regexp_replace(text, f"[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+", " ")


def remove_links(text: Column) -> Column:
    return F.regexp_replace(text, f"http[^{SPACE}]+", "")


def remove_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}+", "")


def remove_punctuation(text: Column) -> Column:
    """Drop everything that is neither a word character (underscore included) nor white space."""
    return F.regexp_replace(text, f"[^{WORD}{SPACE}]+", "")


def remove_single_characters(text: Column) -> Column:
    return F.regexp_replace(text, f"(?<![{WORD}])[{WORD}](?![{WORD}])", "")


def clean_text(text: Column) -> Column:
    """Lower case, no links, single spaces, no digits, no punctuation, in this order.

    Spaces that stood around a removed number stay, so two in a row can occur. Digits and
    punctuation go in one pass, which equals one pass for each.
    """
    spaced = collapse_whitespace(remove_links(F.lower(text)))
    return F.regexp_replace(spaced, rf"[^\p{{L}}\p{{Nl}}\p{{No}}_{SPACE}]+", "")


def clean_author(author: Column) -> Column:
    """One joined lower-case key per author list: no punctuation, initials or spaces."""
    names = remove_single_characters(remove_punctuation(F.lower(author)))
    return F.regexp_replace(names, f"[{SPACE}]+", "")


def strip_quotes(line: Column) -> Column:
    """All leading double quotes and all trailing double quotes and line ends are dropped."""
    return F.rtrim(F.ltrim(line, F.lit('"')), F.lit('"\n'))


def parse_label(raw: Column) -> Column:
    """``SDG4.00`` -> 4; null when what is left is no integer."""
    return F.replace(F.replace(raw, F.lit("SDG"), F.lit("")), F.lit(".00"), F.lit("")).try_cast("int")


def extract_title(title: Column, strict_compat: bool = False) -> Column:
    """The text before the first sentence mark (``.``, ``?`` or ``!``).

    A title without a mark is kept whole; ``strict_compat`` cuts its last character instead.
    """
    dotted = F.translate(title, "?!", "..")
    at = F.instr(dotted, ".")
    unmarked = F.left(dotted, F.length(dotted) - 1) if strict_compat else dotted
    return F.when(at > 0, F.left(dotted, at - 1)).otherwise(unmarked)


def join_title(title: Column, abstract: Column) -> Column:
    """``title. abstract``; null when either is null."""
    return F.concat(title, F.lit(". "), abstract)


def _pieces(text: Column) -> Column:
    first_parts = "|".join(f"{first}(?={rest}(?![{WORD}]))" for first, rest in CONTRACTIONS)
    spaced = F.regexp_replace(text, f"(?<![{WORD}])({first_parts})", "$1 ")
    return F.split(spaced, f"[{SPACE}]+")


def tokenize(text: Column) -> Column:
    """Split cleaned text into tokens, contractions in their two parts."""
    return F.filter(_pieces(text), lambda token: token != "")


def remove_stopwords(tokens: Column, words: Sequence[str] = stopwords.ENGLISH) -> Column:
    """Drop stop words, case-sensitively; duplicates and order of the rest are kept."""
    return F.filter(tokens, lambda token: ~token.isin(*words))


def clean_tokens(text: Column) -> Column:
    """Cleaned text as a token list without stop words."""
    return remove_stopwords(_pieces(clean_text(text)), [*stopwords.ENGLISH, ""])


def parse_token_list(printed: Column) -> Column:
    """Read a token list that an older file holds as printed text; tokens keep their quotes."""
    return F.split(F.regexp_replace(printed, r"^\[|\]$", ""), ", ")


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of a token list, joined by one space; none when the list is shorter."""
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.slice(tokens, 1, count)
    for place in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(tokens, place, count), lambda left, right: F.concat(left, F.lit(" "), right))
    return grams


def char_ngrams(text: Column, n: int = 3) -> Column:
    """All overlapping runs of n characters: look n ahead, then step over one character."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))."), F.lit(1))


def spans(tokens: Column, window: int = 128, stride: int = 96) -> Column:
    """Overlapping token spans as ``array<struct<start, tokens>>``.

    A span begins every ``stride`` tokens until one reaches the end of the list.
    """
    rest = F.greatest(F.size(tokens) - window, F.lit(0))
    last = F.ceil(rest / F.lit(float(stride))).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(
            (i * stride).alias("start"),
            F.slice(tokens, i * stride + 1, window).alias("tokens"),
        ),
    )
