"""Column functions over texts, words and pieces. Positions count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
#: A run of letters and digits, or one other sign, each with the spaces before it; or spaces at the end.
PRETOKEN = r"▁*[\p{L}\p{N}]+|▁*[^\p{L}\p{N}▁]|▁+"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def words(line: Column) -> Column:
    """What stands between white space."""
    return F.regexp_extract_all(line, F.lit(r"(\S+)"), F.lit(1))


def spaced(line: Column) -> Column:
    """What stands between single spaces; nothing for two spaces in a row."""
    return F.filter(F.split(line, " ", -1), lambda w: w != "")


def trim_end(line: Column) -> Column:
    return F.regexp_replace(line, r"\s+$", "")


def pretokens(line: Column) -> Column:
    """Words and signs, with a mark for the space before them."""
    marked = F.concat(F.lit(SPACE), F.translate(line, " ", SPACE))
    return F.regexp_extract_all(marked, F.lit(f"({PRETOKEN})"), F.lit(1))


def _spans(word: Column, most: int, body) -> Column:
    """body(start, length) for all spans of up to `most` code points; start counts from 1. Empty for an empty word."""
    size = F.char_length(word)
    longest = F.least(size, F.lit(most))
    found = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(longest, F.lit(1))),
            lambda n: F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda b: body(b, n)),
        )
    )
    return F.when(size > 0, found)


def substrings(word: Column, most: int = 10) -> Column:
    """All substrings, as often as they occur; shorter ones first. Null for an empty word."""
    return _spans(word, most, lambda b, n: F.substring(word, b, n))


def spans(word: Column, most: int = 10, wordpiece: bool = False) -> Column:
    """struct<start, end, piece>, start from 0. With wordpiece, pieces that don't begin the word have ## in front."""

    def one(b, n):
        piece = F.substring(word, b, n)
        if wordpiece:
            piece = F.when(b > 1, F.concat(F.lit("##"), piece)).otherwise(piece)
        return F.struct((b - 1).alias("start"), (b + n - 1).alias("end"), piece.alias("piece"))

    return _spans(word, most, one)


def ngrams(token: Column, order: int, overcount: bool = True) -> Column:
    """Slices of 1 to `order` code points from each position. A slice that the end cuts short is counted again with
    each length, as corpus tools with plain slicing do; overcount=False leaves those out."""
    size = F.char_length(token)
    found = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.lit(order) if overcount else F.least(F.lit(order), size - i + 1)),
                lambda n: F.substring(token, i, n),
            ),
        )
    )
    return F.when(size > 0, found)


def pairs(items: Column) -> Column:
    """struct<prev, token> of neighbours."""
    return F.when(
        F.size(items) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(items) - 1),
            lambda i: F.struct(F.get(items, i - 1).alias("prev"), F.get(items, i).alias("token")),
        ),
    )


def bucket(text: Column, buckets: int) -> Column:
    """Number of the hash bucket of a subword in FastText's tables: 32-bit FNV-1a over its bytes, each with its sign."""
    raw = F.encode(text, "UTF-8")
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
    signed = F.transform(codes, lambda b: F.when(b > 127, b + F.lit(0xFFFFFF00)).otherwise(b))
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    hashed = F.aggregate(signed, F.lit(2166136261).cast("long"), step)
    return F.when(F.octet_length(raw) == 0, F.lit(2166136261)).otherwise(hashed) % buckets


def clean_pieces(pieces: Column) -> Column:
    """Without pieces that are only marks, and without the mark of a space in front of the others."""
    marks = F.array(*[F.lit(x) for x in (SPACE, "<unk>", "<s>", "</s>")])
    return F.transform(F.filter(pieces, lambda p: ~F.array_contains(marks, p)), lambda p: F.regexp_replace(p, f"^{SPACE}", ""))
