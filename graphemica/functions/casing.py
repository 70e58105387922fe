"""Case folding and mapping of columns."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphemica.kernels import casing as kernel
from graphemica.kernels.locales import casing_locale


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@functools.lru_cache(1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, what each folds to, characters that fold to several), by the rule of the Unicode tables."""
    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)]
    one = [c for c in chars if len(c.casefold()) == 1]
    return "".join(one), "".join(c.casefold() for c in one), tuple((c, c.casefold()) for c in chars if len(c.casefold()) > 1)


def fold(text: Column | str, mode: str | None = None) -> Column:
    """Full case folding as an expression: nothing leaves the JVM, and it can be a join or grouping key.

    Rows of Latin-1 take ``lower`` and the two Latin-1 letters that fold otherwise; others one ``translate``
    for the one-to-one folds; only rows that hold one of the hundred characters that fold to several take the
    replacements.
    """
    c = _col(text)
    if kernel.is_turkic(mode):
        c = F.translate(c, "\u0130I", "i\u0131")
    source, target, several = _fold_tables()
    folded = F.translate(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), source, target)
    full = folded
    for a, b in several:
        full = F.replace(full, F.lit(a), F.lit(b))
    some = "[" + "".join(a for a, _ in several) + "]"
    plain = F.replace(F.replace(F.lower(c), F.lit("\u00df"), F.lit("ss")), F.lit("\u00b5"), F.lit("\u03bc"))
    return F.when(~c.rlike("[^\\x00-\\xFF]"), plain).when(c.rlike(some), full).otherwise(folded)


def equals_ignoring_case(a: Column | str, b: Column | str, mode: str | None = None) -> Column:
    """For a join, project ``fold`` of both keys and join on equality."""
    return fold(a, mode) == fold(b, mode)


def _kernel(f, locale: str | None, strict: bool):
    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([f(t, locale, strict) for t in texts.to_pylist()], pa.string())

    return run


def _only(kernel_udf, c: Column, where: Column, native: Column) -> Column:
    """``native``, but the kernel for the rows of ``where``; the others reach Python as null."""
    return F.when(where, kernel_udf(F.when(where, c))).otherwise(native)


def _parted(c: Column, own: str, strict: bool) -> tuple[Column, Column]:
    """(the part up to the first character beyond ASCII that isn't in ``own``, the rest): a locale's rules hold in the first."""
    if strict:
        return c, F.substr(c, F.length(c) + 1)
    head = F.regexp_extract(c, f"^[\\x00-\\x7F{own}]*+", 0)
    return head, F.substr(c, F.length(head) + 1)


def upcase(text: Column | str, locale: str | None = None, strict: bool = False) -> Column:
    c, where = _col(text), casing_locale(locale)
    if where in ("any", "lt", "nl"):
        return F.upper(c)
    if where in ("tr", "az"):  # only the letter i differs
        head, tail = _parted(c, "", strict)
        return F.concat(F.upper(F.replace(head, F.lit("i"), F.lit("\u0130"))), F.upper(tail))
    return _only(_kernel(kernel.upcase, where, strict), c, c.rlike("[^\\x00-\\x7F]"), F.upper(c))


def downcase(text: Column | str, locale: str | None = None, strict: bool = False) -> Column:
    c, where = _col(text), casing_locale(locale)
    sigma = F.contains(c, F.lit("\u03a3"))  # a final one is told by the whole text
    if where in ("tr", "az"):
        head, tail = _parted(c, "\u0130", strict)
        plain = F.concat(F.lower(F.translate(head, "\u0130I", "i\u0131")), F.lower(tail))
        return _only(_kernel(kernel.downcase, where, strict), c, sigma, plain)
    if where == "lt":
        return _only(_kernel(kernel.downcase, where, strict), c, c.rlike("[^\\x00-\\x7F]"), F.lower(c))
    return _only(_kernel(kernel.downcase, "any", strict), c, sigma, F.lower(c))


def titlecase(text: Column | str, locale: str | None = None) -> Column:
    """Every word segment with its first character in title case and the rest in lower case."""
    from graphemica.functions.segmentation import LATIN, native_words, segmenter

    c, where = _col(text), casing_locale(locale)
    words = segmenter("word", locale)

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else "".join(kernel.title_word(w, locale) for w in words.stream(t)) for t in texts.to_pylist()], pa.string())

    if where != "any" or words.dictionary:
        return run(c)
    # the text is lowered at once, and each word gets its first character back in upper case
    native = F.array_join(F.transform(native_words(F.lower(c)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")
    # letters whose title case isn't their upper case are left to the kernel
    plain = c.rlike(LATIN) & ~c.rlike("[\u0130\u0149\u01c4-\u01cc\u01f0-\u01f3]|(?<![\\p{L}\\p{N}_])\u00df")
    return F.coalesce(run(F.when(~plain, c)), native)  # plain texts come back from Python as null
