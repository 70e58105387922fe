"""Segmentation of columns.

Texts of Basic Latin to Latin Extended-B (but the soft hyphen) are split by a regular expression inside the
JVM; the others go to the kernels in Arrow batches.  Both give the same segments.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphemica.functions.casing import _col
from graphemica.kernels.dictionary import Dictionary
from graphemica.kernels.locales import check_break, dictionary_of
from graphemica.kernels.properties import class_table
from graphemica.kernels.segment import Segmenter

#: Texts that the native patterns cover.
LATIN = "\\A[\\x00-\\xAC\\xAE-\\x{24F}]*+\\z"
_WHITE = "^[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$"
_WHITE_START = "^[\\t-\\r \\x{85}\\x{A0}]+"
_ARRAY = T.ArrayType(T.StringType())
_NEXT = T.StructType([T.StructField("segment", T.StringType()), T.StructField("rest", T.StringType())])
_DICTIONARIES = ("zh", "th", "lo", "km", "my")


def dictionaries(paths: dict[str, str] | None = None) -> dict[str, Dictionary]:
    """ICU's dictionaries, or text files by name."""
    return {name: Dictionary(name, (paths or {}).get(name)) for name in _DICTIONARIES}


def segmenter(break_type: str, locale: str | None = None, suppressions: bool = True, paths: dict[str, str] | None = None) -> Segmenter:
    words: frozenset[str] = frozenset()
    if check_break(break_type) == "sentence" and suppressions:
        from graphemica.sources.cldr import suppression_words

        words = suppression_words(locale)
    return Segmenter(break_type, locale, suppressions, words, dictionaries(paths))


@functools.lru_cache(1)
def _native_word_pattern() -> str:
    """The word rules over U+0000 to U+024F, with each class as ranges from the class table."""
    flat = class_table("word").spread()[:0x250]

    def ranges(letters: str) -> str:
        at = [i for i in range(0x250) if chr(flat[i]) in letters]
        out, k = [], 0
        while k < len(at):
            j = k
            while j + 1 < len(at) and at[j + 1] == at[j] + 1:
                j += 1
            out.append(f"\\x{{{at[k]:X}}}-\\x{{{at[j]:X}}}")
            k = j + 1
        return "[" + "".join(out) + "]"

    a, d, low = ranges("aA"), ranges("0"), ranges("_")
    run = f"(?:{a}(?:{ranges('mbq')}(?={a}))?+|{d}(?:{ranges('ubq')}(?={d}))?+)++"
    word = f"(?:(?:{run})?+{low}++)*+{run}|(?:(?:{run})?+{low}++)++"
    return f"(?s)\\r\\n|{ranges('w')}++|{word}|."


_NATIVE_GRAPHEME = "(?s)\\r\\n|."


def native_pattern(break_type: str) -> str:
    """The segments of a text that LATIN covers, as a Java pattern."""
    return _native_word_pattern() if break_type == "word" else _NATIVE_GRAPHEME


def native_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_native_word_pattern()), F.lit(0))


def _arrow(f, kind: T.DataType) -> Column:
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([f(t) for t in texts.to_pylist()], arrow)

    return run


def _native(break_type: str, seg: Segmenter) -> bool:
    return break_type == "grapheme" or (break_type == "word" and not seg.dictionary)


def _split(text: Column | str, break_type: str, locale: str | None, suppressions: bool, trim: bool, paths, how: str) -> Column:
    c, seg = _col(text), segmenter(break_type, locale, suppressions, paths)
    run = _arrow(getattr(seg, how), _ARRAY)
    if _native(break_type, seg):
        # texts that the pattern covers reach Python as null and come back as null, so one look at a text decides both
        out = F.coalesce(run(F.when(~c.rlike(LATIN), c)), F.regexp_extract_all(c, F.lit(native_pattern(break_type)), F.lit(0)))
    else:
        out = run(c)
    return trim_segments(out) if trim else out


def split(text: Column | str, break_type: str = "word", *, locale: str | None = None, suppressions: bool = True, trim: bool = False, dictionary_paths: dict[str, str] | None = None) -> Column:
    """array<string> of segments; joined they are the text again (without ``trim``).  Null gives null."""
    return _split(text, break_type, locale, suppressions, trim, dictionary_paths, "split")


def stream(text: Column | str, break_type: str = "word", *, locale: str | None = None, suppressions: bool = True, trim: bool = False, dictionary_paths: dict[str, str] | None = None) -> Column:
    """Like ``split``, segment by segment: greedy dictionary words, and lines by the rules alone."""
    return _split(text, break_type, locale, suppressions, trim, dictionary_paths, "stream")


def split_by_locale(text: Column | str, locale: Column | str, break_type: str = "word", *, suppressions: bool = True, trim: bool = False) -> Column:
    """``split`` with a locale per row.  The locales of a batch are resolved once each."""
    from graphemica.kernels.locales import SEGMENTATION_LOCALES, segmentation_locale
    from graphemica.sources.cldr import suppression_words

    check_break(break_type)
    words = {loc: suppression_words(loc) for loc in SEGMENTATION_LOCALES} if break_type == "sentence" and suppressions else {}
    tables = {name: class_table(break_type, name) for name in ("root", "el")}
    known = dictionaries()

    @F.arrow_udf(_ARRAY)
    def run(texts: pa.Array, locales: pa.Array) -> pa.Array:
        made: dict[str | None, Segmenter] = {}
        out = []
        for t, loc in zip(texts.to_pylist(), locales.to_pylist(), strict=True):
            if loc not in made:
                where = segmentation_locale(break_type, loc)
                same = next((s for s in made.values() if s.locale == where), None)
                made[loc] = same or Segmenter(break_type, loc, suppressions, words.get(where, frozenset()), known)
            out.append(made[loc].split(t))
        return pa.array(out, pa.list_(pa.string()))

    assert tables  # built on the driver, so that a bad break type fails here
    out = run(_col(text), _col(locale))
    return trim_segments(out) if trim else out


def trim_segments(segments: Column | str) -> Column:
    """Without the segments that are white space only."""
    return F.filter(_col(segments), lambda s: ~s.rlike(_WHITE))


def next_segment(text: Column | str, break_type: str = "word", *, locale: str | None = None, suppressions: bool = True, trim: bool = False, dictionary_paths: dict[str, str] | None = None) -> Column:
    """struct<segment, rest> of the first segment; null at the end."""
    c, seg = _col(text), segmenter(break_type, locale, suppressions, dictionary_paths)

    def first(t: str | None) -> dict | None:
        found = seg.next(t, trim)
        return None if found is None else {"segment": found[0], "rest": found[1]}

    run = _arrow(first, _NEXT)
    if not _native(break_type, seg):
        return run(c)
    other = F.when(~c.rlike(LATIN), c)
    begun = F.regexp_replace(c, _WHITE_START, "") if trim else c  # white space never joins what follows it here
    segment = F.regexp_extract(begun, f"^(?:{native_pattern(break_type).removeprefix('(?s)')})".replace("^", "(?s)^", 1), 0)
    plain = F.when(segment != "", F.struct(segment.alias("segment"), F.substr(begun, F.length(segment) + 1).alias("rest")))
    return F.when(other.isNull(), plain).otherwise(run(other))


def is_break(before: Column | str, after: Column | str, break_type: str = "word", *, locale: str | None = None, suppressions: bool = True, dictionary_paths: dict[str, str] | None = None) -> Column:
    """Whether there is a boundary between two texts.  Dictionaries play no part, but a locale of one needs it."""
    seg = segmenter(break_type, locale, suppressions, dictionary_paths)
    name = dictionary_of(locale) if break_type == "word" else None
    if name and not seg.loaded(name):
        raise ValueError(f"The dictionary for {locale!r} isn't available")

    @F.arrow_udf(T.BooleanType())
    def run(befores: pa.Array, afters: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else seg.is_break(a, b) for a, b in zip(befores.to_pylist(), afters.to_pylist(), strict=True)], pa.bool_())

    return run(_col(before), _col(after))


def break_at(before: Column | str, after: Column | str, break_type: str = "word", **options) -> Column:
    """struct<op, before, matched, rest>: break or no_break, and the first character of what follows."""
    b, a = _col(before), _col(after)
    op = F.when(is_break(b, a, break_type, **options), "break").otherwise("no_break")
    both = b.isNotNull() & a.isNotNull()
    first, rest = F.substring(a, 1, 1), F.substring(a, 2, 1 << 30)
    empty = b == ""
    return F.when(both, F.struct(op.alias("op"), b.alias("before"), F.when(empty, F.lit("")).otherwise(first).alias("matched"), F.when(empty, a).otherwise(rest).alias("rest")))


def decide_by_rules(text: Column | str, break_type: str = "word", *, locale: str = "root", folder: str | None = None, suppressions: bool = False) -> Column:
    """array<string> with break or no_break for each place between two characters, by LDML rules alone.

    For rules of one's own: each place is decided by itself, so long texts belong to ``split``.  Null gives null.
    """
    from graphemica.kernels.rules import compile_rules, evaluate_rules
    from graphemica.sources import cldr

    kind = {"grapheme": "grapheme_cluster_break"}.get(check_break(break_type), f"{break_type}_break")
    data = cldr.segment_data(locale, kind, folder)
    listed = [*data.suppressions, *cldr.suppressions(locale, break_type)] if suppressions else []
    rules = compile_rules(data.rules, data.variables, listed)

    def decide(t: str | None) -> list[str] | None:
        return None if t is None else [evaluate_rules((t[:i], t[i:]), rules)[0] for i in range(1, len(t))]

    return _arrow(decide, _ARRAY)(_col(text))


@functools.lru_cache(1)
def _word_like_pattern() -> str:
    """Alphabetic or numeric characters, as ranges from the Unicode tables of this package."""
    import numpy as np

    from graphemica.kernels.properties import members

    flags = members(r"[\p{Alphabetic}\p{N}]")
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b - 1:X}}}" for a, b in zip(edges[::2], edges[1::2], strict=True)) + "]"


def word_like(segment: Column | str) -> Column:
    """Whether any character is alphabetic or numeric.  Plain segments are told by a short pattern."""
    c = _col(segment)
    return F.when(c.rlike("[0-9A-Za-z]"), F.lit(True)).when(~c.rlike("[^\\x00-\\x7F]"), F.lit(False)).otherwise(c.rlike(_word_like_pattern()))


def is_language(tag: Column | str) -> Column:
    return F.octet_length(_col(tag)).isin(2, 3)


def is_script(tag: Column | str) -> Column:
    return F.octet_length(_col(tag)) == 4


def is_territory(tag: Column | str) -> Column:
    return F.octet_length(_col(tag)) == 2
