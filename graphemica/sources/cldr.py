"""Segmentation metadata: suppressions from the ICU library, rules and variables from LDML files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from graphemica.kernels.locales import SEGMENTATION_LOCALES, ancestors, segmentation_locale
from graphemica.sources.icu import sentence_exceptions

_SETS = {"GraphemeClusterBreak": "grapheme_cluster_break", "LineBreak": "line_break", "SentenceBreak": "sentence_break", "WordBreak": "word_break"}
#: LDML files of this package: variables and rules of root, and of the locales that have their own.
BUNDLED = Path(__file__).parent / "ldml"


def suppressions(locale: str | None = None, break_type: str = "sentence") -> list[str]:
    """Abbreviations after which a sentence goes on, as CLDR lists them (read from the ICU library among Spark's jars); a
    locale's come after those of its ancestors.  None for other breaks."""
    if break_type != "sentence":
        return []
    return [x for name in reversed(ancestors(segmentation_locale("sentence", locale))) for x in sentence_exceptions(name)]


def suppression_words(locale: str | None) -> frozenset[str]:
    """Lower case, without the periods at the end: what the sentence kernel looks up."""
    return frozenset(s.strip().rstrip(".").strip().lower() for s in suppressions(locale))


def suppressions_frame(spark: SparkSession) -> DataFrame:
    rows = [(loc, "sentence", i, s) for loc in SEGMENTATION_LOCALES for i, s in enumerate(suppressions(loc))]
    return spark.createDataFrame(rows, "locale string, break_type string, ordinal int, value string")


@dataclass
class SegmentData:
    variables: list[tuple[str, str]] = field(default_factory=list)
    rules: list[tuple[float, str]] = field(default_factory=list)
    suppressions: list[str] = field(default_factory=list)


def read_ldml(path: str | Path) -> dict[str, SegmentData]:
    """Segment type -> variables, rules and suppressions of one LDML file."""
    out: dict[str, SegmentData] = {}
    for node in ET.parse(path).getroot().iter("segmentation"):
        data = out.setdefault(_SETS.get(node.get("type", ""), node.get("type", "")), SegmentData())
        data.variables += [(v.get("id", ""), (v.text or "").strip()) for v in node.iter("variable")]
        data.rules += [(float(r.get("id", "0")), (r.text or "").strip()) for r in node.iter("rule")]
        data.suppressions += [(s.text or "").strip() for s in node.iter("suppression")]
    return out


def segment_files(folder: str | Path | None = None) -> dict[str, Path]:
    """Locale -> its LDML file, for the locales that have one; without a folder, the files of this package."""
    found = {f.stem.replace("_", "-"): f for f in Path(BUNDLED if folder is None else folder).glob("*.xml")}
    return {name: found[name] for name in SEGMENTATION_LOCALES if name in found}


def read_segments(folder: str | Path | None = None, locale: str = "root") -> dict[str, SegmentData]:
    """A locale's data after that of its ancestors, root first.  Locales without a file add nothing.  Unknown locales raise
    a ValueError.  (The bundled files hold no suppressions: see ``suppressions``.)"""
    files = segment_files(folder)
    merged: dict[str, SegmentData] = {}
    for name in reversed(ancestors(locale)):
        for kind, data in (read_ldml(files[name]) if name in files else {}).items():
            into = merged.setdefault(kind, SegmentData())
            into.variables += data.variables
            into.rules += data.rules
            into.suppressions += data.suppressions
    return merged


def segment_data(locale: str, break_type: str, folder: str | Path | None = None) -> SegmentData:
    """The data of one type, like ``word_break``; an unknown type raises a ValueError."""
    merged = read_segments(folder, locale)
    if break_type not in merged:
        raise ValueError(f"Unknown segment type {break_type!r}")
    return merged[break_type]


def segment_frames(spark: SparkSession, folder: str | Path | None = None, locale: str = "root") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variables, rules, suppressions) of a locale as tables."""
    data = read_segments(folder, locale)
    variables = [(locale, k, i, n, v) for k, d in data.items() for i, (n, v) in enumerate(d.variables)]
    rules = [(locale, k, i, v) for k, d in data.items() for i, v in sorted(d.rules)]
    listed = [(locale, k, i, v) for k, d in data.items() for i, v in enumerate(d.suppressions)]
    return (
        spark.createDataFrame(variables, "locale string, break_type string, ordinal int, name string, value string"),
        spark.createDataFrame(rules, "locale string, break_type string, id double, value string"),
        spark.createDataFrame(listed, "locale string, break_type string, ordinal int, value string"),
    )
