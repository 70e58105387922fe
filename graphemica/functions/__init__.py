"""Column functions.  Built-ins where they give the defined results, Arrow kernels elsewhere."""

from graphemica.functions.casing import downcase, equals_ignoring_case, fold, titlecase, upcase
from graphemica.functions.segmentation import break_at, decide_by_rules, is_break, is_language, is_script, is_territory, next_segment, split, stream, trim_segments, word_like

__all__ = [
    "break_at", "decide_by_rules", "downcase", "equals_ignoring_case", "fold", "is_break", "is_language", "is_script", "is_territory",
    "next_segment", "split", "stream", "titlecase", "trim_segments", "upcase", "word_like",
]
