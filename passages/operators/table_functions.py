"""Chunkers and matchers as table functions, for SQL with a lateral join.

    register(spark)
    spark.sql("SELECT d.doc_id, p.* FROM documents d, LATERAL sentence_passages(d.text, 100) p")
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from passages.functions.text import mentions_of
from passages.operators.chunk import segment_groups, sentence_groups


class SentencePassages:
    """Rows of ``pack_sentences`` for one text, which is trimmed first; a null text has none."""

    def eval(self, text: str, target: int):
        text = (text or "").strip()
        for pos, (start, end, words) in enumerate(sentence_groups(text, target)):
            yield pos, start, end, words, text[start:end]


class SegmentPassages:
    """Rows of ``pack_segments`` for one array of (start, end, text)."""

    def eval(self, segments, target: int):
        texts = [s["text"] for s in segments or ()]
        for pos, (first, last, start, end, words) in enumerate(segment_groups(texts, target)):
            spoken = " ".join(t.strip() for t in texts[first : last + 1] if t and t.strip())
            yield pos, start, end, float(segments[first]["start"]), float(segments[last]["end"]), words, spoken


class LabelMentions:
    """Rows of ``mentions`` for one text."""

    def eval(self, text: str):
        yield from mentions_of(text)


FUNCTIONS = {
    "sentence_passages": (SentencePassages, "pos int, char_start int, char_end int, n_words int, passage string"),
    "segment_passages": (SegmentPassages, "pos int, char_start int, char_end int, time_start double, time_end double, n_words int, passage string"),
    "label_mentions": (LabelMentions, "pos int, label int"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions in the session and returns their names."""
    for name, (function, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, returnType=schema))
    return list(FUNCTIONS)
