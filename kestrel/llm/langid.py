"""Language identification by compression.

A language's model is a raw-content zstandard dictionary: slices of a bounded sample of its labelled texts.  A text belongs
to the language whose dictionary lets it compress to the fewest bytes.  Where the runner-up needs hardly more, the answer is
narrow and counts as rejected.  A dictionary helps only until a text has been its own dictionary for a while, so a long text
is compressed in equal blocks, each from the bare dictionary, and the blocks' sizes are added: the margin is that of a block,
whatever the length.

Defined results.  A null text, or one without a letter, is ``und`` with score 0 and is rejected.  A text of one letter is
judged like any other.  Ties go to the language that sorts first.  With no labelled text every document is ``und``.  Rows
without a language or an id are never learned from.  Repeated rows get the same answer.  No rows in, no rows out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_arrow

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Texts of fewer bytes are written twice.
SHORT = 256
#: Most bytes of a block.
BLOCK = 16_384
FIELDS = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("margin", T.DoubleType(), False), T.StructField("rejected", T.BooleanType(), False)]


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries by language, in the languages' order."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 6
    least_margin: float = 0.004

    def classifier(self):
        """text -> (language, score, relative margin, rejected)."""
        coders = []
        for name, content in self.dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coders.append((name, zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        least = self.least_margin

        def classify(text: str | None) -> tuple[str, float, float, bool]:
            if not text or not coders or not LETTER.search(text):
                return UNKNOWN, 0.0, 0.0, True
            data = text.lower().encode("utf-8", "surrogatepass")
            if len(data) < SHORT:  # a coder stores what it can't shorten; a second copy costs the same in every language
                data += b"\n" + data
            step = -(-len(data) // -(-len(data) // BLOCK))
            sizes = [0] * len(coders)
            for at in range(0, len(data), step):
                for i, (_, c) in enumerate(coders):
                    sizes[i] += len(c.compress(data[at : at + step]))
            best = min(sizes)
            at = sizes.index(best)
            score = 1 / sum(2.0 ** min(0, (best - n) / 2) for n in sizes)
            if len(sizes) == 1:
                return coders[0][0], score, 1.0, False
            second = min(n for i, n in enumerate(sizes) if i != at)
            margin = (second - best) / second
            return coders[at][0], score, margin, margin < least

        return classify


def fit(docs: DataFrame, usable: Column | None = None, per_language: int = 96, slice_chars: int = 2048, dictionary_bytes: int = 112_640, level: int = 6, least_margin: float = 0.004) -> CompressionModel:
    """Dictionaries from ``text`` and ``lang`` of the rows where ``usable`` holds.

    Bounded sample: ``per_language`` texts each, those whose ids hash lowest, and of each at most ``slice_chars`` characters.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") >= 200))
    rows = rows.filter(usable) if usable is not None else rows
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "cut")
    cut = rows.select("doc_id", "lang", F.substring("text", 1, slice_chars).alias("cut"))
    found = cut.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).orderBy("lang", "n").collect()
    by: dict[str, bytes] = {}
    for r in found:
        held = by.get(r["lang"], b"")
        if len(held) < dictionary_bytes:
            by[r["lang"]] = (held + r["cut"].lower().encode("utf-8", "surrogatepass") + b"\n")[:dictionary_bytes]
    return CompressionModel(tuple(sorted(by.items())), level, least_margin)


def identify(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), margin and rejected.  Only ``text`` is looked at."""

    def make():
        classify = model.classifier()

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [classify(t) for t in batch.column("text").to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            return [pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]

        return step

    return with_arrow(docs, make, FIELDS)


def fold(parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
