"""Parts of texts for fitting the small models of this subpackage: a bounded, repeatable sample, or all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are sampled in parts of this many characters, so that a sample is bounded however long they are.
PART_CHARS = 3000
#: So many distinct parts come to one task where all are used.
TASK_PARTS = 10_000


def _number(text_col: str, chars: int) -> Column:
    return F.floor((F.length(text_col) + (chars - 1)) / chars)


def _parts(docs: DataFrame, text_col: str, chars: int) -> DataFrame:
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(chars))
    parts = F.transform(starts, lambda i: F.substring(F.col(text_col), i + 1, F.lit(chars)))
    whole = F.when(F.length(text_col) <= chars, F.array(text_col)).otherwise(parts)
    return docs.filter(F.length(text_col) > 0).select(F.explode(whole).alias("t")).filter(F.trim("t") != "")


def distinct_parts(docs: DataFrame, text_col: str = "text", chars: int = PART_CHARS, rows: int = TASK_PARTS) -> DataFrame:
    """``(t)``: every non-blank part of ``chars`` characters of all texts once, about ``rows`` to a partition.

    Which parts share a partition depends on the parts alone. Copies fall away before the shuffle.
    """
    total = docs.agg(F.sum(_number(text_col, chars))).first()[0] or 0
    return _parts(docs, text_col, chars).distinct().repartition(max(1, -(-total // rows)), "t")


def sample_texts(docs: DataFrame, rows: int, text_col: str = "text", chars: int = PART_CHARS) -> list[str]:
    """Up to ``rows`` distinct non-blank parts of texts, those with the least hash of their content, for fitting only.

    Every text is cut into parts of ``chars`` characters, all of which may be drawn, from wherever in a text. Only
    parts below a bound of the hash, set from their number, leave their task, and copies of one part once: about
    ``1.5 * rows`` of them in all, however large the table is.
    """
    total = docs.agg(F.sum(_number(text_col, chars))).first()[0] or 0
    share = min(1.0, 1.5 * rows / max(1, total))
    texts = _parts(docs, text_col, chars)
    hashed = texts.select(F.xxhash64("t").alias("h"), "t")
    if share < 1:
        hashed = hashed.filter(F.col("h") < int(-(2**63) + share * 2**64))
    found = hashed.dropDuplicates(["h"]).orderBy("h", "t").limit(rows).collect()
    return list(dict.fromkeys(r.t for r in found))
