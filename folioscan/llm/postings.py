"""What problems 2 and 5 share: which rows of postings count, and how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: white space that pads terms (Python's str.strip set within the basic plane).
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def counted(postings: DataFrame) -> DataFrame:
    """``(term, path, unit_ord, n)`` of the rows that count: term trimmed of blanks and lower-cased, ``n`` its positions.

    Rows with a null or blank term, or null positions or path, don't count. Rows may still be repeated.
    """
    term = F.lower(F.btrim("term", F.lit(_BLANKS)))
    rows = postings.filter("term is not null and path is not null and positions is not null")
    return rows.select(term.alias("term"), "path", "unit_ord", F.size("positions").cast("bigint").alias("n")).filter("term != ''")


def term_file_counts(postings: DataFrame) -> DataFrame:
    """``(term, path, tf)``: occurrences of each term in each file.

    Rows equal in (term, path, unit_ord) count once; where they differ in positions, the longer list counts.
    One shuffle, by (term, path): it serves both groupings, and neither a hot term nor a hot file ends in one task.
    """
    rows = counted(postings).repartition("term", "path").groupBy("term", "path", "unit_ord").agg(F.max("n").alias("n"))
    return rows.groupBy("term", "path").agg(F.sum("n").alias("tf"))
