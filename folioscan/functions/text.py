"""Text functions as Columns. What Java can do stays in the JVM; Unicode folding and stemming go to Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import words

#: A word character, spelt out: Java's classes differ from it.
W = r"[\p{L}\p{N}_]"
#: Unicode white space, as a split at blanks sees it.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
TOKEN = rf"([{words.CJK}]|{W}+)"


def _map_strings(f: Callable[[str | None], str]) -> Callable[[Column | str], Column]:
    """A function of strings as an Arrow UDF; null stays null."""

    def series(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in s], index=s.index, dtype=object)

    return F.pandas_udf(series, StringType())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: White space of ASCII texts, as Python's patterns and strip see it.
_ASCII_SPACE = r"[\t-\r\x1c-\x20]"
_PLAIN = r"^[\x00-\x7f]*$"


def _split(c: Column | str, plain: Callable[[Column], Column], other: Callable[[Column | str], Column]) -> Column:
    """``plain`` in the JVM for ASCII texts, which are most; only the others go to Python. Null stays null."""
    ascii_ = col(c).rlike(_PLAIN)
    return F.when(ascii_, plain(col(c))).otherwise(other(F.when(~ascii_, col(c))))


def fold(c: Column | str, accent_fold: bool = True) -> Column:
    """Compatibility forms unified, lower case and, by default, without accents. Null stays null."""
    return _split(c, F.lower, _map_strings(lambda v: words.normalize(v, accent_fold)))


def strip_accents(c: Column | str) -> Column:
    return _split(c, lambda x: x, _map_strings(words.strip_accents))


def even(c: Column, word: str = "[A-Za-z0-9_]", space: str = _ASCII_SPACE) -> Column:
    """Words broken at line ends joined, line ends and blanks evened, at most one blank line."""
    joined = F.regexp_replace(c, rf"({word}+)-{space}*\n{space}*({word}+)", "$1$2")
    lines = F.regexp_replace(joined, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def trimmed(c: Column) -> Column:
    """Without white space of ASCII at both ends."""
    return F.regexp_replace(c, rf"^{_ASCII_SPACE}+|{_ASCII_SPACE}+\z", "")


def clean_extracted(c: Column | str, accent_fold: bool = True) -> Column:
    return _split(c, lambda x: trimmed(even(x)), _map_strings(lambda v: words.clean_extracted(v, accent_fold)))


def clean_display(c: Column | str) -> Column:
    return _split(c, lambda x: trimmed(even(x)), _map_strings(words.clean_display))


def nfkc(c: Column | str) -> Column:
    """Compatibility forms unified. Null stays null."""
    return _split(c, lambda x: x, _map_strings(lambda v: unicodedata.normalize("NFKC", v)))


def tokenize(folded: Column | str) -> Column:
    """Words of a folded text, each CJK character one word. Null and empty texts have none."""
    return F.coalesce(F.regexp_extract_all(col(folded), F.lit(TOKEN), F.lit(1)), F.array().cast("array<string>"))


def stems(tokens: Column | str, suffixes: tuple[str, ...] = words.SUFFIXES) -> Column:
    """The stem of each token: of the distinct ones of a batch, each looked up once."""

    def of_batch(lists: pa.Array) -> pa.Array:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        found = lists.flatten().dictionary_encode()
        stemmed = pa.array([None if w is None else words.stem(w, suffixes) for w in found.dictionary.to_pylist()], pa.string())
        sizes = lists.value_lengths().fill_null(0)
        offsets = pa.array([0, *np.cumsum(sizes.to_numpy())], pa.int32())
        return pa.ListArray.from_arrays(offsets, stemmed.take(found.indices), mask=lists.is_null())

    return F.arrow_udf(of_batch, ArrayType(StringType()))(col(tokens))


def stem(word: Column | str, suffixes: tuple[str, ...] = words.SUFFIXES) -> Column:
    """The stem of one word, for columns of distinct words."""
    return _map_strings(lambda v: words.stem(v, suffixes))(col(word))


def hyphen_variant(c: Column | str) -> Column:
    """Hyphens and slashes between word characters as blanks."""
    return F.regexp_replace(col(c), rf"(?<={W})[-/](?={W})", " ")


def mask_digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\p{Nd}+", "#")


def strip_tags(c: Column | str) -> Column:
    """Text of markup by patterns alone: scripts and styles dropped, tags to blanks, blanks collapsed."""
    no_code = F.regexp_replace(col(c), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(no_code, r"(?s)<[^>]+>", " "), r"\s+", " "))


def fingerprint(c: Column | str) -> Column:
    return F.md5(col(c))


def safe_name(c: Column | str) -> Column:
    """A name for output folders: base name, forbidden characters as '_', at most 64 characters; 'root' if nothing is left."""
    base = F.regexp_extract(F.regexp_replace(col(c), r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    name = F.substring(F.regexp_replace(base, r'[<>:"|?*\x00-\x1f]', "_"), 1, 64)
    return F.when(F.coalesce(name, F.lit("")) == "", "root").otherwise(name)


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; '.fb2.zip' counts as one. '' without any."""
    low = F.lower(col(path))
    return F.when(low.endswith(".fb2.zip"), ".fb2.zip").otherwise(F.regexp_extract(low, r"[^/\\.][^/\\]*?(\.[^./\\]*)$", 1))


#: The switches of file types and their extensions.
FILE_TYPES = {
    "txt": (".txt", ".log"), "md": (".md",), "csv": (".csv",), "docx": (".docx",), "html": (".html", ".htm"), "excel": (".xlsx", ".xls"), "pdf": (".pdf",),
    "image": (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".gif", ".webp"), "json": (".json", ".jsonl"),
    "ttl": (".ttl", ".nt", ".n3", ".rdf", ".owl", ".trig", ".nq"), "ebook": (".epub", ".fb2", ".fb2.zip"),
}


def type_of(ext: Column | str) -> Column:
    """The switch an extension belongs to, null for none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, exts in FILE_TYPES.items():
        out = out.when(col(ext).isin(*exts), kind)
    return out


def position_label(ext: Column | str) -> Column:
    """What the location of a match counts, by extension."""
    e = col(ext)
    return (
        F.when(e == ".pdf", "Page").when(e == ".docx", "Paragraph").when(e.isin(".html", ".htm"), "Element").when(e == ".md", "Block")
        .when(e.isin(".xlsx", ".xls"), "Cell").when(e == ".csv", "Location").otherwise("Line")
    )


def html_escape(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def delimiter_of(c: Column | str, sample: int = 8192) -> Column:
    """The most frequent of comma, semicolon, tab and bar in the head of a text; ties in this order, comma for none."""
    head = F.substring(F.coalesce(col(c), F.lit("")), 1, sample)
    n = {d: F.length(head) - F.length(F.replace(head, F.lit(d), F.lit(""))) for d in ",;\t|"}
    most = F.greatest(*n.values())
    out = F.when(most == 0, ",")
    for d, k in n.items():
        out = out.when(k == most, d)
    return out


# Quality of page texts


def alpha_share(c: Column | str) -> Column:
    n = F.length(col(c))
    return F.when(n > 0, F.regexp_count(col(c), F.lit(r"\p{L}")) / n).otherwise(F.lit(0.0))


def unique_share(c: Column | str) -> Column:
    """Distinct words among all."""
    ws = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(f"({W}+)"), F.lit(1))
    return F.when(F.size(ws) > 0, F.size(F.array_distinct(ws)) / F.size(ws)).otherwise(F.lit(0.0))


def is_garbage(c: Column | str) -> Column:
    n = F.coalesce(F.length(col(c)), F.lit(0))
    return (n < 60) | (alpha_share(c) < 0.15) | (unique_share(c) < 0.10)


def page_score(c: Column | str) -> Column:
    return F.coalesce(F.length(col(c)), F.lit(0)) * (0.7 * alpha_share(c) + 0.3 * unique_share(c))


def is_poor(c: Column | str) -> Column:
    """Whether the text layer is too thin to search."""
    return (F.coalesce(F.length(col(c)), F.lit(0)) < 120) | (alpha_share(c) < 0.15)
