"""Files to units on the executors, with plugins for formats that need other libraries."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import formats

_UNITS = "path string, unit_ord int, location string, unit_kind string, root_folder string, text string, error string"


def read_units(files: DataFrame, plugins: Mapping[str, Callable[[bytes], list[formats.Unit]]] | None = None, file_timeout: float = 0) -> DataFrame:
    """Units of ``files(path, ext, root_folder, content)`` from the scan, one file at a time on each task.

    ``plugins`` maps extensions ('.pdf', '.png', '.xls', ...) to readers of the same form as those of
    :mod:`.formats`. A file that can't be read gives one row with a null text and its ``error``; nothing stops
    the others. A reader may yield units; beyond ``file_timeout`` seconds (0: no limit) those read so far
    stay and an error row follows.
    """
    readers = {**formats.READERS, **(plugins or {})}

    def run(batches):
        for pdf in batches:
            rows = []
            for path, ext, root, content in zip(pdf["path"], pdf["ext"], pdf["root_folder"], pdf["content"]):
                began, k = time.monotonic(), 0
                try:
                    reader = readers.get(ext)
                    if reader is None:
                        raise ValueError(f"no reader for {ext}")
                    if content is None:
                        raise OSError("can't be opened")
                    for location, kind, text in reader(bytes(content)):
                        rows.append((path, k, location, kind, root, text, None))
                        k += 1
                        if file_timeout and time.monotonic() - began > file_timeout:
                            raise TimeoutError(f"more than {file_timeout} s")
                except Exception as e:
                    rows.append((path, k, None, None, root, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "unit_ord", "location", "unit_kind", "root_folder", "text", "error"])

    return files.select("path", "ext", "root_folder", "content").mapInPandas(run, _UNITS)


def fetch(files: DataFrame) -> DataFrame:
    """``files(path, ext, root_folder, ...)`` with their ``content``, opened on the executors one by one.

    For files that were chosen by their names: no bytes are joined or shuffled. A file that can't be opened has null content.
    """

    def run(batches):
        from pyarrow import fs

        for pdf in batches:
            for i in range(len(pdf)):  # one file at a time, however large
                row = pdf.iloc[i : i + 1].copy()
                try:
                    where, at = fs.FileSystem.from_uri(row["path"].iloc[0])
                    with where.open_input_stream(at) as f:
                        row["content"] = [f.read()]
                except (OSError, ValueError):
                    row["content"] = [None]
                yield row

    cols = ["path", "ext", "root_folder"]
    return files.select(*cols).mapInPandas(run, "path string, ext string, root_folder string, content binary")


def skipped(units: DataFrame) -> DataFrame:
    """``(path, reason)`` of the files that couldn't be read, wholly or to the end."""
    return units.filter("error is not null").select("path", F.col("error").alias("reason"))


def read_documents(files: DataFrame) -> DataFrame:
    """``(path, text)``: the whole text of each file, for ranking; '' for formats without a reader or broken files."""

    def run(batches):
        for pdf in batches:
            texts = []
            for ext, content in zip(pdf["ext"], pdf["content"]):
                try:
                    texts.append(formats.whole_text(ext, bytes(content)))
                except Exception:
                    texts.append("")
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return files.select("path", "ext", "content").mapInPandas(run, "path string, text string")


def units_of_texts(texts: DataFrame, reader: Callable[[str], list], key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, unit_ord, location, unit_kind, text)`` by a reader of decoded text; null texts give none."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(i, k, *u) for i, t in zip(pdf[key], pdf[text_col]) if t is not None for k, u in enumerate(reader(t))]
            yield pd.DataFrame(rows, columns=[key, "unit_ord", "location", "unit_kind", "text"])

    return texts.select(key, text_col).mapInPandas(run, f"`{key}` {kind}, unit_ord int, location string, unit_kind string, text string")


def table_units(table: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Every cell and every row of a table as units, without leaving the JVM.

    ``(key, location, unit_kind, text)``; cells are ``C1``.. of the row, the row is all its cells joined by ' | '.
    Blank and null cells are left out, and rows of such only.
    """
    cells = F.array(*[F.trim(F.col(c).cast("string")) for c in cols])
    rows = table.select(key, cells.alias("cells"))
    one = rows.select(key, F.posexplode("cells").alias("i", "text")).select(key, F.concat(F.lit("C"), F.col("i") + 1).alias("location"), F.lit("cell").alias("unit_kind"), "text")
    joined = F.array_join(F.filter("cells", lambda c: c.isNotNull() & (c != "")), " | ")
    whole = rows.select(key, F.lit("R").alias("location"), F.lit("row").alias("unit_kind"), joined.alias("text"))
    return one.unionByName(whole).filter("text is not null and text != ''")
