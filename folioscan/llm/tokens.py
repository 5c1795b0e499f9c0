"""Problem 7: encode every text with a public byte-level tokenizer.

The rank file is a parameter and is read on the workers; it must lie at the same path on every
executor. Long texts are cut at boundaries where the tokenizer's own pre-splitting pattern always
cuts, so the ids equal those of the whole text, and decoding works on raw bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies lie by default; FOLIOSCAN_TOKENIZERS names another folder.
VOCAB_DIR = os.environ.get("FOLIOSCAN_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"

#: Fixed value: the pre-splitting pattern of the published byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts longer than this many characters are encoded piece by piece.
LONG_TEXT = 50_000


@lru_cache(maxsize=4)
def load_encoding(rank_file: str):
    """The tiktoken encoding of a local rank file (base64 token, rank in each line)."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Where the pattern always cuts: before white space, and where letters, digits and signs change. Not between an
#: apostrophe and a letter, which may be one token.
_CUT = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"


def safe_pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Cut ``text`` into pieces of about ``size`` characters at places where the pattern always cuts.

    A longer run without such a place (letters only, one kind of sign, blanks) is one word to the tokenizer, whose
    own merging takes it as a whole in any case; it stays one piece. The ids are right always.
    """
    import regex

    cut = regex.compile(_CUT)
    start = 0
    while len(text) - start > size:
        m = cut.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_text(enc, text: str | None, long_text: int = LONG_TEXT) -> list[int]:
    """Ids of one text without special tokens; null and empty texts give an empty list."""
    if not text:
        return []
    if len(text) <= long_text:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, long_text):
        ids += enc.encode_ordinary(piece)
    return ids


def _rank_path(rank_file: str | None) -> str:
    return rank_file or f"{VOCAB_DIR}/{BYTE_BPE}"


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """``(id_col, ids array<int>)``: the ids of every text.

    Null, empty: ``[]``. Blank texts have the ids of their blanks. Every input row gives one output row,
    repeated rows included; columns other than the two named are not read. An empty table gives none.
    No shuffle: the scan, one Python stage.
    """
    path = _rank_path(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(path)
        for batch in batches:
            ids = [encode_text(enc, t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_file: str | None = None) -> DataFrame:
    """``(id_col, n_tokens bigint)``; null and empty texts have 0."""
    path = _rank_path(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(path)
        for batch in batches:
            n = [len(encode_text(enc, t)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", rank_file: str | None = None) -> DataFrame:
    """``(id_col, text)``: the raw bytes of all ids joined, then decoded once, so that characters whose bytes
    lie in several tokens come out whole. Bytes that are no UTF-8 become U+FFFD. Null ids give a null text."""
    path = _rank_path(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(path)
        for batch in batches:
            texts = [None if i is None else enc.decode_bytes(i).decode("utf-8", "replace") for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
