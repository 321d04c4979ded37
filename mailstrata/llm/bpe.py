"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file is read on the driver and sent to the workers as bytes (its size is the
vocabulary's, not the data's); each Python worker builds the encoder once. Texts beyond
LONG code points are cut where no match of the split pattern can span: before a white
space that follows something else, and after a run of letters or of digits. Pieces are
encoded one by one, so memory is that of a piece, and ids are joined in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points from which a text is cut before it is encoded, and the largest rank file that is sent to the workers.
LONG, MAX_RANK_BYTES = 20_000, 32 << 20

_encoders: dict = {}


def rank_bytes(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; a rank file of at most {MAX_RANK_BYTES} is sent to the workers")
    return data


def encoder(ranks: bytes, pattern: str):
    """The tiktoken encoder of a rank file; kept by this process."""
    import tiktoken

    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def safe_pieces(text: str, size: int = LONG) -> Iterator[str]:
    """text in pieces of about size code points, cut only where every way to split it by the pattern has a boundary.

    No alternative of the pattern goes on from something else to white space, from a letter to
    something else or from a digit to something else, and none looks back; so a cut there changes no match.
    A text without such a place stays whole.
    """
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while cut < n:
            a, b = text[cut - 1], text[cut]
            if not a.isspace() and (b.isspace() or _letter(a) and not _letter(b) and not _mark(b)):
                break
            cut += 1
        yield text[at:cut]
        at = cut
    if at < n or not n:
        yield text[at:]


def _letter(c: str) -> bool:
    return c.isalpha()


def _mark(c: str) -> bool:
    """Anything of which Python and the pattern's engine may disagree whether it is a letter."""
    return ord(c) > 127


def encode_text(enc, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text) for i in enc.encode_ordinary(piece)]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs with ids array<int> (digest: with n_tokens, ids_sha256, decoded_sha256 instead).

    A null or empty text has no ids. Rows, repeated ones too, and all other columns stay as they are, but those named like a new one, which it replaces.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(rank_bytes(ranks_path))
    if not digest:

        @F.pandas_udf("array<int>")
        def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            enc = encoder(sent.value, pattern)
            for s in batches:
                yield pd.Series([encode_text(enc, t) for t in s], dtype=object)

        return docs.withColumn("ids", ids_of(F.col(text)))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        enc = encoder(sent.value, pattern)
        for s in batches:
            rows = []
            for t in s:
                ids = encode_text(enc, t)
                raw = enc.decode_bytes(ids)
                rows.append((len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = ("n_tokens", "ids_sha256", "decoded_sha256")
    return docs.withColumn("_d", digest_of(F.col(text))).select(*[F.col(c) for c in docs.columns if c not in made], *[f"_d.{c}" for c in made])


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with decoded binary, the raw bytes of ids; null ids give no bytes. Ids outside the ranks raise an error."""
    sent = rows.sparkSession.sparkContext.broadcast(rank_bytes(ranks_path))

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(sent.value, pattern)
        for s in batches:
            yield pd.Series([enc.decode_bytes([int(i) for i in x]) if x is not None else b"" for x in s], dtype=object)

    return rows.withColumn("decoded", bytes_of(F.col(ids)))


def production() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, *production(), digest=True).drop("text")
