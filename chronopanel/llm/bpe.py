"""Byte-level BPE encoding and decoding over Arrow batches (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .shared import slices, text_slices


def encode(
    docs: DataFrame, model: tuple[str, ...], key: str = "doc_id", text: str = "text",
    append: int | None = None, offsets: bool = False,
) -> DataFrame:
    """Ids of every whole text: ``(key, n_tokens, ids)``, in the order and partitions of the input.

    ``model`` is ``("file", path)`` for a tokenizers file or ``("ranks", path,
    pattern)`` for ranks; ``ids`` is binary, little-endian unsigned 32-bit.
    ``append`` adds one id at each document's end.  ``offsets`` adds
    ``byte_ends``, ``char_starts`` and ``char_ends`` per text token (a token that
    holds part of a character spans that character).

    Null and empty texts have no ids but the appended one.  Repeated rows and
    null keys stay as they are; other columns, whatever their names, are left out.
    """
    fields = [docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if offsets:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("byte_ends", "char_starts", "char_ends")]

    def run(batches):
        own = tokens.encoder(*model)
        for part, texts in text_slices(batches, text):
            ids, n = own.encode(texts)
            columns = [part.column(0)]
            extra = []
            if offsets:
                bounds = np.cumsum(n)
                rows = [np.cumsum(own.table.length[ids[b - k:b]]) for b, k in zip(bounds, n)]
                spans = [tokens.character_offsets(t, r) for t, r in zip(texts, rows)]
                extra = [rows, [s[0] for s in spans], [s[1] for s in spans]]
                extra = [pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in extra]
            if append is not None:
                ids, n = np.insert(ids, np.cumsum(n), np.uint32(append)), n + 1
            columns += [pa.array(n, pa.int64()), binary(ids.astype("<u4"), n * 4), *extra]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, model: tuple[str, ...], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Bytes behind ids: ``(key, decoded)`` by the reversed byte table.

    Bytes are returned, not text, as ids may split characters; texts cut at such
    places are read with ``tokens.token_texts``.  Null ids decode to no bytes.
    """
    schema = T.StructType([encoded.schema[key], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        table = tokens.encoder(*model).table
        for batch in batches:
            sizes = [n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()]
            for lo, hi in slices(sizes):
                part = batch.slice(lo, hi - lo)
                runs = [np.frombuffer(b or b"", "<u4") for b in part.column(1).to_pylist()]
                own = np.concatenate(runs)
                raw = tokens.gather(table.flat, table.start[own], table.length[own])
                ends = np.concatenate([[0], np.cumsum(table.length[own])])
                cuts = ends[np.cumsum([len(r) for r in runs])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), binary(raw, np.diff(np.concatenate([[0], cuts])))], names=[key, "decoded"])

    return encoded.select(key, ids).mapInArrow(run, schema)


def binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column from one run of memory and the bytes of each row."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if ends[-1] < 2**31:
        return pa.BinaryArray.from_buffers(
            pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
    raw = flat.tobytes()
    return pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())
