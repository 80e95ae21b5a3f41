"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

Method: forced-boundary splitting. A pair of neighbouring bytes that occurs inside no
vocabulary token can't be bridged by any merge, so the text may be cut there. Fragments
are encoded independently and the ids concatenated. Of the cuts allowed only those are
made that leave fragments of :data:`FRAGMENT` bytes or more: shorter ones cost more calls
than they save.

A cut must also leave the pre-tokenizer's pieces as they are. Its pattern looks ahead
only from white space (``\\s+(?!\\S)``) and treats an apostrophe specially
(``'s``, ``'t`` ...), so no cut is made after white space, before an apostrophe or
inside a UTF-8 character; everywhere else a fragment's pieces equal the text's pieces
up to the cut, which no merge crosses.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes a fragment has at least, unless its text ends. Changes speed only.
FRAGMENT = 1024


def tokenizer_dir() -> str:
    """Folder of the public vocabulary files: ``CHAINLOOM_TOKENIZERS``, else where they are installed."""
    return os.environ.get("CHAINLOOM_TOKENIZERS", "/opt/tokenizers")


def _pattern(folder: str) -> str:
    spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(folder, "__init__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod.PATTERN


class FragmentEncoder:
    """A vocabulary and the byte pairs at which texts may be cut."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        bridged = np.zeros((256, 256), bool)
        for token in ranks:
            t = np.frombuffer(token, np.uint8)
            bridged[t[:-1], t[1:]] = True
        self.cut = ~bridged
        left = np.zeros(256, bool)
        left[0x21:0x7F] = True  # visible ASCII
        left[0x80:0xC0] = True  # last byte of a longer character
        # fixed values: last bytes of U+0085, U+00A0, U+1680, U+2000-200A, U+2028/9, U+202F, U+205F, U+3000
        left[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = False
        self.cut[~left] = False
        self.cut[:, 0x80:0xC0] = False
        self.cut[:, ord("'")] = False

    def fragments(self, data: np.ndarray, offsets: np.ndarray, least: int | None = None) -> np.ndarray:
        """Offsets at which fragments begin: every text that isn't empty, and cuts at least ``least`` bytes after the beginning before."""
        least = FRAGMENT if least is None else least
        at = (np.flatnonzero(self.cut[data[:-1], data[1:]]) + 1) if len(data) > 1 else np.zeros(0, np.int64)
        out: list[int] = []
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            while s < e:
                out.append(s)
                i = int(np.searchsorted(at, s + least)) if e - s > least else len(at)
                s = int(at[i]) if i < len(at) else e
                s = min(s, e)
        return np.array(out, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offset of each text's first id (one more at the end)."""
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64, count=texts.offset + len(texts) + 1)[texts.offset :]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        body = data.tobytes()
        cuts = self.fragments(data, offsets)
        ends = np.append(cuts[1:], len(data)) if len(cuts) else cuts
        out: list[int] = []
        counts = np.zeros(len(cuts) + 1, np.int64)
        plain, extend = self._bpe.encode_ordinary, out.extend
        for i, (s, e) in enumerate(zip(cuts.tolist(), ends.tolist())):
            extend(plain(body[s:e].decode("utf-8")))
            counts[i + 1] = len(out)
        bounds = counts[np.searchsorted(cuts, offsets)]
        bounds[-1] = len(out)
        return np.array(out, dtype=np.int32), bounds


_ENCODERS: dict[str, FragmentEncoder] = {}


def _encoder(folder: str, vocabulary: str) -> FragmentEncoder:
    key = f"{folder}/{vocabulary}"
    if key not in _ENCODERS:
        _ENCODERS[key] = FragmentEncoder(key, _pattern(folder))
    return _ENCODERS[key]


def _batches(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text, one row at least."""
    size = 0
    first = 0
    for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        if size + (n or 0) > most and i > first:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n or 0
    if len(batch) > first:
        yield batch.slice(first)


def encode(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), *, count_only: bool = False, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """``keys`` and the token ids of ``text``: ``ids`` (array of int), or only ``n_tokens``.

    One row for each row of ``df``; repeated rows stay repeated. A null and an empty text
    have the empty list. Special tokens' strings are ordinary text. Other columns are
    dropped, so clashing names can't arise. An empty table gives an empty result.
    """
    folder = folder or tokenizer_dir()
    source = df.select(*keys, F.col(text).alias("text"))
    result = T.StructField("n_tokens", T.LongType(), False) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)
    schema = T.StructType([*[source.schema[k] for k in keys], result])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(folder, vocabulary)
        for whole in batches:
            for batch in _batches(whole):
                ids, bounds = enc.encode(batch.column("text"))
                made = pa.array(np.diff(bounds)) if count_only else pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], made], names=[*keys, result.name])

    return source.mapInArrow(run, schema)
