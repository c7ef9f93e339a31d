"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The driver reads the rank file (its size is checked) and broadcasts it. Long texts are cut where the pre-splitting
pattern cannot match across: between a letter, of any script, and white space or a full stop, comma or the like. A run of
letters ends there and the next piece starts there, so the pieces of the parts are the pieces of the whole. Decoding joins raw
bytes, never strings.

Defined cases: null texts are empty and have no ids; very long texts are encoded in parts, those without a safe boundary in
one go; repeated rows are encoded each for itself; an empty table gives an empty result; an input column that has the name of
an added one is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import free, lean
from .textnum import groups

#: The largest rank file that is broadcast, in bytes.
MAX_RANK_BYTES = 64 << 20
#: Texts longer than this many characters are cut at safe boundaries.
PART_CHARS = 1 << 16
#: Bytes of documents taken from an Arrow batch at a time.
BYTES_AT_ONCE = 1 << 20
SAFE = regex.compile(r"(?<=\p{L})(?=[\s.,;:!?。、，！？])")
KINDS = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "decoded": T.BinaryType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def read_ranks(path: str) -> bytes:
    """The rank file's bytes."""
    if (n := Path(path).stat().st_size) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has {n} bytes; at most {MAX_RANK_BYTES} are broadcast")
    return Path(path).read_bytes()


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    """The tiktoken encoding of a rank file without special tokens."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts that can be encoded one by one."""
    start = 0
    while len(text) - start > size and (m := SAFE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= PART_CHARS:
        return enc.encode_ordinary(text)
    return [i for part in parts(text) for i in enc.encode_ordinary(part)]


def encode(docs: DataFrame, rank_path: str, pattern: str, emit: tuple[str, ...] = ("ids", "n_tokens"), keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (None: all) and, for each name in ``emit``: ids, n_tokens, decoded (the ids' bytes), ids_sha256
    (of decimal ids joined by commas), decoded_sha256."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in emit]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, KINDS[k]) for k in emit])
    src = docs.select(*[docs[f"`{c}`"] for c in kept], docs["text"].alias(free(kept, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        digits = [str(i) for i in range(enc.max_token_value + 1)]
        for whole in batches:
            for batch, texts in groups(whole, whole.num_columns - 1, BYTES_AT_ONCE):
                out: dict[str, list] = {k: [] for k in emit}
                for text in texts:
                    ids = encode_text(enc, text.decode())
                    if "decoded" in out or "decoded_sha256" in out:
                        raw = enc.decode_bytes(ids)
                    for k, v in out.items():
                        if k == "ids":
                            v.append(ids)
                        elif k == "n_tokens":
                            v.append(len(ids))
                        elif k == "decoded":
                            v.append(raw)
                        elif k == "ids_sha256":
                            v.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                        else:
                            v.append(hashlib.sha256(raw).hexdigest())
                cols = [batch.column(i) for i in range(len(kept))] + [pa.array(out[k], ARROW[k]) for k in emit]
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *emit])

    return src.mapInArrow(lean(run), schema)


ARROW = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of its ids; null ids have none."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for batch in batches:
            raw = [None if x is None else enc.decode_bytes(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(raw, pa.binary())], names=[*kept, out])

    return df.select(*[df[f"`{c}`"] for c in kept], df[f"`{ids}`"].alias(free(kept, "__ids"))).mapInArrow(lean(run), schema)
