"""Packing by power-of-two decomposition.

A document of T tokens is cut along the binary digits of T: as many pieces of ``LENGTH`` as fit, then
one piece for every set bit of the rest, longest first. Pieces of equal length form a bucket, and every
piece is a sequence by itself: lengths are powers of two, so nothing is padded and no sequence crosses documents.
Sequences are numbered by bucket, so that a batch is a run of sequences of one length.

Edge cases: a null or empty text is the end token alone (one piece of length 1); very long texts give more pieces,
never longer ones; repeated rows are separate documents; an empty table gives no pieces; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import numbered, small
from tagloom.session import stage

LENGTH = 1024
END = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a tokenizer file, as little-endian 32-bit integers.

    A byte-level BPE whose ids are its merge order (the default file) gives the same ids through
    ``tiktoken``, three times as fast; texts that hold the string of a special token, and
    any other kind of file, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = self._fast(path, set(added))

    @staticmethod
    def _fast(path: str, added: set[str]):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
        plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and not spec.get("normalizer")
        if model.get("type") != "BPE" or not plain:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [model["vocab"]["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            return None
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self.special is not None and self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Kept by a Python worker from task to task."""
    return Encoder(path)


def lengths(total: int, longest: int = LENGTH) -> list[int]:
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(longest.bit_length(), -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    path = tokenizer or default_tokenizer()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        encode = encoder(path)
        for batch in small(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                start = 0
                for n in lengths(len(ids)):
                    raw = ids[start : start + n].tobytes()
                    for column, value in zip(out, (doc, start, n, crc32(raw), len(ids), raw)):
                        column.append(value)
                    start += n
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            arrays = [pa.array(v, t) for v, t in zip(out, types)]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(arrays[:keep], names=names[:keep])

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset (0: a sequence is one piece)."""
    order = ["length", "doc_id", "start", "ids_crc32", "doc_tokens"]
    cut = stage(pieces(docs, tokenizer, with_ids))  # range bounds are drawn by a pass of their own
    return numbered(cut, order, "sequence_id").withColumn("offset", F.lit(0).cast("long"))
