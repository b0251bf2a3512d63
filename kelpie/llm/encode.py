"""Encoding of a whole corpus with a public byte-level BPE tokenizer, and exact decoding.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. Two neighbouring chunks are stitched
at the first position in their overlap where both see a pre-token begin; from there on both scans agree, as a
pre-token depends only on the text that follows its start. The pieces between stitches are then encoded in parallel
and their ids joined. A text with an overlap that holds no such position (a pre-token as long as the overlap) is encoded
as one piece.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import cut as checkpoint

TOKENIZERS = os.environ.get("KELPIE_TOKENIZERS", "/opt/tokenizers")
CHUNK, OVERLAP = 2048, 256
_EDGE = 64  # the last characters of a chunk, whose pre-tokens may depend on what follows

# Fixed value: the public pre-token pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def codec(folder: str, name: str):
    """The tokenizer of one worker process; ranks are read from ``folder`` and kept for all batches."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoder(folder: str, name: str, keep: list[str], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(folder, name)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = [enc.encode_ordinary(t) if t else [] for t in texts]
            value = pa.array([len(x) for x in ids], pa.int64()) if out == "n_tokens" else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [value], names=[*keep, out])

    return run


def _encoded(texts: DataFrame, keep: list[str], out: str, folder: str, name: str) -> DataFrame:
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    kind = "long" if out == "n_tokens" else "array<int>"
    return texts.select(*keep, "text").mapInArrow(_encoder(folder, name, keep, out), f"{fields}, {out} {kind}")


def token_counts(documents: DataFrame, keep: list[str], folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``keep`` and n_tokens of each row; 0 for empty and null texts."""
    return _encoded(documents, keep, "n_tokens", folder, name)


_STARTS, _SPACE = regex.compile(PATTERN), regex.compile(r"\s")


def _starts(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[pa.RecordBatch]:
    """Pre-token starts, counted from the text's start, inside a chunk's head and tail overlap."""
    for b in batches:
        head, tail = [], []
        for text, at, last in zip(b.column("text").to_pylist(), b.column("at").to_pylist(), b.column("last").to_pylist()):
            # not behind white space, whose pre-token also depends on the character that follows it
            pos = [m.start() for m in _STARTS.finditer(text) if m.start() and not _SPACE.match(text, m.start() - 1)]
            sure = len(text) - (0 if last else min(_EDGE, overlap // 4))
            head.append([at + p for p in pos if p < overlap and p < sure])
            tail.append([at + p for p in pos if len(text) - overlap <= p < sure])
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("no"), b.column("at"), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=["doc", "no", "at", "head", "tail"])


def _pieces(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc, text) of long texts to (doc, start, text): pieces whose encodings join to the encoding of the text."""
    step = chunk - overlap
    n = F.greatest(F.ceil((F.length("text") - overlap) / step).cast("int"), F.lit(1))
    cuts = long.select("doc", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * step + 1, F.lit(chunk)))).alias("no", "text"))
    rows = cuts.select("doc", "no", (F.col("no") * step).alias("at"), (F.col("no") == F.col("n") - 1).alias("last"), "text").repartition("doc", "no")
    seen = rows.mapInArrow(lambda it: _starts(it, overlap), f"doc {long.schema['doc'].dataType.simpleString()}, no int, at int, head array<int>, tail array<int>")
    by = Window.partitionBy("doc").orderBy("no")
    sync = F.array_min(F.filter(F.array_intersect("head", F.lag("tail").over(by)), lambda p: p > F.col("at")))
    marks = seen.select("doc", "no", F.when(F.col("no") == 0, 0).otherwise(sync).alias("start"))
    # a chunk that never meets its neighbour leaves all that follow unproven: such a text is encoded whole
    met = F.count("start") == F.count("*")
    starts = marks.groupBy("doc").agg(F.when(met, F.sort_array(F.collect_list("start"))).otherwise(F.array(F.lit(0))).alias("starts"))
    text = long.join(starts, "doc")
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.length("text")))
    spans = F.arrays_zip(F.col("starts").alias("s"), ends.alias("e"))
    cut = F.transform(spans, lambda x: F.struct(x["s"].alias("start"), F.substring("text", x["s"] + 1, x["e"] - x["s"]).alias("text")))
    return text.select("doc", F.inline(cut)).repartition("doc", "start")


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id_col`` and ids (array<int>) of every row, without special tokens.

    Empty and null texts have an empty list, never null; strings that look like special tokens are ordinary text. A
    repeated row comes out as often as it goes in, as rows of texts above ``chunk`` characters, which go through
    chunks, are told apart by a running number and not by their id, which may be null.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = _encoded(docs.filter(~is_long), ["doc_id"], "ids", folder, name)
    long = docs.filter(is_long)
    numbered = checkpoint(long.select(F.struct(F.col("doc_id"), F.monotonically_increasing_id().alias("row")).alias("doc"), "text"))
    if numbered.isEmpty():
        return short.withColumnRenamed("doc_id", id_col)
    flat = numbered.select(F.col("doc.row").alias("doc"), "text")
    parts = _encoded(_pieces(flat, chunk, overlap), ["doc", "start"], "ids", folder, name)
    joined = parts.groupBy("doc").agg(F.expr("flatten(transform(array_sort(collect_list(struct(start, ids))), x -> x.ids))").alias("ids"))
    back = numbered.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.row").alias("doc")).join(joined, "doc").select("doc_id", "ids")
    return short.union(back).withColumnRenamed("doc_id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``id_col`` and text: the raw bytes of the ids, concatenated, read as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(folder, name)
        for b in batches:
            texts = [enc.decode_bytes(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")
