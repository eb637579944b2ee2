"""BPE encoding and decoding of whole texts, long unsplit passages by tree concatenation."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchlake.llm.common import byte_batches, fresh, stash, table

#: A pre-token never runs from a character that is no white space into a space or line end, so text may be cut there.
PIECE = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
#: Code points of a piece that are encoded at once; longer pieces are halved.
LEAF = 4096
LONG = re.compile(r"\S{%d}" % LEAF)
#: Code points of a text that one task encodes; longer texts are dealt out.
SPREAD = 1 << 20
#: Characters that every Unicode version has in the same category: on them both libraries split alike.
SETTLED = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u024f]*")


class Codec:
    """A tokenizers file. Where the same merges lie beside it as ranks, texts of settled characters without special
    tokens go through tiktoken, which gives the same ids in a quarter of the time; all others through tokenizers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as lines:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and SETTLED.fullmatch(text) and not any(t in text for t in self.special):
            return self.fast.encode_ordinary(text)
        return self.tok.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.tok.decode(ids, skip_special_tokens=False)


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, once per worker."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def join_encoded(tok: Codec, left: tuple[list[int], str], right: tuple[list[int], str], agree: int = 2) -> tuple[list[int], str]:
    """The encoding of left text + right text from both encodings.

    A window of tokens on either side of the join is encoded anew and grows until its first and last `agree` tokens are
    those that the sides had; an encoding is right if each pair of neighbouring tokens is, and each pair now comes from
    one right encoding. A window that reaches an end of the text needs no agreement there.
    """
    (a, left_text), (b, right_text) = left, right
    if not a or not b:
        return a + b, left_text + right_text
    width = 8
    while True:
        wa, wb = min(width, len(a)), min(width, len(b))
        # Token borders inside a code point have no place in the text: such a window grows.
        head = tok.decode(a[len(a) - wa :]) if wa < len(a) else left_text
        tail = tok.decode(b[:wb]) if wb < len(b) else right_text
        if (wa == len(a) or left_text.endswith(head)) and (wb == len(b) or right_text.startswith(tail)):
            ids = tok.encode(head + tail)
            if (wa == len(a) or ids[:agree] == a[len(a) - wa :][:agree]) and (wb == len(b) or ids[-agree:] == b[:wb][-agree:]):
                return a[: len(a) - wa] + ids + b[wb:], left_text + right_text
        width *= 2


def encode_unsplit(tok: Codec, text: str, leaf: int = LEAF) -> list[int]:
    """Encode text by halves and join them, however long it is and whether or not it has a place to cut."""
    if len(text) <= leaf:
        return tok.encode(text)
    half = len(text) // 2
    left, right = text[:half], text[half:]
    return join_encoded(tok, (encode_unsplit(tok, left, leaf), left), (encode_unsplit(tok, right, leaf), right))[0]


def encode_whole(tok: Codec, text: str, leaf: int = LEAF) -> list[int]:
    """ids of a text; pieces of more than `leaf` code points without a place to cut are encoded as a tree."""
    if len(text) <= leaf or (leaf == LEAF and not LONG.search(text)):
        return tok.encode(text)
    ids: list[int] = []
    run: list[str] = []
    for piece in PIECE.findall(text):
        if len(piece) <= leaf:
            run.append(piece)
            continue
        ids += tok.encode("".join(run)) + encode_unsplit(tok, piece, leaf)
        run = []
    return ids + tok.encode("".join(run))


def _lists(ids: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1])) if len(ids) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _encoded(path: str, leaf: int, column: str, decoded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(path)
        for batch in batches:
            ids = [encode_whole(tok, t.as_py() or "", leaf) for t in batch.column(column)]
            out = batch.select([n for n in batch.schema.names if n != column]).append_column("token_ids", _lists(ids))
            yield out.append_column("decoded", pa.array(map(tok.decode, ids), pa.string())) if decoded else out

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec(path)
        for batch in batches:
            texts = [tok.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in batch.column("token_ids")]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return run


def _joined(path: str, row: str, at: str, text: str, decoded: bool):
    def run(rows: pa.Table) -> pa.Table:
        tok = codec(path)
        rows = rows.sort_by(at)
        level = [(i.as_py(), t.as_py()) for i, t in zip(rows.column("token_ids"), rows.column(text), strict=True)]
        while len(level) > 1:
            level = [join_encoded(tok, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        out = rows.slice(0, 1).select([row]).append_column("token_ids", pa.array([level[0][0]], pa.list_(pa.int32())))
        return out.append_column("decoded", pa.array([tok.decode(level[0][0])], pa.string())) if decoded else out

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", leaf: int = LEAF, spread: int = SPREAD, decoded: bool = False) -> DataFrame:
    """docs with token_ids, an array of int, as tokenizers' encode(text, add_special_tokens=False) gives them; with
    `decoded` also what decode(token_ids, skip_special_tokens=False) makes of them, by the same workers.

    A null text counts as empty and gets an empty array. Texts up to `spread` code points are encoded where they lie.
    Longer ones are written, dealt out in slices of that size, encoded in parallel and joined as a tree, one text per group;
    the row's other columns join its ids at the end, so that what is moved grows with the text. A column named token_ids (or decoded) is replaced; all other columns and all rows stay, repeated rows too.
    """
    docs = docs.drop("token_ids", *(["decoded"] if decoded else []))
    keep = docs.columns
    text, row, at, leaf_text = fresh(docs, "_text", "_row", "_leaf", "_leaf_text")
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    schema = docs.schema.add("token_ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("decoded", "string") if decoded else schema
    near = byte_batches(rows.where(F.length(text) <= spread), _encoded(path, leaf, text, decoded), schema)
    far = stash(rows.where(F.length(text) > spread).withColumn(row, F.monotonically_increasing_id()), "long_texts")
    # A slice travels with its row's number only; a pattern cuts the text in one pass from end to end.
    slices = F.posexplode(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{spread}}}"), F.lit(0)))
    leaves = far.select(row, slices.alias(at, leaf_text)).repartition(row, at).withColumn(text, F.col(leaf_text))
    done = byte_batches(leaves, _encoded(path, leaf, text), leaves.drop(text).schema.add("token_ids", T.ArrayType(T.IntegerType())))
    told = T.StructType([f for f in schema if f.name in ("token_ids", "decoded")])
    found = done.groupBy(row).applyInArrow(_joined(path, row, at, leaf_text, decoded), T.StructType([T.StructField(row, T.LongType()), *told]))
    return near.unionByName(far.select(*keep, row).join(found, row).select(*keep, *told.names))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded, the text of token_ids; special tokens are spelled out. An empty array gives an empty text."""
    return byte_batches(encoded.drop("decoded"), _decoded(path), encoded.drop("decoded").schema.add("decoded", "string"))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode() of all documents with what decoding gives: doc_id, n_tokens and both digests; a null text is empty."""
    path = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encode(docs, path, decoded=True)
    ids = F.array_join(F.transform("token_ids", lambda i: i.cast("string")), ",")
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


SQL = None
