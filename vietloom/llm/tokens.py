"""Problem 8: encoding a corpus with a public byte-level BPE through a table of distinct words.

Words are split in Spark by the tokenizer's own pattern; each distinct word of the corpus is encoded once; ids go
back by position. For the way back, documents are cut into blocks of a fixed number of characters: a block's distinct
words fetch their ids by an equi-join (partial distinct first, so a word in a third of all texts is a row per block),
and a block meets its own small table once more to lay out the ids. Nothing is broadcast or collected.

Cases: null and empty texts get an empty list; strings that look like special tokens are ordinary text; ids that
repeat are each encoded; very long texts are one row of their block.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

TOKENIZERS = "/opt/tokenizers"
WHITE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The published splitting pattern of byte-level BPE, with white space spelled out for Java.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
BLOCK_CHARS = 2_000_000


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def split(df: DataFrame, text: str) -> DataFrame:
    """Adds ``words``; null and empty texts have none."""
    return df.withColumn("words", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0)))


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of a column of distinct words."""

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            w = b.column("word").to_pylist()
            ids = [e.ids for e in t.encode_batch_fast(w, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def encode(df: DataFrame, id_col: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids) of every row."""
    path = f"{folder}/{name}.json"
    kind = dict(df.dtypes)[id_col]
    size = df.agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + 8)).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_CHARS))
    parts = min(blocks, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(blocks / 8)))
    docs = df.select(F.col(id_col).alias("id"), F.col(text).alias("t"), F.pmod(F.xxhash64(id_col, text), F.lit(blocks)).cast("int").alias("block"))
    docs = split(docs.repartition(parts, "block"), "t").drop("t")
    pairs = docs.select("block", F.explode("words").alias("word")).distinct()
    pairs = written(pairs, "words") if blocks > 1 else pairs
    ids = word_table(pairs.select("word").distinct(), path)
    table = pairs.join(ids, "word").select(F.col("block").alias("own"), "word", "ids").repartition(parts, "own")

    def lay(docs: pa.Table, words: pa.Table) -> pa.Table:
        """Ids of all documents of a block by looking each word's row up."""
        w = docs["words"].combine_chunks()
        off = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(w), 0)))]).astype(np.int64)
        if not words.num_rows:
            return pa.table({"id": docs["id"], "ids": pa.array([[]] * docs.num_rows, pa.list_(pa.int32()))})
        at = pc.index_in(w.flatten(), value_set=words["word"].combine_chunks())
        found = pc.take(words["ids"].combine_chunks(), at)
        upto = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(found)))]).astype(np.int64)
        return pa.table({"id": docs["id"], "ids": pa.ListArray.from_arrays(pa.array(upto[off], pa.int32()), found.flatten().cast(pa.int32()))})

    return docs.groupBy("block").cogroup(table.groupBy("own")).applyInArrow(lay, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def pieces(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> list[tuple[int, bytes]]:
    """(id, bytes) of the vocabulary; its size is that of the tokenizer, whatever the corpus."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    vocab = tokenizer(f"{folder}/{name}.json").get_vocab()
    return [(i, bytes(back[c] for c in p) if all(c in back for c in p) else p.encode()) for p, i in vocab.items()]


def decode(df: DataFrame, id_col: str, ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, text): the way back through an id-to-piece join; an empty list gives an empty text."""
    spark = df.sparkSession
    table = spark.createDataFrame(pieces(name, folder), "token int, piece binary")
    flat = df.select(id_col, F.posexplode(ids).alias("pos", "token")).join(F.broadcast(table), "token")
    # concat_ws would need strings, and a piece may end inside a character: bytes are joined as hex digits
    joined = flat.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("x")))), lambda s: s["x"]), "").alias("x"))
    return df.select(id_col).join(joined, id_col, "left").select(id_col, F.decode(F.unhex(F.coalesce("x", F.lit(""))), "utf-8").alias("text"))
