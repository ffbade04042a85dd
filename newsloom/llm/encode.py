"""Problem 8: encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.bpe import TOKENIZER_DIR, VOCABULARY, load_vocabulary, worker_encoder


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(id_col, ids ARRAY<INT>) for every row of ``df``.

    Map-only: one pass, no shuffle; only the two columns are read. The vocabulary (fixed size, about 2 MB) is broadcast.
    Empty and null texts give an empty list, null ids stay null, repeated rows come out repeated, an empty table gives
    none, and any other columns are ignored, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer_dir, vocabulary))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = worker_encoder(f"{tokenizer_dir}/{vocabulary}", shared).encode
        for b in batches:
            lists = [encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)
