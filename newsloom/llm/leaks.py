"""Problem 9: passages of held-out items inside corpus documents, by a prefix-filtered containment join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.shingling import WORDS_PLAIN, WordHash, hashed, shingles, words
from newsloom.operators.similar import lists, longs
from newsloom.runtime import BitFilter, materialize

_memo = WordHash()
#: Bits of the filter that every executor holds: 16 MB, whatever the number of items.
FILTER_BITS = 27


def _hashes(text: str | None, run: int, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The ``k``-word shingles of a text and the digests of its windows of ``run`` words; None if it has no window."""
    ws = words(text or "", WORDS_PLAIN)
    if len(ws) < run:
        return None
    h = hashed(ws, _memo)
    return shingles(h, k), shingles(h, run) | np.uint64(1)


def _around(starts: np.ndarray, per: int, most: int) -> np.ndarray:
    """All positions of shingles inside the windows that begin at ``starts``."""
    inside = np.zeros(most + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + per, -1)
    return np.flatnonzero(np.cumsum(inside)[:most])


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "item_text",
    run: int = 12,
    k: int = 5,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(id_col, item_id_col), once each, of documents with at least ``run`` consecutive words of an item.

    Words are lower-case runs of ASCII letters and digits. Every ``run``-word window of an item is a set of ``run - k + 1``
    shingles; a document that contains the window contains them all, in place.
    1. Items become rows of windows; their shingles set bits of a filter of fixed size (2^filter_bits), the only thing
       that is broadcast. A full filter lets more through and loses nothing.
    2. The corpus is read once: a window of a document goes on if all its shingles pass the filter. Of these windows the
       shingles come out with their position and the digests of the windows around them.
    3. Shingles are ordered by rarity, counted over all that came out; of each item window the rarest is its prefix, since
       one shared token is necessary and enough to meet. Prefixes are joined with the documents' shingles; the positional
       and length bounds place the window, and its digest must agree (64 bits beside the 64 of the shingle).
    Items and documents are both distributed; no document text is shuffled, and only bits of the filter reach the driver.
    Null or short texts on either side match nothing, null ids are left out, repeated rows count once, extra columns
    are ignored.
    """
    if run < k:
        raise ValueError("a run must hold at least one shingle")
    per = run - k + 1
    texts = documents.select(documents[id_col].alias("id"), documents[text_col].alias("text")).where("id is not null and text is not null")
    own = items.select(items[item_id_col].alias("item"), items[item_text_col].alias("item_text")).where("item is not null and item_text is not null")
    id_type, item_type = texts.schema["id"].dataType.simpleString(), own.schema["item"].dataType.simpleString()

    def windows(batches):
        for b in batches:
            rows, digests, sets = [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                both = _hashes(t, run, k)
                if both:
                    sh, dg = both
                    rows += [r] * len(dg)
                    digests.append(dg)
                    sets += list(np.lib.stride_tricks.sliding_window_view(sh, per))
            flat = np.concatenate(digests) if digests else np.empty(0, np.uint64)
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), longs(flat), lists(sets)], ["item", "digest", "shingles"])

    wanted = materialize(own.mapInArrow(windows, f"item {item_type}, digest bigint, shingles array<bigint>").distinct(), "item-windows")
    known = BitFilter(wanted.select(F.explode("shingles").alias("shingle")), filter_bits)

    def probe(batches):
        for b in batches:
            rows, tokens, around = [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                both = _hashes(t, run, k)
                if not both:
                    continue
                sh, dg = both
                passed = np.concatenate([[0], np.cumsum(known.passes(sh))])
                whole = passed[per:] - passed[:-per] == per
                if not whole.any():
                    continue
                places = _around(np.flatnonzero(whole), per, len(sh))
                starts = places[:, None] - np.arange(per)[None, :]
                valid = (starts >= 0) & (starts < len(dg))
                starts[~valid] = 0
                rows += [r] * len(places)
                tokens.append(sh[places])
                around += list(np.where(valid & whole[starts], dg[starts], np.uint64(0)))
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), longs(flat), lists(around)], ["id", "shingle", "digests"])

    probes = materialize(texts.mapInArrow(probe, f"id {id_type}, shingle bigint, digests array<bigint>"), "probes")
    rarity = probes.groupBy("shingle").agg(F.count("*").alias("n"))
    tokens = wanted.select("item", "digest", F.posexplode("shingles").alias("offset", "shingle")).join(rarity, "shingle")
    prefix = tokens.groupBy("item", "digest").agg(F.min(F.struct("n", "shingle", "offset")).alias("p")).select("item", "digest", "p.shingle", "p.offset")
    met = probes.join(prefix, "shingle").where(F.get("digests", F.col("offset")) == F.col("digest"))
    return met.select("id", "item").distinct().withColumnsRenamed({"id": id_col, "item": item_id_col})
