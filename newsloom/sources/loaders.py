"""Readers of labelled datasets: JSON arrays, tables with summaries, zipped text folders, labelled sentences."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import word_count
from newsloom.operators.topics import round_robin

#: All loaders give these columns; reference_content and metadata are JSON text.
DOCUMENT = "external_id string, split string, title string, primary_text string, reference_content string, metadata string"


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_i``, the position over all files in the order of their paths, from ``_file`` and ``_row`` (the position in the file).

    Only one count per file is gathered, so the number of files bounds what the window holds.
    """
    sizes = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_start"))
    return rows.join(starts, "_file").withColumn("_i", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def _parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")))


def box_scores(spark: SparkSession, folder: str, split: str = "train", limit: int | None = None) -> DataFrame:
    """Games of ``<folder>/<split>.json``, one JSON array a file; the external id is the split and the position over all files.

    A file is read whole by one task, as an array can't be split; a pattern of files is read in parallel.
    """
    files = spark.read.format("binaryFile").load(f"{folder}/{split}.json").select("path", "content")

    def run(frames):
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"]):
                for i, g in enumerate(json.loads(raw.decode("utf-8"))[:limit]):
                    names = {k: str(g.get(k) or "") for k in ("home_name", "vis_name", "home_city", "vis_city", "day")}
                    text = g.get("summary") or ""
                    text = " ".join(text) if isinstance(text, list) else text
                    content = {k: g.get(k) or {} for k in ("box_score", "home_line", "vis_line")}
                    meta = {"home_team": names["home_name"], "away_team": names["vis_name"], "home_city": names["home_city"], "away_city": names["vis_city"], "day": names["day"]}
                    title = f"{names['vis_city']} {names['vis_name']} @ {names['home_city']} {names['home_name']}"
                    rows.append((path, i, split, title, text, json.dumps(content), json.dumps(meta)))
            yield pd.DataFrame(rows, columns=["_file", "_row", "split", "title", "primary_text", "reference_content", "metadata"])

    games = numbered(files.mapInPandas(run, "_file string, _row bigint, " + DOCUMENT.split(", ", 1)[1]))
    kept = games if limit is None else games.where(F.col("_i") < limit)
    return kept.select(F.concat(F.lit(f"{split}_"), F.col("_i").cast("string")).alias("external_id"), "split", "title", "primary_text", "reference_content", "metadata")


def summaries(spark: SparkSession, path: str, split: str = "train", limit: int | None = None) -> DataFrame:
    """Parquet rows of (text, summary, title); rows without a text or summary go, positions in the id are those before."""
    rows = _parquet_rows(spark, path)
    kept = rows.where((F.coalesce("text", F.lit("")) != "") & (F.coalesce("summary", F.lit("")) != ""))
    if limit is not None:
        kept = kept.orderBy("_i").limit(limit)
    meta = F.struct(F.lit(split).alias("split"), F.length("text").alias("text_length"), F.length("summary").alias("summary_length"))
    return kept.select(
        F.concat(F.lit(f"{split}_"), F.col("_i").cast("string")).alias("external_id"), F.lit(split).alias("split"), F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("primary_text"),
        F.to_json(F.struct("summary")).alias("reference_content"), F.to_json(meta).alias("metadata"),
    )


# Folders of the zipped texts and their labels, in the order of turns.
FOLDERS = {"Left Data": "left", "Center Data": "center", "Right Data": "right"}


def zipped_texts(spark: SparkSession, path: str, split: str = "train", limit: int | None = None, min_words: int = 20) -> DataFrame:
    """Text files of zip archives, labelled by folder; bad UTF-8 is replaced, short texts go, ``limit`` takes labels in turn."""
    archives = spark.read.format("binaryFile").load(path).select("content")

    def run(frames):
        for frame in frames:
            rows = []
            for raw in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in z.namelist():
                        label = next((v for k, v in FOLDERS.items() if f"{k}/" in name), None)
                        if label and name.endswith(".txt"):
                            rows.append((name, label, z.read(name).decode("utf-8", errors="replace").strip()))
            yield pd.DataFrame(rows, columns=["name", "label", "text"])

    rows = archives.mapInPandas(run, "name string, label string, text string").where(word_count(F.col("text")) >= min_words)
    order = F.array_position(F.array(*map(F.lit, FOLDERS.values())), F.col("label"))
    rows = rows.withColumn("label_order", order)
    if limit is not None:
        rows = round_robin(rows, "label_order", [F.asc("name")], limit)
    stem = F.regexp_extract("name", r"([^/]+)\.txt$", 1)
    return rows.select(
        F.concat(F.lit(f"{split}_"), "label", F.lit("_"), stem).alias("external_id"), F.lit(split).alias("split"), stem.alias("title"), F.col("text").alias("primary_text"),
        F.to_json(F.struct("label")).alias("reference_content"), F.to_json(F.struct(F.col("name").alias("file"), word_count(F.col("text")).alias("word_count"))).alias("metadata"),
    )


def labelled_sentences(spark: SparkSession, path: str, split: str = "train", limit: int | None = None) -> DataFrame:
    """Parquet rows of (text, label, label_text); a missing label_text follows from the label (0 objective, else subjective)."""
    rows = _parquet_rows(spark, path).where(F.coalesce("text", F.lit("")) != "")
    if limit is not None:
        rows = rows.orderBy("_i").limit(limit)
    name = F.coalesce("label_text", F.when(F.col("label") == 0, "objective").otherwise("subjective"))
    return rows.select(
        F.concat(F.lit(f"{split}_"), F.col("_i").cast("string")).alias("external_id"), F.lit(split).alias("split"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("primary_text"),
        F.to_json(F.struct(F.col("label"), name.alias("label_text"))).alias("reference_content"), F.lit("{}").alias("metadata"),
    )


#: Loaders by name with their splits; add() extends both.
LOADERS: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {
    "rotowire": (box_scores, ["train", "valid", "test"]),
    "billsum": (summaries, ["train", "test", "ca_test"]),
    "political_bias": (zipped_texts, ["train"]),
    "subj": (labelled_sentences, ["train", "validation", "test"]),
}


def add(name: str, loader: Callable[..., DataFrame], splits: list[str]) -> None:
    LOADERS[name] = (loader, splits)


def load(spark: SparkSession, name: str, path: str, split: str = "train", limit: int | None = None) -> DataFrame:
    loader, splits = LOADERS[name]
    if split not in splits:
        raise ValueError(f"{name} has the splits {', '.join(splits)}")
    return loader(spark, path, split, limit)
