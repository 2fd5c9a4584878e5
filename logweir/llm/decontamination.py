"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by the number of their shingles, in powers of two. A partition keeps the shingles whose hash lies below
the partition's bound, so that an item of any size retains about ``RETAINED`` to twice as many of them, and a small one all. How many of
an item's retained hashes a document holds estimates which part of the item it contains, however long the document is: no
ratio of sizes enters, as it would with the similarity of whole sketches. Pairs whose estimate is within six standard deviations of the
threshold are verified on the full sets; for items that retain everything the estimate is exact already.

Documents' shingles meet the items' by join; a bitmap of fixed size (``SLOTS``) drops most of those that no item
retains before the shuffle, and passes more of them the more items there are. A text of fewer than ``size`` words is one
shingle, so such an item is found only in documents that equal it. Null and empty texts contain nothing and are
contained in nothing. Items and documents with repeated ids are told apart by their texts. Empty tables give no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import carried, document_key, numbered, shingle_set, stored, without_keys

RETAINED = 64
SLOTS = 1 << 22
#: Documents up to which a set of them is sent to all tasks.
SMALL_ROWS = 200_000


def item_sketches(items: DataFrame, size: int, retained: int = RETAINED) -> DataFrame:
    """item_id, item (a hash of the set), n, partition, shingles (packed) and kept (those below the partition's bound)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch["item_id"], batch["text"], strict=True):
                s = shingle_set(text, size)
                if not len(s):
                    continue
                part = len(s).bit_length() - 1
                bound = min((1 << 64) - 1, (retained << 64) >> part)
                kept = s[s <= np.uint64(bound)]
                rows.append((item_id, xxhash.xxh3_64_intdigest(s.tobytes()) >> 1, len(s), part, s.tobytes(), kept.view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["item_id", "item", "n", "part", "shingles", "kept"])

    schema = "item_id string, item long, n long, part int, shingles binary, kept array<long>"
    return numbered(carried(items, "item_id").mapInPandas(read, schema), "item_id").dropDuplicates(["item_id", "item"])


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 5,
    percent: int = 80,
) -> DataFrame:
    """key (of the document), doc_id, item_id, item_shingles, shared: an item with ``percent`` of its shingles in a document."""
    spark = docs.sparkSession
    name, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    rows = docs.select(document_key(name, body).alias("key"), name.alias("doc_id"), body.alias("text"))
    listed = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    known = stored(item_sketches(listed, size), "items")
    wanted = known.select("item_id", "item", "n", F.size("kept").alias("kept_n"), F.explode("kept").alias("value"))
    slots = wanted.select(F.pmod("value", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    bits = np.zeros(SLOTS, bool)
    bits[slots] = True
    bitmap = spark.sparkContext.broadcast(np.packbits(bits))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(bitmap.value).astype(bool)
        for batch in batches:
            keys, values = [], []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                s = shingle_set(text, size).view(np.int64)
                s = s[bits[s % SLOTS]]
                keys += [key] * len(s)
                values.append(s)
            yield pd.DataFrame({"key": keys, "value": np.concatenate(values) if values else np.empty(0, np.int64)})

    found = rows.select("key", "text").mapInPandas(seen, "key binary, value long").distinct()
    least = max(0.0, percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / RETAINED))
    held = found.join(wanted, "value").groupBy("key", "item_id", "item", "n", "kept_n").agg(F.count(F.lit(1)).alias("hits"))
    enough = F.when(F.col("kept_n") == F.col("n"), F.col("hits") * 100 >= F.col("n") * percent).otherwise(F.col("hits") >= F.col("kept_n") * least)
    likely = stored(held.where(enough).select("key", "item_id", "item"), "item-pairs")

    sets = likely.join(known.select("item_id", "item", "n", "shingles"), "item").where(likely.item_id.eqNullSafe(known.item_id))
    by_doc = sets.groupBy("key").agg(F.collect_list(F.struct(known.item_id.cast("string").alias("item_id"), "n", "shingles")).alias("sets"))
    few = likely.select("key").distinct().count() <= SMALL_ROWS
    met = rows.join(F.broadcast(by_doc) if few else by_doc, "key")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, doc_id, text, sets in zip(batch["key"], batch["doc_id"], batch["text"], batch["sets"], strict=True):
                whole = shingle_set(text, size)
                for one in sets:
                    shared = int(np.isin(np.frombuffer(one["shingles"], np.uint64), whole, assume_unique=True).sum())
                    if 100 * shared >= percent * one["n"]:
                        out.append((key, doc_id, one["item_id"], one["n"], shared))
            yield pd.DataFrame(out, columns=["key", "doc_id", "item_id", "item_shingles", "shared"])

    found = carried(met, "doc_id").mapInPandas(verify, "key binary, doc_id string, item_id string, item_shingles long, shared long")
    return numbered(found, "doc_id", "item_id")


def without_items(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    bad = stored(contained_items(docs, items, **settings).select("key").distinct(), "contaminated")
    return without_keys(docs, bad, settings.get("doc_id", "doc_id"), settings.get("text", "text"))
