"""Pieces that several of these operators use: stored tables, words and shingle hashes."""

from __future__ import annotations


import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweir.session import fresh_path

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: later readers see one fixed copy."""
    path = fresh_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(rows: DataFrame, *ids: str) -> DataFrame:
    """``rows`` with its ids as strings, the form in which they go through pandas: a long column with a null is a double there."""
    return rows.withColumns({c: F.col(c).cast("string") for c in ids})


def numbered(rows: DataFrame, *ids: str) -> DataFrame:
    """Ids that were ``carried``, as long again."""
    return rows.withColumns({c: F.col(c).cast("long") for c in ids})


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def document_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for an id together with a text."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(doc_id.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))).cast("binary")))


#: Keys up to which a set of them is sent to all tasks.
SMALL_KEYS = 500_000


def without_keys(docs: DataFrame, keys: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` without the documents whose key is in ``keys`` (one column ``key``)."""
    gone = keys.select(F.col("key").alias("_gone")).distinct()
    few = gone.count() <= SMALL_KEYS
    here = document_key(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    return docs.join(F.broadcast(gone) if few else gone, here == F.col("_gone"), "left_anti")


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of equal texts: the one with the smallest id, a null id last.

    Texts without words are left alone, and so are rows equal in id and text to the one that stays.
    """
    name, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    copy = F.unhex(F.sha2(body.cast("binary"), 256))
    place = F.struct(name.isNull().alias("unnamed"), name.alias("id"), document_key(name, body).alias("key"))
    facts = stored(docs.where(body.rlike(WORD)).select(copy.alias("copy"), place.alias("place")), "copies")
    first = stored(facts.groupBy("copy").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-copies")
    few = first.count() <= SMALL_KEYS
    later = facts.join(F.broadcast(first) if few else first, "copy").where("place.key <> first.key")
    return without_keys(docs, later.select("place.key"), doc_id, text)


# Hashes of words and word shingles, for use inside tasks.

_words: dict[bytes, int] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word of the text, with A-Z in lower case."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(_words) > 250_000:
        _words.clear()
    out = np.empty(len(words), np.uint64)
    get = _words.get
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _words[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; a shorter text is one shingle, a text without words has none."""
    n = len(hashes)
    if n == 0:
        return hashes
    take = min(size, n)
    out = np.zeros(n - take + 1, np.uint64)
    for i in range(take):
        out = mixed(out * _MIX + hashes[i : n - take + 1 + i])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles(word_hashes(text), size))


