"""Ranked lexical search: the best documents for each item, by prefix trees over the documents' vectors of asked-for terms.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lowered. A term's weight falls with the documents that hold it, its share
of the score grows with its tf and falls with the document's length (``weight`` and ``term_tree.term_share``); all scores are integers.

1. One pass over the texts keeps of each document its number of terms and the tf of those terms that some item asks for. Numbers of documents and terms and
   the terms' document counts come from all documents.
2. Blocks of ``BLOCK`` documents, in the tasks that hold them, become prefix trees (``term_tree``). A share of the documents, about the
   square root of their number times the block, is searched first: the score of an item's last returned document there is a floor for
   the search over all documents, so that blocks return little beyond what ranks in the end. The floor drops no document that belongs in the result.
3. Spark ranks what the blocks return.

Items are searched by distinct texts, in groups whose texts have about ``GROUP_BYTES`` together; each group's terms go to all tasks, and
each group is one pass over the documents. Documents never move.

A null text has no terms, and a document without terms counts for nothing. An item without terms, or whose terms no document holds, returns
nothing. Each row of the documents is a document, repeated ids and texts too; equal scores go by ascending doc_id, a null id last. Rows of items equal in
id and text are one item. Texts of any length are read whole. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logweir.llm.common import stored, text_key
from logweir.llm.term_tree import TermTree

BLOCK = 1 << 14
GROUP_BYTES = 16 << 20
#: ASCII characters other than digits and letters part terms; A-Z are lowered. All bytes of other characters belong to terms.
_LOWERED = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWERED).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def term_vectors(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms) and the asked-for terms with their tf, for rows ``doc_id, text``; documents without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            keep, sizes, offsets, terms, tfs = [], [], [0], [], []
            for k, text in enumerate(batch.column("text")):
                found = terms_of(text.as_py())
                if not found:
                    continue
                counts = Counter(filter(number.__contains__, found))
                keep.append(k)
                sizes.append(len(found))
                terms.extend(map(number.__getitem__, counts))
                tfs.extend(counts.values())
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, tfs)]
            names = batch.column("doc_id").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([names, pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return stored(docs.mapInArrow(read, VECTOR), "term-vectors")


class Corpus:
    """What all tasks need of one group: the items' terms with weights, the order of the terms, and the corpus totals."""

    def __init__(self, vectors: DataFrame, numbers: dict[bytes, int], items: dict[bytes, Counter]):
        self.documents, self.terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # the group's terms at most
        df = np.zeros(len(numbers), np.int64)
        for r in held:
            df[r["t"]] = r["df"]
        order = np.lexsort((np.arange(len(df)), -df))
        self.rank = np.empty(len(df), np.int64)
        self.rank[order] = np.arange(len(df))
        weights = np.array([weight(self.documents, int(c)) if c else 0 for c in df], np.int64)
        self.items = []
        for key, counts in items.items():
            asked = [(self.rank[numbers[t]], weights[numbers[t]] * q) for t, q in counts.items() if df[numbers[t]] and weights[numbers[t]]]
            if asked:
                ranks, worth = (np.array(x, np.int64) for x in zip(*asked, strict=True))
                self.items.append((key, ranks, worth))

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 75 + (25 * n * self.documents) // self.terms


FOUND = "key binary, doc_id long, score long"


def _searcher(corpus: Corpus, most: int, floors: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(block: list[pa.RecordBatch], corpus: Corpus) -> pa.RecordBatch:
        table = pa.Table.from_batches(block).combine_chunks()
        lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
        terms, tfs = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
        sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        names = table.column("doc_id").combine_chunks()
        # A null id comes after all others.
        order = np.empty(len(names), np.int64)
        order[np.lexsort((names.fill_null(0).to_numpy(), names.is_null().to_numpy(zero_copy_only=False)))] = np.arange(len(names))
        tree = TermTree(np.r_[0, np.cumsum(sizes)], corpus.rank[terms], tfs, corpus.norm(table.column("n").to_numpy()), len(corpus.rank))
        keys, rows, scores = [], [], []
        for key, ranks, worth in corpus.items:
            found, score = tree.best(ranks, worth, order, most, floors.get(key, 1))
            keys += [key] * len(found)
            rows.append(found)
            scores.append(score)
        at = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), names.take(at), pa.array(np.concatenate(scores) if scores else np.empty(0, np.int64))], ["key", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if held + part.num_rows > BLOCK:
                    yield search(block, shared.value)
                    block, held = [], 0
                block.append(part)
                held += part.num_rows
        if held:
            yield search(block, shared.value)

    return run


def _search(vectors: DataFrame, corpus: Corpus, most: int, floors: dict[bytes, int]) -> DataFrame:
    """What the blocks return: key, doc_id, score."""
    shared = vectors.sparkSession.sparkContext.broadcast(corpus)
    run = _searcher(corpus, most, floors)
    return vectors.mapInArrow(lambda batches: run(batches, shared), FOUND)


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _best_of_group(docs: DataFrame, items: dict[bytes, str], most: int) -> DataFrame:
    """key, doc_id, score, rank for items given by key and text."""
    counts = {key: Counter(terms_of(text)) for key, text in items.items()}
    numbers = {t: i for i, t in enumerate(sorted(set().union(*counts.values())))}
    vectors = term_vectors(docs, numbers)
    corpus = Corpus(vectors, numbers, counts)
    holding = vectors.where(F.size("terms") > 0)
    floors: dict[bytes, int] = {}
    if corpus.documents > 4 * BLOCK:
        share = math.sqrt(BLOCK / corpus.documents)
        part = F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 30)) < int(share * (1 << 30))
        blocks = max(1, int(share * corpus.documents) // BLOCK)
        first = _ranked(_search(holding.where(part).coalesce(blocks), corpus, most, {}), most)
        floors = {bytes(r["key"]): r["score"] for r in first.where(F.col("rank") == most).collect()}  # a number per item of the group
    return stored(_ranked(_search(holding, corpus, most, floors), most), "search-found")


def best_documents(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = 20
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` documents of each item with the highest scores above 0."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    listed = items.select(F.col(f"`{item_id}`").alias("item_id"), text_key(F.col(f"`{item_text}`")).alias("key"), F.col(f"`{item_text}`").alias("text"))
    texts = stored(listed.select("key", "text").dropDuplicates(["key"]), "search-texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // GROUP_BYTES)
    found = None
    for g in range(groups):
        mine = texts.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g).collect()  # about GROUP_BYTES of text
        if mine:
            more = _best_of_group(rows, {bytes(r["key"]): r["text"] for r in mine}, most)
            found = more if found is None else found.unionByName(more)
    if found is None:
        found = docs.sparkSession.createDataFrame([], FOUND + ", rank int")
    return listed.select("item_id", "key").distinct().join(found, "key").select("item_id", "rank", "doc_id", "score")
