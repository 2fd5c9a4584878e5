"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(group | history) P(class | group, history) P(word | class). The first two are softmaxes over
``WIDTH`` outcomes whose scores add up the weights of hashed features of the history: a bias, the last word, the last two
words and the word before the last (skip). The last factor is the word's share of its class.
Frequent words (at most ``DICTIONARY``) are dealt to classes by frequency; all others go to the last ``RARE`` classes by hash. Each
rare class keeps the mass of its words seen once for words that training never saw, counted as one outcome, so that all factors
add up to one.

Word counts cover all training documents and grow with them; they are never gathered in one place. Training is a pass over the
training documents in ``ROUNDS`` rounds: tasks update their copy of the two weight tables (``ROWS`` rows of ``WIDTH``, whatever the
input's size) with each batch's gradients, and the changes of all tasks are added up by row, weighted by the tasks'
tokens. Counts of rare words reach the scores by join.

Null and empty texts are just the end token. Rows are scored one by one, repeated ones too; a null id counts as the empty
text when documents are held out. Tables without training documents give a model that knows no word.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from logweir.llm.common import carried, mixed, numbered, stored

WIDTH = 16
RARE = 8
DICTIONARY = 1 << 15
LONGEST = 64
ROWS = 1 << 16
ROUNDS = 2
RATE = 0.5
BATCH = 1 << 15
#: Tokens that are scored at once: their arrays stay in a core's cache.
SCORED = 1 << 12
#: Tokens that a training task takes at least: it sends a change for most rows, however little it has read.
TASK_TOKENS = 4_000_000
END = b"\n"

_SCALE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def is_held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _rare_classes(tokens: list[bytes]) -> np.ndarray:
    named = np.fromiter(map(xxhash.xxh64_intdigest, tokens, repeat(1)), np.uint64, len(tokens))
    return WIDTH * WIDTH - RARE + (named % np.uint64(RARE)).astype(np.int64)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, class of its hash, count) over all given documents, counted per batch before the shuffle."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(tokens_of(text))
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    made = docs.select("text").mapInPandas(tally, "token binary, cls int, n long")
    return stored(made.groupBy("token", "cls").agg(F.sum("n").alias("n")), "token-counts")


def _counted(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame({"token": list(counts), "cls": _rare_classes(list(counts)), "n": list(counts.values())})


class Vocabulary:
    """What every task needs: the frequent words with their classes and shares, and the totals of the rare classes."""

    def __init__(self, counts: DataFrame):
        self.train_tokens, self.words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        short = counts.where(F.octet_length("token") <= LONGEST)
        top = short.orderBy(F.desc("n"), "token").limit(DICTIONARY).toPandas()
        self.top = [bytes(t) for t in top["token"]]
        self.top_counts = top["n"].to_numpy(np.int64)
        frequent = counts.sparkSession.createDataFrame(pd.DataFrame({"token": self.top or [b"\n"]}), "token binary")
        rest = counts.join(F.broadcast(frequent), "token", "left_anti")
        sums = rest.groupBy("cls").agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
        self.rare_once = dict.fromkeys(range(WIDTH * WIDTH - RARE, WIDTH * WIDTH), 1) | {r["cls"]: r["once"] + 1 for r in sums}
        self.rare_total = dict(self.rare_once)
        for r in sums:
            self.rare_total[r["cls"]] += r["n"]
        share = np.sqrt(self.top_counts.astype(float))
        # Every word takes at least its own step of the cumulated roots of the counts.
        share = np.cumsum(share) / max(1.0, share.sum())
        self.top_class = np.minimum((share * (WIDTH * WIDTH - RARE)).astype(np.int32), WIDTH * WIDTH - RARE - 1)
        totals = np.bincount(self.top_class, self.top_counts, WIDTH * WIDTH)
        self.top_within = np.log10(self.top_counts / totals[self.top_class]) if len(top) else np.empty(0)

    @property
    def base_total(self) -> int:
        return self.train_tokens + self.words + 1


class _Numbers(defaultdict):
    """Word numbers that grow with the words asked for; hash and class by number."""

    def __init__(self, words: Vocabulary):
        super().__init__(count(len(words.top)).__next__, {t: i for i, t in enumerate(words.top)})
        self.names = list(words.top)
        self.hash = np.array([xxhash.xxh64_intdigest(t) for t in words.top], np.uint64)
        self.cls = words.top_class.astype(np.int64)

    def settle(self) -> None:
        """Hashes and classes of the words that came since the last call."""
        new = list(islice(reversed(self), len(self) - len(self.names)))[::-1]
        self.names += new
        self.hash = np.r_[self.hash, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))]
        self.cls = np.r_[self.cls, _rare_classes(new)]


class _Reader:
    """Turns texts of a batch into arrays: a task's words get numbers once."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.number = _Numbers(words)

    def read(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per text its word numbers; hashes and classes by number."""
        if len(self.number) > 2_000_000:
            self.number = _Numbers(self.words)
        number = self.number.__getitem__
        numbers = [np.fromiter(map(number, row), np.int64, len(row)) for row in map(tokens_of, texts)]
        self.number.settle()
        return numbers, self.number.hash, self.number.cls


def _features(numbers: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """Hashed features of the history of every token of every text; histories end at a text's start."""
    pad = np.uint64(0x5DEECE66D)
    lengths = [len(r) for r in numbers]
    flat = np.full(sum(lengths) + 2 * len(lengths), pad, np.uint64)
    at = np.empty(sum(lengths), np.int64)
    place = done = 0
    for row, n in zip(numbers, lengths, strict=True):
        flat[place + 2 : place + 2 + n] = hashes[row]
        at[done : done + n] = np.arange(place + 2, place + 2 + n)
        place += n + 2
        done += n
    one, two = flat[at - 1], flat[at - 2]
    a, b, c, d, e = _SCALE
    return np.stack([np.full(len(at), e), mixed(one * a), mixed(one * b + two * c), mixed(two * d)])


def _rows_of(features: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the outer and of the inner table, by feature; ``ROWS`` is as large as 16 bits allow."""
    inner = (features + (groups.astype(np.uint64) + np.uint64(1)) * _SCALE[0]) * _SCALE[1]
    return features.astype(np.uint16), (inner >> np.uint64(48)).astype(np.uint16)


def _sums(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = table.take(rows[0], axis=0)
    for r in rows[1:]:
        total += table.take(r, axis=0)
    return total


def _log_shares(scores: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Log of the softmax at the wanted outcomes; outcomes are laid out as rows, over which numpy sums fast."""
    by_outcome = np.ascontiguousarray(scores.T)
    by_outcome -= by_outcome.max(axis=0)
    found = by_outcome[wanted, np.arange(len(wanted))]
    return found - np.log(np.exp(by_outcome, out=by_outcome).sum(axis=0))


def _slopes(scores: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Gradient of the log softmax at the wanted outcomes."""
    by_outcome = np.ascontiguousarray(scores.T)
    by_outcome -= by_outcome.max(axis=0)
    np.exp(by_outcome, out=by_outcome)
    by_outcome /= -by_outcome.sum(axis=0)
    by_outcome[wanted, np.arange(len(wanted))] += 1
    return np.ascontiguousarray(by_outcome.T)


def _summed(slope: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``slope`` in ``order``, from each start to the next."""
    ends = np.r_[starts[1:], len(order)]
    if len(starts) > 4 * WIDTH:  # most rows occur once
        sums, several = slope.take(order[starts], axis=0), ends - starts > 1
        order = order[np.repeat(several, ends - starts)]
        sizes = (ends - starts)[several]
        if len(sizes):
            sums[several] = np.add.reduceat(slope.take(order, axis=0), np.cumsum(sizes) - sizes, axis=0)
        return sums
    ordered = slope.take(order, axis=0)
    return np.stack([np.einsum("ij->j", ordered[a:b]) for a, b in zip(starts, ends, strict=True)])  # bias rows: few and long


def _class_scores(weights: np.ndarray, features: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log10 probability of each token's class."""
    groups, inside = cls // WIDTH, cls % WIDTH
    outer, inner = _rows_of(features, groups)
    first = _log_shares(_sums(weights[0], outer), groups).astype(float)
    return (first + _log_shares(_sums(weights[1], inner), inside)) / np.log(10)


def _update(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> None:
    """One gradient step on a batch: rows that occur share the batch's mean gradient, with a step that shrinks with use."""
    slope = _slopes(_sums(table, rows), wanted)
    for r in rows:
        order = np.argsort(r, kind="stable")
        ordered = r[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        gradient = _summed(slope, order, starts)
        used = ordered[starts]
        past = squares.take(used, axis=0)
        past += gradient * gradient
        squares[used] = past
        past += np.float32(1)
        gradient *= np.float32(RATE)
        gradient /= np.sqrt(past, out=past)
        table[used] += gradient


def train(docs: DataFrame, words: Vocabulary) -> np.ndarray:
    """Weights after one pass over ``docs`` (columns part, text), a share of them in each round."""
    spark = docs.sparkSession
    weights = np.zeros((2, ROWS, WIDTH), np.float32)
    if not words.top:
        return weights
    shared_words = spark.sparkContext.broadcast(words)
    columns = [f"w{i}" for i in range(WIDTH)]
    schema = "row int, tokens long, " + ", ".join(f"{c} float" for c in columns)
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start = shared.value  # noqa: B023
            local, squares, seen = start.copy(), np.zeros(start.shape, np.float32), 0
            reader = _Reader(shared_words.value)
            for batch in batches:
                texts = list(batch["text"])
                for piece in _pieces(texts):
                    numbers, hashes, classes = reader.read(piece)
                    features = _features(numbers, hashes)
                    cls = classes[np.concatenate(numbers)]
                    seen += len(cls)
                    for at in range(0, len(cls), BATCH):
                        some, wanted = features[:, at : at + BATCH], cls[at : at + BATCH]
                        outer, inner = _rows_of(some, wanted // WIDTH)
                        _update(local[0], squares[0], outer, wanted // WIDTH)
                        _update(local[1], squares[1], inner, wanted % WIDTH)
            change = (local - start).reshape(-1, WIDTH)
            rows = np.flatnonzero(change.any(axis=1))
            out = pd.DataFrame(change[rows] * np.float32(seen), columns=columns)
            out.insert(0, "tokens", np.full(len(rows), seen))
            out.insert(0, "row", rows.astype(np.int32))
            yield out

        tasks = max(1, words.train_tokens // (ROUNDS * TASK_TOKENS))
        part = docs.where(F.col("part") == k).select("text").coalesce(tasks)
        summed = part.mapInPandas(learn, schema).groupBy("row").agg(F.sum("tokens").alias("tokens"), *[F.sum(c).alias(c) for c in columns])
        got = summed.toPandas()  # at most 2 * ROWS rows
        flat = weights.reshape(-1, WIDTH).copy()
        flat[got["row"].to_numpy()] += (got[columns].to_numpy() / got["tokens"].to_numpy()[:, None]).astype(np.float32)
        weights = flat.reshape(weights.shape)
    return weights


def _pieces(texts: list[str | None], characters: int = 1 << 20) -> Iterator[list[str | None]]:
    """The texts in runs of bounded size."""
    piece, held = [], 0
    for t in texts:
        piece.append(t)
        held += len(t or "")
        if held >= characters:
            yield piece
            piece, held = [], 0
    if piece:
        yield piece


def score(docs: DataFrame, words: Vocabulary, weights: np.ndarray, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for rows ``doc_id, held_out, text``."""
    spark = docs.sparkSession
    shared_words, shared = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(weights)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared_words.value
        reader, top = _Reader(w), len(w.top)
        base = np.log10((w.top_counts + 1) / w.base_total) if top else np.empty(0)
        first, done = TaskContext.get().partitionId() << 33, 0  # a row's number, for the join of its rare words
        for batch in batches:
            ids, out_flags = batch["doc_id"], batch["held_out"]
            at = 0
            for piece in _pieces(list(batch["text"])):
                numbers, hashes, classes = reader.read(piece)
                names = reader.number.names
                features = _features(numbers, hashes)
                cls = classes[np.concatenate(numbers)]
                parts = [_class_scores(shared.value, features[:, i : i + SCORED], cls[i : i + SCORED]) for i in range(0, len(cls), SCORED)]
                scores, place, rows = np.concatenate(parts), 0, []
                for k, row in enumerate(numbers):
                    common = row[row < top]
                    rare, n = np.unique(row[row >= top], return_counts=True)
                    total = float(scores[place : place + len(row)].sum() + w.top_within[common].sum())
                    own = ([names[i] for i in rare.tolist()], n, classes[rare].astype(np.int32))
                    rows.append((first + done, ids.iloc[at + k], bool(out_flags.iloc[at + k]), len(row), len(common), float(base[common].sum()), total, *own))
                    done += 1
                    place += len(row)
                at += len(piece)
                yield pd.DataFrame(rows, columns=["key", "doc_id", "held_out", "n_tokens", "known", "base", "score", "token", "n", "cls"])

    schema = (
        "key long, doc_id string, held_out boolean, n_tokens long, known long, base double, score double, "
        "token array<binary>, n array<long>, cls array<int>"
    )
    scored = stored(numbered(carried(docs.select("doc_id", "held_out", "text"), "doc_id").mapInPandas(judge, schema), "doc_id"), "lm-scores")
    rare = scored.select("key", F.inline(F.arrays_zip("token", "n", "cls"))).join(counts.select("token", F.col("n").alias("c")), "token", "left")
    once, total = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (words.rare_once, words.rare_total))
    seen = F.coalesce("c", F.lit(0))
    within = F.log10(F.when(seen > 0, seen).otherwise(once[F.col("cls")]) / total[F.col("cls")])
    sums = rare.groupBy("key").agg(
        F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((seen + 1) / F.lit(words.base_total))).alias("rare_base"),
        F.sum(F.col("n") * within).alias("rare_score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.drop("token", "n", "cls").join(sums, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("known", "rare_known").cast("long").alias("n_known"),
        F.lit(words.train_tokens).cast("long").alias("train_tokens"),
        plus("base", "rare_base").alias("base_score"),
        plus("score", "rare_score").alias("score"),
    )


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """Learns from the documents that are not held out and scores all of them."""
    name = F.col(f"`{doc_id}`")
    rows = docs.select(name.cast("long").alias("doc_id"), is_held_out(name, folds, fold).alias("held_out"), F.col(f"`{text}`").alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = count_tokens(training)
    words = Vocabulary(counts)
    parts = training.select(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).alias("part"), "text")
    return score(rows, words, train(parts, words), counts)
