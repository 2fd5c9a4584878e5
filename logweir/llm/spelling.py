"""Spelling variants: words one edit apart, found by composing acceptors of the vocabulary with a one-edit transducer.

Words are counted over all texts first (``count_words``). Two words that are one edit apart agree before the edit and after it. So the vocabulary is
parted by first characters, where pairs that differ behind these meet, and once more by last characters (as reversed words), where those
that differ before these meet. A part holds the words that share an initial state of the composed machine: a prefix of
``START`` characters, longer ones where more than ``PART_WORDS`` words share it. A task reads its parts one after the other: minimal acceptor, composition, pairs
(``word_automaton``). A pair is reported in one part: in the second partition only if the first one parts its words.

Where long prefixes and long suffixes overlap in a word, an edit may lie in both. For such places only, the words without the character there are
joined (``_in_both``); at most one word per character of the alphabet has the same rest.

Tasks return for each word the number of near words and the best of them; Spark adds these up. Forms are followed by doubling: n grows tenfold with each
step, so a few joins suffice.

Null and empty texts have no words; a null doc_id counts as the empty text. Repeated rows count each time. Runs of letters of any length are words. An empty table
gives no words; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logweir.llm.common import stored
from logweir.llm.word_automaton import Acceptor, OneEdit

START = 3
PART_WORDS = 30_000
#: Words of a task, about.
TASK_WORDS = 8_192
#: Letters are A-Z (lowered), a-z and the characters C0 to FF; everything else, as one byte of this encoding, parts words.
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _spoiled(run: bytes, start: int, every: int) -> bytes:
    """The run, or in one of ``every`` cases by its checksum, the run without one character."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """word and n over all rows ``doc_id, text``, for words of at least ``least`` characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter((text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    if len(run) >= least and len(word := _spoiled(run, start, every)) >= least:
                        counts[word] += n
                if len(counts) > 200_000:
                    yield _batch(counts)
                    counts = Counter()
        yield _batch(counts)

    made = docs.mapInArrow(count, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def _batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _beginning(word: Column, length: Column) -> Column:
    """The first characters; a word that is shorter ends with a mark, which makes it a part of its own."""
    return F.substring(F.concat(word, F.lit("\0")), F.lit(1), length)


def _parted(words: DataFrame, word: Column, out: str, part_words: int) -> DataFrame:
    """``out``: how many first characters of ``word`` its part shares."""
    sized, length = words.withColumn(out, F.lit(START)), START
    while True:
        beginning = _beginning(word, F.lit(length))
        many = sized.where(F.col(out) == length).groupBy(beginning.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_words)
        many = stored(many.select("_part"), "spelling-parts")  # at most words / part_words rows
        if many.isEmpty():
            return sized
        longer = sized.join(F.broadcast(many), (F.col(out) == length) & (beginning == F.col("_part")), "left")
        length += 1 + length // 4
        sized = stored(longer.withColumn(out, F.when(F.col("_part").isNotNull(), length).otherwise(F.col(out))).drop("_part"), "spelling-sized")


NEAR = "word string, n_near long, best_n long, best string"


def _composed(words: DataFrame, backward: bool, tasks: int) -> DataFrame:
    """Near words of each word, for rows word, n, head, tail, from the parts of one direction."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "spelt", "n", "head")), strict=True):
                if row[0] != part:
                    if len(rows) > 1:
                        yield _near_words(rows, backward)
                    part, rows = row[0], []
                rows.append(row[1:])
        if len(rows) > 1:
            yield _near_words(rows, backward)

    word = F.reverse("word") if backward else F.col("word")
    keyed = words.select(_beginning(word, F.col("tail") if backward else F.col("head")).alias("part"), word.alias("spelt"), "n", "head")
    return keyed.repartition(tasks, "part").sortWithinPartitions("part", "spelt").mapInArrow(near, NEAR)


def _near_words(rows: list[tuple[str, int, int]], backward: bool) -> pa.RecordBatch:
    """``rows``: ascending words with n and the length of their first partition's prefix."""
    known = {w: (n, head) for w, n, head in rows}
    found: dict[str, list] = {}
    for x, y in OneEdit(Acceptor([r[0] for r in rows])).pairs():
        (n, head), (m, _) = known[x], known[y]
        if backward:
            x, y = x[::-1], y[::-1]
            if x[:head] == y[:head]:
                continue  # these share a part of the first partition
        for a, b, k in ((x, y, m), (y, x, n)):
            held = found.setdefault(a, [0, 0, ""])
            held[0] += 1
            if k > held[1] or (k == held[1] and b < held[2]):
                held[1], held[2] = k, b
    values = list(zip(*found.values(), strict=True)) or [(), (), ()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((list(found), *values), kinds, strict=True)], ["word", "n_near", "best_n", "best"])


def _in_both(words: DataFrame) -> DataFrame:
    """Near words whose edit lies in the prefix of the one partition and in the suffix of the other.

    ``at`` is a place before both ends; ``rest`` the word without its character there.
    """
    size = F.length("word")
    places = F.sequence(F.greatest(F.lit(0), size - F.col("tail")), F.least(F.col("head"), size) - 1)
    at = words.where(F.col("head") + F.col("tail") > size).select("word", "n", "tail", F.explode(places).alias("at"))
    cut = stored(
        at.select(
            *("word", "n", "tail", "at"),
            F.substring("word", F.lit(1), F.col("at")).alias("before"),
            F.substring("word", F.col("at") + 1, F.lit(1)).alias("c"),
            F.expr("substring(word, at + 2)").alias("after"),
        ).withColumn("rest", F.concat("before", "after")),
        "spelling-places",
    )
    x, y = cut.alias("x"), cut.alias("y")
    replaced = x.join(y, (F.col("x.rest") == F.col("y.rest")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.word") != F.col("y.word")))
    # In words whose lengths differ, the same character before the edit lengthens what both end with.
    run = F.length("before") - F.length(F.expr("trim(TRAILING c FROM before)"))
    differs = (F.col("after") == "") | (F.col("c") != F.substring("after", 1, 1))
    longer = cut.where(differs & (F.length("after") + run < F.col("tail"))).select("word", "n", "rest")
    shorter = words.where(F.col("head") + F.col("tail") > size).select(F.col("word").alias("short"), F.col("n").alias("short_n"))
    cut_short = longer.join(shorter, F.col("rest") == F.col("short"))
    pairs = (
        replaced.select(F.col("x.word").alias("word"), F.col("y.n").alias("k"), F.col("y.word").alias("near"))
        .unionByName(cut_short.select("word", F.col("short_n").alias("k"), F.col("short").alias("near")))
        .unionByName(cut_short.select(F.col("short").alias("word"), F.col("n").alias("k"), F.col("word").alias("near")))
    )
    return pairs.select("word", F.lit(1).cast("long").alias("n_near"), F.col("k").alias("best_n"), F.col("near").alias("best"))


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """n_near, best_n and best (the near word of largest n, of these the first) for rows word, n of at least ``2 * START`` characters; words without near ones are left out."""
    total = words.count()
    tasks = max(1, -(-total // TASK_WORDS))
    headed = _parted(words, F.col("word"), "head", part_words)
    sized = stored(_parted(headed, F.reverse("word"), "tail", part_words), "spelling-words")
    found = _composed(sized, False, tasks).unionByName(_composed(sized, True, tasks)).unionByName(_in_both(sized))
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for rows word, form: the last form on the way."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(steps.join(further, "root", "left"), "spelling-roots")
        if joined.where(F.col("next").isNotNull()).isEmpty():
            return steps
        steps = joined.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, seen: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of at least ``least`` characters that occurs ``seen`` times."""
    if least < 2 * START + 1:
        raise ValueError(f"words need at least {2 * START + 1} characters")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    words = stored(count_words(rows, least, every).where(F.col("n") >= seen), "spelling-vocabulary")
    judged = words.join(near_words(words), "word", "left")
    found = F.col("best_n") >= times * F.col("n")
    facts = stored(
        judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(found, F.col("best")).alias("form"), F.when(found, F.col("best_n")).alias("form_n")),
        "spelling-forms",
    )
    roots = _roots(facts.where(F.col("form").isNotNull()))
    return facts.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
