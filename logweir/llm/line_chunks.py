"""Line dedup by content-defined chunks: runs of lines that occur in several places stay in the first place only.

Native DataFrame code. A rolling hash over the hashes of the last two lines chooses chunk ends, so that a shared passage is cut
alike wherever it stands. An end is skipped where the chunk would have one line only, and a single last line belongs to the chunk before, so that
every line of a text of several lines is in a chunk that can be removed: a copy loses all of them. Chunks with a word are counted over all documents by a 128-bit hash. Of a
repeated chunk the occurrence with the smallest id (then text hash, then line) is kept and the others are marked; the
marks join their documents once, and the bytes of equally hashed chunks are compared before anything is removed: a hash
with two different contents is left alone.

Null texts stay null. Null ids sort after others. Rows equal in id and text count as one document and lose the same lines.
Documents of one line never lose it. Other columns of ``docs`` are kept; results are named as the caller says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweir.functions.binding import let
from logweir.llm.common import WORD, stored

MODULUS = 3
MIXER = 40_503


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's md5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def roll(before: Column, here: Column) -> Column:
    """16 bits that depend on all bits of the hashes of a line and the one before it."""
    low = F.lit(1 << 32)
    return F.shiftright((before * 31 + here) % low * MIXER % low, 16)


def chunks(text: Column, modulus: int = MODULUS) -> Column:
    """Array of (start line, lines, hash) of the chunks that can be removed."""

    def ends(hashes: Column) -> Column:
        last = F.size(hashes) - 1
        rolled = F.transform(hashes, lambda h, i: F.when(roll(F.coalesce(F.get(hashes, i - 1), F.lit(0)), h) % modulus == 0, i))
        inner = F.filter(rolled, lambda i: (i > 0) & (i < last - 1))
        none = F.array().cast("array<int>")
        # Two lines at least since the last end.
        apart = lambda found, i: F.when(i - F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(-1)) < 2, found).otherwise(F.concat(found, F.array(i)))
        return F.concat(F.aggregate(inner, none, apart), F.array(last))

    def cut(lines: Column) -> Column:
        def spans(at: Column) -> Column:
            def span(end: Column, k: Column) -> Column:
                return let(F.coalesce(F.get(at, k - 1) + 1, F.lit(0)), lambda s: F.struct(s.alias("start"), (end - s + 1).alias("lines")))

            found = F.filter(F.transform(at, span), lambda c: c["lines"] > 1)
            texts = F.transform(found, lambda c: F.struct(c.alias("at"), chunk_text(lines, c["start"], c["lines"]).alias("text")))
            whole = F.filter(texts, lambda c: c["text"].rlike(WORD))
            return F.transform(
                whole,
                lambda c: F.struct(
                    c["at"]["start"].alias("start"), c["at"]["lines"].alias("lines"), F.unhex(F.md5(c["text"].cast("binary"))).alias("hash")
                ),
            )

        return let(let(F.transform(lines, line_hash), ends), spans)

    return let(F.split(text, "\n"), cut)


def chunk_text(lines: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, count), "\n")


def _without(text: Column, marks: Column) -> Column:
    """The text without the lines of ``marks`` (sorted, apart): what lies between them is joined again."""

    def rest(lines: Column) -> Column:
        after = lambda k: F.coalesce(F.get(marks, k)["start"] + F.get(marks, k)["lines"], F.lit(0))
        before = F.transform(marks, lambda m, k: let(after(k - 1), lambda a: F.slice(lines, a + 1, m["start"] - a)))
        tail = let(after(F.size(marks) - 1), lambda a: F.slice(lines, a + 1, F.size(lines) - a))
        return F.array_join(F.flatten(F.concat(before, F.array(tail))), "\n")

    return let(F.split(text, "\n"), rest)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = MODULUS) -> DataFrame:
    """Rows ``doc`` (the row of ``docs`` as a struct), ``kept`` (its text without repeated chunks), ``n_lines``, ``removed_lines``, ``removed_chunks``."""
    body, name = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    key = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(name.cast("string"), F.lit("-")), F.coalesce(body, F.lit(""))).cast("binary")))
    rows = docs.select(key.alias("key"), F.struct("*").alias("doc"))
    inside = F.col("doc").getField(text)
    found = stored(
        docs.select(key.alias("key"), name.alias("id"), F.inline(chunks(body, modulus))).distinct(),
        "line-chunks",
    )
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key", "start")
    repeated = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where(F.col("n") > 1)
    is_first = (F.col("key") == F.col("first.key")) & (F.col("start") == F.col("first.start"))
    marks = found.join(repeated, "hash").select("key", "start", "lines", "hash", is_first.alias("first"))
    marked = stored(_marked(rows, marks), "line-marks")
    different = stored(_different(marked, inside), "line-differences")
    if not different.isEmpty():
        marked = _marked(rows, marks.join(different, "hash", "left_anti"))
    gone = F.sort_array(F.filter(F.coalesce("marks", F.array().cast("array<struct<start:int,lines:int,hash:binary,first:boolean>>")), lambda m: ~m["first"]))
    return marked.withColumn("gone", gone).select(
        "doc",
        F.when(F.size("gone") == 0, inside).otherwise(_without(inside, F.col("gone"))).alias("kept"),
        F.coalesce(F.size(F.split(inside, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.aggregate("gone", F.lit(0), lambda a, m: a + m["lines"]).cast("long").alias("removed_lines"),
        F.size("gone").cast("long").alias("removed_chunks"),
    )


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    by_doc = marks.groupBy("key").agg(F.collect_list(F.struct("start", "lines", "hash", "first")).alias("marks"))
    return rows.join(by_doc, "key", "left")


def _different(marked: DataFrame, text: Column) -> DataFrame:
    """Hashes that stand for more than one content."""
    pieces = marked.select(
        F.inline(
            let(F.split(text, "\n"), lambda ls: F.transform("marks", lambda m: F.struct(m["hash"].alias("hash"), chunk_text(ls, m["start"], m["lines"]).alias("chunk"))))
        )
    )
    return pieces.distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("hash")
