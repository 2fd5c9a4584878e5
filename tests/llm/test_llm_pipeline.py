"""The whole pipeline against plain versions of its stages, over the smallest tables."""

import re
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import cases
import duckdb
import numpy as np
import public_tokenizers
from test_llm_duplicates import plain_chunks, shingles
from test_llm_filters import plain_measures
from tokenizers import Tokenizer

import corpus_pipeline
from logweir.llm import near_duplicates

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\r\x0b\x0c"


def accepted(text):
    words, chars, symbols, repeated_lines, repeated = plain_measures(text)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    capitals = sum(unicodedata.category(c) == "Lu" for c in text)
    return not (
        words < 50
        or 100 * repeated > 50 * words
        or 10 * symbols > 3 * words
        or (len(lines) >= 4 and 2 * repeated_lines > len(lines))
        or 10 * len(re.findall("[!?]", text)) > 5 * words
        or 10 * capitals > 6 * chars
        or not 2 * words <= chars <= 25 * words
    )


def without_copies(docs):
    """Of equal texts the one with the smallest id."""
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    return {i: t for i, t in docs.items() if first[t] == i}


def without_repeated_chunks(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        kept = []
        for _, lines in plain_chunks(docs[i]):
            body = "\n".join(lines)
            if len(lines) > 1 and body.strip(BLANK):
                if body in seen:
                    continue
                seen.add(body)
            kept += lines
        if "\n".join(kept).strip(BLANK):
            out[i] = "\n".join(kept)
    return out


def first_of_near_copies(docs):
    sets = {i: shingles(t, 5) for i, t in docs.items()}
    label = {i: i for i in docs}
    for a in docs:
        for b in docs:
            if a < b and label[a] != label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return {i: t for i, t in docs.items() if label[i] == i}


def test_pipeline_is_its_plain_stages(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    items = [s for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall() if (s := shingles(t, 5))]
    docs = first_of_near_copies(without_repeated_chunks(without_copies({i: t for i, t in docs.items() if accepted(t or "")})))
    docs = {i: t for i, t in docs.items() if not any(100 * len(s & shingles(t, 5)) >= 80 * len(s) for s in items)}
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in docs.items():
        ids = np.asarray([*encoder.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k, at, min(2048, len(ids) - at), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048


def test_exact_copies_leave_no_remnants(spark):
    texts = ["\n".join(f"line {k} of text {i} " + "word " * 12 + f"end {k}" for k in range(12)) for i in range(8)]
    rows = [(10 * c + i, t, len(t)) for c in range(3) for i, t in enumerate(texts)] + [(None, texts[0], 1), (0, texts[0], len(texts[0]))]
    rows += [(90, "", 0), (91, "", 0), (92, None, None), (93, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(5)
    left = corpus_pipeline.line_dedup(spark, docs, SF)
    assert left.columns == docs.columns
    want = Counter({(i, t): 1 for i, t in enumerate(texts)} | {(0, texts[0]): 2, (90, ""): 1, (91, ""): 1, (92, None): 1, (93, None): 1})
    assert Counter((r.doc_id, r.text) for r in left.collect()) == want
    assert Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, left, SF).where("text <> ''").collect()) == Counter(range(8))


def test_near_dedup_needs_few_rounds_for_a_large_group(spark, monkeypatch):
    """Copies of one text, half of them too far off to be linked: the stage keeps one of each group, and is done in a few rounds."""
    r = np.random.default_rng(4)
    rows, base = [], cases.prose(81, 200).split()
    for i in range(200):
        words = list(base)
        for at in r.choice(len(words), int(r.integers(0, 10)), replace=False):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows]
    label = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    rounds, write = [], near_duplicates.stored
    monkeypatch.setattr(near_duplicates, "stored", lambda df, name: rounds.append(name) or write(df, name))
    monkeypatch.setattr(near_duplicates, "ROUND_PAIRS", 1)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(label))
    assert 1 <= rounds.count("near-pivots") <= 3
