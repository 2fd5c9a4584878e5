"""Ids beyond 2^53 stay exact beside null ids in every operator that goes through Python."""

import cases
import public_tokenizers
from tokenizers import Tokenizer

from logweir.llm import decontamination, maxent_lm, near_duplicates, packing, warc

A, B, NONE = cases.LARGE
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, texts):
    return cases.with_clashes(spark, list(zip(cases.LARGE, texts, strict=True))).coalesce(1)


def test_revisits_name_the_page(spark):
    pages = spark.createDataFrame([(A, "u", "x" * 1500), (B, "u", "x" * 1500), (NONE, "u", "y"), (A + 1, "u", "z")], "page_id long, url string, html string")
    got = warc.read_archives(*warc.archive_pages(pages.coalesce(1))).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(A, "revisit", B), (B, "response", None), (NONE, "response", None), (A + 1, "response", None)}


def test_near_copies_are_linked(spark):
    base = cases.prose(2, 300, 12)
    rows = docs(spark, [base, base.replace(base.split()[40], "changed", 1), cases.prose(9, 80)])
    got = near_duplicates.near_duplicates(rows, size=4).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(A, A), (B, A), (NONE, NONE)}
    assert {r.doc_id for r in near_duplicates.without_near_duplicates(rows).collect()} == {A, NONE}


def test_items_and_documents_keep_their_ids(spark):
    item = cases.prose(50, 20)
    items = spark.createDataFrame([(A, item), (B, cases.prose(51, 20)), (NONE, cases.prose(52, 20))], "item_id long, text string").coalesce(1)
    rows = docs(spark, ["q " + item, cases.prose(60, 40), "r " + item])
    got = decontamination.contained_items(rows, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(A, A), (NONE, A)}
    assert {r.doc_id for r in decontamination.without_items(rows, items).collect()} == {B}


def test_scores_and_pieces_keep_their_ids(spark):
    texts = [cases.prose(1, 30), cases.prose(2, 40), cases.prose(3, 50)]
    rows = docs(spark, texts)
    want = {(i, len(t.split()) + 1) for i, t in zip(cases.LARGE, texts, strict=True)}
    assert {(r.doc_id, r.n_tokens) for r in maxent_lm.score_documents(rows).collect()} == want
    encoder = Tokenizer.from_file(TOKENIZER)
    want = {(i, len(encoder.encode(t, add_special_tokens=False).ids) + 1) for i, t in zip(cases.LARGE, texts, strict=True)}
    assert {(r.doc_id, r.length) for r in packing.token_pieces(rows, TOKENIZER).collect()} == want
