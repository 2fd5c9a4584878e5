"""Elias-Fano sequences and token files against plain versions."""

import zlib
from collections import Counter

import cases
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from logweir.llm import cell_table, elias_fano, token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=700), st.integers(0, 63))
@settings(max_examples=150, deadline=None)
def test_elias_fano_gives_back_every_value(values, shift):
    values = sorted(v >> shift for v in values)
    found = elias_fano.EliasFano(elias_fano.packed(np.array(values, np.uint64)))
    assert len(found) == len(values) and found.values().tolist() == values
    assert [found.select(i) for i in range(len(values))] == values
    a, b = len(values) // 3, 2 * len(values) // 3
    assert found.values(a, b).tolist() == values[a:b]


def test_elias_fano_is_near_minimal():
    r = np.random.default_rng(1)
    for n, top in ((1000, 10**6), (50_000, 10**9), (200_000, 1 << 21)):
        bits = 8 * len(elias_fano.packed(np.sort(r.integers(0, top, n).astype(np.uint64))))
        assert bits <= n * (3 + np.log2(top / n)) + 500


def plain(rows):
    encoder, found, start = Tokenizer.from_file(TOKENIZER), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 2]
        found.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


TRICKY = [
    "a  b\n\n c\t d  e",
    " lead",
    "trail \n",
    "it's we'll 'tis x<|endoftext|>y <|endoftext|> \n<|endoftext|>",
    "don’t, stop.\nNow! 12 ab12.. ́ .",
    "　wide　   line \x1c sep \x85 end",
    "ñ, é. Ǆ? ά; 日本。 x" * 40,
    "w" * 3000,
]


@pytest.mark.parametrize("file_ids,file_docs", [(1 << 24, 1 << 20), (500, 1 << 20), (1 << 24, 2)])
def test_files_give_back_every_document(spark, file_ids, file_docs):
    rows = [(i, t) for i, t in cases.odd_rows() if i != 11] + [(200 + i, t) for i, t in enumerate(TRICKY)]
    rows += [((1 << 60) + 1, "x y"), ((1 << 60) + 3, "x z"), (-(1 << 62), "below"), (-5, "zero")]
    rows = [r for r in rows if r[0] is not None] + [(None, "only one without an id")]
    got = token_files.token_round_trip(cases.with_clashes(spark, rows), TOKENIZER, file_ids=file_ids, file_docs=file_docs).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == plain(rows)


def test_rows_of_one_id_are_kept(spark):
    rows = [(7, f"copy {i % 3}") for i in range(60)] + [(None, "n"), (None, "n"), (8, "after")]
    got = sorted(map(tuple, token_files.token_round_trip(cases.with_clashes(spark, rows), TOKENIZER).collect()), key=lambda r: r[1])
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((r[0], r[2], r[3]) for r in plain(rows))
    assert [r[0] for r in got] == [None] * 2 + [7] * 60 + [8]


def test_any_document_by_select(spark, tmp_path):
    rows = [(3 * i - 20, cases.prose(i, 5 + i)) for i in range(300)] + [(None, "q")]
    folder = f"file://{tmp_path}"
    manifest = token_files.write_token_files(cases.with_clashes(spark, rows).coalesce(1), folder, TOKENIZER, 2, file_ids=9000).collect()
    encoder, texts, seen = Tokenizer.from_file(TOKENIZER), dict(rows), 0
    for f in manifest:
        with token_files.TokenFile(folder, f.file) as file:
            assert file.documents == f.documents and file.type.itemsize == 2
            for i in reversed(range(file.documents)):
                name, ids = file.document(i)
                assert ids.tolist() == [*encoder.encode(texts[name], add_special_tokens=False).ids, 2]
                seen += 1
    assert seen == len(rows) and len(manifest) > 3
    whole = (tmp_path / manifest[0].file).read_bytes()
    (tmp_path / "cut.ids").write_bytes(whole[:-3])
    with pytest.raises(ValueError):
        token_files.TokenFile(folder, "cut.ids")


def test_no_documents_no_files(spark):
    assert token_files.token_round_trip(cases.empty(spark), TOKENIZER).count() == 0


@pytest.mark.parametrize("name,end", [("byte_bpe_50k.json", 2), ("word_bpe_49k.json", 0)])
def test_cells_give_the_tokenizers_ids(name, end):
    encode = cell_table.CellEncoder(public_tokenizers.path(name), end)
    texts = [*TRICKY, "", "..", " .", "\n.", "a.\n,b", "İ. x ŉ? ẞ! ǰ. ΐ; ÿ, ×. ÷, ñ.. 's. 'll, I'm", "", "x " * 300_000, "日" * 300 + " " + "w" * 700 + ", x"]
    for c in map(chr, [*range(1, 0x180), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0x180E, 0xFEFF, 0x301, 0x1F600]):
        texts += [f"ab {c}cd", f"ab{c} cd", f"ab\n{c}c d", f"a{c}\nb", f"{c}a b{c}. {c}", f"{c}, x"]
    encode.held = 2000  # a generation a run
    for _ in range(2):
        at = iter(texts)
        for ids, ends in encode.encode(texts):
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                assert ids[a:b].tolist() == [*encode.tokenizer.encode(next(at), add_special_tokens=False).ids, end]
        assert next(at, None) is None
