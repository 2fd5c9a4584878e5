"""Shards, archives and packed sequences against plain versions of the same rules."""

import hashlib
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from logweir.llm import packing, sharding, warc


def least_capacity(sizes, shards):
    def fits(capacity):
        used, held = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if held + s > capacity:
                used, held = used + 1, 0
            held += s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards_have_the_least_capacity(spark, shards, monkeypatch):
    monkeypatch.setattr(sharding, "ATOMS", 16)  # ranges of several groups, so that cuts need finer sums
    rows = cases.odd_rows() + [(100 + i, cases.prose(i, 5 + i % 37)) for i in range(150)]
    got = sharding.minimax_shards(cases.with_clashes(spark, rows), shards=shards).toPandas()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    groups = defaultdict(int)
    for _, t in rows:
        groups[int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)] += size(t)
    left, alone, total = sum(groups.values()), 0, sum(groups.values())
    for o, s in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if s * shards > total and alone + 1 < shards and s * (shards - alone) > left:
            left, alone = left - s, alone + 1
            del groups[o]
    rest = got[got.shard >= alone].groupby("shard")["size"].sum()
    assert rest.max() == least_capacity([groups[o] for o in sorted(groups)], shards - alone)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert (got.groupby("text_crc32").shard.nunique() == 1).all()
    assert Counter(zip(got["size"], got.text_crc32)) == Counter((size(t), zlib.crc32((t or "").encode())) for _, t in rows)


def test_no_rows_no_shards(spark):
    assert sharding.minimax_shards(cases.empty(spark)).count() == 0


PAGES = [
    (1, "http://a.b/c", "x" * 1500),
    (2, None, "x" * 1500),
    (2, "http://a.b/\r\nd", "x" * 1500),
    (3, "u", "x" * 999),
    (4, "u", "x" * 999),
    (5, "u", None),
    (6, "u", ""),
    (None, "u", "y" * 2000),
    (7, "u", "y" * 2000),
    (8, "u", "é\r\n\r\nñ" * 400),
    (9, "u", "z" * 3_000_000),
]


@pytest.mark.parametrize("archive_bytes", [1000, 1 << 25])
def test_archives_give_back_every_payload(spark, archive_bytes, monkeypatch):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, n int").repartition(2)
    monkeypatch.setattr(warc.write_archives, "__defaults__", ("2024-01-01T00:00:00Z", archive_bytes))
    manifest, folder = warc.archive_pages(pages)
    got = warc.read_archives(manifest, folder).collect()
    whole = {p: (h or "").encode() for p, _, h in PAGES}
    largest = {1: 2, None: 7}
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(
        (
            p,
            len(whole[p]),
            hashlib.sha1(whole[p]).hexdigest(),
            "revisit" if p in largest else "response",
            largest.get(p),
        )
        for p, _, _ in PAGES
    )
    assert all(bytes(r.payload) == whole[r.page_id] for r in got if r.record_type == "response")
    assert warc.read_archives(manifest, folder, payloads=False).columns[-1] == "refers_to"


def test_archives_lead_with_their_dictionary(tmp_path):
    records = [warc.warc_record(i, "http://a", f"<html><p>{cases.prose(i, 80)}</p></html>".encode(), b"\0" * 20, None, "d") for i in range(200)]
    name = warc._write_archive(f"file://{tmp_path}", records)
    data = (tmp_path / name).read_bytes()
    assert data[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little")
    size = int.from_bytes(data[4:8], "little")
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj().decompress(data[8 + size :])
    assert one == records[0]
    with open(tmp_path / name, "rb") as f:
        assert list(warc._frames(f)) == records


def test_no_pages_no_archives(spark):
    manifest, folder = warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest.count() == 0 and warc.read_archives(manifest, folder).count() == 0


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, most):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(most - n)
    return len(gaps)


def test_plans_place_every_rank_and_need_no_more_sequences():
    r = np.random.default_rng(5)
    for most in (10, 64, 257):
        for _ in range(40):
            runs = {int(r.integers(1, most + 1)): int(r.integers(1, 30)) for _ in range(int(r.integers(1, 40)))}
            held, ranks = defaultdict(list), Counter()
            for length, a, b, first, each, base in packing.best_fit_plan(runs, most):
                for k in range(b - a):
                    held[first + k // each].append((base + length * (k % each), length))
                    ranks[length, a + k] += 1
            assert ranks == Counter({(n, k): 1 for n, c in runs.items() for k in range(c)})
            for pieces in held.values():
                at = 0
                for offset, n in sorted(pieces):
                    assert offset == at
                    at += n
                assert at <= most
            assert len(held) <= plain_best_fit([n for n, c in runs.items() for _ in range(c)], most)


def test_packed_pieces_are_the_tokenizers_ids(spark):
    rows = cases.odd_rows() + [(90, "it's <|endoftext|> don't,x \x1c y\x85z é. Ünï? ΑΣ."), (91, "a" * 5000), (92, "İ. x İİ, y ŉ? ẞ! ǰ. ΐ; İ")]
    got = packing.pack(packing.token_pieces(cases.with_clashes(spark, rows), TOKENIZER, 64, 0), 64).toPandas()
    encoder = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in rows:
        ids = np.asarray([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    ids = [None if i != i else i for i in got.doc_id.astype("float")]
    assert Counter(zip(ids, got.piece, got.start, got.length, got.ids_crc32)) == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 64
    assert packing.pack(packing.token_pieces(cases.empty(spark), TOKENIZER), 2048).count() == 0
