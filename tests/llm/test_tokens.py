import random
import zlib
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import huffman, packing, token_counts
from panelwright.llm.common import new_folder
from panelwright.llm.tokens import Encoder, Numbers
from .docs import odd_rows, prose, table


@pytest.fixture(scope="module")
def library():
    return Encoder().lib


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_library(library):
    parts = ["'", "''", " ", "  ", "\n", "\t", "s", "t", "re", "ve", "ll", "d", "m", "ab", "B", "é", "ß", "1", "23", "!", "?", "..", "'s", "'re", "\xa0", "\x85", "x'll", "\r\n", "-", "²", "\x1c", "中", "<|endoftext|>", " ", "😀"]
    r = random.Random(3)
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(3000)] + [" ".join(prose(5, 4000)), "   ", "'s", " 's"]
    expected = library.encode_batch(texts, add_special_tokens=False)
    plain, spans = Encoder().encode(texts), Encoder(offsets=True).encode(texts)
    for e, p, s in zip(expected, plain, spans):
        assert p.tolist() == e.ids == s[:, 0].tolist()
        assert [tuple(x) for x in s[:, 1:].tolist()] == e.offsets


def test_numbers_survive_growth_and_collisions():
    n = Numbers(4)
    keys = (np.arange(5000, dtype=np.uint64) << np.uint64(20)) | np.uint64(7)  # one slot for all
    for a in range(0, 5000, 500):
        n.add(keys[a : a + 500])
    assert n.find(keys).tolist() == list(range(5000))
    assert (n.find(keys + np.uint64(1)) == -1).all()


@pytest.mark.parametrize("limit", [4, 9, 18])
def test_code_is_complete_and_limited(limit):
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89], np.int64)
    lengths = huffman.code_lengths(counts, limit)
    used = counts > 0
    assert lengths[0] == 0 and lengths.max() <= limit
    assert sum(2.0 ** -lengths[used].astype(float)) == 1
    best = {4: None, 9: None, 18: None}
    if limit == 18:  # no limit in effect: equals Huffman's own cost
        import heapq

        heap, cost = counts[used].tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        best[18] = cost
        assert int((counts * lengths).sum()) == cost


def test_blocks_decode_alone_and_together():
    r = np.random.default_rng(0)
    ids = [r.zipf(1.3, n).clip(0, 999).astype(np.uint16) for n in (1, 127, 128, 129, 5000)]
    code = huffman.Code(huffman.code_lengths(np.bincount(np.concatenate(ids), minlength=1000), 12))
    blocks = [huffman.write_block(code, [7, None], [x, x[:3]]) for x in ids]
    for some in ([blocks[3]], blocks):
        for (names, sizes, flat), x in zip(huffman.read_blocks(code, some), [ids[3]] if len(some) == 1 else ids):
            assert names == [7, None] and flat.tolist() == [*x, *x[:3]] and sizes.tolist() == [len(x), len(x[:3])]


def test_single_symbol_code():
    code = huffman.Code(huffman.code_lengths(np.array([0, 5]), 18))
    (_, _, flat), = huffman.read_blocks(code, [huffman.write_block(code, [1], [np.ones(300, np.int64)])])
    assert flat.tolist() == [1] * 300


def test_file_round_trip(spark, library):
    rows = odd_rows()
    folder = new_folder(spark, "test")
    huffman.write_ids(table(spark, rows), folder, block=500)
    got = huffman.read_ids(spark, folder).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, tuple(ids_of(library, t))) for d, t in rows)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got[:-1]]).tolist()
    names = [r.doc_id for r in got]
    assert names == sorted(names, key=lambda d: (d is not None, d or 0))
    assert [(r.n_tokens, r.ids_crc32) for r in huffman.digests(spark, folder).orderBy("start").collect()] == [
        (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got
    ]


def test_empty_tables(spark):
    empty = table(spark, [])
    folder = new_folder(spark, "test")
    huffman.write_ids(empty, folder)
    assert huffman.digests(spark, folder).count() == 0
    assert packing.pack(empty).count() == 0
    assert token_counts.count_lines(empty).count() == 0


def test_cuts():
    assert packing.cuts(5, 5) == [(0, 5)] and packing.cuts(12, 5) == [(0, 2), (2, 5), (7, 5)] and packing.cuts(3, 5) == [(0, 3)]


def test_open_bins_take_the_best_fit_and_close_the_fullest():
    b = packing.OpenBins(10, 2)
    assert b.put(6) == (0, 0) and b.put(5) == (1, 0)
    assert b.put(4) == (0, 6)  # exactly fills the first
    assert b.put(6) == (2, 0)  # fits nowhere; two are open now
    assert b.put(7) == (3, 0)  # closes the fullest, bin 2
    assert b.put(4) == (1, 5) and b.put(3) == (3, 7)


def test_packing_is_gapless_and_whole(spark, library):
    rows = odd_rows() + [(100 + i, " ".join(prose(i, 40 + 7 * i))) for i in range(60)]
    got = packing.pack(table(spark, rows), length=256, open_bins=8, range_pieces=50).collect()
    pieces, wanted = Counter(), Counter()
    for r in got:
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    for d, t in rows:
        ids = np.array(ids_of(library, t), "<u4")
        for k, (a, n) in enumerate(packing.cuts(len(ids), 256)):
            wanted[d, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    assert pieces == wanted
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 256
    assert len(bins) <= 1.15 * sum(bins.values()) / 256 + 2


def brute_lines(library, text, rule):
    text = text or ""
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    edges = np.cumsum([0, *map(len, lines)]).tolist()
    counts = [0] * len(lines)
    for a, b in library.encode(text, add_special_tokens=False).offsets:
        part = [max(0, min(b, edges[i + 1]) - max(a, edges[i])) for i in range(len(lines))]
        touched = [i for i, p in enumerate(part) if p]
        counts[touched[0] if rule == "first" else touched[-1] if rule == "last" else part.index(max(part))] += 1
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_line_counts_by_rule(spark, library, rule):
    rows = [(i, t) for i, (_, t) in enumerate(odd_rows() + [(0, "a\n\n\n  b\n \n c"), (0, "x\n"), (0, "\n\n"), (0, "end\n\n\n\n  \n\n\nnext !!\n!! more")])]
    got = {}
    for r in token_counts.count_lines(table(spark, rows), rule).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        assert [r.n_tokens for r in got[d]] == brute_lines(library, t, rule)
        assert abs(sum(r.n_shared for r in got[d]) - sum(r.n_tokens for r in got[d])) < 1e-6
        assert got[d][-1].end == len(t or "")


def test_field_counts(spark, library):
    df = spark.createDataFrame([(1, "a title", "body text\nwith lines"), (2, None, "only body"), (3, None, None)], "id long, title string, body string")
    got = token_counts.count_fields(df, "id", ["title", "body"]).groupBy("doc_id").sum("n_tokens").collect()
    whole = {1: "a title\nbody text\nwith lines", 2: "\nonly body", 3: "\n"}
    assert {r[0]: r[1] for r in got} == {k: len(ids_of(library, t)) - 1 for k, t in whole.items()}
