"""Packing, token-id files and n-best pieces against the tokenizers and by enumeration."""

import random
from array import array
from collections import Counter, defaultdict

import pytest

from tidemark.llm import bitplanes
from tidemark.llm.bitplanes import pack_block, read_tokens, unpack_block, write_tokens
from tidemark.llm.encoding import PieceEncoder
from tidemark.llm.nbest import SPACE, PieceLattice, decode_ids, encode_nbest
from tidemark.llm.packing import pack_powers_of_two, piece_lengths
from tidemark.llm.queries import vocabulary

ODD = [
    "", " ", "  a", "a  b", "a \n b", " \x1f x", "  x", "a　 b", "it's  we'll\n\n x ", "a <|endoftext|> b", "tab\t x", "end ", "é ́x",
    "\n", "x \n", "Σ ΑΣ ß ﬁ", "a   b", " \u0085 x", "'s 's  's", "x" * 3000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_pieces_change_nothing(name, rows):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(vocabulary(name)), PieceEncoder(vocabulary(name))
    for text in ODD + [r[1] or "" for r in rows] + ODD:
        assert array("I", own.encode(text)).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:50])


def ids_of(name, rows, end):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary(name))
    return [(r[0], array("I", [*plain.encode(r[1] or "", add_special_tokens=False).ids, end]).tobytes()) for r in rows]


def test_piece_lengths():
    for n in range(1, 200):
        lengths = piece_lengths(n, 16)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 16 for x in lengths)
        assert sorted(lengths, reverse=True) == lengths and max(Counter(x for x in lengths if x < 16).values(), default=1) == 1


def test_packing(docs, rows):
    out = pack_powers_of_two(docs, vocabulary("byte_bpe_50k.json"), window=64).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert [r.length for r in sorted(out, key=lambda r: r.sequence_id)] == sorted(r.length for r in out)
    pieces = defaultdict(list)
    for r in out:
        assert len(r.ids) == 4 * r.length and r.offset == 0
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    want = Counter()
    for i, ids in ids_of("byte_bpe_50k.json", rows, 0):
        at = 0
        for length in piece_lengths(len(ids) // 4, 64):
            want[i, len(ids) // 4, at, ids[4 * at : 4 * (at + length)]] += 1
            at += length
    assert Counter((*k, s, b) for k, v in pieces.items() for s, b in v) == want


@pytest.mark.parametrize("planes", ["bytes", "bits"])
def test_block_round_trip(planes):
    rng = random.Random(2)
    for n in (1, 7, 8, 9, 1000):
        ids = array("I", [rng.choice([0, 1, 50_000, 2**32 - 1, rng.randrange(2**20)]) for _ in range(n)]).tobytes()
        assert unpack_block(pack_block(ids, planes)) == ids
    with pytest.raises(ValueError):
        unpack_block(b"else" + bytes(20))


@pytest.mark.parametrize("planes", ["bytes", "bits"])
def test_token_files(spark, docs, rows, planes):
    path = write_tokens(docs, vocabulary("word_bpe_49k.json"), block=100, planes=planes)
    out = read_tokens(spark, path).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in out) == Counter(ids_of("word_bpe_49k.json", rows, 1))
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    index = spark.read.parquet(path).select("n_ids").collect()
    assert max(r.n_ids for r in index) == 100 and sum(r.n_ids for r in index) == at


def test_nbest_by_enumeration():
    best = 4
    lattice, rng = PieceLattice(vocabulary("piece_bpe_32k.model"), best), random.Random(1)
    texts = ["a", "the", "the cat.", " a  b", "é\nx", "   ", "日本語", "x "]
    texts += ["".join(rng.choice("ten a.,\né ") for _ in range(rng.randint(1, 11))) for _ in range(150)]
    for text in texts:
        whole = SPACE + text.replace(" ", SPACE)
        edges = lattice.edges(whole)
        paths = {0: [(0.0, ())]}
        for end in range(1, len(whole) + 1):
            paths[end] = [(s + score, ids + more) for start, score, more in edges[end] for s, ids in paths[start]]
        every = dict((ids, s) for s, ids in paths[len(whole)])
        got = [(s, tuple(array("I", ids))) for s, ids in lattice.encode(text)]
        assert [s for s, _ in got] == sorted(every.values(), reverse=True)[:best]
        assert len({ids for _, ids in got}) == len(got) and all(every[ids] == s for s, ids in got)
        assert all(lattice.decode(ids) == text for _, ids in lattice.encode(text))


def test_nbest_checks_each_rank(monkeypatch):
    """A wrong segmentation of any rank is reported for that rank only."""
    import pyarrow as pa

    from tidemark.llm import nbest

    path, text = vocabulary("piece_bpe_32k.model"), "the thing of the end"
    lattice = PieceLattice(path, 3)
    found = lattice.encode(text)
    wrong = [*found[:2], (found[2][0], found[2][1][:-4])]
    monkeypatch.setattr(lattice, "encode", lambda _: wrong)
    monkeypatch.setattr(nbest, "_lattice", lambda *_: lattice)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])
    out = pa.Table.from_batches(nbest._encode(path, 3)(iter([batch])))
    assert out["rank"].to_pylist() == [1, 2, 3] and out["round_trip"].to_pylist() == [True, True, False]


def test_nbest_round_trips_are_those_of_whole_decoding():
    lattice, rng = PieceLattice(vocabulary("piece_bpe_32k.model"), 4), random.Random(2)
    texts = ["", "a", "the▁thing", "▁", "é\nx end", *("".join(rng.choice("ten a.,\né ▁") for _ in range(40)) for _ in range(200))]
    for text in texts:
        found = [ids for _, ids in lattice.encode(text)]
        found += [found[-1][4:], found[0][:-4], found[0][:8] + found[0][12:], found[0] * 2, b"", *found]
        for given in (found, found[::-1]):
            assert lattice.round_trips(given, text) == [lattice.decode(ids) == text for ids in given], text


def test_nbest_rows(docs, rows):
    out = encode_nbest(docs, vocabulary("piece_bpe_32k.model"), best=3)
    back = decode_ids(out, vocabulary("piece_bpe_32k.model")).collect()
    firsts = Counter((r.doc_id, r.text) for r in back if r["rank"] == 1)
    assert firsts == Counter((r[0], r[1] or "") for r in rows)
    assert all(r.round_trip for r in back) and all(len(r.ids) == 4 * r.n_pieces for r in back)
    assert [(r.n_pieces, r.score) for r in back if r.doc_id == 91] == [(0, 0.0)]


def test_empty(spark, empty):
    assert pack_powers_of_two(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    assert read_tokens(spark, write_tokens(empty, vocabulary("word_bpe_49k.json"))).count() == 0
    assert encode_nbest(empty, vocabulary("piece_bpe_32k.model")).count() == 0
    assert bitplanes.BLOCK > 0
