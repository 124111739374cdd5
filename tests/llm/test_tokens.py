import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from courtside.llm.packing import hilbert_index, pack
from courtside.llm.simple8b import decode_blocks, encode_blocks
from courtside.llm.token_files import read_token_files, write_token_files
from courtside.llm.tokens import ID, FieldEncoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  ", "a  b", " a", "a ", "it's x's 'tis don't", "a\n b", "a \n b", "end.\nStart\n\nnext\n", "é É ñ ÀÉ",
       "<|endoftext|> a b", "1,2. 3.", "12.5, ab12.   x", "\t a", "x y z w", "Σας ΣΑΣ", "é ́x", "###*** a###",
       "日本語 テキスト。", "a.\nb.\nc", "x" * 3000 + " y", "  a \x1c b", "word,\nword, word"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_fields_give_the_ids_of_the_library(path):
    library, encoder = Tokenizer.from_file(path), FieldEncoder(path)
    for _ in range(2):  # the second time from the cache
        ids = encoder.encode(ODD + [None])
        for text, own in zip(ODD + [""], ids):
            assert np.frombuffer(own, ID).tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Zé'.,\n\t1#- ́", max_size=30), max_size=5))
def test_any_text_gives_the_ids_of_the_library(texts):
    for path in (BYTE, WORD):
        library, encoder = _pair(path)
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(i, ID).tolist() for i in encoder.encode(texts)] == expected


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_a_line_break_learnt_inside_a_field_is_no_field(path):
    library, encoder = Tokenizer.from_file(path), FieldEncoder(path)
    for texts in (["a x\nbar c"], ["foo \nbar", "foo \nbar c x\nbar", "\nbar", " \nbar"], ["bar \nx", "y\nbar x\nbar bar"]):
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(i, ID).tolist() for i in encoder.encode(texts)] == expected


_PAIRS = {}


def _pair(path):
    if path not in _PAIRS:
        _PAIRS[path] = (Tokenizer.from_file(path), FieldEncoder(path))
    return _PAIRS[path]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2 ** 64 - 1)), max_size=150), max_size=5))
def test_blocks_come_back(blocks):
    values = np.array([v for b in blocks for v in b], np.uint64)
    coded = encode_blocks(values, np.cumsum([len(b) for b in blocks]).astype(int))
    back, lengths = decode_blocks(coded)
    assert back.tolist() == values.tolist() and lengths.tolist() == [len(b) for b in blocks]


ROWS = [(5, "one two three"), (1, None), (3, ""), (3, "b"), (3, "b"), (None, "no id"), (2, "long " * 20000), (9, "x\ny")]


@pytest.mark.parametrize("vocabulary", [BYTE, WORD])
def test_every_letter_and_mark_of_unicode(vocabulary):
    """Lower-casing or composing may turn a letter into a letter and a mark, which the vocabulary's splitter parts."""
    library, own = Tokenizer.from_file(vocabulary), FieldEncoder(vocabulary)
    signs = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LM" and not 0xAC50 < c < 0xD7A0 and not 0x4F00 < c < 0x9F00]
    texts = [f"x {c} y {c}a b{c}c. z\n{c} {c}" for c in signs] + ["x İstanbul y İSTANBUL. x", "x क़ y", "x שׁ y"]
    for start in range(0, len(texts), 5000):
        part = texts[start:start + 5000]
        wanted = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(i, ID).tolist() for i in own.encode(part)] == wanted


def test_files_hold_all_ids_in_order(spark, tmp_path):
    library = Tokenizer.from_file(BYTE)
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, words string").repartition(3)
    write_token_files(docs, str(tmp_path / "ids"), BYTE, block_ids=64)
    got = sorted(read_token_files(spark, str(tmp_path / "ids")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 3, 5, 9]
    place = 0
    texts = sorted((library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in ROWS))
    assert sorted(np.frombuffer(r["ids"], ID).tolist() for r in got) == texts
    for r in got:
        assert r["start"] == place and r["n_tokens"] == len(r["ids"]) // 4
        place += r["n_tokens"]
    write_token_files(docs.limit(0), str(tmp_path / "none"), BYTE)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_hilbert_neighbours_differ_in_one_step():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        place = hilbert_index(grid, bits).astype(int)
        assert sorted(place) == list(range(len(grid)))
        walk = grid[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_packing_places_every_id_once(spark):
    library = Tokenizer.from_file(WORD)
    rows = ROWS + [(100 + i, f"same text here {i % 3}") for i in range(300)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(4)
    pieces = pack(docs, WORD, length=64).collect()
    line = {}
    for p in pieces:
        assert p["offset"] + p["length"] <= 64 and len(p["ids"]) == 4 * p["length"]
        line[p["sequence_id"], p["offset"]] = p["length"]
    at = 0
    for (sequence, offset), length in sorted(line.items()):
        assert sequence * 64 + offset == at
        at += length
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert at == want == sum(p["length"] for p in pieces)
    whole = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        if p["doc_id"] in (2, 5, 9):
            whole[p["doc_id"]] = whole.get(p["doc_id"], b"") + p["ids"]
    for doc, text in ((2, ROWS[6][1]), (5, "one two three"), (9, "x\ny")):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [2], ID)
        assert zlib.crc32(whole[doc]) == zlib.crc32(ids.tobytes())
    assert pack(docs.limit(0), WORD).count() == 0
