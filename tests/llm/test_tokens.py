"""Token files and packing, against the tokenizers library and plain Python."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendloom.llm.common import scratch
from spendloom.llm.packing import best_fit, pack_documents, pack_items
from spendloom.llm.token_frames import EMPTY_FRAME, CorruptFrame, TokenFile, file_parts, read_token_frames, token_index, write_token_frames
from spendloom.llm.tokenizing import BYTE_BPE, WORD_BPE, piece_ids

ODD = ["", " ", "  a", "a  b\n\nc", "\x1cc \x85d", "ΑΣ ΣΑΣ", "é ́x", "<|endoftext|> x", "İstanbul ﬁ", "don't  'll x's, It's.", "a\t b\r\n c "]
SCHEMA = "doc_id long, text string, n_tokens string, start int"


def whole(vocabulary: str, text: str) -> list[int]:
    return piece_ids(vocabulary).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("vocabulary", [WORD_BPE, BYTE_BPE])
@given(st.one_of(st.sampled_from(ODD), st.text(alphabet=" \n\t.,'aAbéßü1!- ́", max_size=40), st.text(max_size=30)))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_the_whole_text(vocabulary, text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(piece_ids(vocabulary).encode([text])[0], "<u4").tolist() == whole(vocabulary, text)


def documents(spark):
    rows = [(5, "b b", "x", 1), (1, None, "x", 1), (3, "", None, 2), (2, "word " * 9000, "y", 1), (None, "null id", "", 1)]
    rows += [(5, "b b", "x", 1), (5, "another", "x", 1), (-4, "minus", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_files_hold_all_documents_in_order(spark):
    path = scratch(spark, "frames")
    docs = documents(spark)
    write_token_frames(docs, path)
    found = token_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, -4, 1, 2, 3, 5, 5, 5]
    start = 0
    texts: dict = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(whole(WORD_BPE, r.text or "") + [2])
    for r in found:
        assert r.start == start
        start += r.n_tokens
        matching = [i for i in texts[r.doc_id] if len(i) == r.n_tokens and zlib.crc32(np.array(i, "<u4").tobytes()) == r.ids_crc32]
        assert matching
        texts[r.doc_id].remove(matching[0])
    some = read_token_frames(spark, path, doc_ids=[2, 3]).collect()
    assert sorted((r.doc_id, len(r.ids) // 4) for r in some) == [(2, 9001), (3, 1)]


def test_empty_table_gives_no_documents(spark):
    path = scratch(spark, "frames")
    write_token_frames(spark.createDataFrame([], SCHEMA), path)
    assert token_index(spark, path).count() == 0
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_file_is_a_zstandard_stream_and_damage_is_found():
    documents = [(1, struct.pack("<3I", 1, 2, 3)), (None, struct.pack("<I", 2)), (7, b"\1\0\0\0" * 1000)]
    content = b"".join(part + EMPTY_FRAME for part in file_parts(documents))
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
    assert stream == b"".join(ids for _, ids in documents)
    f = TokenFile(content)
    assert f.numbers == [1, None, 7] and [f.ids(i) for i in range(3)] == [ids for _, ids in documents]
    broken = bytearray(content)
    broken[int(f.ends[0]) - 1] ^= 1  # the first frame's checksum
    assert TokenFile(bytes(broken)).ids(2) == documents[2][1]
    with pytest.raises(CorruptFrame):
        TokenFile(bytes(broken)).ids(0)
    with pytest.raises(CorruptFrame):
        TokenFile(content[:-3])


@given(st.lists(st.integers(1, 50), max_size=80))
@settings(deadline=None)
def test_best_fit_takes_the_tightest_bin(lengths):
    bins, offsets, fills = best_fit(np.array(lengths, int), 50)
    open_bins: list[int] = []
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        room = [50 - f for f in open_bins]
        fitting = [r for r in room if r >= n]
        if fitting:
            assert room[b] == min(fitting) and o == open_bins[b]
        else:
            assert b == len(open_bins) and o == 0
            open_bins.append(0)
        open_bins[b] += n
    assert open_bins == fills


def check_sequences(rows, limit):
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limit
    return by_sequence


@pytest.mark.parametrize("group_items", [7, 60, 100_000])
def test_levels_leave_no_gap_and_few_sequences(spark, group_items):
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 100, 400)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = pack_items(items, 100, group_items, 1).join(items, "item").collect()
    assert len(rows) == 400
    found = check_sequences(rows, 100)
    assert len(found) <= (1.1 if group_items > 7 else 1.4) * sum(lengths) / 100 + 2


def test_documents_are_cut_and_packed(spark):
    docs = documents(spark)
    rows = pack_documents(docs, group_items=3).collect()
    check_sequences(rows, 2048)
    long = sorted((r for r in rows if r.doc_id == 2), key=lambda r: r.piece)
    ids = whole(BYTE_BPE, "word " * 9000) + [0]
    assert [r.length for r in long] == [len(ids) % 2048 or 2048] + [2048] * ((len(ids) - 1) // 2048)
    for r in long:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert sorted(str(r.doc_id) for r in rows if r.piece == 0) == sorted(str(r.doc_id) for r in docs.collect())


def test_vocabulary_path_is_a_parameter(spark):
    path = public_tokenizers.path(BYTE_BPE)
    one = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    from spendloom.llm.packing import token_pieces

    assert token_pieces(one, vocabulary_path=path).select(F.sum("length")).collect()[0][0] == len(whole(BYTE_BPE, "hello there")) + 1


@pytest.mark.parametrize("vocabulary", [WORD_BPE, BYTE_BPE])
def test_added_tokens_in_texts_have_one_id(vocabulary):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    texts = ["end <|endoftext|> x", "a<|endoftext|>b  <|startoftext|>\n", "<|endoftext|>", "<|ENDOFTEXT|> c", "<|endof text|> don't", *ODD]
    found = [np.frombuffer(ids, "<u4").tolist() for ids in piece_ids(vocabulary).encode(texts)]
    assert found == [fresh.encode(text, add_special_tokens=False).ids for text in texts]
    assert len(found[2]) == 1
