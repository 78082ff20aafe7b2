"""Token files and packing against the tokenizers library and a plain walk over the rows."""

import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldtrace.llm.packing import best_fit, cut, pack_documents
from fieldtrace.llm.token_files import read_token_files, write_token_files
from fieldtrace.llm.tokens import Encoder

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = ["Ab cd's I'LL", None, "", "  x\n\n y \t", "½²ª ſ's İI", "<|endoftext|>", "日本 語", "é́ x", "a" * 5000,
         "word " * 4000, "Same text", "Same text", " ", "…''s", "\x1c a"]
SCHEMA = "doc_id long, text string, ids string, start string, bin string"


kept_encoder = cache(Encoder)


@cache
def reference(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def table(spark, keys):
    return spark.createDataFrame([(k, t, "extra", "extra", "extra") for k, t in zip(keys, TEXTS)], SCHEMA).repartition(4)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBsS'LlTt \n\t.-½9éİ́ßſ\x1c"), max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(text):
    for path in (WORD, BYTE):
        assert kept_encoder(path)(text) == np.array(reference(path)(text), "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|ENDoftext|>", "<|", "endoftext", "|>", " ", "a", "Bé", "\n", "1", "½"]), max_size=12))
def test_added_tokens_in_texts(parts):
    text = "".join(parts)
    for path in (WORD, BYTE):
        assert kept_encoder(path)(text) == np.array(reference(path)(text), "<u4").tobytes()
    assert 49407 in reference(WORD)("a <|endoftext|> b") and 50256 in reference(BYTE)("a <|endoftext|> b")


def test_files_round_trip(spark):
    keys = [*range(len(TEXTS) - 3), None, 5, 5]
    manifest = write_token_files(table(spark, keys), WORD, 1)
    got = read_token_files(manifest).collect()
    ids = reference(WORD)
    rows = sorted(zip(keys, TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for k, t in rows:
        one = ids(t) + [1]
        want.append((k, start, len(one), zlib.crc32(np.array(one, "<u4").tobytes()), one))
        start += len(one)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids))) for r in got)


def test_only_wanted_documents_are_read(spark):
    manifest = write_token_files(table(spark, range(len(TEXTS))), WORD, 1)
    got = read_token_files(manifest, wanted=[3, 9, 99]).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == [(k, reference(WORD)(TEXTS[k]) + [1]) for k in (3, 9)]
    assert read_token_files(manifest, wanted=[]).count() == 0


def test_a_changed_byte_is_found(spark, tmp_path):
    from fieldtrace.llm.token_files import read_frames
    manifest = write_token_files(table(spark, range(len(TEXTS))).coalesce(1), WORD, 1, folder=f"file://{tmp_path}/f")
    file = manifest.first()["file"][len("file://"):]
    data = bytearray(open(file, "rb").read())
    data[8] ^= 1
    open(file, "wb").write(data)
    from pyarrow import fs
    with pytest.raises(Exception):
        list(read_frames(fs.LocalFileSystem().open_input_file(file)))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert read_token_files(write_token_files(empty, WORD, 1)).count() == 0
    assert pack_documents(empty, BYTE, 0).count() == 0


def test_pieces_are_packed_whole_and_gapless(spark):
    keys = [*range(len(TEXTS) - 3), None, 5, 5]
    docs = table(spark, keys).unionAll(table(spark, keys)).repartition(9)
    rows = pack_documents(docs, BYTE, 0, room=512).collect()
    ids = reference(BYTE)
    want = []
    for k, t in [*zip(keys, TEXTS)] * 2:
        one = np.array(ids(t) + [0], "<u4")
        want += [(k, j, s, n, zlib.crc32(one[s:s + n].tobytes())) for j, (s, n) in enumerate(cut(len(one), 512))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 512
    assert len(places) <= 1.1 * sum(r.length for r in rows) / 512 + 2
    assert sum(sum(n for _, n in s) <= 256 for s in places.values()) <= 1


def test_cut_keeps_the_rest_first():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(4, 4) == [(0, 4)]


def test_best_fit_takes_the_tightest_bin():
    random.seed(3)
    for _ in range(50):
        lengths = np.array([random.randint(1, 100) for _ in range(random.randint(0, 60))], np.int64)
        bins, offsets, fills = best_fit(lengths, 100)
        want: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fit = [i for i, f in enumerate(want) if f + n <= 100]
            if fit:
                want[max(fit, key=lambda i: want[i])] += n
            else:
                want.append(n)
        assert sorted(fills.tolist()) == sorted(want)
