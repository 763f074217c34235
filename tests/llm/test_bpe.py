import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tablewright.llm import bpe, registry

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.load_vocabulary(PATH))


def ours(coder, text):
    return coder.encode([text])[0].tolist()


TEXTS = ["", " ", "  \n\t a", "Hello, world! it's we'll I'd 'S", "über Größe naïve été ñandú", "日本語のテキスト",
         "🙂🙃 family 👨‍👩‍👧", "a" * 70, "ab" * 5000, "x" * 100_000, "1234567890 3.14", "a<|endoftext|>b <|endoftext|>",
         "<|endoftext|><|endoftext|>", "<|endoftext", "  <|endoftext|>  ", "\x00\x01\x7f\x85\x1c\x1d  ​ x",
         "tail   ", "\r\n\r\n", "<|endoftext|>\n\nx", "ſs K ﷺ \U000e0001", "the the and of " * 3000]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_same_ids_as_the_library(lib, coder, i):
    ids = lib.encode(TEXTS[i], add_special_tokens=False).ids
    assert ours(coder, TEXTS[i]) == ids
    v = coder.v
    assert bpe.decode_ids(v, np.array(ids), np.array([len(ids)])) == [lib.decode(ids, skip_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    global _LIB, _CODER
    try:
        lib, coder = _LIB, _CODER
    except NameError:
        lib, coder = _LIB, _CODER = Tokenizer.from_file(PATH), bpe.Encoder(bpe.load_vocabulary(PATH))
    assert ours(coder, text) == lib.encode(text, add_special_tokens=False).ids


def test_every_character(lib, coder):
    for start in range(0, 0x30000, 0x1000):
        text = " ".join(f"a{chr(c)}b" for c in range(start, start + 0x1000) if not 0xD800 <= c < 0xE000)
        if text:
            assert ours(coder, text) == lib.encode(text, add_special_tokens=False).ids, hex(start)


def test_one_tree_and_many_trees_agree(coder):
    rng = np.random.default_rng(3)
    for _ in range(200):
        piece = bytes(rng.choice(list(b"theandoirs"), rng.integers(2, 64)).tolist())
        sym = coder.v.byte_ids[np.frombuffer(piece, np.uint8)]
        assert bpe.merge_long(coder.v, sym).tolist() == bpe.encode_pieces(coder.v, [piece])[0].tolist()


def test_part_of_a_character_decodes_to_a_replacement(lib, coder):
    ids = lib.encode("🙂é", add_special_tokens=False).ids
    for some in (ids[:1], ids[1:], ids[::-1], [50256, ids[0]]):
        assert bpe.decode_ids(coder.v, np.array(some), np.array([len(some)])) == [
            lib.decode(some, skip_special_tokens=False)]


def test_frames(spark):
    schema = "doc_id long, text string, ids string, decoded int"
    df = spark.createDataFrame([(1, None, "a", 1), (None, "", "a", 1), (2, "it's", None, None), (2, "it's", "b", 1)], schema)
    out = bpe.decode(bpe.encode(df, PATH, ids_col="t"), PATH, ids_col="t", text_col="back")
    assert sorted((str(r.doc_id), r.back) for r in out.collect()) == [("1", ""), ("2", "it's"), ("2", "it's"), ("None", "")]
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_query(spark, lib):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.QUERIES["op3_bpe"](spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert got.pop(r.doc_id) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert not got
