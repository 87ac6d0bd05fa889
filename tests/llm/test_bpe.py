import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketlens.llm import bpe, queries
from basketlens.sources.tables import read_table

from .util import SF, docs_frame

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.vocabulary_path()


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def library_digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(min_codepoint=32, max_codepoint=0x24F), st.sampled_from("'sStrRe  \n\tΣ日本😀.!?|<>")), max_size=60))
def test_same_ids_and_text_as_the_library(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text).tolist() == want
    assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "a" * 5000, "İΣΑΣ ΣΑΣ", "it's WE'RE I'll'd", "é Å", "\x1cx\x1fy\x85z\xa0w", "!?" * 500])
def test_special_cases(codec, library, text):
    assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_stale_entries_and_memory(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    rng = random.Random(0)
    for _ in range(50):
        text = " ".join("".join(rng.choice("aabnn") for _ in range(rng.randrange(1, 30))) for _ in range(10))
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_frames(spark, library):
    rows = [(1, "Hello wörld", "old"), (1, "Hello wörld", "old"), (2, None, None), (3, "", "x"), (4, "long " * 20_000, "y")]
    df = docs_frame(spark, rows, "doc_id long, text string, ids string")
    enc = bpe.encode(df, PATH)
    out = {r.doc_id: r for r in bpe.decode(enc, PATH).collect()}
    for i, t, _ in rows:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].ids == want and out[i].decoded == library.decode(want, skip_special_tokens=False)
    assert enc.count() == 5 and bpe.encode(docs_frame(spark, []), PATH).count() == 0


def test_query_on_the_whole_table(spark, library):
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op4_bpe"](spark, SF).collect()}
    assert out == {r.doc_id: library_digest(library, r.text) for r in read_table(spark, SF, "documents").collect()}
