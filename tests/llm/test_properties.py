"""Properties on random texts: scanning and encoding agree with regular expressions and with the library on whole texts."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossa.llm import bytescan, tokenfile
from glossa.llm.encoding import Encoder, tokenizer_json
from glossa.llm.queries import tokenizer_path

from .conftest import lower

ALPHABET = list("abZ09 '\".,!?<|>-_=\n\t\r\x0b\x0c") + [" ", " ", "　", "\u0085", "é", "é", "́", "ß", "Σ", "ς", "İ", "中", "😀", "½", "²", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "\x00", "\x1c", "​", "ﬁ"]
TEXT = st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join)
ENCODERS = {n: Encoder(tokenizer_json(tokenizer_path(n))) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
@pytest.mark.parametrize("name", ENCODERS)
def test_runs_encode_like_whole_texts(name, texts):
    encoder = ENCODERS[name]
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT, st.text(max_size=30)), min_size=1, max_size=5))
def test_scans_agree_with_regular_expressions(texts):
    for word, pattern in ((bytescan.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (bytescan.NONSPACE, r"[^\x20\x09-\x0D]+")):
        w = bytescan.scan(pa.array(texts, pa.string()), word)
        for d, t in enumerate(texts):
            assert [w.text(i, i + 1).decode() for i in range(w.doc[d], w.doc[d + 1])] == re.findall(pattern, lower(t))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=80))
def test_bits_round_trip(bits, numbers):
    ids = np.array([n % 2**bits for n in numbers], np.uint32)
    assert (tokenfile.unpack_bits(np.frombuffer(tokenfile.pack_bits(ids, bits), np.uint8), len(ids), bits) == ids).all()
