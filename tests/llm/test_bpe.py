import random
import struct

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hydrospark.llm import bpe

PATH, PATTERN = bpe.default_table()
TEXTS = st.text(st.sampled_from("abcdeé'st re  \n\t\x1c漢字🙂12AB.!the "), max_size=60)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks_at(PATH).rank, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=TEXTS, put=TEXTS, seed=st.integers(0, 2**32))
def test_appends_and_edits_equal_encoding_afresh(library, text, put, seed):
    held = bpe.Encoded(bpe.ranks_at(PATH), PATTERN, text)
    assert held.ids() == library.encode_ordinary(text)
    pick = random.Random(seed)
    begin = pick.randint(0, len(text))
    end = pick.randint(begin, len(text))
    held.edit(begin, end, put)
    text = text[:begin] + put + text[end:]
    assert held.ids() == library.encode_ordinary(text)
    held.append(put)
    assert held.ids() == library.encode_ordinary(text + put)


def test_work_stays_near_an_edit():
    held = bpe.Encoded(bpe.ranks_at(PATH), PATTERN, "some words here " * 2000)
    before = held.encoded_bytes
    held.edit(16000, 16004, "other")
    assert held.encoded_bytes - before < 60


def test_prefixes_of_a_long_piece(library):
    ranks, piece = bpe.ranks_at(PATH), b"abcabcxyzthequick" * 200
    last = ranks.last_tokens(piece)
    for n in (1, 7, 100, len(piece)):
        assert ranks.walk_back(last, n) == library._encode_single_piece(piece[:n])
    assert ranks.last_tokens(piece, last[:50]) == last


def test_table(spark, table, library):
    texts = ["", None, "Hello <|endoftext|> world's  end\n\n", "a\x1cb \x85 c", "x" * 50_000, "Hello", "Hello"]
    docs = table(*enumerate(texts), (None, "no id"))
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH).collect()}
    assert len(rows) == len(texts) + 1
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert bytes(rows[i].ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert bytes(rows[i].decoded) == (text or "").encode()
    assert bytes(rows[None].decoded) == b"no id"
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0
