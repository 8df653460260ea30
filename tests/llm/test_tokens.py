"""Token counts and BPE against their libraries."""

import hashlib
import pathlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import queries as Q
from millrace.llm.bpe import Bpe, decode_ids, encode_texts
from millrace.llm.token_counts import Lengths, count_tokens, frequent_lengths, pretokens, read_vocabulary

PIECES, BYTES = Q.vocabulary_path("piece_bpe_32k.model"), Q.vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.no_padding(), t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    return Bpe(pathlib.Path(BYTES).read_bytes())


def test_counts_of_whole_table(spark, sf_dir, pieces):
    texts = {r.doc_id: r.text or "" for r in Q.table(spark, sf_dir, "documents").collect()}
    rows = Q.op1_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(pieces.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_counts_of_odd_rows(spark, odd_docs, keeps_columns, pieces):
    for entries in (0, 32768):  # any table gives the same counts
        rows = keeps_columns(count_tokens(odd_docs, PIECES, entries=entries), odd_docs, ("n_tokens", "n_bytes"))
        assert all(r.n_tokens == len(pieces.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) for r in rows)
    assert count_tokens(odd_docs.where("false"), PIECES).count() == 0


def test_table_has_the_frequent_pretokens(spark, sf_dir, pieces):
    """Over all rows, without a shuffle by pre-token: what moves is packed rows, one a task."""
    docs = Q.table(spark, sf_dir, "documents").repartition(6)
    seen = Counter(p for r in docs.collect() for p in pretokens(r.text or ""))
    found = frequent_lengths(docs, read_vocabulary(PIECES), entries=300)
    assert len(found) == 300 and len(set(found) & {p for p, _ in seen.most_common(300)}) > 270
    assert all(n == len(pieces.encode(p[1:])) for p, n in found.items() if p != " ")
    assert frequent_lengths(docs.where("false"), read_vocabulary(PIECES)) == {}


def test_counts_of_random_texts(pieces, random_texts):
    assert Lengths({}, read_vocabulary(PIECES)).of(random_texts) == [len(pieces.encode(t)) for t in random_texts]


def test_bpe_of_whole_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in Q.table(spark, sf_dir, "documents").collect()}
    rows = Q.op5_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_of_odd_rows(spark, odd_docs, keeps_columns, library):
    out = encode_texts(odd_docs, BYTES, decoded="decoded")
    for r in keeps_columns(out, odd_docs, ("ids", "decoded")):
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert encode_texts(odd_docs.where("false"), BYTES).count() == 0
    ids = spark.createDataFrame([([220, 50256],), (None,), ([],)], "ids array<int>")
    assert [r.text for r in decode_ids(ids, BYTES).collect()] == [" <|endoftext|>", "", ""]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_bpe_of_any_text(own, library, text):
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_bpe_of_random_texts(own, library, random_texts):
    for t in [*random_texts, *("".join(map(chr, range(k, k + 64))) for k in range(0, 0x3000, 64))]:
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_decode_of_broken_bytes(own, library):
    for ids in ([0xE9, 100, 222], [170, 170, 5], list(range(256))):
        import numpy as np

        assert own.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)
