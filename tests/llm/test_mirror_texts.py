"""Texts by the Thue-Morse rule and their mirror images, which polynomial hashes modulo 2**64 take for equal."""
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from stallwise.llm import lines, minhash, sentence_pieces, spans, substrings, token_files, wordcache
from stallwise.llm.common import scratch

from . import brute

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(SWAP)
    return text


ONE, TWO = thue_morse(1024), thue_morse(4096)
PAIRS = [(ONE, ONE.translate(SWAP)), (TWO, TWO.translate(SWAP))]
REST = " ".join(f"w{i}" for i in range(19))
ROWS = [(2 * i + j, t) for i, pair in enumerate(PAIRS) for j, t in enumerate(pair)]
ROWS += [(10 + d, f"{t} {REST}") for d, t in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string").coalesce(1).cache()


def by_id(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_hashes_tell_them_apart():
    found = spans.words(*spans.utf8(pa.array([t for _, t in ROWS[:4]])))
    for kind in ({}, {"lower": True}, {"second": True}):
        assert len(set(found.hashes(**kind).tolist())) == 4
    letters = [spans.words(*spans.utf8(pa.array([" ".join(t)]))) for _, t in ROWS[:2]]
    grams = [spans.gram_hashes(s.hashes(), np.array([0]), n)[0] for s in letters for n in (1024, np.array([1024]))]
    assert len(set(map(int, grams))) == 4


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 20])
def test_grams_are_equal_for_equal_windows_only(n):
    values = spans.mix(np.random.default_rng(n).integers(0, 3, 400).astype(np.uint64))
    at = np.arange(400 - n + 1)
    for kind in (False, True):
        got = spans.gram_hashes(values, at, n, kind).tolist()
        want = [values[i: i + n].tobytes() for i in at]
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_lines_stay(docs):
    want = {d: (n, k, brute.sha(t)) for d, n, k, t in brute.lines(ROWS)}
    assert by_id(lines.drop_lines(docs, batches=2)) == want and not any(k for _, k, _ in want.values())


def test_words_stay(docs):
    want = brute.repeats(ROWS)
    assert by_id(substrings.drop_repeats(docs)) == want and not any(gone for _, gone, _ in want.values())


def test_groups_stay_apart(docs):
    assert by_id(minhash.near_duplicates(docs)) == brute.near(ROWS)


def test_pieces_are_their_own(docs):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentence_pieces.encode(docs, path, ["doc_id"]).collect():
        text = dict(ROWS)[r.doc_id]
        assert r.ids == library.encode(text) and r.decoded_sha256 == brute.sha(text)


def test_token_files_are_their_own(spark, docs):
    from tokenizers import Tokenizer
    path, folder = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "ids")
    token_files.write_ids(docs, folder, path, 2)
    library = Tokenizer.from_file(path)
    for r in token_files.read_ids(spark, folder, with_ids=True).collect():
        assert r.ids == [*library.encode(dict(ROWS)[r.doc_id], add_special_tokens=False).ids, 2]


def test_cache_compares_bytes(monkeypatch):
    """Even if all spans had one hash, each would get its own ids; a small cache starts afresh."""
    def encode(texts):
        return np.array([b for t in texts for b in t], np.int32), np.array([len(t) for t in texts], np.int64)
    for equal in (False, True):
        if equal:
            monkeypatch.setattr(wordcache, "block_hashes", lambda blocks, count, size: np.zeros(len(count), np.uint64))
        for limits in ({}, {"limit": 2}, {"room": 40}):
            cache = wordcache.WordCache(encode, **limits)
            for texts in (["one two three one", "", "two three2"], ["four three x"], [None, "abcdefgh abcdefghi abcdefgh"]):
                ids, counts = cache.tokens(spans.words(*spans.utf8(pa.array(texts, pa.string()))))
                plain = [(t or "").replace(" ", "").encode() for t in texts]
                assert ids.tolist() == list(b"".join(plain)) and counts.tolist() == [len(p) for p in plain]
