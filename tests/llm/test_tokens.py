import random

import numpy as np
import public_tokenizers
import pytest

from quarry.llm import queries, sentence_pieces, token_counts
from quarry.llm.piece_model import PieceModel, StreamingCoder
from quarry.sources.tables import table

from .fixtures import docs, odd_texts, with_clashes

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(WORDS)


def test_coder_equals_library(library):
    rng = random.Random(5)
    with open(PIECES, "rb") as f:
        coder = StreamingCoder(PieceModel(f.read()), cache_size=300)  # caches are emptied again and again
    alphabet = "abcdefghijklmnop    ,.\n\té漢字aaaa<>x0A▁−"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(800)]
    texts += ["".join(library.id_to_piece(rng.randrange(259, 32000)).replace("▁", " ") for _ in range(30)) for _ in range(400)]
    texts += ["".join(rng.choice("abcdef") for _ in range(8000)), "a" * 3000, " " * 2000, "=-" * 900, "theofin" * 400, "\x00 \x00"]
    for t in texts:
        assert np.frombuffer(coder.encode(t), dtype=np.int32).tolist() == library.encode(t), t[:80]


def test_window_is_bounded(monkeypatch):
    with open(PIECES, "rb") as f:
        coder = StreamingCoder(PieceModel(f.read()))
    seen = []
    real = StreamingCoder._converged
    monkeypatch.setattr(StreamingCoder, "_converged", staticmethod(lambda last, end, longest: seen.append(len(last)) or real(last, end, longest)))
    pieces = coder.path("the" * 20000)
    assert "".join(pieces) == "the" * 20000
    assert max(seen) < 40 * coder.m.longest


def test_encode_decode(spark, library):
    texts = odd_texts()
    rows = sentence_pieces.round_trip(with_clashes(docs(spark, texts)), PIECES).collect()
    by_id = {r.id: r for r in rows}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert by_id[k].ids == library.encode(t or "")
        assert by_id[k].same == ("▁" not in (t or ""))  # the mark itself decodes to a blank
    assert sentence_pieces.round_trip(docs(spark, []), PIECES).count() == 0


def test_decode_equals_library(spark, library):
    rng = random.Random(2)
    lists = [[], [1, 2], [rng.randrange(259, 32000) for _ in range(50)], library.encode("漢字 x"), None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "id long, ids array<int>")
    got = {r.id: r.decoded for r in sentence_pieces.decode(df, PIECES).collect()}
    assert [got[k] for k in range(len(lists))] == [library.decode(x or []) for x in lists]


def test_op5_on_documents(spark, library):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = queries.op5_sentence_pieces(spark, SF).collect()
    assert len(rows) == len(texts) and all(r.round_trip and r.ids == library.encode(texts[r.doc_id]) for r in rows)


def test_counts_equal_library(spark, words):
    texts = odd_texts(3, 200)
    rows = token_counts.count_tokens(with_clashes(docs(spark, texts)), WORDS).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(words.encode(t, add_special_tokens=False))), t[:80]
    assert token_counts.count_tokens(docs(spark, []), WORDS).count() == 0


def test_counts_without_safe_cuts(spark):
    """A byte-level tokenizer keeps white space, so its texts are encoded whole."""
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = odd_texts(4, 30)
    for r in token_counts.count_tokens(docs(spark, texts), path).collect():
        assert r.n_tokens == len(whole.encode(texts[r.id] or "", add_special_tokens=False))


def test_op9_on_documents(spark, words):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = queries.op9_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(words.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
