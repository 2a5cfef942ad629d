import random

import public_tokenizers
import pytest
from tessera.llm import token_count as K

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda s: len(t.encode(s or "", add_special_tokens=False))


def test_counts_equal_the_library(library):
    rnd = random.Random(1)
    letters = list("ab 12'\n\t é🙂\x1c\x85　<|>.,")
    texts = ["", " ", "a  b", "it's we'll I'D", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "日本語 テスト", " x ", "\n\n x", "antidisestablishmentarianism" * 9]
    texts += ["".join(rnd.choices(letters, k=rnd.randint(1, 50))) for _ in range(1500)]
    m = K.Merger(PATH)
    assert [m.count(t) for t in texts] == [library(t) for t in texts]


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(K, "CACHE_ENTRIES", 3)
    m = K.Merger(PATH)
    for t in ("a few words here and there again a few", "x y z x y z"):
        assert m.count(t) == library(t)


def test_messy_documents(messy, library):
    rows = K.token_counts(messy, PATH, limit=20).collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in messy.collect()), key=str)
    want = sorted(((i, len((t or "").encode()), library(t), library(t) > 20) for i, t in texts), key=str)
    assert sorted(map(tuple, rows), key=str) == want


def test_empty_table(empty):
    assert K.token_counts(empty, PATH).count() == 0
