import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prosemill.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB, ENCODER = Tokenizer.from_file(PATH), WordEncoder(PATH)


def same(texts):
    ids, lengths = ENCODER.encode(texts, 1)
    want = [LIB.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_short_way_is_in_use():
    assert ENCODER.model is not None


def test_words():
    same(["Hello, WORLD...", "it's don't IT'S x's' 's", "naïve Über ÉCOLE straße ŒUVRE İstanbul ΣΟΦΟΣ ſ K", "a1b2 3.14 x<y verein$$$ (word) -- _a_", "éte ñ< a̸=", "中文 текст नमस्ते ﬁ Ǆ ǆ ª º ŉ", "", None, " a b﻿c\x85d", "a\x00b \x1f"])


def test_generations(monkeypatch):
    monkeypatch.setattr(WordEncoder, "LIMIT", 3)
    for k in range(6):
        same([f"one two w{k} Three, four.", f"x{k} one two five"])
    assert ENCODER.last and len(ENCODER.cache) < 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZÉéßñøŁǆ'.,-_$<=1٣ \ń̸ İſ中\u0958\ufb1d\u0301"), max_size=30), max_size=6))
def test_any_text(texts):
    same(texts)


def test_a_stretch_is_learned_where_it_is_met_and_once(monkeypatch):
    """Known stretches cost one lookup each: no set of a batch's words is made and held against the cache."""
    fresh, met = WordEncoder(PATH), []
    learn = fresh.cache.learn
    monkeypatch.setattr(fresh.cache, "learn", lambda w: met.append(w) or learn(w))
    texts = ["Alpha beta, beta; alpha", "beta alpha 12-34 Élan élan 漢字", "", None]
    want = [LIB.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    for _ in range(2):
        ids, lengths = fresh.encode(texts, 1)
        assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == list(map(len, want))
    assert len(met) == len(set(met)) and {b"Alpha", b"alpha", b"beta", b","} <= set(met)


def test_widths_of_any_number():
    import numpy as np

    from prosemill.llm.tokens import _bits

    numbers = sorted({0, *((1 << k) + d for k in range(32) for d in (-1, 0, 1) if (1 << k) + d < 1 << 32)})
    assert _bits(np.array(numbers, np.uint32)).tolist() == [n.bit_length() for n in numbers]
