"""Words of an encoder against the whole tokenizer, and which words go through it."""

import random

import numpy as np
from tokenizers import Tokenizer

from quadspan.llm import tokens


def test_odd_words(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 500)  # both generations are used
    path, dice = tokens.default_vocabulary(), random.Random(1)
    letters = [*"abZÀéßÿŸ×÷ñ'\"#.,-_|<>()[]{}~`^$%&*+=?@!/\\:;019", "'s", "</w>", "É", "<|", "é"]
    words = ["".join(dice.choice(letters) for _ in range(dice.randint(1, 9))) for _ in range(3000)]
    whole, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    for at in range(0, len(words), 100):
        texts = [" ".join(words[at : at + 100])]
        got = encoder.encode([t.encode() for t in texts])
        assert np.frombuffer(got[0], "<u4").tolist() == whole.encode(texts[0], add_special_tokens=False).ids


def test_marked_words_are_cut(monkeypatch):
    """A word with marks, or in upper case, isn't sent through the whole tokenizer."""
    seen, whole = [], tokens.Encoder.whole
    monkeypatch.setattr(tokens.Encoder, "whole", lambda self, word: (seen.append(word), whole(self, word))[1])
    tokens.Encoder(tokens.default_vocabulary()).encode(["(wending) wending### Échoing### «no»".encode()])
    assert sorted(seen) == [b"###", b"(", b")", "«no»".encode()]


def test_words_of_letters_need_no_pattern(monkeypatch):
    """ASCII letters go to the model at once, and words that are letters but for their end don't make the pattern go back."""
    from quadspan.llm import tokens

    e, whole = tokens.Encoder(tokens.default_vocabulary()), tokens.Encoder(tokens.default_vocabulary()).whole
    for word in ("letters", "a", "x" * 300, "é" * 40 + "1", "aé" * 40 + "1", "a" * 60 + "1", "..word,", "ça", "don't"):
        assert e.encode([word.encode()]) == [whole(word.encode())], word
    monkeypatch.setattr(tokens, "_PLAIN", None)
    assert e.encode([b"unmet Wordsofletters"]) == [whole(b"unmet") + whole(b"wordsofletters")]
