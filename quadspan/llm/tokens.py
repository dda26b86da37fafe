"""Token ids of texts, by a vocabulary file of the tokenizers library (lower case, white space dropped).

Texts are cut at ASCII white space, which the file's pre-tokeniser also does, so a word's ids don't depend on its
neighbours, and each worker keeps the ids of words that it has met.  Of new words, a run of Latin letters is one
pre-token, of which the normaliser only makes lower case: it goes to the library's BPE model itself.  ASCII marks before
and behind such a run are pre-tokens of their own (apostrophes aren't taken so, nor < and |, which special tokens begin
with).  All others go through the whole tokenizer."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Words whose ids a worker keeps in each of two generations: memory is bounded, and results don't depend on it.
KEPT_WORDS = 300_000

_MARKS = rb"[!-&(-/:;=?@\[-`{}~]*"
_PLAIN = re.compile(rb"(" + _MARKS + rb")((?:[a-zA-Z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)(" + _MARKS + rb")").fullmatch


class _Ids(dict):
    """The ids of words; those of a new one are looked for with learn."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.load(open(path))
        #: Plain words are only known to be single pre-tokens under this kind of file.
        self.plain = spec["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in json.dumps(spec["normalizer"])
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({chr(b): level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1:] for b in range(0x80, 0xC0)} | {"\xc3": level.pre_tokenize_str("é")[0][0][0]})
        self.four = [i.to_bytes(4, "little") for i in range(max(spec["model"]["vocab"].values()) + 1)]
        self.known, self.older = _Ids(self.learn), {}
        self.marks: dict[bytes, bytes] = {b"": b""}

    def whole(self, word: bytes) -> bytes:
        """The ids of a word, through the whole tokenizer."""
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def mark(self, marks: bytes) -> bytes:
        """The ids of a run of marks; those of short ones are kept."""
        if (ids := self.marks.get(marks)) is None:
            ids = self.whole(marks)
            if len(marks) < 4:
                self.marks[marks] = ids
        return ids

    def learn(self, word: bytes) -> bytes:
        """The ids of a word that isn't among the known ones."""
        if (ids := self.older.get(word)) is not None:
            return ids
        four = self.four
        if self.plain and word.isalpha():  # ASCII letters only
            return b"".join([four[t.id] for t in self.model.tokenize(word.decode().lower())])
        if not self.plain or (m := _PLAIN(word)) is None:
            return self.whole(word)
        before, run, behind = m.groups()
        if before or behind:
            return self.mark(before) + self.known[run] + self.mark(behind)
        # an ASCII letter is itself to the model, bytes of others are letters of their own
        text = run.decode("latin-1").lower() if run.isascii() else run.decode().lower().encode().decode("latin-1").translate(self.letters)
        return b"".join([four[t.id] for t in self.model.tokenize(text)])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, _Ids(self.learn)
        get = self.known.__getitem__
        # special tokens are told apart by case
        return [b"".join(map(get, (t if b"<|" in t or not self.plain else t.lower()).split())) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
