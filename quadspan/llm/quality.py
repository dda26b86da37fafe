"""Quality rules as a short-circuit cascade.

Each rule is a predicate over a text's counts.  ``plan`` measures every rule's cost and the share of documents that it
rejects on a bounded sample, and orders the rules by rejections per cost; ``cascade`` then asks the next rule only for
the documents that no earlier rule has rejected.  A document is kept if no rule rejects it, so the order changes the
work and never the verdict.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; repeated rows get the same
verdict each; an empty table gives an empty result; other columns of the input stay as they are.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidied
from .words import Texts, chunks, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LETTER = _UPPER.copy()
_ASCII_LETTER[97:123] = True
_LETTER = _ASCII_LETTER.copy()
_LETTER[128:] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(t: Texts, flags: np.ndarray) -> np.ndarray:
    """How many of each text's bytes are flagged."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[t.bounds[1:]] - total[t.bounds[:-1]]


def n_words(t: Texts, live: np.ndarray) -> np.ndarray:
    return np.diff(t.first)[live]


def word_chars(t: Texts, live: np.ndarray) -> np.ndarray:
    return _sums(t, t.inside & ((t.data & 0xC0) != 0x80))[live]


def n_symbols(t: Texts, live: np.ndarray) -> np.ndarray:
    return _sums(t, _SYMBOL[t.data])[live]


def n_dup_lines(t: Texts, live: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    breaks = np.flatnonzero(t.data == 10)
    starts = np.union1d(t.bounds[:-1], breaks + 1)
    starts = starts[starts < len(t.data)]
    nexts = np.append(starts[1:], len(t.data))
    broken = np.zeros(len(t.data) + 1, bool)
    broken[breaks] = True
    ends = np.where(broken[nexts - 1], nexts - 1, nexts)
    worded = np.concatenate(([0], np.cumsum(t.inside)))
    full = worded[ends] > worded[starts]
    starts, ends = starts[full], ends[full]
    hashes, at = t.spans(starts, ends), np.searchsorted(starts, t.bounds)
    return np.array([(n := at[i + 1] - at[i]) - len(np.unique(hashes[at[i] : at[i + 1]])) if at[i + 1] - at[i] > 1 else 0 for i in live], np.int64)


def n_repeat_words(t: Texts, live: np.ndarray, k: int = 5) -> np.ndarray:
    """Words inside k-word windows that the text has twice or more."""
    words, out = t.words(), np.zeros(len(live), np.int64)
    for j, i in enumerate(live):
        w = windows(words[t.first[i] : t.first[i + 1]], k)
        if len(w) < 2:
            continue
        order = np.argsort(w)
        same = w[order][1:] == w[order][:-1]
        if not same.any():
            continue
        twice = np.zeros(len(w) + k, np.int64)
        found = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
        np.add.at(twice, found, 1)
        np.add.at(twice, found + k, -1)
        out[j] = (np.cumsum(twice)[: len(w) + k - 1] > 0).sum()
    return out


@dataclass(frozen=True)
class Rule:
    """rejects(texts, live): for each text number of live, whether the rule rejects it."""

    name: str
    rejects: Callable[[Texts, np.ndarray], np.ndarray]


def base(t: Texts, live: np.ndarray) -> np.ndarray:
    n = n_words(t, live)
    return (n < 10) | (100 * n_repeat_words(t, live) > 20 * n)


def symbols(t: Texts, live: np.ndarray) -> np.ndarray:
    """More than one symbol in ten words."""
    return 10 * n_symbols(t, live) > n_words(t, live)


def shouting(t: Texts, live: np.ndarray) -> np.ndarray:
    """Over half of the ASCII letters are capitals."""
    return 2 * _sums(t, _UPPER[t.data])[live] > _sums(t, _ASCII_LETTER[t.data])[live]


def exclaiming(t: Texts, live: np.ndarray) -> np.ndarray:
    """Over one ! or ? to two words."""
    return 2 * _sums(t, _SHOUT[t.data])[live] > n_words(t, live)


def word_length(t: Texts, live: np.ndarray) -> np.ndarray:
    """A mean word of under 2 or over 15 characters."""
    n, c = n_words(t, live), word_chars(t, live)
    return (c < 2 * n) | (c > 15 * n)


def letterless(t: Texts, live: np.ndarray) -> np.ndarray:
    """Over half of the words hold no letter."""
    letters = np.concatenate(([0], np.cumsum(_LETTER[t.data])))
    none = np.concatenate(([0], np.cumsum(letters[t.ends] == letters[t.starts])))
    return 2 * (none[t.first[1:]] - none[t.first[:-1]])[live] > n_words(t, live)


def repeated_lines(t: Texts, live: np.ndarray) -> np.ndarray:
    """More lines repeat an earlier one than don't."""
    lines = _sums(t, t.data == 10)[live] + 1
    return 2 * n_dup_lines(t, live) > lines


RULES = (Rule("base", base), Rule("symbols", symbols), Rule("shouting", shouting), Rule("exclaiming", exclaiming), Rule("word_length", word_length), Rule("letterless", letterless), Rule("repeated_lines", repeated_lines))


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 400, text: str = "text") -> tuple[Rule, ...]:
    """The rules by rejections per second, most first, as measured by the driver on the first ``sample`` documents of
    moderate length that Spark comes by (it reads a few partitions, not all)."""

    texts = docs.select(text).filter(F.length(text) <= 20_000).take(sample)
    spent, bad = Counter(), Counter()
    for _, t in chunks(pa.array([r[0] for r in texts], pa.string())):
        for k, r in enumerate(rules):
            began = time.perf_counter()
            bad[k] += int(r.rejects(t, np.arange(t.n)).sum())
            spent[k] += time.perf_counter() - began
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-bad[k] / max(spent[k], 1e-9), k)))


def cascade(t: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """The number of the rule that rejects each text, or -1; a rule sees only what no earlier one has rejected."""
    out, live = np.full(t.n, -1), np.arange(t.n)
    for k, r in enumerate(rules):
        if not len(live):
            break
        bad = r.rejects(t, live)
        out[live[bad]] = k
        live = live[~bad]
    return out


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] | None = None, text: str = "text") -> DataFrame:
    """The documents that every rule keeps, with the columns that they had."""
    rules, schema = rules or plan(docs, text=text), docs.schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in chunks(b.column(at)):
                yield b.slice(k, t.n).filter(pa.array(cascade(t, rules) < 0))

    return docs.mapInArrow(tidied(run), schema)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each document the base counts, whether the base rules reject it, the first rule of the cascade that does,
    and the verdict."""
    rules = rules or plan(docs, text=text)
    rest = tuple(r for r in rules if r.name != "base")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in chunks(b.column(1)):
                live = np.arange(t.n)
                counts = {f.__name__: f(t, live).astype(np.int64) for f in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)}
                failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
                by = np.full(t.n, -1)
                passed = np.flatnonzero(~failed)
                ask = passed
                for j, r in enumerate(rest):
                    bad = r.rejects(t, ask) if len(ask) else np.zeros(0, bool)
                    by[ask[bad]] = j
                    ask = ask[~bad]
                rule = ["base" if f else rest[j].name if j >= 0 else None for f, j in zip(failed, by)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, t.n), *(pa.array(counts[n]) for n in BASE), pa.array(failed), pa.array(~failed & (by < 0)), pa.array(rule, pa.string())], [key, *BASE, "base_failed", "kept", "rejected_by"])

    return docs.select(key, text).mapInArrow(tidied(run), f"{key} {kind}, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, kept boolean, rejected_by string")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")
