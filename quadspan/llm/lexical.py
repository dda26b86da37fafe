"""Ranked lexical search with Fagin's threshold algorithm.

``forward_index`` reads every text once and keeps of each document its length and how often each of the queries' terms
occurs in it.  Document counts of terms, and the number and total length of documents, are summed over all of it.  Then
each task takes the rows of the index in blocks of a bounded number of postings.  A block has a list of documents for
each term, sorted by impact (what the term adds to the score), and the forward rows for lookups.  For each query the
lists are read round-robin; documents seen for the first time are scored in full by lookups; reading stops when the sum of
the impacts reached in the lists falls strictly below the k-th best score of this task so far, so that ties are never
lost.  Each task's k best are ranked over all tasks.

Queries go to the tasks in slices of about ``SLICE_BYTES`` of text; each further slice reads the documents again.
Nothing else that is sent to tasks or to the driver grows with the data: a slice's terms and their counts.

Scores are 64-bit integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), and its impact on a document
weight * ((10**9 tf) div (1000 tf + 8 m)) with m = 10 + (90 n N) div L.

Defined cases: each row of documents is a document, each row of items a query (equal rows are ranked once each); null
texts have no terms; documents without a score above 0 are not ranked, so items without terms have no rows; equal scores
are ranked by ascending id, null ids last; extra columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import Tables, tidied
from .words import Texts, chunks

TOP = 10
#: Text of the queries that are worked on at once.
SLICE_BYTES = 4 << 20
#: Postings of a block.
BLOCK = 2_000_000
#: Places of each list that are read at a time, at first.
STRIDE = 8
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = False


class Terms(Texts):
    """Texts whose words are runs of ASCII letters and digits and of all other characters outside ASCII."""

    @property
    def inside(self) -> np.ndarray:
        return ~_OUTSIDE[self.data]


def _terms_of(text: str | None) -> list[bytes]:
    out = []
    for _, t in chunks(pa.array([text or ""]), lower=True):
        found = Terms(t.data, t.bounds)
        out += [t.data[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)]
    return out


class Vocabulary:
    """The distinct terms of some queries, numbered, and found in texts by hash and then byte by byte."""

    def __init__(self, queries: list[str | None]):
        self.of = [sorted(set(_terms_of(q))) for q in queries]
        self.terms = sorted(set().union(*self.of)) if self.of else []
        self.number = {t: k for k, t in enumerate(self.terms)}
        self.queries = [np.array([self.number[t] for t in ts], np.int32) for ts in self.of]
        data = np.frombuffer(b"".join(self.terms), np.uint8)
        self.ends = np.cumsum([0, *map(len, self.terms)])
        hashes = Texts(data, self.ends).spans(self.ends[:-1], self.ends[1:])
        self.order = np.argsort(hashes)
        self.hashes, self.data = hashes[self.order], data

    def lookup(self, t: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words of t are terms, and which term each of those is."""
        words = t.words()
        if not len(self.hashes) or not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == words)
        term = self.order[place[hit]]
        # equal hashes are not taken for equal words: all bytes are compared
        a, b, length = t.starts[hit], self.ends[term], (t.ends - t.starts)[hit]
        same = length == self.ends[term + 1] - b
        for j in range(int(length[same].max()) if same.any() else 0):
            left = np.flatnonzero(same & (length > j))
            same[left] = t.data[a[left] + j] == self.data[b[left] + j]
        return hit[same], term[same]


def forward_index(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (all terms of the document), terms (those of the vocabulary, ascending), tf: one row for each document with
    terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, whole in chunks(b.column(1), lower=True):
                t = Terms(whole.data, whole.bounds)
                n = np.diff(t.first)
                hit, term = vocabulary.lookup(t)
                doc = np.searchsorted(t.first, hit, "right") - 1
                pairs, tf = np.unique(doc.astype(np.int64) << 32 | term, return_counts=True)
                ends = np.searchsorted(pairs >> 32, np.arange(t.n + 1))
                some = n > 0
                out = [b.column(0).slice(k, t.n), pa.array(n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs & 0xFFFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tf.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(out, ["id", "n", "terms", "tf"]).filter(pa.array(some))

    return docs.select(F.col(key).cast("long"), text).mapInArrow(tidied(run), "id long, n long, terms array<int>, tf array<long>")


class Block:
    """A part of the index: impact-sorted lists of its documents by term, and their forward rows."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.n_terms = ids, n_terms
        self.keys, self.impact = doc * n_terms + term, impact  # ascending: rows and their terms are
        order = np.lexsort((doc, -impact, term))
        self.docs, self.sorted = doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.seen = np.zeros(len(ids), bool)

    def score(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by lookups in their forward rows."""
        want = docs[:, None] * self.n_terms + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.impact[at], 0).sum(axis=1)

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Fagin's threshold algorithm over the block's lists of some terms."""
        lo, hi = self.first[terms], self.first[terms + 1]
        touched, depth, stride = [], 0, STRIDE
        while True:
            at = lo[:, None] + np.arange(depth, depth + stride)
            docs = self.docs[at[at < hi[:, None]]]
            new = np.unique(docs[~self.seen[docs]])
            if len(new):
                self.seen[new] = True
                touched.append(new)
                best.offer(self.score(new, terms), self.ids[new])
            depth += stride
            # what an unseen document can have at most: the impact last read in each list that goes on
            on = lo + depth < hi
            if not on.any() or self.sorted[lo[on] + depth - 1].sum() < best.least:
                break
            stride = min(2 * stride, 4096)
        for new in touched:
            self.seen[new] = False


class Best:
    """The k best (score, id) so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.empty(0, np.int64), np.empty(0, np.int64), 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least
        scores, ids = np.concatenate((self.scores, scores[keep])), np.concatenate((self.ids, ids[keep]))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


NO_ID = (1 << 63) - 1


def _impacts(n: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 10 + (90 * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def top_documents(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """query, id, score: each task's k best for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]

        def work(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held)
            ids = t.column("id").fill_null(NO_ID).to_numpy()
            terms, tf = (t.column(c).combine_chunks() for c in ("terms", "tf"))
            sizes = np.diff(terms.offsets.to_numpy())
            doc = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
            term = terms.flatten().to_numpy().astype(np.int64)
            impact = _impacts(t.column("n").to_numpy()[doc], tf.flatten().to_numpy(), weights[term], documents, length)
            block = Block(ids, doc, term, impact, len(weights))
            for q, b in zip(queries, best, strict=True):
                if len(q) and len(term):
                    block.search(q, b)

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(2).flatten()) + b.num_rows
            if size >= BLOCK:
                work(held)
                held, size = [], 0
        if held:
            work(held)
        rows = [(q, i, s) for q, b in enumerate(best) for i, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["query", "id", "score"])

    return index.mapInArrow(tidied(run), "query long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each item."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    asked = tables.write(items.select(F.col(item_key).alias("item"), F.col(item_text).alias("said"), F.xxhash64(F.monotonically_increasing_id()).alias("lot")), "items")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("said")), F.lit(0))).collect()[0][0]
    slices = max(1, -(-total // SLICE_BYTES))
    asked = asked.withColumn("part", F.pmod("lot", F.lit(slices)))
    out = None
    for s in range(slices):
        rows = asked.filter(F.col("part") == s).select("item", "said").collect()  # a slice, bounded by SLICE_BYTES
        words = Vocabulary([r["said"] for r in rows])
        index = tables.write(forward_index(docs, words, key, text), "forward")
        documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).collect()[0]
        df = np.zeros(len(words.terms), np.int64)
        for term, held in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a slice's terms
            df[term] = held
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        found = top_documents(index, words.queries, weights, documents, length, k)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        ranked = tables.write(found.withColumn("rank", place).filter(F.col("rank") <= k), "ranked")
        tables.drop(index)
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(rows)], StructType([StructField("query", LongType()), StructField("item_id", items.schema[item_key].dataType)]))
        part = ranked.join(F.broadcast(names), "query").select("item_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")
        out = part if out is None else out.unionByName(part)
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce({_LOWER}, ''), '{_TERM}') AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts)) AS n_terms FROM d),
q AS (SELECT item_id, row_number() OVER () AS qid, unnest(list_distinct(regexp_extract_all(coalesce({_LOWER}, ''), '{_TERM}'))) AS term FROM benchmark),
f AS (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM f WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT q.qid, q.item_id, p.rid, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
