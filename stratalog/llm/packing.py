"""Training sequences of related documents, by a sharded BM25 index over each task's blocks.

Documents are routed to shards by content: range-sorted by the least hash of their long
words, so that documents with the same rare words come to lie side by side, wherever they
were stored. A shard is a block of documents of a task, which holds one block at a time; a
route that very many documents share is a range of several tasks. The first unused document of a shard seeds a window; its most
telling terms query the shard's inverted index, and the unused neighbours that it returns
fill the window, the last one being cut. The rest of a cut document seeds the next window.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import map_batches
from stratalog.llm.tokens import chunk_tokenizer, vocabulary_path

#: Tokens of a sequence, id that ends a document, tokens of a shard, terms of a query,
#: neighbours that one query returns, the usual BM25 parameters, characters of a word that
#: can route its document, and shuffle partitions of documents whose pieces one task gives.
SEQUENCE, END_ID, SHARD_TOKENS, QUERY_TERMS, NEIGHBOURS, K1, B, LONG_WORD = 4096, 2, 4_000_000, 24, 32, 1.2, 0.75, 7
RANGES_A_PART = 32

_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class InvertedIndex:
    """BM25 postings of the documents of one shard; terms are token ids."""

    def __init__(self, docs: list[np.ndarray]):
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs))
        n = np.array([len(t) for t in terms])
        length = np.array([len(d) for d in docs], np.float64)
        doc, term, tf = np.repeat(np.arange(len(docs)), n), np.concatenate(terms), np.concatenate(counts)
        df = np.bincount(term)
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / length.mean()))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(df)])
        self.size, self.df = len(docs), df
        # of each document, the terms that others have too and that tell most
        self.query: list[np.ndarray] = []
        at = 0
        for k in n.tolist():
            own, w = term[at : at + k], np.where(df[term[at : at + k]] > 1, weight[at : at + k], 0)
            best = np.argpartition(-w, QUERY_TERMS)[:QUERY_TERMS] if k > QUERY_TERMS else np.arange(k)
            self.query.append(own[best[w[best] > 0]])
            at += k

    def neighbours(self, terms: np.ndarray, unused: np.ndarray) -> list[int]:
        """Unused documents by falling score, then position; those that share no term are
        not among them."""
        terms = terms[terms < len(self.df)]
        if not len(terms):
            return []
        spans = [slice(self.start[t], self.start[t + 1]) for t in terms.tolist()]
        docs = np.concatenate([self.doc[s] for s in spans])
        score = np.bincount(docs, np.concatenate([self.weight[s] for s in spans]), self.size)
        score[~unused] = 0
        best = np.argpartition(-score, NEIGHBOURS)[:NEIGHBOURS] if self.size > NEIGHBOURS else np.arange(self.size)
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))].tolist()


class Packer:
    """Fills windows shard by shard; the window that a shard leaves open goes on in the next."""

    def __init__(self, first_id: int):
        self.next_id, self.room, self.window, self.terms = first_id, SEQUENCE, [], None
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def _put(self, doc_id, ids: np.ndarray, terms: np.ndarray) -> None:
        """Add a document; what does not fit goes into windows of its own, the last left open."""
        at = 0
        while at < len(ids):
            part = ids[at : at + self.room]
            if not self.window:
                self.terms = terms
            self.window.append((doc_id, at, part, len(ids)))
            at += len(part)
            self.room -= len(part)
            if not self.room:
                self._emit(self.window)
                self.window, self.room = [], SEQUENCE

    def shard(self, doc_ids: list, docs: list[np.ndarray]) -> None:
        index = InvertedIndex(docs)
        unused = np.ones(len(docs), bool)
        first = 0

        def take(i: int) -> None:
            unused[i] = False
            self._put(doc_ids[i], docs[i], index.query[i])

        while True:
            if self.window:
                full = self.next_id
                near = index.neighbours(self.terms, unused)
                for i in near:
                    take(i)
                    if self.next_id != full:
                        break
                if near:  # a full window, or one that asks for more
                    continue
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return
            take(first)  # a seed, or, where no neighbour is left, the next in order

    def finish(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two: no padding."""
        left = SEQUENCE - self.room
        for k in reversed(range(SEQUENCE.bit_length())):
            if not left >> k & 1:
                continue
            need, pieces = 1 << k, []
            while need:
                doc_id, start, ids, total = self.window.pop(0)
                if len(ids) > need:
                    self.window.insert(0, (doc_id, start + need, ids[need:], total))
                    ids = ids[:need]
                pieces.append((doc_id, start, ids, total))
                need -= len(ids)
            self._emit(pieces)
        self.window, self.room = [], SEQUENCE


def routed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of the least hash of the words, cut at spaces, of LONG_WORD
    characters or more; without any, of the text."""
    words = F.filter(F.split("text", " "), lambda w: F.length(w) >= LONG_WORD)
    route = F.coalesce(F.array_min(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    keyed = docs.select(F.col("doc_id").cast("long"), "text", route.alias("route"))
    order = ["route", "doc_id", F.xxhash64("text")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def _in_few_parts(pieces: DataFrame) -> DataFrame:
    """pieces dealt out evenly to a task for every RANGES_A_PART shuffle partitions (but one a
    core). A piece is some 50 bytes of a document of thousands, so what packs documents in
    parallel would else write as many tiny files, and for each of them an executor forks
    children off its JVM on local file systems, which hold its memory twice for a moment."""
    session = pieces.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions")) // RANGES_A_PART
    return pieces.repartition(max(session.sparkContext.defaultParallelism, parts))


def pack(docs: DataFrame, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece of docs(doc_id, text): where it lies in its document and sequence.

    A document is its token ids and an end id, so null and empty texts are one token. All
    sequences have SEQUENCE tokens but the last few of a task, which have powers of two.
    sequence_id holds the task's number and a count; a task that runs again makes the same
    rows, since its range is sorted. Repeated rows, null and equal ids are packed as given; an empty
    table gives none; other columns are not read. Rows come in no promised order.
    """
    vocabulary = vocabulary or vocabulary_path()

    def run(batches):
        from pyspark import TaskContext

        tokenizer, packer = chunk_tokenizer(vocabulary), Packer(TaskContext.get().partitionId() << 40)
        end = np.array([END_ID], np.uint32)

        def rows():
            found, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 7,
                names=[f.split()[0] for f in _PIECES.split(", ")],
            )

        ids, held, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = np.concatenate([np.frombuffer(tokenizer.encode(text.as_py() or ""), "<u4"), end])
                ids.append(doc_id)
                held.append(coded)
                size += len(coded)
                if size >= shard_tokens:
                    packer.shard(ids, held)
                    ids, held, size = [], [], 0
                    yield rows()
        if held:
            packer.shard(ids, held)
        packer.finish()
        tokenizer.forget()
        yield rows()

    return _in_few_parts(map_batches(routed(docs), run, _PIECES))
