"""Ranked lexical search over a bit-sliced impact index.

The weight that a term adds to a document's score, its impact, is an integer known once the corpus counts are. The
index holds blocks of `BLOCK` documents; bit s of the impacts of a term in a block is one bitmap over its documents.
A search adds the bitmaps of a query's terms slice by slice with carries, for many queries and 64 documents a machine
word at a time, and finds the best k from the most significant slice down: documents with the bit are kept while more
than k have it, else they are in and the search goes on among those without. Ties at the end go to the smaller id,
as the documents of a block lie in that order. The best of the blocks are merged in each task, then over tasks.

Queries come in blocks of at most `block_chars` characters, which bounds what is broadcast: their terms are the
vocabulary of the index of that block. Every document is counted and every document with one of the terms is indexed.

Defined results: terms are `[0-9A-Za-z]` and everything above ASCII, only A-Z lower-cased; null and empty texts have
none; a query without terms or without matches has no rows; rows of documents with equal ids are ranked each; ids that
are null rank last among equals; query rows of equal ids are separate queries; empty tables give an empty result;
other columns of either table are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import cut, discard, sliced, tidy
from tidewater.llm.decontamination import words

#: Documents of an index block: 64 in each of 32 words.
BLOCK = 2048
_WORDS = BLOCK // 64
#: Queries added up at a time.
TOGETHER = 128


@dataclass
class Queries:
    """A block of queries: ids, numbered terms, and what each query adds up, a term taken c times as c's binary digits."""

    ids: list
    terms: dict[bytes, int]
    query: np.ndarray
    term: np.ndarray
    shift: np.ndarray

    @classmethod
    def of(cls, items: list[tuple]) -> Queries:
        terms: dict[bytes, int] = {}
        parts = []
        for q, (_, text) in enumerate(items):
            for word, times in Counter(words(text)).items():
                t = terms.setdefault(word, len(terms))
                parts += [(q, t, b) for b in range(times.bit_length()) if times >> b & 1]
        query, term, shift = np.array(parts, np.int64).reshape(-1, 3).T
        return cls([item for item, _ in items], terms, query, term, shift)


@dataclass
class Corpus:
    """Counts over all documents: N, L, and the weight of each term."""

    documents: int
    length: int
    weights: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * self.documents) // max(self.length, 1)
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def count_terms(docs: DataFrame, shared: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """`doc`, its number of terms `n`, and the numbers and counts (`terms`, `tfs`) of those that a query holds."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("tfs", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.terms
        for batch in sliced(batches, 4096, text_col):
            sizes, terms, tfs = [], [], []
            for text in batch.column(text_col):
                found = words(text.as_py())
                held = Counter(map(known.get, found))
                held.pop(None, None)
                sizes.append(len(found))
                terms.append(list(held))
                tfs.append(list(held.values()))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(sizes, pa.int64()), *lists], schema.names)

    return docs.select(id_col, text_col).mapInArrow(tidy(run), schema)


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def slice_blocks(counted: DataFrame, corpus: Broadcast) -> DataFrame:
    """The index: a row a block with its `docs`, its `terms` with their number of documents `sizes`, the places of
    those in the block (`offsets`, term by term), and as `slices` one bitmap for each bit of their impacts."""
    schema = T.StructType(
        [
            T.StructField("docs", T.ArrayType(counted.schema["doc"].dataType)),
            *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "sizes", "offsets")],
            T.StructField("slices", T.ArrayType(T.BinaryType())),
        ]
    )

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc", "ascending")])).combine_chunks()
        lists = rows.column("terms").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        place = np.repeat(np.arange(len(rows)), sizes)
        term = lists.flatten().to_numpy().astype(np.int64)
        tf = pc.list_flatten(rows.column("tfs")).to_numpy().astype(np.int64)
        impact = corpus.value.impacts(term, tf, rows.column("n").to_numpy()[place])
        order = np.lexsort((place, term))
        term, place, impact = term[order], place[order], impact[order]
        own, count = np.unique(term, return_counts=True)
        depth = int(impact.max(initial=0)).bit_length()
        slices = [_packed(((impact >> s) & 1).astype(np.uint8)) for s in range(depth)]
        one = [[own.tolist()], [count.tolist()], [place.tolist()]]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column("doc").combine_chunks())]
        arrays += [pa.array(x, pa.list_(pa.int32())) for x in one] + [pa.array([slices], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            while batch.num_rows:
                part = batch.slice(0, BLOCK - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == BLOCK:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield block(pa.Table.from_batches(held))

    return counted.mapInArrow(tidy(run), schema)


class Block:
    """One block of the index, ready to be searched."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, slices: list[bytes]) -> None:
        self.terms, self.ends = terms, np.cumsum(sizes)
        self.starts, self.offsets = self.ends - sizes, offsets
        n = len(offsets)
        self.bits = np.array([np.unpackbits(np.frombuffer(s, np.uint8), count=n, bitorder="little") for s in slices], np.uint8).reshape(len(slices), n)

    def bitmaps(self, rows: np.ndarray) -> np.ndarray:
        """(slice, term, word): the bitmaps of some of the block's terms, over all its documents."""
        sizes = self.ends[rows] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        term, place = np.repeat(np.arange(len(rows)), sizes), self.offsets[at]
        word = term * _WORDS + (place >> 6)
        opens = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros((len(self.bits), len(rows) * _WORDS), np.uint64)
        shift = (place & 63).astype(np.uint64)
        for s, plane in enumerate(self.bits):
            out[s, word[opens]] = np.bitwise_or.reduceat(plane[at].astype(np.uint64) << shift, opens)
        return out.reshape(len(self.bits), len(rows), _WORDS)

    def add(self, query: np.ndarray, term: np.ndarray, shift: np.ndarray, n: int, depth: int) -> np.ndarray:
        """(slice, query, word): the scores of `n` queries; `query`, `term` and `shift` say what each adds up."""
        total = np.zeros((depth, n, _WORDS), np.uint64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        here = self.terms[at] == term
        query, at, shift = query[here], at[here], shift[here]
        if not len(query):
            return total
        rows, at = np.unique(at, return_inverse=True)
        maps = self.bitmaps(rows)
        # the next addend of every query at once; those shifted apart
        order = np.argsort(query, kind="stable")
        first = np.flatnonzero(np.diff(query[order], prepend=-1))
        turn = np.empty(len(query), np.int64)
        turn[order] = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
        groups = np.lexsort((shift, turn))
        edges = np.flatnonzero((np.diff(turn[groups], prepend=-1) != 0) | (np.diff(shift[groups], prepend=-1) != 0))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(groups)], strict=True):
            which = groups[a:b]
            self._add(total, maps, query[which], at[which], int(shift[which[0]]))
        return total

    @staticmethod
    def _add(total: np.ndarray, maps: np.ndarray, query: np.ndarray, at: np.ndarray, shift: int) -> None:
        carry = np.zeros((len(query), _WORDS), np.uint64)
        for s in range(shift, len(total)):
            own = total[s][query]
            if s - shift < len(maps):
                other = maps[s - shift][at]
                half = own ^ other
                total[s][query] = half ^ carry
                carry = (own & other) | (half & carry)
            else:
                total[s][query] = own ^ carry
                carry &= own
                if not carry.any():
                    break


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place and score of the k best documents of each query, from the most significant slice down."""
    among = np.bitwise_or.reduce(total, axis=0)
    sure, need = np.zeros_like(among), np.full(len(among), k, np.int64)
    for plane in total[::-1]:
        hit = among & plane
        count = np.bitwise_count(hit).sum(axis=1, dtype=np.int64)
        many = count > need
        sure |= np.where(many[:, None], 0, hit).astype(np.uint64)
        need -= np.where(many, 0, count)
        among = np.where(many[:, None], hit, among & ~plane)
    spread = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
    tied = spread(among)
    taken = spread(sure) | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= need[:, None]))
    query, place = np.nonzero(taken)
    score = np.zeros(len(query), np.int64)
    for s, plane in enumerate(total):
        score |= ((plane[query, place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << s
    return query, place, score


def _leading(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query."""
    found = found.take(pc.sort_indices(found, sort_keys=[("query", "ascending"), ("score", "descending"), ("doc", "ascending")]))
    query = found.column("query").to_numpy()
    opens = np.flatnonzero(np.diff(query, prepend=-1))
    place = np.arange(len(query)) - np.repeat(opens, np.diff(opens, append=len(query)))
    return found.filter(pa.array(place < k))


def search(index: DataFrame, shared: Broadcast, corpus: Broadcast, k: int) -> DataFrame:
    """`query`, `doc`, `score` of the k best documents of each query in each task's part of the index."""
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("doc", index.schema["docs"].dataType.elementType), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value, corpus.value.weights
        top = np.zeros(len(queries.ids), object)
        np.add.at(top, queries.query, [int(w) * 1_000_000 << int(s) for w, s in zip(weights[queries.term], queries.shift, strict=True)])
        depth = int(max(top, default=0)).bit_length()
        parts = []
        for begin in range(0, len(queries.ids), TOGETHER):
            a, b = np.searchsorted(queries.query, (begin, begin + TOGETHER))
            n = min(TOGETHER, len(queries.ids) - begin)
            parts.append((begin, n, queries.query[a:b] - begin, queries.term[a:b], queries.shift[a:b]))
        held: list[pa.Table] = []
        for batch in sliced(batches, 1):
            own = {c: batch.column(c)[0].values for c in ("docs", "terms", "sizes", "offsets")}
            numbers = [own[c].to_numpy().astype(np.int64) for c in ("terms", "sizes", "offsets")]
            block = Block(*numbers, batch.column("slices")[0].as_py())
            for begin, n, query, term, shift in parts:
                query, place, score = best(block.add(query, term, shift, n, depth), k)
                docs = own["docs"].take(pa.array(place))
                held.append(pa.table({"query": pa.array(query + begin, pa.int32()), "doc": docs, "score": pa.array(score)}))
            if len(held) >= 64:
                held = [_leading(pa.concat_tables(held), k)]
        if held:
            yield from _leading(pa.concat_tables(held), k).select(schema.names).combine_chunks().to_batches()

    return index.mapInArrow(tidy(run), schema)


def _ranked(found: DataFrame, k: int, *by) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_chars: int = 2_000_000,
) -> DataFrame:
    """The k highest-scoring documents of each item with a score above 0: item id, `rank` from 1, document id, `score`."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    out = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else asked
        queries = Queries.of([(r.item, r.text) for r in part.collect()])
        shared = spark.sparkContext.broadcast(queries)
        counted = cut(count_terms(docs, shared, id_col, text_col), "term-counts")
        seen = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("length")).first()
        weights = np.zeros(len(queries.terms), np.int64)
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the queries
            weights[r["term"]] = term_weight(seen.documents, r["count"])
        corpus = spark.sparkContext.broadcast(Corpus(seen.documents, seen.length or 0, weights))
        index = cut(slice_blocks(counted, corpus), "impact-slices")
        discard(counted)
        found = search(index, shared, corpus, k)
        # tasks first, in parts of bounded size, then all
        leading = _ranked(found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))), k, "query", "part").drop("rank", "part")
        names = T.StructType([T.StructField("query", T.IntegerType()), T.StructField(item_col, items.schema[item_col].dataType)])
        ids = spark.createDataFrame(list(enumerate(queries.ids)), names)
        ranked = _ranked(leading, k, "query").join(ids, "query")
        ranked = ranked.select(item_col, F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
