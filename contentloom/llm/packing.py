"""Lexical retrieval packing: sequences filled with documents that share their rarer words.

Documents become token ids once, in a staged table. A first pass over it counts in how many
documents each token occurs, over all documents. The second pass routes: documents are put in order
of their two best tokens (by BM25 weight, of those that another document has as well), so documents
of the same rarer words, wherever they stand in the files, come to lie beside each other. The order
is cut into tasks by ranges; a token that leads many documents spans several. The third pass packs:
the rows of a task are its shards of the index, ``shard_docs`` documents at a time. Whole windows of a long document are
sequences of their own; what is left of each document goes into the shard's inverted index, with
BM25 weights from the counts over all documents. The first unused document seeds a window; the
index gives the unused neighbours of the seed, best first, and they fill the window. A neighbour
that is longer than the room is cut, and the rest of it seeds the next window. A window that a
shard leaves unfilled is the start of the next shard's first one. The last one of a task is cut
into sequences whose sizes are powers of two, so no sequence is padded.

All tokens are indexed. A neighbour is looked for in the seed's shard only, so related documents
whose best tokens differ may still not meet.

A task that is run again gets the same rows in the same order and gives the same sequences. What is sent to tasks is one number for each token of
the vocabulary.

Defined cases: a null or empty text has no ids but the end token. Repeated rows are packed one by
one, each with its own pieces. Null ids are passed through.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from contentloom.llm.tokens import id_type, token_ids
from contentloom.session import stage

K1, B = 1.2, 0.75


def document_counts(spark: SparkSession, tokens: DataFrame, vocabulary: int) -> tuple[np.ndarray, int, int]:
    """In how many rows each token occurs; the number of rows; the number of tokens. A task gives
    at most one row for each token of the vocabulary."""
    dtype = id_type(vocabulary)

    def counted(batches):
        found, rows, total = np.zeros(vocabulary + 2, np.int64), 0, 0
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                terms = np.frombuffer(ids, dtype)
                here = np.zeros(vocabulary + 2, bool)
                here[terms] = True
                found += here
                rows, total = rows + 1, total + len(terms)
        found[vocabulary], found[vocabulary + 1] = rows, total
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "n"])

    sums = tokens.select("ids").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary + 2, np.int64)
    for row in sums.collect():
        counts[row.term] = row.n
    return counts[:vocabulary], int(counts[vocabulary]), int(counts[vocabulary + 1])


def best_tokens(ids: np.ndarray, idf: np.ndarray, found: np.ndarray, mean_length: float) -> tuple[int, int]:
    """The two tokens of the largest BM25 weight that another document has as well; -1 for none."""
    own = np.sort(ids, kind="stable")
    firsts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    n, terms = np.diff(np.append(firsts, len(own))), own[firsts].astype(np.int64)
    shared = found[terms] > 1
    n, terms = n[shared], terms[shared]
    weight = idf[terms] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ids) / mean_length))
    best = [*terms[np.argsort(-weight, kind="stable")[:2]].tolist(), -1, -1]
    return best[0], best[1]


class Shard:
    """BM25 inverted index over some documents, most of its work done in arrays."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        terms, counts, owner = [], [], []
        for at, ids in enumerate(docs):
            own = np.sort(ids, kind="stable")
            firsts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            n = np.diff(np.append(firsts, len(own)))
            kept = idf[own[firsts]] > 0
            terms.append(own[firsts][kept])
            counts.append(n[kept])
            owner.append(np.full(len(terms[-1]), at, np.int32))
        self.terms_of = terms
        term, n, self.size = np.concatenate(terms), np.concatenate(counts), len(docs)
        order = np.argsort(term, kind="stable")
        self.owner = np.concatenate(owner)[order]
        term, n = term[order], n[order]
        length = np.array([len(d) for d in docs])[self.owner] / mean_length
        self.weight = idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * length))
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents by falling score; those without a common word come last, in order."""
        terms = self.terms_of[seed].astype(np.int64)
        start, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.repeat(start - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        scores = np.bincount(self.owner[at], self.weight[at], minlength=self.size)
        free = np.flatnonzero(~used)
        return free[np.argsort(-scores[free], kind="stable")]


class Packer:
    """Fills windows with pieces: (document number, start, length)."""

    def __init__(self, window: int):
        self.window, self.room, self.pieces, self.done = window, window, [], []

    def put(self, doc: int, start: int, length: int) -> int:
        """Take as much as there is room for; returns how much that was."""
        taken = min(length, self.room)
        self.pieces.append((doc, start, taken))
        self.room -= taken
        if not self.room:
            self.done.append(self.pieces)
            self.pieces, self.room = [], self.window
        return taken

    def close(self) -> None:
        """Cut the unfilled window into sequences whose sizes are powers of two."""
        pieces, left = self.pieces[::-1], self.window - self.room
        self.pieces, self.room = [], self.window
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            sequence = []
            while size:
                doc, start, length = pieces.pop()
                taken = min(length, size)
                sequence.append((doc, start, taken))
                if taken < length:
                    pieces.append((doc, start + taken, length - taken))
                size -= taken
            self.done.append(sequence)


def pack_shard(packer: Packer, docs: list[np.ndarray], first: int, idf: np.ndarray, mean_length: float) -> None:
    """Put all of the documents (numbered from ``first``) into windows."""
    whole = [len(d) // packer.window * packer.window for d in docs]
    for at, n in enumerate(whole):
        packer.done += [[(first + at, start, packer.window)] for start in range(0, n, packer.window)]
    tails = [at for at, d in enumerate(docs) if len(d) > whole[at]]
    if not tails:
        return
    index = Shard([docs[at][whole[at] :] for at in tails], idf, mean_length)
    used, next_free = np.zeros(len(tails), bool), 0
    seed, start = None, 0
    while True:
        if seed is None:
            while next_free < len(tails) and used[next_free]:
                next_free += 1
            if next_free == len(tails):
                return
            seed, start = next_free, whole[tails[next_free]]
            used[seed] = True
        room = packer.room
        length = len(docs[tails[seed]]) - start
        packer.put(first + tails[seed], start, length)
        if length >= room:  # the window is full
            seed, start = (seed, start + room) if length > room else (None, 0)
            continue
        rest = None
        for near in index.neighbours(seed, used).tolist():
            at = tails[near]
            used[near] = True
            taken = packer.put(first + at, whole[at], len(docs[at]) - whole[at])
            if packer.room == packer.window:
                if taken < len(docs[at]) - whole[at]:
                    rest = (near, whole[at] + taken)
                break
        seed, start = rest or (None, 0)


def pack(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    window: int = 4096,
    end: int = 2,
    shard_docs: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece: ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, and ``ids`` if asked for."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    dtype = id_type(vocabulary)
    tokens = stage(token_ids(docs, path, end, id_col, text_col), "token-ids")
    found, n_docs, n_tokens = document_counts(spark, tokens, vocabulary)
    idf = np.log(1 + (n_docs - found + 0.5) / (found + 0.5))
    shared = spark.sparkContext.broadcast((idf, found, max(n_tokens / max(n_docs, 1), 1.0)))
    kind = dict(tokens.dtypes)["id"]

    def routed(batches):
        for batch in batches:
            best = [best_tokens(np.frombuffer(ids, dtype), *shared.value) for ids in batch.column(1).to_pylist()]
            routes = [pa.array([b[k] for b in best], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *routes], names=["id", "ids", "first", "second"])

    # The hash parts the documents of one pair of tokens, so a range may end within them.
    order = ["first", "second", F.xxhash64("ids"), "id"]
    in_order = (
        tokens.select("id", "ids")
        .mapInArrow(routed, f"id {kind}, ids binary, first int, second int")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def packed(batches):
        idf, _, mean_length = shared.value
        packer, base, made = Packer(window), TaskContext.get().partitionId() << 32, 0
        kept: dict[int, tuple] = {}  # documents with pieces that are not given out yet
        shard, first = [], 0

        def out(made: int):
            rows, columns = [], [[] for _ in names[1:]]
            for n, sequence in enumerate(packer.done):
                offset = 0
                for doc, start, length in sequence:
                    key, ids = kept[doc]
                    piece = ids[start : start + length].astype("<u4")
                    values = [start, length, zlib.crc32(piece.tobytes()), len(ids), base + made + n, offset]
                    for column, value in zip(columns, values + [piece] * with_ids, strict=True):
                        column.append(value)
                    rows.append(key)
                    offset += length
            made += len(packer.done)
            packer.done = []
            for doc in kept.keys() - {doc for doc, _, _ in packer.pieces}:
                del kept[doc]
            arrays = [pa.array(rows, id_kind)] + [pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names[1:], columns, strict=True)]
            return made, pa.RecordBatch.from_arrays(arrays, names=names)

        def finish():
            for at, row in enumerate(shard):
                kept[first + at] = row
            pack_shard(packer, [ids for _, ids in shard], first, idf, mean_length)

        held, id_kind = 0, None
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.append((key, np.frombuffer(ids, dtype)))
                held += len(ids)
                if len(shard) == shard_docs or held > 16_000_000:
                    finish()
                    made, rows = out(made)
                    yield rows
                    first, shard, held = first + len(shard), [], 0
        if id_kind is not None:
            finish()
            packer.close()
            yield out(made)[1]

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return in_order.select("id", "ids").mapInArrow(packed, schema + (", ids array<int>" if with_ids else ""))
