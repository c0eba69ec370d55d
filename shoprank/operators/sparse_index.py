"""Exact sparse cosine top-n over an inverted index with per-block upper bounds.

Texts are token counts; the score is the cosine of the counts. The index is cut into shards of documents by a hash of
the id. A shard holds, per token, its documents in order with their counts, in blocks of BLOCK documents, each with the
greatest weight (count / norm) in it; a token that most documents hold is so spread over all shards and over many blocks.

A question meets every shard (:mod:`shoprank.operators.tile_join`), never the pairs of a token. Within a shard, with the n-th
best score found so far as threshold (max-score):

1. the question's tokens are ordered by the most they can add; the leading ones that together stay below the threshold
   bring no document of their own;
2. the documents of the other tokens are summed up;
3. the leading tokens are looked up for these documents only, block by block, and only while a document with all that
   is still to come, by the bounds of its blocks, reaches the threshold.

Dot products and squared norms are integers, so scores are the same in any order. Documents that share no token
with a question are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import TOKEN_SPLIT
from ..session import scratch_table
from .tile_join import from_blob, pack, tile_join, to_blob

BLOCK = 128
#: Postings that a shard is meant to hold.
SHARD_POSTINGS = 400_000
#: What double rounding may add to a bound.
SLACK = 1e-9


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, token, tf``: runs of letters and digits of the lower-cased whole texts, counted before the shuffle."""
    tokens = df.select(key, F.explode(F.split(F.lower(F.col(text)), TOKEN_SPLIT)).alias("token")).where(F.length("token") > 0)
    return tokens.groupBy(key, "token").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def build_index(products: DataFrame, id_col: str = "product_id", text_col: str = "text") -> DataFrame:
    """The shards as a written table ``tile, n, blob``: one row a shard."""
    spark = products.sparkSession
    rows = products.select(F.col(id_col).cast("long").alias("product_id"), F.col(text_col).alias("text")).where("product_id IS NOT NULL")
    counts = scratch_table(spark, token_counts(rows, "product_id", "text"), "postings")
    shards = max(1, -(-counts.count() // SHARD_POSTINGS))
    counts = counts.withColumn("tile", F.pmod(F.xxhash64("product_id"), F.lit(shards)).cast("int"))
    return scratch_table(spark, counts.groupBy("tile").applyInArrow(_shard, "tile int, n int, blob binary"), "sparse-index")


def _shard(t: pa.Table) -> pa.Table:
    ids, doc = np.unique(t.column("product_id").to_numpy(), return_inverse=True)
    tf = t.column("tf").to_numpy().astype(np.int64)
    square = np.zeros(len(ids), np.int64)
    np.add.at(square, doc, tf * tf)
    token = t.column("token").combine_chunks().dictionary_encode()
    code = token.indices.to_numpy()
    order = np.lexsort((doc, code))
    doc, tf, code = doc[order], tf[order], code[order]
    weight = tf / np.sqrt(square)[doc]
    first = np.searchsorted(code, np.arange(len(token.dictionary)))
    place = np.arange(len(code)) - first[code]
    heads = np.flatnonzero(place % BLOCK == 0)
    inner = pa.table({"docs": pa.array(np.split(doc.astype(np.int32), heads[1:]), pa.list_(pa.int32())), "tfs": pa.array(np.split(tf.astype(np.int32), heads[1:]), pa.list_(pa.int32())),
                      "token": token.dictionary.take(pa.array(code[heads])), "most": pa.array(np.maximum.reduceat(weight, heads))})
    owners = pa.table({"id": pa.array(ids), "square": pa.array(square)})
    both = pa.table({"part": pa.array([to_blob(inner), to_blob(owners)], pa.binary())})
    return pa.table({"tile": t["tile"].slice(0, 1), "n": pa.array([len(ids)], pa.int32()), "blob": pa.array([to_blob(both)], pa.binary())})


class Shard:
    """The postings of one shard: per token its range of blocks, per block its first document and bound."""

    def __init__(self, table: pa.Table):
        inner, owners = (from_blob(b) for b in table.column("part").to_pylist())
        self.ids, square = (owners.column(c).to_numpy() for c in ("id", "square"))
        self.norm = np.sqrt(square.astype(np.float64))
        docs = inner.column("docs").combine_chunks()
        self.docs = docs.flatten().to_numpy()
        self.tfs = inner.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(docs.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.most = inner.column("most").to_numpy()
        self.first_doc = self.docs[self.at[:-1]] if len(self.docs) else self.docs
        self.blocks: dict[str, tuple[int, int]] = {}
        tokens = inner.column("token").to_pylist()
        begin = 0
        for i in range(1, len(tokens) + 1):
            if i == len(tokens) or tokens[i] != tokens[begin]:
                self.blocks[tokens[begin]] = (begin, i)
                begin = i

    def best(self, terms: list[str], tfs: list[int], n: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(document, score * question norm, postings read) of the documents that can be among the ``n`` best; ``least``: a score to be reached."""
        found = sorted((self.most[slice(*self.blocks[t])].max() * tf, *self.blocks[t], tf) for t, tf in zip(terms, tfs) if t in self.blocks)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0), 0
        reach = np.cumsum([x[0] for x in found])
        lead = int(np.searchsorted(reach, least - SLACK))  # tokens 0 .. lead-1 together stay below ``least``
        if lead == len(found):
            return np.zeros(0, np.int64), np.zeros(0), 0
        dot = np.zeros(len(self.ids), np.int64)
        read = 0
        for _, a, b, tf in found[lead:]:
            z = slice(self.at[a], self.at[b])
            dot[self.docs[z]] += self.tfs[z] * tf
            read += z.stop - z.start
        doc = np.flatnonzero(dot)
        for k in range(lead - 1, -1, -1):
            _, a, b, tf = found[k]
            below = reach[k - 1] if k else 0.0
            block = np.searchsorted(self.first_doc[a:b], doc, side="right") - 1 + a
            bound = np.where(block >= a, self.most[np.maximum(block, a)], 0.0) * tf
            alive = dot[doc] / self.norm[doc] + bound + below >= least - SLACK
            doc, block = doc[alive], block[alive]
            for x in np.unique(block[block >= a]).tolist():
                z = slice(self.at[x], self.at[x + 1])
                mine = doc[block == x]
                own = self.docs[z]
                place = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                hit = own[place] == mine
                dot[mine[hit]] += self.tfs[z][place[hit]] * tf
                read += len(own)
        return doc, dot[doc], read


def _score(pairs) -> Iterator[pa.RecordBatch]:
    bound: dict[int, np.ndarray] = {}  # per question the n best scores met so far in this partition
    last, shard = None, None
    for _, questions, rt, blob in pairs:
        if rt != last:
            last, shard = rt, Shard(blob)
        out: list[list] = [[], [], [], [], []]
        for qid, n, terms, tfs, square in zip(*(questions.column(c).to_pylist() for c in ("query_id", "n", "terms", "tfs", "square"))):
            norm = float(np.sqrt(square))
            have = bound.get(qid, np.zeros(0))
            least = float(have.min()) if len(have) >= n else 0.0
            doc, dot, read = shard.best(terms, tfs, n, least * norm)
            score = dot / (norm * shard.norm[doc])
            if len(doc) > n:
                order = np.lexsort((shard.ids[doc], -score))[:n]
                doc, score = doc[order], score[order]
            have = np.concatenate([have, score])
            bound[qid] = np.partition(have, len(have) - n)[len(have) - n:] if len(have) > n else have
            out[0].append(np.full(len(doc), qid))
            out[1].append(np.full(len(doc), n))
            out[2].append(shard.ids[doc])
            out[3].append(score)
            out[4].append(np.concatenate([[read], np.zeros(max(0, len(doc) - 1), np.int64)])[:len(doc)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1]).astype(np.int32)), pa.array(np.concatenate(out[2])),
                                          pa.array(np.concatenate(out[3])), pa.array(np.concatenate(out[4]))], names=["query_id", "n", "product_id", "score", "read"])


def search_index(questions: DataFrame, index: DataFrame, question_rows: int = 512) -> DataFrame:
    """``query_id, product_id, rank, score``: each question's ``n`` best documents (``questions``: ``query_id, text, n``).

    Equal texts are searched once, for the least id that asks them with the same n.
    """
    spark = questions.sparkSession
    asked = scratch_table(spark, questions.select("query_id", "text", F.col("n").cast("int").alias("n")).where("query_id IS NOT NULL"), "sparse-asked")
    distinct = scratch_table(spark, asked.groupBy("text", "n").agg(F.min("query_id").alias("rep")), "sparse-distinct")
    counts = token_counts(distinct, "rep", "text").groupBy("rep").agg(
        F.collect_list(F.struct("token", "tf")).alias("t"), F.sum(F.col("tf").cast("long") * F.col("tf")).alias("square"))
    rows = counts.join(distinct, "rep").select(F.col("rep").alias("query_id"), "n", F.col("t.token").alias("terms"), F.col("t.tf").alias("tfs"), "square")
    packed = scratch_table(spark, pack(rows, question_rows), "sparse-questions")
    found = tile_join(packed, index, _score, "query_id long, n int, product_id long, score double, read long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "product_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("n")).select(F.col("query_id").alias("rep"), "product_id", "rank", "score")
    return asked.join(distinct, ["text", "n"]).select("query_id", "rep").join(best, "rep").drop("rep")
