"""Phrase collocations counted over a prefix-free parse.

Texts are lower-cased (A-Z) and split at ``. , ; : ! ?`` and U+000A to U+000D into pieces, pieces at U+0020 and U+0009 into
words; everything is counted per language (null: ``und``).

Parse: a window of max_words - 1 words whose hash is 0 mod TRIGGER ends a chunk and begins the next one, so that
neighbouring chunks overlap by the window and equal stretches of text are cut alike. Pieces of up to SHORT words, and
the rest of any piece, are chunks that end with a line feed. The distinct chunks with their frequencies are the dictionary: texts
are read once, all counting is done on distinct chunks weighted by frequency. A phrase that lies in the overlap at the
end of a chunk is counted in the next chunk only, so each occurrence counts once. A chunk is cut after LONGEST words
at the latest, which leaves the counts exact.

Counts grow a word at a time: phrases of k words are counted only where both of their parts of k - 1 words
occur ``least`` times (which every frequent phrase's parts do). Tasks know the frequent parts by a table of bits that is
bounded in size (SLOTS); a shared slot lets a rare phrase through to the exact count, nothing is lost.

Phrases are compared word by word and by UTF-8 bytes; products are decimals (exact up to 10**16 occurrences). Null and
empty texts have no words; repeated rows count each; a table without a frequent phrase gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, ragged, span_hasher, span_hashes, table, text_blocks, tidied, word_spans, written

#: One window of TRIGGER ends a chunk, in pieces of more than SHORT words.
TRIGGER = 16
SHORT = 8
LONGEST = 4096
#: Most slots of the table of frequent parts (one bit each when sent, one byte each in a task).
SLOTS = 1 << 25
#: Different chunks that a task sums up before it sends them.
HELD = 150_000
#: Bytes of chunks whose phrases a task sums up before it sends them.
BLOCK = 2 << 20
#: Parts in which a language's phrases are ranked before the last ranking.
PARTS = 8
#: Bytes of text that are split at once.
PART = 1 << 20

_SPLIT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")


def parsed(words: list[bytes], window: int, done: bool = True) -> tuple[list[bytes], list[bytes]]:
    """The chunks of a piece, and the words of the unfinished one (of a piece that is not ``done``)."""
    if done and len(words) <= SHORT:
        return ([b" ".join(words) + b"\n"] if words else []), []
    chunks, begin = [], 0
    for end in range(window + 1, len(words)):
        # words[end - window:end] is a window with a word after it
        if end - begin > window and (not xxhash.xxh3_64_intdigest(b" ".join(words[end - window:end])) % TRIGGER or end - begin >= LONGEST):
            chunks.append(b" ".join(words[begin:end]))
            begin = end - window
    if done:
        return [*chunks, b" ".join(words[begin:]) + b"\n"], []
    return chunks, words[begin:]


def _pieces(text: bytes, window: int) -> Iterator[tuple[bytes, int]]:
    """(chunk, count) of a text of more than PART bytes, a part at a time."""
    at, n, open_words = 0, len(text), []
    while at < n:
        end = min(at + PART, n)
        while end < n and text[end] not in b" \t.,;:!?\n\v\f\r":
            end += 1
        pieces = text[at:end].translate(_SPLIT).split(b"\n")
        for k, piece in enumerate(pieces):
            done = k < len(pieces) - 1 or end == n
            whole, open_words = parsed(open_words + piece.split(), window, done)
            yield from ((c, 1) for c in whole)
        at = end


def chunk_counts(df: DataFrame, text_col: str, lang_col: str, window: int) -> DataFrame:
    """The dictionary (lang, chunk, f, words): distinct chunks, how often each occurs and how many words it owns."""

    def out(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                                                  pa.array(list(counts.values()), pa.int64())], names=["lang", "chunk", "f"])
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw: dict[str, Counter] = {}
                for text, lang in zip(part.column(0).cast(pa.large_binary()), part.column(1).to_pylist()):
                    text = text.as_py() or b""
                    lang = "und" if lang is None else lang
                    if len(text) <= PART:
                        raw.setdefault(lang, Counter()).update(text.translate(_SPLIT).split(b"\n"))
                        continue
                    sums = held.setdefault(lang, Counter())
                    for chunk, f in _pieces(text, window):
                        sums[chunk] += f
                        if len(sums) > HELD:
                            yield from out({lang: sums.copy()})
                            sums.clear()
                for lang, pieces in raw.items():
                    sums = held.setdefault(lang, Counter())
                    for piece, f in pieces.items():
                        for chunk in parsed(piece.split(), window)[0]:
                            sums[chunk] += f
                if sum(map(len, held.values())) > HELD:
                    yield from out(held)
        yield from out(held)

    rows = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    sums = rows.mapInArrow(tidied(run), "lang string, chunk string, f long").groupBy("lang", "chunk").agg(F.sum("f").alias("f"))
    own = F.size(F.split(F.rtrim("chunk", F.lit("\n")), " ")) - F.when(F.col("chunk").endswith("\n"), 0).otherwise(window)
    return written(df.sparkSession, sums.withColumn("words", own.cast("long")), "phrase-chunks")


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            held.append(part)
            n += part.nbytes
            if n > size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def phrase_counts(chunks: DataFrame, k: int, window: int, frequent: bytes | None) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``k`` words; ``frequent``: packed bits of slots that their parts may have."""
    shared = chunks.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool) if shared.value else np.ones(1, bool)
        mask = np.uint64(len(slots) - 1)
        for batch in _gathered(batches, BLOCK):
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy()
            f = batch.column(2).to_numpy()
            for lo, hi, data, offs in text_blocks(batch, "chunk", 2 * BLOCK):
                starts, ends, row = word_spans(data, offs)
                n = len(starts) - k + 1
                if n <= 0:
                    continue
                hashes = span_hasher(data)
                after = np.full(len(starts), -1)  # the row of the word that stands ``window`` words on
                after[:len(starts) - window] = row[window:]
                own = (row[:n] == row[k - 1:]) & ((data[offs[1:] - 1] == 10)[row[:n]] | (after[:n] == row[:n]))
                if k > 1:
                    good = slots[hashes(starts[:n + 1], ends[k - 2:k - 1 + n]) & mask]
                    own &= good[:-1] & good[1:]
                at = np.flatnonzero(own)
                if not len(at):
                    continue
                key = hashes(starts[at], ends[at + k - 1]) + mix64(code[lo:hi][row[at]].astype(np.uint64))
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
                one = at[order[cuts]]
                size = ends[one + k - 1] - starts[one]
                ends_of = np.zeros(len(one) + 1, np.int32)
                np.cumsum(size, out=ends_of[1:])
                phrase = pa.StringArray.from_buffers(len(one), pa.py_buffer(ends_of), pa.py_buffer(data[ragged(starts[one], size)]))
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(code[lo:hi][row[one]])), phrase, pa.array(np.add.reduceat(f[lo:hi][row[at[order]]], cuts))],
                    names=["lang", "phrase", "f"])

    rows = chunks.select("lang", "chunk", "f").mapInArrow(tidied(run), "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_slots(frequent: DataFrame) -> bytes:
    """Bits of the slots of all phrases of ``frequent``, packed; at most SLOTS bits reach the driver."""
    size = min(SLOTS, 1 << max(10, int(16 * frequent.count()).bit_length()))
    page = min(size, 1 << 18)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in text_blocks(batch, "phrase"):
                at = np.unique(span_hashes(data, offs[:-1], offs[1:]) & np.uint64(size - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at // page).astype(np.int32)), pa.array((at % page).astype(np.int32))], names=["page", "bit"])

    def pack(group: pa.Table) -> pa.Table:
        bits = np.zeros(page, np.uint8)
        bits[group.column("bit").to_numpy()] = 1
        return pa.table({"page": group.column("page").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = bytearray(size // 8)
    rows = frequent.select("phrase").mapInArrow(tidied(slots), "page int, bit int").distinct()
    for row in rows.groupBy("page").applyInArrow(pack, "page int, bits binary").toLocalIterator():
        out[row.page * page // 8:(row.page + 1) * page // 8] = row.bits
    return bytes(out)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, least: int = 10, top: int = 2000,
                 cover: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``max_words`` words that occur ``least`` times.

    score: the lowest floor(10**6 * a * a / (l * r)) over the phrase's cuts into two parts that occur l and r times. Phrases of
    which a longer frequent phrase that holds them has ``cover`` per cent of the occurrences are left out.
    """
    spark = df.sparkSession
    window = max_words - 1
    chunks = chunk_counts(df, text_col, lang_col, window)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("f") * F.col("words")).alias("n"))
    levels: list[DataFrame] = []
    for k in range(1, max_words + 1):
        bits = frequent_slots(levels[-1]) if levels else None
        counted = phrase_counts(chunks, k, window, bits).where(F.col("f") >= least)
        levels.append(written(spark, counted, f"phrases-{k}"))

    scored = None
    for k in range(2, max_words + 1):
        words = F.split("phrase", " ")
        rows = levels[k - 1].select("lang", "phrase", F.col("f").alias("a"))
        cuts = []
        for cut in range(1, k):
            head = levels[cut - 1].select("lang", F.col("phrase").alias(f"head{cut}"), F.col("f").alias(f"l{cut}"))
            tail = levels[k - cut - 1].select("lang", F.col("phrase").alias(f"tail{cut}"), F.col("f").alias(f"r{cut}"))
            rows = rows.withColumn(f"head{cut}", F.array_join(F.slice(words, 1, cut), " ")).join(head, ["lang", f"head{cut}"])
            rows = rows.withColumn(f"tail{cut}", F.array_join(F.slice(words, cut + 1, k - cut), " ")).join(tail, ["lang", f"tail{cut}"])
            value = f"1000000 * CAST(a AS DECIMAL(16)) * CAST(a AS DECIMAL(16)) DIV (CAST(l{cut} AS DECIMAL(16)) * CAST(r{cut} AS DECIMAL(16)))"
            cuts.append(F.struct(F.expr(value).alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
        best = F.array_min(F.array(*cuts))
        rows = rows.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
        for longer in range(k + 1, max_words + 1):
            parts = F.split("phrase", " ")
            inside = F.array(*[F.array_join(F.slice(parts, i + 1, k), " ") for i in range(longer - k + 1)])
            over = levels[longer - 1].select("lang", F.explode(inside).alias("phrase"), F.col("f").alias("over"))
            over = over.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
            rows = rows.join(over, ["lang", "phrase"], "left").where(f"over IS NULL OR 100 * over < {cover} * a").drop("over")
        scored = rows if scored is None else scored.unionByName(rows)
    scored = written(spark, scored, "phrases-scored")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    ranked = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)  # a language's best come from PARTS parts
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two or three words of every language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3)) AS ks(k))
  GROUP BY ALL),
totals AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, h.f AS l, t.f AS r, cut, (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) AS c
  JOIN grams AS h ON h.lang = c.lang AND h.k = cut AND h.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN grams AS t ON t.lang = c.lang AND t.k = c.k - cut AND t.phrase = array_to_string(c.w[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
covered AS (
  SELECT lang, phrase, max(f) AS over FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a AS f FROM cand WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best AS b LEFT JOIN covered AS c ON b.k = 2 AND c.lang = b.lang AND c.phrase = b.phrase
  WHERE c.over IS NULL OR 100 * c.over < 50 * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
