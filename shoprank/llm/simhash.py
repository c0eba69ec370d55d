"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A text's words are its lower-cased (A-Z) runs of non-white-space bytes; its features are its word shingles, repeats
included. Bit j of the fingerprint is 1 if bit j of the XXH64 hashes of over half the features is 1.

Covering tables: every bit position gets a non-zero vector of radius + 1 bits, and every such vector v selects the
positions whose vectors have odd inner product with v. For any ``radius`` differing positions some v is orthogonal to
all of their vectors, so the masked fingerprints of a pair within the radius are equal in at least one of the
2 ** (radius + 1) - 1 tables: no pair is missed.

Only distinct fingerprints enter the tables. Keys are dealt by range over (table, key, fingerprint), so a key with very
many fingerprints is spread over partitions. Keys of up to GROUP fingerprints are compared directly. The fingerprints of
larger keys, and of keys at the edge of a partition, are linked exactly by balls instead: two fingerprints are
within the radius if and only if some 64-bit value lies within radius / 2 of both, so each is sent to all values around
it, where only a bounded number can meet (65 for radius 2). No pair within a large key is enumerated.

Nulls and texts without words have fingerprint zero and are linked like any other; a text of fewer words than a shingle
is one feature. Rows without an id take part and carry links, but name no component: the component is the least id
that is reachable, null if there is none. Repeated rows stay repeated. An empty table gives an empty result. Texts are
read in parts of PART bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, with_fields, written
from .components import components

WIDTH = 64
SEED = 42
#: Fingerprints of one key that are compared with each other; larger keys go the way of balls.
GROUP = 32
#: Bytes of one text whose words are held at once.
PART = 1 << 20


def word_parts(text: bytes, part: int = PART) -> Iterator[list[bytes]]:
    """The lower-cased words of ``text`` in order, a part of the text at a time; words are never cut."""
    at, n = 0, len(text)
    while n - at > part:
        end = at + part
        while end < n and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].lower().split()
        at = end
    yield text[at:].lower().split()


def fingerprint(text: bytes, shingle: int = 3) -> bytes:
    """The 8 bytes of the SimHash, most significant first."""
    ones, total = np.zeros(WIDTH, np.int64), 0
    tail: list[bytes] = []
    for words in word_parts(text):
        words = tail + words
        if len(words) >= shingle:
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), ">u8", len(words) - shingle + 1)
            ones += np.unpackbits(h.view(np.uint8)).reshape(-1, WIDTH).sum(0, dtype=np.int64)
            total += len(h)
        tail = words[max(0, len(words) - shingle + 1):]
    if not total and tail:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], ">u8")
        ones, total = np.unpackbits(h.view(np.uint8)).astype(np.int64), 1
    return np.packbits(2 * ones > total).tobytes()


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``df`` without its text, with ``fp`` (the fingerprint as a signed 64-bit number). No shuffle."""
    schema = with_fields(df, "fp long", text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = rows.column(rows.schema.get_field_index(text_col)).cast(pa.large_binary()).to_pylist()
                fps = np.frombuffer(b"".join(fingerprint(t or b"", shingle) for t in texts), ">i8").astype(np.int64)
                keep = [c for n, c in zip(rows.schema.names, rows.columns) if n != text_col]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(fps)], names=schema.names)

    return df.mapInArrow(run, schema)


def masks(radius: int) -> list[int]:
    """The covering family's bit masks."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(WIDTH)]
    return [sum(1 << i for i, u in enumerate(vector) if (u & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(radius: int):
    """Arrow function over (t, key, fp) in order: links (fp, other) of small keys, (fp, null) of the others."""

    def out(fp: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
        b = pa.array(other, pa.int64()) if other is not None else pa.nulls(len(fp), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), b], names=["fp", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(3)]  # the rows of the last key seen
        edge = True  # the held key is the partition's first one, or has been given up as too large
        for batch in batches:
            t, key, fp = (np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns))
            if not len(fp):
                continue
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(np.concatenate([starts, [len(fp)]]))
            apart = sizes > GROUP
            apart[0] |= edge
            if len(starts) == 1:
                edge = bool(apart[0])
            else:
                edge = bool(apart[-1])
            of = np.repeat(np.arange(len(starts)), sizes)
            last = starts[-1]
            give = apart[of]
            give[last:] &= edge
            if give.any():
                yield out(fp[give], None)
            use = np.flatnonzero(~apart[of[:last]])
            f, g = fp[use], of[use]
            most = int(sizes[:-1][~apart[:-1]].max(initial=0))
            for lag in range(1, most):
                near = (g[lag:] == g[:-lag]) & (np.bitwise_count((f[lag:] ^ f[:-lag]).view(np.uint64)) <= radius)
                if near.any():
                    yield out(f[:-lag][near], f[lag:][near])
            rest = slice(len(fp) - 1, None) if edge else slice(last, None)
            held = [t[rest], key[rest], fp[rest]]
            if edge:  # its rows are given; one stays to recognise the key
                held = [x[-1:] for x in held]
        if len(held[2]):
            yield out(held[2], None)

    return run


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, other): links that connect all distinct fingerprints ``fp`` of ``fps`` at ``radius`` or fewer differing bits."""
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("radius must be 2 or 4")
    spark = fps.sparkSession
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                       for t, m in enumerate(masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("k.t", "k.key", "fp")
    keyed = keyed.repartitionByRange("t", "key", "fp").sortWithinPartitions("t", "key", "fp")
    found = written(spark, keyed.mapInArrow(_links(radius), "fp long, other long"), "simhash-links")
    flips = [0] + [_signed(sum(1 << i for i in c)) for k in range(1, radius // 2 + 1) for c in combinations(range(WIDTH), k)]
    around = F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.col("fp").bitwiseXOR(x))
    balls = found.where("other IS NULL").select("fp").distinct().select("fp", F.explode(around).alias("z"))
    met = balls.groupBy("z").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    star = met.select(F.array_min("fps").alias("fp"), F.explode("fps").alias("other")).where("fp <> other")
    return found.where("other IS NOT NULL").unionByName(star).distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``df``."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = written(spark, fingerprints(rows, "text", shingle), "simhash-rows")
    classes = written(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    tied = components(fingerprint_links(classes.select("fp"), radius), "fp", "other")
    tied = written(spark, tied.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "least"), "simhash-tied")
    named = tied.join(tied.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    names = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_covering_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at 2 or fewer differing bits."""
    return simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))
