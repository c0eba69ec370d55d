"""Text encoders as plug-ins, run once for every distinct (encoder, text).

An :class:`Encoder` names a factory that loads a model on a Python worker; :func:`encode_distinct` removes repeated
pairs before any model sees them and runs all encoders in one stage. The hashing encoders stand in for trained
models: token counts in ``dim`` buckets, another bucket layout per encoder name, exact small integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import TOKEN_SPLIT

#: Texts that a model gets at once.
BATCH = 256
#: Models of this Python worker, by encoder.
_LOADED: dict[Encoder, Callable] = {}


@dataclass(frozen=True)
class Encoder:
    """``factory`` makes a function from a list of texts to one vector of ``dim`` numbers each."""

    name: str
    dim: int
    factory: Callable[[], Callable[[list[str]], Iterable]]


@dataclass(frozen=True)
class _Hashing:
    name: str
    dim: int

    def __call__(self) -> Callable[[list[str]], np.ndarray]:
        import regex

        split = regex.compile(TOKEN_SPLIT)
        buckets: dict[str, int] = {}

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dim), np.float32)
            for row, text in zip(out, texts):
                for token in split.split(text.lower()):
                    if token:
                        at = buckets.get(token)
                        if at is None:
                            if len(buckets) > 100_000:
                                buckets.clear()
                            at = buckets[token] = int(hashlib.md5(f"{self.name}:{token}".encode()).hexdigest()[:6], 16) % self.dim
                        row[at] += 1
            return out

        return encode


def hashing_encoder(name: str, dim: int) -> Encoder:
    """bucket of a token = first 24 bits of md5("<name>:<token>") mod ``dim``; vector = counts per bucket."""
    return Encoder(name, dim, _Hashing(name, dim))


def encode_distinct(pairs: DataFrame, encoders: Iterable[Encoder]) -> DataFrame:
    """``encoder, text, vec ARRAY<FLOAT>`` for every distinct pair of ``pairs`` (``encoder, text``).

    NULL texts and encoders that are not listed give no row. The one exchange is that of the distinct pairs; a model
    is loaded once per Python worker and sees at most BATCH texts at a time.
    """
    known = {e.name: e for e in encoders}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(names)):
                encoder = known[name]
                model = _LOADED.get(encoder)
                if model is None:
                    model = _LOADED[encoder] = encoder.factory()
                own = [t for n, t in zip(names, texts) if n == name]
                for at in range(0, len(own), BATCH):
                    part = own[at:at + BATCH]
                    vecs = np.asarray(list(model(part)), np.float32)
                    if vecs.shape != (len(part), encoder.dim):
                        raise ValueError(f"encoder {name} returned vectors of the wrong shape")
                    offs = pa.array(np.arange(0, vecs.size + 1, encoder.dim, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part, pa.string()),
                                                      pa.ListArray.from_arrays(offs, pa.array(vecs.ravel()))], names=["encoder", "text", "vec"])

    wanted = pairs.select("encoder", "text").where(F.col("text").isNotNull() & F.col("encoder").isin(*known)).distinct()
    return wanted.mapInArrow(run, "encoder string, text string, vec array<float>")
