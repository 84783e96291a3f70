"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. A letter n-gram is the elementwise product of
its letters' vectors, each rotated by its place. A text is the sum of its n-grams, a language the sum of its texts;
a text gets the language whose sum has the largest cosine with its own.

Sums are taken n-gram by n-gram: a batch's distinct n-grams are bound once, and one matrix product with the counts
gives the vectors of all its texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions of a vector and letters of an n-gram.
DIMENSIONS, ORDER = 1024, 3
#: Code points and texts that are counted at a time, about; the count matrix is texts by distinct n-grams.
BATCH_CHARS, BATCH_TEXTS = 1_000_000, 256


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    is_letter = np.zeros(0x110000, dtype=bool)
    is_letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return is_letter


@functools.lru_cache(maxsize=65_536)
def _vector(code: int, place: int) -> np.ndarray:
    """The vector of a letter (0: anything else) at a place of an n-gram."""
    bits = np.random.Generator(np.random.PCG64(code)).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return np.roll(bits * np.int8(2) - np.int8(1), place)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts of texts by distinct n-grams, the n-grams' letters). A run without letters counts as one gap."""
    texts = [t.lower() for t in texts]
    joint = "\n\n\n".join(["", *texts, ""])
    codes = np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = 3 + np.concatenate(([0], np.cumsum([len(t) + 3 for t in texts])[:-1])).astype(np.int64)
    codes = np.where(_letters()[codes], codes, 0)
    text_of = np.zeros(len(codes), dtype=np.int32)
    text_of[starts] = 1
    text_of = np.maximum(np.cumsum(text_of, dtype=np.int32) - 1, 0)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    # Texts are parted by a gap of their own, which belongs to the text before it.
    codes, text_of = codes[keep], text_of[keep]
    alphabet, ids = _renumber(codes)
    size = len(alphabet)
    n = len(ids) - ORDER + 1
    if n <= 0:
        return np.zeros((len(texts), 0), np.float32), np.zeros((0, ORDER), np.uint32)
    gram = np.zeros(n, dtype=np.int64)
    for place in range(ORDER):
        gram = gram * size + ids[place : place + n]
    # The n-gram lies in the text of its middle; one with two gaps spans two texts or has no pair of letters.
    owner, middle = text_of[1 : n + 1], codes[1 : n + 1] != 0
    gram, owner = gram[middle], owner[middle]
    distinct, gram = _renumber(gram, size**ORDER)
    counts = np.bincount(owner.astype(np.int64) * len(distinct) + gram, minlength=len(texts) * len(distinct))
    places = [alphabet[distinct // size ** (ORDER - 1 - place) % size] for place in range(ORDER)]
    return counts.reshape(len(texts), len(distinct)).astype(np.float32), np.stack(places, axis=1)


def _renumber(values: np.ndarray, limit: int = 0x110000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's place among them; a table where it is small, else a sort."""
    if limit > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(limit, dtype=bool)
    seen[values] = True
    distinct = np.flatnonzero(seen)
    table = np.zeros(limit, dtype=np.int64)
    table[distinct] = np.arange(len(distinct))
    return distinct, table[values]


def _bound(grams: np.ndarray) -> np.ndarray:
    """The vectors of n-grams."""
    out = np.ones((len(grams), DIMENSIONS), dtype=np.float32)
    for place in range(ORDER):
        distinct, at = np.unique(grams[:, place], return_inverse=True)
        if len(distinct):
            out *= np.stack([_vector(int(c), place) for c in distinct])[at]
    return out


def _pieces(texts: Iterator[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= BATCH_CHARS or len(held) >= BATCH_TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The sum vector of every language, over all rows with a language and a text.

    The driver receives one vector of ``DIMENSIONS`` numbers for each language, and nothing that grows with the rows.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for piece in _pieces(iter(texts)):
                counts, grams = _grams(piece)
                names = np.array(langs[at : at + len(piece)], dtype=object)
                at += len(piece)
                bound = _bound(grams)
                for lang in set(names):
                    part = counts[names == lang].sum(axis=0, dtype=np.float64) @ bound
                    total[lang] = total.get(lang, 0) + part
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * DIMENSIONS, pa.string()),
                    pa.array(np.arange(DIMENSIONS, dtype=np.int32)),
                    pa.array(np.rint(vector).astype(np.int64)),
                ],
                ["lang", "place", "value"],
            )

    taught = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    rows = (
        taught.mapInArrow(sums, "lang string, place int, value bigint")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    out = {}
    for lang, part in rows.sort_values("place").groupby("lang", sort=True):
        vector = part["value"].to_numpy(dtype=np.float64)
        if vector.any():
            out[str(lang)] = vector
    return out


def identify(text: Column, known: dict[str, np.ndarray]) -> Column:
    """struct(lang, score): the language with the largest cosine, ties by name, and the cosine (0 if negative).

    ``und`` with score 0 for a null text, one without letters, or if no language is known.
    """
    names = sorted(known)
    matrix = np.stack([known[n] / np.linalg.norm(known[n]) for n in names]) if names else np.zeros((0, DIMENSIONS))
    matrix = matrix.astype(np.float32)

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for piece in _pieces(iter(batch)):
                counts, grams = _grams(piece)
                vectors = counts @ _bound(grams)
                norms = np.linalg.norm(vectors, axis=1)
                none = (norms == 0) | (not names)
                likeness = vectors @ matrix.T / np.where(norms == 0, 1, norms)[:, None] if names else vectors[:, :1]
                best = likeness.argmax(axis=1)
                langs += [("und" if n else names[b]) for n, b in zip(none, best, strict=True)]
                scores += np.where(none, 0.0, np.clip(likeness.max(axis=1), 0.0, 1.0)).tolist()
            yield pd.DataFrame({"lang": langs, "score": scores})

    return of(F.coalesce(text, F.lit("")))


def op6_hyperdimensional_language(docs: DataFrame) -> DataFrame:
    """The digest of the contract: taught by the documents whose id's checksum leaves 0 or 2 modulo 3.

    A null id has no checksum: its row is not held out, and does not teach. Repeated rows are rows like any other.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    known = profiles(docs.filter(remainder != 1))
    said = identify(F.col("text"), known)
    return docs.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), said.alias("said")).select(
        "doc_id", "held_out", F.col("said.lang").alias("lang_pred"), F.col("said.score").alias("score")
    )
