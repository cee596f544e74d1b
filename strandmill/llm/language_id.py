"""Language identification by rank-order n-gram profiles.

A language's profile lists its most frequent n-grams of 1 to 3 letters in order. A document is
given the language whose profile is nearest to the document's own list by the out-of-place distance:
the sum, over the document's n-grams, of how far their ranks lie apart, an n-gram that the profile
does not have counting as out of place by the profile's length.

Profiles are learned from a bounded sample of labelled rows (``sample_rows`` per language);
every row is judged from its whole text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.common import tidy

PROFILE = 300
SAMPLE_ROWS = 2_000
MAX_LANGUAGES = 1_000
BITS = 21
EDGE = (1 << BITS) - 1  # stands for what surrounds a word; no character has this number
UNDETERMINED = "und"
PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a mark."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])


def ngram_codes(text: str) -> np.ndarray:
    """Codes of the n-grams of 1 to 3 symbols of a text's words, each word between two edges."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    symbols = np.where(letter, points, EDGE).astype(np.int64)
    kept = letter | np.concatenate(([False], letter[:-1]))  # of other characters the first after a word
    symbols = np.concatenate(([EDGE], symbols[kept], [EDGE] if letter[-1] else np.zeros(0, np.int64)))
    single = symbols[symbols != EDGE]
    double = symbols[:-1] | symbols[1:] << BITS
    triple = (double[:-1] | symbols[2:] << 2 * BITS)[symbols[1:-1] != EDGE]
    return np.concatenate((single, double, triple))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their numbers; long texts in pieces cut between words."""
    if len(text) <= PIECE:
        return np.unique(ngram_codes(text), return_counts=True)
    parts, begin = [], 0
    while begin < len(text):
        end = min(begin + PIECE, len(text))
        while end < len(text) and unicodedata.category(text[end])[0] in "LM":
            end += 1
        parts.append(np.unique(ngram_codes(text[begin:end]), return_counts=True))
        begin = end
    codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent codes, of equally frequent ones the smaller first."""
    if len(codes) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:n]


class Profiles:
    """All profiles as one table of ranks: a row per language, a column per known n-gram."""

    def __init__(self, profiles: dict[str, list[int]], length: int):
        self.length, self.languages = length, sorted(profiles)
        self.codes = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()]))
        self.ranks = np.full((len(profiles), len(self.codes)), -1, np.int64)
        for row, language in enumerate(self.languages):
            self.ranks[row, np.searchsorted(self.codes, np.array(profiles[language], np.int64))] = np.arange(len(profiles[language]))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The nearest language (the first by name if several are) and 1 - distance / largest distance."""
        if not any(map(str.isalpha, text or "")):  # marks alone are no letters
            return UNDETERMINED, 0.0
        codes, counts = ngram_counts(text)
        top = ranked(codes, counts, self.length)
        column = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = np.where(self.codes[column] == top, self.ranks[:, column], -1)
        apart = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(apart.argmin())
        return self.languages[best], 1.0 - float(apart[best]) / (len(top) * self.length)


def learn_profiles(
    labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", length: int = PROFILE, sample_rows: int = SAMPLE_ROWS
) -> dict[str, list[int]]:
    """The profiles of the languages of ``labelled``; rows without a language or text are left out.

    Of a language with more than ``sample_rows`` rows about so many are taken, by a hash of
    ``key_col``, so that the sample does not depend on how the rows lie in files.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(key_col).alias("key"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    scale = 1 << 30
    share: Column = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(scale, -(-scale * sample_rows // n)))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(scale)) < share).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list] = {}
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(ngram_counts(text.as_py()))
            for lang, parts in by_lang.items():
                codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    counted = sample.mapInArrow(tidy(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    profiles: dict[str, list[int]] = {}
    for row in counted.withColumn("place", place).where(F.col("place") <= length).orderBy("lang", "place").collect():
        profiles.setdefault(row["lang"], []).append(row["code"])
    return profiles


def identify(documents: DataFrame, profiles: dict[str, list[int]], *, id_col: str = "doc_id", text_col: str = "text", length: int = PROFILE) -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    ``und`` with score 0 for a null text, a text without letters, and where there is no
    profile. The id may be null or repeat; rows are judged one by one. Other columns are not read.
    """
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, length) if profiles else None
        for batch in batches:
            found = [known.judge(text.as_py()) if known else (UNDETERMINED, 0.0) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(tidy(judge), schema)
