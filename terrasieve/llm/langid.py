"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Symbols: 0 stands for a run of what is no letter, 1 to 26 for a to z, and
#: any other letter's code point for itself. Trigrams of symbols below
#: N_SYMBOLS are numbered below N_TABLED and tabulated.
N_SYMBOLS = 40
N_TABLED = N_SYMBOLS**3


@dataclass(frozen=True)
class Space:
    """Random letter vectors of +1 and -1, and how n-grams are made of them."""

    dims: int = 1024
    seed: int = 8

    def letters(self) -> np.ndarray:
        return np.random.default_rng(self.seed).choice(np.array([-1, 1], dtype=np.int8), size=(N_SYMBOLS, self.dims))

    def grams(self) -> np.ndarray:
        """A row for each trigram abc: a permuted twice, b permuted once and c,
        bound by their product. The permutation is a turn by one place."""
        one = self.letters()
        first, second = np.roll(one, 2, axis=1), np.roll(one, 1, axis=1)
        pairs = (first[:, None, :] * second[None, :, :]).reshape(N_SYMBOLS**2, self.dims)
        return (pairs[:, None, :] * one[None, :, :]).reshape(N_SYMBOLS**3, self.dims)


class Vectors:
    """Trigram vectors of a space: tabulated where all letters are of a to z,
    else bound on demand from the letters' own seeded vectors."""

    def __init__(self, space: Space):
        self.space, self.table = space, space.grams()
        self.one = dict(enumerate(space.letters()))

    def letter(self, symbol: int) -> np.ndarray:
        if symbol not in self.one:
            bits = np.random.default_rng((self.space.seed, symbol)).integers(0, 2, self.space.dims, dtype=np.int8)
            self.one[symbol] = 2 * bits - 1
        return self.one[symbol]

    def of(self, grams: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(grams >= N_TABLED)
        if not len(at):
            return self.table[grams]
        out = np.empty((len(grams), self.space.dims), dtype=np.int8)
        rest = np.flatnonzero(grams < N_TABLED)
        out[rest] = self.table[grams[rest]]
        abc = (grams[at] - N_TABLED)[None, :] >> np.array([[42], [21], [0]]) & 0x1FFFFF
        found, where = np.unique(abc, return_inverse=True)
        a, b, c = where.reshape(abc.shape)
        one = np.stack([self.letter(int(x)) for x in found])
        out[at] = np.roll(one, 2, axis=1)[a] * np.roll(one, 1, axis=1)[b] * one[c]
        return out


def symbol_table() -> np.ndarray:
    """The symbol of each code point of the Basic Multilingual Plane; code
    points beyond it are looked up by ``_beyond``."""
    table = np.zeros(0x10000, dtype=np.uint32)
    for cp in range(0x10000):
        if chr(cp).isalpha():
            table[cp] = _symbol(cp)
    return table


def _symbol(cp: int) -> int:
    return cp - 96 if 97 <= cp <= 122 else cp


def _beyond(cp: int) -> int:
    return _symbol(cp) if chr(cp).isalpha() else 0


def gram_counts(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of a text and their counts; words are bounded by
    one symbol 0. A text without a letter has none."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = table[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        symbols[i] = _beyond(int(codes[i]))
    if not symbols.any():
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    s = np.concatenate([[0], symbols, [0]]).astype(np.int64)
    s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])]
    if s[-1] > 0:
        s = np.append(s, 0)
    a, b, c = s[:-2], s[1:-1], s[2:]
    grams = (a * N_SYMBOLS + b) * N_SYMBOLS + c
    if (other := np.maximum(np.maximum(a, b), c) >= N_SYMBOLS).any():
        grams = np.where(other, N_TABLED + (a << 42 | b << 21 | c), grams)
    elif len(grams) > 20_000:
        counts = np.bincount(grams, minlength=N_SYMBOLS**3)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(grams, return_counts=True)


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", space: Space = Space()) -> dict[str, np.ndarray]:
    """A prototype vector for each language: the bundle (sum) of the n-gram
    vectors of all its texts, to unit length.

    Each batch adds its trigram counts by language and bundles once; sums of
    the ``dims`` numbers a language are what the shuffle and the driver see.
    Rows without text or language teach nothing.
    """

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, vectors = symbol_table(), Vectors(space)
        totals: dict[str, np.ndarray] = {}
        others: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: Counter[str] = Counter()
        sums: dict[str, np.ndarray] = {}

        def add(name: str, found: np.ndarray, n: np.ndarray) -> None:
            summed = sums.setdefault(name, np.zeros(space.dims))
            for i in range(0, len(found), 4096):
                summed += n[i : i + 4096].astype(np.float64) @ vectors.of(found[i : i + 4096])

        def add_others(name: str) -> None:
            grams, counts = (np.concatenate(x) for x in zip(*others.pop(name)))
            found, at = np.unique(grams, return_inverse=True)
            add(name, found, np.bincount(at, weights=counts))
            waiting[name] = 0

        for batch in batches:
            for name, t in zip(batch["lang"], batch["text"]):
                grams, counts = gram_counts(t, table)
                if not len(grams):
                    continue
                cut = int(np.searchsorted(grams, N_TABLED))  # grams ascend
                total = totals.setdefault(name, np.zeros(N_TABLED, dtype=np.int64))
                total[grams[:cut]] += counts[:cut]
                if cut < len(grams):
                    others.setdefault(name, []).append((grams[cut:], counts[cut:]))
                    waiting[name] += len(grams) - cut
                    if waiting[name] > 200_000:
                        add_others(name)
        for name, total in totals.items():
            found = np.flatnonzero(total)
            add(name, found, total[found])
            if name in others:
                add_others(name)
            yield pd.DataFrame({"lang": name, "dim": np.arange(space.dims, dtype=np.int32), "value": sums[name]})

    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sums = labelled.mapInPandas(bundle, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    by_lang: dict[str, np.ndarray] = {}
    for row in sums.collect():  # dims numbers for each language
        by_lang.setdefault(row["lang"], np.zeros(space.dims))[row["dim"]] = row["value"]
    return {name: v / max(np.linalg.norm(v), 1e-300) for name, v in sorted(by_lang.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", space: Space = Space()) -> DataFrame:
    """Add lang_pred and score: the language whose prototype has the largest
    cosine with the text's vector, and that cosine (0 where it is negative).

    A null text, one without a letter, and any text without prototypes give
    ``und`` and 0. Equal cosines go to the first language by code point.
    Other columns stay; those of the two names are replaced.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, space.dims), dtype=np.float32)

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, vectors = symbol_table(), Vectors(space)
        for batch in batches:
            langs, scores = [], []
            for t in batch:
                grams, counts = gram_counts(t or "", table)
                if not len(grams) or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                vector = np.zeros(space.dims, dtype=np.float32)
                for i in range(0, len(grams), 512):
                    vector += counts[i : i + 512].astype(np.float32) @ vectors.of(grams[i : i + 512]).astype(np.float32)
                cosines = matrix @ vector / max(float(np.linalg.norm(vector)), 1e-30)
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    found = F.pandas_udf(work, "lang_pred string, score double")
    out = docs.withColumn("_found", found(F.col(text)))
    return out.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those not held out."""
    held = F.coalesce(common.crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text", "lang")
    prototypes = profiles(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")
