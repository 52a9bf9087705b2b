"""Language identification by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent character n-grams over every
training document. A document is ranked the same way, and its out-of-place distance to a
profile is the sum over its n-grams of how far each stands from its rank there, with the
largest possible value where the profile lacks it.

N-grams are those of lower-cased letter runs with a mark at either end, up to three
characters, as 18-bit hashes. They are computed for a whole text at a time from its code
points: everything but letters becomes the mark, and a gram that has a mark inside is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, keep_rows, letters, slices

PROFILE, BITS = 400, 18
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_MIX = np.uint32(0x27D4EB2F)


def grams(text: str) -> np.ndarray:
    """Numbers of all n-grams of a text, repeats included."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    code = np.where(letters()[code], code, np.uint32(0))
    one, two, three = _FACTORS
    a, b, c = code[:-2], code[1:-1], code[2:]
    middle = b != 0
    first = (code * one)[1:-1][middle]
    pair = (code[:-1] * two + code[1:] + _MIX) * one
    pair = pair[(code[:-1] != 0) | (code[1:] != 0)]
    triple = (((a * three + b) * two + c + _MIX + _MIX) * one)[middle]
    return (np.concatenate((first, pair, triple)) >> np.uint32(32 - BITS)).astype(np.int32)


def _ranked(found: np.ndarray, most: int) -> np.ndarray:
    """The most frequent numbers, ties by the smaller number."""
    ids, counts = np.unique(found, return_counts=True)
    key = (counts.astype(np.int64) << (BITS + 1)) | ((1 << BITS) - 1 - ids)
    if len(key) > most:
        key = np.partition(key, len(key) - most)[-most:]
    return (1 << BITS) - 1 - (np.sort(key)[::-1] & ((1 << BITS) - 1))


def train_profiles(docs: DataFrame, profile: int = PROFILE) -> dict[str, list[int]]:
    """``docs(text, lang)`` -> language -> its n-grams by rank, counted over all rows.

    Rows with a null text or lang are left out, repeated rows count as often, and an empty table
    has no languages. What comes to the driver is ``profile`` numbers for each language.
    """

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for b in slices(batches):
            texts: dict[str, list[str]] = {}
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                total = totals.setdefault(lang, np.zeros(1 << BITS, np.int64))
                total += np.bincount(grams(" ".join(some)), minlength=1 << BITS)
        for lang, total in totals.items():
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["lang", "gram", "n"])

    counted = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, gram int, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile)
    profiles: dict[str, list[int]] = {}
    for row in sorted(best.select("lang", "rank", "gram").collect()):
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


def _predictor(profiles: dict[str, list[int]], profile: int):
    """text -> (language, score) by the smallest out-of-place distance."""
    langs = sorted(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p} | {1 << BITS}), np.int64)
    ranks = np.full((len(langs), len(known)), -1, np.int32)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(text: str | None) -> tuple[str, float]:
        own = grams(text or "")
        if not len(own) or not langs:
            return "und", 0.0
        own = _ranked(own, profile)
        at = np.searchsorted(known, own)
        there = ranks[:, np.where(known[at] == own, at, len(known) - 1)]
        away = np.where(there >= 0, np.abs(there - np.arange(len(own))), profile).sum(axis=1)
        best = int(away.argmin())
        return langs[best], 1.0 - float(away[best]) / (profile * len(own))

    return predict


def identify(docs: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` plus, under ``names``, the language and its score.

    score is 1 less the out-of-place distance as a share of the largest possible. ``und``,
    score 0: text null or without a letter, or no profile. Ties go to the smaller name.
    Whole texts are used, repeated rows come back repeated, an empty table gives an empty result,
    and existing columns of those names, in whatever case, are replaced.
    """
    predict = _predictor(profiles, profile)

    def make(texts):
        found = [predict(t) for t in texts]
        return pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())

    return add_columns(docs, ["text"], lambda: make, names, ("string", "double"))


def clean(docs: DataFrame, profiles: dict[str, list[int]], least: float, profile: int = PROFILE) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose language can be told: a
    text with a letter and a score of ``least`` or more."""
    predict = _predictor(profiles, profile)

    def decide(text):
        lang, score = predict(text)
        return lang != "und" and score >= least

    return keep_rows(docs, ["text"], lambda: decide)
