"""Language ID by string kernels: Nystrom landmarks and one-versus-rest kernel ridge regression.

Kernel: blended-spectrum presence kernel, the number of character n-grams (1 to 4, hashed to GRAMS features)
that occur in both texts, divided by the root of the product of their own numbers.  With landmark texts Z and
features phi(x) = K_ZZ^(-1/2) k_Z(x), ridge regression has one weight vector per language against the rest.
Scores of a batch are matrix products: presence matrix (texts x grams) times landmark presence (grams x
landmarks) times weights (landmarks x languages); the last two factors are fixed after training and are
multiplied once.

Training uses a bounded sample: at most SAMPLE labelled texts (one of each language at least), chosen by a hash of
id and text, equally many per language.  Only the model (GRAMS x languages numbers) goes to the executors.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphemica.llm.textarrays import release

GRAMS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Bounds of training: labelled texts, landmarks, characters of text.
SAMPLE, LANDMARKS, SAMPLE_CHARS = 2400, 240, 12 << 20
RIDGE, SHARPNESS = 1e-2, 8.0
#: Texts in a block, and characters: the presence matrix of a block stays small.
_BLOCK, _CHARS = 256, 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """One flag per code point, made once per process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x GRAMS matrix of 0 and 1, which texts have a letter).  Other characters count as one space."""
    out = np.zeros((len(texts), GRAMS), dtype=np.uint8)
    lettered = np.zeros(len(texts), dtype=bool)
    lower = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lower])
    codes = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return out, lettered
    row = np.repeat(np.arange(len(texts)), sizes)
    letter = _is_letter()[codes]
    lettered[row[letter]] = True
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()  # a run of other characters is one space
    keep[1:] |= letter[:-1]
    codes, row = codes[keep], row[keep]
    for n in ORDERS:
        if len(codes) < n:
            break
        m = len(codes) - n + 1
        h = np.full(m, n, dtype=np.uint32)
        for j in range(n):
            h = (h ^ codes[j : j + m]) * _MULTIPLIERS[j]
            h ^= h >> np.uint32(15)
        same = row[:m] == row[n - 1 : n - 1 + m]
        out[row[:m][same], (h[same] * np.uint32(0x9E3779B1)) >> np.uint32(17)] = 1
    out[~lettered] = 0
    return out, lettered


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (GRAMS + 1) x languages; the last row is the constant

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs: list[str] = ["und"] * len(texts)
        scores: list[float] = [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and to - at < _BLOCK and (to == at or chars + len(texts[to] or "") <= _CHARS):
                chars += len(texts[to] or "")
                to += 1
            x, lettered = presence([t or "" for t in texts[at:to]])
            norm = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))
            raw = (x.astype(np.float32) @ self.weights[:-1]) / norm[:, None] + self.weights[-1]
            soft = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
            soft /= soft.sum(axis=1, keepdims=True)
            best = raw.argmax(axis=1)
            for i in np.flatnonzero(lettered):
                langs[at + i], scores[at + i] = self.languages[best[i]], float(soft[i, best[i]])
            at = to
        return langs, scores

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weights=self.weights, languages=np.array(self.languages, dtype=object).astype("U"))
        return out.getvalue()


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, language), in a fixed order."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((GRAMS + 1, 0), dtype=np.float32))
    n = len(rows)
    step = max(1, n // LANDMARKS)
    z, _ = presence([t for t, _ in rows[::step][:LANDMARKS]])
    z = z.astype(np.float32)
    z /= np.sqrt(np.maximum(z.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    strong = values > 1e-6 * values.max()
    half = vectors[:, strong] / np.sqrt(values[strong])  # K^(-1/2) on the span of the landmarks
    phi = np.empty((n, half.shape[1]))
    for a in range(0, n, 64):
        x, _ = presence([t for t, _ in rows[a : a + 64]])
        k = x.astype(np.float32) @ z.T / np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))[:, None]
        phi[a : a + 64] = k @ half
    target = np.array([[1.0 if lang == c else -1.0 for c in languages] for _, lang in rows])
    mean, middle = phi.mean(axis=0), target.mean(axis=0)
    centred = phi - mean
    w = np.linalg.solve(centred.T @ centred + RIDGE * n / 100 * np.eye(phi.shape[1]), centred.T @ (target - middle))
    weights = z.T @ (half @ w).astype(np.float32)
    return Model(languages, np.vstack([weights, (middle - mean @ w).astype(np.float32)]))


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a sample of ``labelled``: per language, the texts of the smallest hashes of id and text.

    SAMPLE and SAMPLE_CHARS are shared out equally; every language has a text at least, and texts of over a quarter
    of its characters come last.  Defined cases: null texts and languages teach nothing; a null id is a value like any
    other; a repeated row counts once; ties of hashes go to the smaller text; an empty table teaches no language.
    """
    rows = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.lit("sample"), f"`{id_col}`", f"`{text_col}`").alias("h")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row per language, as the model has
    if not counts:
        return fit([])
    share, chars = max(1, SAMPLE // len(counts)), SAMPLE_CHARS / len(counts)
    # more rows than needed (four times as many) fall under this mark, so sorting has little to do; rare languages pass whole
    mark = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 4 * share / max(r["n"], 1)))))) if len(counts) <= 1000 else None
    if mark is not None:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) <= mark[F.col("lang")])
    once = rows.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.length("text") > chars / 4, "h")
    least = once.withColumn("k", F.row_number().over(order)).where(F.col("k") <= share)
    sums = least.withColumn("chars", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sample = sums.where((F.col("chars") <= chars) | (F.col("k") == 1)).select("h", "text", "lang").collect()
    return fit([(text, lang) for _, text, lang in sorted(map(tuple, sample))])


def _predictor(model: bytes, text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.load(io.BytesIO(model)) as m:
            known = Model(m["languages"].tolist(), m["weights"])
        for batch in batches:
            langs, scores = known.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang", "score"])
            release()

    return run


def predict_language(docs: DataFrame, model: Model, *, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """Add lang_pred and score (0 to 1) to every row, from the whole text alone.

    Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text under a
    model that has learned no language; very long texts are read whole; ties go to the first language in
    alphabetical order; repeated rows get equal results; columns of ``docs`` with the new columns' names are
    replaced, any others are kept; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in (lang_name, score_name)]
    kept = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))  # names of any kind stay out of it
    schema = kept.withColumns({"lang": F.lit(""), "score": F.lit(0.0)}).schema
    told = kept.mapInArrow(_predictor(model.dump(), f"c{names.index(text_col)}", kept.columns), schema)
    return told.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("lang").alias(lang_name), F.col("score").alias(score_name))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, **names: str) -> DataFrame:
    """Train on the rows of ``docs`` that aren't held out and predict all; languages come from the lang column."""
    return predict_language(docs, train(docs.where(~held_out())), **names)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.select("doc_id", "text", "lang").where(~held_out()))
    out = predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


assert GRAMS == 1 << 15 and math.log2(GRAMS) == 15  # the shift in presence() leaves 15 bits
