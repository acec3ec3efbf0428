"""Language identification by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed byte n-grams (1 to 3 bytes, letters folded to lower case, everything that is no letter
a space). Documents are compared with all centroids by cosine; the best one's language is predicted, and a document whose distance to it
exceeds the centroid's limit for texts of its length is rejected, however short it is.

Document frequencies are counted over all training documents; centroids are fitted by spherical k-means on at most about
``per_language`` documents of each language, picked by a hash of the id. Limits are learnt from all training documents, each taken whole
and, so that short lengths are learnt too, as one run of words of each of a few sizes: a rejected text is farther away than nearly all
texts nearest to the centroid, and no nearer than nearly all texts of other languages are when their own language's centroids are left
out. A centroid with few texts of some length takes the distances of its language there, or those of all; a shorter text's limit is never
below a longer one's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from driftfield.llm import blocks as B

DIMS = 1 << 13
CENTROIDS = 4
PER_LANGUAGE = 600
#: The share of the training texts that "nearly all" means.
WITHIN = 0.99
#: So many training texts of a length give a centroid, else its language, a distance of its own.
LEAST_TEXTS = 200
#: Bands of length: fewer than 8 n-grams, 16, 32 and so on by twos; the last one has no upper end.
BANDS = 9
#: Least bytes of the runs of words that training documents are also taken as.
PIECES = (3, 6, 12, 24, 48, 96, 192)
#: Distances are counted by steps of 1 / STEPS.
STEPS = 1000
_ROUNDS = 12

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def is_held_out(doc_id: Column) -> Column:
    """Whether ``crc32(doc_id as text) mod 4`` is 2; held-out documents are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _grams(block: B.Block) -> np.ndarray:
    """text * DIMS + slot of every hashed n-gram. An n-gram lies in one text and does not begin or end with two spaces."""
    code = _FOLD[block.data]
    size = len(code)
    row = np.repeat(np.arange(len(block), dtype=np.int64), np.diff(block.offsets))
    left = block.offsets[1:][row] - np.arange(size)  # bytes up to the end of the text
    found = []
    gram = np.zeros(size, np.uint32)
    for width in (1, 2, 3):
        if size < width:
            break
        gram = (gram[: size - width + 1] << np.uint32(8)) | code[width - 1 :]
        fine = left[: len(gram)] >= width
        fine &= code[: len(gram)] != 0x20 if width == 1 else (code[: len(gram)] != 0x20) | (code[1 : len(gram) + 1] != 0x20)
        at = np.flatnonzero(fine)
        slot = ((gram[at] + np.uint32(width << 26)) * np.uint32(2654435761)) >> np.uint32(32 - 13)
        found.append(row[at] * DIMS + slot)
    return np.concatenate([np.zeros(0, np.int64), *found])


def _counts(block: B.Block) -> np.ndarray:
    """(texts, DIMS) counts of hashed n-grams."""
    return np.bincount(_grams(block), minlength=len(block) * DIMS).reshape(len(block), DIMS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(counts.shape, np.float32)
    some = counts > 0
    x[some] = 1 + np.log(counts[some].astype(np.float32))
    x *= idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Model:
    """Its size is languages * centroids * DIMS numbers."""

    languages: list[str]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray  # largest distance that a centroid accepts, by band of length
    idf: np.ndarray


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for b in B.blocks(batch.column("text")):
                df += (_counts(b) > 0).sum(0)
                n += len(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), DIMS)), pa.array(np.append(df[df > 0], n))], ["slot", "n"])

    rows = texts.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most DIMS + 1 rows
    df = np.zeros(DIMS + 1, np.int64)
    df[rows["slot"]] = rows["n"]
    return df[:DIMS], int(df[DIMS])


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the means of ``k`` equal shares of the documents, dealt by nearness to their common mean."""
    order = np.argsort(x @ x.mean(0), kind="stable")
    centres = np.stack([x[part].mean(0) for part in np.array_split(order, min(k, len(x)))])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    for _ in range(_ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[own == i].sum(0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def fit(docs: DataFrame, centroids: int = CENTROIDS, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from ``docs(doc_id, text, lang)``: rows with text and language that are not held out.

    Of each language about ``per_language`` documents are used for the centroids (all, if fewer). No training rows: an empty model.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    df, n = _document_frequencies(usable.select("text"))
    if n == 0:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros((0, BANDS)), np.zeros(DIMS, np.float32))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    per_row = F.lit(0.0)
    for lang in sorted(counts):
        per_row = F.when(F.col("lang") == lang, per_language / counts[lang]).otherwise(per_row)
    share = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.where(share < per_row).select("lang", "doc_id", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in B.blocks(batch.column("text")):
                packed = pa.array([r.tobytes() for r in _vectors(_counts(b), idf).astype(np.float16)], pa.binary())
                kept = [batch.column(c).slice(b.first, len(b)) for c in ("lang", "doc_id")]
                yield pa.RecordBatch.from_arrays([*kept, packed], ["lang", "doc_id", "x"])

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
        centres = _cluster(x, centroids)
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(centres)), "no": pa.array(range(len(centres)), pa.int32()), "centre": pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    fitted = sample.mapInArrow(vectors, f"lang string, doc_id {kind}, x binary").groupBy("lang").applyInArrow(train, "lang string, no int, centre binary")
    rows = sorted(fitted.collect(), key=lambda r: (r["lang"], r["no"]))  # ``centroids`` rows per language
    centres = np.stack([np.frombuffer(r["centre"], np.float32) for r in rows]) if rows else np.zeros((0, DIMS), np.float32)
    model = Model([r["lang"] for r in rows], centres, np.ones((len(rows), BANDS)), idf)
    return replace(model, limits=_limits(usable.select("lang", "text"), model)) if rows else model


def _band(grams: np.ndarray) -> np.ndarray:
    return np.clip(np.frexp(grams.astype(np.float64))[1] - 3, 0, BANDS - 1)


def _cosines(model: Model, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """(texts, centroids) cosines, and the number of n-grams of each text."""
    counts = _counts(block)
    return _vectors(counts, model.idf) @ model.centroids.T, counts.sum(1)


def _cosines_of_short(model: Model, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """The same without a row of DIMS numbers per text."""
    n = len(block)
    keys, counts = np.unique(_grams(block), return_counts=True)
    row, slot = keys // DIMS, keys % DIMS
    x = (1 + np.log(counts.astype(np.float32))) * model.idf[slot]
    near = np.stack([np.bincount(row, x * c[slot], n) for c in model.centroids], 1).astype(np.float64)
    near /= np.maximum(np.sqrt(np.bincount(row, x * x, n)), 1e-12)[:, None]
    return near, np.bincount(row, counts, n).astype(np.int64)


def _pieces(block: B.Block) -> tuple[B.Block, np.ndarray]:
    """Of each text that is long enough one run of words per size of PIECES, somewhere in it; and the row that each is from."""
    starts, ends, rows = B.words(block)
    words = np.bincount(rows, minlength=len(block))
    first, some, length = np.cumsum(words) - words, np.flatnonzero(words), np.diff(block.offsets)
    found = []
    for size in PIECES:
        at = first[some] + (length[some] * 7919 + size) % words[some]
        left = starts[at]
        right = ends[np.minimum(np.searchsorted(ends, left + size), first[some] + words[some] - 1)]
        found.append(np.stack([left, right, some])[:, right - left >= size])
    left, right, row = np.concatenate(found, 1)
    offsets = np.append(0, np.cumsum(right - left))
    return B.Block(0, block.data[np.repeat(left - offsets[:-1], right - left) + np.arange(offsets[-1])], offsets), row


def _limits(texts: DataFrame, model: Model) -> np.ndarray:
    """(centroids, BANDS) largest distances, from counts of the distances of all texts and their pieces to the nearest centroid, and to the
    nearest of another language."""
    held = texts.sparkSession.sparkContext.broadcast(model)
    shape = (2, len(model.centroids), BANDS, STEPS + 1)
    langs = np.array(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        tally = np.zeros(shape, np.int64)
        for batch in batches:
            own = np.array(batch.column("lang").to_pylist())[:, None] == langs
            for b in B.blocks(batch.column("text")):
                short, row = _pieces(b)
                for (near, grams), at in ((_cosines(m, b), np.arange(len(b))), (_cosines_of_short(m, short), row)):
                    for other, near in enumerate((near, np.where(own[b.first + at], -1.0, near))):
                        best = near.argmax(1)
                        cosine = near[np.arange(len(best)), best]
                        step = np.clip(np.ceil(np.round((1 - cosine) * STEPS, 3)), 0, STEPS).astype(np.int64)
                        cell = np.ravel_multi_index((np.full(len(best), other), best, _band(grams), step), shape)[(grams > 0) & (cosine >= 0)]
                        np.add.at(tally.reshape(-1), cell, 1)
        at = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(tally.ravel()[at])], ["cell", "n"])

    rows = texts.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most two per centroid, band and step
    tally = np.zeros(shape, np.int64)
    tally.ravel()[rows["cell"]] = rows["n"]

    def distance(other: int, c: int, band: int, share: float) -> float:
        for group in (np.arange(len(langs)) == c, langs == langs[c], np.ones(len(langs), bool)):
            n = tally[other, group, band].sum(0)
            if n.sum() >= LEAST_TEXTS:
                break
        return np.searchsorted(np.cumsum(n), share * n.sum()) / STEPS if n.any() else np.nan

    limits = np.zeros(shape[1:3])
    for c, band in np.ndindex(limits.shape):
        own, beyond = distance(0, c, band, WITHIN), distance(1, c, band, 1 - WITHIN)
        limits[c, band] = own if np.isnan(beyond) else max(own, beyond)
    for band in range(1, BANDS):  # no text is so long
        limits[:, band] = np.where(np.isnan(limits[:, band]), limits[:, band - 1], limits[:, band])
    limits = np.maximum.accumulate(np.nan_to_num(limits, nan=0)[:, ::-1], 1)[:, ::-1]
    return np.where(limits > 0, limits, 1.0)


def _score(model: Model, block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best centroid, cosine and whether the text is too far from it."""
    near, grams = _cosines(model, block)
    best = near.argmax(1)
    cosine = np.round(near[np.arange(len(best)), best].astype(np.float64), 6)
    return best, np.clip(cosine, 0, 1), 1 - cosine > model.limits[best, _band(grams)]


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs(doc_id, text)``; texts are read whole.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. With an empty model every document is.
    Otherwise ``lang_pred`` is the nearest centroid's language even if the document is rejected for its distance.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for b in B.blocks(batch.column("text")):
                letter = batch.column("_letter").slice(b.first, len(b)).to_numpy(zero_copy_only=False) & bool(m.languages)
                if m.languages:
                    best, cosine, far = _score(m, b)
                else:
                    best, cosine, far = np.zeros(len(b), int), np.zeros(len(b)), np.ones(len(b), bool)
                named = [m.languages[i] if ok else "und" for i, ok in zip(best, letter)]
                rest = [batch.column(c).slice(b.first, len(b)) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(named, pa.string()), pa.array(np.where(letter, cosine, 0.0)), pa.array(far | ~letter)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text", _has_letter().alias("_letter"))
    return picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    letter = B.unused_name("has_letter", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            keep = batch.column(letter).to_numpy(zero_copy_only=False) & bool(m.languages)
            if m.languages:
                far = [_score(m, b)[2] for b in B.blocks(batch.column("text"))]
                keep &= ~np.concatenate([np.zeros(0, bool), *far])
            yield batch.filter(pa.array(keep))

    return B.map_whole_rows(docs.withColumn(letter, _has_letter()), run).drop(letter)
