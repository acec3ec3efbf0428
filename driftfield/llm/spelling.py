"""Spelling variants: words one edit apart, found in a reduced alphabet, and the common form that each leads to.

1. ``word_counts``: runs of letters of every whole text, counted per block of texts before they leave a task.
2. ``near_pairs``: letters are hashed to a few symbols. Every word puts forth the full one-edit neighbourhood of its reduced word (itself,
   every deletion, replacement and insertion of a symbol), as 64-bit keys computed for all words of a length at once. The keys meet the
   reduced vocabulary, and the join verifies each candidate on the original strings. Keys of no reduced word are dropped where they arise
   by a bitmap of fixed size; it only saves shuffling, whatever it lets through meets nothing.
   Where many words share one reduced word, these words and the ones that came upon them go through the same again in an alphabet that
   keeps all letters apart, so no reduced word stays crowded and no pair is dropped.
3. ``variants``: a word's form is its near word with the most occurrences, if it has ten times its own; roots follow forms by doubling.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftfield.llm import blocks as B
from driftfield.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT = 7, 2
TYPO_RATE = 31
RATIO = 10
#: A prime above the 90 letters: with so many symbols, no two letters share one.
ALL_APART = 97
#: A reduced word of more words than this is refined.
CROWDED = 1_000
#: Bits of the map of reduced words that tasks are given (16 MB).
MAP_BITS = 27
COUNT_BYTES, COUNT_ROWS = 4 << 20, 4096
#: Neighbour keys computed at a time.
KEYS = 1 << 21
_TABLE_LENGTH = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = 0xD6E8FEB86659FD93
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _is_letter(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes of letters: A-Z, a-z, and U+00C0 to U+00FF, which are 0xC3 and another byte."""
    lead = data == 0xC3
    mask = _LETTER[data] | lead
    mask[1:] |= lead[:-1]
    return mask


def _shift_tables() -> np.ndarray:
    """(length, byte position, byte): what a crc32 turns into when so many zero bytes follow."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    tables = np.zeros((_TABLE_LENGTH + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * 8)
    for length in range(_TABLE_LENGTH):
        tables[length + 1] = (tables[length] >> 8) ^ step[tables[length] & 0xFF]
    return tables


_SHIFT = _shift_tables()


def _crc_after(prefix: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings one after the other, from both crc32 and the length of the second, up to _TABLE_LENGTH."""
    for position in range(4):
        crc = crc ^ _SHIFT[length, position, (prefix >> np.uint32(8 * position)) & np.uint32(0xFF)]
    return crc


def _block_words(block: B.Block, ids: list, typo_rate: int, least_length: int) -> tuple[list[bytes], np.ndarray]:
    """Words of a block and how often each occurs; a word may come twice."""
    inside = _is_letter(block.data)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    follows = np.zeros(len(inside) + 1, np.int64)
    np.cumsum((block.data & 0xC0) == 0x80, out=follows[1:])
    points = ends - starts - (follows[ends] - follows[starts])
    long = points >= least_length
    starts, ends, points = starts[long], ends[long], points[long]
    if not len(starts):
        return [], np.zeros(0, np.int64)
    rows = B.rows_of(block, starts)
    code, kinds = pd.factorize(B.span_hashes(block.data, starts, ends, lower=True))
    sample = np.flatnonzero(B.first_of_each(code))  # one span per kind, in order of kinds
    raw = _LOWER[block.data].tobytes()
    words = [raw[s:e] for s, e in zip(starts[sample], ends[sample])]
    size, points = ends[sample] - starts[sample], points[sample]
    pair, times = np.unique(rows * len(kinds) + code, return_counts=True)
    row, kind = pair // len(kinds), pair % len(kinds)
    prefixes = [f"{'' if i is None else i}:".encode() for i in ids]
    prefix_crc = np.array([zlib.crc32(p) for p in prefixes], np.uint32)
    word_crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    crc = _crc_after(prefix_crc[row], word_crc[kind], np.minimum(size[kind], _TABLE_LENGTH))
    for at in np.flatnonzero(size[kind] > _TABLE_LENGTH):
        crc[at] = zlib.crc32(words[kind[at]], int(prefix_crc[row[at]]))
    typo = crc % np.uint32(typo_rate) == 0
    counts = np.bincount(kind[~typo], weights=times[~typo], minlength=len(kinds)).astype(np.int64)
    kept = np.flatnonzero(counts)
    typo = typo & (points[kind] > least_length)
    changed = []
    for k, h in zip(kind[typo], crc[typo]):
        word, at = words[k].decode(), int(h) % int(points[k])
        changed.append((word[:at] + word[at + 1 :]).encode())
    return [words[k] for k in kept] + changed, np.concatenate([counts[kept], times[typo]])


def word_counts(docs: DataFrame, typo_rate: int = TYPO_RATE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of ``docs(doc_id, text)``, with a letter less where the crc32 of document and word is a multiple of ``typo_rate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in B.blocks(batch.column("text"), COUNT_BYTES, COUNT_ROWS):
                words, n = _block_words(b, batch.column("doc_id").slice(b.first, len(b)).to_pylist(), typo_rate, least_length)
                offsets = np.zeros(len(words) + 1, np.int64)
                np.cumsum([len(w) for w in words], out=offsets[1:])
                column = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(words))])
                yield pa.RecordBatch.from_arrays([column.cast(pa.string()), pa.array(n)], ["word", "n"])

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _symbols(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (1 and up) of all words one after another, and where words begin."""
    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    letter = np.where(data >= 0xC0, data - 0xC0 + 26, data - 97)
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=offsets[1:])
    return (letter * 37 % ALL_APART % symbols + 1).astype(np.uint64), offsets


def _powers(n: int) -> np.ndarray:
    steps = np.full(n + 1, _BASE, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def _key(total: np.ndarray, length: int) -> np.ndarray:
    length = int(length)
    return B.mix64(total + np.uint64(length * _LENGTH % (1 << 64)))


def _reduced(words: list[str], symbols: int) -> np.ndarray:
    """The key of each reduced word."""
    values, offsets = _symbols(words, symbols)
    if not len(values):
        return np.zeros(len(words), np.uint64)
    sizes = np.diff(offsets)
    place = np.arange(len(values)) - np.repeat(offsets[:-1], sizes)
    total = np.add.reduceat(values * _powers(int(sizes.max()))[place], offsets[:-1])
    return B.mix64(total + sizes.astype(np.uint64) * np.uint64(_LENGTH))


def _neighbours(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, key) of the one-edit neighbourhoods of reduced words, by pieces; a key may come twice for a word."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.arange(1, symbols + 1, dtype=np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    for n in np.unique(sizes):
        of_size = np.flatnonzero(sizes == n)
        power = _powers(n + 1)
        for at in range(0, len(of_size), max(1, KEYS // int((2 * n + 1) * symbols))):
            some = of_size[at : at + max(1, KEYS // int((2 * n + 1) * symbols))]
            values = _symbols([words[i] for i in some], symbols)[0].reshape(len(some), n)
            before = np.zeros((len(some), n + 1), np.uint64)
            np.cumsum(values * power[:n], axis=1, out=before[:, 1:])
            total = before[:, -1:]
            yield some, _key(total[:, 0], n)
            yield np.repeat(some, n), _key(before[:, :-1] + (total - before[:, 1:]) * inverse, n - 1).ravel()
            for i in range(0, n + 1, max(1, KEYS // (symbols * len(some)))):
                j = min(n + 1, i + max(1, KEYS // (symbols * len(some))))
                inserted = before[:, i:j, None] + letters * power[i:j, None] + ((total - before[:, i:j]) * _BASE)[:, :, None]
                yield np.repeat(some, inserted[0].size), _key(inserted, n + 1).ravel()
                last = min(j, n)
                replaced = (total - values[:, i:last] * power[i:last])[:, :, None] + letters * power[i:last, None]
                yield np.repeat(some, replaced[0].size), _key(replaced, n).ravel()


def _reduced_vocabulary(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """(key, word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _reduced(batch.column("word").to_pylist(), symbols)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns], ["key", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint")


def _key_map(keys: DataFrame) -> np.ndarray:
    """A bit per low MAP_BITS bits of a key, set where a key has them: parts of it are filled by the executors, 16 MB in all."""
    part_bits = 16
    low = F.col("key").bitwiseAND((1 << MAP_BITS) - 1)
    placed = keys.select(F.shiftright(low, part_bits).alias("part"), low.bitwiseAND((1 << part_bits) - 1).cast("int").alias("bit")).distinct()
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)

    def run(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << part_bits, bool)
        own[table["bit"].to_numpy()] = True
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    size = 1 << (part_bits - 3)
    for row in placed.groupBy("part").applyInArrow(run, "part bigint, bits binary").toLocalIterator():
        bits[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _neighbourhoods(words: DataFrame, known: DataFrame, symbols: int) -> DataFrame:
    """(key, word, n) of all one-edit neighbours that the map of known keys lets through, each once per word."""
    spread = words.sparkSession.sparkContext.broadcast(_key_map(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = spread.value
        for batch in batches:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for word, key in _neighbours(batch.column("word").to_pylist(), symbols):
                low = (key & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
                real = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                found.append((word[real], key[real]))
            word, key = (np.concatenate(c) for c in zip(*found))
            new = B.first_of_each(B.mix64(key + B.mix64(word.astype(np.uint64) + np.uint64(1))))
            word, key = pa.array(word[new]), key[new]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("word").take(word), batch.column("n").take(word)], ["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint")


def _few_symbols(n_words: int) -> int:
    """The smallest power of two, from 4, that gives the shortest words as many reduced words as there are words."""
    symbols = 4
    while symbols**LEAST_LENGTH < n_words and symbols < 64:
        symbols *= 2
    return symbols


def _verified(neighbours: DataFrame, reduced: DataFrame) -> DataFrame:
    other = reduced.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    close = F.abs(F.length("word") - F.length("near")) <= 1
    met = neighbours.join(other, (neighbours["key"] == other["key"]) & close & (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    return met.select("word", "n", "near", "near_n")


def near_pairs(vocabulary: DataFrame, symbols: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """(word, n, near, near_n): all pairs of ``vocabulary(word, n)`` one edit apart, both ways round. Words are distinct, of a-z and U+00C0 to
    U+00FF."""
    symbols = symbols or _few_symbols(vocabulary.count())
    reduced = cut_lineage(_reduced_vocabulary(vocabulary, symbols))
    neighbours = cut_lineage(_neighbourhoods(vocabulary, reduced, symbols))
    hot = cut_lineage(reduced.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowded).select("key"))
    if symbols >= ALL_APART or hot.isEmpty():
        return _verified(neighbours, reduced)
    met = cut_lineage(neighbours.join(hot, "key", "left_semi").select("word", "n").distinct())
    full = cut_lineage(reduced.join(hot, "key", "left_semi").select("word", "n"))
    apart = _reduced_vocabulary(full, ALL_APART)
    return _verified(neighbours, reduced.join(hot, "key", "left_anti")).union(_verified(_neighbourhoods(met, apart, ALL_APART), apart))


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(word, root): ``forms(word, form)`` followed to the last. Forms grow ``ratio``-fold, so chains are short and doubling ends them."""
    longest, n = 0, most
    while n >= ratio:
        longest, n = longest + 1, n // ratio
    at = forms.where("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while reach < longest:
        at = cut_lineage(at)
        ahead = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        at = at.join(ahead, at["root"] == ahead["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"))
        reach *= 2
    return at


def variants(docs: DataFrame, typo_rate: int = TYPO_RATE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, symbols: int | None = None, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs(doc_id, text)``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least ``least_length`` letters, A-Z in lower case, that occur at least
    ``least_count`` times, after the planted typos (see ``word_counts``; a null ``doc_id`` counts as an empty one). Null and empty texts have
    no words; repeated rows count as often as they occur; an empty table gives no row; other columns are not read. Near words with equal
    counts are taken in code-point order.
    """
    vocabulary = cut_lineage(word_counts(docs, typo_rate, least_length, least_count))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best")
    near = near_pairs(vocabulary, symbols, crowded).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    common = -F.col("best.m") >= RATIO * F.col("n")
    joined = vocabulary.join(near, "word", "left").withColumns({"form": F.when(common, F.col("best.w")), "form_n": F.when(common, -F.col("best.m"))})
    with_forms = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n"))
    most = vocabulary.agg(F.max("n")).first()[0] or 0
    rooted = with_forms.join(roots(with_forms, most), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: For op11: crc32 is worked out byte by byte, near words come from strings with one place blotted out or left out.
SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)
  )
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), kinds AS (
  SELECT run, count(*) AS c, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM kinds, crc_table
), written AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed
), vocabulary AS (SELECT word, sum(c)::BIGINT AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM vocabulary),
blotted AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS k FROM places),
shorter AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS k FROM places),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM blotted a JOIN blotted b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT s.word, v.word, v.n FROM shorter s JOIN vocabulary v ON s.k = v.word
  UNION ALL SELECT v.word, s.word, s.n FROM shorter s JOIN vocabulary v ON s.k = v.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word
), firsts AS (
  SELECT b.word, b.n_near, b.most, arg_min(p.near, encode(p.near)) AS near FROM best b JOIN pairs p ON p.word = b.word AND p.near_n = b.most GROUP BY ALL
), forms AS (
  SELECT v.word, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, CASE WHEN f.most >= 10 * v.n THEN f.near END AS form, CASE WHEN f.most >= 10 * v.n THEN f.most END::BIGINT AS form_n
  FROM vocabulary v LEFT JOIN firsts f USING (word)
), walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL
), ends AS (SELECT w.word, w.at AS root FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
