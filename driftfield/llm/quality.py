"""Quality rules as a bitmask ledger.

Every rule runs once per document; its failure is one bit, and the measurements stay beside the bits. A policy is a version with a set
of rules: applying it is one bitwise AND. Ablations, i.e. what each rule of a policy does alone and beside the others, come from the
counts per bit pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftfield.llm import blocks as B

#: Bit by bit. Names stay when policies change.
RULES = ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "word_length", "shouting", "few_letters")
BASE = ("few_words", "repeated_windows")
#: Policy versions: the rules that reject.
POLICIES = {
    1: BASE,
    2: (*BASE, "many_symbols", "repeated_lines", "word_length", "few_letters"),
    3: (*BASE, "many_symbols", "repeated_lines", "word_length", "shouting", "few_letters"),
}
CURRENT = 3
WINDOW = 8
SYMBOLS = b"[#*$%&|<>]"[1:-1]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")
LEDGER = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
#: ASCII letters, and the first byte of any longer character.
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = 1
_CHAR_START = (np.arange(256) & 0xC0) != 0x80


def mask(rules) -> int:
    """The bits of the named rules."""
    return sum(1 << RULES.index(r) for r in rules)


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(block: B.Block, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Per text, words that lie in a window of 8 words which occurs twice or more in it."""
    keys, whole = B.windows(hashes, rows, WINDOW)
    at = np.flatnonzero(whole)
    _, which, count = np.unique(B.by_row(rows[at], keys[at]), return_inverse=True, return_counts=True)
    at = at[count[which] > 1]
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=len(block))


def _lines(block: B.Block, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, lines with a word, and those among them that equal an earlier line."""
    if not len(word_starts):
        return np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
    breaks = np.flatnonzero(block.data == 0x0A)
    starts = np.unique(np.concatenate([block.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(block.data)]
    ends = np.append(starts[1:], len(block.data))
    ends = ends - (block.data[ends - 1] == 0x0A)
    has_word = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    rows = np.searchsorted(block.offsets, starts, "right") - 1
    new = B.first_of_each(B.by_row(rows, B.span_hashes(block.data, starts, ends)))
    return np.bincount(rows, minlength=len(block)), np.bincount(rows[~new], minlength=len(block))


def _measure(block: B.Block) -> dict[str, np.ndarray]:
    starts, ends, rows = B.words(block)
    data, offsets = block.data, block.offsets
    lines, repeats = _lines(block, starts)
    return {
        "n_words": np.bincount(rows, minlength=len(block)),
        "word_chars": _per_text(B.IN_WORD[data] & _CHAR_START[data], offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_lines": lines,
        "n_dup_lines": repeats,
        "n_repeat_words": _repeated(block, rows, B.span_hashes(data, starts, ends)),
        "n_letters": _per_text(_LETTER[data], offsets),
        "n_upper": _per_text(_UPPER[data], offsets),
    }


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_measure(b) for b in B.blocks(batch.column("text"))]
        columns = [pa.array(np.concatenate([p[m] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed) for every row of ``docs(doc_id, text)``; ``failed`` has bit i set if rule i fails.

    Null or empty text counts as no words and fails ``few_words`` alone. Texts are measured whole. Repeated rows give repeated rows.
    """
    m = docs.select("doc_id", "text").mapInArrow(_measure_batches, LEDGER)
    words = F.col("n_words")
    fails = {
        "few_words": words < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * words,
        "many_symbols": 100 * F.col("n_symbols") > 10 * words,
        "repeated_lines": (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        "word_length": (words > 0) & ((F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words)),
        "shouting": 2 * F.col("n_upper") > F.col("n_letters"),
        "few_letters": (words > 0) & (2 * F.col("n_letters") < F.col("word_chars")),
    }
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits + F.when(fails[rule], 1 << i).otherwise(0)
    return m.withColumn("failed", bits)


def apply_policy(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with ``base_failed``, ``policy`` and ``kept``: no rule of the policy, and no base rule, fails."""
    wanted = mask({*BASE, *POLICIES[version]})
    return entries.withColumns(
        {"base_failed": F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0, "policy": F.lit(version), "kept": F.col("failed").bitwiseAND(F.lit(wanted)) == 0}
    )


def ablations(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """(rule, n_failed, n_alone, n_kept, n_kept_without), one row per rule of the policy.

    ``n_alone`` documents fail no other rule of the policy, so leaving the rule out would keep them too. Documents are counted per bit
    pattern first, at most 2 ** rules rows; an empty ledger gives zeros.
    """
    wanted = mask({*BASE, *POLICIES[version]})
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(wanted)).alias("bits")).count()
    rules = patterns.sparkSession.createDataFrame([(r, 1 << i) for i, r in enumerate(RULES) if wanted >> i & 1], "rule string, bit bigint")
    counted = patterns.agg(F.collect_list(F.struct("bits", "count")).alias("all")).withColumn("r", F.lit(0))
    each = rules.withColumn("r", F.lit(0)).join(counted, "r")
    count = lambda test: F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + F.when(test(x["bits"]), x["count"]).otherwise(0))
    bit = F.col("bit")
    return each.select(
        "rule",
        count(lambda b: b.bitwiseAND(bit) != 0).alias("n_failed"),
        count(lambda b: b == bit).alias("n_alone"),
        count(lambda b: b == 0).alias("n_kept"),
        count(lambda b: (b == 0) | (b == bit)).alias("n_kept_without"),
    )


#: For op2, from words and lines as rows.
SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM worded),
grams AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM words
), windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(g, ' '))) AS n FROM grams WHERE len(g) = 8),
repeats AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM windows WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^A-Za-z\x{0080}-\x{10FFFF}]', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM worded LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
), bits AS (
  SELECT *, ((n_words < 20)::BIGINT + (100 * n_repeat_words > 30 * n_words)::BIGINT * 2 + (100 * n_symbols > 10 * n_words)::BIGINT * 4
         + (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT * 8 + (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))::BIGINT * 16
         + (2 * n_upper > n_letters)::BIGINT * 32 + (n_words > 0 AND 2 * n_letters < word_chars)::BIGINT * 64)::BIGINT AS failed
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_upper, failed,
       failed & 3 <> 0 AS base_failed, failed = 0 AS kept
FROM bits
"""

#: For the ablations of the current policy, from the same ledger.
ABLATIONS_SQL = f"""
WITH entries AS ({SQL}), wanted AS (SELECT doc_id, failed & {mask({*BASE, *POLICIES[CURRENT]})} AS bits FROM entries),
rules(rule, bit) AS (VALUES {", ".join(f"('{r}', {1 << i})" for i, r in enumerate(RULES) if r in {*BASE, *POLICIES[CURRENT]})})
SELECT rule, count(*) FILTER (bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (bits = bit)::BIGINT AS n_alone, count(*) FILTER (bits = 0)::BIGINT AS n_kept,
       count(*) FILTER (bits = 0 OR bits = bit)::BIGINT AS n_kept_without
FROM rules, wanted GROUP BY rule
"""
