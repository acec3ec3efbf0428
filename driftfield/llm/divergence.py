"""How far each source's words are from the other sources of its language: counts in Arrow, divergences from shards of a column table.

1. ``partial_counts``: inside ``mapInArrow`` a block of whole texts goes through ``ascii_lower``, ``split_pattern_regex``,
   ``dictionary_encode`` and two hash ``group_by`` calls, first per document and term, then per language, source and term. What leaves a
   task is one row per block, group and term, so a word in every document costs a row per block.
2. ``term_counts``: Spark adds these up and marks the terms that enough documents of a language hold.
3. ``audit``: the kept terms of a language are dealt to shards by hash, its sources to tiles. A task holds one shard of two tiles as a
   matrix of terms by sources and adds up the divergences of all their pairs; the sums of the shards are added in the end.

Terms are maximal runs of ASCII letters and of characters beyond ASCII, with A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftfield.llm import blocks as B
from driftfield.session import cut_lineage

#: What lies between terms.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS = 10
TOP = 10
#: Terms of a shard and sources of a tile: a task's matrices have at most 2 * TILE columns and about SHARD rows.
SHARD, TILE = 20_000, 128
COUNT_BYTES, COUNT_ROWS = 8 << 20, 10_000

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _count_terms(texts: pa.Array, rows: np.ndarray) -> pa.Table:
    """(row, term, n) of some texts; several may belong to one row."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), GAP)
    terms = pc.list_flatten(lists)
    real = pc.not_equal(terms, "")
    row = pa.array(rows).take(pc.list_parent_indices(lists).filter(real))
    coded = terms.filter(real).dictionary_encode()
    counted = pa.table({"row": row, "code": coded.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    return pa.table({"row": counted["row"], "term": coded.dictionary.take(counted["code"]), "n": counted["count_all"]})


def _pieces(text: np.ndarray) -> list[tuple[int, int]]:
    """A text's bytes in spans of about COUNT_BYTES that no term crosses (a longer term stays whole)."""
    spans, at = [], 0
    while at < len(text):
        end = at + COUNT_BYTES
        while end < len(text) and _IN_TERM[text[end - 1]]:
            gaps = np.flatnonzero(~_IN_TERM[text[end : end + COUNT_BYTES]])
            end = end + int(gaps[0]) + 1 if len(gaps) else end + COUNT_BYTES
        spans.append((at, min(end, len(text))))
        at = end
    return spans


def _block_counts(block: B.Block) -> pa.Table:
    """(row, term, n) of a block, rows counted within it. A block longer than COUNT_BYTES is one text, taken piece by piece."""
    if len(block.data) <= COUNT_BYTES:
        offsets = pa.py_buffer(np.ascontiguousarray(block.offsets))
        texts = pa.Array.from_buffers(pa.large_string(), len(block), [None, offsets, pa.py_buffer(np.ascontiguousarray(block.data))])
        return _count_terms(texts, np.arange(len(block)))
    total = None
    for start, end in _pieces(block.data):
        one = _count_terms(pa.array([block.data[start:end].tobytes().decode()], pa.large_string()), np.zeros(1, np.int64))
        total = one if total is None else pa.concat_tables([total, one]).group_by(["row", "term"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["row", "term", "n"])
    return total


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) per block: occurrences, and documents with the term. The empty term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in B.blocks(batch.column("text"), COUNT_BYTES, COUNT_ROWS):
                lang, source = (batch.column(c).slice(b.first, len(b)).cast(pa.string()) for c in ("lang", "source"))
                counts = _block_counts(b)
                groups = pa.table({"lang": lang, "source": source, "term": pa.array([""] * len(b)), "n": pa.array(np.zeros(len(b), np.int64))})
                row = counts["row"]
                held = pa.table({"lang": lang.take(row), "source": source.take(row), "term": counts["term"].cast(pa.string()), "n": counts["n"]})
                merged = pa.concat_tables([groups, held]).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
                yield from merged.rename_columns(["lang", "source", "term", "n", "df"]).to_batches()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(run, "lang string, source string, term string, n bigint, df bigint")


def term_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, n_lang, kept, new): counts per group and per language; ``new`` marks one row of each kept term.

    The empty term has one row per group, never kept.
    """
    added = partial_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = W.partitionBy("lang", "term")
    kept = (F.col("term") != "") & (F.sum("df").over(term) >= least_documents)
    new = F.col("source") == F.min("source").over(term)
    counted = added.withColumns({"n_lang": F.sum("n").over(term), "kept": kept, "new": new})
    return cut_lineage(counted.where("kept or term = ''").drop("df"))


def _share(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 2) / (n + 2 * v)) in whole numbers: three digits of the quotient at a time, so nothing overflows."""
    of = n + 2 * v
    rest, out = count + 2, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shard(counts: pa.Table, groups: pa.Table, top: int) -> dict[str, list]:
    """Partial sums of all pairs across the two tiles, and the best terms of each source where the tiles are one."""
    lang = groups["lang"][0].as_py()
    order = np.argsort(groups["idx"].to_numpy())
    names = groups["source"].take(pa.array(order)).to_pylist()
    idx, tile, total = (groups[c].to_numpy()[order] for c in ("idx", "tile", "total"))
    v, n_lang = groups["v"][0].as_py(), groups["lang_total"][0].as_py()
    coded = counts["term"].combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    at = np.searchsorted(idx, counts["of"].to_numpy())
    n = np.zeros((len(terms), len(idx)), np.int64)
    n[code, at] = counts["n"].to_numpy()
    p = _share(n, total[None, :], v) if len(terms) else n
    out = {"source": [], "part": [], "item": [], "value": []}

    def put(source, part, item, value):
        for name, x in (("source", source), ("part", part), ("item", item), ("value", int(value))):
            out[name].append(x)

    first, last = tile.min(), tile.max()
    own = first == last
    for i in range(len(idx)):
        others = np.flatnonzero(np.arange(len(idx)) != i) if own else np.flatnonzero(tile != tile[i])
        sums = _divergence(p[:, others], p[:, i : i + 1]).sum(axis=0)
        for j, s in zip(others, sums):
            put(names[i], "pair", names[j], s)
    if own and len(terms):
        whole = np.zeros(len(terms), np.int64)
        whole[code] = counts["n_lang"].to_numpy()
        q = _share(whole, np.full(len(terms), n_lang, np.int64), v)
        by_name = np.argsort(np.argsort(np.array([t.encode() for t in terms.to_pylist()], object)))
        for i in range(len(idx)):
            more = np.flatnonzero((n[:, i] > 0) & (p[:, i] > q))
            value = _divergence(p[more, i], q[more])
            for at_ in np.lexsort((by_name[more], -value))[:top]:
                put(names[i], "term", terms[more[at_]].as_py(), value[at_])
    return {"lang": [lang] * len(out["source"]), **out}


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(lang, source, text)``; null counts as ''.

    With p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)) for a kept term's count in a group, N the group's total and V the number of
    kept terms of the language, ``pair`` rows hold the sum over all kept terms of floor((p - q)**2 / (p + q)) for every other source of the
    language, and ``term`` rows the ``top`` terms that the group has more often than its language. Groups without terms take part with
    counts of zero; where no term is kept, all pairs are 0. Equal values are ranked by the item's UTF-8 bytes. Repeated rows count as often as
    they occur; an empty table gives no row; other columns are not read.
    """
    counts = term_counts(docs, least_documents)
    zero = F.lit(0).cast("bigint")
    kept_sum = lambda c: F.coalesce(F.sum(F.when(F.col("kept"), c)), zero)
    groups = counts.groupBy("lang", "source").agg(kept_sum(F.col("n")).alias("total"), kept_sum(F.col("new").cast("bigint")).alias("news"))
    lang = W.partitionBy("lang")
    groups = groups.withColumns({"v": F.sum("news").over(lang), "lang_total": F.sum("total").over(lang), "idx": F.row_number().over(lang.orderBy("source")) - 1, "n_sources": F.count(F.lit(1)).over(lang)})
    groups = groups.withColumns({"tile": F.floor(F.col("idx") / TILE).cast("int"), "tiles": F.ceil(F.col("n_sources") / TILE).cast("int"), "shards": F.greatest(F.lit(1), F.ceil(F.col("v") / SHARD)).cast("int")})
    groups = cut_lineage(groups.drop("news", "n_sources"))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("i"), F.greatest("tile", o).alias("j")))
    key = ["lang", "shard", "i", "j"]

    def placed(df: DataFrame, shard: Column, columns: list) -> DataFrame:
        return df.withColumn("shard", shard).withColumn("cell", F.explode(meets)).select("lang", "shard", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), *columns)

    rows = counts.where("kept").drop("kept", "new").join(groups.select("lang", "source", "idx", "tile", "tiles", "shards"), ["lang", "source"])
    of_terms = placed(rows, F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"), [F.col("idx").alias("of"), "term", "n", "n_lang"])
    of_groups = placed(groups, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)), ["source", "idx", "tile", "total", "v", "lang_total"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(_shard(left, right, top), schema)

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    sums = of_terms.groupBy(*key).cogroup(of_groups.groupBy(*key)).applyInArrow(run, "lang string, source string, part string, item string, value bigint")
    values = sums.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")).cast("int")
    return values.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


#: For op13, from terms as rows and whole numbers of 128 bits.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS (SELECT lang, term, count(*) AS c FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM terms t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM groups g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1::HUGEINT + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.n + 2 * l.v) AS p,
         1::HUGEINT + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS q
  FROM totals g JOIN langs l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), all_parts AS (
  FROM every_pair
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM all_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
