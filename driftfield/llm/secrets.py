"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

The field tags words as secret begin, inside or outside. A word's features are its shape (length, digits, letters, case, symbols), the
same of its neighbours, keywords before it, and how often the document assigns values or has digits at all. It is fitted by maximum
likelihood on a bounded sample of words around base matches and of other text, with the keyword features of half the matches hidden, so
that shapes alone suffice. Lines are decoded by Viterbi.

A line is decoded only if some span in it could beat tagging everything outside: the best begin score plus all positive inside scores is
an upper bound of any span's gain, so the lines left out are outside throughout in the exact solution too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from driftfield.llm import blocks as B

#: Base kinds in order: pattern, and the least length of the group that counts. Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
METHOD_KIND = "field"
#: Finds every text that can have a base match.
_HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}"
#: Finds the texts that have one, for Spark: the patterns of KINDS with their least lengths.
_MATCH = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
_KEYWORD = re.compile(r"(?i)passw|secret|token|api_?key|credential|private|auth|access|bearer", re.ASCII)

OUT, BEGIN, INSIDE = 0, 1, 2
#: Documents whose words the field is fitted on.
SAMPLE = 400
_WINDOW = 12
_STEPS = 150


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in the order of the digest."""
    found = []
    for kind, (_, pattern, group, least) in enumerate(KINDS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def _joined(spans, names) -> str:
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in spans)


_NAMES = [k for k, *_ in KINDS] + [METHOD_KIND]

# byte classes, counted per word
_CLASSES = ("digit", "lower", "upper", "hexadecimal", "symbol", "assign", "quote", "other")


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES)), np.int32)
    for b in range(256):
        c = chr(b)
        if c.isdigit() and b < 128:
            table[b, 0] = 1
        if "a" <= c <= "z":
            table[b, 1] = 1
        if "A" <= c <= "Z":
            table[b, 2] = 1
        if c in "0123456789abcdef":
            table[b, 3] = 1
        if c in "+/_.-@!$%^&*()[]{}|~`,;?<>\\#":
            table[b, 4] = 1
        if c in "=:":
            table[b, 5] = 1
        if c in "\"'":
            table[b, 6] = 1
        if b >= 128:
            table[b, 7] = 1
    return table


_TABLE = _class_table()
_PACKED = [np.ascontiguousarray((_TABLE[:, i].astype(np.int64) << 32) | _TABLE[:, i + 1]) for i in range(0, len(_CLASSES), 2)]

#: Shape features of one word, each 0 or 1.
SHAPES = (
    "len>=6", "len>=8", "len>=12", "len>=16", "len>=20", "len>=32", "all digits", "some digit", "digits>=4", "lower and digit", "upper and digit",
    "lower and upper inside", "hexadecimal", "assign only", "ends in assign", "quoted", "many symbols", "other bytes", "letters only", "email or address",
)
DOC_FEATURES = ("assigns", "digits rare", "digits often")
NAMES = ("bias", *SHAPES, "keyword", *[f"before: {s}" for s in SHAPES], "before: keyword", "second before: keyword", *[f"after: {s}" for s in SHAPES], *DOC_FEATURES)


def _words(block: B.Block):
    """Words of a block with shape features, a keyword flag, the last byte's class, and document features."""
    starts, ends, rows = B.words(block)
    n = len(starts)
    if not n:
        return starts, ends, rows, np.zeros((0, len(SHAPES)), bool), np.zeros(0, bool), np.zeros((len(block), len(DOC_FEATURES)), bool)
    bounds = np.stack([starts, ends], 1).ravel()
    counts = np.zeros((n, len(_CLASSES)), np.int32)
    for k, packed in enumerate(_PACKED):
        values = np.zeros(len(block.data) + 1, np.int64)
        np.take(packed, block.data, out=values[:-1])
        both = np.add.reduceat(values, bounds)[::2]
        counts[:, 2 * k], counts[:, 2 * k + 1] = both >> 32, both & 0xFFFFFFFF
    digit, lower, upper, hexa, symbol, assign, quote, other = counts.T
    length = ends - starts
    core = length - symbol - assign - quote
    last = block.data[ends - 1]
    letters = lower + upper
    shape = np.column_stack(
        [
            core >= 6, core >= 8, core >= 12, core >= 16, core >= 20, core >= 32, (digit == core) & (digit > 0), digit > 0, digit >= 4, (lower > 0) & (digit > 0),
            (upper > 0) & (digit > 0), (lower > 0) & (upper > 1), (hexa == core) & (digit > 0), (assign == length), (last == 0x3D) | (last == 0x3A), quote > 0,
            3 * symbol > length, other > 0, letters == core, ((symbol >= 3) & (digit > 0)),
        ]
    )
    assigns, digits = (np.bincount(rows, weights=c, minlength=len(block)) for c in (assign, digit))
    size = np.maximum(np.diff(block.offsets), 1)
    features = np.stack([assigns * 200 > size, digits * 200 < size, digits * 20 > size], 1)
    return starts, ends, rows, shape, _keywords(block, starts, ends, rows), features


def _keywords(block: B.Block, starts, ends, rows) -> np.ndarray:
    """Words with a keyword in them; only texts that contain one are searched for its places."""
    flags = np.zeros(len(starts), bool)
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block), [None, pa.py_buffer(np.ascontiguousarray(block.offsets)), pa.py_buffer(block.data)])
    for row in np.flatnonzero(pc.match_substring_regex(texts, _KEYWORD.pattern).to_numpy(zero_copy_only=False)):
        at = int(block.offsets[row])
        for m in _KEYWORD.finditer(block.data[at : block.offsets[row + 1]].tobytes().decode("latin-1")):
            i = int(np.searchsorted(starts, at + m.start(), "right")) - 1
            if i >= 0 and at + m.end() <= ends[i]:
                flags[i] = True
    return flags


def _shift(x: np.ndarray, by: int, same: np.ndarray) -> np.ndarray:
    """Values of the word ``by`` places away, zero where it is on another line. ``same``: word i is on the line of word i - 1."""
    out = np.zeros_like(x)
    if by > 0:
        out[by:] = x[:-by]
        for k in range(by):
            out[k:][~same[: len(out) - k]] = 0
    else:
        out[:by] = x[-by:]
        out[:by][~same[-by:]] = 0
    return out


def _lines(block: B.Block, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each word is on the same line of the same text as the word before."""
    breaks = np.flatnonzero(block.data == 0x0A)
    line = np.searchsorted(breaks, starts)
    same = np.zeros(len(starts), bool)
    same[1:] = (line[1:] == line[:-1]) & (rows[1:] == rows[:-1])
    return same


def _features(shape, keyword, doc_of_word, same) -> np.ndarray:
    """(words, features) matrix of 0 and 1."""
    one = np.ones((len(shape), 1), bool)
    k = keyword[:, None]
    return np.concatenate([one, shape, k, _shift(shape, 1, same), _shift(k, 1, same), _shift(k, 2, same), _shift(shape, -1, same), doc_of_word], 1)


@dataclass
class Field:
    """Weights of the field: (features, 3) for words, (3, 3) for steps from one tag to the next, (3,) for a line's first tag."""

    word: np.ndarray
    step: np.ndarray
    first: np.ndarray


_FORBIDDEN = -1e4


def _forbid(step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step, first = step.copy(), first.copy()
    step[OUT, INSIDE] = first[INSIDE] = _FORBIDDEN
    return step, first


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def fit_field(x: np.ndarray, tags: np.ndarray, length: np.ndarray, penalty: float = 1e-3) -> Field:
    """Maximum likelihood with a squared penalty by Adam, over sequences ``x`` (n, t, features) of the given lengths."""
    n, t, f = x.shape
    inside = np.arange(t)[None] < length[:, None]
    held = Field(np.zeros((f, 3)), np.zeros((3, 3)), np.zeros(3))
    params = [held.word, held.step, held.first]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    hot = np.eye(3)[tags] * inside[..., None]
    pair = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    for it in range(1, _STEPS + 1):
        step, first = _forbid(held.step, held.first)
        e = x @ held.word
        a, b = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        a[:, 0] = first + e[:, 0]
        for i in range(1, t):
            a[:, i] = np.where(inside[:, i, None], _log_sum(a[:, i - 1, :, None] + step, 1) + e[:, i], a[:, i - 1])
        for i in range(t - 2, -1, -1):
            b[:, i] = np.where(inside[:, i + 1, None], _log_sum(step + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0)
        z = _log_sum(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * inside[..., None]
        q = np.exp(a[:, :-1, :, None] + step + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
        grads = [
            np.einsum("ntf,ntj->fj", x, hot - p) / n - penalty * held.word,
            (pair - q.sum((0, 1))) / n - penalty * held.step,
            (hot[:, 0] - p[:, 0]).sum(0) / n - penalty * held.first,
        ]
        for w, g, m in zip(params, grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            w += 0.1 * m[0] / (1 - 0.9**it) / (np.sqrt(m[1] / (1 - 0.99**it)) + 1e-8)
    step, first = _forbid(held.step, held.first)
    return Field(np.round(held.word, 6), step, first)


def viterbi(field: Field, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Best tags of many lines at once; ``starts`` is the first word of each line in ``scores`` (words, 3)."""
    lengths = np.diff(np.append(starts, len(scores)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    back = np.zeros((len(scores), 3), np.int8)
    best = field.first + scores[starts]
    ends = np.zeros((len(starts), 3))
    live = len(starts)
    for i in range(1, int(lengths[0]) if len(lengths) else 0):
        still = int(np.searchsorted(-lengths, -i, "left"))  # lines with more than i words
        ends[still:live] = best[still:live]
        live = still
        paths = best[:live, :, None] + field.step
        back[starts[:live] + i] = paths.argmax(1)
        best = paths.max(1) + scores[starts[:live] + i]
    ends[:live] = best[:live]
    tags = np.zeros(len(scores), np.int8)
    now = ends.argmax(1)
    for i in range((int(lengths[0]) if len(lengths) else 0) - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -i, "left"))
        at = starts[:live] + i
        tags[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return tags


def _tag(field: Field, block: B.Block) -> list[tuple[int, int, int]]:
    """(row, start, end) in bytes of every span that the field finds."""
    starts, ends, rows, shape, keyword, doc = _words(block)
    n = len(starts)
    if not n:
        return []
    same = _lines(block, starts, rows)
    # words have few different shapes: each shape's scores for the word itself, the next and the one before are looked up
    s, w = len(SHAPES), field.word
    packed = keyword.astype(np.int32) << s
    for i in range(s):
        packed |= shape[:, i].astype(np.int32) << i
    which, kinds = pd.factorize(packed)
    bits = ((kinds[:, None] >> np.arange(s + 1)) & 1).astype(np.float64)
    scores = (w[0] + bits @ w[1 : s + 2])[which]
    scores += _shift((bits @ w[s + 2 : 2 * s + 3])[which], 1, same)
    scores += _shift((bits[:, :s] @ w[2 * s + 4 : 3 * s + 4])[which], -1, same)
    if keyword.any():
        scores += _shift(keyword[:, None] * w[2 * s + 3], 2, same)
    scores += (doc @ w[3 * s + 4 :])[rows]
    gain_begin = scores[:, BEGIN] - scores[:, OUT] + max(field.step[OUT, BEGIN], field.step[BEGIN, BEGIN], field.step[INSIDE, BEGIN], field.first[BEGIN] - field.first[OUT]) - min(0, field.step[OUT, OUT])
    gain_inside = scores[:, INSIDE] - scores[:, OUT] + max(field.step[BEGIN, INSIDE], field.step[INSIDE, INSIDE]) - field.step[OUT, OUT]
    leave = max(0.0, field.step[BEGIN, OUT] - field.step[OUT, OUT], field.step[INSIDE, OUT] - field.step[OUT, OUT])
    line = np.flatnonzero(~same)
    bound = np.maximum.reduceat(gain_begin, line) + np.add.reduceat(np.maximum(np.maximum(gain_inside, gain_begin + leave), 0), line) + leave
    some = bound > 0
    if not some.any():
        return []
    size = np.diff(np.append(line, n))
    picked = np.repeat(some, size)
    where = np.flatnonzero(picked)
    tags = viterbi(field, scores[picked], (np.cumsum(size[some]) - size[some]))
    spans = []
    for at in np.flatnonzero(tags == BEGIN):
        end = at
        while end + 1 < len(tags) and tags[end + 1] == INSIDE and same[where[end + 1]]:
            end += 1
        spans.append((int(rows[where[at]]), int(starts[where[at]]), int(ends[where[end]])))
    return spans


_TRIM = "\"'`,;:!?()[]{}<>.#*%$&|=\\"


def _sequences(text: str, hide: bool):
    """Training windows (features, tags) of a text: around base matches, whose words are the truth, else one somewhere.

    With ``hide``, keywords and assignments before a match are hidden.
    """
    xs, ys = [], []
    names = {name: i for i, name in enumerate(NAMES)}
    for b in B.blocks(pa.array([text])):
        starts, ends, rows, shape, keyword, doc = _words(b)
        if not len(starts):
            continue
        same = _lines(b, starts, rows)
        tags = np.zeros(len(starts), np.int64)
        for m_start, kind, m_end in base_spans(text):
            start = len(text[: _value_start(text, m_start, kind)].encode())
            end = len(text[:m_end].encode())
            hit = np.flatnonzero((ends > start) & (starts < end))
            if len(hit) and not tags[hit].any():
                tags[hit] = INSIDE
                tags[hit[0]] = BEGIN
        x = _features(shape, keyword & (not hide), doc[rows], same)
        if hide:
            x[:, [names["before: assign only"], names["before: ends in assign"]]] = False
        centres = np.flatnonzero(tags == BEGIN)
        for c in centres[:4] if len(centres) else [len(text) * 7919 % len(starts)]:
            lo, hi = c, c + 1
            while lo > 0 and same[lo] and c - lo < _WINDOW // 2:
                lo -= 1
            while hi < len(starts) and same[hi] and hi - lo < _WINDOW:
                hi += 1
            xs.append(x[lo:hi])
            ys.append(tags[lo:hi])
    return xs, ys


def _value_start(text: str, start: int, kind: int) -> int:
    if KINDS[kind][0] != "assign":
        return start
    m = ASSIGN.match(text, start)
    return m.start(2) if m else start


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field from at most about ``sample`` documents with base matches and at most as many without, picked by a hash of id and text.

    Rows that repeat both count once, so whatever ids are missing or repeated, no more than four times that many come to the driver. Where matches are few, the others are four times as many; texts that only have a keyword are among these. None without matches.
    """
    text = F.col("text")
    marked = docs.where(text.isNotNull()).select("doc_id", "text", text.rlike(_MATCH).alias("hit"))
    counts = {r["hit"]: r["n"] for r in marked.groupBy("hit").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(True):
        return None
    share = F.pmod(F.xxhash64(F.lit("secrets"), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    wanted = F.when(F.col("hit"), sample / counts[True]).otherwise(min(sample, 4 * counts[True]) / max(counts.get(False, 1), 1))
    # a window around the matches is enough to learn from; other texts give one window each
    rows = marked.where(share < wanted).select("doc_id", "text").dropDuplicates(["doc_id", "text"]).limit(4 * sample)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc_id": [], "part": [], "x": [], "y": []}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                xs, ys = _sequences(text, hide=bool((doc_id or 0) * 2654435761 >> 7 & 1))
                for part, (x, y) in enumerate(zip(xs, ys)):
                    out["doc_id"].append(doc_id)
                    out["part"].append(part)
                    out["x"].append(np.packbits(x, axis=1).tobytes())
                    out["y"].append(y.astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], batch.schema.field("doc_id").type), pa.array(out["part"], pa.int32()), pa.array(out["x"], pa.binary()), pa.array(out["y"], pa.binary())], list(out))

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(windows, f"doc_id {kind}, part int, x binary, y binary").collect()  # at most four windows a sampled document
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["part"], r["x"]))
    if not got:
        return None
    f = len(NAMES)
    x, y = np.zeros((len(got), _WINDOW, f)), np.zeros((len(got), _WINDOW), np.int64)
    for i, r in enumerate(got):
        tags = np.frombuffer(r["y"], np.int8)
        bits = np.unpackbits(np.frombuffer(r["x"], np.uint8).reshape(len(tags), -1), axis=1)[:, :f]
        x[i, : len(tags)], y[i, : len(tags)] = bits, tags
    return fit_field(x, y, np.array([len(r["y"]) for r in got]))


def _spans_of(field: Field | None, column: pa.Array) -> Iterator[tuple[int, list, list]]:
    """(row, base spans, added spans) in code points, for the rows that have any."""
    column = pc.fill_null(column, "")
    hints = set(np.flatnonzero(pc.match_substring_regex(column, _HINT).to_numpy(zero_copy_only=False)).tolist())
    tagged: dict[int, list] = {}
    if field is not None:
        for b in B.blocks(column):
            for row, start, end in _tag(field, b):
                tagged.setdefault(row + b.first, []).append((start - int(b.offsets[row]), end - int(b.offsets[row])))
    for row in sorted(hints | set(tagged)):
        text = column[row].as_py()
        base = base_spans(text)
        added = []
        raw = text.encode()
        for start, end in tagged.get(row, ()):
            word = raw[start:end].decode()
            core = word.strip(_TRIM)
            if not core:
                continue
            at = len(raw[:start].decode()) + word.index(core)
            span = (at, len(KINDS), at + len(core))
            if not any(s < span[2] and span[0] < e for s, _, e in base):
                added.append(span)
        if base or added:
            yield row, base, added


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_added, base_spans, spans) for every row of ``docs(doc_id, text)``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and kind, comma-joined. Base matches overlap others' kinds
    freely; a span of the field that overlaps a base match is left to it. Null text counts as empty. ``field`` None: base matches only.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)
    columns = ("n_assign", "n_access", "n_hex", "n_added")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, 4), np.int64)
            base_text, all_text = [""] * batch.num_rows, [""] * batch.num_rows
            for row, base, added in _spans_of(held.value, batch.column("text")):
                for _, kind, _ in base + added:
                    counts[row, kind] += 1
                base_text[row], all_text[row] = _joined(base, _NAMES), _joined(sorted(base + added), _NAMES)
            arrays = [batch.column("doc_id"), *[pa.array(counts[:, i]) for i in range(4)], pa.array(base_text, pa.string()), pa.array(all_text, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *columns, "base_spans", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in columns)}, base_spans string, spans string")


def redact(docs: DataFrame, field: Field | None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mark``, overlapping ones by a single one; ``n_chars``, if there, follows the text."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed: dict[int, str] = {}
            column = batch.column("text")
            for row, base, added in _spans_of(held.value, column):
                text, out, at = column[row].as_py(), [], 0
                for start, _, end in sorted(base + added):
                    if start >= at:
                        out += [text[at:start], mark]
                    at = max(at, end)
                changed[row] = "".join([*out, text[at:]])
            if changed:
                texts = column.to_pylist()
                for row, text in changed.items():
                    texts[row] = text
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, column.type))
                if counted:
                    at = batch.schema.get_field_index("n_chars")
                    lengths = batch.column("n_chars").to_pylist()
                    for row, text in changed.items():
                        lengths[row] = len(text)
                    batch = batch.set_column(at, "n_chars", pa.array(lengths, batch.schema.field(at).type))
            yield batch

    assert isinstance(docs.schema["text"].dataType, StringType)
    return B.map_whole_rows(docs, run)
