"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file gives pieces and scores only. A block of texts becomes one flat array of symbols, cut into words where no piece can
cross: before a space mark that follows another character, and around characters that no piece contains. Each distinct word of the
block is encoded once. A round finds the best-ranked pair of every word by a segmented minimum (equal ranks: leftmost), merges it in
all words at once and ranks the two new pairs; words without a pair leave, and the rest is compacted. One merge per word and round
keeps exactly the order of a priority queue, so the ids equal the library's.

A word of more than ``LONG_WORD`` symbols is merged with a heap in the same order, since rounds would be quadratic in its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftfield.llm import blocks as B

SPACE = "▁"
LONG_WORD = 2_048
_NONE = np.int64(1 << 62)
_EMPTY = np.int64(-1)
_SLOT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """What encoding and decoding need, as arrays; it is broadcast, and its size depends on the model file alone."""

    symbol: np.ndarray  # by code point: symbol, or -1 where no piece contains the character
    rank: np.ndarray  # by symbol: place in the order of merges; equal scores share a place
    slots: np.ndarray  # hash table of symbol pairs: left << 32 | right
    merged: np.ndarray  # symbol that the pair becomes
    n_ids: int  # symbols from here on are characters without a piece of their own
    extra: list[str]
    byte_ids: np.ndarray
    surface: np.ndarray  # bytes of all pieces, one after another
    surface_at: np.ndarray
    prefix: bool
    bos: int
    eos: int


def load_model(model: bytes) -> Model:
    """Read a BPE model with byte fallback that leaves texts unnormalised but for spaces.

    Raises ValueError for another kind of model, whose results this encoder would not match.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)]
    if sum(sp.is_byte(i) for i in range(n)) != 256 or any(sp.is_unused(i) for i in range(n)):
        raise ValueError("only models with byte fallback and without unused pieces are supported")
    probe = "ﬁ  　x\t "
    prefix = sp.normalize("a") == SPACE + "a"
    if sp.normalize(probe) != (SPACE if prefix else "") + probe.replace(" ", SPACE):
        raise ValueError("only models without normalisation of characters or spaces are supported")
    pieces = {names[i]: i for i in range(n) if plain[i]}
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece goes on over a space")
    extra = sorted({c for p in pieces for c in p} - set(pieces))
    number = pieces | {c: n + i for i, c in enumerate(extra)}
    symbol = np.full(0x110000, -1, np.int32)
    for text, i in number.items():
        if len(text) == 1:
            symbol[ord(text)] = i
    scores = np.array([sp.get_score(i) for i in range(n)])
    rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
    keys, values = [], []
    for text, i in pieces.items():
        for cut in range(1, len(text)):
            a, b = number.get(text[:cut]), number.get(text[cut:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                values.append(i)
    slots, merged = _hash_table(np.array(keys, np.int64), np.array(values, np.int32))
    shown = [_surface(sp, names[i], i) for i in range(n)]
    return Model(
        symbol, rank, slots, merged, n, extra,
        np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32),
        np.frombuffer(b"".join(shown), np.uint8), np.cumsum([0, *map(len, shown)]), prefix, sp.bos_id(), sp.eos_id(),
    )


def _surface(sp, name: str, i: int) -> bytes:
    if sp.is_control(i):
        return b""
    if sp.is_unknown(i):
        return " ⁇ ".encode()
    return bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace(SPACE, " ").encode()


def _slots_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _SLOT) >> np.uint64(64 - bits)).astype(np.int64)


def _hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = max(4, int(len(keys)).bit_length() + 2)
    slots, merged = np.full(1 << bits, _EMPTY), np.full(1 << bits, -1, np.int32)
    at = _slots_of(keys, bits)
    left = np.arange(len(keys))
    while len(left):
        free = left[slots[at[left]] == _EMPTY]
        slots[at[free]] = keys[free]  # of several, the last stays
        merged[at[free]] = values[free]
        left = left[slots[at[left]] != keys[left]]
        at[left] = (at[left] + 1) & ((1 << bits) - 1)
    return slots, merged


def _merge_of(m: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What each pair of symbols becomes, or -1."""
    bits = len(m.slots).bit_length() - 1
    keys = a.astype(np.int64) << 32 | b.astype(np.int64)
    keys[(a < 0) | (b < 0)] = -2
    at = _slots_of(keys, bits)
    out = np.where(m.slots[at] == keys, m.merged[at], np.int32(-1))
    left = np.flatnonzero((m.slots[at] != keys) & (m.slots[at] != _EMPTY))
    while len(left):
        at[left] = (at[left] + 1) & (len(m.slots) - 1)
        found = m.slots[at[left]]
        hit = left[found == keys[left]]
        out[hit] = m.merged[at[hit]]
        left = left[(found != keys[left]) & (found != _EMPTY)]
    return out


def _merge_rounds(m: Model, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of every word, and the word of each."""
    words = np.arange(len(starts))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    word_of = np.repeat(words, np.diff(np.append(starts, len(symbols))))
    first = None
    while len(words):
        n = len(symbols)
        if first is None:  # after a compaction: rank all pairs, link neighbours
            place = np.arange(n)
            after, before = place + 1, place - 1
            last = np.append(starts[1:], n) - 1
            after[last], before[starts] = -1, -1
            inner = np.flatnonzero(after >= 0)
            becomes = np.full(n, -1, np.int32)
            becomes[inner] = _merge_of(m, symbols[inner], symbols[inner + 1])
            order = np.where(becomes >= 0, m.rank[becomes] << 32 | place, _NONE)
            alive = np.ones(n, bool)
            first = starts
        best = np.minimum.reduceat(order, first)
        busy = best < _NONE
        if busy.sum() < 0.7 * len(words) or not busy.any():
            stays = np.repeat(busy, np.diff(np.append(first, n)))
            out = alive & ~stays
            done.append((word_of[out], symbols[out]))
            keep = alive & stays
            symbols, word_of, words = symbols[keep], word_of[keep], words[busy]
            starts = np.searchsorted(word_of, words)
            first = None
            continue
        left = best[busy] & np.int64(0xFFFFFFFF)
        right = after[left]
        symbols[left] = becomes[left]
        alive[right] = False
        order[right] = _NONE
        beyond = after[right]
        after[left] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = left[linked]
        order[left] = _NONE
        pairs_left = np.concatenate([before[left][before[left] >= 0], left[linked]])
        becomes[pairs_left] = new = _merge_of(m, symbols[pairs_left], symbols[after[pairs_left]])
        order[pairs_left] = np.where(new >= 0, m.rank[new] << 32 | pairs_left, _NONE)
    word_of, symbols = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    sort = np.argsort(word_of, kind="stable")
    return symbols[sort], word_of[sort]


def _merge_heap(m: Model, symbols: np.ndarray) -> np.ndarray:
    """The same merges in one long word."""
    sym = symbols.tolist()
    n = len(sym)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    first = _merge_of(m, symbols[:-1], symbols[1:])
    heap = [(int(m.rank[v]), i, sym[i], sym[i + 1], int(v)) for i, v in enumerate(first) if v >= 0]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, v = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j] = v, None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for p in (before[i], i):
            if p >= 0 and after[p] >= 0:
                new = int(_merge_of(m, np.array([sym[p]]), np.array([sym[after[p]]]))[0])
                if new >= 0:
                    heapq.heappush(heap, (int(m.rank[new]), p, sym[p], sym[after[p]], new))
    return np.array([s for s in sym if s is not None], np.int32)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


def _bytes_of(m: Model, char: str) -> np.ndarray:
    return m.byte_ids[np.frombuffer(char.encode(), np.uint8)]


_code_values: list[np.ndarray] = []


def _word_ids(m: Model, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the distinct words one after another, their bounds, and the number of each word's distinct form."""
    if not _code_values:
        _code_values.append(B.mix64(np.arange(1, 0x110001, dtype=np.uint64)))
    up, down = B._power_tables(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_code_values[0][codes] * up[: len(codes)], out=total[1:])
    ends = np.append(starts[1:], len(codes))
    lengths = ends - starts
    form, _ = pd.factorize(B.mix64((total[ends] - total[starts]) * down[starts] + lengths.astype(np.uint64)))
    n_forms = int(form.max()) + 1
    sample = np.empty(n_forms, np.int64)
    sample[form[::-1]] = np.arange(len(starts))[::-1]
    lengths = lengths[sample]
    at = _spread(starts[sample], lengths)
    chars, symbols = codes[at], m.symbol[codes[at]]
    form_of = np.repeat(np.arange(n_forms), lengths)
    symbols = np.where(symbols < 0, -1 - chars.astype(np.int64), symbols)  # an unknown character keeps its code
    bounds = np.cumsum(lengths) - lengths
    long = np.flatnonzero(lengths > LONG_WORD)
    parts = []
    for w in long:
        s = _merge_heap(m, symbols[bounds[w] : bounds[w] + lengths[w]])
        parts.append((np.full(len(s), w), s))
    usual = np.flatnonzero(lengths <= LONG_WORD)
    inside = np.isin(form_of, usual) if len(long) else slice(None)
    flat, of = symbols[inside], form_of[inside]
    if len(usual):
        s, w = _merge_rounds(m, flat, np.searchsorted(of, usual))
        parts.append((usual[w], s))
    of, flat = (np.concatenate(x) for x in zip(*parts))
    if len(long):
        sort = np.argsort(of, kind="stable")
        of, flat = of[sort], flat[sort]
    odd = np.flatnonzero((flat < 0) | (flat >= m.n_ids))
    if len(odd):  # characters without an id become their bytes
        kinds, which = np.unique(flat[odd], return_inverse=True)
        spelt = [_bytes_of(m, chr(-1 - k) if k < 0 else m.extra[k - m.n_ids]) for k in kinds]
        widths = np.ones(len(flat), np.int64)
        widths[odd] = np.array([len(x) for x in spelt])[which]
        sources = np.concatenate([flat, *spelt])
        firsts = np.arange(len(flat))
        firsts[odd] = (len(flat) + np.cumsum([0, *map(len, spelt)])[:-1])[which]
        of, flat = np.repeat(of, widths), sources[_spread(firsts, widths)]
    return flat.astype(np.uint32), np.searchsorted(of, np.arange(n_forms + 1)), form


def encode_block(m: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one text after another with begin and end ids, and n + 1 offsets."""
    full = [((SPACE if m.prefix else "") + t).replace(" ", SPACE) if t else "" for t in texts]
    codes = np.frombuffer("".join(full).encode("utf-32-le"), np.uint32)
    text_at = np.cumsum([0, *map(len, full)])
    if not len(codes):
        return np.tile(np.array([m.bos, m.eos], np.uint32), len(texts)), np.arange(len(texts) + 1) * 2
    unknown = m.symbol[codes] < 0
    mark = codes == ord(SPACE)
    cut = np.ones(len(codes), bool)
    cut[1:] = (mark[1:] & ~mark[:-1]) | unknown[1:] | unknown[:-1]
    cut[text_at[:-1][text_at[:-1] < len(codes)]] = True
    starts = np.flatnonzero(cut)
    flat, bounds, form = _word_ids(m, codes, starts)
    # begin and end ids are words of their own, put before the first and after the last word of each text
    n_forms = len(bounds) - 1
    flat = np.concatenate([flat, np.array([m.bos, m.eos], np.uint32)])
    bounds = np.concatenate([bounds, bounds[-1] + np.array([1, 2])])
    word_at = np.searchsorted(starts, text_at)
    spots = np.concatenate([word_at[:-1], word_at[1:]])
    order = np.argsort(np.concatenate([np.arange(len(texts)) * 2, np.arange(len(texts)) * 2 + 1]), kind="stable")
    marks = np.concatenate([np.full(len(texts), n_forms), np.full(len(texts), n_forms + 1)])
    form = np.insert(form, spots[order], marks[order])
    lengths = np.diff(bounds)[form]
    ids = flat[_spread(bounds[form], lengths)]
    token_at = np.concatenate([[0], np.cumsum(lengths)])
    return ids, token_at[word_at + 2 * np.arange(len(texts) + 1)]


def decode_block(m: Model, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and their n + 1 offsets; the space put before a text goes."""
    starts, lengths = m.surface_at[ids], np.diff(m.surface_at)[ids]
    if m.prefix:
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        shown = np.flatnonzero(lengths > 0)
        firsts = shown[np.unique(rows[shown], return_index=True)[1]] if len(shown) else shown
        is_byte = np.isin(ids[firsts], m.byte_ids)
        firsts = firsts[(m.surface[starts[firsts]] == 0x20) & ~is_byte & (ids[firsts] != 0)]
        starts[firsts] += 1
        lengths[firsts] -= 1
    end = np.concatenate([[0], np.cumsum(lengths)])
    return m.surface[_spread(starts, lengths)], end[offsets]


def _list_array(kind: pa.DataType, offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    at = pa.py_buffer(offsets.astype(np.int32))
    if pa.types.is_list(kind):
        return pa.Array.from_buffers(kind, len(offsets) - 1, [None, at], children=[pa.array(values.view(np.int32))])
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(values))])


def tokenize(docs: DataFrame, model: bytes, packed: bool = False) -> DataFrame:
    """(doc_id, ids, decoded): ``ids`` the token ids with begin and end ids, ``decoded`` their text.

    ``ids`` is an array, or with ``packed`` 32-bit little-endian integers in a binary. Null text counts as empty: begin and end ids alone,
    decoded to an empty text. Texts are encoded whole; repeated rows give repeated rows. ``model`` is the content of the model file, so
    executors need no copy of it.
    """
    held = docs.sparkSession.sparkContext.broadcast(load_model(model))
    kind, width = (pa.binary(), 4) if packed else (pa.list_(pa.int32()), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            keys, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text")
            for b in B.blocks(texts, max_rows=4096):
                ids, at = encode_block(m, ["" if t is None else t for t in texts.slice(b.first, len(b)).to_pylist()])
                text, text_at = decode_block(m, ids, at)
                columns = [keys.slice(b.first, len(b)), _list_array(kind, at * width, ids.view(np.uint8) if packed else ids), _list_array(pa.binary(), text_at, text).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, ids {'binary' if packed else 'array<int>'}, decoded string")


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of packed tokens."""
    return tokens.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
