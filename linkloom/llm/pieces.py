"""Operator 12: SentencePiece encoding and decoding in vectorised merge rounds.

A model's pieces become flat arrays once, on the driver: which symbol a
character is, which pairs of symbols merge into which piece and how good that
piece is. In the tasks a run of texts is one array of symbols. It is cut
between characters that stand side by side in no piece, so no merge can cross
a cut; what is between two cuts is a *word*, and equal words of the run are
merged once.

A round finds each word's best pair (least rank, leftmost first) and merges
it in all words together. More than one place of a word is merged in the same
round only while the order of single merges would do the same: the places
have the same rank, don't overlap, and no merge before them makes a pair that
is as good. Then the arrays are compacted, and words without a pair left
are taken out, until none is left. A word that is not done after ``ROUNDS``
rounds (a very long run of blanks, say, which allows one merge a round) is
finished by the same rule from a heap of its pairs.

Decoding gathers the pieces' bytes; runs of byte pieces that are not UTF-8
give U+FFFD for every wrong byte, as the sentencepiece library does.

Models are BPE models with the identity normaliser and a dummy prefix; one
that shows anything else on the probes below is refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import mixed, slices, with_python

SPACE = 0x2581
NONE = np.int32(1 << 30)
ROUNDS = 200
_GOLD = np.uint64(0x9E3779B97F4A7C15)
PROBES = ("a  b ", " a", "\ta\n\nb", "ﬁ ａ é é", "　x​﻿", "A\x00b", "▁a", "日本語 🙂", "")


@dataclass(frozen=True)
class PieceModel:
    """Arrays of a model; symbols are the pieces' ids, then characters that only occur within pieces."""

    symbol_of: np.ndarray  # by code point; -1: in no piece
    letter_of: np.ndarray  # by code point; 0: in no piece
    beside: np.ndarray  # [letter, letter]: the two stand side by side in some piece
    keys: np.ndarray  # left << 32 | right, ascending
    merged: np.ndarray
    ranks: np.ndarray
    letters: np.ndarray  # code points of the symbols that are no pieces
    size: int
    byte_ids: np.ndarray
    unknown: int
    piece_bytes: np.ndarray
    piece_bounds: np.ndarray
    is_byte: np.ndarray
    is_control: np.ndarray


def load_model(path: str) -> PieceModel:
    """The arrays of the model file ``path``; ValueError if it is of another kind than the module says."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(size)]
    is_byte = np.array([sp.is_byte(i) for i in range(size)])
    is_control = np.array([sp.is_control(i) for i in range(size)])
    plain = [i for i in range(size) if not (is_byte[i] or is_control[i] or sp.is_unknown(i) or sp.is_unused(i))]
    symbol = {names[i]: i for i in plain}
    letters = sorted({c for i in plain for c in names[i]})
    extra = [c for c in letters if c not in symbol]
    symbol |= {c: size + j for j, c in enumerate(extra)}
    scores = sorted({-sp.get_score(i) for i in plain})
    rank_of = {s: r for r, s in enumerate(scores)}
    pairs = sorted(((symbol[names[i][:k]] << 32) | symbol[names[i][k:]], i, rank_of[-sp.get_score(i)])
                   for i in plain for k in range(1, len(names[i])) if names[i][:k] in symbol and names[i][k:] in symbol)
    symbol_of, letter_of = np.full(0x110000, -1, np.int32), np.zeros(0x110000, np.int32)
    for j, c in enumerate(letters):
        symbol_of[ord(c)], letter_of[ord(c)] = symbol[c], j + 1
    beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
    for i in plain:
        at = letter_of[[ord(c) for c in names[i]]]
        beside[at[:-1], at[1:]] = True
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32) if is_byte.sum() == 256 else np.zeros(0, np.int32)
    shown = [bytes([int(n[3:5], 16)]) if b else b"" if c else b" \xe2\x81\x87 " if i == sp.unk_id() else n.replace("▁", " ").encode()
             for i, (n, b, c) in enumerate(zip(names, is_byte, is_control))]
    out = PieceModel(symbol_of, letter_of, beside, *(np.array(x, t) for x, t in zip(zip(*pairs), (np.int64, np.int32, np.int32))),
                     np.array([ord(c) for c in extra], np.int64), size, byte_ids, sp.unk_id(), np.frombuffer(b"".join(shown), np.uint8),
                     np.cumsum([0, *map(len, shown)]), is_byte, is_control)
    for probe in PROBES:
        data = probe.encode()
        ids, bounds = encode_run(out, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        if ids.tolist() != sp.encode(probe) or decode_run(out, ids, bounds) != [sp.decode(ids.tolist())]:
            raise ValueError(f"{path} is no BPE model with the identity normaliser and a dummy prefix")
    return out


def _look_up(model: PieceModel, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and piece that two symbols give; rank NONE where they give none."""
    key = (left.astype(np.int64) << 32) + right
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    there = model.keys[at] == key
    return np.where(there, model.ranks[at], NONE), model.merged[at]


def _by_heap(model: PieceModel, symbols: list[int]) -> list[int]:
    """One word's merges one by one, best rank and then leftmost first."""
    after, before = list(range(1, len(symbols))) + [-1], list(range(-1, len(symbols) - 1))
    alive = [True] * len(symbols)
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(at: list[int]) -> None:
        at = [i for i in at if i >= 0 and after[i] >= 0]
        left, right = [symbols[i] for i in at], [symbols[after[i]] for i in at]
        if at:
            for i, x, y, r, m in zip(at, left, right, *(v.tolist() for v in _look_up(model, np.array(left), np.array(right)))):
                if r < NONE:
                    heapq.heappush(heap, (r, i, x, y, m))

    offer(list(range(len(symbols))))
    while heap:
        _, i, x, y, m = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or symbols[i] != x or symbols[j] != y:
            continue
        symbols[i], alive[j], after[i] = m, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer([before[i], i])
    return [s for s, live in zip(symbols, alive) if live]


def merge_words(model: PieceModel, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words (end to end, by ``lengths``) with all merges made; and the word of each."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.full(len(symbols), NONE, np.int32)
    piece = np.zeros(len(symbols), np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner], piece[inner] = _look_up(model, symbols[inner], symbols[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rounds = 0
    while len(word):
        lead = np.flatnonzero(np.diff(word, prepend=-1))
        size = np.diff(np.append(lead, len(word)))
        best = np.repeat(np.minimum.reduceat(rank, lead), size)
        over = best == NONE
        if over.any():
            done.append((symbols[over], word[over]))
            symbols, word, rank, piece, best = (x[~over] for x in (symbols, word, rank, piece, best))
            if not len(word):
                break
        if rounds == ROUNDS:
            for w in np.split(np.arange(len(word)), np.flatnonzero(np.diff(word)) + 1):
                left = _by_heap(model, symbols[w].tolist())
                done.append((np.array(left, symbols.dtype), np.full(len(left), word[w[0]])))
            break
        rounds += 1
        at = np.flatnonzero(rank == best)
        # Of places that overlap every other one, from the left.
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1] + 1
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at = at[nth % 2 == 0]
        result = piece[at]
        # A merge that makes a pair no worse is the last one of its word in this round.
        left = symbols[at - 1]
        beside = np.flatnonzero(at[1:] == at[:-1] + 2) + 1
        left[beside] = result[beside - 1]
        has_left = (at > 0) & (word[at - 1] == word[at])
        far = np.minimum(at + 2, len(word) - 1)
        has_right = (at + 2 < len(word)) & (word[far] == word[at])
        ends = has_left & (_look_up(model, left, result)[0] <= best[at]) | has_right & (_look_up(model, result, symbols[far])[0] <= best[at])
        before = np.cumsum(ends) - ends
        first = np.searchsorted(word[at], word[at])
        keep = before == before[first]
        at, result = at[keep], result[keep]
        symbols[at] = result
        stays = np.ones(len(word), bool)
        stays[at + 1] = False
        symbols, word, rank, piece = (x[stays] for x in (symbols, word, rank, piece))
        at = at - np.arange(len(at))
        near = np.concatenate([at, at[at > 0] - 1])
        rank[near] = NONE
        near = near[near + 1 < len(word)]
        near = near[word[near] == word[near + 1]]
        rank[near], piece[near] = _look_up(model, symbols[near], symbols[near + 1])
    symbols, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*done) if done else ((), ())))
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def _tokens(model: PieceModel, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols, and how many each has: characters that are no piece are spelt in bytes (or are unknown)."""
    odd = (symbols < 0) | (symbols >= model.size)
    if not odd.any():
        return symbols.astype(np.int32), np.ones(len(symbols), np.int64)
    at = symbols[odd].astype(np.int64)
    points = -at - 1
    own = at >= 0
    points[own] = model.letters[at[own] - model.size]
    if not len(model.byte_ids):
        out = symbols.astype(np.int32)
        out[odd] = model.unknown
        return out, np.ones(len(symbols), np.int64)
    count = np.ones(len(symbols), np.int64)
    count[odd] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    spelt = model.byte_ids[np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)]
    out = np.empty(int(count.sum()), np.int32)
    mark = np.repeat(odd, count)
    out[mark], out[~mark] = spelt, symbols[~odd]
    return out, count


def _valid(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The run as text; rows that are not UTF-8 have U+FFFD for their wrong bytes."""
    try:
        return data.tobytes().decode(), data, offsets
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        offsets = np.cumsum([0, *(len(r.encode()) for r in rows)])
        text = "".join(rows)
        return text, np.frombuffer(text.encode(), np.uint8), offsets


def encode_run(model: PieceModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that lie end to end as UTF-8, and the texts' bounds in them."""
    text, data, offsets = _valid(data, offsets)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    some = np.diff(begin) > 0
    # A blank before every text, and all blanks as U+2581.
    row = np.repeat(np.arange(len(some)), np.diff(begin))
    whole = np.full(len(codes) + int(some.sum()), SPACE, np.int64)
    whole[np.arange(len(codes)) + np.cumsum(some)[row] if len(codes) else []] = np.where(codes == 0x20, SPACE, codes)
    begin = begin + np.concatenate([[0], np.cumsum(some)])
    if not len(whole):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    letter = model.letter_of[whole]
    cut = np.ones(len(whole), bool)
    cut[1:] = ~model.beside[letter[:-1], letter[1:]]
    cut[begin[:-1][some]] = True
    lead = np.flatnonzero(cut)
    length = np.diff(np.append(lead, len(whole)))
    # Equal words once: told by a hash, and compared.
    place = np.arange(len(whole)) - np.repeat(lead, length)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(whole.astype(np.uint64) + place.astype(np.uint64) * _GOLD))])
    name = total[lead + length] - total[lead]
    _, sample, word = np.unique(mixed(name) + length.astype(np.uint64), return_index=True, return_inverse=True)
    if (length[sample][word] != length).any() or (whole[np.repeat(lead[sample][word], length) + place] != whole).any():
        sample = word = np.arange(len(lead))
    size = length[sample]
    inside = np.repeat(lead[sample] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    symbols = model.symbol_of[whole[inside]].astype(np.int64)
    symbols = np.where(symbols < 0, -whole[inside] - 1, symbols)
    symbols, owner = merge_words(model, symbols, size)
    ids, count = _tokens(model, symbols)
    held = np.bincount(owner, count, len(sample)).astype(np.int64)
    first = np.cumsum(held) - held
    many = held[word]
    out = ids[np.repeat(first[word] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    return out, np.concatenate([[0], np.cumsum(many)])[np.searchsorted(lead, begin)]


def _spelt(model: PieceModel, ids: np.ndarray) -> str:
    """A text whose byte pieces are not UTF-8 throughout: every byte that starts no character is U+FFFD."""
    out, held = [], b""

    def flush() -> None:
        nonlocal held
        while held:
            for n in (1, 2, 3, 4):
                try:
                    out.append(held[:n].decode())
                    held = held[n:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                held = held[1:]

    for i in ids.tolist():
        piece = model.piece_bytes[model.piece_bounds[i]:model.piece_bounds[i + 1]].tobytes()
        if model.is_byte[i]:
            held += piece
        else:
            flush()
            out.append(piece.decode())
    flush()
    return "".join(out)


def decode_run(model: PieceModel, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of id sequences that lie end to end."""
    size = np.diff(model.piece_bounds)[ids]
    start = model.piece_bounds[ids]
    # The blank that begins a text's first piece is the dummy prefix.
    shown = np.flatnonzero(~model.is_control[ids])
    first = np.searchsorted(shown, bounds[:-1])
    ok = first < len(shown)
    lead = shown[first[ok]]
    lead = lead[lead < bounds[1:][ok]]
    blank = lead[(size[lead] > 0) & ~model.is_byte[ids[lead]] & (ids[lead] != model.unknown)]
    blank = blank[model.piece_bytes[start[blank]] == 0x20]
    size[blank] -= 1
    start = start.copy()
    start[blank] += 1
    at = np.concatenate([[0], np.cumsum(size)])
    data = model.piece_bytes[np.repeat(start - at[:-1], size) + np.arange(at[-1])].tobytes()
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        try:
            out.append(data[at[a]:at[b]].decode())
        except UnicodeDecodeError:
            text = _spelt(model, ids[a:b])
            out.append(text[1:] if np.isin(np.arange(a, b), blank).any() else text)
    return out


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *, decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ids array<int>, and with ``decoded`` also decoded string.

    No begin or end ids. Null and empty texts have no ids and decode to the
    empty text; repeated rows and null ids are kept as they are, an empty
    table gives no rows, other columns are not looked at. Very long texts are
    looked at one by one.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "t"):
            ids, bounds = encode_run(model.value, data, offsets)
            columns = [batch.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
            if decoded:
                columns.append(pa.array(decode_run(model.value, ids, bounds), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][:len(columns)])

    rows = with_python(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(encoded, f"id {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the text of its ids (array<int>) as decoded; null ids and null arrays give nothing. ValueError for an id that no piece has."""
    model = encoded.sparkSession.sparkContext.broadcast(load_model(model_path))
    names, schema = encoded.columns, encoded.schema

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[i for i in x or () if i is not None] for x in batch.column(ids_col).to_pylist()]
            ids = np.array([i for x in held for i in x], np.int64)
            if len(ids) and not 0 <= ids.min() <= ids.max() < model.value.size:
                raise ValueError("an id that no piece has")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decode_run(model.value, ids, np.cumsum([0, *map(len, held)])), pa.string())], [*names, "decoded"])

    return with_python(encoded).mapInArrow(texts, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, decoded string")
