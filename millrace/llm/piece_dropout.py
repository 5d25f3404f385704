"""SentencePiece encoding with seeded merge-dropout, and its decoding.

Encoding follows the merge order of a public BPE piece model: an agenda holds the candidate merges
of a chunk, best score first and leftmost on ties. With dropout a candidate is skipped for good if
a keyed hash of the chunk, the row's key, the occurrence's number and the place of the merge falls
below the rate; skipped merges leave smaller pieces, so equal words are cut in different ways. A rate of 0 gives the
model's own segmentation.

No piece of the model holds a space after its first character or a line feed, so merges never
cross from one chunk (spaces with the word after them) into the next. Each occurrence of a chunk has
its own draw. The distinct chunks of a slice of texts are cut without dropout first; an occurrence that
skips none of the merges made there has the same pieces, only the others are cut one by one. Chunks of
one length are rows of a matrix, and in each round every row takes the best entry of its agenda.
Characters outside the vocabulary become byte pieces, the model's space mark among them, so
decoding gives back every text exactly.

Encoding and decoding are projections: no shuffle; memory is one slice of texts or one text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import wordscan as W

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
LONGEST = 32  # longer chunks are processed one by one
SLICE_CHARS = 1 << 20
BATCH_TEXTS = 1000  # texts that are Python strings at once
MASK = (1 << 64) - 1
OCCURRENCES = 1 << 16  # occurrences whose draws are made at once
HASHED_CHARS = 1 << 18  # characters whose chunks are hashed at once
PLACES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class Dropout:
    rate: float = 0.1
    seed: int = 0


class PieceModel:
    """The vocabulary of a piece model: ids and scores of pieces, ids of bytes, bytes of ids."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=proto)
        self.score, self.id, self.bytes_of, self.byte_id = {}, {}, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(SPACE_MARK, " ")
                if " " in text.lstrip(" ") or "\n" in text:
                    raise ValueError(f"piece {i} crosses chunks")
                self.id[text], self.score[text] = i, model.get_score(i)
                self.bytes_of.append(text.encode())
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces, so decoding would lose characters")

        self.prepare_pairs()

    def prepare_pairs(self) -> None:
        """Symbols are pieces, or characters that only occur inside pieces; a sorted table gives
        rank and result of every merge of two symbols."""
        symbol = dict(self.id)
        for piece in self.id:
            for c in piece:
                symbol.setdefault(c, len(symbol) + len(self.bytes_of))
        keys, ranks, merged = [], [], []
        for piece, i in self.id.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(-self.score[piece])
                    merged.append(i)
        order = np.argsort(keys)
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(1) << 62)
        self.pair_ranks = np.append(np.array(ranks, dtype=np.float64)[order], np.inf)
        self.pair_merged = np.append(np.array(merged, dtype=np.int64)[order], -1)
        self.symbol_of = np.full(0x110000, -1, dtype=np.int64)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i

    def agenda_of_chunk(self, chunk: str, key: int, limit: int) -> list[int]:
        """Piece ids of one chunk; ``key`` is its keyed hash, ``limit`` the rate as a share of 2^64."""
        n, score = len(chunk), self.score
        # Symbols are spans of the chunk: end[i] for a symbol that starts at i, 0 if none does.
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-score[chunk[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if chunk[i : i + 2] in score]
        heapq.heapify(agenda)
        while agenda:
            _, left, mid, stop = heapq.heappop(agenda)
            if end[left] != mid or mid >= n or end[mid] != stop:
                continue  # one of its symbols has been merged since
            if limit and place_hash(key, left, mid, stop) < limit:
                continue
            end[left], end[mid] = stop, 0
            if stop < n:
                before[stop] = left
                s = score.get(chunk[left : end[stop]])
                if s is not None:
                    heapq.heappush(agenda, (-s, left, stop, end[stop]))
            if left > 0:
                first = before[left]
                s = score.get(chunk[first:stop])
                if s is not None:
                    heapq.heappush(agenda, (-s, first, left, stop))
        out, i = [], 0
        while i < n:
            piece = self.id.get(chunk[i : end[i]])
            out += [piece] if piece is not None else [self.byte_id[b] for b in chunk[i : end[i]].encode()]
            i = end[i]
        return out

    def agendas(self, chars: np.ndarray, key: np.ndarray, limit: int, log: list | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Segmentations of chunks of one length (rows of ``chars``): groups of ``(rows, symbols,
        starts)`` by number of symbols. ``log`` receives ``(rows, places)`` of the merges made."""
        rows, length = chars.shape
        active, symbols = np.arange(rows), self.symbol_of[chars]
        starts = np.broadcast_to(np.arange(length + 1, dtype=np.int64), (rows, length + 1)).copy()
        rank, merged = self.candidates(symbols[:, :-1], symbols[:, 1:], key[:, None], starts[:, :-2], starts[:, 1:-1], starts[:, 2:], limit)
        groups = []
        while len(active):
            width = symbols.shape[1]
            at = rank.argmin(axis=1) if width > 1 else np.zeros(len(active), np.int64)
            every = np.arange(len(active))
            done = np.isinf(rank[every, at]) if width > 1 else np.ones(len(active), bool)
            if done.any():
                groups.append((active[done], symbols[done], starts[done]))
                go = ~done
                active, symbols, starts, rank, merged, key, at = (x[go] for x in (active, symbols, starts, rank, merged, key, at))
                every = np.arange(len(active))
                if not len(active):
                    break
            # Columns right of the merge move one to the left.
            new = merged[every, at]
            if log is not None:
                log.append((active, places(starts[every, at], starts[every, at + 1], starts[every, at + 2])))
            column = np.arange(width - 1)
            symbols = np.where(column <= at[:, None], symbols[:, :-1], symbols[:, 1:])
            symbols[every, at] = new
            starts = np.where(np.arange(width) <= at[:, None], starts[:, :-1], starts[:, 1:])
            if width > 2:
                column = np.arange(width - 2)
                rank = np.where(column < at[:, None], rank[:, :-1], rank[:, 1:])
                merged = np.where(column < at[:, None], merged[:, :-1], merged[:, 1:])
                for side in (at - 1, at):  # the pairs on both sides of the new symbol
                    own = np.flatnonzero((side >= 0) & (side < width - 2))
                    j = side[own]
                    rank[own, j], merged[own, j] = self.candidates(
                        symbols[own, j], symbols[own, j + 1], key[own], starts[own, j], starts[own, j + 1], starts[own, j + 2], limit
                    )
        return groups

    def candidates(self, left, right, key, begin, mid, stop, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merges; an infinite rank if there is no such piece or it is skipped."""
        pair = np.where((left >= 0) & (right >= 0), left << 32 | right, -1)
        at = np.searchsorted(self.pair_keys, pair)
        found = self.pair_keys[at] == pair
        if limit:
            found &= W.mix(key ^ places(begin, mid, stop)) >= np.uint64(limit)
        return np.where(found, self.pair_ranks[at], np.inf), self.pair_merged[at]

    def segment(
        self, chars: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, limit: int, log: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of the chunks ``chars[begin : begin + size]``; ``log`` receives the
        chunks and places of the merges made in chunks of up to ``LONGEST`` characters."""
        counts, pieces = np.zeros(len(begin), dtype=np.int64), []
        for length in np.unique(size).tolist():
            own = np.flatnonzero(size == length)
            if length > LONGEST:
                for i in own.tolist():
                    text = chars[begin[i] : begin[i] + length].astype("<u4").tobytes().decode("utf-32-le")
                    pieces.append((np.array([i]), np.array([self.agenda_of_chunk(text, int(key[i]), limit)])))
                continue
            for at in range(0, len(own), 1 << 16):
                part = own[at : at + (1 << 16)]
                text = chars[begin[part][:, None] + np.arange(length)]
                own_log = None if log is None else []
                made = self.agendas(text, key[part], limit, own_log)
                if log is not None:
                    log += [(part[rows], where) for rows, where in own_log]
                for rows, symbols, starts in made:
                    plain = ((symbols >= 0) & (symbols < len(self.bytes_of))).all(axis=1)
                    pieces.append((part[rows[plain]], symbols[plain]))
                    for row, own_symbols, own_starts in zip(rows[~plain].tolist(), symbols[~plain].tolist(), starts[~plain].tolist()):
                        ids = []
                        for s, at_char in zip(own_symbols, own_starts):
                            known = 0 <= s < len(self.bytes_of)
                            ids += [s] if known else [self.byte_id[b] for b in chr(text[row, at_char]).encode()]
                        pieces.append((part[row : row + 1], np.array([ids])))
        for rows, ids in pieces:
            counts[rows] = ids.shape[1]
        offsets = np.concatenate(([0], np.cumsum(counts)))
        values = np.empty(offsets[-1], dtype=np.int32)
        for rows, ids in pieces:
            values[offsets[rows][:, None] + np.arange(ids.shape[1])] = ids
        return offsets, values

    def encode(self, texts: list[str | None], salts: np.ndarray, drop: "Dropout") -> list[np.ndarray | None]:
        """Piece ids of texts; null for null."""
        out: list[np.ndarray | None] = [None if t is None else np.empty(0, np.int32) for t in texts]
        rows, pending = [], 0
        for i, t in enumerate(texts):
            if t:
                rows.append(i)
                pending += len(t)
            if rows and (pending >= SLICE_CHARS or i == len(texts) - 1):
                for row, ids in zip(rows, self.encode_slice([texts[r] for r in rows], salts[rows], drop)):
                    out[row] = ids
                rows, pending = [], 0
        return out

    def encode_slice(self, texts: list[str], salts: np.ndarray, drop: "Dropout") -> list[np.ndarray]:
        chars = np.frombuffer("".join([" " + t for t in texts]).encode("utf-32-le"), dtype=np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        space, feed = chars == 0x20, chars == 0x0A
        start = np.empty(len(chars), dtype=bool)
        start[1:] = feed[1:] | feed[:-1] | (space[1:] & ~space[:-1])
        start[bounds[:-1]] = True
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, len(chars)))
        first = np.searchsorted(begin, bounds)
        del start, space, feed
        chunk = chunk_hashes(chars, begin, size)
        _, sample, inverse = np.unique(chunk, return_index=True, return_inverse=True)
        log: list = []
        offsets, values = self.segment(chars, begin[sample], size[sample], chunk[sample], 0, log)
        source, count = offsets[inverse], np.diff(offsets)[inverse]
        if drop.rate > 0:
            limit = min(int(drop.rate * (1 << 64)), MASK)
            nth = np.arange(len(begin)) - np.repeat(first[:-1], np.diff(first))
            draw = W.mix(np.repeat(salts, np.diff(first)) + nth.astype(np.uint64))
            key = W.mix(chunk ^ W.mix(draw + np.uint64(drop.seed * 1_000_003 & MASK)))
            own = np.flatnonzero(self.skipping(inverse, key, len(sample), log, limit) | (size > LONGEST))
            more, own_values = self.segment(chars, begin[own], size[own], key[own], limit)
            source[own], count[own] = len(values) + more[:-1], np.diff(more)
            values = np.concatenate((values, own_values))
        upto = np.concatenate(([0], np.cumsum(count)))
        ids = values[np.repeat(source - upto[:-1], count) + np.arange(upto[-1])]
        ends = upto[first]
        return [ids[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def skipping(self, chunk: np.ndarray, key: np.ndarray, chunks: int, log: list, limit: int) -> np.ndarray:
        """Which occurrences skip a merge that their chunk makes without dropout (``log``)."""
        out = np.zeros(len(chunk), dtype=bool)
        if not log:
            return out
        rows, where = (np.concatenate(x) for x in zip(*log))
        where = where[np.argsort(rows, kind="stable")]
        merges = np.bincount(rows, minlength=chunks)
        begin = np.cumsum(merges) - merges
        for at in range(0, len(chunk), OCCURRENCES):
            part = chunk[at : at + OCCURRENCES]
            n = merges[part]
            upto = np.cumsum(n)
            owner = np.repeat(np.arange(len(part)), n)
            place = where[np.repeat(begin[part] - upto + n, n) + np.arange(len(owner))]
            out[at + owner[W.mix(key[at : at + OCCURRENCES][owner] ^ place) < np.uint64(limit)]] = True
        return out

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        raw = b"".join([table[i] for i in ids.tolist()])
        # The space before the first word was added by the encoder.
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def chunk_hashes(chars: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the chunks ``chars[begin : begin + size]``, which follow one another. A chunk's hash
    does not depend on its place, so pieces of bounded size are hashed one after the other."""
    out = np.empty(len(begin), dtype=np.uint64)
    at = 0
    while at < len(begin):
        end = max(at + 1, int(np.searchsorted(begin, begin[at] + HASHED_CHARS)))
        first = begin[at]
        own, n = begin[at:end] - first, size[at:end]
        sums, downs = W.prefix_hash(W.mix(chars[first : first + own[-1] + n[-1]].astype(np.uint64) + np.uint64(1)), W.SEQUENCE_BASES[1])
        out[at:end] = W.mix((sums[own + n] - sums[own]) * downs[own] + n.astype(np.uint64))
        at = end
    return out


def places(begin: np.ndarray, mid: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return begin.astype(np.uint64) * PLACES[0] ^ mid.astype(np.uint64) * PLACES[1] ^ stop.astype(np.uint64) * PLACES[2]


def place_hash(key: int, left: int, mid: int, stop: int) -> int:
    """Keyed hash of the place of a merge in a chunk."""
    x = (key ^ left * int(PLACES[0]) ^ mid * int(PLACES[1]) ^ stop * int(PLACES[2])) & MASK
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & MASK
    return x ^ x >> 31


@lru_cache(maxsize=2)
def load(proto: bytes) -> PieceModel:
    return PieceModel(proto)


def read_model(path: str) -> bytes:
    """The model file, about half a megabyte, read once by the driver and sent with the function."""
    with open(path, "rb") as f:
        return f.read()


def encode(text: Column, key: Column, drop: Dropout = Dropout(), model_path: str = MODEL_PATH) -> Column:
    """``array<int>`` of piece ids; null for null, empty for empty texts. ``key`` is a long that
    seeds the draws of a row; rows with equal keys and texts get equal ids."""
    proto = read_model(model_path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array, keys: pa.Array) -> pa.Array:
        model = load(proto)
        made = [id_lists(model.encode(plain, salts, drop)) for plain, salts in text_batches(texts, row_salts(keys, drop))]
        return pa.concat_arrays(made)

    return encoded.asNondeterministic()(text, key)


def row_salts(keys: pa.Array, drop: Dropout) -> np.ndarray:
    return W.mix(np.asarray(keys.fill_null(0)).astype(np.int64).view(np.uint64) + np.uint64(drop.seed & MASK))


def text_batches(texts: pa.Array, salts: np.ndarray) -> Iterator[tuple[list[str | None], np.ndarray]]:
    """Texts and salts of ``BATCH_TEXTS`` rows at a time; one empty batch if there are no rows."""
    for at in range(0, max(len(texts), 1), BATCH_TEXTS):
        yield texts.slice(at, BATCH_TEXTS).to_pylist(), salts[at : at + BATCH_TEXTS]


def id_lists(parts: list[np.ndarray | None]) -> pa.Array:
    """Lists of ids, null for None."""
    offsets = np.cumsum([0, *(0 if p is None else len(p) for p in parts)]).astype(np.int32)
    some = [p for p in parts if p is not None]
    values = pa.array(np.concatenate(some) if some else np.empty(0, np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([p is None for p in parts], pa.bool_()))


def decode(ids: Column, model_path: str = MODEL_PATH) -> Column:
    """The text of an array of piece ids; null for null. Ids are taken in any segmentation."""
    proto = read_model(model_path)

    @F.arrow_udf(T.StringType())
    def decoded(lists: pa.Array) -> pa.Array:
        model, flat, at, out = load(proto), np.asarray(lists.flatten()), 0, []
        for size in lists.value_lengths():
            size = size.as_py()
            out.append(None if size is None else model.decode(flat[at : at + size]))
            at += size or 0
        return pa.array(out, pa.string())

    return decoded(ids)


ROUND_TRIP = T.StructType([T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])


def round_trip(text: Column, key: Column, drop: Dropout = Dropout(), model_path: str = MODEL_PATH) -> Column:
    """``pieces`` as of ``encode`` and whether ``decode`` gives the text back, in one pass."""
    proto = read_model(model_path)

    @F.arrow_udf(ROUND_TRIP)
    def both(texts: pa.Array, keys: pa.Array) -> pa.Array:
        model, made = load(proto), []
        for plain, salts in text_batches(texts, row_salts(keys, drop)):
            parts = model.encode(plain, salts, drop)
            same = [(None if ids is None else model.decode(ids)) == text for ids, text in zip(parts, plain)]
            made.append(pa.StructArray.from_arrays([id_lists(parts), pa.array(same, pa.bool_())], names=ROUND_TRIP.names))
        return pa.concat_arrays(made)

    return both.asNondeterministic()(text, key)


def with_pieces(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", out: str = "pieces",
    drop: Dropout = Dropout(), model_path: str = MODEL_PATH,
) -> DataFrame:
    """All rows and columns of ``df`` and the array ``out``; a column of that name is replaced.
    Rows of equal id and text get equal pieces, null ids are allowed."""
    return df.withColumn(out, encode(F.col(f"`{text_col}`"), F.xxhash64(f"`{id_col}`"), drop, model_path))


def encoded_and_decoded(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", drop: Dropout = Dropout(), model_path: str = MODEL_PATH,
) -> DataFrame:
    """``id_col``, ``pieces``, ``n_pieces`` and ``lossless``: whether decoding gives the text back."""
    made = round_trip(F.col(f"`{text_col}`"), F.xxhash64(f"`{id_col}`"), drop, model_path)
    back = df.select(F.col(f"`{id_col}`").alias("id"), made.alias("made"))
    count = F.coalesce(F.size("made.pieces"), F.lit(0)).cast("long")
    return back.select(F.col("id").alias(id_col), count.alias("n_pieces"), "made.pieces", "made.lossless")
