"""SentencePiece encoding and decoding over a lattice of pieces.

A word is a space mark with what follows it; no piece reaches over its start. The distinct words
of a slice of texts are exploded into substrings of bounded length, character by character as long
as some piece begins so, and joined to the piece table by hash: the edges of the lattice, grouped
by word. A fold over the edges then cuts every word. What it folds depends on the model:

- merge models (byte-pair encoding): among the edges that unite two neighbouring parts the one of
  the best piece is taken, the leftmost of equals, until there is none. This is what such a model
  defines; the best path through the lattice is another segmentation.
- unigram models: the best path (Viterbi), see ``viterbi``.

Words of each task are cut once. Characters that no piece covers become byte pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .tables import column

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Longer words are cut one by one by a heap; shorter ones all at once.
SHORT = 32
#: Words that a task remembers before it starts afresh, and bytes of text that it takes at a time: both bound its memory.
REMEMBERED = 1 << 18
SLICE = 1 << 20
_CHUNK = 1 << 12
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(1 << 30)


@dataclass(frozen=True)
class Pieces:
    """A piece table: text, rank (0 is best) and id of every ordinary piece, and the byte pieces."""

    text: tuple[str, ...]
    rank: tuple[int, ...]
    ids: tuple[int, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    size: int

    @staticmethod
    def load(path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        byte_ids = [i for i in range(n) if model.is_byte(i)]
        return Pieces(
            tuple(model.id_to_piece(i) for i in order), tuple(range(len(order))), tuple(order), tuple(byte_ids), model.unk_id(), n)


def _lookup_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing: place of a key is its low bits, or the next free ones."""
    size = 1 << max(4, int(len(keys) * 3).bit_length())
    table, held = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
    for key, value in zip(keys.tolist(), values.tolist()):
        at = key & (size - 1)
        while held[at] != -1:
            at = (at + 1) & (size - 1)
        table[at], held[at] = key, value
    return table, held


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.rank = dict(zip(pieces.text, pieces.rank))
        self.id_of_rank = np.array(pieces.ids, np.int32)
        self.longest = max(map(len, pieces.text), default=1)
        known: dict[int, int] = {}  # hash of a beginning of a piece -> rank, or _NONE if it is no piece
        for text, rank in self.rank.items():
            h = 0
            for i, ch in enumerate(text):
                h = (h * int(_STEP) + ord(ch) + 1) & (2**64 - 1)
                whole = i == len(text) - 1
                known[h] = rank if whole else known.get(h, int(_NONE))
        mixed = K.mix(np.array(list(known), np.uint64))
        self.table, self.held = _lookup_table(mixed, np.array(list(known.values()), np.int32))
        self.hashes = np.empty(0, np.uint64)  # of words cut so far, ascending
        self.forget()

    def forget(self) -> None:
        self.hashes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.begin, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Rank for each hash; _NONE for a mere beginning, -1 for no beginning at all."""
        mask = np.uint64(len(self.table) - 1)
        mixed = K.mix(keys)
        at = (mixed & mask).astype(np.int64)
        out = self.held[at]
        wrong = np.flatnonzero((self.table[at] != mixed) & (out != -1))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(mask)
            out[wrong] = self.held[at[wrong]]
            wrong = wrong[(self.table[at[wrong]] != mixed[wrong]) & (out[wrong] != -1)]
        return out

    def _lattice(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        """edge[word, start, length - 1]: rank of that substring, _NONE if it is no piece."""
        n = len(starts)
        edge = np.full((n, width, min(width, self.longest)), _NONE, np.int32)
        word = np.repeat(np.arange(n), lengths)
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        hashes = np.zeros(len(word), np.uint64)
        for more in range(edge.shape[2]):
            inside = place + more < lengths[word]
            word, place, hashes = word[inside], place[inside], hashes[inside]
            hashes = hashes * _STEP + codes[starts[word] + place + more].astype(np.uint64) + np.uint64(1)
            found = self._find(hashes)
            edge[word, place, more] = np.where(found < 0, _NONE, found)
            go = found >= 0
            word, place, hashes = word[go], place[go], hashes[go]
        return edge

    def _fold(self, edge: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """next[word, start]: end of the part that begins there, 0 where none does."""
        n, width, longest = edge.shape
        places = np.arange(width)
        nxt = np.where(places < lengths[:, None], places + 1, 0).astype(np.int64)
        live = np.arange(n)
        while len(live):
            ends = nxt[live]
            second = np.take_along_axis(np.pad(ends, ((0, 0), (0, 1))), ends, axis=1)  # end of the next part, 0 if none
            size = second - places
            ok = (ends > 0) & (second > 0) & (size <= longest)
            rank = np.where(ok, edge[live[:, None], places, np.where(ok, size - 1, 0)], _NONE)
            best = rank.argmin(axis=1)
            rows = np.flatnonzero(rank[np.arange(len(live)), best] < _NONE)
            live, best = live[rows], best[rows]
            middle = ends[rows, best]
            nxt[live, best] = second[rows, best]
            nxt[live, middle] = 0
        return nxt

    def _cut_long(self, word: str) -> list[int]:
        """The same fold for one long word: a heap of possible unions."""
        n = len(word)
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        alive = [True] * n

        def offer(a: int) -> None:
            b = right[a]
            if b < n and end[b] - a <= self.longest and (rank := self.rank.get(word[a:end[b]])) is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or right[a] != b or end[b] != stop:
                continue
            alive[b], end[a], right[a] = False, stop, right[b]
            if right[a] < n:
                left[right[a]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        return [i for part in (word[a:end[a]] for a in range(n) if alive[a]) for i in self._ids(part)]

    def _ids(self, part: str) -> list[int]:
        rank = self.rank.get(part)
        return [int(self.id_of_rank[rank])] if rank is not None else self._bytes(part)

    def _bytes(self, part: str) -> list[int]:
        if not self.pieces.byte_ids:
            return [self.pieces.unknown]
        return [self.pieces.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]

    def _cut(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(starts)
        for i in np.flatnonzero(lengths > SHORT).tolist():
            word = codes[starts[i]:starts[i] + lengths[i]].tobytes().decode("utf-32-le", "surrogatepass")
            out[i] = np.array(self._cut_long(word), np.int32)
        short = np.flatnonzero(lengths <= SHORT)
        short = short[np.argsort(lengths[short], kind="stable")]
        for at in range(0, len(short), _CHUNK):
            some = short[at:at + _CHUNK]
            width = int(lengths[some].max())
            edge = self._lattice(codes, starts[some], lengths[some], width)
            nxt = self._fold(edge, lengths[some])
            word, place = np.nonzero(nxt)
            rank = edge[word, place, nxt[word, place] - place - 1]
            ids = np.where(rank < _NONE, self.id_of_rank[np.minimum(rank, len(self.id_of_rank) - 1)], -1).astype(np.int32)
            cuts = np.searchsorted(word, np.arange(len(some) + 1))
            for j, i in enumerate(some.tolist()):
                out[i] = ids[cuts[j]:cuts[j + 1]]
            for j in np.unique(word[ids < 0]).tolist():  # with byte pieces
                span = slice(cuts[j], cuts[j + 1])
                parts = [
                    self._bytes(chr(codes[starts[some[j]] + p])) if x < 0 else [x]
                    for p, x in zip(place[span].tolist(), ids[span].tolist())]
                out[some[j]] = np.array([x for part in parts for x in part], np.int32)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and how many each text has."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.array([len(t) for t in marked], np.int64)
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        firsts = np.cumsum(sizes) - sizes
        space = codes == ord(SPACE)
        opens = space & ~np.concatenate(([False], space[:-1]))
        opens[firsts[sizes > 0]] = True
        starts = np.flatnonzero(opens)
        lengths = np.diff(np.append(starts, len(codes)))
        hashes = self._word_hashes(codes, starts, lengths)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            cut = self._cut(codes, starts[first[new]], lengths[first[new]])
            count = np.array([len(c) for c in cut], np.int64)
            begin = len(self.flat) + np.cumsum(count) - count
            hashes_all = np.concatenate((self.hashes, distinct[new]))
            order = np.argsort(hashes_all, kind="stable")
            self.slots = np.concatenate((self.slots, np.arange(len(self.begin), len(self.begin) + len(cut))))[order]
            self.hashes = hashes_all[order]
            self.flat = np.concatenate((self.flat, *cut))
            self.begin, self.count = np.concatenate((self.begin, begin)), np.concatenate((self.count, count))
            at = np.searchsorted(self.hashes, distinct)
        slot = self.slots[at][which]
        count = self.count[slot]
        total = np.cumsum(count)
        flat = self.flat[np.arange(total[-1]) + np.repeat(self.begin[slot] - (total - count), count)]
        upto = np.concatenate(([0], total))
        bounds = np.searchsorted(starts, np.append(firsts, len(codes)))
        return flat, np.diff(upto[bounds])

    @staticmethod
    def _word_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        values = K.mix(codes.astype(np.uint64) + np.uint64(1))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(values * K._powers(K._BASE, len(codes)), out=sums[1:])
        shift = K._powers(K._BASE_INVERSE, len(codes))[starts]
        return K.mix((sums[starts + lengths] - sums[starts]) * shift + lengths.astype(np.uint64))


class Decoder:
    """Bytes of the pieces end to end; a leading space of a text, which encoding adds, is dropped."""

    def __init__(self, pieces: Pieces):
        parts = [b""] * pieces.size
        for text, i in zip(pieces.text, pieces.ids):
            parts[i] = text.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for byte, i in enumerate(pieces.byte_ids):
            parts[i] = bytes([byte])
        self.lengths = np.array([len(p) for p in parts] + [0], np.int64)  # the last one is for ids outside the table
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts from all ids in turn and how many each text has."""
        ids = np.where((ids >= 0) & (ids < len(self.lengths) - 1), ids, len(self.lengths) - 1)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        data = self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - (ends - lengths), lengths)].tobytes()
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        texts = (data[x + (data[x:x + 1] == b" " and x < y):y] for x, y in zip(bounds, bounds[1:]))
        return [t.decode("utf-8", "replace") for t in texts]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: Pieces | None = None, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces and the ids of every row's text. Null and empty texts have no pieces;
    repeated rows are encoded alike; an empty table gives an empty result; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces or Pieces.load(path))  # a vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            for a, b, _, _ in K.text_slices(batch.column(1), SLICE):
                flat, counts = encoder.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "n_pieces", "ids"])

    source = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>")


def decode_pieces(encoded: DataFrame, ids_col: str = "ids", pieces: Pieces | None = None, path: str = MODEL, name: str = "decoded") -> DataFrame:
    """The rows with the decoded text added; null ids give null. Ids outside the table are skipped."""
    at = encoded.columns.index(ids_col)
    sent = encoded.sparkSession.sparkContext.broadcast(pieces or Pieces.load(path))
    schema = StructType(list(encoded.schema.fields)).add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists = part.column(at)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = decoder.decode_all(ids, counts)
                if lists.null_count:
                    texts = [t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return encoded.mapInArrow(run, schema)


def lattice_edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, start, end, piece_id, score): substrings of bounded length joined to the piece table."""
    spans = F.expr(
        f"explode(flatten(transform(sequence(1, length(word)), i -> transform(sequence(1, least({longest}, length(word) - i + 1)), "
        "n -> named_struct('start', i, 'end', i + n, 'piece', substring(word, i, n))))))")
    return words.select("word").distinct().select("word", spans.alias("s")).select("word", "s.*").join(pieces, "piece").select(
        "word", "start", "end", "piece_id", "score")


def viterbi(edges: DataFrame) -> DataFrame:
    """(word, ids, score): the best path of every word for unigram scores, by one fold over its edges.

    The fold keeps, for every position reached, the best score and path. Edges come by their end, so
    all that lead to a start are folded before it is used. Equal scores keep the edge seen first: the
    longer piece. Words that no path covers give null ids.
    """
    ordered = F.array_sort(F.collect_list(F.struct("end", "start", "piece_id", "score")))
    empty = F.expr("map(1, named_struct('score', 0D, 'ids', cast(array() AS array<int>)))")
    step = """(best, e) -> CASE WHEN best[e.start] IS NULL THEN best
        WHEN best[e.end] IS NOT NULL AND best[e.end].score >= best[e.start].score + e.score THEN best
        ELSE map_concat(map_filter(best, (k, v) -> k <> e.end), map(e.end,
            named_struct('score', best[e.start].score + e.score, 'ids', concat(best[e.start].ids, array(e.piece_id))))) END"""
    grouped = edges.select("word", "start", "end", F.col("piece_id").cast("int"), F.col("score").cast("double")).groupBy("word").agg(
        ordered.alias("edges")).withColumn("empty", empty)
    folded = grouped.withColumn("best", F.expr(f"aggregate(edges, empty, {step})")).withColumn("last", F.expr("best[length(word) + 1]"))
    return folded.select("word", F.col("last.ids").alias("ids"), F.col("last.score").alias("score"))
