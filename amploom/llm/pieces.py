"""SentencePiece encoding and decoding by a shared-prefix forward search.

A text is marked (a space becomes the mark, one is put before the text) and cut where no piece of the model can
reach across: before a run of marks and around line breaks. The distinct units of a block are sorted, which is a
depth-first walk of their trie, and the forward state of each prefix is kept on a stack: a unit starts from the
state of the prefix that it shares with the one before.

For a unigram model the state of a prefix is its best score and last piece (Viterbi). For a BPE model the best
sum of scores isn't what SentencePiece gives, so the state is the last piece of the prefix's own BPE encoding: a
piece ends a prefix if and only if it and the last piece of what comes before stay apart when encoded together.
That is again a forward recurrence over prefixes, shared in the same way, and gives the library's ids.

Decoding gathers the pieces' bytes; byte pieces give their byte, and the first mark goes.

Nulls and odd rows: a null text has null ids and decodes to null; an empty text has no ids; doc_id may be null or
repeated, each row is its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_arrow, text_slices

MARK = "▁"
#: Pairs of pieces whose BPE encoding is remembered, in each of two generations.
PAIRS = 1 << 16
#: Bytes of units and their ids remembered from one block to the next, in each of two generations; longer units than LONG are not.
HELD_BYTES, LONG = 24 << 20, 64
#: Bytes that a remembered unit takes beside its own and its ids'.
_EACH = 190
#: Transitions of the piece automaton that are remembered beyond those of its trie.
STEPS = 1 << 18
#: Bytes of text that one step makes ids of: its arrays take about 30 times as much.
SLICE = 1 << 20


class Pieces:
    """A SentencePiece model: its pieces, their scores and bytes, and the automaton that finds the pieces ending at a character.

    A character that is no piece counts as a piece of its own with a number from ``len(text)`` on.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm, spec = m.normalizer_spec, m.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models that keep the text as it is")
        self.bpe, self.prefix = spec.model_type == 2, norm.add_dummy_prefix
        self.text = [p.piece for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4)}  # ordinary and user-defined
        self.size = array("i", map(len, self.text))
        self.score = array("d", [p.score for p in m.pieces])
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.lost = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.byte = [byte[b] for b in range(256)] if len(byte) == 256 else None
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any("\n" in p and p != "\n" for p in self.ids):
            raise ValueError("a piece reaches across words")
        self.raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type in (1, 4) else b" \xe2\x81\x87 " if p.type == 2 else b"" for p in m.pieces]
        self._automaton()
        self._whole = bytearray(len(self.text))  # 1: BPE arrives at this piece, 3: with steps out of order, 2: it doesn't, 0: not looked at yet
        self._left, self._right = (array("i", bytes(4 * len(self.text))) for _ in range(2))
        self._pairs: tuple[dict[int, bool], dict[int, bool]] = ({}, {})
        self.known = Units()  # a worker's later tasks find the units of its earlier ones

    def _automaton(self) -> None:
        """A trie of the pieces; ``fail`` leads to the longest proper suffix that is in the trie too, ``best`` is the longest piece that ends there, ``shorter`` the next one after a piece."""
        self.go: dict[int, int] = {}
        best, parent = array("i", [-1]), {}
        for piece, i in sorted(self.ids.items()):
            at = 0
            for c in piece:
                key = at << 21 | ord(c)
                to = self.go.get(key)
                if to is None:
                    to = self.go[key] = len(best)
                    best.append(-1)
                    parent[to] = key
                at = to
            best[at] = i
        self.trie = len(self.go)
        self.best, self.fail, self.shorter = best, array("i", bytes(4 * len(best))), array("i", [-1]) * len(self.text)
        depth = array("i", bytes(4 * len(best)))
        for s in range(1, len(best)):  # a parent has a smaller number than its children
            depth[s] = depth[parent[s] >> 21] + 1
        for s in sorted(range(1, len(best)), key=depth.__getitem__):
            up, c = parent[s] >> 21, parent[s] & 0x1FFFFF
            at = self.fail[up]
            while up and at and (at << 21 | c) not in self.go:
                at = self.fail[at]
            self.fail[s] = self.go.get(at << 21 | c, 0) if up else 0
            if best[s] >= 0:
                self.shorter[best[s]] = best[self.fail[s]]
            else:
                best[s] = best[self.fail[s]]

    def _step(self, state: int, c: int) -> int:
        """The state after one more character, where the trie doesn't say."""
        key, at = state << 21 | c, state
        while at and (at << 21 | c) not in self.go:
            at = self.fail[at]
        to = self.go.get(at << 21 | c, 0)
        if len(self.go) < self.trie + STEPS:
            self.go[key] = to
        return to

    def _merged(self, text: str) -> tuple[list[str], list[str]]:
        """BPE as defined: join the neighbours whose joint piece has the best score, leftmost first, until none is a piece. Also the parts before the last step."""
        parts, ids, score = list(text), self.ids, self.score
        before = parts
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = ids.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or score[p] > best):
                    best, at = score[p], i
            if at < 0:
                break
            before = parts
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts, before

    def _halves(self, p: int) -> bool:
        """Whether BPE arrives at this piece; notes the two pieces of its last step, and whether each step of it has a worse score than those before."""
        text, n = self.text[p], len(self.text)
        parts, before = self._merged(text)
        whole = len(parts) == 1
        if whole and len(text) > 1:
            of = lambda x: self.ids.get(x, n + ord(x[0]))
            self._left[p], self._right[p] = map(of, before)
            if any(len(x) > 1 and self.score[of(x)] <= self.score[p] for x in before):
                whole = self._whole[p] = 3
        self._whole[p] = self._whole[p] or (1 if whole else 2)
        return bool(whole)

    def _is_whole(self, p: int) -> bool:
        return self._whole[p] & 1 if self._whole[p] else self._halves(p)

    def _apart(self, a: int, b: int) -> bool:
        """Whether BPE of the two pieces' joint text gives them back."""
        key, (young, old) = a << 21 | b, self._pairs
        got = young.get(key)
        if got is None:
            got = old.get(key)
            if got is None:
                got = self._is_whole(b) and self._stay(a, b)
            if len(young) >= PAIRS:
                self._pairs = young, old = {}, young
            young[key] = got
        return got

    def _stay(self, a: int, b: int) -> bool:
        """Undo the steps that made the two pieces, the latest first: they join if their neighbours' piece had a better score than the step undone last; of equal scores the left one comes first."""
        text, ids, score, n = self.text, self.ids, self.score, len(self.text)
        size, x, y, limit, equal = self.size, a, b, -np.inf, False
        while True:
            c = ids.get((text[x] if x < n else chr(x - n)) + (text[y] if y < n else chr(y - n)))
            if c is not None and (score[c] > limit or equal and score[c] == limit):
                return False
            leaf_x, leaf_y = x >= n or size[x] == 1, y >= n or size[y] == 1
            if leaf_x and leaf_y:
                return True
            if leaf_y or not leaf_x and score[x] < score[y]:
                self._is_whole(x)
                if self._whole[x] != 1:
                    return self._merged(text[a] + text[b])[0] == [text[a], text[b]]
                limit, equal, x = score[x], False, self._right[x]
            else:
                self._is_whole(y)
                if self._whole[y] != 1:
                    return self._merged(text[a] + text[b])[0] == [text[a], text[b]]
                limit, equal, y = score[y], True, self._left[y]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit; ``units`` are sorted, and a unit goes on from the state of the prefix it shares with the one before."""
        state, last, score = [0], [0], [0.0]  # by length of the prefix: of the automaton, its last piece, its best sum of scores
        out, before = [], ""
        extend = self._extend_bpe if self.bpe else self._extend_best
        n_pieces, size, byte = len(self.text), self.size, self.byte
        for unit in units:
            n = 0
            for a, b in zip(before, unit):
                if a != b:
                    break
                n += 1
            del state[n + 1 :], last[n + 1 :], score[n + 1 :]
            extend(unit, n, state, last, score)
            before, at, found = unit, len(unit), []
            while at:
                p = last[at]
                if p < n_pieces:
                    found.append(p)
                    at -= size[p]
                else:
                    at -= 1
                    if byte is not None:
                        found.extend(byte[b] for b in reversed(unit[at].encode()))
                    elif not at or last[at] < n_pieces or self.bpe:
                        found.append(self.unknown)  # a unigram model gives unknown neighbours as one
            out.append(found[::-1])
        return out

    def _extend_bpe(self, unit: str, end: int, state: list[int], last: list[int], score: list[float]) -> None:
        """A piece ends a prefix where it and the last piece of what is before stay apart; the longest such piece is tried first."""
        s, go, best, shorter, size, n_pieces = state[-1], self.go, self.best, self.shorter, self.size, len(self.text)
        young = self._pairs[0]
        for c in map(ord, unit[end:]):
            to = go.get(s << 21 | c)
            s = self._step(s, c) if to is None else to
            end += 1
            p = best[s]
            while p >= 0:
                k = size[p]
                if k == end:
                    if self._is_whole(p):
                        break
                else:
                    a = last[end - k]
                    if a >= n_pieces:  # nothing joins a character that is no piece
                        if self._is_whole(p):
                            break
                    else:
                        ok = young.get(a << 21 | p)
                        if ok is None:
                            ok = self._apart(a, p)
                            young = self._pairs[0]
                        if ok:
                            break
                p = shorter[p]
            state.append(s)
            last.append(p if p >= 0 else n_pieces + c)

    def _extend_best(self, unit: str, end: int, state: list[int], last: list[int], score: list[float]) -> None:
        """Viterbi: the best sum of scores of each prefix, and the last piece of it."""
        s, go, best, shorter, size, worth, n_pieces = state[-1], self.go, self.best, self.shorter, self.size, self.score, len(self.text)
        for c in map(ord, unit[end:]):
            to = go.get(s << 21 | c)
            s = self._step(s, c) if to is None else to
            end += 1
            p, top, arg, single = best[s], -np.inf, -1, False
            while p >= 0:
                single |= size[p] == 1
                sum_ = score[end - size[p]] + worth[p]
                if sum_ > top:
                    top, arg = sum_, p
                p = shorter[p]
            if not single and score[end - 1] + self.lost > top:
                top, arg = score[end - 1] + self.lost, n_pieces + c
            state.append(s)
            last.append(arg)
            score.append(top)


class Units:
    """Ids of the units seen lately, in two generations of HELD_BYTES: a unit that is asked for again moves to the younger one."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def find(self, units: list[bytes]) -> list[bytes | None]:
        young, old = self.young.get, self.old.get
        each = [young(u) or old(u) for u in units]
        if self.held > HELD_BYTES:  # what was asked for now is the start of the next generation
            self.young, self.old, self.held = {}, self.young, 0
            self.keep((u, ids) for u, ids in zip(units, each) if ids is not None)
        return each

    def keep(self, pairs: Iterable[tuple[bytes, bytes]]) -> None:
        held, young = self.held, self.young
        for unit, ids in pairs:
            if len(unit) <= LONG:
                young[unit] = ids
                held += len(unit) + len(ids) + _EACH
        self.held = held


@lru_cache(1)
def model(path: str) -> Pieces:
    return Pieces(path)


def units_of(buf: np.ndarray, offs: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marked bytes, where each unit starts and the end, units before each text): units lie side by side."""
    full = np.diff(offs) > 0
    if prefix:
        buf = np.insert(buf, offs[:-1][full], 32)
        offs = offs + np.concatenate([[0], np.cumsum(full)])
    if not len(buf):
        return buf, np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    space, line = buf == 32, buf == 10
    new = line.copy()
    new[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
    new[offs[:-1][full]] = True
    starts = np.append(np.flatnonzero(new), len(buf))
    return buf, starts, np.searchsorted(starts, offs)


class Encoder:
    """Encodes blocks of texts; units seen lately are not encoded again."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids side by side, and each text's offset."""
        buf, starts, at = units_of(buf, offs, self.pieces.prefix)
        if len(starts) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        units = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        known = self.pieces.known
        each = known.find(distinct)
        fresh = [i for i, ids in enumerate(each) if ids is None]
        text = [distinct[i].decode().replace(" ", MARK) for i in fresh]
        order = sorted(range(len(text)), key=text.__getitem__)
        for i, ids in zip(order, self.pieces.encode_units([text[i] for i in order])):
            each[fresh[i]] = array("i", ids).tobytes()
        known.keep((distinct[i], each[i]) for i in fresh)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.int32)
        first = np.cumsum(size) - size
        which = units.indices.to_numpy()
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(first[which] - upto[:-1], n) + np.arange(upto[-1])], upto[at]


class Decoder:
    def __init__(self, pieces: Pieces):
        self.prefix = pieces.prefix
        self.size = np.array([len(r) for r in pieces.raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces.raw), np.uint8)

    def __call__(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts side by side, and each text's offset."""
        n = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = self.flat[np.repeat(self.first[ids] - upto[:-1], n) + np.arange(upto[-1])]
        offs = upto[at]
        if self.prefix and len(out):
            start = offs[:-1][np.diff(offs) > 0]
            drop = start[out[start] == 32]
            keep = np.ones(len(out), bool)
            keep[drop] = False
            offs = np.concatenate([[0], np.cumsum(keep)])[offs]
            out = out[keep]
        return out, offs


def _list(values: np.ndarray, at: np.ndarray, null: pa.Array) -> pa.Array:
    offs = pa.array(at.astype(np.int32))
    return pa.compute.if_else(null, pa.scalar(None, pa.list_(pa.int32())), pa.ListArray.from_arrays(offs, pa.array(values)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>): the whole text's piece ids, as the library gives them."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(model(path))
        for b in batches:
            for lo, hi, buf, offs in text_slices(b, limit=SLICE):
                null = b.column("text").slice(lo, hi - lo).is_null()
                yield pa.record_batch([b.column("doc_id").slice(lo, hi - lo), _list(*enc(buf, offs), null)], names=["doc_id", "ids"])

    return in_arrow(_rows(docs), go, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(model(path))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids = b.column("ids").slice(lo, 256)
                out, offs = dec(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())]))
                text = [out[a:z].tobytes().decode(errors="replace") for a, z in zip(offs[:-1], offs[1:])]
                null = ids.is_null().to_pylist()
                yield pa.record_batch([b.column("doc_id").slice(lo, 256), pa.array([None if n else t for n, t in zip(null, text)], pa.string())], names=["doc_id", "text"])

    return in_arrow(encoded.select("doc_id", "ids"), go, "doc_id long, text string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (as little-endian 32-bit numbers), decoded_sha256 and round_trip (decoded text = text), encoding and decoding each whole text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = Encoder(model(path)), Decoder(model(path))
        for b in batches:
            for lo, hi, buf, offs in text_slices(b, limit=SLICE):
                ids, at = enc(buf, offs)
                out, end = dec(ids, at)
                le = ids.astype("<u4")
                crc = [zlib.crc32(le[a:z].tobytes()) for a, z in zip(at[:-1], at[1:])]
                texts = [out[a:z].tobytes() for a, z in zip(end[:-1], end[1:])]
                same = [t == buf[a:z].tobytes() for t, a, z in zip(texts, offs[:-1], offs[1:])]
                sha = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.record_batch([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return in_arrow(_rows(docs), go, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_pieces": op5_pieces}
ORACLES: dict[str, str] = {}
