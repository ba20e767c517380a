"""SentencePiece encoding that keeps byte offsets, and decoding.

A byte-pair model file is read on the driver (pieces, scores, flags and the compiled character map)
and shipped to the tasks; it is bounded by its vocabulary. A text is normalised by the longest
prefix that the character map knows (else one character as it is), and for every normalised byte the
source byte is kept. Merging takes the pair of the best score first, the leftmost of equals. No piece
of such a model has white space after other characters (checked when it is read), so merging never
crosses from a word to the next and each distinct word is merged once per task. Pieces unknown to
the vocabulary fall back to bytes. Every piece is projected to the span of source bytes it covers.

Defined cases: a null text counts as empty and encodes to nothing but the asked-for end id; texts are
never cut; the bytes of a character that falls back share its span: all but the last of its byte
pieces are empty spans at its start. Invalid byte runs decode to U+FFFD for each byte.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sent, columns_free, text_of

MARK = "▁"
#: Piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct words whose pieces a worker keeps (some 30 MB), and the length up to which words are kept and merged together.
KEPT_WORDS, KEPT_LENGTH = 100_000, 48
#: Documents that are encoded together, and the bytes of their texts (a longer one is encoded by itself).
BATCH, TOGETHER = 512, 400_000
SHORT = 24
NEVER = float("-inf")
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

codecs.register_error("fffd-each", lambda e: ("�" * (e.end - e.start), e.end))


class CharacterMap:
    """The compiled map: a double-array trie of source strings, and their replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]
        self.known: dict[bytes, tuple[bytes, int]] = {}

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix at a place and the prefix's length."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        node ^= self._step(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._step(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        start, length = found
        return self.strings[start : self.strings.index(0, start)], length

    @staticmethod
    def _step(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


@dataclass
class Pieces:
    """A model's contents, and its encoder."""

    names: list[str]
    kinds: list[int]
    scores: list[float]
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    fallback: bool
    unk: int
    end: int
    cache: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.map = CharacterMap(self.charsmap)
        self.rank = {n: s for n, k, s in zip(self.names, self.kinds, self.scores, strict=True) if k == NORMAL}
        self.ids = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}
        shown = {NORMAL: lambda n: n.replace(MARK, " ").encode(), BYTE: lambda n: bytes([int(n[3:5], 16)])}
        shown |= {CONTROL: lambda n: b"", UNKNOWN: lambda n: " ⁇ ".encode()}
        self.surface = [shown[k](n) for n, k in zip(self.names, self.kinds, strict=True)]
        self._tables()

    def _tables(self) -> None:
        """Arrays for merging many words at once: pair to piece, piece to rank and width, character to piece."""
        count, ids = len(self.names), self.ids
        self.width = np.array([1 if k == BYTE else len(n.encode()) for n, k in zip(self.names, self.kinds, strict=True)], np.int32)
        self.place = np.unique(-np.array(self.scores), return_inverse=True)[1].astype(np.int32)
        pairs = {}
        for name, merged in ids.items():
            for k in range(1, len(name)):
                left, right = ids.get(name[:k]), ids.get(name[k:])
                if left is not None and right is not None:
                    pairs[left * count + right] = merged
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        self.chars = np.full(0x110000, -1, np.int32)
        for name, piece in ids.items():
            if len(name) == 1:
                self.chars[ord(name)] = piece
        for code, piece in self.bytes.items():
            if code < 0x80 and self.chars[code] < 0 and self.fallback:
                self.chars[code] = piece

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__ and k != "cache"}

    def __setstate__(self, state) -> None:
        self.__init__(**state)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its UTF-8 bytes and its end, the source byte."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 32, len(MARK.encode()) if self.escape else 1, 1)
            prefix = len(MARK.encode() if self.escape else b" ") if self.dummy_prefix else 0
            source = np.repeat(np.arange(len(raw)), width)
            source = np.concatenate((np.zeros(prefix, np.int64), source, [len(raw)]))
            space = MARK if self.escape else " "
            return (space if self.dummy_prefix else "") + text.replace(" ", space), source
        return self._mapped(data)

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        units, at = [], 0  # (normalised bytes, source byte)
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                length = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                found = data[at : at + length], length
            units.append((found[0], at))
            at += found[1]
        first = 0
        if self.squeeze:
            while first < len(units) and units[first][0] == b" ":
                first += 1
        space = MARK.encode() if self.escape else b" "
        start = units[first][1] if first < len(units) else len(data)
        if first == len(units):
            return "", np.full(1, len(data))
        out, source = bytearray(), []
        if self.dummy_prefix:
            out += space
            source += [start] * len(space)
        after_space = self.squeeze
        for piece, at in units[first:]:
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                shown = piece.replace(b" ", space)
                out += shown
                source += [at] * len(shown)
                after_space = self.squeeze and piece.endswith(b" ")
        end = len(data)
        while self.squeeze and out.endswith(space):
            end = source[len(out) - len(space)]
            del out[len(out) - len(space) :], source[len(out) :]
        return out.decode(), np.array([*source, end])

    def merge(self, chunk: str) -> list[str]:
        """The pieces of a word: best score first, leftmost of equals."""
        parts, rank = list(chunk), self.rank
        if len(parts) > SHORT:
            return self._merge_long(parts)
        get = rank.get
        scores = [get(a + b, NEVER) for a, b in itertools.pairwise(parts)]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            i = scores.index(best)
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], NEVER)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of pairs, for words of any length."""
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (score := rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def word(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids and normalised byte widths of a word's pieces, packed as 32-bit numbers.

        A byte piece but the last of its character has width 0.
        """
        ids, widths = [], []
        for part in self.merge(chunk):
            known = self.ids.get(part)
            data = part.encode()
            if known is not None:
                ids.append(known)
                widths.append(len(data))
            elif self.fallback:
                for char in part:
                    data = char.encode()
                    ids += [self.bytes[b] for b in data]
                    widths += [0] * (len(data) - 1) + [len(data)]
            elif ids and ids[-1] == self.unk:
                widths[-1] += len(data)
            else:
                ids.append(self.unk)
                widths.append(len(data))
        return array("i", ids).tobytes(), array("i", widths).tobytes()

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or -1."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) * len(self.names) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def words(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """``word`` for many words at once: in each round every word makes its best merge."""
        quick = [c for c in chunks if len(c) <= KEPT_LENGTH]
        out = {c: self.word(c) for c in chunks if len(c) > KEPT_LENGTH}
        lengths = np.fromiter(map(len, quick), np.int64, len(quick))
        parts = self.chars[np.frombuffer("".join(quick).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(quick), dtype=np.int32), lengths)
        odd = np.zeros(len(quick), bool)
        odd[owner[parts < 0]] = True
        out |= {quick[i]: self.word(quick[i]) for i in np.flatnonzero(odd).tolist()}
        keep = ~odd[owner]
        parts, owner = parts[keep], owner[keep]
        never = np.int32(len(self.names))
        inside = owner[:-1] == owner[1:]
        joined = np.full(len(parts), -1, np.int32)  # of a part and the next one
        joined[:-1][inside] = self._joined(parts[:-1][inside], parts[1:][inside])
        done = []
        while len(parts):
            rank = np.where(joined >= 0, self.place[joined], never)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(parts)))
            going = np.repeat(best < never, sizes)
            done.append((owner[~going], parts[~going]))
            hits = np.flatnonzero((rank == np.repeat(best, sizes)) & going)
            hits = hits[np.concatenate(([True], owner[hits][1:] != owner[hits][:-1]))] if len(hits) else hits
            parts[hits] = joined[hits]
            stay = going
            stay[hits + 1] = False
            moved = np.cumsum(stay) - 1
            parts, owner, joined = parts[stay], owner[stay], joined[stay]
            at = moved[hits]
            for here in (at, at[at > 0] - 1):
                here = here[here + 1 < len(parts)]
                joined[here] = -1
                same = here[owner[here] == owner[here + 1]]
                joined[same] = self._joined(parts[same], parts[same + 1])
            if len(parts):
                joined[-1] = -1
        owners = np.concatenate([d[0] for d in done]) if done else owner
        order = np.argsort(owners, kind="stable")
        ids = (np.concatenate([d[1] for d in done]) if done else parts)[order].astype(np.int32)
        stops = (np.cumsum(np.bincount(owners, minlength=len(quick))) * 4).tolist() if len(quick) else []
        packed, widths, start = ids.tobytes(), self.width[ids].tobytes(), 0
        for chunk, stop in zip(quick, stops, strict=True):
            if stop > start:
                out[chunk] = packed[start:stop], widths[start:stop]
            start = stop
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and the first and past-the-last source byte of each piece."""
        cache = self.cache
        plain = [self.normalise(text) for text in texts]
        chunks = [CHUNK.findall(p[0]) for p in plain]
        fresh = self.words(list({c for found in chunks for c in found if c not in cache}))
        out = []
        for (_, source), found in zip(plain, chunks, strict=True):
            packed = [cache.get(c) or fresh[c] for c in found]
            ids = np.frombuffer(b"".join([f[0] for f in packed]), np.int32)
            widths = np.frombuffer(b"".join([f[1] for f in packed]), np.int32)
            if not self.fallback and len(ids) > 1:
                ids, widths = self._one_unknown(ids, widths)
            stops = np.cumsum(widths, dtype=np.int64)
            out.append((ids, source[stops - widths].astype(np.int64), source[stops].astype(np.int64)))
        for chunk in fresh:
            if len(cache) >= KEPT_WORDS:
                break
            if len(chunk) <= KEPT_LENGTH:
                cache[chunk] = fresh[chunk]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode_all`` for one text."""
        return self.encode_all([text])[0]

    def _one_unknown(self, ids: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring unknown pieces count as one."""
        first = np.flatnonzero(~((ids == self.unk) & (np.concatenate(([-1], ids[:-1])) == self.unk)))
        return ids[first], np.add.reduceat(widths, first)

    def decode(self, ids) -> str:
        surface = self.surface
        ids = list(ids)
        data = b"".join([surface[i] for i in ids])
        if self.dummy_prefix or self.squeeze:
            lead = next((i for i in ids if self.kinds[i] != CONTROL), None)
            if lead is not None and self.kinds[lead] == NORMAL and self.names[lead].startswith(MARK):
                data = data[1:]
        return data.decode("utf-8", "fffd-each")


def row_ranges(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """First row and number of rows of what is encoded together, given the texts' bytes."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (i - first >= BATCH or held + size > TOGETHER):
            yield first, i - first
            first, held = i, 0
        held += size
    if sizes:
        yield first, len(sizes) - first


def read_model(path: str) -> Pieces:
    """A byte-pair model from its file on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    with open(path, "rb") as file:
        data = file.read()
    model = schema.ModelProto()
    model.ParseFromString(data)
    kinds = [p.type for p in model.pieces]
    names = [p.piece for p in model.pieces]
    rules, shape = model.normalizer_spec, model.trainer_spec
    if shape.model_type != shape.BPE or shape.treat_whitespace_as_suffix or {USER, UNUSED} & set(kinds):
        raise ValueError("only byte-pair models with leading white space and without own symbols are read")
    if any(k == NORMAL and re.search(f"[^{MARK}]{MARK}", n) for n, k in zip(names, kinds, strict=True)):
        raise ValueError("pieces that span several words are not supported")
    end = next((i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == CONTROL and n == shape.eos_piece), -1)
    return Pieces(
        names, kinds, [p.score for p in model.pieces], rules.precompiled_charsmap, rules.add_dummy_prefix,
        rules.remove_extra_whitespaces, rules.escape_whitespaces, shape.byte_fallback, kinds.index(UNKNOWN), end,
    )


def encode_documents(
    docs: DataFrame,
    model: Pieces,
    carry: list[str] | None = None,
    text_col: str = "text",
    add_end: bool = True,
    decode: bool = False,
) -> DataFrame:
    """The ``carry`` columns, ``ids``, ``starts``, ``ends`` (arrays of one length), ``decoded`` if asked for.

    The end id has the empty span behind the last byte. Added names get leading underscores where a
    carried column has them.
    """
    spark = docs.sparkSession
    carry = ["doc_id"] if carry is None else carry
    shared = Sent(spark, model)
    added = columns_free(docs.select(*[F.col(f"`{c}`") for c in carry]), "ids", "starts", "ends", "decoded")
    if not decode:
        added = added[:3]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("held"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at, rows in row_ranges(pc.binary_length(batch.column("text")).to_pylist()):
                part = batch.slice(at, rows)
                parts, texts = [], []
                given = part.column("text").to_pylist()
                for text, (ids, starts, ends) in zip(given, own.encode_all(given), strict=True):
                    if add_end:
                        size = len(text.encode())
                        ids = np.append(ids, np.int32(own.end))
                        starts, ends = np.append(starts, size), np.append(ends, size)
                    parts.append((ids, starts, ends))
                    if decode:
                        texts.append(own.decode(ids))
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(p[0]) for p in parts]))), pa.int32())
                flat = [np.concatenate([p[k] for p in parts] or [[]]) for k in range(3)]
                kinds = (pa.int32(), pa.int64(), pa.int64())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in zip(flat, kinds, strict=True)]
                columns = [part.column("held"), *lists, *([pa.array(texts, pa.string())] if decode else [])]
                yield pa.RecordBatch.from_arrays(columns, ["held", "ids", "starts", "ends", "decoded"][: len(columns)])

    kind = held.schema["held"].dataType.simpleString()
    tail = ", decoded string" if decode else ""
    out = held.mapInArrow(run, f"held {kind}, ids array<int>, starts array<bigint>, ends array<bigint>{tail}")
    named = zip(["ids", "starts", "ends", "decoded"], added, strict=False)
    return out.select("held.*", *[F.col(old).alias(new) for old, new in named])
