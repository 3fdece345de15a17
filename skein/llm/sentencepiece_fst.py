"""SentencePiece encoding and decoding as shortest paths in a weighted transducer.

A model compiles to machines over the tropical semiring (min, +), whose weights are costs and in which no arc is an infinite one:

* `Normaliser`: a tree of the sequences that the model's character map reads, of which the longest is taken, and a state after a blank where blanks are squeezed; it writes the meta symbol first and for each blank.
* `Lexicon`: a tree of the pieces' characters; the arc that completes a piece gives its id and costs the negated score in a unigram model, 0 in a BPE model. A character that no piece
  consists of has an arc of its own, the byte fallback, to the ids of its UTF-8 bytes (or to the unknown id, at the unknown cost).
* `Junctions`, of BPE models: its states are pieces; an arc from one to the next costs 0 if the merges leave the two apart as they are, and there is none otherwise. A sequence of pieces is what BPE
  makes of a text exactly if each neighbouring pair is what BPE makes of that pair, so one path remains and it is the model's own result.

`Transducer` composes them with an input lazily. The nodes of the composition are (place, last piece). Dijkstra's algorithm expands them by cost, and looks an arc's junction up only when the arc is next.

No piece spans a place where the characters on both sides never meet inside a piece; the composition falls apart there, and the paths of
the parts, words as a rule, are kept in a bounded table.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from skein.llm.store import bound_batches, tidy
from skein.llm.textkit import chunks, column

META = "▁"
#: Entries of the two tables of paths and of the table of junctions in a Python worker. A full table of paths becomes the older one, from which what is used comes back.
PATHS, PAIRS = 200_000, 300_000
#: No piece is longer.
LONGEST = 128
END, NEW = "", object()


def character_map(blob: bytes) -> dict[str, str]:
    """What a model's precompiled map writes for each character sequence that it reads.

    Fixed format: the length of a double array in bytes (little-endian, as are its 32-bit units), the double array, and the written texts, each ended by a zero byte. In a unit bit 8 says that a key ends below it, bits 10 on
    (or, with bit 9, eight times that) where its arcs lie, and the low byte with bit 31 which byte led to it; the unit of a key's end holds in its lower 31 bits where its text begins.
    """
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
    base = lambda at: at ^ (int(units[at]) >> 10) << ((int(units[at]) & 512) >> 6)
    out: dict[str, str] = {}
    todo = [(base(0), b"")] if len(units) else []
    while todo:
        arcs, key = todo.pop()
        for c in range(1, 256):
            at = arcs ^ c
            if at < len(units) and int(units[at]) & 0x800000FF == c:
                below = base(at)
                if int(units[at]) >> 8 & 1:
                    begin = int(units[below]) & 0x7FFFFFFF
                    out[(key + bytes([c])).decode()] = texts[begin : texts.index(b"\0", begin)].decode()
                todo.append((below, key + bytes([c])))
    return out


class Normaliser:
    """The machine that writes a normalised text.

    Its arcs read the sequences of a model's character map, the longest that there is, or any other character, which they write as it is. If blanks are squeezed, it has one state more, after a blank, in which no blank is
    written; blanks at the end go. What is written has the meta symbol for each blank, and one first. Deterministic, so its composition with a text is a string.
    """

    def __init__(self, dummy: bool, squeeze: bool = False, rules: dict[str, str] | None = None):
        self.first, self.squeeze, self.rules = META if dummy else "", squeeze, rules or {}
        self.root: dict = {}  # a state: character to state, and END to what is written where a sequence is complete
        for read, written in self.rules.items():
            state = self.root
            for c in read:
                state = state.setdefault(c, {})
            state[END] = written
        self.plain = re.compile(f"[^{re.escape(''.join(self.root))}]+").match if self.rules else None

    def arcs(self, text: str) -> Iterator[str]:
        """What the arcs along a text write, runs of characters that begin no sequence together."""
        at, end = 0, len(text)
        while at < end:
            run = self.plain(text, at)
            if run:
                yield run.group()
                at = run.end()
                continue
            state, place, after, written = self.root, at, at + 1, text[at]
            while place < end and (state := state.get(text[place])) is not None:
                place += 1
                if END in state:
                    after, written = place, state[END]
            yield written
            at = after

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.squeeze or self.rules:
            out, blank = [], self.squeeze
            for some in self.arcs(text) if self.rules else [text]:
                some = some.lstrip(" ") if blank else some
                some = re.sub("  +", " ", some) if self.squeeze else some
                if some:
                    out.append(some)
                    blank = self.squeeze and some.endswith(" ")
            text = "".join(out)
            if self.squeeze and not text.strip(" "):
                return ""
        text = self.first + text.replace(" ", META)
        return text.rstrip(META) if self.squeeze else text


class Lexicon:
    """From a place of a normalised text to the places after each piece that begins there."""

    def __init__(self, score: dict[str, float], ids: dict[str, tuple[int, ...]], byte: list[int], unknown: int, cost: float | None):
        self.ids, self.byte, self.unknown = ids, byte, unknown
        self.costs = {} if cost is None else {p: -x for p, x in score.items()}
        self.otherwise = cost or 0.0
        self.root: dict = {}  # a state: character to state, and END to the piece that is complete there
        for piece in score:
            state = self.root
            for c in piece:
                state = state.setdefault(c, {})
            state[END] = piece

    def arcs(self, text: str, at: int) -> list[str]:
        """Pieces of the arcs from a place, the shortest first: one character at least, by the byte fallback if it is no piece."""
        first = text[at]
        state = self.root.get(first)
        out = [first]
        if state is not None:
            for c in text[at + 1 : at + LONGEST]:
                state = state.get(c)
                if state is None:
                    break
                piece = state.get(END)
                if piece is not None:
                    out.append(piece)
        return out

    def cost(self, piece: str) -> float:
        return self.costs.get(piece, self.otherwise)

    def spell(self, piece: str) -> tuple[int, ...]:
        known = self.ids.get(piece)
        return known if known is not None else tuple([self.byte[b] for b in piece.encode()]) if min(self.byte) >= 0 else (self.unknown,)


class Junctions:
    """Which pieces a BPE model leaves beside each other."""

    def __init__(self, score: dict[str, float]):
        self.score, self.known, self.size = score, {}, 0

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the best-scored neighbouring pair, the leftmost of equals, until none is a piece."""
        s, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = score.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def cost(self, last: str, piece: str) -> float | None:
        """0, or None for no arc; last is empty at the start."""
        row = self.known.get(last)
        if row is None:
            row = self.known[last] = {}
        if piece not in row:
            if self.size >= PAIRS:
                self.known, self.size = {last: {}}, 0
                row = self.known[last]
            self.size += 1
            row[piece] = 0.0 if self.merged(last + piece) == ([last, piece] if last else [piece]) else None
        return row[piece]


class Transducer:
    """Compiled from the bytes of a .model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        kinds = {"normal": 1, "unknown": 2, "control": 3, "user": 4, "byte": 6}
        if not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that write blanks as a symbol before a word can be compiled")
        if any(len(p.piece) > LONGEST for p in proto.pieces):
            raise ValueError(f"only models of pieces of up to {LONGEST} characters can be compiled")
        if proto.trainer_spec.model_type not in (1, 2) or any(p.type == kinds["user"] for p in proto.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces can be compiled")
        self.bpe, self.dummy = proto.trainer_spec.model_type == 2, norm.add_dummy_prefix
        score = {p.piece: p.score for p in proto.pieces if p.type == kinds["normal"]}
        unknown, byte = next(i for i, p in enumerate(proto.pieces) if p.type == kinds["unknown"]), [-1] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == kinds["byte"]:
                byte[int(p.piece[1:-1], 16)] = i
        self.normalise = Normaliser(self.dummy, norm.remove_extra_whitespaces, character_map(norm.precompiled_charsmap) if norm.precompiled_charsmap else None)
        self.lexicon = Lexicon(score, {p.piece: (i,) for i, p in enumerate(proto.pieces) if p.piece in score}, byte, unknown, None if self.bpe else 10 - min(score.values(), default=0))
        self.junctions = Junctions(score) if self.bpe else None
        self.joins_unknown = min(byte) < 0  # without byte fallback unknown characters beside each other are one
        #: What each id stands for in decoding; ids of control pieces for nothing.
        self.spelled = [p.piece.replace(META, " ").encode() if p.piece in score else bytes([int(p.piece[1:-1], 16)]) if p.type == kinds["byte"] else " ⁇ ".encode() if p.type == kinds["unknown"] else b"" for p in proto.pieces]
        inner = {(a, b) for p in score for a, b in zip(p, p[1:])}
        splits = not any(b == META != a for a, b in inner) and not any("\n" in x for x in inner)
        self.parts = re.compile(f"{META}*[^{META}\n]+|\n|{META}+" if splits else r"(?s:.+)").findall
        # Signs that no piece has beside a letter or digit, nor any other character that is no sign: a part falls apart there too.
        plain = set(string.punctuation)
        signs = sorted(plain - {x for a, b in inner for x, y in ((a, b), (b, a)) if x in plain and y not in plain and y != META})
        sign, other = re.escape("".join(signs)), re.escape(string.punctuation + META)
        self.subparts = re.compile(f"(?<=[^{other}])(?=[{sign}])|(?<=[{sign}])(?=[^{other}])").split if signs and splits else lambda part: [part]
        self._paths: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def path(self, part: str) -> tuple[int, ...]:
        """Ids on the shortest path through the composition with a part of a normalised text."""
        lexicon, junctions, end = self.lexicon, self.junctions, len(part)
        settled: dict[tuple[int, str], tuple[int, str, str]] = {}  # node: the node before it, and the piece between
        if junctions:
            # All arcs cost 0, so any order of the queue is one by cost; last in, first out goes furthest first.
            arcs, stack, known = lexicon.arcs, [(lexicon.arcs(part, 0), 0, "", junctions.known.get("") or {})], junctions.known
            while True:
                open_, at, last, row = stack[-1]
                if not open_:
                    stack.pop()
                    continue
                piece = open_.pop()
                cost = row.get(piece, NEW)
                if cost is NEW:
                    cost, known = junctions.cost(last, piece), junctions.known
                if cost is None:
                    continue
                place = at + len(piece)
                node = (place, piece)
                if node in settled:
                    continue
                settled[node] = (at, last, piece)
                if place == end:
                    break
                stack.append((arcs(part, place), place, piece, known.get(piece) or {}))
        else:
            queue = [(lexicon.cost(piece), -len(piece), piece, 0) for piece in lexicon.arcs(part, 0)]
            heapify(queue)
            while True:
                cost, place, piece, at = heappop(queue)
                node = (-place, "")
                if node in settled:
                    continue
                settled[node] = (at, "", piece)
                if -place == end:
                    break
                for x in lexicon.arcs(part, -place):
                    heappush(queue, (cost + lexicon.cost(x), place - len(x), x, -place))
        out: list[tuple[int, ...]] = []
        while node[0]:
            at, last, piece = settled[node]
            out.append(lexicon.spell(piece))
            node = (at, last)
        return tuple([i for ids in reversed(out) for i in ids])

    def encode(self, text: str | None) -> list[int]:
        parts = self.parts(self.normalise(text or ""))
        found = list(map(self._paths.get, parts))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self._looked_up(parts[k])
        out = list(chain.from_iterable(found))
        if self.joins_unknown:
            unknown = self.lexicon.unknown
            out = [i for k, i in enumerate(out) if i != unknown or not k or out[k - 1] != i]
        return out

    def _looked_up(self, part: str) -> tuple[int, ...]:
        """Ids of a part that was not in the table when its text began, which goes into it now if it is short."""
        ids = self._paths.get(part) or self._older.get(part) or self._new(part)
        if len(part) <= 64:
            if len(self._paths) >= PATHS:
                self._older, self._paths = self._paths, {}
            self._paths[part] = ids
        return ids

    def _new(self, part: str) -> tuple[int, ...]:
        words = self.subparts(part)
        if len(words) == 1:
            return self.path(part)
        return tuple([i for w in words for i in self._paths.get(w) or self.path(w)])

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def _shared(docs: DataFrame, model: str):
    bound_batches(docs.sparkSession)
    tidy(docs.sparkSession)
    with open(model, "rb") as f:  # on the driver alone
        return docs.sparkSession.sparkContext.broadcast(f.read())


_compiled: dict[int, Transducer] = {}


def _transducer(shared) -> Transducer:
    """One for each model and Python worker, so that its tables serve all of the worker's tasks."""
    key = hash(shared.value)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(shared.value)
    return _compiled[key]


def encode(docs: DataFrame, model: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs' columns of `keep` (all but one of the name ids) and ids, array<int>, of each row's whole text; null and empty texts have none."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(shared)
        for batch in chunks(batches, text):
            ids = [np.array(machine.encode(t), np.int32) for t in column(batch, text).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in keep], pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*keep, "ids"])

    schema = StructType([*docs.select(*keep).schema, StructField("ids", ArrayType(IntegerType(), False))])
    return docs.select(*keep, *([text] if text not in keep else [])).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """The columns of `keep`, decoded (text of ids; null ids: empty) and packed (ids as little-endian 32-bit integers, binary)."""
    shared = _shared(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(shared)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                ids = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32) for x in column(part, "ids")]
                yield pa.RecordBatch.from_arrays([*[column(part, c) for c in keep], pa.array([machine.decode(x.tolist()) for x in ids], pa.string()), pa.array([x.astype("<i4").tobytes() for x in ids], pa.binary())], names=[*keep, "decoded", "packed"])

    schema = StructType([*encoded.select(*keep).schema, StructField("decoded", StringType()), StructField("packed", BinaryType())])
    return encoded.select(*keep, *(["ids"] if "ids" not in keep else [])).mapInArrow(run, schema)


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and decoded_sha256 of each row of docs."""
    out = decode(encode(docs, model, ["doc_id"]), model, ["doc_id"])
    return out.select("doc_id", (F.octet_length("packed") / 4).cast(LongType()).alias("n_pieces"), F.crc32("packed").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
