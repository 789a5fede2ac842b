"""SentencePiece encoding and decoding (operator 1): a max-plus parallel scan.

The vocabulary is a BPE model, so the weights of the scan say which segmentation
BPE yields. A text's BPE segmentation is the only one in which every piece, and
every two neighbouring pieces taken alone, encode to themselves: merges between
two pieces depend on nothing outside them until one crosses their common border,
and no merge ever does. A step to a piece weighs 0 where that holds and minus
infinity otherwise; the best path is the segmentation, and its weight is 0.

A text is cut into chunks of ``CHUNK`` characters. A state at a border is the piece that
covers the character before it, so a chunk yields a max-plus matrix from the states at
its left border to those at its right one. The matrices are multiplied in a tree: ``FAN``
neighbours give their parent's matrix, level by level, up to one matrix per text; on the way
down each node hands its children the states that the start reaches on their left and that
reach the end on their right. That leaves one state per border, and every chunk is then
backtraced alone from its two states. No task holds more than ``FAN`` matrices of a text.
Texts of one chunk have a 1 x 1 matrix.

Inside a chunk, no piece spans the place before a blank that follows another character
(checked on the vocabulary), so all paths meet there. Segments between such
places are independent of the states and are looked up; only those that a border cuts
run through the lattice.

Encoding equals the library's ``encode``; decoding equals its ``decode``. Null texts have
null ids, empty texts none; repeated rows give repeated results; empty tables
give empty results. Added columns whose names are taken get underscores in front. Of equally
scored merges the leftmost goes first, as in the library. A vocabulary whose pieces span the
place before a blank is refused when it is loaded. Chunks are written to the shared folder with row numbers, so
repeated ids are safe.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import appended, give_back, materialize, ship_package

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters in a chunk.
CHUNK = 32_768
#: Matrices that are multiplied at once.
FAN = 64
#: Segments whose ids a worker remembers, and pairs whose verdicts it does.
SEGMENT_CACHE = 60_000
PAIR_CACHE = 50_000
BLANK = "▁"
#: A run of blanks with the characters up to the next one.
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
START = -1

State = tuple[int, int]  # start and end of a piece, relative to the border


class Vocabulary:
    """A SentencePiece BPE model: pieces, scores and its normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.pieces: list[bytes] = []
        self.bytes_from = m.piece_to_id("<0x00>")
        for i in range(m.vocab_size()):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.pieces.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i):
                self.pieces.append(b"")
            elif m.is_unknown(i):
                self.pieces.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.scores[piece] = m.get_score(i)
                self.pieces.append(piece.replace(BLANK, " ").encode())
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids):
            raise ValueError("a piece of this vocabulary spans the place before a blank")
        self.segments: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}

    def normalize(self, text: str) -> str:
        return self.model.normalize(text)

    def merge(self, symbols: list[str]) -> list[str]:
        """BPE: the best-scored neighbouring pair is merged, the leftmost of equals, until none is a piece."""
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def stands(self, piece: str) -> bool:
        """Whether a string is a step of the lattice: a single character, or a piece that encodes to itself."""
        if len(piece) == 1:
            return True
        if piece not in self.scores:
            return False
        if piece not in self.alone:
            self.alone[piece] = self.merge(list(piece)) == [piece]
        return self.alone[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces side by side encode to themselves: weight 0, else minus infinity."""
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(list(left + right)) == [left, right]
        return known

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes_from + b for b in piece.encode("utf-8", "replace")]

    def encode_segments(self, segments: list[str]) -> bytes:
        """Ids (int32) of whole segments, by the worker's memory and the library."""
        known = self.segments
        if len(known) > SEGMENT_CACHE:
            known.clear()
        fresh = [s for s in set(segments).difference(known)]
        if fresh:
            # The normaliser puts one blank in front; segments without one are encoded piece by piece.
            led = [s for s in fresh if s[0] == BLANK]
            for s, ids in zip(led, self.model.encode([s[1:].replace(BLANK, " ") for s in led], num_threads=1)):
                known[s] = np.array(ids, np.int32).tobytes()
            for s in fresh:
                if s[0] != BLANK or len(s) == 1:
                    known[s] = np.array([i for p in self.merge(list(s)) for i in self.ids_of(p)], np.int32).tobytes()
        return b"".join(map(known.__getitem__, segments))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def border_states(v: Vocabulary, before: str, after: str) -> list[State]:
    """Steps (start, end) with start < 0 <= end around a border between ``before`` and ``after``,
    where the step covers the last character before it."""
    out = []
    for s in range(1, min(v.longest, len(before)) + 1):
        for e in range(0, min(v.longest - s, len(after)) + 1):
            if v.stands(before[len(before) - s :] + after[:e]):
                out.append((-s, e))
    return out


class Chunk:
    """A chunk with ``longest`` characters of context on either side."""

    def __init__(self, v: Vocabulary, before: str, body: str, after: str):
        self.v, self.text = v, before + body + after
        self.lo, self.hi = len(before), len(before) + len(body)
        self.first, self.last = not before, not after
        self.entries = [(START, START)] if self.first else border_states(v, before, body + after)
        self.exits = [(START, START)] if self.last else border_states(v, before + body, after)

    def _steps(self, at: int) -> Iterator[tuple[str, int]]:
        for end in range(at + 1, min(at + self.v.longest, len(self.text)) + 1):
            if self.v.stands(piece := self.text[at:end]):
                yield piece, end

    def _meeting(self, at: int, stop: int) -> int:
        """The first place after ``at`` where all paths meet, or ``stop``."""
        t = self.text
        for i in range(max(at, 1), stop):
            if t[i] == BLANK and t[i - 1] != BLANK:
                return i
        return stop

    def _entry(self, k: int) -> tuple[str, int]:
        s, e = self.entries[k]
        return ("", self.lo) if self.first else (self.text[self.lo + s : self.lo + e], self.lo + e)

    def walk(self, starts: dict[int, dict[str, int]], stop: int) -> dict[int, dict[str, int]]:
        """Lattice steps that begin before ``stop``. ``starts``: place -> last piece -> set of entries
        (bits) that reach it with weight 0. Returns the same at places from ``stop`` on, with
        all places passed in ``self.passed`` for the backtrace."""
        open_at = {p: dict(x) for p, x in starts.items()}
        self.passed: dict[int, dict[str, int]] = {}
        for at in range(min(open_at, default=stop), stop):
            here = open_at.pop(at, None)
            if not here:
                continue
            self.passed[at] = here
            for piece, end in self._steps(at):
                bits = 0
                for left, b in here.items():
                    if not left or self.v.fits(left, piece):
                        bits |= b
                if bits:
                    into = open_at.setdefault(end, {})
                    into[piece] = into.get(piece, 0) | bits
        return open_at

    def matrix(self) -> list[int]:
        """Per entry state the set (bits) of exit states that it reaches with weight 0."""
        all_bits = (1 << len(self.entries)) - 1
        starts: dict[int, dict[str, int]] = {}
        for k in range(len(self.entries)):
            piece, at = self._entry(k)
            into = starts.setdefault(at, {})
            into[piece] = into.get(piece, 0) | 1 << k
        meet = self._meeting(self.lo, self.hi)
        if meet < self.hi:
            reached = self.walk({p: x for p, x in starts.items() if p <= meet}, meet).get(meet, {})
            alive = 0
            for b in reached.values():
                alive |= b
            tail = self._last_meeting(meet)
            ends = self.walk({tail: {"": all_bits}}, self.hi)
        else:
            alive, ends = all_bits, self.walk(starts, self.hi)
        rows = [0] * len(self.entries)
        for j, (s, e) in enumerate(self.exits):
            bits = self._exit_bits(ends, s, e)
            for k in range(len(rows)):
                if bits & alive & 1 << k:
                    rows[k] |= 1 << j
        return rows

    def _exit_bits(self, ends: dict[int, dict[str, int]], s: int, e: int) -> int:
        if self.last:
            bits = 0
            for b in ends.get(self.hi, {}).values():
                bits |= b
            return bits
        return ends.get(self.hi + e, {}).get(self.text[self.hi + s : self.hi + e], 0)

    def _last_meeting(self, lowest: int) -> int:
        t = self.text
        for i in range(self.hi - 1, lowest, -1):
            if t[i] == BLANK and t[i - 1] != BLANK:
                return i
        return lowest

    def _trace(self, starts: dict[int, dict[str, int]], stop: int, goal: tuple[int, str] | None) -> list[str]:
        """The steps of the only path from ``starts`` to ``goal`` (place, last piece)."""
        ends = self.walk(starts, stop)
        if goal is None:
            goal = (stop, next(iter(ends[stop])) if stop in ends else "")
        steps = []
        at, piece = goal
        while piece and not (at in starts and piece in starts[at]):
            steps.append(piece)
            at -= len(piece)
            here = self.passed[at]
            if "" in here:
                break
            piece = next(left for left in here if self.v.fits(left, piece))
        return steps[::-1]

    def backtrace(self, entry: int, exit_: int) -> bytes:
        """Ids of the steps that begin in the chunk, between its two states."""
        piece, at = self._entry(entry)
        s, e = self.exits[exit_]
        goal = None if self.last else (self.hi + e, self.text[self.hi + s : self.hi + e])
        pack = lambda steps: np.array([i for p in steps for i in self.v.ids_of(p)], np.int32).tobytes()
        meet = self._meeting(self.lo, self.hi)
        if meet >= self.hi:
            return pack(self._trace({at: {piece: 1}}, self.hi, goal)) if at < self.hi else b""
        head = pack(self._trace({at: {piece: 1}}, meet, None)) if at < meet else b""
        tail = self._last_meeting(meet)
        middle = self.v.encode_segments(SEGMENT.findall(self.text[meet:tail]))
        if self.last:
            return head + middle + self.v.encode_segments(SEGMENT.findall(self.text[tail : self.hi]))
        return head + middle + pack(self._trace({tail: {"": 1}}, self.hi, goal))


Matrix = list[int]  # per entry state the set (bits) of exit states reached with weight 0


def forward(states: int, m: Matrix) -> int:
    """The states on the right that ``states`` on the left reach."""
    out = 0
    for k, row in enumerate(m):
        if states >> k & 1:
            out |= row
    return out


def backward(states: int, m: Matrix) -> int:
    """The states on the left that reach ``states`` on the right."""
    return sum(1 << k for k, row in enumerate(m) if row & states)


def product(matrices: list[Matrix]) -> Matrix:
    """The matrix of neighbours; over {0, minus infinity} a max-plus product is one of bit sets."""
    out = matrices[0]
    for m in matrices[1:]:
        out = [forward(row, m) for row in out]
    return out


def hand_down(matrices: list[Matrix], left: int, right: int) -> list[tuple[int, int]]:
    """Per matrix the states reached from ``left`` (a set) on its left, and those that reach ``right`` on its right."""
    before, after = [left], [right]
    for m in matrices[:-1]:
        before.append(forward(before[-1], m))
    for m in matrices[:0:-1]:
        after.append(backward(after[-1], m))
    return list(zip(before, reversed(after)))


def the_only(states: int) -> int:
    if states.bit_count() != 1:
        raise ValueError("the lattice has no single best path")
    return states.bit_length() - 1


def combine(matrices: list[Matrix]) -> list[int]:
    """The state at every border (one more than the matrices)."""
    sides = hand_down(matrices, 1, 1)
    return [the_only(f & backward(b, m)) for m, (f, b) in zip(matrices, sides)] + [the_only(forward(sides[-1][0], matrices[-1]) & 1)]


def packed(states: int) -> bytes:
    return states.to_bytes((states.bit_length() + 7) // 8 or 1, "little")


def unpacked(states: bytes) -> int:
    return int.from_bytes(states, "little")


def _matrices(column: pa.Array) -> Iterator[list[Matrix]]:
    for value in column:
        yield [[unpacked(row) for row in m] for m in value.as_py()]


def tree_levels(chunks: DataFrame) -> list[DataFrame]:
    """Levels of (rid, part, matrix), from the chunks up to one matrix per text."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[packed(row) for row in product(ms)] for ms in _matrices(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.binary()))], ["rid", "part", "matrix"])

    levels = [chunks.select("rid", "part", "matrix")]
    most = chunks.agg(F.max("part")).first()[0] or 0
    while most:
        levels.append(materialize(siblings(levels[-1]).mapInArrow(multiply, "rid long, part int, matrix array<binary>")))
        most //= FAN
    return levels


def siblings(level: DataFrame) -> DataFrame:
    """rid, part (the parent's) and the children's matrices in order, at most ``FAN``."""
    parent = F.floor(F.col("part") / FAN).cast("int").alias("part")
    return level.groupBy("rid", parent).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "matrix"))), lambda x: x["matrix"]).alias("matrices"))


def border_sets(levels: list[DataFrame]) -> DataFrame:
    """rid, part, entry, exit of every chunk: its two states."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"rid": [], "part": [], "left": [], "right": []}
            sides = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            for rid, part, ms, (left, right) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrices(batch.column(2)), sides):
                for i, (f, b) in enumerate(hand_down(ms, unpacked(left), unpacked(right))):
                    rows["rid"].append(rid)
                    rows["part"].append(part * FAN + i)
                    rows["left"].append(packed(f))
                    rows["right"].append(packed(b))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("rid", pa.int64()), ("part", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both: list[tuple[int, int]] = []
            for m, left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                m, f, b = [unpacked(row) for row in m], unpacked(left), unpacked(right)
                both.append((the_only(f & backward(b, m)), the_only(forward(f, m) & b)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in both], pa.int32()), pa.array([x for _, x in both], pa.int32())], ["rid", "part", "entry", "exit"]
            )

    one = F.lit(packed(1))
    sides = levels[-1].select("rid", "part", one.alias("left"), one.alias("right"))
    for level in reversed(levels[:-1]):
        sides = siblings(level).join(sides, ["rid", "part"]).select("rid", "part", "matrices", "left", "right").mapInArrow(down, "rid long, part int, left binary, right binary")
    return levels[0].join(sides, ["rid", "part"]).select("rid", "part", "matrix", "left", "right").mapInArrow(states, "rid long, part int, entry int, exit int")


def encode_whole(v: Vocabulary, text: str) -> bytes:
    """Ids of a text of one chunk."""
    normal = v.normalize(text)
    return Chunk(v, "", normal, "").backtrace(0, 0) if normal else b""


def cut(v: Vocabulary, text: str, size: int) -> list[tuple[str, str, str]]:
    """(before, body, after) of a text's chunks."""
    normal, k = v.normalize(text), v.longest
    return [(normal[max(0, i - k) : i], normal[i : i + size], normal[i + size : i + size + k]) for i in range(0, len(normal), size)]


def _matrix_bytes(v: Vocabulary, chunk: tuple[str, str, str]) -> list[bytes]:
    return [packed(row) for row in Chunk(v, *chunk).matrix()]


def encode(
    docs: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", path: str = MODEL_PATH, chunk: int = CHUNK, decoded_col: str | None = None
) -> DataFrame:
    """``docs`` with the array column ``ids_col`` and, where ``decoded_col`` is named, the text
    that these ids decode to.

    Texts of one chunk are encoded where they are read. Longer ones go through
    chunk matrices, their combination per text, and a backtrace per chunk; what
    is brought together for a text is small matrices, then its ids.
    """
    ship_package(docs.sparkSession)
    ids_col, *rest = appended(docs.columns, [ids_col, *([decoded_col] if decoded_col else [])])
    decoded_col = rest[0] if rest else None
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    place = docs.columns.index(text_col)
    # Normalising adds one character in front.
    long = F.coalesce(F.length(text_col) >= chunk, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            found = [encode_whole(v, x.as_py()) if x.is_valid else None for x in batch.column(place)]
            lengths = np.cumsum([0] + [len(x or b"") // 4 for x in found]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.frombuffer(b"".join(x or b"" for x in found), np.int32)))
            if None in found:
                ids = pa.ListArray.from_arrays(pa.array(lengths), ids.values, mask=pa.array([x is None for x in found]))
            arrays, names = [*batch.columns, ids], [*batch.schema.names, ids_col]
            if decoded_col:
                arrays.append(pa.array([None if x is None else v.decode(np.frombuffer(x, np.int32).tolist()) for x in found], pa.string()))
                names.append(decoded_col)
            yield pa.RecordBatch.from_arrays(arrays, names)
        v.segments.clear()
        give_back()

    added = [f"`{ids_col}` array<int>", *([f"`{decoded_col}` string"] if decoded_col else [])]
    short = docs.filter(~long).mapInArrow(whole, ", ".join([*columns, *added]))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = cut(v, text.as_py(), chunk)
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    yield pa.RecordBatch.from_pydict(
                        {"rid": [rid] * len(some), "part": list(range(i, i + len(some))), "before": [p[0] for p in some], "body": [p[1] for p in some], "after": [p[2] for p in some], "matrix": [_matrix_bytes(v, p) for p in some]},
                        schema=pa.schema([("rid", pa.int64()), ("part", pa.int32()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string()), ("matrix", pa.list_(pa.binary()))]),
                    )

    key, again = appended([*docs.columns, ids_col], ["__rid", "__again"])
    numbered = materialize(docs.filter(long).select(F.monotonically_increasing_id().alias(key), *[F.col(f"`{c}`") for c in docs.columns]))
    chunks = materialize(
        numbered.select(key, text_col).mapInArrow(cut_up, "rid long, part int, before string, body string, after string, matrix array<binary>")
    )

    placed = chunks.drop("matrix").join(border_sets(tree_levels(chunks)), ["rid", "part"]).select("rid", "part", "before", "body", "after", "entry", "exit")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            rows = batch.to_pylist()
            ids = [np.frombuffer(Chunk(v, r["before"], r["body"], r["after"]).backtrace(r["entry"], r["exit"]), np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("part"), pa.array(ids, pa.list_(pa.int32()))], ["rid", "part", "ids"])

    traced = placed.mapInArrow(trace, "rid long, part int, ids array<int>")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"]))
    whole_ids = traced.groupBy(F.col("rid").alias(key)).agg(joined.alias(ids_col))
    named = [F.col(f"`{c}`") for c in [*docs.columns, ids_col]]
    giants = numbered.join(whole_ids, key)
    if decoded_col:
        return short.unionAll(decode(giants.select(*named, F.col(f"`{ids_col}`").alias(again)), again, decoded_col, path))
    return short.unionAll(giants.select(*named))


def decode(rows: DataFrame, ids_col: str = "piece_ids", text_col: str = "decoded", path: str = MODEL_PATH) -> DataFrame:
    """``rows`` with the string column ``text_col`` in place of ``ids_col``."""
    ship_package(rows.sparkSession)
    (text_col,) = appended([c for c in rows.columns if c != ids_col], [text_col])
    rest = [f for f in rows.schema.fields if f.name != ids_col]
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest]
    ordered = rows.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{ids_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [v.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], text_col])

    return ordered.mapInArrow(run, ", ".join([*columns, f"`{text_col}` string"]))


def ids_digest(ids: Column) -> Column:
    """64-bit hash of the ids in order."""
    return F.xxhash64(ids)
