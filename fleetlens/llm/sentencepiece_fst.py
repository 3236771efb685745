"""SentencePiece encoding and decoding as a weighted transducer.

The compiled machine is a composition of four parts over the tropical semiring (weights add along a path, the
smallest path wins):

* the normaliser rewrites an input: a dummy blank in front, blanks joined where the model says so, every blank
  written as its visible mark;
* the piece lexicon has an arc for every piece that matches from one position of the normalised input to another;
* byte fallback has an arc for a character that no piece covers; it writes one byte piece for each of its bytes;
* the grammar weighs neighbouring arcs. A unigram model weighs pieces alone (the negative score). A merge (BPE) model
  allows two pieces side by side, at weight 0, where merging their joint string gives exactly these two, and forbids
  them (infinite weight) elsewhere. The merge result of a text is the one path of finite weight, because merges only
  depend on neighbours: every prefix of that path is the merge result of its own string, so a state is a position
  with the last piece of its prefix.

Composition with an input is lazy and the shortest path is found left to right, one state a position. Between two
characters that are neighbours in no piece every path goes through one state, so the input is cut there (in front of a
blank mark, in all usual models), and a worker remembers the paths of the parts it has met.

Decoding follows the machine backwards: pieces write their strings, runs of byte pieces the characters they spell
(what is no UTF-8 becomes U+FFFD byte by byte), marks become blanks, and the dummy blank goes.

Supported models: types unigram and BPE with an identity normaliser (no character map); others are refused at
compile time, as are user-defined pieces, which no public model here has.

Defined results: a null text is an empty one; an empty text has no pieces and decodes to the empty text. Lengths do not
matter: work and memory are in proportion to the text. Repeated rows get equal results, further columns are kept, and
one whose name a result column has is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from fleetlens.llm.text import plus_columns
from fleetlens.llm.worker_memory import kept

MARK = "▁"
RESULT = ("token_ids", "n_tokens", "decoded")

#: Paths that a worker remembers, at some 250 bytes each; and pairs, at some 80, before it starts anew.
REMEMBERED_PARTS, REMEMBERED_PAIRS = 300_000, 250_000
#: The characters of a part that is remembered at most.
SHORT = 64

#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: varints as numbers, four-byte floats as floats, the rest as bytes."""
    import struct

    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at:at + size]
            at += size
        elif kind == 5:
            yield tag >> 3, struct.unpack("<f", data[at:at + 4])[0]
            at += 4
        elif kind == 1:
            at += 8
        else:
            raise ValueError("not a model file")


class Model:
    """What the machine needs of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for field, value in _fields(data):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append((x.get(1, b"").decode(), x.get(2, 0.0), x.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.join_blanks = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or normaliser.get(2) or any(k == USER_DEFINED for _, _, k in self.pieces) or trainer.get(24, 0):
            raise ValueError("only unigram and BPE models with an identity normaliser are supported")


class _Recent(dict):
    """Paths by string. Once half of `most` are there they become the old half, and what is still old by the next time is let go."""

    def __init__(self, path: Callable[[str], bytes], most: int):
        self.path, self.half, self.old = path, most // 2, {}

    def __missing__(self, part: str) -> bytes:
        path = self.old.pop(part, None)
        if path is None:
            path = self.path(part)
        if len(part) <= SHORT:
            if len(self) >= self.half:
                self.old = self.copy()
                self.clear()
            self[part] = path
        return path


class Transducer:
    def __init__(self, model: Model):
        self.model = model
        self.strings = [p for p, _, _ in model.pieces]
        self.kinds = [k for _, _, k in model.pieces]
        self.lexicon = {p: i for i, (p, _, k) in enumerate(model.pieces) if k in (NORMAL, UNUSED)}
        self.scores = [s for _, s, _ in model.pieces]
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(model.pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: the most characters of a piece, by its last one
        self.longest: dict[str, int] = {}
        for p in self.lexicon:
            self.longest[p[-1]] = max(len(p), self.longest.get(p[-1], 0))
        #: the neighbours inside pieces; between all others every path has one state
        self.inside = {p[i:i + 2] for p in self.lexicon for i in range(len(p) - 1)}
        self.marks_begin = all(MARK not in p.lstrip(MARK) for p in self.lexicon)
        #: what a piece spells if it can be told without its neighbours
        self.plain_of = [p if k in (NORMAL, UNUSED) else chr(self.byte_of[i]) if k == BYTE and self.byte_of[i] < 128 else None for i, (p, _, k) in enumerate(model.pieces)]
        usual = [s for s, k in zip(self.scores, self.kinds) if k == NORMAL]
        self.worst = min(usual, default=0.0) - 10.0  # the weight of an unknown character in a unigram model
        self.beside: dict[int, bool] = {}
        self.paths = _Recent(self._path_of_part, REMEMBERED_PARTS)

    # normaliser

    def normalised(self, text: str) -> str:
        if self.model.join_blanks:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        if self.model.dummy_prefix:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def plain(self, normalised: str) -> str:
        """What is left of a normalised input when marks are blanks again."""
        text = normalised.replace(MARK, " ") if self.model.escape else normalised
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    # grammar

    def _merges_to(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b, best score and leftmost first, ends with a and b and never over their border."""
        parts, border, lexicon, scores = [*a, *b], len(a), self.lexicon, self.scores
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                piece = lexicon.get(parts[i] + parts[i + 1])
                if piece is not None and scores[piece] > best:
                    best, at = scores[piece], i
            if at < 0:
                return parts == ([a, b] if a else [b])
            if at == border - 1:
                return False
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            border -= at < border

    def _allowed(self, left: int, right: int) -> bool:
        """Whether the grammar lets `right` follow `left`; -1 stands for the start and for characters without a piece."""
        pair = (left + 1) * len(self.strings) + right
        known = self.beside.get(pair)
        if known is None:
            if len(self.beside) >= REMEMBERED_PAIRS:
                self.beside.clear()
            known = self.beside[pair] = self._merges_to(self.strings[left] if left >= 0 else "", self.strings[right])
        return known

    # shortest path

    def _merge_path(self, text: str) -> list[int]:
        """The one path of finite weight: by position, the last piece of the prefix and where it began."""
        n = len(text)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        lexicon, beside, size, longest = self.lexicon, self.beside, len(self.strings), self.longest
        for end in range(1, n + 1):
            begin[end] = end - 1  # a character without a piece, unless an arc reaches this state
            for start in range(max(0, end - longest.get(text[end - 1], 0)), end):
                piece = lexicon.get(text[start:end])
                if piece is None:
                    continue
                left = last[start]
                known = beside.get((left + 1) * size + piece)
                if known or known is None and self._allowed(left, piece):
                    last[end], begin[end] = piece, start
                    break
        out, end = [], n
        while end:
            out.append(last[end] if last[end] >= 0 else ~(end - 1))
            end = begin[end]
        return out[::-1]

    def _unigram_path(self, text: str) -> list[int]:
        n = len(text)
        weight, last, begin = [0.0] + [math.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest.get(text[end - 1], 0)), end):
                piece = self.lexicon.get(text[start:end])
                w = weight[start] - (self.scores[piece] if piece is not None else math.inf)
                if piece is not None and self.kinds[piece] == NORMAL and w < weight[end]:
                    weight[end], last[end], begin[end] = w, piece, start
            if text[end - 1] not in self.lexicon and weight[end - 1] - self.worst < weight[end]:
                weight[end], last[end], begin[end] = weight[end - 1] - self.worst, -1, end - 1
        out, end = [], n
        while end:
            out.append(last[end] if last[end] >= 0 else ~(end - 1))
            end = begin[end]
        return out[::-1]

    def _path(self, text: str) -> bytes:
        steps = self._merge_path(text) if self.model.kind == BPE else self._unigram_path(text)
        out: list[int] = []
        before = False
        for x in steps:
            if x >= 0:
                out.append(x)
            elif self.model.byte_fallback:
                out.extend(self.bytes[b] for b in text[~x].encode())
            elif not before:
                out.append(self.unknown)  # neighbouring unknown characters are one unknown piece
            before = x < 0
        return np.array(out, np.int32).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The piece numbers of a text, as the bytes of 32-bit integers."""
        x = self.normalised(text or "")
        if not x:
            return b""
        if not self.marks_begin:
            return self.paths[x]
        # every blank mark begins a part, but a run of marks stays together with what follows it
        parts = x.split(MARK)
        paths, out, run = self.paths, [], ""
        if parts[0]:
            out.append(paths[parts[0]])
        for part in parts[1:]:
            run += MARK
            if part:
                out.append(paths[run + part])
                run = ""
        if run:
            out.append(paths[run])
        return b"".join(out)

    def _path_of_part(self, part: str) -> bytes:
        at = [0, *[i for i in range(1, len(part)) if part[i - 1:i + 1] not in self.inside], len(part)]
        if not self.model.byte_fallback:
            at = [0, len(part)]  # neighbouring unknown characters make one piece
        if len(at) == 2:
            return self._path(part)
        return b"".join([self.paths[part[i:j]] for i, j in zip(at, at[1:])])

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        try:
            return self.plain("".join(map(self.plain_of.__getitem__, ids.tolist())))
        except TypeError:
            pass  # a piece that takes its neighbours to tell
        out, run = [], bytearray()
        for i in ids.tolist():
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_spelled(bytes(run)))
                run.clear()
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(self.strings[i])
        if run:
            out.append(_spelled(bytes(run)))
        return self.plain("".join(out))


def _spelled(data: bytes) -> str:
    """The characters that bytes spell; a byte that is part of none becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[:e.start].decode() + "�" + _spelled(data[e.start + 1:])


def compiled(path: str) -> Transducer:
    def build() -> Transducer:
        with open(path, "rb") as f:
            return Transducer(Model(f.read()))

    return kept(("sentencepiece", path), build)


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with its piece numbers, their count, and the text that they decode to.

    `path` is the model file, which every executor has at the same place. One pass, no shuffle.
    """
    columns = plus_columns(docs.columns, list(RESULT))
    kept = StructType([docs.schema[c] for c in columns])
    schema = StructType([*kept.fields, StructField("token_ids", ArrayType(IntegerType(), False)), StructField("n_tokens", IntegerType()), StructField("decoded", StringType())])
    at, places = docs.columns.index(text), [docs.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            first, texts = 0, batch.column(at)
            while first < len(texts):
                # parts of a bounded number of characters, so that one batch of long texts is no great memory
                paths, decoded, size, n = [], [], 0, first
                while n < len(texts) and size < 4_000_000:
                    t = texts[n].as_py() or ""
                    paths.append(machine.encode(t))
                    decoded.append(machine.decode(np.frombuffer(paths[-1], np.int32)))
                    size += len(t)
                    n += 1
                counts = np.array([len(p) // 4 for p in paths], np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(paths), np.int32)))
                part = batch.slice(first, n - first)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in places], ids, pa.array(counts), pa.array(decoded, pa.string())],
                                                 names=[f.name for f in schema])
                first = n

    return docs.mapInArrow(run, schema)
