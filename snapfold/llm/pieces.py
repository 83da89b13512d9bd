"""SentencePiece encoding and decoding: BPE models with byte fallback, by backtracking over longest matches.

A text is encoded when it is cut into pieces of which every two neighbours stay two pieces if their text is merged anew.
So the longest match at a place is tried first, then shorter ones, and a place from which no match leads on is marked in
a bitfield and never tried again. Blanks only begin pieces, so a text falls into chunks that encode on their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapfold.llm.common import prepare, whole

#: The sign that stands for a blank in pieces.
BLANK = "▁"
#: Characters that are matched at once.
BLOCK = 256
#: Chunks and pairs a worker remembers; it forgets all of them when there are more.
REMEMBERED, REMEMBERED_CHARS = 1 << 19, 64
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = float("-inf")


class Remembered(dict):
    """Values found once; a key of more than so many characters is not kept."""

    def __init__(self, find: Callable, longest: int | None = None):
        super().__init__()
        self.find, self.longest = find, longest

    def __missing__(self, key):
        value = self.find(key)
        if self.longest is None or len(key) <= self.longest:
            self[key] = value
        return value

    def forget(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


class Vocabulary:
    """A model's pieces, and what a worker remembers of them while it encodes."""

    def __init__(self, path: str):
        """Read a model; one that is not BPE with byte fallback, or that rewrites texts, is refused."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, how = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        if how.model_type != how.BPE or kinds.count(BYTE) != 256 or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model is not BPE with byte fallback")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or how.treat_whitespace_as_suffix:
            raise ValueError("the model rewrites texts before it cuts them")
        self.pieces, self.kinds = [p.piece for p in model.pieces], kinds
        self.prefix, self.end, self.unknown = rules.add_dummy_prefix, how.eos_id, how.unk_surface
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        if any(c not in self.scores for p in self.scores for c in p):
            raise ValueError("a character of a piece is no piece")
        self.sizes = [len(p) for p in self.pieces]
        self.longest = max(self.sizes)
        #: Pieces that merging reaches.
        self.reached = [p for p in self.scores if self.merge(p) == [p]]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("matcher", "chunks", "letters", "known", "pairs", "shorter", "surfaces", "high")}

    def merge(self, text: str) -> list[str]:
        """Merge neighbours, those of the highest score first and the leftmost of equal ones; for short texts."""
        score, parts = self.scores.get, list(text)
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > NEVER:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for p in self.reached:
            made.add_word(p, self.ids[p])
        made.make_automaton()
        return made

    @cached_property
    def chunks(self) -> re.Pattern:
        """Stretches that no piece goes beyond."""
        inner = any(BLANK in p.lstrip(BLANK) for p in self.scores)
        return re.compile(r"[\s\S]+" if inner else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

    @cached_property
    def letters(self) -> frozenset[str]:
        """The characters that are pieces."""
        return frozenset(p for p in self.scores if len(p) == 1)

    @cached_property
    def known(self) -> Remembered:
        """The ids of a chunk as bytes of 32-bit numbers."""
        return Remembered(lambda chunk: np.array(self._chunk(chunk), np.int32).tobytes(), REMEMBERED_CHARS)

    @cached_property
    def pairs(self) -> Remembered:
        """Whether two pieces stay as they are when their text is merged anew."""

        def stay(pair: tuple[int, int]) -> bool:
            both = [self.pieces[x] for x in pair]
            return self.merge("".join(both)) == both

        return Remembered(stay)

    @cached_property
    def shorter(self) -> dict[int, list[int]]:
        """A piece and the pieces it begins with, from the longest to the shortest."""
        reached = {p: self.ids[p] for p in self.reached}
        return {i: [reached[p[:k]] for k in range(len(p), 0, -1) if p[:k] in reached] for p, i in reached.items()}

    def cut(self, text: str) -> list[int]:
        """The pieces of a text of known characters."""
        sizes, pairs, shorter, longest, failed = self.sizes, self.pairs, self.shorter, self.longest, bytearray(len(text) // 8 + 1)
        pieces: list[int] = []
        tried: list[tuple[int, int]] = []  # the longest match where a piece stands, and which of its beginnings is taken
        place = 0
        while place < len(text):
            # the longest matches, one behind the other, as long as they fit
            low, match = place, -1
            for last, match in self.matcher.iter_long(text[low : low + BLOCK] if len(text) > BLOCK else text[low:]):
                if place > low + BLOCK - longest:
                    match = -1
                    break
                end = low + last + 1
                if failed[end >> 3] >> (end & 7) & 1 or (pieces and not pairs[pieces[-1], match]):
                    break
                pieces.append(match)
                tried.append((match, 0))
                place = end
            else:
                match = -1
            # else shorter ones, and if none fits, shorter ones of the piece before
            n = 0
            while match >= 0:
                for n in range(n + 1, len(shorter[match])):
                    piece = shorter[match][n]
                    end = place + sizes[piece]
                    if not failed[end >> 3] >> (end & 7) & 1 and (not pieces or pairs[pieces[-1], piece]):
                        pieces.append(piece)
                        tried.append((match, n))
                        place, match = end, -1
                        break
                else:
                    failed[place >> 3] |= 1 << (place & 7)
                    place -= sizes[pieces.pop()]
                    match, n = tried.pop()
        return pieces

    def _chunk(self, chunk: str) -> list[int]:
        """Characters that are no pieces become their bytes; what stands between them is cut."""
        made: list[int] = []
        done = 0
        for at in [i for i, c in enumerate(chunk) if c not in self.letters]:
            if done < at:
                made += self.cut(chunk[done:at])
            made += [self.bytes[b] for b in chunk[at].encode()]
            done = at + 1
        return made + self.cut(chunk[done:]) if done < len(chunk) else made

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, the end id last."""
        text = text.replace(" ", BLANK)
        chunks = self.chunks.findall(BLANK + text if self.prefix and text else text)
        known = self.known
        ids = b"".join(map(known.__getitem__, chunks)) + np.int32(self.end).tobytes()
        known.forget()
        self.pairs.forget()
        return np.frombuffer(ids, np.int32)

    @cached_property
    def surfaces(self) -> list[str]:
        """The text of each id, blanks as in pieces; bytes beyond ASCII have none of their own."""
        made = []
        for p, kind in zip(self.pieces, self.kinds, strict=True):
            byte = int(p[3:5], 16) if kind == BYTE else 0
            made.append({UNKNOWN: self.unknown, CONTROL: "", BYTE: chr(byte) if byte < 128 else ""}.get(kind, p))
        return made

    @cached_property
    def high(self) -> np.ndarray:
        """The byte beyond ASCII that an id stands for, else 0."""
        made = np.zeros(len(self.pieces), np.uint8)
        made[self.bytes[128:]] = np.arange(128, 256)
        return made

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; a byte that is no part of UTF-8 becomes U+FFFD, the blank put in front goes."""
        surface = self.surfaces.__getitem__
        high = self.high[ids] if len(ids) else np.empty(0, np.uint8)
        places = np.flatnonzero(high)
        parts, done = [], 0
        if len(places):
            for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                parts += map(surface, ids[done : run[0]].tolist())
                parts.append(_utf8(high[run].tobytes()))
                done = run[-1] + 1
        parts += map(surface, ids[done:].tolist())
        text = "".join(parts)
        if self.prefix and text[:1] == BLANK:
            text = text[1:]
        return text.replace(BLANK, " ")


def _utf8(data: bytes) -> str:
    """Each byte that begins no whole character becomes one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        made, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    made.append(data[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                made.append("�")
                size = 1
            at += size
        return "".join(made)


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text by the model in a file, the end id last.

    The file is read on the driver and its pieces are broadcast (their number is the model's). A null text is empty and
    has the end id only. Rows are handled one by one: repeated rows and null ids come out as they came in, columns
    beyond doc_id and text are not read, no rows give none. A long stretch without blanks takes linear time.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            made = [words.encode(x) for x in batch.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in made], dtype=np.int64)])
            data = pa.array(np.concatenate([np.empty(0, np.int32), *made]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), data)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), whole().alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with a column ``decoded``, the text of its ids (a clashing column goes); null ids give a null text."""
    spark = prepare(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(Vocabulary(model))
    rows = encoded.drop("decoded")
    at = rows.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            made = pa.array([words.decode(x.values.to_numpy()) if x.is_valid else None for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit(None).cast("string")).schema)
