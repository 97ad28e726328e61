"""Operator 1: SentencePiece (merge type) encoding and decoding by a prefix table.

In a merge-type encoding the last token of every prefix is unique: it is the one
token that ends there, whose left neighbour is the last token of the prefix
before it, and whose text joined to that neighbour's encodes to just these two
tokens. One pass over an automaton's matches fills the table of last tokens and
the ids are then read off backwards. No piece holds the word mark behind another
character, so no merge crosses a new word mark; each such segment is encoded on
its own, and a bounded cache keeps what segments gave.

Nulls and empty texts have no ids and decode to the empty text. Texts are whole,
of any length; the work is linear in it. Rows stay where they are: no shuffle,
repeated rows are encoded each. Columns other than the kept ones and the text are
not read, so their names do not matter.
"""

from __future__ import annotations

import itertools
import math
import re
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from notelens.llm.tables import map_rows, slices

MARK = "▁"
#: Segments and pairs whose results one Python worker keeps, and the longest segment it keeps.
CACHED_SEGMENTS, CACHED_PAIRS, CACHED_CHARS = 250_000, 500_000, 64
SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Codec:
    """Vocabulary of one merge-type model and the tables made from it."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i)}
        plain = [i for i in ids if i not in self.special and not sp.is_byte(i)]
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.unknown = sp.unk_id()
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.spaced = [p.replace(MARK, " ") for p in self.pieces]
        self.first_plain = max([*self.special, *self.byte_of], default=-1) + 1
        if 0 in plain or "\n" in self.score or any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("piece 0 is not special, or a piece holds a line end or the word mark behind another character")
        self.automaton = ahocorasick.Automaton()
        self.left_edge: dict[int, list[tuple[str, float]]] = {}
        self.right_edge: dict[int, list[tuple[str, float]]] = {}
        for i in plain:
            if self._edges(i):
                self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}

    def merged(self, text: str, seen: list | None = None) -> list[str]:
        """The merges as defined: join the adjacent pair of the best score, the leftmost of equals, until none is left.

        Only for short texts: single pieces and pairs of pieces. ``seen`` gets the parts before each merge and its score.
        """
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            if seen is not None:
                seen.append((parts[0], parts[-1], best))
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: int) -> bool:
        """Note which symbols stand at a token's ends while it is merged, each with the score of the merge that ends it.

        False where the token's own text encodes to other tokens, so that it never occurs.
        """
        piece, seen = self.pieces[token], []
        if self.merged(piece, seen) != [piece]:
            return False
        left, right = [], []
        steps = [*seen, (piece, piece, -math.inf)]
        for k, (first, final, score) in enumerate(steps):
            following = steps[k + 1] if k + 1 < len(steps) else None
            if following is None or following[0] != first:
                left.append((first, score))
            if following is None or following[1] != final:
                right.append((final, score))
        falling = all(a[2] > b[2] for a, b in itertools.pairwise(steps)) or len(set(piece)) > 1
        if falling and piece.strip(MARK):
            self.left_edge[token], self.right_edge[token] = left, right
        return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens stay two when their texts are encoded together.

        Scores fall from merge to merge, so a symbol at the seam lives until the merge that takes it in. A merge over
        the seam happens if its score beats that merge on the left (which comes first on a tie) and is not beaten by the
        one on the right. Runs of word marks share one score; they are merged out in full.
        """
        a, b = self.right_edge.get(left), self.left_edge.get(right)
        if a is None or b is None:
            x, y = self.pieces[left], self.pieces[right]
            return self.merged(x + y) == [x, y]
        score = self.score
        for end, lost in a:
            for start, taken in b:
                s = score.get(end + start)
                if s is not None and s > lost and s >= taken:
                    return False
        return True

    def segment(self, text: str) -> list[int]:
        """Ids of one segment: the table of each prefix's last token, then the ids from the end."""
        n = len(text)
        last = [0] * (n + 1)  # 0: the start, or a character that no piece holds and nothing merges with
        width = [1] * (n + 1)
        fits_of = self.pairs.get
        done = -1
        for at, (token, size) in self.automaton.iter(text):
            if at == done:
                continue  # the token that ends here is known
            before = last[at + 1 - size]
            if before:
                fits = fits_of(before << 32 | token)
                if fits is None:
                    fits = self._pair(before, token)
                if not fits:
                    continue
            done = at
            last[at + 1] = token
            width[at + 1] = size
        ids: list[int] = []
        end = n
        while end:
            if last[end]:
                ids.append(last[end])
            else:
                ids.extend(reversed(self._bytes(text[end - 1])))
            end -= width[end]
        ids.reverse()
        return ids

    def _pair(self, left: int, right: int) -> bool:
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left << 32 | right] = self.compatible(left, right)
        return fits

    def _bytes(self, char: str) -> list[int]:
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in char.encode()]

    def segments(self, text: str | None) -> list[str]:
        """Independent parts of a text: words with the word marks before them, and line ends."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return SEGMENT.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")

    def _learn(self, part: str) -> None:
        if len(self.known) >= CACHED_SEGMENTS:
            self.known.clear()
            self.texts.clear()
        ids = self.segment(part)
        self.known[part] = array("i", ids).tobytes()
        self.texts[part] = self._plain(ids)

    def convert(self, text: str | None) -> tuple[bytes, str]:
        """The ids of a text as 32-bit integers, and the text that these ids decode to."""
        parts = self.segments(text)
        if not parts:
            return b"", ""
        known, texts = self.known, self.texts
        raw, read = list(map(known.get, parts)), list(map(texts.get, parts))
        if None in raw:
            for k in [k for k, ids in enumerate(raw) if ids is None]:
                part = parts[k]
                if part not in known:
                    if len(part) > CACHED_CHARS:
                        ids = self.segment(part)
                        raw[k], read[k] = array("i", ids).tobytes(), self._plain(ids)
                        continue
                    self._learn(part)
                raw[k], read[k] = known[part], texts[part]
        return b"".join(raw), "".join(read)[1:]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.convert(text)[0], np.int32).tolist()

    def _plain(self, ids: Sequence[int]) -> str:
        """The text of ids with word marks as spaces; bytes are joined as UTF-8."""
        if ids and min(ids) >= self.first_plain:
            return "".join(map(self.spaced.__getitem__, ids))
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            if i not in self.special:
                out.append(self.spaced[i])
            elif i == self.unknown:
                out.append(" ⁇ ")
        out.append(raw.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids; the mark that encoding puts before a text is taken off."""
        text = self._plain(ids)
        first = next((i for i in ids if i in self.byte_of or i not in self.special or i == self.unknown), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text


_CODECS: dict[int, Codec] = {}


def _codec(model) -> Codec:
    """The codec of a broadcast model file, made once in a Python worker."""
    if model.id not in _CODECS:
        _CODECS.clear()
        _CODECS[model.id] = Codec(model.value)
    return _CODECS[model.id]


class _Model:
    """A broadcast model file (some hundred kB) with an id that workers can cache by."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            self.shared = spark.sparkContext.broadcast(f.read())
        self.id = self.shared._jbroadcast.id()

    def __getstate__(self):
        return {"shared": self.shared, "id": self.id}

    @property
    def value(self) -> bytes:
        return self.shared.value


def encode(df: DataFrame, model_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``ids`` (array of int) and ``decoded`` (text read back from the ids) of every row."""
    model = _Model(df.sparkSession, model_path)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for part in slices(batches):
            coded = [codec.convert(t) for t in part.column(len(names)).to_pylist()]
            offsets = np.zeros(len(coded) + 1, dtype=np.int32)
            np.cumsum([len(ids) // 4 for ids, _ in coded], out=offsets[1:])
            flat = np.frombuffer(b"".join(ids for ids, _ in coded), np.int32)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(names)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                 pa.array([text for _, text in coded], pa.string())], [*names, "ids", "decoded"])

    fields = [df.schema[n] for n in names]
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return map_rows(df.select(*names, text), run, fields + new)


def decode(df: DataFrame, model_path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``decoded``, the text of each row's ids (null: empty)."""
    model = _Model(df.sparkSession, model_path)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for part in slices(batches):
            texts = [codec.decode(row or ()) for row in part.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pa.array(texts, pa.string())], [*names, "decoded"])

    return map_rows(df.select(*names, ids), run, [df.schema[n] for n in names] + [T.StructField("decoded", T.StringType())])
