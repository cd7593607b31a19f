"""SentencePiece encoding and decoding for models of the merge (BPE) type.

Encoding searches instead of merging. An Aho-Corasick automaton over the pieces
gives the longest piece at each position; a piece is taken if merging it anew
together with the piece before it gives back the two; otherwise the next shorter
piece is tried, and where none is left the search steps back and marks the position
as failed in a bitfield, so that no position is tried twice. The result is the one
sequence that merging yields, for any text, in time that doesn't depend on the order
of merges.
"""

from __future__ import annotations

import codecs
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, with_id

SPACE = "▁"
CACHE_WORDS = 150_000
PAIR_CACHE = 400_000


class PieceCodec:
    """A model file's pieces, with an encoder and a decoder."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = [-1] * 256
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.raw: list[bytes] = []
        self.is_byte = [False] * n
        self.controls = [i for i in range(n) if sp.is_control(i)]
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                b = int(p[3:5], 16)
                self.byte_id[b] = i
                self.is_byte[i] = True
                self.raw.append(bytes([b]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.score[p] = sp.get_score(i)
                self.id[p] = i
                self.raw.append(p.replace(SPACE, " ").encode())
        self.unknown = sp.unk_id()
        if sp.encode("") != [] or sp.encode("a  b") != sp.encode("a  b ")[: len(sp.encode("a  b"))] or sp.encode("ﬁ") == sp.encode("fi"):
            raise ValueError("only models without text normalisation are supported")
        self.length = {i: len(p) for p, i in self.id.items()}
        automaton = ahocorasick.Automaton()
        reached = {p: i for p, i in self.id.items() if len(self.merge(p)) == 1}  # merging never ends in another piece
        for p, i in reached.items():
            automaton.add_word(p, (len(p) - 1, i))
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter = {i: next((reached[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in reached), -1) for p, i in reached.items()}
        self.pairs: dict[int, bool] = {}
        self.replays: dict[int, list] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts = self.splitter()

    def splitter(self):
        """Splits a text where no piece goes on, so that each part is encoded by itself.

        Characters that stand side by side in a piece are of one class, and pieces have
        spaces in front only; parts are spaces and then characters of one class.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            return lambda text: [text]
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                c = root[c]
            return c

        for p in self.id:
            p = p.lstrip(SPACE)
            for a, b in zip(p, p[1:], strict=False):
                root[find(a)] = find(b)
        classes: dict[str, list[str]] = {}
        for c in root:
            classes.setdefault(find(c), []).append(c)
        several = sorted((x for x in classes.values() if len(x) > 1), key=len, reverse=True)
        runs = "|".join(f"[{re.escape(''.join(sorted(x)))}]+" for x in several)
        return re.compile(f"{SPACE}*(?:{runs + '|' if runs else ''}[^{SPACE}])|{SPACE}+", re.DOTALL).findall

    def merge(self, text: str) -> list[str]:
        """Merge characters by score, the leftmost first among equals: the definition that encoding must meet."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def replay(self, i: int) -> list[tuple[float, str, str]]:
        """The merges that make piece ``i``, in order: score, then first and last part after each.

        The entry before the first merge has no score.
        """
        out = self.replays.get(i)
        if out is None:
            parts, score = list(self.piece[i]), self.score
            out = [(0.0, parts[0], parts[-1])]
            while len(parts) > 1:
                s, at = max((score.get(parts[k] + parts[k + 1], -math.inf), -k) for k in range(len(parts) - 1))
                parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
                out.append((s, parts[0], parts[-1]))
            self.replays[i] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Merging the characters of both pieces anew gives the two pieces.

        Their own merges are replayed together in the order of scores, the left
        piece first among equals; the answer is no if a merge across the border would
        come before the next of them.
        """
        key = a << 32 | b
        out = self.pairs.get(key)
        if out is not None:
            return out
        left, right, score = self.replay(a), self.replay(b), self.score
        i, j, out = 1, 1, True
        while True:
            across = score.get(left[i - 1][2] + right[j - 1][1])
            s = left[i][0] if i < len(left) else -math.inf
            t = right[j][0] if j < len(right) else -math.inf
            if across is not None and across > s and across >= t:
                out = False
                break
            if s == t == -math.inf:
                break
            if s >= t:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        self.pairs[key] = out
        return out

    def search(self, text: str) -> list[int] | None:
        """Ids of a text, or None if one of its characters is no piece."""
        n = len(text)
        longest = [-1] * n
        for end, (back, i) in self.automaton.iter(text):
            longest[end - back] = i  # a later end is a longer piece
        if -1 in longest:
            return None
        length, shorter, known = self.length, self.shorter, self.pairs
        failed = 0
        out: list[int] = []
        at, piece = 0, longest[0]
        while at < n:
            before = out[-1] if out else -1
            while piece >= 0:
                end = at + length[piece]
                if not failed >> end & 1:
                    if before < 0:
                        break
                    fits = known.get(before << 32 | piece)
                    if fits or fits is None and self.compatible(before, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at = end
                if at < n:
                    piece = longest[at]
            else:
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                failed |= 1 << at
                piece = out.pop()
                at -= length[piece]
        return out

    def part(self, text: str) -> list[int]:
        """Ids of a part; a character that is no piece becomes the ids of its bytes."""
        out = self.search(text)
        if out is not None:
            return out
        ids = self.id
        out, run = [], []
        for c in text:
            if c in ids:
                run.append(c)
                continue
            if run:
                out += self.search("".join(run))
                run = []
            codes = [self.byte_id[b] for b in c.encode()]
            out += [self.unknown] if -1 in codes else codes
        return out + self.search("".join(run)) if run else out

    def miss(self, word: str) -> bytes:
        """Ids of a part as int32 bytes, kept in one of two generations of bounded size."""
        out = self.older.get(word)
        if out is None:
            out = array("i", self.part(word)).tobytes()
        if len(word) <= 64:
            if len(self.words) >= CACHE_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as int32 bytes, without begin and end."""
        if not text:
            return b""
        parts = self.parts(SPACE + text.replace(" ", SPACE))
        out = list(map(self.words.get, parts))
        if None in out:
            at = -1
            for _ in range(out.count(None)):
                at = out.index(None, at + 1)
                out[at] = self.words.get(parts[at]) or self.miss(parts[at])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces put together, byte pieces as UTF-8, the space put in front taken away.

        Bytes that aren't UTF-8 become U+FFFD one by one.
        """
        if not ids:
            return ""
        raw = self.raw
        try:
            if any(i in ids for i in self.controls):
                raise ValueError("these end a run of bytes")
            out = b"".join([raw[i] for i in ids]).decode()
        except ValueError:
            out, run = "", b""
            for i in [*ids, -1]:
                if i >= 0 and self.is_byte[i]:
                    run += raw[i]
                    continue
                out += run.decode(errors="piece-bytes")
                run = b""
                out += raw[i].decode() if i >= 0 else ""
        first = next((i for i in ids if raw[i]), self.unknown)
        return out[1:] if raw[first][:1] == b" " and not self.is_byte[first] and first != self.unknown else out


codecs.register_error("piece-bytes", lambda e: ("\ufffd", e.start + 1))


@lru_cache(maxsize=2)
def codec(model: str) -> PieceCodec:
    """One codec for each worker process and model."""
    return PieceCodec(model)


def _int_lists(parts: list[bytes]) -> pa.Array:
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _encode_rows(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            rest, start = batch.num_rows, 0
            while start < rest:  # about 16 MB of text at a time
                size, stop, parts = 0, start, []
                for raw in texts(batch.column(1).slice(start)):
                    parts.append(c.encode(raw.decode(errors="replace")))
                    size += len(raw)
                    stop += 1
                    if size > 1 << 24:
                        break
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), _int_lists(parts)], ["id", "ids"])
                start = stop

    return run


def _decode_rows(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            ids = batch.column(1)
            out = [c.decode(v.values.to_pylist() if v.is_valid else []) for v in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(out, pa.string())], ["id", "ids", "decoded"])

    return run


def _round_trip_rows(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in _encode_rows(model)(batches):
            ids = batch.column(1)
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            out = [c.decode(values[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(out, pa.string())], ["id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` of every whole text.

    A null or empty text has no ids; a null id stays null; repeated rows are each
    encoded; other columns aren't read; no rows give no rows. ``model`` is the path
    of the model file on every executor.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode_rows(model), with_id(docs, id_col, "ids array<int>")).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id_col, ids, decoded``: the text of each row's ids; null ids give an empty text."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(_decode_rows(model), with_id(encoded, id_col, "ids array<int>, decoded string")).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, ids, decoded``: ``encode`` and then ``decode`` of its ids, in one pass over the texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_round_trip_rows(model), with_id(docs, id_col, "ids array<int>, decoded string")).withColumnRenamed("id", id_col)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    rows = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
