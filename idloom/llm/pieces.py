"""SentencePiece encoding and decoding by a streaming Viterbi over a BPE piece vocabulary.

A sequence of pieces is the BPE encoding of its text exactly if each two neighbours are: merging their joint
text gives the two back. So each position has one surviving backpointer, to the piece that ends there and agrees
with the piece that survives at its start. A piece is never longer than the longest of the vocabulary, so only a
window of positions is kept; where the paths of all positions from which a piece may yet start meet, the ids up
to there are final and leave the window.

Pieces of blanks alone are merged last and all score alike, so the best path over a run of blanks is the one that
merging from the left gives: as many of the longest piece as fit and one for the rest. Only the length of such a
run is kept, and less than one longest piece of it waits for the word behind, which may take the last blank.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from idloom.llm.common import binary_column, documents, map_batches, prepare
from idloom.llm.tokens import BARE, BREAK, MARK, SegmentCoder, tokenizer_path

SPACE = "▁"
_SEGMENT = re.compile(" *[^ ]+| +$")
_RUN = re.compile(f"{SPACE}+|[^{SPACE}]+")
#: Agreement of neighbouring pieces that a worker remembers.
PAIRS = 200_000
_codecs: dict[str, Codec] = {}


class Pieces:
    """The vocabulary of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        skip = set(self.bytes)
        self.ids = {model.id_to_piece(i): i for i in range(size) if not special[i] and i not in skip}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.text = [b"" if special[i] else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])
        self.cuts_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        #: Neighbouring characters of one piece: between any other two all paths meet.
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                lengths.setdefault(p[-3:], {1, 2}).add(len(p))
        #: Lengths of the pieces that may end in three given characters, longest first.
        self.lengths = {e: tuple(sorted(n, reverse=True)) for e, n in lengths.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        blank = {len(p): s for p, s in self.score.items() if set(p) == {SPACE} and len(p) > 1}
        others = [s for p, s in self.score.items() if len(p) > 1 and p.strip(SPACE)]
        apart = self.cuts_at_spaces and not any(p[:2] == SPACE * 2 and p.strip(SPACE) for p in self.ids)
        #: The longest run of blanks that is one piece, if such pieces are merged last and longer runs begin with it.
        self.longest_blank = n = max(blank, default=1)
        self._blanks = [self.merge(SPACE * i) for i in range(n)]
        if not apart or len(set(blank.values())) > 1 or max(blank.values(), default=float("-inf")) >= min(others, default=0) or any(self.merge(SPACE * i) != self._run(i) for i in range(n, 3 * n)):
            self.longest_blank = 0

    def _run(self, n: int) -> list[str]:
        whole, rest = divmod(n, self.longest_blank)
        return [SPACE * self.longest_blank] * whole + self._blanks[rest]

    def blanks(self, n: int) -> list[int]:
        """The ids of a run of n blanks."""
        return [x for p in self._run(n) for x in self.to_ids(p)]

    def merge(self, text: str) -> list[str]:
        """Plain BPE: the best-scored pair of neighbours is merged, the leftmost of equals first."""
        part: list[str] = list(text)
        after = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(part) and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j] = a + b, ""
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p]

    def agree(self, left: str, right: str) -> bool:
        """Whether the two stay as they are when their joint text is merged."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def to_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode()]


class StreamingViterbi:
    """Feed text in any portions, blanks as U+2581; ids come as soon as they are final.

    Vocabularies whose blanks follow other rules (longest_blank is 0) take runs of two blanks or more like letters.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.start()

    def start(self) -> None:
        self.window = ""  # text after the last committed boundary
        self.last = [""]  # the piece that survives at each position of the window, at 0 the last committed one
        self.run = 0  # blanks just read
        self.held: int | None = None  # blanks before the window's first one, until that one's piece is known

    def feed(self, text: str) -> list[int]:
        if not self.pieces.longest_blank or not self.run and SPACE * 2 not in text and text[-1:] != SPACE:
            return self._letters(text)
        out: list[int] = []
        for m in _RUN.finditer(text):
            if m[0][0] == SPACE:
                self.run += len(m[0])
                if self.run > 1:
                    out += self._close()
                    whole = (self.run - 1) // self.pieces.longest_blank
                    out += self.pieces.blanks(whole * self.pieces.longest_blank)
                    self.run -= whole * self.pieces.longest_blank
            elif self.run:
                if self.run > 1 or not self.window and not self.last[0]:
                    self.held = self.run - 1
                self.run = 0
                out += self._letters(SPACE + m[0])
            else:
                out += self._letters(m[0])
        return out

    def finish(self) -> list[int]:
        ids = self._close() + (self.pieces.blanks(self.run) if self.run else [])
        self.start()
        return ids

    def _letters(self, text: str) -> list[int]:
        out: list[int] = []
        step = 4 * self.pieces.longest
        for i in range(0, len(text), step):
            self._extend(text[i : i + step])
            if len(self.window) >= self.pieces.longest:
                out += self._commit()
        return out

    def _close(self) -> list[int]:
        """End the window's path; what follows hangs on nothing before it."""
        ids = self._cut(len(self.window))
        self.last = [""]
        return ids

    def _extend(self, text: str) -> None:
        known, pairs, lengths, last = self.pieces.ids, self.pieces.pairs, self.pieces.lengths, self.last
        at = len(self.window)
        w = self.window = self.window + text
        for i in range(at + 1, len(w) + 1):
            for n in lengths.get(w[i - 3 : i], (2, 1)) if i > 2 else (2, 1)[2 - i :]:
                if n <= i and ((piece := w[i - n : i]) in known or n == 1):
                    key = (last[i - n], piece)
                    ok = pairs.get(key)
                    if self.pieces.agree(*key) if ok is None else ok:
                        last.append(piece)
                        break
            else:
                raise AssertionError("no surviving path")

    def _commit(self) -> list[int]:
        live = set(range(max(0, len(self.window) - self.pieces.longest + 1), len(self.window) + 1))
        while len(live) > 1:
            end = max(live)
            live.remove(end)
            live.add(end - len(self.last[end]))
        return self._cut(live.pop())

    def _cut(self, boundary: int) -> list[int]:
        pieces = []
        i = boundary
        while i:
            pieces.append(self.last[i])
            i -= len(self.last[i])
        ids: list[int] = []
        if pieces:
            self.window, self.last = self.window[boundary:], self.last[boundary:]
            if self.held is not None:
                alone = pieces[-1] == SPACE
                ids += self.pieces.blanks(self.held + alone)
                if alone:
                    pieces.pop()
                self.held = None
        for p in reversed(pieces):
            ids += self.pieces.to_ids(p)
        return ids


def _key(segment: str) -> str:
    return segment[1:] if segment[:1] == " " and segment[1:2] not in ("", BARE) else BARE + segment


class Codec(SegmentCoder):
    """Ids of whole texts and back. A key is a segment less its leading blank, or BARE and the segment."""

    odd = f"^$|^ | $|  |{BARE}|{SPACE}"

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        super().__init__("H" if len(self.pieces.text) <= 1 << 16 else "I")
        self.viterbi = StreamingViterbi(self.pieces)
        if not self.pieces.cuts_at_spaces:
            self.odd = ""
        elif not any(b in ".,;:!?" and a.isalpha() or "\n" in (a, b) for a, b in filter(lambda x: len(x) == 2, self.pieces.inside)):
            self.splits = ((BREAK, f"\\1 {BARE}\n {BARE}\\2"), (MARK, f"\\1 {BARE}\\2 "))

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(SPACE, " ")
        return list(map(_key, _SEGMENT.findall(" " + text))) if self.pieces.cuts_at_spaces else [_key(" " + text)]

    def _parts(self, key: str) -> list[str]:
        """Cut where no piece holds both neighbours."""
        text, inside = key[1:] if key[:1] == BARE else " " + key, self.pieces.inside
        if text.isascii() and text[1:].isalpha():
            return [key]
        shown = text.replace(" ", SPACE)
        if not self.pieces.cuts_at_spaces or SPACE * 2 in shown:
            return [key]
        cuts = [i for i in range(1, len(shown)) if shown[i - 1 : i + 1] not in inside]
        return [_key(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def _ids(self, key: str) -> bytes:
        text = (key[1:] if key[:1] == BARE else " " + key).replace(" ", SPACE)
        if SPACE * 2 in text and not self.pieces.longest_blank:
            ids = [x for p in self.pieces.merge(text) for x in self.pieces.to_ids(p)]
        else:
            ids = self.viterbi.feed(text) + self.viterbi.finish()
        return array(self.code, ids).tobytes()

    def compute(self, keys: list[str]) -> list[bytes]:
        out = []
        for k in keys:
            parts = self._parts(k)
            if len(parts) == 1:
                out.append(self._ids(k))
                continue
            found = []
            for p in parts:
                x = self.known(p)
                if x is None:
                    x = self._ids(p)
                    self.keep([p], [x])
                found.append(x)
            out.append(b"".join(found))
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.pieces.text.__getitem__, array(self.code, ids))).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, ids (little-endian, 2 bytes; 4 beyond 65,536 pieces).

    Null and empty texts have no ids. Rows that share a doc_id, or have none, are encoded like any other; extra
    columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = codec(model).arrays(batch.column(1))
        sizes = np.diff(ends, prepend=0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), binary_column(ids, sizes)], names=["doc_id", "n_pieces", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, "doc_id bigint, n_pieces bigint, ids binary")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """encoded with a column text, in place of one of that name: what its ids spell.

    A text's own U+2581 comes back as a blank. Null ids spell null, no ids the empty text; rows of equal doc_id are
    decoded like any other and all other columns stay. An empty table gives no rows.
    """
    prepare(encoded.sparkSession)
    kept = encoded.drop("text")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model)
        texts = [None if x is None else c.decode(x) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return map_batches(kept, fn, StructType([*kept.schema.fields]).add("text", "string"))


def _round_trip(model: str):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model)
        ids, ends = c.arrays(batch.column(1))
        raw, wide = ids.tobytes(), ids.astype("<u4")
        cuts = [0, *ends.tolist()]
        runs = list(zip(cuts, cuts[1:], strict=False))
        width = c.dtype.itemsize
        same = [c.decode(raw[width * a : width * b]) == (t or "") for (a, b), t in zip(runs, batch.column(1).to_pylist(), strict=True)]
        crc = [zlib.crc32(wide[a:b]) for a, b in runs]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends, prepend=0)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return fn


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), round_trip: decoding gave the text back."""
    prepare(spark)
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    return map_batches(docs, _round_trip(tokenizer_path("piece_bpe_32k.model")), "doc_id bigint, n_pieces bigint, ids_crc32 bigint, round_trip boolean")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
