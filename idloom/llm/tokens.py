"""Whole-text tokenising with the tokenizers library, one library call per word that is new to a worker.

The two supported kinds of tokenizer never join characters across certain blanks, so a text's ids are the
ids of its segments in a row: a byte-level BPE can be cut before a blank between two other characters, a
word BPE that drops white space at every blank. Arrow cuts a batch of texts and tells its distinct segments
apart; only those are looked up, and numpy puts the ids together. Segments recur, so each worker keeps the
ids of short ones, up to a number of bytes.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from unicodedata import category, is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from idloom.llm.common import kept

#: Bytes of segments and their ids in each of a worker's two generations; longer segments than SEGMENT_CHARS are not kept.
CACHE_BYTES, SEGMENT_CHARS = 80 << 20, 64
#: Texts are encoded in blocks of about this much.
TEXT_BYTES = 2 << 20
_ENTRY = 190  # bytes of a dictionary's entry, a string and a bytes object without their contents

# White space of any kind, in RE2's words: a blank beside another one is no place to cut.
_WIDE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Before a segment that has no leading blank in its text; texts that hold this character are cut one by one.
BARE = "\x01"
# A line break between lines, and a mark between a word and a blank, are segments of their own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
BREAK, MARK = rf"([{_LETTERS}.,;:!?])\n([{_LETTERS}])", rf"([{_LETTERS}])([.,;:!?]) "
_encoders: dict[str, Encoder] = kept("tokens")


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The runs values[start : start + size] in a row, about `most` values at a time."""
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    i, at = 0, 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, at + most, "right")))
        end = int(ends[j - 1])
        out[at:end] = values[np.arange(at, end) + np.repeat(starts[i:j] - (ends[i:j] - sizes[i:j]), sizes[i:j])]
        i, at = j, end
    return out


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and ends of texts that each have one id more."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


class SegmentCoder:
    """Ids of texts put together from the ids of their segments.

    A subclass says by `odd` which texts it cuts by itself, one at a time. All others are cut at each blank, after
    the replacements of `splits`; `bare` marks their first segments. compute gives the ids of keys.
    """

    odd: str | None = None
    bare = False
    splits: tuple[tuple[str, str], ...] = ()

    def __init__(self, code: str, most: int = CACHE_BYTES):
        self.code, self.dtype, self.most = code, np.dtype("<u2" if code == "H" else "<u4"), most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def cut(self, text: str) -> list[str]:
        return text.split(" ")

    def compute(self, keys: list[str]) -> list[bytes]:
        raise NotImplementedError

    def known(self, key: str) -> bytes | None:
        found = self.new.get(key)
        return self.old.get(key) if found is None else found

    def keep(self, keys: list[str], ids: list[bytes]) -> None:
        sizes = list(map(len, keys))
        if max(sizes, default=0) > SEGMENT_CHARS:
            short = [i for i, n in enumerate(sizes) if n <= SEGMENT_CHARS]
            keys, ids, sizes = [keys[i] for i in short], [ids[i] for i in short], [sizes[i] for i in short]
        held = _ENTRY * len(keys) + sum(sizes) + sum(map(len, ids))
        if self.held and self.held + held > self.most:
            self.old, self.new, self.held = self.new, {}, 0
        self.held += held
        self.new.update(zip(keys, ids, strict=True))

    def lookup(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.new.get, keys))
        if None in found:
            at = [i for i, x in enumerate(found) if x is None]
            missing = [keys[i] for i in at]
            again = list(map(self.old.get, missing))
            rest = list(dict.fromkeys(k for k, x in zip(missing, again, strict=True) if x is None))
            back = [(k, x) for k, x in zip(missing, again, strict=True) if x is not None]
            got = dict(back)
            self.keep(list(got), list(got.values()))
            for i in range(0, len(rest), 8192):
                part = rest[i : i + 8192]
                ids = self.compute(part)
                self.keep(part, ids)
                got.update(zip(part, ids, strict=True))
            for i, k in zip(at, missing, strict=True):
                found[i] = got[k]
        return found

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (null: none) and the end of each text's."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = np.zeros(len(texts), bool) if self.odd is None else pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        for pattern, parts in self.splits:
            plain = pc.replace_substring_regex(plain, pattern, parts)
        lists = pc.split_pattern(plain, " ")
        words = lists.flatten().dictionary_encode()
        keys, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
        sizes, starts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        sizes[~odd] = n = pc.list_value_length(lists).to_numpy()
        starts[~odd] = begins = np.cumsum(n) - n
        if self.bare and len(begins):
            codes = codes.copy()
            heads, place = np.unique(codes[begins], return_inverse=True)
            codes[begins] = len(keys) + place
            keys += [BARE + keys[c] for c in heads.tolist()]
        if odd.any():
            own = [self.cut(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            index: dict[str, int] = {}
            more = np.array([len(keys) + index.setdefault(k, len(index)) for c in own for k in c], codes.dtype)
            sizes[odd] = n = np.fromiter(map(len, own), np.int64, len(own))
            starts[odd] = len(codes) + np.cumsum(n) - n
            codes = gather(np.concatenate([codes, more]), starts, sizes)
            keys += index
        values = self.lookup(keys)
        n = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        each = n[codes]
        ids = gather(np.frombuffer(b"".join(values), self.dtype), (np.cumsum(n) - n)[codes], each)
        return ids, np.concatenate(([0], np.cumsum(each)))[np.cumsum(sizes)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, of 2 bytes (4 for vocabularies beyond 65,536)."""
        ids, ends = self.arrays(pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder(SegmentCoder):
    """Ids by a tokenizer file. A byte-level tokenizer's key is a segment less its leading blank, or BARE and the segment."""

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        super().__init__("H" if self.library.get_vocab_size() <= 1 << 16 else "I", cache)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm, added = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("added_tokens", [])
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] or t["content"].isalpha() for t in added)
        #: No special token is put together from letters, marks and line breaks alone.
        apart = all("<" in t["content"] or "[" in t["content"] for t in added)
        self.kind, self.odd = "whole", ""  # every text is odd
        if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind, self.odd, self.bare = "bytes", f"{_WIDE} | {_WIDE}|{BARE}", True
            self.splits = ((BREAK, f"\\1 {BARE}\n {BARE}\\2"), (MARK, f"\\1 {BARE}\\2 ")) if apart else ()
        elif plain and spec["model"].get("end_of_word_suffix") and [p.get("behavior") for p in pre.get("pretokenizers", [])][:1] == ["Removed"]:
            self.kind, self.odd = "words", None
            self.splits = ((BREAK, r"\1 \2"), (MARK, r"\1 \2 ")) if apart else ()
        self.merges, self.letters = self.library.model.tokenize, _byte_letters()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)").search

    def cut(self, text: str) -> list[str]:
        if self.kind != "bytes":
            return [text]
        if BARE in text:
            return [BARE + text]
        parts = _SAFE_SPACE.split(text)
        parts[0] = BARE + parts[0]
        return parts

    def _segment(self, key: str) -> str:
        return key if self.kind != "bytes" else key[1:] if key[:1] == BARE else " " + key

    def _straight(self, key: str) -> bool:
        """A word of letters alone is one pre-token: the model takes it in its byte alphabet."""
        if self.kind == "bytes":
            return key.isalpha() or key[:1] == BARE and key[1:].isalpha()
        return self.kind == "words" and key.isalpha() and (key.isascii() or _latin(key))

    def _parts(self, key: str) -> list[str]:
        """The keys of the pre-tokens, or of the whole segment where they are not sure."""
        segment = self._segment(key)
        if self.kind == "whole" or self.special(segment):  # a special token's string stays whole
            return [key]
        if self.kind == "words":
            return _parts(segment)
        parts = _spaced_parts(segment)
        return [p[1:] if p[:1] == " " and len(p) > 1 else BARE + p for p in parts] if len(parts) > 1 else [key]

    def _library(self, keys: list[str]) -> list[bytes]:
        straight = list(map(self._straight, keys))
        segments = list(map(self._segment, keys))
        rest = iter(self.library.encode_batch_fast([s for s, ok in zip(segments, straight, strict=True) if not ok], add_special_tokens=False))
        out, merges, code, letters, blank, lower = [], self.merges, self.code, self.letters, self.letters[0x20], self.kind == "words"
        for s, ok in zip(segments, straight, strict=True):
            if ok:
                s = s.lower() if lower else s
                s = s.replace(" ", blank) if s.isascii() else s.encode().decode("latin-1").translate(letters)
                out.append(array(code, [t.id for t in merges(s)]).tobytes())
            else:
                out.append(array(code, next(rest).ids).tobytes())
        return out

    def compute(self, keys: list[str]) -> list[bytes]:
        cuts = {k: c for k in keys if not self._straight(k) and (c := self._parts(k)) != [k]}
        new = dict.fromkeys(k for k in keys if k not in cuts)
        parts = list(dict.fromkeys(p for c in cuts.values() for p in c if p not in new))
        ids = {p: x for p in parts if (x := self.known(p)) is not None}
        rest = [p for p in parts if p not in ids]
        got = self._library([*new, *rest])
        self.keep(rest, got[len(new) :])
        ids.update(zip([*new, *rest], got, strict=True))
        return [b"".join([ids[p] for p in cuts[k]]) if k in cuts else ids[k] for k in keys]


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


# Inside a segment a pre-token ends wherever letters end, and around a single line break between other characters.
_SPACED_PART = re.compile(r" ?[^\W\d_]+|\n| ?[^\w\s]+")
_PART = re.compile(r"[^\W\d_]+|[^\w\s]+")
_ODD_BREAK = re.compile(r"\s\s|\s$|^\n")


def _spaced_parts(segment: str) -> list[str]:
    if "'" in segment or "\n" in segment and _ODD_BREAK.search(segment):
        return [segment]
    parts = _SPACED_PART.findall(segment)
    if sum(map(len, parts)) != len(segment):
        return [segment]
    return parts if segment.isascii() or all(map(_plain, parts)) else [segment]


def _parts(segment: str) -> list[str]:
    simple = segment.isascii()
    if "'" in segment or not (simple or is_normalized("NFC", segment)):
        return [segment]
    parts = _PART.findall(segment.replace("\n", " "))
    if sum(map(len, parts)) != len(segment) - segment.count("\n"):
        return [segment]
    return parts if simple or all(_plain(p) and _plain(p.lower()) for p in parts) else [segment]


def _plain(part: str) -> bool:
    """Letters alone, or no letter, number or code point that Unicode may yet make one."""
    return part.strip(" ").isalpha() or part.isascii() or not any(c.isalnum() or category(c) == "Cn" for c in part)


def _latin(word: str) -> bool:
    """Letters that are their own normal form and have one lower-case letter each, the same in any library."""
    return max(word) < "ɐ" and "İ" not in word


def encoder(path: str, cache: int = CACHE_BYTES) -> Encoder:
    """This worker's encoder for a tokenizer file; its cache is as large as the last caller says. Tasks that use it are of kind "tokens"."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = cache
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
