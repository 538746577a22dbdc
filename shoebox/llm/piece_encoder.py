"""Byte-level BPE of whole texts by their repeated pieces, over Arrow buffers.

The pre-tokens of byte-level BPE never span a space that stands between two characters that are not white space (the
space begins the next one), a lone line break, or the place between a letter and a mark after it. Texts are cut there,
the pieces are dictionary-encoded, and only pieces that the worker has not met are given to the tokenizer; ids are then gathered
for all pieces at once in numpy. Where a cut is in doubt (other white space, special tokens) none is made, which gives longer
pieces and the same ids. Tokenizers with other pre-tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Pieces that a worker remembers; beyond, it keeps those that came again.
CACHE_PIECES = 700_000
#: Bytes of text that are worked on at a time, if they can be cut there.
GROUP = 4 << 20
#: Pieces that are tokenized as one text.
_TOGETHER = 20_000

_BYTE = np.arange(256)
#: Bytes of ASCII white space, and of the separators that some take for white space.
_WHITE = np.isin(_BYTE, [*range(0x09, 0x0E), *range(0x1C, 0x21)])
_BREAK = np.isin(_BYTE, [0x0A, 0x20])
#: Marks that end a pre-token of letters (an apostrophe may belong to it).
_MARK = np.isin(_BYTE, np.frombuffer(b".,;:!?#$%&*|", np.uint8))
_LETTER = np.isin(_BYTE, [*range(65, 91), *range(97, 123)])
#: First bytes of two-byte letters; of those after C3, two are signs (97, B7).
_LEAD = np.isin(_BYTE, [*range(0xC3, 0xC9), 0xD0, 0xD1])
#: White space beyond ASCII.
_WIDE = np.array(sorted(int.from_bytes(chr(c).encode().rjust(3, b"\0"), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _solid(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character that begins at `first` (or, of the others, ends at `last`) is no white space; both index data."""
    own = ~_WHITE[data[first]] & ~_WHITE[data[last]]
    high = np.flatnonzero(own & ((data[first] >= 0x80) | (data[last] >= 0x80)))
    if len(high):
        n = len(data) - 1
        for at in (first[high], last[high] - 2):
            code = (data[np.clip(at, 0, n)].astype(np.int64) << 16) | (data[np.clip(at + 1, 0, n)].astype(np.int64) << 8) | data[np.clip(at + 2, 0, n)]
            own[high] &= ~np.isin(code, _WIDE)
        for at in (first[high], last[high] - 1):
            code = (data[np.clip(at, 0, n)].astype(np.int64) << 8) | data[np.clip(at + 1, 0, n)]
            own[high] &= ~np.isin(code, _WIDE)
    return own


def cuts(data: np.ndarray, offsets: np.ndarray, marks: bool = True) -> np.ndarray:
    """Sorted places, with those of offsets (from 0 to the end), between which each piece can be encoded alone."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    edge = cut.copy()
    at = np.flatnonzero(_BREAK[data])
    at = at[~edge[at] & ~edge[at + 1]]
    at = at[_solid(data, at + 1, at - 1)]
    cut[at] = True
    cut[at[data[at] == 0x0A] + 1] = True
    if marks:
        at = np.flatnonzero(_MARK[data])
        at = at[~edge[at]]
        before = data[at - 1]
        two = data[np.maximum(at - 2, 0)]
        letter = _LETTER[before] | ((before >= 0x80) & _LEAD[two] & ~((two == 0xC3) & ((before == 0x97) | (before == 0xB7))) & (at > 1))
        cut[at[letter]] = True
    return np.flatnonzero(cut)


def _gathered(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ids with these numbers one after another, where each begins and the last ends); run i is ids[ends[i] : ends[i + 1]]."""
    start, n = ends[which], ends[which + 1] - ends[which]
    done = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat(start - done[:-1], n) + np.arange(done[-1])], done


class Encoder:
    """Ids of whole texts by a tokenizer file; equal to what the tokenizer itself gives."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added]
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.by_pieces = (
            spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
            and not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added)
        )
        special = {t.content for t in added}
        #: Bytes that each id stands for.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token.encode()) if token in special else len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends, self.met = np.empty(0, self.dtype), np.zeros(1, np.int64), np.empty(0, bool)

    def _shrink(self) -> None:
        """Keep the pieces that were met again after they had been learned, if these are few enough."""
        kept, pieces = np.flatnonzero(self.met), list(self.known)
        ids, ends = self.ids, self.ends
        self._forget()
        if 2 * len(kept) <= CACHE_PIECES:
            self.known = {pieces[i]: k for k, i in enumerate(kept.tolist())}
            self.ids, self.ends = _gathered(ids, ends, kept)
            self.met = np.zeros(len(kept), bool)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of pieces that begin with a space: encoded as one text, told apart by their bytes."""
        ids = self._ids([b"".join(pieces).decode()])[0]
        ends = np.cumsum([len(p) for p in pieces])
        done = np.cumsum(self.width[ids])
        last = np.searchsorted(done, ends)
        if len(done) == 0 or last[-1] >= len(done) or (done[last] != ends).any():
            raise ValueError("a piece is no run of pre-tokens of this tokenizer")
        return ids, np.diff(last, prepend=-1)

    def _learn(self, plain: list[bytes], rest: list[bytes]) -> None:
        """plain: pieces of a space and characters that neither begin nor end with white space."""
        flat, counts, order = [self.ids], [], plain + rest
        for at in range(0, len(plain), _TOGETHER):
            ids, n = self._joined(plain[at : at + _TOGETHER])
            flat.append(ids)
            counts.append(n)
        if rest:
            got = self._ids([p.decode() for p in rest])
            flat += got
            counts.append(np.array([len(x) for x in got]))
        first = len(self.known)
        self.known.update(zip(order, range(first, first + len(order)), strict=True))
        self.ids = np.concatenate(flat)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        self.met = np.concatenate([self.met, np.zeros(len(order), bool)])

    def _entries(self, words: pa.Array) -> np.ndarray:
        """Where the worker's memory holds each of these distinct pieces, all of which it then has."""
        pieces = words.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(pieces) > CACHE_PIECES:
            self._shrink()
        entry = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        fresh = entry < 0
        self.met[entry[~fresh]] = True
        if fresh.any():
            offsets, data = np.frombuffer(words.buffers()[1], np.int32)[: len(pieces) + 1].astype(np.int64), np.frombuffer(words.buffers()[2], np.uint8)
            start, end = offsets[:-1], offsets[1:]
            plain = (data[start] == 0x20) & (end - start > 1)
            plain[plain] = _solid(data, start[plain] + 1, end[plain] - 1)
            first = len(self.known)
            order = [np.flatnonzero(fresh & plain), np.flatnonzero(fresh & ~plain)]
            self._learn(*[[pieces[i] for i in x.tolist()] for x in order])
            entry[np.concatenate(order)] = np.arange(first, len(self.known))
        return entry

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, number of ids of each row) of UTF-8 rows; offsets run from 0 to the end of data."""
        if not len(data):
            return np.empty(0, self.dtype), np.zeros(len(offsets) - 1, np.int64)
        if not self.by_pieces:
            got = self._ids([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            return np.concatenate(got), np.array([len(x) for x in got])
        raw = np.ascontiguousarray(data)
        places = cuts(raw, offsets, marks=not self._holds_special(raw))
        coded = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        entry = self._entries(coded.dictionary)[coded.indices.to_numpy()]
        ids, done = _gathered(self.ids, self.ends, entry)
        return ids, np.diff(done[np.searchsorted(places, offsets)])

    def _holds_special(self, data: np.ndarray) -> bool:
        text = data.tobytes()
        return any(s in text for s in self.special)

    def part(self, data: np.ndarray, most: int = GROUP) -> int:
        """How many bytes at the start of one row can be encoded alone: about `most`, or all."""
        while self.by_pieces and most < len(data):
            window = data[: most + 4]
            places = cuts(window, np.array([0, len(window)]), False)
            places = places[(places > 0) & (places <= most)]
            if len(places):
                return int(places[-1])
            most *= 2
        return len(data)


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder; what it has learned stays for the worker's later tasks."""
    return Encoder(path)
