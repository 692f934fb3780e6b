"""Token ids of whole texts by a public byte-level BPE, fast enough for a whole corpus.

The vocabulary's split pattern starts a new pre-token at every space that a non-blank character follows, so the ids
of a text are those of its pieces between such spaces, one after the other. A line break that a non-blank character follows is a
pre-token of its own, so a piece also begins at each of these. A space or line break before a blank doesn't part pieces; texts that have
one are cut by a regular expression, all others by Arrow.

Pieces repeat: Arrow numbers those of a batch, each worker keeps the ids of those it has met (at most ``KEEP``; then it starts anew)
and gives the library only new ones, many at a time.

Ids have two bytes where the vocabulary allows it, four otherwise (``Encoder.kind``, little-endian).
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import only_cache

#: Pieces that a worker keeps.
KEEP = 800_000
#: Characters of new pieces that go to the library in one call; bytes of text that are cut up together.
CALL, SLICE = 20_000, 16_000_000
#: Possible blanks.
_UNSURE = [(0, 0x20), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
#: A space that parts pieces; a space or line break that parts none (in Arrow's syntax).
SURE = re.compile("[ ](?=[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in _UNSURE) + "])")
ODD = "[ \\n](?:\\z|[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _UNSURE) + "])"
#: Goes before a text, so that its first piece, which no space is before, differs from the same piece elsewhere.
FIRST = "\x02"


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.breaks = np.zeros(len(self.opens), bool)  # the line break
        self.breaks[vocabulary.get("Ċ", 0)] = "Ċ" in vocabulary
        self.kind = "<u2" if len(self.opens) <= 1 << 16 else "<u4"
        self.forget()

    def forget(self) -> None:
        #: Piece to its number; by number, where its ids begin in ``flat`` and how many they are.
        self.known: dict[str, int] = {}
        self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, self.kind), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)

    def _keep(self, pieces: list[str], ids: np.ndarray, starts: np.ndarray) -> None:
        """Adds pieces whose ids begin at ``starts`` of ``ids``."""
        n, m = len(self.known), len(pieces)
        while n + m > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + starts
        self.length[n : n + m] = np.diff(np.append(starts, len(ids)))
        self.used += len(ids)
        self.known.update(zip(pieces, range(n, n + m)))

    def _single(self, pieces: list[str], texts: list[str]) -> None:
        """Each by itself."""
        for k in range(0, len(pieces), 500):
            ids = [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts[k : k + 500], add_special_tokens=False)]
            lengths = np.array([len(x) for x in ids])
            self._keep(pieces[k : k + 500], np.concatenate(ids), np.cumsum(lengths) - lengths)

    def _joined(self, pieces: list[str], before: str, starts: np.ndarray) -> None:
        """``before`` goes before each piece, whose ids then begin where ``starts`` says."""
        calls, call, n = [], [], 0
        for p in pieces:
            call.append(p)
            n += len(p) + 1
            if n > CALL:
                calls.append(call)
                call, n = [], 0
        calls += [call] if call else []
        for k in range(0, len(calls), 64):
            some = calls[k : k + 64]
            for call, e in zip(some, self.library.encode_batch_fast([before + before.join(c) for c in some], add_special_tokens=False)):
                ids = np.array(e.ids, self.kind)
                at = np.flatnonzero(starts[ids])
                if len(at) == len(call):
                    self._keep(call, ids, at)
                else:
                    self._single(call, [before + p for p in call])

    def learn(self, pieces: list[str]) -> None:
        first, broken, spaced, odd = [], [], [], []
        for p in pieces:
            (first if p[0] == FIRST else broken if p[0] == "\n" else odd if " " in p else spaced).append(p)
        self._joined(spaced, " ", self.opens)
        self._joined(broken, "", self.breaks)
        self._single(odd, [" " + p for p in odd])
        self._single(first, [p[1:] for p in first])

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces."""
        if len(self.known) + len(pieces) > KEEP:
            self.forget()
        out = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int32, len(pieces))
        new = np.flatnonzero(out < 0)
        if len(new):
            unknown = [pieces[i] for i in new.tolist()]
            self.learn(unknown)
            out[new] = np.fromiter(map(self.known.__getitem__, unknown), np.int32, len(new))
        return out

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        kind = pa.large_string()
        texts = pc.binary_join_element_wise(pa.scalar(FIRST, kind), texts.fill_null(""), pa.scalar("", kind))
        is_odd = pc.match_substring_regex(texts, ODD)
        odd = np.flatnonzero(is_odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(is_odd, pa.scalar(FIRST, kind), texts) if len(odd) else texts
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        pieces, counts = cut.flatten(), np.diff(cut.offsets.to_numpy())
        if len(odd):
            lists = [SURE.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
            more = np.array([len(x) for x in lists])
            # the odd texts' one piece each is replaced by their pieces, which go to the end
            at = (np.cumsum(counts) - counts)[odd]
            pieces = pa.concat_arrays([pieces, pa.array([p for x in lists for p in x], pieces.type)])
            place = np.arange(len(pieces) - int(more.sum()))
            ends = len(place) + np.cumsum(more)
            place = np.concatenate([x for k, a in enumerate(at.tolist()) for x in (place[at[k - 1] + 1 if k else 0 : a], np.arange(ends[k] - more[k], ends[k]))] + [place[at[-1] + 1 :]])
            counts[odd] = more
        coded = pieces.dictionary_encode()
        number = self.numbers(coded.dictionary.to_pylist())
        code = coded.indices.to_numpy()
        code = number[code if not len(odd) else code[place]]
        length = self.length[code]
        ends = np.cumsum(length, dtype=np.int64)
        at = np.repeat((self.start[code] - (ends - length)).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], np.append(0, ends)[np.append(0, np.cumsum(counts))]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (and the last's end); null counts as empty."""
        texts = texts.cast(pa.large_string())
        size = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy())
        cuts = np.flatnonzero(np.diff(size // SLICE, prepend=0) > 0).tolist()
        ids, offsets, total = [np.zeros(0, self.kind)], [np.zeros(1, np.int64)], 0
        for a, b in zip([0, *cuts], [*cuts, len(texts)]):
            if a < b:
                some, at = self._slice(texts.slice(a, b - a))
                ids.append(some)
                offsets.append(at[1:] + total)
                total += len(some)
        pa.default_memory_pool().release_unused()  # the pieces of a slice take several times its bytes
        return np.concatenate(ids), np.concatenate(offsets)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text the bytes of its ids, of ``kind`` each."""
        ids, at = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    only_cache("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    return np.insert(ids, at[1:], end_id), at + np.arange(len(at))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
