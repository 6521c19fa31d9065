"""Token ids of whole texts with the tokenizers library, each distinct piece encoded once.

A byte-level BPE tokenizer first cuts a text into pieces (words with their
leading space, digits, punctuation, white space) and encodes each piece by
itself. So it is enough to find the pieces of a text, and let the library
encode each distinct piece the first time a worker meets it. Finding pieces is
done on arrays. Texts this does not cover (characters beyond U+024F, strings
of special tokens) are given to the library whole. Results are the library's.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from panelwright.llm.common import mix, powers, steps

# Pieces a worker remembers before it starts anew: bounds memory only.
MOST_PIECES = 1_500_000
_LATIN = 0x250
_CHAR_BASE = 0x2545F4914F6CDD1D
_SUFFIX = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}
_WHITE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0}
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4


def _classes() -> np.ndarray:
    out = np.full(_LATIN, _OTHER, np.uint8)
    for i in range(_LATIN):
        kind = unicodedata.category(chr(i))[0]
        out[i] = _SPACE if i in _WHITE else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    return out


CLASSES = _classes()


def default_path() -> str:
    """The public 50k byte-level vocabulary; any tokenizers file can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """First characters of the pieces of texts chars[begin:end] (texts are not empty)."""
    kind = CLASSES[chars]
    n = len(chars)
    white, blank = kind == _SPACE, chars == 0x20
    starts = np.zeros(n, bool)
    changed = kind[1:] != kind[:-1]
    # a run of white space starts a piece, and so does its last character
    starts[1:] = np.where(white[1:], changed, changed & ~blank[:-1])
    starts[:-1] |= white[:-1] & ~white[1:]
    # at the end of a text white space is one piece
    last = end - 1
    inner = white[last] & (last > begin)
    keep = last[inner][white[last[inner] - 1]]
    starts[keep] = False
    starts[begin] = True
    quotes = np.flatnonzero(chars == 0x27)
    if len(quotes):
        text_end = end[np.searchsorted(begin, quotes, "right") - 1]
        for q, stop in zip(quotes.tolist(), text_end.tolist()):
            if not starts[q]:
                continue
            two = "".join(map(chr, chars[q + 1 : min(q + 3, stop)]))
            k = _SUFFIX.get(two[:1]) or _SUFFIX.get(two)
            if k:
                starts[q + 1 : q + 1 + k] = False
                if q + 1 + k < stop:
                    starts[q + 1 + k] = True if not white[q + 1 + k] else starts[q + 1 + k]
    return np.flatnonzero(starts)


class Numbers:
    """Numbers of 64-bit hashes in order of arrival: open addressing on arrays."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 if it is new."""
        slot = hashes & self.mask
        out = np.where(self.keys[slot] == hashes, self.values[slot], -2)
        out[self.values[slot] < 0] = -1
        left = np.flatnonzero(out == -2)
        step = np.uint64(1)
        while len(left):
            slot = (hashes[left] + step) & self.mask
            value = self.values[slot]
            done = (value < 0) | (self.keys[slot] == hashes[left])
            out[left[done]] = value[done]
            left, step = left[~done], step + np.uint64(1)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Distinct new hashes get the next numbers."""
        if 2 * (self.n + len(hashes)) > len(self.keys):
            held = self.values >= 0
            old, number = self.keys[held], self.values[held]
            self._clear(max(16, (4 * (self.n + len(hashes))).bit_length()))
            self._place(old, number)
        self._place(hashes, np.arange(self.n, self.n + len(hashes), dtype=np.int32))
        self.n += len(hashes)

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        step = np.uint64(0)
        while len(hashes):
            slot = (hashes + step) & self.mask
            free = np.flatnonzero(self.values[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = hashes[won], numbers[won]
            rest = np.ones(len(hashes), bool)
            rest[won] = False
            hashes, numbers, step = hashes[rest], numbers[rest], step + np.uint64(1)


class Encoder:
    """Ids (and character spans, if asked for) of texts for one tokenizer file."""

    def __init__(self, path: str | None = None, offsets: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path or default_path())
        self.offsets = offsets
        pre = str(self.lib.pre_tokenizer)
        self.by_piece = (
            pre.startswith("ByteLevel(") and "add_prefix_space=False" in pre and "use_regex=True" in pre
            and self.lib.normalizer is None and self.lib.post_processor is None
        )
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.bytes_of = np.zeros(self.lib.get_vocab_size() + 1, np.int64)
        for token, i in self.lib.get_vocab().items():  # a byte-level token has one character a byte
            self.bytes_of[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers()
        self.first, self.count, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.pool, self.filled = np.zeros((4096, 3 if self.offsets else 1), np.int32), 0

    def vocabulary(self) -> int:
        return self.lib.get_vocab_size()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces; words after a blank are encoded as one text, which the library cuts there anyway."""
        plain = [i for i, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        rest = np.ones(len(pieces), bool)
        rest[plain] = False
        rest = np.flatnonzero(rest).tolist()
        coded = self.lib.encode_batch([pieces[i] for i in rest], add_special_tokens=False) if rest else []
        parts = [np.column_stack([np.array(c.ids, np.int32), np.array(c.offsets, np.int32).reshape(-1, 2)]) for c in coded]
        order, lengths = rest, [len(c.ids) for c in coded]
        for x in range(0, len(plain), 4096):
            own = [pieces[i] for i in plain[x : x + 4096]]
            text = "".join(own)
            whole = self.lib.encode(text, add_special_tokens=False) if self.offsets else self.lib.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(whole.ids, np.int32)
            size = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in own])
            stop = np.searchsorted(np.cumsum(self.bytes_of[ids]), size) + 1
            n = np.diff(stop, prepend=0)
            rows = np.zeros((len(ids), 3), np.int32)
            rows[:, 0] = ids
            if self.offsets:
                begin = np.cumsum([0, *map(len, own)])[:-1]
                rows[:, 1:] = np.array(whole.offsets, np.int32) - np.repeat(begin, n)[:, None]
            parts.append(rows)
            order, lengths = order + plain[x : x + 4096], lengths + n.tolist()
        flat = np.concatenate(parts)[:, : self.pool.shape[1]]
        lengths, order = np.array(lengths, np.int64), np.array(order)
        if self.used + len(pieces) > len(self.first):
            more = max(len(self.first), len(pieces))
            self.first, self.count = (np.concatenate([v, np.zeros(more, np.int64)]) for v in (self.first, self.count))
        if self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros((max(len(self.pool), len(flat)), self.pool.shape[1]), np.int32)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.count[self.used + order], self.first[self.used + order] = lengths, self.filled + np.cumsum(lengths) - lengths
        self.used, self.filled = self.used + len(pieces), self.filled + len(flat)

    def _by_library(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.lib.encode_batch(texts, add_special_tokens=False)
        if self.offsets:
            return [np.column_stack([np.array(c.ids, np.int32), np.array(c.offsets, np.int32).reshape(-1, 2)]) for c in coded]
        return [np.array(c.ids, np.int32)[:, None] for c in coded]

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        end = np.cumsum([len(t) for t in texts])
        begin = end - [len(t) for t in texts]
        a = piece_starts(chars, begin, end)
        b = np.append(a[1:], len(chars))
        up, down = powers(_CHAR_BASE, len(chars) + 1)
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(0x10001)) * up[:-1], out=total[1:])
        h = mix((total[b] - total[a]) * down[a])
        if self.known.n > MOST_PIECES:
            self._forget()
        known = self.known.find(h)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            new, where = np.unique(h[missing], return_index=True)
            at = missing[where]
            self._learn([joined[x:y] for x, y in zip(a[at].tolist(), b[at].tolist())])
            self.known.add(new)
            known[missing] = self.known.find(h[missing])
        n = self.count[known]
        stop = np.cumsum(n)
        token = np.repeat(self.first[known] - (stop - n), n) + np.arange(stop[-1])
        out = self.pool[token]
        cut = stop[np.searchsorted(a, end) - 1]
        if self.offsets:
            text = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], cut])))
            out[:, 1:] += (np.repeat(a, n) - begin[text])[:, None].astype(np.int32)
        return np.split(out, cut[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array per text: ids, or rows of (id, first character, end character)."""
        width = 3 if self.offsets else 1
        out: list[np.ndarray | None] = [None] * len(texts)
        for x, y in steps(texts):
            plain, rest = [], []
            for i in range(x, y):
                t = texts[i]
                if not t:
                    out[i] = np.empty((0, width), np.int32)
                elif self.by_piece and _is_latin(t) and not any(s in t for s in self.special):
                    plain.append(i)
                else:
                    rest.append(i)
            for group, way in ((plain, self._by_pieces), (rest, self._by_library)):
                if group:
                    for i, got in zip(group, way([texts[i] for i in group])):
                        out[i] = got
        return out if self.offsets else [o[:, 0] for o in out]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return max(text) < chr(_LATIN)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str | None, offsets: bool = False) -> Encoder:
    """The worker's encoder for a file, kept between batches and tasks."""
    if (path, offsets) not in _ENCODERS:
        _ENCODERS[path, offsets] = Encoder(path, offsets)
    return _ENCODERS[path, offsets]
