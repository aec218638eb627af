"""Token ids of whole texts, with each distinct word encoded once by a worker.

A byte-pair model with word ends treats the pieces of its pre-tokenizer one by one, so
the ids of a text are those of its pieces. Pieces are cut by the rules of the model's
own pattern, on code points, and looked up by a 64-bit hash; the library encodes those
met first. Texts outside the range where that is safe go to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from panelgrid.llm.text import bytes_of, range_hash, worker_cache

END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHE_PIECES = 1 << 20
SPACE, LETTER, NUMBER, OTHER, UNSAFE = range(5)
#: the contractions of the pattern, cut off where an apostrophe begins a piece (fixed values)
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """Class of each code point below 0x250; unsafe where engines differ or normalization does more than fold case."""
    out = np.full(0x251, UNSAFE, dtype=np.uint8)  # the last entry stands for all above
    for c in [*range(0x20, 0x7F), *range(0xA1, 0x250)]:
        text = chr(c)
        out[c] = LETTER if text.isalpha() else NUMBER if text.isnumeric() else OTHER
    out[[0x09, 0x0A, 0x0D, 0x20]] = SPACE
    out[0x130] = UNSAFE
    return out


CLASSES = _classes()


class Encoder:
    """Encodes texts with one tokenizer file. The piece table is emptied when full: it is a cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.slots = 2 * CACHE_PIECES
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, dtype=np.uint64)
        self.start = np.zeros(self.slots, dtype=np.int64)
        self.length = np.zeros(self.slots, dtype=np.int32)
        self.ids = np.empty(1 << 20, dtype=np.uint32)
        self.filled = self.pieces = 0

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each hash, by linear probing, and whether it is taken by that hash."""
        slot = (h % np.uint64(self.slots)).astype(np.int64)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != h) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.slots
            held[open_] = self.keys[slot[open_]]
            open_ = open_[(held[open_] != h[open_]) & (held[open_] != 0)]
        return slot, held == h

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        encoded = self.model.encode_batch_fast(
            [" ".join(texts[i : i + 2000]) for i in range(0, len(texts), 2000)], add_special_tokens=False
        )
        found = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in encoded])
        stops = np.flatnonzero(self.ends[found]) + 1
        if len(stops) != len(texts):
            raise ValueError("the tokenizer does not end every piece with a word-end token")
        while self.filled + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.filled : self.filled + len(found)] = found
        starts = np.concatenate([[0], stops[:-1]])
        left = np.arange(len(h))
        while len(left):
            slot, _ = self._find(h[left])
            _, first = np.unique(slot, return_index=True)  # one new piece a slot and round
            put, at = left[first], slot[first]
            self.keys[at] = h[put]
            self.start[at] = self.filled + starts[put]
            self.length[at] = (stops - starts)[put]
            left = np.delete(left, first)
        self.filled += len(found)
        self.pieces += len(h)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each followed by the end id, and ``n + 1`` offsets."""
        data, offsets = bytes_of(column)
        n = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        kind = CLASSES[np.minimum(points, 0x250)]
        odd = np.flatnonzero(kind == UNSAFE)
        special = np.flatnonzero((points[:-1] == ord("<")) & (points[1:] == ord("|"))) if len(points) else odd
        whole = np.unique(np.searchsorted(at, np.concatenate([odd, special]), side="right") - 1)
        low = np.where((points >= 65) & (points <= 90), points + 32, points)
        start, end = self._pieces(low, kind, at)
        row = np.searchsorted(at, start, side="right") - 1
        if len(whole):
            kept = ~np.isin(row, whole)
            start, end, row = start[kept], end[kept], row[kept]
        h = range_hash(low, start, end)
        h[h == 0] = 1
        if self.pieces > CACHE_PIECES - min(len(h), CACHE_PIECES):
            _, first = np.unique(h, return_index=True)
            if self.pieces + len(first) > CACHE_PIECES:
                self.clear()
                while self.slots < 2 * len(first):
                    self.slots *= 2
                    self.clear()
        slot, known = self._find(h)
        if not known.all():
            missing = np.flatnonzero(~known)
            fresh, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            self._learn(fresh, [low[a:b].tobytes().decode("utf-32-le") for a, b in zip(start[first], end[first])])
            slot[missing], known = self._find(h[missing])
        lengths = self.length[slot].astype(np.int64)
        total = np.bincount(row, weights=lengths, minlength=n).astype(np.int64)
        alone = {
            int(i): np.array(self.model.encode(column[int(i)].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            for i in whole
        }
        for i, ids in alone.items():
            total[i] = len(ids)
        out = np.concatenate([[0], np.cumsum(total + 1)]).astype(np.int64)
        ids = np.empty(out[-1], dtype=np.uint32)
        ids[out[1:] - 1] = END_ID
        inner = np.cumsum(lengths) - lengths
        ends = np.cumsum(lengths)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[slot] - inner, lengths)
        # pieces of a row are written from its start on; rows that went whole have none
        pieces_before = np.concatenate([[0], np.cumsum(np.bincount(row, weights=lengths, minlength=n))]).astype(np.int64)
        target = np.arange(len(source)) + np.repeat((out[:-1] - pieces_before[:-1])[row], lengths)
        ids[target] = self.ids[source]
        for i, own in alone.items():
            ids[out[i] : out[i] + len(own)] = own
        return ids, out

    @staticmethod
    def _pieces(low: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letter runs, single numbers, runs of other characters, with contractions cut off."""
        n = len(low)
        if n == 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        new = np.empty(n, dtype=bool)
        new[0] = True
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        new |= edge[:n]
        start = np.flatnonzero(new)
        end = np.append(start[1:], n)
        is_quote = (low[start] == ord("'")) & (end - start == 1)
        is_quote[-1] = False
        quotes = np.flatnonzero(is_quote)
        quotes = quotes[(kind[start[quotes + 1]] == LETTER) & ~edge[start[quotes + 1]]]
        for q in quotes.tolist():  # rare in running text
            a, b = int(start[q + 1]), int(end[q + 1])
            tail = low[a : min(a + 2, b)].tobytes().decode("utf-32-le")
            suffix = next((s for s in SUFFIXES if tail.startswith(s)), "")
            end[q] += len(suffix)
            start[q + 1] += len(suffix)
        kept = (end > start) & (kind[np.minimum(start, n - 1)] != SPACE)
        return start[kept], end[kept]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]
