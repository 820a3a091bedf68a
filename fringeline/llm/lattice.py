"""All occurrences of a vocabulary's pieces in a batch of words, by a suffix array.

The distinct words of a batch are laid end to end, each followed by an end mark, and indexed by a suffix array
that is ordered to the length of the longest piece.  Every piece is looked up by binary search, all pieces at
once; the ranges found are the edges of the lattice, which are put in the order of their positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACE = "▁"
#: Code points of the words that are searched together.
CELLS = 1 << 18


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model; rank orders them by falling score, equal scores alike."""

    pieces: list[str]
    ids: np.ndarray  # id of each ordinary piece
    rank: np.ndarray  # by id
    byte: np.ndarray  # id of each byte
    longest: int

    def __post_init__(self):
        text = [self.pieces[i] for i in self.ids.tolist()]
        self.length = np.fromiter(map(len, text), np.int64, len(text))
        self.letters = np.zeros((len(text), self.longest), np.int32)  # code points of each ordinary piece
        row = np.repeat(np.arange(len(text)), self.length)
        self.letters[row, ranges(np.zeros(len(text), np.int64), self.length)] = np.fromiter(map(ord, "".join(text)), np.int32)

    @property
    def size(self) -> int:
        return len(self.pieces)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The model's vocabulary, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = _read(path)
    return _loaded[path]


def _read(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    ids = np.array([i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))], np.int64)
    scores = np.array([model.get_score(i) for i in range(n)])
    if any(SPACE in pieces[i].lstrip(SPACE) for i in ids.tolist()):
        raise ValueError("a piece spans words")
    byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
    rank = np.unique(-scores, return_inverse=True)[1]
    return Vocabulary(pieces, ids, rank.astype(np.int64), byte, max(len(pieces[i]) for i in ids.tolist()))


@dataclass
class Runs:
    """Words, or parts of words, as code points end to end."""

    code: np.ndarray
    length: np.ndarray

    def __post_init__(self):
        self.start = np.cumsum(self.length) - self.length

    def __len__(self) -> int:
        return len(self.length)

    def one(self, i: int) -> np.ndarray:
        return self.code[self.start[i] : self.start[i] + self.length[i]]

    def some(self, which: np.ndarray) -> Runs:
        size = self.length[which]
        return Runs(self.code[ranges(self.start[which], size)], size)

    def in_cells(self, cells: int = CELLS) -> Iterator[tuple[int, Runs]]:
        """Parts of about so many code points, so a lattice stays small; with the number of each part's first word."""
        part = (np.cumsum(self.length + 1) - 1) // cells
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(self))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield a, Runs(self.code[self.start[a] : self.start[b - 1] + self.length[b - 1]], self.length[a:b])


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first on, size of them, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def joined(words: list[np.ndarray]) -> Runs:
    return Runs(np.concatenate([np.zeros(0, np.int64), *words]), np.fromiter(map(len, words), np.int64, len(words)))


class Lattice:
    """piece[position, length - 1]: id of the piece there, or -1; a word's positions are start to start + length."""

    def __init__(self, words: Runs, vocab: Vocabulary):
        self.length = words.length
        self.start = np.cumsum(self.length + 1) - self.length - 1
        n = int((self.length + 1).sum())
        code = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.start + self.length] = False
        code[inside] = words.code
        self.code = code
        longest = vocab.longest
        self.piece = np.full((n, longest), -1, np.int32)
        if not n:
            return
        number = np.zeros(0x110000, np.int32)  # of each letter that occurs; the end mark has 0
        number[code] = 1
        letters = np.flatnonzero(number)
        number[letters] = np.arange(len(letters))
        bits = max(1, int(len(letters)).bit_length())
        per = max(1, 63 // bits)
        blocks = -(-longest // per)
        padded = np.zeros(n + per * blocks + 1, np.int64)
        padded[:n] = number[code]
        key = np.zeros(n + per * blocks + 1 - per, np.int64)
        for i in range(per):
            key = (key << bits) | padded[i : i + len(key)]
        keys = [key[per * b : per * b + n] for b in range(blocks)]
        array = np.argsort(keys[0])
        own = keys[0][array]
        tie = np.zeros(n, bool)
        tie[1:] = own[1:] == own[:-1]
        tie[:-1] |= tie[1:]
        if blocks > 1:
            tied = array[tie]
            array[tie] = tied[np.lexsort([k[tied] for k in keys[::-1]])]
        # pieces whose letters all occur, as keys of the same form: the least and the greatest suffix they start
        number[0], inside = 0, vocab.letters > 0
        grid = number[vocab.letters]
        known = ((grid > 0) | ~inside).all(1)
        grid, size, ids = grid[known].astype(np.int64), vocab.length[known], vocab.ids[known]
        sides = []
        for fill in (0, (1 << bits) - 1):
            full = np.full((len(grid), per * blocks), fill, np.int64)
            full[:, :longest][inside[known]] = grid[inside[known]]
            want = []
            for b in range(blocks):
                k = np.zeros(len(full), np.int64)
                for i in range(per):
                    k = (k << bits) | full[:, per * b + i]
                want.append(k)
            at = np.searchsorted(own, want[0], "right" if fill else "left")
            long = np.flatnonzero(size > per)  # their first letters alone don't tell
            at[long] = _bisect(keys, array, [k[long] for k in want], fill > 0)
            sides.append(at)
        low, count = sides[0], sides[1] - sides[0]
        edge = np.repeat(np.arange(len(ids)), count)
        where = array[ranges(low, count)]
        self.piece.reshape(-1)[where * longest + size[edge] - 1] = ids[edge]  # scattered into the order of positions


def _bisect(keys: list[np.ndarray], array: np.ndarray, want: list[np.ndarray], right: bool) -> np.ndarray:
    """Place of each wanted key in the suffix array; right: after all suffixes that don't exceed it."""
    low, high = np.zeros(len(want[0]), np.int64), np.full(len(want[0]), len(array))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        at = array[np.minimum(middle, len(array) - 1)]
        before, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for k, w in zip(keys, want, strict=True):
            x = k[at]
            before |= equal & (x < w)
            equal &= x == w
        if right:
            before |= equal
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
