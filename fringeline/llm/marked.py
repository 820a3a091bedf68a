"""Words as a SentencePiece vocabulary sees them, and what is known of them.

A text's spaces become U+2581 with one more in front, and words start where such a mark follows another character;
no piece of the vocabulary spans words.  Words are found on the bytes of Arrow's strings, with the mark still a space.
A word's pieces or scores depend on the word alone, so they are worked out once for each distinct word of a batch,
and kept for the batches after it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fringeline.llm.lattice import CELLS, SPACE, Lattice, Runs, Vocabulary, joined
from fringeline.llm.words import Words, bytes_of, plain_strings

#: Characters of a word that is cut where no piece spans, before anything else is done with it.
LONG = 48
#: Bytes of words that are remembered.
HELD = 1 << 21


def marked_words(texts: pa.Array | pa.ChunkedArray) -> Words:
    """Words of every text, each from its first space on; null and empty texts have none.  U+2581 reads as a space."""
    texts = plain_strings(texts)
    if pc.any(pc.match_substring(texts, SPACE)).as_py():
        texts = pc.replace_substring(texts, SPACE, " ")
    empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    texts = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(space, texts, empty), empty)
    data, bounds = bytes_of(texts)
    mark = data[:-8] == 32
    new = mark.copy()
    new[1:] &= ~mark[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(new)
    return Words(data, start, np.append(start[1:], len(mark))[: len(start)], np.searchsorted(start, bounds))


def code_points(words: list[bytes]) -> Runs:
    """The words with marks for their spaces; bytes that are no UTF-8 become U+FFFD."""
    raw = b"".join(words)
    code = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    length = np.diff(lead[first], prepend=0)
    if lead[-1] != len(code):
        each = [np.frombuffer(w.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for w in words]
        code, length = np.concatenate(each).astype(np.int64), np.fromiter(map(len, each), np.int64, len(each))
    code[code == 32] = ord(SPACE)
    return Runs(code, length)


class Known:
    """Values of the words seen so far; work(words) gives the number of values of each word, and all of them."""

    def __init__(self, work: Callable[[Runs], tuple[np.ndarray, np.ndarray]]):
        self.work = work
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.held, self.first, self.values = 0, np.zeros(1, np.int64), None

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The place in `values` and the number of values of each of these distinct words."""
        if self.held > HELD:
            self.forget()
        new = [w for w in words if w not in self.place]
        if new:
            size, values = self.work(code_points(new))
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.first = np.append(self.first, self.first[-1] + np.cumsum(size))
            self.values = values if self.values is None else np.concatenate([self.values, values])
            self.held += sum(map(len, new))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.first[at], self.first[at + 1] - self.first[at]

    def classes(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the number of its class, and the place and number of values of each class."""
        place, sample = w.classes()
        raw = w.data.tobytes()
        return place, *self.look([raw[a:b] for a, b in zip(w.start[sample].tolist(), w.end[sample].tolist(), strict=True)])


def segments(words: Runs, vocab: Vocabulary, cells: int = CELLS) -> tuple[np.ndarray, Runs]:
    """Parts of words in order, and the word that each is of.

    A word of over LONG characters is cut between characters that no piece spans: every segmentation has a cut there,
    and no merge crosses it.  Words beyond `cells` characters are searched in blocks that overlap by a piece.
    """
    long = np.flatnonzero(words.length > LONG).tolist()
    if not long:
        return np.arange(len(words)), words
    reach = {i: np.zeros(words.length[i], np.int64) for i in long}  # how far the pieces that begin at a character go
    blocks = [(i, a) for i in long for a in range(0, len(reach[i]), cells)]
    for first, cell in joined([words.one(i)[a : a + cells + vocab.longest - 1] for i, a in blocks]).in_cells(cells):
        lattice = Lattice(cell, vocab)
        size = np.ones(len(lattice.code), np.int64)
        for k in range(1, vocab.longest):
            size[lattice.piece[:, k] >= 0] = k + 1
        for (i, a), at in zip(blocks[first : first + len(cell)], lattice.start.tolist(), strict=True):
            n = min(cells, len(reach[i]) - a)
            reach[i][a : a + n] = a + np.arange(n) + size[at : at + n]
    starts = [words.start]
    for i in long:
        starts.append(words.start[i] + np.flatnonzero(np.maximum.accumulate(reach[i])[:-1] <= np.arange(1, len(reach[i]))) + 1)
    start = np.sort(np.concatenate(starts))
    return np.searchsorted(words.start, start, "right") - 1, Runs(words.code, np.diff(start, append=len(words.code)))
