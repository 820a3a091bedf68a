"""Near-duplicate documents by the Jaccard similarity of their shingle sets, by parity sketches.

A sketch deals a set's shingles by hash into k segments, and XORs the 64-bit hashes of a segment's shingles
into one word of parity bits.  A segment can differ between two sets only if it holds a shingle of their
symmetric difference, so the number of differing segments is a lower bound of that difference, as the Hamming
distance of the bits is.  Sets of sizes a and b that reach the similarity n/d differ by at most
(d - n) (a + b) / (d + n) shingles, so of m filled segments at least m minus that many are equal (pigeonhole).
Sketches are compared within size bands: k doubles from band to band, and a set whose partners may fall into
the next band is sketched there as well.  A set too unevenly dealt for the bound is sketched again with finer
segments, at last with one for each shingle, so no pair is missed.  Sets of which too few segments occur in
another set are out; the rest meet by equal segments, and every link is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeline.llm import exchange as X
from fringeline.llm.components import components
from fringeline.llm.shared import written
from fringeline.llm.words import U64, Words, mix, words_of

LAST = np.iinfo(np.int64).max
#: Bytes of text that a task holds; sets and sketches take some seventy times as much.
BUCKET_BYTES = 4 << 20
#: Segments of a band, as a part of its smallest size; finer sketches have more, the last one for each shingle.
DENSITY = (0.7, 2.8, 0)
ROWS = "doc_id long, n_shingles long, class_id long, segments array<long>, shingles array<long>, bits binary"


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and the sorted distinct shingle hashes of each; a text of fewer words has one shingle of all of them."""
    n, count = len(w), np.diff(w.first)
    h, doc = w.hashes(), w.doc()
    i = np.arange(max(n - size + 1, 0))
    i = i[doc[i] == doc[i + size - 1]]
    s = np.full(len(i), size, U64)
    for k in range(size):
        s = mix(s * U64(3) ^ h[i + k])
    owner = doc[i]
    for length in range(1, size):
        short = np.flatnonzero(count == length)
        if len(short):
            x = np.full(len(short), length, U64)
            for k in range(length):
                x = mix(x * U64(3) ^ h[w.first[short] + k])
            s, owner = np.concatenate([s, x]), np.concatenate([owner, short])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = X.group_starts(owner, s)
    s, owner = s[new], owner[new]
    return np.searchsorted(owner, np.arange(len(count) + 1)), s


def sketches(rows: np.ndarray, first: np.ndarray, s: np.ndarray, n: int, d: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sketches of these texts, as (row, word) of each filled segment with the row's count of them and the most that can differ."""
    size = np.diff(first)[rows]
    rows, size = rows[size > 0], size[size > 0]
    home = np.frexp(size.astype(np.float64))[1].astype(np.int64) - 1
    most = size * d // n
    guest = most >= (1 << (home + 1))
    out = []
    for band, own, limit in ((home, rows, np.minimum(most, (1 << (home + 1)) - 1)), (home[guest] + 1, rows[guest], most[guest])):
        own_size = np.diff(first)[own]
        differ = (d - n) * (own_size + limit) // (d + n)
        for fine, density in enumerate(DENSITY):
            if not len(own):
                break
            k = np.ceil(density * (1 << band)).astype(np.int64)
            at = np.repeat(np.arange(len(own)), own_size)
            elem = s[np.repeat(first[own], own_size) + np.arange(len(at)) - np.repeat(np.cumsum(own_size) - own_size, own_size)]
            code = mix(elem + U64(0x2545F4914F6CDD1D))
            if density:
                segment = ((code >> U64(32)) * k[at].astype(U64)) >> U64(32)
                order = np.argsort((at.astype(U64) << U64(32)) | segment)
                segment, at, code = segment[order], at[order], mix(elem[order])
                new = X.group_starts(at, segment)
                start = np.flatnonzero(new)
                word = mix(np.bitwise_xor.reduceat(code, start)) ^ mix(segment[start] + U64(1))
                at = at[start]
            else:
                word = code
            word = mix(word ^ mix((band[at] * 4 + fine + 1).astype(U64)))
            filled = np.bincount(at, minlength=len(own))
            out.append((own[at], word, filled[at], differ[at]))
            weak = filled <= differ
            band, own, own_size, differ = band[weak], own[weak], own_size[weak], differ[weak]
    return out


#: Bits of a sketch at most: it goes to every key range that its document's segments touch.
MOST_BITS = 4096


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set, two to four for each shingle up to MOST_BITS; the halves of a sketch XOR to the next smaller one."""
    size = min(MOST_BITS, 64 << max(0, int(2 * len(s) - 1).bit_length() - 6))
    odd = np.bincount((mix(s ^ U64(0x94D049BB133111EB)) & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class BitSketches:
    """Bit sketches of documents, by their sizes; differences() is the Hamming distance of each pair's."""

    def __init__(self, bits: list[bytes]):
        size = np.fromiter(map(len, bits), np.int64, len(bits))
        self.level = np.frexp(size.astype(float))[1].astype(np.int64)
        self.place = np.zeros(len(bits), np.int64)
        self.own, self.half = {}, {}
        for level in np.unique(self.level).tolist():
            rows = np.flatnonzero(self.level == level)
            self.place[rows] = np.arange(len(rows))
            m = np.frombuffer(b"".join(bits[i] for i in rows.tolist()), U64).reshape(len(rows), -1)
            self.own[level] = m
            self.half[level] = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]

    def differences(self, a: np.ndarray, b: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """At most the symmetric difference of the pair's sets; 0 where the sketches' sizes are far apart."""
        out = np.zeros(len(a), np.int64)
        for step, left, right in ((0, self.own, self.own), (1, self.half, self.own), (-1, self.own, self.half)):
            for level in self.own:
                rows = np.flatnonzero((self.level[a] == level) & (self.level[b] == level - step))
                for i in range(0, len(rows), block):
                    r = rows[i : i + block]
                    out[r] = np.bitwise_count(left[level][self.place[a[r]]] ^ right[level - step][self.place[b[r]]]).sum(1)
        return out


def set_rows(docs: DataFrame, shingle: int, similarity: tuple[int, int], bucket_bytes: int) -> DataFrame:
    """ROWS, written: each input row's class, and of rows that stand for a class and may have a partner the set and sketches."""
    n, d = similarity
    buckets = X.bucket_count(docs, bucket_bytes)
    texts = X.in_buckets(docs, buckets)

    def sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, offsets, shingles, rows that have a set and an id, and the two hashes of these rows' sets."""
        first, s = shingle_sets(words_of(table["text"], lower=True), shingle)
        ids = table["doc_id"].fill_null(LAST).to_numpy()
        rows = np.flatnonzero((np.diff(first) > 0) & table["doc_id"].is_valid().to_numpy())
        total = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(s + U64(c)))]) for c in (11, 29)]
        a, b = (mix(x[first[rows + 1]] - x[first[rows]]) for x in total)
        return ids, first, s, rows, a, b

    def distinct_sets(ids: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids[rows], b, a))
        new = X.group_starts(a[order], b[order])
        place = np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new) - 1
        return a[order][new], b[order][new], ids[rows][order][new], place

    def sets(key: tuple, table: pa.Table) -> pa.Table:
        ids, _, _, rows, a, b = sets_of(table)
        keys, more, least, _ = distinct_sets(ids, rows, a, b)
        return X.pack(key[0].as_py(), keys, [more, least], buckets)

    def least_of(cols: list[np.ndarray]) -> np.ndarray:
        keys, more, least = cols
        order = np.lexsort((least, more, keys))
        new = X.group_starts(keys[order], more[order])
        out = np.empty(len(keys), np.int64)
        if len(keys):
            out[order] = least[order][new][np.cumsum(new) - 1]
        return out

    class Bucket:
        """Classes of a bucket's rows, and the sketches of the rows that stand for their class."""

        def __init__(self, table: pa.Table, replies: pa.Table):
            self.ids, self.first, self.s, rows, a, b = sets_of(table)
            keys, _, _, place = distinct_sets(self.ids, rows, a, b)
            self.classes = np.full(len(self.ids), LAST)
            self.classes[rows] = X.replies_of(replies, 0, keys, buckets, np.int64)[place]
            own = np.flatnonzero(self.ids[rows] == self.classes[rows])
            order = np.lexsort((a[own], self.ids[rows][own]))
            own = own[order][X.group_starts(self.ids[rows][own][order], a[own][order])]
            parts = sketches(np.sort(rows[own]), self.first, self.s, n, d)
            self.part = np.concatenate([np.full(len(p[0]), k) for k, p in enumerate(parts)] or [np.zeros(0, np.int64)])
            self.row, word, self.filled, self.differ = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.argsort(word, kind="stable")
            sorted_word = word[order]
            new = X.group_starts(sorted_word)
            group = np.cumsum(new) - 1
            self.word, self.keys = word, sorted_word[new]
            self.several = np.bincount(group, minlength=len(self.keys)) > 1
            self.place = np.empty(len(word), np.int64)
            self.place[order] = group

    def segments(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        b = Bucket(table, replies)
        return X.pack(key[0].as_py(), b.keys, [b.several], buckets)

    def is_shared(cols: list[np.ndarray]) -> np.ndarray:
        _, place, count = np.unique(cols[0], return_inverse=True, return_counts=True)
        several = np.zeros(len(count), bool)
        several[place[cols[1]]] = True
        return ((count > 1) | several)[place]

    def kept(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        """All rows; of those that may have a partner also the set and the first words of each sketch, in the words' order."""
        b = Bucket(table, replies)
        shared = X.replies_of(replies, 1, b.keys, buckets, bool)[b.place]
        order = np.lexsort((b.word, b.part, b.row))
        row, part, shared, word, filled, differ = (x[order] for x in (b.row, b.part, shared, b.word, b.filled, b.differ))
        start = np.flatnonzero(X.group_starts(row, part))
        sketch = np.cumsum(X.group_starts(row, part)) - 1
        rank = np.arange(len(row)) - (start[sketch] if len(start) else 0)
        common = np.bincount(sketch, shared, len(start))
        enough = common >= np.maximum(1, filled[start] - differ[start]) if len(start) else np.zeros(0, bool)
        use = shared & (rank <= differ) & enough[sketch] if len(start) else np.zeros(0, bool)
        row, word = row[use], word[use]
        cut = np.searchsorted(row, np.arange(table.num_rows + 1))
        has = np.diff(cut) > 0
        size = np.diff(b.first)
        listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64), pa.int64()))
        take = np.repeat(has, size)
        valid = table["doc_id"].is_valid().to_numpy()
        own = np.where(b.classes == LAST, b.ids, b.classes)
        return pa.table({"doc_id": table["doc_id"].cast(pa.int64()), "n_shingles": pa.array(size, pa.int64()), "class_id": pa.array(own, pa.int64(), mask=~valid), "segments": listed(cut, word), "shingles": listed(np.concatenate([[0], np.cumsum(size * has)]), b.s[take]), "bits": pa.array([bit_sketch(b.s[b.first[i] : b.first[i + 1]]) if has[i] else None for i in range(table.num_rows)], pa.binary())})

    asked = texts.groupBy("t").applyInArrow(sets, X.ASK)
    classes = X.answers(asked, 0, [U64, U64, np.int64], least_of)
    tried = texts.groupBy("t").cogroup(classes.groupBy("t")).applyInArrow(segments, X.ASK)
    shared = X.answers(tried, 1, [U64, bool], is_shared)
    return written(texts.groupBy("t").cogroup(classes.unionByName(shared).groupBy("t")).applyInArrow(kept, ROWS), "sets")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: tuple[int, int] = (3, 4), bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Documents linked where the Jaccard similarity of their sets of word shingles is at least n/d.

    A-Z count as a-z.  Returns for each input row: doc_id, n_shingles, class_id (smallest doc_id with the same set)
    and component_id (smallest doc_id reachable by links, itself included).  A text of fewer words than a shingle
    has one shingle of all of them; null and empty texts have none and link with nothing.  Rows of one doc_id are
    one document, which has the links of each of its texts; rows with a null doc_id link with nothing, and their
    class_id and component_id are null.  Texts of any length are taken whole.  Extra columns are ignored.  An empty table gives an empty one.
    """
    n, d = similarity
    rows = set_rows(docs, shingle, similarity, bucket_bytes)
    some = rows.where(F.size("segments") > 0)
    best = written(stars(some), "pairs")
    found = written(verified(some, best, n, d), "links")
    roots = written(components(found), "roots")
    rest = written(crossing(some.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left"), best, n, d), "pairs")
    links = found.unionByName(verified(some, rest, n, d)).unionByName(same_id(rows))
    root = components(links)
    return rows.select("doc_id", "n_shingles", "class_id").join(root.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("component_id"))


def links(docs: DataFrame, *, shingle: int = 5, similarity: tuple[int, int] = (3, 4), bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every link (a, b), a > b, between documents that stand for their class (class_id = doc_id) in near_duplicates().

    Null and empty texts and rows without doc_id link with nothing; repeated rows are of one class and give one link;
    texts of any length are taken whole; other columns are ignored; an empty table gives no links.
    """
    n, d = similarity
    rows = set_rows(docs, shingle, similarity, bucket_bytes)
    some = rows.where(F.size("segments") > 0)
    pairs = written(crossing(some.withColumn("root", F.col("doc_id")), some.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0), n, d), "pairs")
    return verified(some, pairs, n, d).distinct()


def verified(some: DataFrame, pairs: DataFrame, n: int, d: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity."""

    side = lambda name, col: some.select(F.col("doc_id").alias(name), F.col("shingles").alias(col))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("i") * d >= (F.size("x") + F.size("y") - F.col("i")) * n).select("a", "b")


def same_id(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows of one doc_id that have different sets."""
    least = rows.where("class_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("most"))
    return rows.select("doc_id", F.col("class_id").alias("a")).join(least.where("b < most").select("doc_id", "b"), "doc_id").where("a > b").select("a", "b").distinct()


def packed_words(words: DataFrame, ranges: int) -> DataFrame:
    """Segment words with doc_id, mark and n_shingles, packed by key range."""

    def pack(batches):
        for batch in batches:
            lists = batch.column("segments")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            keys = lists.flatten().to_numpy().view(U64)
            order = np.argsort(keys)
            beside = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64), size)[order] for c in ("doc_id", "mark", "n_shingles")]
            yield from X.pack(0, keys[order], beside, ranges).to_batches()

    return words.select("doc_id", "segments", "mark", "n_shingles").mapInArrow(pack, X.ASK)


def ranges_of(words: DataFrame, per_range: int = 500_000) -> int:
    return max(1, -(-(words.agg(F.sum(F.size("segments"))).first()[0] or 0) // per_range))


def grouped(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, mark and size in the order of the words, and where each group of equal words starts."""
    _, _, (keys, ids, mark, size) = X.unpack(table, [U64, np.int64, np.int64, np.int64])
    order = np.lexsort((ids, keys))
    return ids[order], mark[order], size[order], np.append(np.flatnonzero(X.group_starts(keys[order])), len(keys))


def stars(words: DataFrame) -> DataFrame:
    """For each document the smaller one that is the smallest in most of its groups of equal words: pairs (a, b), a > b."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        ids, _, _, start = grouped(table)
        low = np.repeat(ids[start[:-1]], np.diff(start))
        a, b = ids[ids > low], low[ids > low]
        order = np.lexsort((b, a))
        at = np.flatnonzero(X.group_starts(a[order], b[order])) if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": a[order][at], "b": b[order][at], "n": pa.array(np.diff(at, append=len(a)), pa.int64())})

    pairs = packed_words(words.withColumn("mark", F.col("doc_id")), ranges_of(words)).groupBy("p").applyInArrow(work, "a long, b long, n long")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))


def crossing(words: DataFrame, known: DataFrame, n: int, d: int, block: int = 1024) -> DataFrame:
    """Pairs (a, b), a > b, that share a word, lie in different components (root), and may reach the similarity.

    Groups whose members are in one component give nothing, and groups of the same members are taken once.  Of the
    other groups' pairs the bit sketches drop those that are too different, so what leaves a task grows with the
    pairs still in doubt.  Known pairs are left out.
    """

    def work(key: tuple, table: pa.Table, sketches: pa.Table) -> pa.Table:
        ids, mark, size, start = grouped(table)
        if not len(ids):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        docs, local = np.unique(ids, return_inverse=True)
        sketch_of: dict[int, set[bytes]] = {}
        for i, b in zip(sketches["doc_id"].to_pylist(), sketches["bits"].to_pylist(), strict=True):
            sketch_of.setdefault(i, set()).add(b)
        bits = BitSketches([min(sketch_of[i]) for i in docs.tolist()])
        sizes, least = np.zeros(len(docs), np.int64), np.full(len(docs), LAST)
        np.maximum.at(sizes, local, size)
        np.minimum.at(least, local, size)
        several = (sizes > least) | np.fromiter((len(sketch_of[i]) > 1 for i in docs.tolist()), bool, len(docs))  # ids of different texts: no filter
        total = len(docs)

        def doubtful(parts: list[np.ndarray]) -> np.ndarray:
            code = np.unique(np.concatenate(parts))
            p, q = np.divmod(code, total)
            return code[several[p] | several[q] | ((d + n) * bits.differences(p, q) <= (d - n) * (sizes[p] + sizes[q]))]

        mixed = np.flatnonzero(np.minimum.reduceat(mark, start[:-1]) != np.maximum.reduceat(mark, start[:-1]))
        members = np.stack([np.add.reduceat(mix(mix(ids.astype(U64) + U64(c)) + size.astype(U64)), start[:-1])[mixed] for c in (3, 5)], 1)
        mixed = mixed[np.unique(members, axis=0, return_index=True)[1]]
        made, waiting, count = [np.zeros(0, np.int64)], [], 0
        for g in mixed.tolist():
            x, m, s = (c[start[g] : start[g + 1]] for c in (local, mark, size))
            for i in range(0, len(x), block):
                for j in range(0, i + 1, block):
                    u, v = s[i : i + block, None], s[None, j : j + block]
                    p, q = np.nonzero((m[i : i + block, None] != m[None, j : j + block]) & (x[i : i + block, None] > x[None, j : j + block]) & (u * d >= v * n) & (v * d >= u * n))
                    waiting.append(x[i + p] * total + x[j + q])
                    count += len(p)
                    if count > 2_000_000:
                        made, waiting, count = [*made, doubtful(waiting)], [], 0
        p, q = np.divmod(doubtful([*made, *waiting]), total)
        return pa.table({"a": pa.array(docs[p], pa.int64()), "b": pa.array(docs[q], pa.int64())})

    marked = words.withColumn("mark", F.coalesce("root", "doc_id"))
    ranges = ranges_of(words)
    place = lambda w: F.shiftright(F.shiftrightunsigned(w, 32) * ranges, 32).cast("int")  # noqa: E731  as X.pack() deals them
    bits = words.select("doc_id", "bits", F.explode(F.array_distinct(F.transform("segments", place))).alias("p"))
    pairs = packed_words(marked, ranges).groupBy("p").cogroup(bits.groupBy("p")).applyInArrow(work, "a long, b long")
    return pairs.distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
