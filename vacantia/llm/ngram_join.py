"""N-gram Jaccard self-join by vertical partitioning.

A document is the set of its n-gram hashes. The global order of n-grams is the order of their hashes, cut
into fragments of equal range. A fragment sees its range of every document and counts partial overlaps,
which are summed per pair. Four steps keep the pairs few and the result exact:

1. A document can only link if three quarters of its n-grams occur elsewhere. The fragments count how many of
   each document's n-grams do; the others leave. Documents with equal sets become one.
2. Every document gets a pivot. An n-gram votes for its holder whose n-grams are the most common; a document
   chooses the holder with the most votes, itself if none reaches half of its n-grams. With D the
   difference of a set and its pivot's, W = whole + part, Q = whole - part and e = W|D| - Q n, two documents
   of one pivot link if and only if e + e' <= 2W |D & D'|. So pairs with e + e' <= 0 link without being made:
   they are counted from a histogram of e, and all of them meet in the member with the smallest e.
3. Pairs of one pivot with e + e' > 0 need common differences. The fragments count |D & D'| on the differences
   that another document of the pivot has too, and the counts are summed per pair.
4. Pairs of different pivots are candidates if they share one of both documents' rarest n-grams, in an order by
   the number of holders: at position r of s n-grams that occur under other pivots, a partner may have
   W (s - r) / part - n n-grams at most. The overlap of what is left is counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm._util import Scratch, column, lower_ascii, mix, partitions, slices, span_hashes, spread_join, text_buffer, word_spans
from vacantia.llm.components import components

#: Pairs that a task holds at once.
PAIRS = 1 << 18
#: Text bytes and n-grams that one fragment holds, on average; the number of fragments follows the input.
FRAGMENT_BYTES, FRAGMENT_GRAMS = 32 << 20, 1 << 19


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; a shorter text is one n-gram, an empty one none."""
    data = lower_ascii(data)
    starts, ends, per = word_spans(data, offsets)
    h = span_hashes(data, starts, ends)
    factor = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(words)]
    grams = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if len(h) >= words:
            grams = np.zeros(len(h) - words + 1, np.uint64)
            for k in range(words):
                grams += mix(h[k : len(h) - words + 1 + k] + factor[k])
                grams *= factor[words - 1 - k]
            grams = mix(grams)
        out = []
        at = 0
        for n in per.tolist():
            if n >= words:
                out.append(np.unique(grams[at : at + n - words + 1]))
            elif n:
                whole = np.uint64(n)
                for x in h[at : at + n]:
                    whole = mix(np.array([whole * factor[0] + x]))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def _fragments(hashes: np.ndarray, count: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


def _six(hashes: np.ndarray) -> bytes:
    """The low 48 bits; the fragment holds more of the rest."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _longs(raw: bytes, width: int = 1) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(-1, width)


def _typed(run):  # noqa: ANN001, ANN202
    """Names the kinds of an inner function's argument and result, which choose the iterator form."""
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column(batch, x).to_pylist() for x in names), strict=True)


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def _sizes_and_shared(docs: DataFrame, words: int, part: int, whole: int) -> DataFrame:
    """``id``, ``n`` (set size) and ``live``: enough n-grams occur in another row to allow a link.

    N-grams that repeat within a slice of texts are known to be shared there and travel once, without their
    holders, so a very common n-gram is one entry for each slice.
    """
    spark = docs.sparkSession
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(partitions(spark), int(text_bytes // FRAGMENT_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        owner = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                sets = shingle_sets(*text_buffer(column(piece, "text")), words)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                hashes = np.concatenate(sets)
                of = np.repeat(np.arange(len(sets)), size)
                every, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
                again = times[at] > 1
                known = np.bincount(of[again], minlength=len(sets))
                common = every[times > 1]
                alone, of = hashes[~again], of[~again]
                order = np.argsort(_fragments(alone, count), kind="stable")
                alone, of = alone[order], of[order]
                ends = np.searchsorted(_fragments(alone, count), np.arange(count + 1))
                both = np.searchsorted(_fragments(common, count), np.arange(count + 1))
                head = np.stack([column(piece, "id").to_numpy(zero_copy_only=False).astype(np.int64), size, known], 1).tobytes()
                rows = []
                for f in range(count):
                    a, b = ends[f], ends[f + 1]
                    if f == 0 or a < b or both[f] < both[f + 1]:
                        per = np.bincount(of[a:b], minlength=len(sets)).astype(np.int32)
                        rows.append((f, owner, head if f == 0 else b"", per.tobytes(), _six(alone[a:b]), _six(common[both[f] : both[f + 1]])))
                owner += 1
                yield _batch(rows, frag=pa.int32(), owner=pa.int64(), heads=pa.binary(), sizes=pa.binary(), grams=pa.binary(), common=pa.binary())

    def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grams, others = [], [], []
        for owner, heads, sizes, g, c in _rows(batches, "owner", "heads", "sizes", "grams", "common"):
            rows.append((owner, heads, np.frombuffer(sizes, np.int32)))
            grams.append(_eight(g))
            others.append(_eight(c))
        lengths = [len(g) for g in grams]
        every = np.concatenate(grams)
        del grams
        known = np.unique(np.concatenate(others))
        order = np.argsort(every)
        every = every[order]
        hit = np.zeros(len(every), bool)
        same = every[1:] == every[:-1]
        hit[1:] |= same
        hit[:-1] |= same
        if len(known):
            hit |= known[np.minimum(np.searchsorted(known, every), len(known) - 1)] == every
        shared = np.zeros(len(every), bool)
        shared[order] = hit
        at = 0
        for (owner, heads, sizes), length in zip(rows, lengths, strict=True):
            got = np.bincount(np.repeat(np.arange(len(sizes)), sizes), shared[at : at + length], len(sizes)).astype(np.int32)
            yield _batch([(owner, heads, got.tobytes())], owner=pa.int64(), heads=pa.binary(), shared=pa.binary())
            at += length

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, shared = b"", 0
        for h, s in _rows(batches, "heads", "shared"):
            heads = heads or h
            shared = shared + np.frombuffer(s, np.int32).astype(np.int64)
        ids, size, known = _longs(heads, 3).T
        live = (size > 0) & ((shared + known) * whole >= part * size)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size), pa.array(live)], ["id", "n", "live"])

    cut_rows = docs.select("id", "text").mapInArrow(cut, "frag int, owner long, heads binary, sizes binary, grams binary, common binary")
    counted = cut_rows.groupBy("frag").applyInArrow(count_shared, "owner long, heads binary, shared binary")
    return counted.groupBy("owner").applyInArrow(decide, "id long, n long, live boolean")


def _sets_of(docs: DataFrame, words: int) -> DataFrame:
    """``id``, ``n``, ``k1``, ``k2`` (a 128-bit key of the set) and ``grams`` (sorted 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(*text_buffer(column(piece, "text")), words)
                with np.errstate(over="ignore"):
                    k1 = np.array([int(np.sum(mix(s))) & (1 << 64) - 1 for s in sets], np.uint64).view(np.int64)
                    k2 = np.array([int(np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)))) & (1 << 64) - 1 for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([column(piece, "id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(k1), pa.array(k2), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "k1", "k2", "grams"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, k1 long, k2 long, grams binary")


class _Pack:
    """Some documents' key sets: a matrix of ``heads``, ``sizes`` and their ``keys`` one after the other."""

    def __init__(self, heads: bytes, width: int, sizes: bytes, keys: bytes) -> None:
        self.heads, self.sizes = _longs(heads, width), np.frombuffer(sizes, np.int32).astype(np.int64)
        self.keys = np.frombuffer(keys, np.uint64)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.distinct, self.at = np.unique(self.keys, return_inverse=True)

    def ranked(self, asked: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries with a ``common`` key by document and rarity, their positions, and each document's number of them."""
        some = np.flatnonzero(common)
        some = some[np.lexsort((self.keys[some], asked[some], self.owner[some]))]
        s = np.bincount(self.owner[some], minlength=len(self.sizes))
        return some, np.arange(len(some)) - np.repeat(np.cumsum(s) - s, s), s


def _packs(rows: DataFrame, *heads: str) -> DataFrame:
    """Rows with ``keys`` as packs of about 2 MB, each with an id; written before use, since the ids count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, "keys"):
                keys = column(piece, "keys").to_pylist()
                head = np.stack([column(piece, x).to_numpy(zero_copy_only=False) for x in heads], 1).astype(np.int64)
                sizes = np.fromiter((len(k) >> 3 for k in keys), np.int32, len(keys))
                yield _batch([(pack, head.tobytes(), sizes.tobytes(), b"".join(keys))], pack=pa.int64(), heads=pa.binary(), sizes=pa.binary(), keys=pa.binary())
                pack += 1

    return rows.select(*heads, "keys").mapInArrow(run, "pack long, heads binary, sizes binary, keys binary")


_HOW = {"sum": np.add, "min": np.minimum, "max": np.maximum}


def _ask(packs: DataFrame, width: int, count: int, local: Callable, how: tuple[str, ...], then: Callable, schema: str) -> DataFrame:
    """What the fragments know about each key of each pack, given to ``then``.

    ``local(pack)`` gives columns of numbers for a pack's distinct keys, so that a common key is one entry
    for each pack. A fragment folds them per key by ``how`` (``first``: the smallest row), and
    ``then(pack, columns)`` gets them aligned with the pack's entries.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, heads, sizes, keys in _rows(batches, "pack", "heads", "sizes", "keys"):
            p = _Pack(heads, width, sizes, keys)
            told = np.stack(local(p), 1)
            ends = np.searchsorted(_fragments(p.distinct, count), np.arange(count + 1))
            rows = [(f, pack, p.distinct[a:b].tobytes(), told[a:b].tobytes()) for f in range(count) for a, b in ((ends[f], ends[f + 1]),) if a < b]
            yield _batch(rows, frag=pa.int32(), pack=pa.int64(), keys=pa.binary(), told=pa.binary())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys, told = [], [], []
        for frag, pack, k, t in _rows(batches, "frag", "pack", "keys", "told"):
            rows.append((frag, pack, len(k) >> 3))
            keys.append(np.frombuffer(k, np.uint64))
            told.append(_longs(t, len(how)))
        every, told = np.concatenate(keys), np.concatenate(told)
        order = np.lexsort((*reversed(told.T), every)) if "first" in how else np.argsort(every, kind="stable")
        new = np.ones(len(every), bool)
        new[1:] = every[order[1:]] != every[order[:-1]]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        answer = np.empty_like(told)
        for k, x in enumerate(how):
            answer[order, k] = (told[order[first], k] if x == "first" else _HOW[x].reduceat(told[order, k], first))[group]
        at = 0
        for frag, pack, n in rows:
            yield _batch([(pack, frag, answer[at : at + n].tobytes())], pack=pa.int64(), frag=pa.int32(), answer=pa.binary())
            at += n

    def back(answers: pa.Table, own: pa.Table) -> pa.Table:
        if not own.num_rows or not answers.num_rows:
            return pa.Table.from_batches([], schema=empty)
        _, heads, sizes, keys = (own.column(x)[0].as_py() for x in ("pack", "heads", "sizes", "keys"))
        p = _Pack(heads, width, sizes, keys)
        answers = answers.sort_by("frag")
        known = np.concatenate([_longs(a, len(how)) for a in answers.column("answer").to_pylist()])
        return pa.Table.from_batches([then(p, known[p.at].T)], schema=empty)

    empty = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in schema.split(", "))])
    answers = packs.mapInArrow(send, "frag int, pack long, keys binary, told binary").groupBy("frag").applyInArrow(_typed(meet), "pack long, frag int, answer binary")
    return answers.groupBy("pack").cogroup(packs.groupBy("pack")).applyInArrow(back, schema)


def _popularity(pack: _Pack, columns: np.ndarray) -> pa.RecordBatch:
    """``score``: how common a document's n-grams are, as the mean logarithm of their holders."""
    total = np.bincount(pack.owner, np.log2(columns[0]), len(pack.sizes))
    score = np.round(total / np.maximum(pack.sizes, 1) * 1024).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pack.heads[:, 0]), pa.array(score)], ["id", "score"])


def _choice(pack: _Pack, columns: np.ndarray) -> pa.RecordBatch:
    """``choice``: the holder that leads most of a document's n-grams, itself if that is less than half."""
    leader, names = np.unique(columns[1], return_inverse=True)[::-1]
    pair, votes = np.unique(pack.owner * len(names) + leader, return_counts=True)
    owner = pair // len(names)
    order = np.lexsort((names[pair % len(names)], -votes, owner))
    lead = order[np.unique(owner[order], return_index=True)[1]]
    choice = pack.heads[:, 0].copy()
    enough = lead[2 * votes[lead] >= pack.sizes[owner[lead]]]
    choice[owner[enough]] = names[pair[enough] % len(names)]
    return pa.RecordBatch.from_arrays([pa.array(pack.heads[:, 0]), pa.array(choice)], ["id", "choice"])


def _differences(part: int, whole: int):  # noqa: ANN202
    """``id``, ``n``, ``pivot``, ``e`` and ``keys``: the n-grams in which a set and its pivot's differ, salted by the pivot."""
    w, q = whole + part, whole - part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "keys"):
                rows = []
                for i, n, g, pivot, p in _rows([piece], "id", "n", "keys", "pivot", "pivot_keys"):
                    own = np.frombuffer(g, np.uint64)
                    d = np.setxor1d(own, np.frombuffer(p, np.uint64), assume_unique=True) if p is not None and i != pivot else own[:0]
                    if len(d) > n:  # the pivot tells nothing
                        pivot, d = i, own[:0]
                    rows.append((i, n, pivot, w * len(d) - q * n, np.sort(mix(d ^ mix(np.array([pivot]).view(np.uint64)))).tobytes()))
                yield _batch(rows, id=pa.int64(), n=pa.int64(), pivot=pa.int64(), e=pa.int64(), keys=pa.binary())

    return run


def _entries(pack: _Pack, some: np.ndarray, count: int, *columns: np.ndarray) -> pa.RecordBatch:
    """Entries (key, id, columns) for the fragments; the head holds a document's numbers."""
    keys = pack.keys[some]
    frag = _fragments(keys, count)
    order = np.argsort(frag, kind="stable")
    body = np.stack([keys.view(np.int64), pack.heads[pack.owner[some], 0], *columns], 1)[order]
    ends = np.searchsorted(frag[order], np.arange(count + 1))
    rows = [(f, body[a:b].tobytes()) for f in range(count) for a, b in ((ends[f], ends[f + 1]),) if a < b]
    return _batch(rows, frag=pa.int32(), entries=pa.binary())


_PACKED = "block int, ids binary, others binary, sizes binary, votes binary"


def _packed(blocks: int, ids: np.ndarray, others: np.ndarray, sizes: np.ndarray, votes: np.ndarray) -> pa.RecordBatch:
    """Counts of pairs as one row for each block of pairs."""
    with np.errstate(over="ignore"):
        block = (mix(ids.astype(np.uint64) + mix(others.astype(np.uint64))) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    cut = np.searchsorted(block[order], np.arange(blocks + 1))
    rows = [(k, *(x[o].astype(np.int64).tobytes() for x in (ids, others, sizes, votes))) for k in range(blocks) if cut[k] < cut[k + 1] for o in (order[cut[k] : cut[k + 1]],)]
    return _batch(rows, block=pa.int32(), ids=pa.binary(), others=pa.binary(), sizes=pa.binary(), votes=pa.binary())


def _pairs(blocks: int, width: int, allowed: Callable):  # noqa: ANN202
    """Pairs of entries with a common key that ``allowed`` lets pass, with how many such keys they have in the fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([_longs(e, width) for (e,) in _rows(batches, "entries")])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        names, local = np.unique(rows[:, 1], return_inverse=True)
        place = np.arange(len(rows))
        rest = np.searchsorted(rows[:, 0], rows[:, 0], "right") - place - 1  # partners that follow
        total = np.cumsum(rest)
        left: list[tuple] = []
        held, at = 0, 0

        def flush() -> pa.RecordBatch:
            code, size, n = (np.concatenate(x) for x in zip(*left, strict=True))
            left.clear()
            code, first, back = np.unique(code, return_index=True, return_inverse=True)
            return _packed(blocks, names[code // len(names)], names[code % len(names)], size[first], np.bincount(back, n).astype(np.int64))

        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            n = rest[at:stop]
            a = np.repeat(np.arange(at, stop), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            ok, size = allowed(rows[a].T, rows[b].T)
            if ok.any():
                code, first, times = np.unique(local[a[ok]] * len(names) + local[b[ok]], return_index=True, return_counts=True)
                left.append((code, size[ok][first], times))
                held += len(code)
            if held > PAIRS:
                yield flush()
                held = 0
            at = stop
        if left:
            yield flush()

    return _typed(run)


def _summed(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The counts of one block summed per pair."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for row in _rows(batches, "ids", "others", "sizes", "votes"):
        for k, x in enumerate(row):
            parts[k].append(np.frombuffer(x, np.int64))
    ids, others, sizes, votes = (np.concatenate(p) for p in parts)
    order = np.lexsort((others, ids))
    ids, others, sizes, votes = ids[order], others[order], sizes[order], votes[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1])
    first = np.flatnonzero(new)
    return ids[first], others[first], sizes[first], np.add.reduceat(votes, first)


def _reaching(times: int):  # noqa: ANN202
    """Pairs whose summed overlap, ``times`` over, reaches their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, others, sizes, votes = _summed(batches)
        ok = times * votes >= sizes
        yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(others[ok])], ["id", "other"])

    return _typed(run)


def _overlapping(part: int, whole: int):  # noqa: ANN202
    """Candidate pairs with both sets, held against the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "a"):
                rows = []
                for i, other, a, b in _rows([piece], "id", "other", "a", "b"):
                    both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                    if 8 * (whole + part) * both >= part * (len(a) + len(b)):
                        rows.append((i, other))
                yield _batch(rows, id=pa.int64(), other=pa.int64())

    return run


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, part: int = 3, whole: int = 4, links: bool = False) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id``: the smallest id reachable by links.

    Two texts link when their sets of ``words``-word n-grams (A-Z lowered; a shorter text is one n-gram) have
    ``whole`` * intersection >= ``part`` * union. Null and empty texts have no n-gram and link with nothing;
    rows with a null id have a null component and link with nothing; repeated rows tie and get equal results; of
    different texts that share an id one (by its key) is compared. Ids must be whole numbers. Texts of any
    length are read whole. Exact up to collisions of 64-bit hashes (in the first pass 48 bits and the fragment).
    Other columns are ignored, whatever their names; an empty table gives no rows.

    With ``links`` a column of that name counts each row's links to other rows, exactly: pairs of distinct sets
    over the threshold, weighted by their copies. Ids must then be unique.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    null = -(1 << 63)
    sizes = scratch.cut(_sizes_and_shared(base.withColumn("id", F.coalesce("id", F.lit(null))), words, part, whole), "sizes")
    live = sizes.where(f"live and id <> {null}").select("id").distinct()
    # sort-merge at every size: what is joined here grows with the input
    sets = scratch.cut(_sets_of(base.join(live.hint("merge"), "id", "left_semi"), words).where("n > 0"), "sets")
    classes = scratch.cut(sets.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    member = scratch.cut(spread_join(sets.select("id", "k1", "k2", "n"), classes, ["k1", "k2", "n"], "rows", "id").select("id", "rep").distinct(), "member")
    chosen = sets.join(classes.select("k1", "k2", "n", F.col("rep").alias("id")).hint("merge"), ["id", "k1", "k2", "n"], "left_semi")
    reps = scratch.cut(chosen.groupBy("id").agg(F.min_by(F.struct("n", F.col("grams").alias("keys")), F.struct("k1", "k2")).alias("s")).select("id", "s.n", "s.keys"), "reps")
    scratch.drop("sets", "classes")
    blocks = partitions(spark)

    def fragments(rows: DataFrame) -> int:
        return max(1, blocks // 4, (rows.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // (8 * FRAGMENT_GRAMS))

    def in_fragments(entries: DataFrame, width: int, allowed: Callable) -> DataFrame:
        return entries.groupBy("frag").applyInArrow(_pairs(blocks, width, allowed), _PACKED).groupBy("block")

    # pivots
    count = fragments(reps)
    packs = scratch.cut(_packs(reps, "id", "n"), "packs")
    score = _ask(packs, 2, count, lambda p: [np.bincount(p.at, minlength=len(p.distinct))], ("sum",), _popularity, "id long, score long")
    scored = scratch.cut(_packs(reps.join(score.hint("merge"), "id"), "id", "score"), "scored")
    scratch.drop("packs")

    def best(p: _Pack) -> list[np.ndarray]:
        order = np.lexsort((p.heads[p.owner, 0], -p.heads[p.owner, 1], p.at))
        lead = p.heads[p.owner[order[np.unique(p.at[order], return_index=True)[1]]]]
        return [-lead[:, 1], lead[:, 0]]

    choice = scratch.cut(_ask(scored, 2, count, best, ("first", "first"), _choice, "id long, choice long"), "choice")
    scratch.drop("scored")
    # a choice that has chosen another is followed once; what doesn't lead to a pivot stands alone
    for k in range(2):
        fan = choice.groupBy("choice").agg(F.count(F.lit(1)).alias("rows"))
        of = fan.join(choice.select(F.col("id").alias("choice"), F.col("choice").alias("next")).hint("merge"), "choice")
        step = F.col("next") if k == 0 else F.when(F.col("next") == F.col("choice"), F.col("choice")).otherwise(F.col("id"))
        choice = scratch.cut(spread_join(choice, of, ["choice"], "rows", "id").select("id", step.alias("choice")), f"choice{k}")
    scratch.drop("choice", "choice0")
    fan = choice.where("id <> choice").groupBy(F.col("choice").alias("pivot")).agg(F.count(F.lit(1)).alias("rows"))
    pivots = scratch.cut(fan.join(reps.select(F.col("id").alias("pivot"), F.col("keys").alias("pivot_keys")).hint("merge"), "pivot"), "pivots")
    placed = reps.join(choice.select("id", F.col("choice").alias("pivot")).hint("merge"), "id")
    diffs = scratch.cut(spread_join(placed, pivots, ["pivot"], "rows", "id").mapInArrow(_differences(part, whole), "id long, n long, pivot long, e long, keys binary"), "diffs")
    scratch.drop("pivots", "choice1")

    # pairs that link by their distances from the pivot meet in the nearest member
    near = diffs.groupBy("pivot").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("e", "id")).alias("m")).select("pivot", "rows", F.col("m.e").alias("m_e"), F.col("m.id").alias("m_id"))
    homes = scratch.cut(spread_join(diffs.drop("keys"), near, ["pivot"], "rows", "id").select("id", "n", "pivot", "e", F.when(F.col("e") + F.col("m_e") <= 0, F.col("m_id")).otherwise(F.col("id")).alias("home")), "homes")
    stars = homes.where("home <> id").select("id", F.col("home").alias("other"))
    w = whole + part

    # pairs of one pivot
    hard = scratch.cut(_packs(diffs.where("octet_length(keys) > 0").join(homes.select("id", "home").hint("merge"), "id"), "id", "e", "home"), "hard_packs")
    count = fragments(hard)

    def shared_differences(p: _Pack, columns: np.ndarray) -> pa.RecordBatch:
        some, _, s = p.ranked(columns[0], columns[0] > 1)
        head = p.heads[p.owner[some]]
        return _entries(p, some, count, head[:, 1], head[:, 2], s[p.owner[some]])

    def same_pivot(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        need = a[2] + b[2]
        return (need > 0) & (need <= 2 * w * np.minimum(a[4], b[4])) & (links | (a[3] != b[3])), need

    entries = _ask(hard, 3, count, lambda p: [np.bincount(p.at, minlength=len(p.distinct))], ("sum",), shared_differences, "frag int, entries binary")
    inner = scratch.cut(in_fragments(entries, 5, same_pivot).applyInArrow(_reaching(2 * w), "id long, other long"), "inner")
    scratch.drop("hard_packs")

    # pairs of different pivots
    whole_sets = scratch.cut(_packs(reps.join(homes.select("id", "pivot").hint("merge"), "id"), "id", "n", "pivot"), "cross_packs")
    count = fragments(reps)

    def pivots_of(p: _Pack) -> list[np.ndarray]:
        order = np.lexsort((p.heads[p.owner, 2], p.at))
        pivot = p.heads[p.owner[order], 2]
        first = np.unique(p.at[order], return_index=True)[1]
        return [np.bincount(p.at, minlength=len(p.distinct)), pivot[first], pivot[np.append(first[1:], len(order)) - 1]] if len(order) else [first, pivot, pivot]

    def rarest(p: _Pack, columns: np.ndarray) -> pa.RecordBatch:
        some, at, s = p.ranked(columns[0], columns[1] != columns[2])
        head = p.heads[p.owner[some]]
        most = w * (s[p.owner[some]] - at) // part - head[:, 1]
        ok = whole * most >= part * head[:, 1]
        return _entries(p, some[ok], count, *head[ok, 1:].T, most[ok])

    def different_pivot(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (a[3] != b[3]) & (a[2] <= b[4]) & (b[2] <= a[4]), a[2] + b[2]

    entries = _ask(whole_sets, 3, count, pivots_of, ("sum", "min", "max"), rarest, "frag int, entries binary")
    candidates = scratch.cut(in_fragments(entries, 5, different_pivot).applyInArrow(_reaching(1 << 62), "id long, other long"), "candidates")
    scratch.drop("cross_packs")
    sides = candidates.join(reps.select("id", F.col("keys").alias("a")).hint("merge"), "id").join(reps.select(F.col("id").alias("other"), F.col("keys").alias("b")).hint("merge"), "other")
    outer = scratch.cut(sides.mapInArrow(_overlapping(part, whole), "id long, other long"), "outer")
    scratch.drop("candidates", "reps", "diffs")

    # components; a component's id is the smallest document among its members
    proved = inner.unionByName(outer)
    roots = components(stars.unionByName(proved).select(F.col("id").alias("u"), F.col("other").alias("v")), scratch)
    roots = scratch.cut(homes.select("id").join(roots.select(F.col("node").alias("id"), "root").hint("merge"), "id", "left").select(F.col("id").alias("rep"), F.coalesce("root", "id").alias("comp")), "roots")
    copies = scratch.cut(member.groupBy("rep").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("least")), "copies")
    least = copies.join(roots.hint("merge"), "rep").groupBy("comp").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("rows"))
    per_rep = spread_join(roots, least, ["comp"], "rows", "rep").select("rep", F.col("least").alias("component")).join(copies.select("rep", "rows").hint("merge"), "rep")
    if links:
        of = homes.join(copies.select(F.col("rep").alias("id"), F.col("rows").alias("copies")).hint("merge"), "id")
        far = proved.unionByName(proved.select(F.col("other").alias("id"), F.col("id").alias("other")))
        far = far.join(copies.select(F.col("rep").alias("other"), "rows").hint("merge"), "other").groupBy("id").agg(F.sum("rows").alias("far"))
        # rows of the pivot whose e is at most x, for each x = -e: a running sum over a histogram of e
        bars = of.groupBy("pivot", "e").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("rows"))
        marks = bars.select("pivot", F.col("e").alias("x"), "c", F.lit(0).alias("rows")).unionByName(bars.select("pivot", (-F.col("e")).alias("x"), F.lit(0).alias("c"), "rows"))
        upto = marks.groupBy("pivot", "x").agg(F.sum("c").alias("c"), F.sum("rows").alias("rows"))
        upto = upto.select("pivot", "x", "rows", F.expr("sum(c) over (partition by pivot order by x rows between unbounded preceding and current row)").alias("within")).where("rows > 0")
        close = spread_join(of.withColumn("x", -F.col("e")), upto, ["pivot", "x"], "rows", "id")
        # the row itself is among them if its own e is not above 0
        counted = close.join(far.hint("merge"), "id", "left").select(F.col("id").alias("rep"), (F.col("within") + F.when(F.col("e") > 0, F.col("copies")).otherwise(0) - 1 + F.coalesce("far", F.lit(0))).alias("links"))
        per_rep = per_rep.join(counted.hint("merge"), "rep")
    per_rep = scratch.cut(per_rep, "per_rep")
    found = spread_join(member, per_rep, ["rep"], "rows", "id")
    found = scratch.cut(found.groupBy("id").agg(F.min("component").alias("component"), *([F.min("links").alias("links")] if links else [])), "found")
    scratch.drop("homes", "inner", "outer", "roots", "copies", "per_rep", "member")
    out = sizes.join(found.hint("merge"), "id", "left")
    return out.select(
        F.when(F.col("id") != null, F.col("id")).cast(kind).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id") != null, F.coalesce("component", "id")).cast(kind).alias("component_id"),
        *([F.coalesce("links", F.lit(0)).cast("long").alias("links")] if links else []),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, part: int = 3, whole: int = 4) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. Null ids stay."""
    found = similar_components(docs, id_col, text_col, words, part, whole)
    gone = found.where(f"component_id <> `{id_col}`").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
