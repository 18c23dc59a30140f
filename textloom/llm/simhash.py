"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. If two differ in at most ``k`` bits,
they differ in at most ``k`` bytes, so they share at least ``8 - k`` positional
bytes. The index posts each distinct fingerprint under combinations of
positional bytes, chosen so that any ``8 - k`` shared bytes contain one of them
(a covering design: with k = 4, twenty or so triples): a posting list then holds
about one fingerprint in 2^24 by chance instead of one in 256. For each pair
that meets in a list all shared positional bytes are tallied, pairs that reach
the guaranteed minimum stay, and their differing bits are counted to verify.

A fingerprint can be several words of 64 bits, which estimate a similarity more
sharply; the words are mixed from one hash a shingle. Its positional bytes, over
all words, are posted under triples of which no two have a pair in common, three
dozen or more for each word, and if asked for, each triple once more with its least
certain bit turned (that where the shingles' votes are closest): a pair that differs
in few bits meets for sure, one at the bound with some probability. Such pairs can
be confirmed by the exact similarity (Jaccard) of their sets of shingles; then all
other pairs that are so similar are found too, by lists of shingles: in one order of
all shingles, two sets of similarity t share one of each set's first
``n - ceil(t n) + 1``. Only lists that hold several of the groups found so far are
looked at, and of these the pairs of different groups whose sizes, places and
parities of hash buckets (each shingle that one set alone has turns one) leave it
possible; of these the sets' counts by hash bucket are compared, then the sets. Sets
are of 32-bit hashes.

Vertices are distinct fingerprints (with exact confirmation: distinct sets of
shingles), as 64-bit numbers. A list that many of them share is split into
blocks, every pair of blocks is a list of its own, dealt to any task, and a task
emits the lightest spanning forest (by differing bits) of the links it finds,
not the links. A link that the forest leaves out joins vertices that lighter
links join; where these fail to be confirmed, the lists of shingles find it.
Components come from distributed star contraction.

Defined cases: a null text has no words; without words the fingerprint is zero
and links like any other; texts of fewer words than a shingle are one shingle;
two texts without words are alike; repeated rows (ids) keep their rows; null ids
count as larger than any other in the choice of a component's id and get one of
it all the same; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import connected_components
from textloom.session import discard, spread, stored

WORDS = 4
MAX_BITS = 4
SEED = 42
#: Vertices of a block of a posting list.
BLOCK = 1024
#: Rows of posting lists that a task looks at together, and links it holds before it thins them.
ROWS, HELD = 1 << 16, 1 << 20
_STEP = 1 << 15
#: One set in ``SAMPLE`` is counted: the ``TOLD`` most frequent shingles of at least ``OFTEN`` of these
#: come last in the order of shingles. Any order finds all pairs; this one keeps lists short.
SAMPLE, OFTEN, TOLD = 16, 8, 1 << 16
#: Words of 64 parities of a set; what may be lost to rounding where a bound is computed.
PARITIES, SLACK = 8, 1e-6
#: Buckets in which a set's hashes are counted, a byte each; parities of large sets tell little, counts do.
COUNTS = 1024
#: Texts of an Arrow batch that are hashed before their results go out.
TEXTS = 256


def mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits for each hash (splitmix64); the first word is the hash itself."""
    if not word:
        return hashes
    x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(texts: list[str | None], words: int = WORDS, width: int = 1, shingles: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """The SimHashes of the word shingles of whole texts, ``width`` times 64 bits a row; how
    certain their bytes are; and, if asked for, the distinct shingles of all texts as sorted
    32-bit hashes, text by text, with the number of each text's.

    The second has, by positional byte, its rank among all of the row by how close its
    closest vote was, times 8, plus the bit of that vote. Shingles are hashed ``_STEP`` at
    a time, of one text or of many.
    """
    ones, total = np.zeros((len(texts), width * 64), np.int64), np.zeros(len(texts), np.int64)
    distinct, waiting, spans, held = [], [], [], 0

    def count() -> None:
        nonlocal waiting, spans, held
        hashes = np.frombuffer(b"".join(waiting), ">u8").astype(np.uint64)
        rows, sizes = np.array(spans).T
        starts = np.cumsum(sizes) - sizes
        for k in range(width):
            bits = np.unpackbits(mixed(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            # a text has one span at most in what is counted together
            ones[rows, 64 * k : 64 * k + 64] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        if shingles:
            distinct.append(np.unique(np.repeat(rows.astype(np.uint64) << np.uint64(32), sizes) | (hashes & np.uint64(0xFFFFFFFF))))
        waiting, spans, held = [], [], 0

    digest = xxhash.xxh64_digest
    for row, text in enumerate(texts):
        tokens = (text or "").encode().lower().split()
        if not tokens:
            continue
        joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        ends = np.cumsum(lengths)
        starts, stops = (ends - lengths)[:n].tolist(), (ends[min(words, len(tokens)) - 1 :] - 1).tolist()
        total[row] = n
        for at in range(0, n, _STEP):
            got = [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + _STEP], stops[at : at + _STEP], strict=True)]
            waiting += got
            spans.append((row, len(got)))
            held += len(got)
            if held >= _STEP:
                count()
    if held:
        count()
    set_bits = 2 * ones > total[:, None]
    fps = np.packbits(set_bits, axis=1).view(">u8").astype(np.uint64).reshape(len(texts), width)
    # bytes from the lowest, as they are posted, and bits in them likewise
    votes = np.abs(2 * ones - total[:, None]).reshape(len(texts), width, 64)[:, :, ::-1].reshape(len(texts), 8 * width, 8)
    rank = votes.min(axis=2).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    certain = (rank.clip(max=31) * 8 + votes.argmin(axis=2)).astype(np.uint8)
    if not shingles:
        return fps, certain, None, None
    found = np.unique(np.concatenate([*distinct, np.zeros(0, np.uint64)]))
    sizes = np.bincount((found >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    return fps, certain, found.astype(np.uint32).view(np.int32), sizes


def fingerprint(text: str | None, words: int = WORDS, width: int = 1) -> list[int]:
    return sketches([text], words, width)[0][0].tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, width: int = 1, shingles: bool = False) -> DataFrame:
    """``id_col``, ``fp``, the fingerprint as an array of signed longs, how certain it is, and if asked for ``sh``, the shingles."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = "id " + kind + ", fp array<long>, certain binary" + ", sh array<int>" * shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, TEXTS):
                batch = big.slice(at, TEXTS)
                fps, certain, found, sizes = sketches(batch.column(1).to_pylist(), words, width, shingles)
                cols = [batch.column(0), _lists(fps.view(np.int64).reshape(-1), width), pa.array([c.tobytes() for c in certain], pa.binary())]
                if shingles:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(found)))
                yield pa.RecordBatch.from_arrays(cols, ["id", "fp", "certain", "sh"][: len(cols)])

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return spread(read).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _lists(flat: np.ndarray, size: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), pa.array(flat))


def covering(max_bits: int) -> list[tuple[int, ...]]:
    """Position sets such that any ``8 - max_bits`` positions contain one of them."""
    shared = 8 - max_bits
    if not 1 <= shared <= 8:
        raise ValueError("max_bits must be 0 to 7")
    size = min(3, max(1, shared - 1 if shared > 2 else shared))
    todo, chosen = set(combinations(range(8), shared)), []
    while todo:
        best = max(combinations(range(8), size), key=lambda c: (sum(set(c) <= set(x) for x in todo), c))
        chosen.append(best)
        todo = {x for x in todo if not set(best) <= set(x)}
    return chosen


def triples(positions: int) -> list[tuple[int, ...]]:
    """Triples of positions of which no two have a pair in common, taken greedily in order of their sums."""
    used, chosen = set(), []
    for c in sorted(combinations(range(positions), 3), key=lambda c: (sum(c) % positions, c)):
        pairs = set(combinations(c, 2))
        if not pairs & used:
            used |= pairs
            chosen.append(c)
    return chosen


def designs(width: int, max_bits: int) -> list[tuple[int, ...]]:
    """The combinations of positional bytes under which a fingerprint is posted."""
    return covering(max_bits) if width == 1 else triples(8 * width)


def keys(fps: np.ndarray, chosen: list[tuple[int, ...]], certain: np.ndarray | None) -> np.ndarray:
    """Row by row the lists under which a fingerprint is posted; with ``certain``, twice as many."""
    low = np.ascontiguousarray(fps, "<u8").view(np.uint8).astype(np.int64)
    out = np.empty((len(fps), len(chosen) * (1 if certain is None else 2)), np.int64)
    for i, positions in enumerate(chosen):
        key = np.full(len(fps), i, np.int64)
        for p in positions:
            key = key * 256 + low[:, p]
        out[:, i] = key
        if certain is not None:
            own = certain[:, list(positions)]
            at = own.argmin(axis=1)
            weak = own[np.arange(len(own)), at].astype(np.int64) & 7
            out[:, len(chosen) + i] = key ^ (1 << (8 * (len(positions) - 1 - at) + weak))
    return out


def differing(a: np.ndarray, b: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: which pairs pass the count filter on shared bytes and the bits, and how many bits differ."""
    diff = np.ascontiguousarray(a ^ b)
    bits = np.bitwise_count(diff).sum(axis=1)
    tally = (diff.view(np.uint8) == 0).sum(axis=1)
    return (tally >= least) & (bits <= most), bits


def lightest(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which links make a lightest spanning forest: all components take their lightest link, round by round."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.lexsort((ends[len(u) :], ends[: len(u)], weight))
    a, b, own, chosen = ends[: len(u)][order], ends[len(u) :][order], np.arange(len(nodes)), []
    while True:
        x, y = own[a], own[b]
        live = x != y
        order, a, b, x, y = order[live], a[live], b[live], x[live], y[live]
        if not len(order):
            return np.concatenate([*chosen, np.zeros(0, np.int64)]).astype(np.int64)
        ranks = np.arange(len(order))
        best = np.full(len(nodes), len(order))
        best[x[::-1]] = ranks[::-1]
        other = np.full(len(nodes), len(order))
        other[y[::-1]] = ranks[::-1]
        best = np.minimum(best, other)
        some = np.flatnonzero(best < len(order))
        chosen.append(order[np.unique(best[some])])
        up = np.arange(len(nodes))
        up[some] = x[best[some]] + y[best[some]] - some
        both = (up[up] == np.arange(len(nodes))) & (np.arange(len(nodes)) < up)
        up[both] = np.flatnonzero(both)
        while (up[up] != up).any():
            up = up[up]
        own = up[own]


def forest(lists: np.ndarray, vids: np.ndarray, fps: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A lightest spanning forest of the links within runs of one value of ``lists``."""
    held: list[tuple[np.ndarray, ...]] = []

    def thinned() -> tuple[np.ndarray, ...]:
        u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = lightest(u, v, w)
        return u[keep], v[keep], w[keep]

    at, n, step = np.arange(len(lists) - 1), 0, 1
    while len(at):
        at = at[at + step < len(lists)]
        at = at[lists[at] == lists[at + step]]
        for k in range(0, len(at), HELD // 8):
            part = at[k : k + HELD // 8]
            ok, bits = differing(fps[part], fps[part + step], least, most)
            if ok.any():
                part, bits = part[ok], bits[ok]
                held.append((np.minimum(vids[part], vids[part + step]), np.maximum(vids[part], vids[part + step]), bits))
                n += len(part)
                if n > HELD:
                    held = [thinned()]
                    n = len(held[0][0]) // 2  # what stays is a forest: at most the rows of a batch
        step += 1
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v, _ = thinned()
    return u, v


def _by_lists(found):
    """Apply ``found`` to rows sorted by their first two columns, so many at once, no list cut; it gives batches of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            for u, v in found(np.cumsum(new), rows):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["src", "dst"])

        waiting, n = [], 0
        for batch in batches:
            waiting.append(np.column_stack([batch.column(i).to_numpy() for i in range(batch.num_columns)]))
            n += batch.num_rows
            if n >= ROWS:
                rows = np.concatenate(waiting)
                # the last list may go on in the next batch
                last = (rows[:, :2] != rows[-1, :2]).any(axis=1)
                cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
                if cut:
                    yield from pairs(rows[:cut])
                waiting, n = [rows[cut:]], len(rows) - cut
        if n:
            yield from pairs(np.concatenate(waiting))

    return run


def _links(width: int, least: int, most: int):
    def found(lists: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield forest(lists, rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64), least, most)

    return _by_lists(found)


def _in_blocks(met: DataFrame, *cols: str) -> DataFrame:
    """Rows (key, n, vid, ...) of lists of ``n``, each once for each pair of blocks of its list that its own is in."""
    met = met.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.lit(1 << 31) + F.greatest(own, o))
    return met.select("key", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("pair"), "vid", *cols)


def links(vertices: DataFrame, width: int = 1, max_bits: int = MAX_BITS, total_bits: int | None = None) -> DataFrame:
    """A stored table of links ``(src, dst)`` of rows (vid, fp, certain) that join what all links join, lightest first.

    Without ``certain``, or with one word, lists hold equal bytes only.
    """
    most = max_bits if total_bits is None else total_bits
    chosen = designs(width, max_bits)
    turned = width > 1 and "certain" in vertices.columns
    # what those that meet are known to share
    least = max(8 * width - most, len(chosen[0]) - turned)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, width)
            certain = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, 8 * width) if turned else None
            found = keys(fps, chosen, certain)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found.reshape(-1), found.shape[1])], ["vid", "keys"])

    posted = vertices.select("vid", "fp", *["certain"] * turned).mapInArrow(post, "vid long, keys array<long>")
    lists = stored(posted)
    posted = lists.select("vid", F.explode("keys").alias("key"))
    counts = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = _in_blocks(posted.join(counts, "key"))
    words = [F.get("fp", F.lit(w)).alias(f"f{w}") for w in range(width)]
    met = dealt.join(vertices.select("vid", *words), "vid").select("key", "pair", "vid", *(f"f{w}" for w in range(width)))
    found = met.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_links(width, least, most), "src long, dst long")
    found = stored(found.distinct())
    discard(lists)
    return found


def within(a: np.ndarray, b: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Row by row: whether sets with these counts of hash buckets and ``n`` shingles together may be so similar.

    What the counts differ by, one set has alone; counts end at 255, which takes differences away only.
    """
    common = np.ceil(similarity / (1 + similarity) * n - SLACK)
    return np.abs(a.astype(np.int32) - b).sum(axis=1) <= n - 2 * common


def thinned(found: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """A stored table of the links that remain when sets (vid, sh) are compared by counts of hash buckets, which are short however large the sets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            each = [x.values.to_numpy() for x in batch.column(1)]
            counts = [np.bincount(x & (COUNTS - 1), minlength=COUNTS).clip(max=255).astype(np.uint8).tobytes() for x in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in each], pa.int64()), pa.array(counts, pa.binary())], ["vid", "n", "counts"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COUNTS) for i in (3, 4))
            keep = pa.array(within(a, b, batch.column(2).to_numpy(), similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["src", "dst"])

    short = stored(sets.mapInArrow(counted, "vid long, n long, counts binary"))
    one, two = (short.select(F.col("vid").alias(e), F.col("n").alias(f"{e}_n"), F.col("counts").alias(f"{e}_counts")) for e in ("src", "dst"))
    both = found.join(one, "src").join(two, "dst").select("src", "dst", (F.col("src_n") + F.col("dst_n")).alias("n"), "src_counts", "dst_counts")
    left = stored(both.mapInArrow(compared, "src long, dst long"))
    discard(short)
    return left


def confirmed(found: DataFrame, vertices: DataFrame, shingles: DataFrame, similarity: float, thin: bool = False) -> DataFrame:
    """The links whose sets of shingles are so similar: each set is read once, for the vertices of links only.

    With ``thin``, for links of which few hold, sets are compared by their counts first; the whole set goes along with what remains.
    """
    ends = found.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    sets = stored(shingles.join(ends.join(vertices, "vid").select("vid", F.col("rep").alias("row")), "row").select("vid", "sh"))
    if thin:
        every, found = found, thinned(found, sets, similarity)
        discard(every)
    one, two = (sets.select(F.col("vid").alias(e), F.col("sh").alias(f"{e}_sh")) for e in ("src", "dst"))
    common = F.size(F.array_intersect("src_sh", "dst_sh"))
    both = found.join(one, "src").join(two, "dst").select("src", "dst", common.alias("common"), (F.size("src_sh") + F.size("dst_sh")).alias("sizes"))
    alike = stored(both.filter(F.col("common") >= similarity * (F.col("sizes") - F.col("common"))).select("src", "dst"))
    discard(sets, found)
    return alike


def frequent(shingles: DataFrame) -> np.ndarray:
    """The most frequent shingles of one set in ``SAMPLE``, rarest first."""
    some = shingles.filter(F.pmod(F.xxhash64("sh"), F.lit(SAMPLE)) == 0).select(F.explode("sh").alias("w"))
    often = some.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "w").limit(TOLD)
    return np.array([r["w"] for r in often.collect()][::-1], np.int32)


def first_shingles(found: np.ndarray, last: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """Those of a set of which any set so similar has one among its own: ``last`` (sorted) by their ranks after all others."""
    n = len(found)
    if len(last):
        at = np.searchsorted(last, found).clip(max=len(last) - 1)
        found = found[np.argsort(np.where(last[at] == found, ranks[at], -1), kind="stable")]
    return found[: n - int(np.ceil(similarity * n - SLACK)) + 1]


def prefixes(shingles: DataFrame, similarity: float) -> DataFrame:
    """Rows (row, n, first, parity) of rows (row, sh): a set's size, its first shingles and the parities of its hash buckets."""
    often = frequent(shingles)
    order = np.argsort(often)
    last, size = often[order], 64 * PARITIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            sets = [x.values.to_numpy() for x in batch.column(1)]
            first = [first_shingles(x, last, order, similarity) for x in sets]
            parity = np.array([np.packbits(np.bincount(x & (size - 1), minlength=size) & 1) for x in sets], np.uint8)
            sizes, starts = pa.array([len(x) for x in sets], pa.int64()), pa.array(np.cumsum([0, *map(len, first)]), pa.int32())
            cols = [batch.column(0), sizes, pa.ListArray.from_arrays(starts, pa.array(np.concatenate(first))), _lists(parity.reshape(-1).view(np.int64), PARITIES)]
            yield pa.RecordBatch.from_arrays(cols, ["row", "n", "first", "parity"])

    return shingles.filter(F.size("sh") > 0).select("row", "sh").mapInArrow(run, "row long, n long, first array<int>, parity array<long>")


def _possible(similarity: float):
    """Pairs of rows (key, pair, vid, group, n, at, parities...) of one list and different groups, sorted by ``n`` in it, that may be so similar."""

    def found(lists: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        vids, groups, n, left, parity = rows[:, 2], rows[:, 3], rows[:, 4], rows[:, 4] - rows[:, 5], np.ascontiguousarray(rows[:, 6:]).view(np.uint64)
        i, step = np.arange(len(rows) - 1), 1
        while len(i):
            i = i[i + step < len(rows)]
            # those further on are larger still
            i = i[(lists[i] == lists[i + step]) & (n[i] >= similarity * n[i + step] - SLACK)]
            for k in range(0, len(i), HELD // 8):
                a = i[k : k + HELD // 8]
                a = a[groups[a] != groups[a + step]]
                common = np.ceil(similarity / (1 + similarity) * (n[a] + n[a + step]) - SLACK)
                ok = np.minimum(left[a], left[a + step]) >= common
                a, common = a[ok], common[ok]
                a = a[np.bitwise_count(parity[a] ^ parity[a + step]).sum(axis=1) <= n[a] + n[a + step] - 2 * common]
                if len(a):
                    yield np.minimum(vids[a], vids[a + step]), np.maximum(vids[a], vids[a + step])
            step += 1

    return _by_lists(found)


def left_out(shingles: DataFrame, vertices: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """A stored table of all pairs ``(src, dst)`` of vertices of different groups (node, component) whose sets may be so similar."""
    own = vertices.select(F.col("rep").alias("row"), "vid").join(groups.select(F.col("node").alias("vid"), "component"), "vid", "left")
    own = own.select("row", "vid", F.coalesce("component", "vid").alias("group"))
    posted = stored(prefixes(shingles, similarity).join(own, "row").drop("row"))
    each = posted.select("vid", "group", F.posexplode("first").alias("at", "key"))
    lists = each.groupBy("key").agg(F.count("*").alias("n"), F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high")
    lists = stored(lists.select("key", "n"))
    dealt = _in_blocks(each.join(lists, "key"), "at")
    parities = [F.get("parity", F.lit(w)).alias(f"p{w}") for w in range(PARITIES)]
    met = dealt.join(posted.select("vid", "group", F.col("n").alias("size"), *parities), "vid")
    met = met.select("key", "pair", "vid", "group", "size", "at", *(f"p{w}" for w in range(PARITIES)))
    found = stored(met.repartition("key", "pair").sortWithinPartitions("key", "pair", "size").mapInArrow(_possible(similarity), "src long, dst long").distinct())
    discard(posted, lists)
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, width: int = 1, max_bits: int = MAX_BITS, total_bits: int | None = None, similarity: float | None = None
) -> DataFrame:
    """``id_col``, ``fingerprint`` and ``component_id``, the smallest id of the document's group.

    With ``similarity``, pairs link if their share of common shingles is at least
    that, all of them: those that the index finds, then those that it left out.
    """
    exact = similarity is not None
    wide = fingerprints(docs, id_col, text_col, words, width, exact).withColumnRenamed(id_col, "id")
    same = [F.xxhash64("sh").alias("a"), F.xxhash64(F.lit("second"), "sh").alias("b")] if exact else []
    wide = stored(wide.drop("certain").select(F.monotonically_increasing_id().alias("row"), "*", *same))
    key = ["fp", "a", "b"] if exact else ["fp"]
    fps = stored(wide.select("id", *key))
    vertices = stored(wide.groupBy(*key).agg(F.min("id").alias("first"), F.min("row").alias("rep")).withColumn("vid", F.monotonically_increasing_id()))
    found = links(vertices, width, max_bits, total_bits)
    edges = found
    if exact:
        shingles = wide.select("row", "sh")
        found = confirmed(found, vertices, shingles, similarity)
        near = stored(connected_components(found))
        more = confirmed(left_out(shingles, vertices, near, similarity), vertices, shingles, similarity, thin=True)
        edges = near.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(more)
    discard(wide)
    groups = stored(connected_components(edges).join(vertices.select(F.col("vid").alias("node"), "first"), "node"))
    named = groups.select("node", "component").join(groups.groupBy("component").agg(F.min("first").alias("group")), "component")
    by_fp = vertices.join(named.select(F.col("node").alias("vid"), "group", F.lit(True).alias("found")), "vid", "left")
    by_fp = by_fp.select(*key, F.when(F.col("found"), F.col("group")).otherwise(F.col("first")).alias("component_id"))
    # two stored sides: a fingerprint that many documents share is split by the adaptive skew join
    by_fp = stored(by_fp)
    discard(found, groups, vertices, *([near, more] if exact else []))
    shown = F.array_join(F.transform("fp", lambda f: F.lower(F.lpad(F.hex(f), 16, "0"))), "")
    return fps.join(by_fp, key).select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")
