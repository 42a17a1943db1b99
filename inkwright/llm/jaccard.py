"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

A text is its set of five-word shingles. Texts with equal sets are one copy class and take part
once; classes go by a hash of the set, and a second hash verifies that a class is one set. A signature of 128 minima is read as 16 trees of depth 8. All (tree, signature) rows
are sorted by range, which lays each tree out as a sorted prefix trie dealt over tasks; a
hot prefix spans several tasks, as ties are broken by hash. All texts are paired that share a
prefix of the depth where a pair at the threshold meets with the target recall (4 at 0.8 and
0.999). Few texts (16) under a prefix make candidate pairs; prefixes at the edges of a task's
range are put together again first.

Texts under a more crowded prefix are dealt into blocks, and each two blocks are compared as
matrices of texts by shingles: all their pairs are verified, but no pair becomes a row. What
leaves is a row a text, with its number of links and one text that it hangs together with. A
pair that shares several crowded prefixes counts under the smallest of them only.

Every candidate pair is verified on the exact shingle sets, so the number of links is that of
all pairs, at the recall of the trees. In a group its work grows with the square of the group.

Edges: texts of one to four words have one shingle, of all their words; texts without words
(also null) are one copy class; words are compared byte by byte; rows with equal ids are told
apart by their texts; a null id never names a class unless there is no other; an empty table
gives none; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwright.llm import tokens
from inkwright.llm.components import components
from inkwright.llm.shared import small_batches, written

SHINGLE = 5
LEAST = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.999
SMALL = 16
#: Rows of a trie that one task sorts.
TASK_ROWS = 200_000
#: Texts of a crowded prefix, and bytes of their shingles, that make a block.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
#: Texts and shingles of a matrix.
STRIP = 256
_draw = np.random.RandomState(11)
_MUL = _draw.randint(1, 2**62, TREES * DEPTH).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.randint(0, 2**62, TREES * DEPTH).astype(np.uint64)


def shortest(least: float = LEAST, recall: float = RECALL) -> int:
    """The greatest depth at which a pair of similarity ``least`` shares a prefix of that length
    in one of the trees with probability ``recall``."""
    return max([d for d in range(1, DEPTH + 1) if 1 - (1 - least**d) ** TREES >= recall], default=1)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text in a row, and where each text's begin."""
    h, doc = tokens.shingles(tokens.words(*tokens.flat(texts)), n, len(texts))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])


def set_keys(h: np.ndarray, at: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two unrelated hashes of each set, 0 for empty ones: the key, of so many bits, and the check."""
    return _set_hash(h, at) >> np.int64(64 - bits), _set_hash(tokens.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)


def _set_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    up, _ = tokens._grown(int(np.diff(at).max(initial=0)) + 1)
    place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[place])])
    key = tokens.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))
    return np.where(np.diff(at) > 0, key, np.uint64(0)).astype(np.int64)


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For sets that aren't empty: the upper 32 bits of the least of 128 permutations, big endian."""
    out = np.empty((len(at) - 1, len(_MUL)), ">u4")
    for k in range(len(_MUL)):
        out[:, k] = np.minimum.reduceat(h * _MUL[k] + _ADD[k], at[:-1]) >> np.uint64(32)
    return out


def _signer(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in tokens.pieces(batch.column(1)):
                h, at = shingle_sets(part)
                keys, checks = set_keys(h, at, bits)
                full = np.flatnonzero(np.diff(at) > 0)
                signed: list[bytes | None] = [None] * len(part)
                if len(full):
                    for d, row in zip(full, signatures(h, np.append(at[full], len(h))), strict=True):
                        signed[d] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array(keys), pa.array(checks), pa.array(signed, pa.binary())], names=["doc_id", "key", "check", "signature"])

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if n:
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n * TREES, 4 * DEPTH)
            key = np.repeat(batch.column(0).to_numpy(), TREES)
            prefix = pa.Array.from_buffers(pa.binary(4 * DEPTH), n * TREES, [None, pa.py_buffer(np.ascontiguousarray(wide))]).cast(pa.binary())
            tie = tokens.mix(key.astype(np.uint64) + np.tile(np.arange(TREES, dtype=np.uint64), n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), prefix, pa.array(tie), pa.array(key)], names=["tree", "prefix", "tie", "key"])


def trie_pairs(tree: np.ndarray, prefix: np.ndarray, key: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sorted rows (``prefix``: rows of DEPTH numbers) that share a prefix of ``shallow``
    numbers with few others; and the rows left, with a hash of their prefix: those of crowded
    prefixes, and of the first and the last one, which may go on in other tasks."""
    n = len(key)
    begin = np.ones(n, bool)
    begin[1:] = (prefix[1:, :shallow] != prefix[:-1, :shallow]).any(axis=1) | (tree[1:] != tree[:-1])
    run = np.cumsum(begin) - 1
    size = np.bincount(run)[run] if n else run
    left = (size > SMALL) | (run == 0) | (run == (run[-1] if n else 0))
    out = [np.zeros((0, 2), np.int64)]
    for off in range(1, min(SMALL, n)):
        i = np.flatnonzero(~left[:-off] & (run[:-off] == run[off:]))
        out.append(np.stack([np.minimum(key[i], key[i + off]), np.maximum(key[i], key[i + off])], axis=1))
    pairs = np.unique(np.concatenate(out), axis=0)
    rest = np.flatnonzero(left)
    bucket = tokens.mix(tree[rest].astype(np.uint64) + np.uint64(1))
    for d in range(shallow):
        bucket = tokens.mix(bucket * np.uint64(tokens._BASE) + prefix[rest, d].astype(np.uint64))
    return pairs[:, 0], pairs[:, 1], rest, bucket.astype(np.int64)


def _pair(shallow: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("tree", pa.int32()), ("prefix", pa.binary()), ("tie", pa.int64()), ("key", pa.int64())])).combine_chunks()
        if t.num_rows:
            tree, key = t.column("tree").to_numpy(), t.column("key").to_numpy()
            prefix = np.frombuffer(b"".join(t.column("prefix").to_pylist()), ">u4").reshape(-1, DEPTH)
            a, b, rest, bucket = trie_pairs(tree, prefix, key, shallow)
            none = lambda n: pa.nulls(n, pa.int64())
            names = ["a", "b", "bucket"]
            for k in range(0, len(a), 100_000):
                x, y = a[k : k + 100_000], b[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), none(len(x))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(key[rest]), none(len(rest)), pa.array(bucket)], names=names)

    return run


def candidates(signed: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """From ``signed(key, signature)``: distinct candidate pairs (a, b) of keys, a < b, of prefixes
    that few share, and the members (bucket, key) of crowded ones."""
    rows = signed.mapInArrow(_trees, "tree int, prefix binary, tie bigint, key bigint")
    tasks = max(1, -(-signed.count() * TREES // TASK_ROWS))
    order = ("tree", "prefix", "tie", "key")
    dealt = rows.repartitionByRange(tasks, *order) if tasks > 1 else rows.repartition(1)
    made = written(dealt.sortWithinPartitions(*order).mapInArrow(_pair(shortest(least)), "a bigint, b bigint, bucket bigint"), "pairs")
    left = made.where(F.col("b").isNull()).select("bucket", F.col("a").alias("key"))
    sizes = written(left.groupBy(F.col("bucket").alias("s_bucket")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    members = written(left.join(sizes, F.col("bucket") == F.col("s_bucket")).select("bucket", "key", "n"), "members")
    few = members.where(F.col("n") <= SMALL)
    cut = few.select("bucket", F.col("key").alias("a")).join(few.select(F.col("bucket").alias("o_bucket"), F.col("key").alias("b")), (F.col("bucket") == F.col("o_bucket")) & (F.col("a") < F.col("b")))
    pairs = made.where(F.col("b").isNotNull()).select("a", "b").unionByName(cut.select("a", "b")).distinct()
    return pairs, members.where(F.col("n") > SMALL).select("bucket", "key")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the bytes of their shingles."""
    for batch in batches:
        for lo, part in tokens.pieces(batch.column(1)):
            h, at = shingle_sets(part)
            packed = [h[at[k] : at[k + 1]].tobytes() for k in range(len(part))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array(packed, pa.binary()), batch.column(2).slice(lo, len(part))], names=["s_key", "shingles", "hot"])


class _Incidence:
    """Which of some rows hold which values, as strips of dense matrices."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        row = np.repeat(np.arange(len(sizes)), sizes)
        _, col, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count > 1  # others are common to no pair
        keep = shared[col]
        row, col = row[keep], (np.cumsum(shared) - 1)[col[keep]]
        order = np.argsort(col, kind="stable")
        self.row, self.col, self.width, self.rows = row[order], col[order], int(shared.sum()), len(sizes)

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of values that each of the rows ``left`` has in common with each of ``right``."""
        out = np.zeros((len(left), len(right)), np.float32)
        at = np.full((2, self.rows), -1)
        at[0, left], at[1, right] = np.arange(len(left)), np.arange(len(right))
        for c in range(0, self.width, STRIP):
            lo, hi = np.searchsorted(self.col, [c, c + STRIP])
            row, col = self.row[lo:hi], self.col[lo:hi] - c
            dense = []
            for k, n in enumerate((len(left), len(right))):
                place = at[k, row]
                dense.append(np.zeros((n, min(STRIP, self.width - c)), np.float32))
                dense[k][place[place >= 0], col[place >= 0]] = 1
            out += dense[0] @ dense[1].T
        return out


def _hang(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a matrix of links, a row that each is connected to; -1
    without links. ``same``: rows and columns are the same texts."""
    rows = np.full(linked.shape[0], -1)
    cols = rows if same else np.full(linked.shape[1], -1)
    turned = linked if same else np.ascontiguousarray(linked.T)
    for s in np.flatnonzero(linked.any(axis=1)):
        if rows[s] >= 0:
            continue
        rows[s] = s
        front = np.array([s])
        while len(front):
            met = np.flatnonzero(linked[front].any(axis=0) & (cols < 0))
            cols[met] = s
            front = met if same else np.flatnonzero(turned[met].any(axis=0) & (rows < 0))
            rows[front] = s
    return rows, cols


def block_links(bucket: int, part: np.ndarray, key: np.ndarray, shingles: list[bytes], hot: list[list[int]], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links between two blocks of a crowded prefix, or within one: texts, a text that each
    is connected to, and their links. Pairs that share a smaller crowded prefix are left to it."""
    size = np.array([len(x) // 8 for x in shingles])
    sets = _Incidence(np.frombuffer(b"".join(shingles), np.uint64), size)
    before = [[x for x in some if x < bucket] for some in hot]
    done = _Incidence(np.array([x for some in before for x in some], np.int64), np.array([len(x) for x in before]))
    left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    same = part.min() == part.max()
    linked = np.zeros((len(left), len(right)), bool)
    for k in range(0, len(left), STRIP):
        rows = left[k : k + STRIP]
        common = sets.common(rows, right).astype(np.int64)
        whole = size[rows][:, None] + size[right] - common
        linked[k : k + STRIP] = (common >= least * whole) & (done.common(rows, right) == 0) & (rows[:, None] != right)
    up, down = _hang(linked, same)
    if same:
        at, root, n = left, up, linked.sum(axis=1)
    else:
        at, root, n = np.concatenate([left, right]), np.concatenate([up, down]), np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])
    met = n > 0
    return key[at[met]], key[left[root[met]]], n[met].astype(np.int64)


def _blocks(least: float) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        get = lambda name: group.column(name).to_numpy()
        i, j, part = get("i")[0], get("j")[0], get("part")
        if len(np.unique(part)) < (1 if i == j else 2):
            found = [np.zeros(0, np.int64)] * 3
        else:
            found = block_links(int(get("bucket")[0]), part, get("key"), group.column("shingles").to_pylist(), group.column("hot").to_pylist(), least)
        return pa.table([pa.array(x) for x in found], names=["key", "root", "n"])

    return run


def crowded_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Stars (key, root, n) of ``members(bucket, key)`` with ``sets(s_key, shingles, hot)``: links of
    a text under a crowded prefix, by blocks, and a text that it is connected to."""
    sized = members.join(sets.select("s_key", F.length("shingles").alias("bytes")), F.col("key") == F.col("s_key"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
    blocks = written(sized.groupBy(F.col("bucket").alias("b_bucket")).agg(parts.alias("parts")), "blocks")
    dealt = members.join(blocks, F.col("bucket") == F.col("b_bucket")).select("bucket", "key", "parts", F.pmod(F.xxhash64("key", "bucket"), F.col("parts")).cast("int").alias("part"))
    each = dealt.select("bucket", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    each = written(each.select("bucket", "key", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")), "blocked")
    return written(each.join(sets.hint("merge"), F.col("key") == F.col("s_key")).groupBy("bucket", "i", "j").applyInArrow(_blocks(least), "key bigint, root bigint, n bigint"), "stars")


def _verify(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep, said = [], []
            for lo, part in tokens.pieces(x):
                left = [part, y.slice(lo, len(part))]
                (h, at), (g, to) = (shingle_sets(t) for t in left)
                for k in range(len(part)):
                    p, q = h[at[k] : at[k + 1]], g[to[k] : to[k + 1]]
                    both = np.concatenate([p, q])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    whole = len(p) + len(q) - common
                    keep.append(whole > 0 and common >= least * whole)
                    said.append(common / max(1, whole))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(said, pa.float64()).filter(mask)], names=["a", "b", "similarity"])

    return run


def similarity_join(docs: DataFrame, least: float = LEAST, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, key) of all documents by copy class, links (a, b, similarity) between different
    copy classes of at least ``least``, and the stars of all further links (see crowded_links)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(docs.select("doc_id", "text").mapInArrow(_signer(bits), f"doc_id {kind}, key bigint, check bigint, signature binary"), "signed")
    grouped = lambda: written(signed.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("check").alias("low"), F.max("check").alias("high")), "classes")
    classes = grouped()
    mixed = classes.where(F.col("low") != F.col("high")).select(F.col("key").alias("m_key"))
    if not mixed.isEmpty():  # different texts met in a key: the check is the key of all of them
        signed = written(signed.join(mixed, F.col("key") == F.col("m_key"), "left").withColumn("key", F.when(F.col("m_key").isNull(), F.col("key")).otherwise(F.col("check"))).drop("m_key"), "signed")
        classes = grouped()
    rows, classes = signed.select("doc_id", "key"), classes.select("key", "first")
    one = signed.where(F.col("signature").isNotNull()).join(
        classes.select(F.col("key").alias("c_key"), "first"), (F.col("key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi"
    )
    unique = written(one.select("key", "signature").dropDuplicates(["key"]), "unique")
    pairs, members = candidates(unique, least)
    pairs = written(pairs, "candidates")
    hot = written(members.groupBy(F.col("key").alias("h_key")).agg(F.collect_set("bucket").alias("hot")), "hot")
    asked = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).union(hot.select("h_key")).distinct()
    needed = written(asked.join(hot, F.col("key") == F.col("h_key"), "left").select("key", "hot").join(classes, "key"), "needed")
    # one plan at every size: what is needed grows with the input, so it isn't broadcast where it happens to be small
    texts = docs.select(F.col("doc_id"), F.col("text")).join(needed.select(F.col("first"), F.col("key").alias("t_key"), "hot").hint("merge"), F.col("doc_id").eqNullSafe(F.col("first")))
    texts = written(texts.select("t_key", "text", "hot").mapInArrow(_owner(bits), "t_key bigint, text string, hot array<bigint>").dropDuplicates(["t_key"]), "texts")
    side = lambda key, text: texts.select(F.col("t_key").alias(key), F.col("text").alias(text), F.col("hot").alias(f"hot_{text}"))
    joined = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").where(~F.coalesce(F.arrays_overlap("hot_x", "hot_y"), F.lit(False)))
    links = written(joined.select("a", "b", "x", "y").mapInArrow(_verify(least), "a bigint, b bigint, similarity double"), "links")
    sets = written(texts.where(F.col("hot").isNotNull()).mapInArrow(_sets, "s_key bigint, shingles binary, hot array<bigint>"), "sets")
    return rows, links, crowded_links(members, sets, least)


def _owner(bits: int) -> Callable:
    """Rows whose text has the key; others share an id with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_keys(*shingle_sets(part), bits) for _, part in tokens.pieces(batch.column(1))]
            wanted = batch.column(0).to_numpy()
            keys, checks = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (wanted, wanted)
            yield batch.filter(pa.array((keys == wanted) | (checks == wanted)))

    return run


def near_duplicates(docs: DataFrame, least: float = LEAST, bits: int = 64) -> DataFrame:
    """(doc_id, key, copy_id, class_id, n_links) for every row: the smallest id of its copy
    class and of its class of linked texts, and its copy class's links."""
    rows, links, stars = similarity_join(docs, least, bits)
    roots = components(links.select("a", "b").union(stars.select("key", "root")))
    one = F.lit(1).cast("long").alias("n")
    ends = links.select(F.col("a").alias("e_key"), one).union(links.select("b", one)).union(stars.select("key", "n")).groupBy("e_key").agg(F.sum("n").alias("n_links"))
    copies = rows.groupBy("key").agg(F.min("doc_id").alias("copy_id"))
    known = written(
        copies.join(roots, F.col("key") == F.col("node"), "left").join(ends, F.col("key") == F.col("e_key"), "left").select("key", "copy_id", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "known",
    )
    named = written(known.groupBy(F.col("root").alias("c_root")).agg(F.min("copy_id").alias("class_id")), "named")
    classes = written(known.join(named, F.col("root") == F.col("c_root")).select(F.col("key").alias("c_key"), "copy_id", "class_id", "n_links"), "membership")
    return rows.join(classes, F.col("key") == F.col("c_key")).select("doc_id", "key", "copy_id", "class_id", "n_links")
