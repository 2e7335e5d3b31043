"""Near-duplicate groups by banded min-max hashing, links confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._skew import join_groups
from ._text import PIECE, grams, mixed, slices, words
from ._work import shared_dir, stash

#: Permutations; each gives its minimum and its maximum, so twice as many signature values, banded by fours. Texts at
#: similarity s share a band with probability 1 - (1 - s^4)^32: 1 - 5e-8 at 0.8.
PERMUTATIONS, ROWS = 64, 4
_VALUES = 2 * PERMUTATIONS
_FACTORS = mixed(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
#: Rows of one bucket that are compared at once, rows of a cluster whose texts are, and rows of a larger cluster that all its blocks hold.
_BLOCK, _CLUSTER, _PIVOTS = 4096, 1024, 16


def signatures(shingles: list[np.ndarray]) -> np.ndarray:
    """Minimum and maximum under each permutation, one row a set; no set may be empty."""
    x = np.concatenate(shingles)
    first = np.concatenate([[0], np.cumsum([len(s) for s in shingles])[:-1]])
    out = np.empty((len(shingles), _VALUES), np.uint64)
    for i, a in enumerate(_FACTORS):
        y = x * a
        out[:, 2 * i] = np.minimum.reduceat(y, first)
        out[:, 2 * i + 1] = np.maximum.reduceat(y, first)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    n = _VALUES // ROWS
    out = np.broadcast_to(mixed(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(32)), (len(signature), n)).copy()
    for j in range(ROWS):
        out = mixed(out ^ mixed(signature[:, j::ROWS] + np.uint64(j)))
    return out


def _least_equal(threshold: int) -> int:
    """Equal signature values, of all, that a pair at the threshold shows: seven standard deviations under the mean.

    Were the values independent, a pair at 0.85 would show fewer with a chance of 1.1e-10 (0.80: 2.7e-11, exact binomial tails); they aren't quite, so recall is also measured (README).
    """
    s = threshold / 100
    return int(_VALUES * s - 7 * (_VALUES * s * (1 - s)) ** 0.5)


def _sketch(size: int):
    """Set size, two sums over the set under independent word hashes, which tell sets apart by 128 bits, signature and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2), PIECE // 4):
                w = words(batch.column(2).slice(lo, hi - lo), lower=True)
                (h, first), (g, _) = grams(w, size), grams(w.other(), size)
                part, s1, s2 = [], np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                for i in range(hi - lo):
                    own, at = np.unique(h[first[i] : first[i + 1]], return_index=True)
                    part.append(own)
                    s1[i], s2[i] = mixed(own ^ np.uint64(1)).sum(dtype=np.uint64), mixed(g[first[i] + at]).sum(dtype=np.uint64)
                n = np.array([len(s) for s in part], np.int64)
                full = np.flatnonzero(n)
                sig = np.zeros((len(part), _VALUES), np.uint64)
                if len(full):
                    sig[full] = signatures([part[i] for i in full])
                keys = bands(sig).view(np.int64)
                offsets = np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([r.tobytes() for r in mixed(sig).astype(np.uint8)], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                    ["id", "th", "n", "s1", "s2", "sig", "bands"],
                )

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid and the text's words, A-Z lower-cased, joined by one space."""
    for batch in batches:
        text = [b" ".join((t or b"").lower().split()) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary())], ["cid", "members"])


def exact_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted numbers of each text's distinct runs of ``size`` words (of all its words, if fewer); equal numbers mean equal bytes. No text may be empty."""
    known: dict[bytes, int] = {}
    seqs = [np.array([known.setdefault(x, len(known)) for x in t.split(b" ")], np.int64) for t in texts]
    count = np.array([len(s) for s in seqs])
    at = np.concatenate([[0], np.cumsum(count)])
    flat = np.concatenate(seqs)
    short = {i: tuple(seqs[i].tolist()) for i in np.flatnonzero(count < size).tolist()}
    run, many = flat[: max(len(flat) - size + 1, 0)], len(known) + 1
    for j in range(1, size):
        run = np.unique(run * many + flat[j : len(flat) - size + 1 + j], return_inverse=True)[1]
    names = {s: len(flat) + k for k, s in enumerate(dict.fromkeys(short.values()))}
    return [np.array([names[short[i]]]) if i in short else np.unique(run[at[i] : at[i + 1] - size + 1]) for i in range(len(texts))]


def _sigs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _VALUES)


def _alike(x: int, y: np.ndarray, n: np.ndarray, sig: np.ndarray, threshold: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of y sizes and signatures let be linked with x, and how many values they share with it."""
    y = y[100 * np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x])]
    equal = (sig[y] == sig[x]).sum(1)
    return y[equal >= least], equal[equal >= least]


def _forest(threshold: int):
    """From rows sorted by block: pairs that span what sizes and signatures let be linked, fewer than rows."""
    least = _least_equal(threshold)

    def spanned(cid: np.ndarray, n: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = np.arange(len(cid))
        while len(left) > 1:
            stack, left = [int(left[0])], left[1:]
            while stack and len(left):
                x = stack.pop()
                y, _ = _alike(x, left, n, sig, threshold, least)
                yield np.full(len(y), cid[x]), cid[y]
                stack += y.tolist()
                left = left[~np.isin(left, y)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)] + [_sigs(batch.column(5))]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            b, i, j, cid, n, sig = rest
            same = np.concatenate([[False], (b[1:] == b[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1])])
            begin = np.flatnonzero(~same)
            whole = len(b) if batch is None else int(begin[-1])
            chain = same[:whole].copy()
            at = np.flatnonzero(chain)
            fits = 100 * np.minimum(n[at], n[at - 1]) >= threshold * np.maximum(n[at], n[at - 1])
            chain[at] = fits & ((sig[at] == sig[at - 1]).sum(1) >= least)
            broken = np.unique(np.searchsorted(begin, np.flatnonzero(same[:whole] & ~chain), "right") - 1)
            out = [(cid[:whole][chain], cid[:whole][np.flatnonzero(chain) - 1])]
            ends = np.append(begin[1:], len(b))
            for g in broken.tolist():
                part = slice(begin[g], ends[g])
                out += spanned(cid[part], n[part], sig[part])
            rest = [x[whole:] for x in rest]
            u, v = (np.concatenate(x) for x in zip(*out, strict=True))
            yield _stars(u, v)

    return run


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Pairs as others that join the same: each node with the smallest of its part, so that chains don't take rounds to shrink."""
    node, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = flat[: len(u)], flat[len(u) :], np.arange(len(node))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        for side in (a, b):
            np.minimum.at(new, least[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, least):
            break
        least = new
    far = least != np.arange(len(node))
    return pa.RecordBatch.from_arrays([pa.array(node[least[far]]), pa.array(node[far])], ["a", "b"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _confirm(threshold: int, size: int):
    """Of one block of a cluster: links, confirmed on whole sets of words' bytes, that join what has different labels; fewer than rows.

    Rows of side 1 are compared with those of side 0; without any, all with each other.
    """
    least = _least_equal(threshold)

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        shared = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
        return 100 * shared >= threshold * (len(x) + len(y) - shared)

    def run(table: pa.Table) -> pa.Table:
        cid, n, side = (table.column(c).to_numpy() for c in ("cid", "n", "side"))
        sig, sets_ = _sigs(table.column("sig")), exact_sets(table.column("members").to_pylist(), size)
        label = np.unique(table.column("label").to_numpy(), return_inverse=True)[1]
        every, out, across = np.arange(len(cid)), [], (side == 1).any()
        for x in np.flatnonzero(side == (1 if across else 0)).tolist():
            y = np.flatnonzero((label != label[x]) & ((side == 0) if across else (every > x)))
            y, equal = _alike(x, y, n, sig, threshold, least)
            for z in y[np.argsort(-equal, kind="stable")].tolist():
                if label[z] != label[x] and linked(sets_[x], sets_[z]):
                    out.append((min(cid[x], cid[z]), max(cid[x], cid[z])))
                    label[label == label[z]] = label[x]
        return pa.Table.from_batches([_stars(*np.array(out, np.int64).reshape(-1, 2).T)])

    return run


def confirmed(full: DataFrame, threshold: int, size: int, path: str) -> DataFrame:
    """``node, root`` of the classes of each cluster that whole sets link with others.

    ``full`` holds ``root, m, cid, n, sig, members``. A cluster of up to
    _CLUSTER classes is one group. Those of a larger one are dealt into blocks,
    each with some _PIVOTS classes that all blocks of the cluster hold, so that
    near copies of one text join in one round, without pairs of blocks. Of what
    is then apart, every class outside the cluster's largest part is compared
    with all of the cluster, in blocks; nothing else can add a link.
    """
    blocks_ = F.ceil(F.col("m") / _CLUSTER).cast("int")
    own = lambda of: F.pmod(F.xxhash64("cid"), of).cast("int")
    pivot = (F.col("nb") > 1) & (F.pmod(F.xxhash64("cid", F.lit(1)), F.col("m")) < _PIVOTS)
    rows = full.withColumn("nb", blocks_)
    alone = rows.withColumn("i", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(own(F.col("nb"))))))
    alone = alone.select("root", "i", "cid", "n", "sig", "members", F.lit(0).alias("side"), F.col("cid").alias("label"))
    links = alone.groupBy("root", "i").applyInArrow(_confirm(threshold, size), "a long, b long")
    parts = stash(components(links, f"{path}-alone"), f"{path}-parts")
    large = rows.where("nb > 1")
    if large.isEmpty():
        return parts
    labels = parts.withColumnsRenamed({"node": "of", "root": "part"})
    large = large.join(labels, F.col("cid") == F.col("of"), "left").withColumn("label", F.coalesce("part", "cid")).drop("of", "part")
    sizes = large.groupBy("root", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("root").agg(F.max_by("label", F.struct("k", "label")).alias("top"), F.sum("k").alias("k"), F.max("k").alias("most"))
    sizes = stash(sizes.where("k > most").withColumn("no", F.ceil((F.col("k") - F.col("most")) / _CLUSTER).cast("int")), f"{path}-open")
    if sizes.isEmpty():
        return parts
    rest = join_groups(large, sizes, {"root": "root"}, "k", ["top", "no"], ["cid"])
    one = rest.withColumn("i", own(F.col("nb"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("no") - 1))).withColumn("side", F.lit(0))
    two = rest.where("label <> top").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("j", own(F.col("no"))).withColumn("side", F.lit(1))
    more = one.unionByName(two).select("root", "i", "j", "cid", "n", "sig", "members", "side", "label")
    more = more.groupBy("root", "i", "j").applyInArrow(_confirm(threshold, size), "a long, b long")
    return stash(components(more.unionAll(parts.select("node", "root")), f"{path}-across"), f"{path}-all")


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows of keys with ``m`` rows each, dealt into all pairs (i, j) of the key's blocks of about ``most`` rows.

    The size comes with each row, so that nothing here shuffles on the key alone.
    """
    dealt = rows.withColumn("nb", F.ceil(F.col("m") / most).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.select(*[c for c in rows.columns if c != "m"], F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def components(links: DataFrame, path: str) -> DataFrame:
    """``node, root`` of all linked nodes, root the smallest reachable: large and small stars in turn until nothing changes."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{path}-0")
    state, k = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
        state, k = now, k + 1
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("k"))
        large = join_groups(both.where("v > u"), least, {"u": "u"}, "k", ["m"], ["v"], total=2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large, f"{path}-{k}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = join_groups(large, least, {"u": "u"}, "k", ["m"], ["v"], total=2 * now[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stash(small.where("u <> v").distinct(), f"{path}-{k}s")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, size: int = 5) -> DataFrame:
    """One row per input row: ``<id>, n_shingles, component_id, kept``.

    Words are maximal runs without white space, A-Z lower-cased; a text's set
    holds its distinct runs of ``size`` words, or all its words as one run if
    it has fewer. Texts whose sets reach ``threshold`` per cent of their union
    are linked, ``component_id`` is the smallest id reachable.

    Equal sets are one class, told apart by 128 bits of two independent hashes.
    Classes that share a band and whose sizes and signatures leave the
    threshold within reach (seven standard deviations) form clusters; each
    bucket adds the pairs that span it, fewer than its rows. Within a cluster
    whole sets of words' bytes decide, and again only links that join
    components are made (``confirmed``). Keys that hold a large share of the
    rows (a class of many copies, a hub, a bucket, a cluster) are met by
    broadcast (``join_groups``) or in blocks over many tasks. No cap ends the
    search.

    Null and empty texts have size 0, no links and their own id. Ids may
    repeat; null ids come last, so that ``component_id`` is null only where
    all ids are. ``kept`` is ``id = component_id``. An empty table gives an
    empty result; further columns are not looked at.
    """
    spark, top = docs.sparkSession, shared_dir(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    sketch = stash(rows.mapInArrow(_sketch(size), f"id {kind}, th long, n long, s1 long, s2 long, sig binary, bands array<long>"), f"{top}/sketch")
    key = ["n", "s1", "s2"]
    who = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("who")
    classes = sketch.where("n > 0").groupBy(*key).agg(who, F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    classes = stash(classes.select(F.monotonically_increasing_id().alias("cid"), *key, F.col("who.id").alias("rep"), F.col("who.th").alias("th"), "sig", "bands", "rows"), f"{top}/classes")

    band = classes.select("cid", "n", F.explode("bands").alias("b"))
    shared = band.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    cand = stash(join_groups(band, shared, {"b": "b"}, "m", ["m"], ["cid"], total=classes.count() * (_VALUES // ROWS)).join(classes.select("cid", "sig"), "cid").select("b", "m", "cid", "n", "sig"), f"{top}/cand")

    # clusters: what sizes and signatures let be linked; a bucket gives fewer pairs than it has rows
    dealt = blocks(cand, _BLOCK).select("b", "i", "j", "cid", "n", "sig")
    dealt = dealt.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j", "n", "cid")
    pairs = stash(dealt.mapInArrow(_forest(threshold), "a long, b long").distinct(), f"{top}/pairs")
    clusters = stash(components(pairs, f"{top}/near"), f"{top}/clusters")
    clusters = clusters.unionAll(clusters.select(F.col("root"), "root").distinct())
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    clusters = join_groups(clusters, sizes, {"root": "root"}, "m", ["m"], ["node"], total=clusters.count())

    # the sets of the clusters' classes, compared in blocks
    need = clusters.join(classes, F.col("node") == F.col("cid")).select("cid", "rep", F.col("th").alias("h"))
    texts = rows.join(need.hint("shuffle_hash"), (F.col("th") == F.col("h")) & F.col("id").eqNullSafe(F.col("rep"))).select("cid", "text")
    members = texts.dropDuplicates(["cid"]).mapInArrow(_words_of, "cid long, members binary")
    full = clusters.join(classes.select("cid", "n", "sig"), F.col("node") == F.col("cid")).drop("cid").join(members, F.col("node") == F.col("cid")).select("root", "m", "cid", "n", "sig", "members")
    roots = confirmed(stash(full, f"{top}/full"), threshold, size, f"{top}/linked")
    placed = classes.join(roots, F.col("cid") == F.col("node"), "left").select(*key, "rep", "rows", F.coalesce("root", "cid").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m"))
    placed = stash(join_groups(placed, least, {"comp": "comp"}, "m", ["component_id"], [*key], total=classes.count()).select(*key, "rows", "component_id"), f"{top}/placed")
    found = join_groups(sketch.where("n > 0").select("id", *key), placed, {c: c for c in key}, "rows", ["component_id"], ["id"], total=sketch.count())
    out = found.unionByName(sketch.where("n = 0").select("id", *key, F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> DataFrame:
    """``docs`` with one document of each group, all columns kept; ids must be distinct, rows of null id all stay."""
    gone = near_groups(docs, id_col, text_col, threshold).where("not kept").select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
