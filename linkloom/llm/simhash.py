"""Near-duplicate documents by SimHash, with Pigeonring filtering before the full Hamming check.

Fingerprints have 64 bits over word shingles. A ring of m segments holds the bits; if two fingerprints differ in at most
r bits, then from some segment on every chain of l consecutive segments differs in at most l * r / m bits. Where this
budget stays below 1 for the first segments (r = 2, m = 5: two segments), they must be equal and are the key under which
candidates meet; longer chains then prune before all bits are compared.

For large radii no chain is equal for certain, so candidates meet under the smallest shingle hashes that they share
(`sketch`), the chains prune as before, and a link needs a Jaccard similarity of `similar`. A set of n shingles has one
more key than the (1 - similar) * n shingles that a partner may lack, so that partners must share one, but `sketch` keys
at most; where that is fewer, a link is lost with a probability of (1 - similar) ** sketch at most. The similarity
is first estimated, as the part of BINS bins in which both texts have the same smallest hash (one-permutation hashing, a
deviation of 0.025 at most); links within MARGIN of `similar` are then checked on the whole shingle sets of both texts.

Groups under one key are never expanded into pairs: from each group a spanning forest leaves, of sure links first, then of
the best doubtful ones between its trees, so fewer links than it has nodes. Doubtful links are looked for between nodes up to
REACH apart in the group; where trees stay apart that have some further off, the group is searched again, in rounds, each
FURTHER times as far. The forest's doubtful links are checked on whole sets. Those it left out matter only where the
checked ones leave a component of possible links in several parts: between these, tasks compare whole sets, in chunks.
Groups over BLOCK nodes are dealt out in chunks, which meet in pairs only where links by other keys leave them apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch, batch, nonempty, small_batches, texts, utf8, written
from linkloom.llm.components import components, stars

SEED = 42
BITS = 64
#: Distinct fingerprints that one task compares with one another; larger groups are dealt out as pairs of chunks.
BLOCK = 4096
#: Bins of the hash range, of a byte each, that estimate the similarity of two texts' shingles.
BINS = 256
#: With a sketch, the least similarity of a link.
SIMILAR = 0.8
#: Estimates this close to the least similarity are checked on whole texts: three deviations.
MARGIN = 0.08
#: The ids of texts to check are broadcast up to this number (8 bytes each), else shuffled.
BROADCAST_IDS = 1_000_000
#: How far apart in a group the first search looks for doubtful links.
REACH = 64
#: How many times as far each round looks as the one before.
FURTHER = 8
#: Copies of the rows that tell a component's least id, so that no task has all rows of a large component.
SALTS = 16
#: Bits that a chain must have to be a key.
KEY_BITS = 12
#: Groups up to this size are compared by shifting; larger ones by search from node to node.
FEW = 8
#: Nodes of a chunk where whole sets are compared, and chunks of a group; there are more only where a chunk has over HELD hashes.
CHUNK, CHUNKS, HELD = 64, 32, 1 << 20
#: Shingles whose hashes are held at once: bounds memory for very long texts.
PIECE = 1 << 18

_BIN_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, piece by piece; of the whole sequence if it has fewer words."""
    n = len(words) - shingle + 1
    if n < 1:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    for at in range(0, n, PIECE):
        part = words[at : min(at + PIECE, n) + shingle - 1]
        joined = map(b" ".join, zip(*(islice(part, i, None) for i in range(shingle)), strict=False))
        yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(part) - shingle + 1)


def distinct(words: list[bytes], shingle: int) -> np.ndarray:
    """The hashes of all shingles, each once, sorted: what similarities go by."""
    held = np.empty(0, np.uint64)
    for h in _hashes(words, shingle) if words else ():
        held = np.union1d(held, h)
    return held


def digest(hashes: np.ndarray) -> int:
    """Of a sorted set of hashes; 0 for the empty set."""
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), SEED) if hashes.size else 0


def fingerprint(text: bytes, shingle: int = 3, sketch: int = 0, similar: float = SIMILAR) -> tuple[int, list[int], bytes, int]:
    """Of a text in UTF-8, with A-Z lower-cased and words parted at ASCII white space: the fingerprint (which counts
    repeated shingles as often as they occur, but with a sketch, as the similarity does, once) and, with a sketch,
    its smallest shingle hashes, a byte for each bin, which tells the bin's smallest hash (0: the bin is empty), and the
    digest of its shingle set, which texts share if their similarity is 1."""
    words = text.lower().split()  # on bytes, both know ASCII only
    if not words:
        return 0, [], bytes(BINS if sketch else 0), 0
    counts, total = np.zeros((8, 256), np.int64), 0
    h = distinct(words, shingle) if sketch else None
    for part in _hashes(words, shingle) if h is None else (h[at : at + PIECE] for at in range(0, len(h), PIECE)):
        for j, column in enumerate(part.astype("<u8").view(np.uint8).reshape(-1, 8).T):
            counts[j] += np.bincount(column, minlength=256)
        total += len(part)
    fp = int(np.packbits((counts @ _BYTE_BITS).ravel() * 2 > total, bitorder="little").view("<u8")[0])
    if not sketch:
        return fp, [], b"", 0
    least = np.full(BINS, _NONE)
    at = np.searchsorted(h, _BIN_STARTS)
    full = np.diff(np.r_[at, len(h)]) > 0
    least[full] = h[at[full]]
    # within a bin the smallest hash has small high bits; its low bits are spread evenly
    bins = np.where(least == _NONE, 0, 1 + (least & np.uint64(0xFFFFFFFF)) % np.uint64(255)).astype(np.uint8).tobytes()
    return fp, h[: min(sketch, prefix(len(h), similar))].tolist(), bins, digest(h)


def prefix(n: int, similar: float) -> int:
    """Of n shingles, how many of the smallest hashes sets of the similarity cannot all lack."""
    return n - math.ceil(similar * n - 1e-9) + 1


def _fingerprints(shingle: int, sketch: int, similar: float, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in nonempty(batches):
        got = [fingerprint(t, shingle, sketch, similar) for t in utf8(b.column(1))]
        fp = pa.array(np.array([x for x, *_ in got], dtype=np.uint64).view(np.int64))
        columns = [b.column(0), fp]
        if sketch:
            flat = np.array([h for _, s, *_ in got for h in s], dtype=np.uint64).view(np.int64)
            ends = np.cumsum([0, *(len(s) for _, s, *_ in got)]).astype(np.int32)
            columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([x for _, _, x, _ in got], pa.binary())]
            columns.append(pa.array(np.array([x for *_, x in got], dtype=np.uint64).view(np.int64)))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def fingerprints(docs: DataFrame, shingle: int = 3, sketch: int = 0, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """doc_id, fp (the unsigned fingerprint in a long) and, if asked for, the sketch: its smallest hashes as `sketch`,
    `bins`, and the digest of the shingle set as `node`. A null or blank text has fingerprint and node 0 and an empty sketch."""
    small_batches(docs.sparkSession)
    fields = [pa.field("doc_id", pa.int64()), pa.field("fp", pa.int64())] + ([pa.field("sketch", pa.list_(pa.int64())), pa.field("bins", pa.binary()), pa.field("node", pa.int64())] if sketch else [])
    ddl = "doc_id long, fp long" + (", sketch array<long>, bins binary, node long" if sketch else "")
    return texts(docs, id_col, text_col).mapInArrow(partial(_fingerprints, shingle, sketch, similar, pa.schema(fields)), ddl)


def ring(radius: int) -> tuple[int, int]:
    """Number of segments, and how many consecutive ones must be equal: the fewest segments of which two in a row must be;
    (4, 0) if such a pair has fewer than KEY_BITS bits, too few for a key."""
    m = 2 * radius + 1
    return (m, 2) if 2 * (BITS // m) >= KEY_BITS else (4, 0)


def widths(m: int) -> list[int]:
    return [BITS // m + (i < BITS % m) for i in range(m)]


def chain_keys(fp: Column, radius: int) -> Column:
    """One key for each segment of the ring: the bits of it and the next one, with its number."""
    m, w = ring(radius)[0], widths(ring(radius)[0])
    at = [sum(w[:i]) for i in range(m)]
    part = lambda i: F.shiftrightunsigned(fp, at[i]).bitwiseAND(F.lit((1 << w[i]) - 1))
    return F.array(*(F.xxhash64(F.lit(i), part(i), part((i + 1) % m)) for i in range(m)))


def pigeonring(x: np.ndarray, radius: int) -> np.ndarray:
    """Of differences x (uint64), which may have up to radius bits: from some segment on, all chains keep within their budgets."""
    m = max(4, ring(radius)[0]) if radius < 8 else 4
    w, at, d = widths(m), 0, []
    for size in w:
        d.append(np.bitwise_count((x >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int16))
        at += size
    any_start = np.zeros(x.shape, bool)
    for start in range(m):
        total, good = np.zeros(x.shape, np.int16), np.ones(x.shape, bool)
        for step in range(1, min(3, m - 1) + 1):  # longer chains cost as much as the full check
            total = total + d[(start + step - 1) % m]
            good &= total * m <= step * radius
        any_start |= good
    return any_start


def near(x: np.ndarray, radius: int) -> np.ndarray:
    """Which differences have at most radius bits: the chains prune, then all bits of the rest are counted."""
    good = pigeonring(x, radius)
    at = np.flatnonzero(good)
    good[at] = np.bitwise_count(x[at]) <= radius
    return good


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of bins: the estimated Jaccard similarity; 0 where both are empty."""
    same = ((a == b) & (a > 0)).sum(axis=1)
    return same / np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)


Found = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _forest(f: np.ndarray, s: np.ndarray | None, radius: int, similar: float) -> tuple[Found, np.ndarray]:
    """Sure links, one fewer than nodes in each tree, as positions in f and estimates; and each node's tree."""
    left, out, tree = np.arange(len(f)), [], np.arange(len(f))
    while left.size:
        root, left, todo = left[0], left[1:], [left[0]]
        while todo and left.size:
            u = todo.pop()
            at = np.flatnonzero(near(f[left] ^ f[u], radius))
            est = np.ones(at.size) if s is None else similarity(s[left[at]], s[u])
            at, est = (at, est) if s is None else (at[est >= similar + MARGIN], est[est >= similar + MARGIN])
            if at.size:
                found = left[at]
                out.append((np.full(at.size, u), found, est))
                tree[found] = root
                todo.extend(found)
                left = np.delete(left, at)
    return out, tree


def _best(a: np.ndarray, b: np.ndarray, est: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between trees, which form a spanning forest of the best estimates, fewer than trees; and each node's tree with them."""
    order, kept = np.argsort(-est, kind="stable"), [np.empty(0, np.int64)]
    x, y, at = tree[a[order]], tree[b[order]], np.arange(len(order))
    while True:
        apart = x != y
        if not apart.any():
            return order[np.concatenate(kept)], tree
        x, y, at = x[apart], y[apart], at[apart]
        first = np.full(len(tree), len(order))
        np.minimum.at(first, x, at)
        np.minimum.at(first, y, at)
        chosen = np.isin(at, first)  # the best link of each tree; as no two links rank the same, these close no circle
        kept.append(at[chosen])
        to = np.arange(len(tree))
        moved, root = stars(x[chosen], y[chosen])
        to[moved] = root
        x, y, tree = to[x], to[y], to[tree]


def _doubtful(f: np.ndarray, s: np.ndarray, tree: np.ndarray, first: int, last: int, radius: int, similar: float) -> tuple[Found, bool]:
    """Links between trees that are possible, of nodes over first and up to last apart in the ring of f, but fewer than trees:
    a spanning forest of the best estimates. And whether trees that it leaves apart have such links further apart."""
    n, found, held = len(f), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], 0
    if (tree == tree[0]).all():
        return [], False
    for apart in range(first + 1, min(last, n // 2) + 1):
        a = np.arange(n if 2 * apart < n else n - apart)
        b = (a + apart) % n
        good = tree[a] != tree[b]
        good[good] = near(f[a[good]] ^ f[b[good]], radius)
        a, b = a[good], b[good]
        est = similarity(s[a], s[b])
        good = est >= similar - MARGIN
        found.append((a[good], b[good], est[good]))
        held += int(good.sum())
        if held > 16 * n or apart == min(last, n // 2):
            a, b, est = map(np.concatenate, zip(*found, strict=True))
            kept, _ = _best(a, b, est, tree)
            found, held = [(a[kept], b[kept], est[kept])], 0
    _, tree = _best(*found[0], tree)
    for i in range(n - 1 if 2 * last < n - 1 else 0):
        at = np.arange(i + last + 1, min(n, n + i - last))
        at = at[tree[at] != tree[i]]
        at = at[near(f[at] ^ f[i], radius)]
        if (similarity(s[at], s[i]) >= similar - MARGIN).any():
            return found, True
    return found, False


def _links_in(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, sketches: np.ndarray | None, radius: int, similar: float, reach: tuple[int, int], roots: np.ndarray | None) -> list[np.ndarray]:
    """Links within the groups of equal keys, which are sorted: the nodes at both ends and the estimates. A group with
    doubtful links beyond the reach gives its key at both ends and OPEN. With roots, links are those between roots."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    few = np.repeat(sizes <= FEW, sizes)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for step in range(1, FEW) if roots is None else ():
        at = np.flatnonzero((keys[step:] == keys[:-step]) & few[step:])
        if at.size:
            at = at[near(fps[at] ^ fps[at + step], radius)]
        if at.size:
            est = np.ones(at.size) if sketches is None else similarity(sketches[at], sketches[at + step])
            good = est >= similar - MARGIN
            out.append((nodes[at[good]], nodes[at[good] + step], est[good]))
    for i in np.flatnonzero(sizes > (FEW if roots is None else 1)):
        own = slice(starts[i], starts[i] + sizes[i])
        s = None if sketches is None else sketches[own]
        found, tree = _forest(fps[own], s, radius, similar) if roots is None else ([], np.unique(roots[own], return_inverse=True)[1])
        if s is not None:
            more, beyond = _doubtful(fps[own], s, tree, *reach, radius, similar)
            found += more
            if beyond:
                out.append((keys[[starts[i]]], keys[[starts[i]]], np.array([OPEN])))
        out += [(nodes[own][a], nodes[own][b], est) for a, b, est in found]
    return [np.concatenate(x) for x in zip(*out, strict=True)]


#: In place of an estimate: more links are to be sought under this key.
OPEN = -1.0
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("estimate", pa.float64())])


def _link(radius: int, similar: float, reach: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last group of a batch waits for the next one. A group has few times BLOCK rows at most."""
    held: list[tuple[np.ndarray, ...]] = []

    def joined():
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    def out(k, n, f, s=None, root=None):
        return batch(_LINKS, *_links_in(k, n, f, s, radius, similar, reach, root))

    for b in nonempty(batches):
        bins = [np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, BINS)] if b.num_columns > 3 else []
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64), *bins, *(b.column(i).to_numpy() for i in range(4, b.num_columns))))
        if sum(len(x[0]) for x in held) < 50_000:
            continue
        whole = joined()
        cut = np.searchsorted(whole[0], whole[0][-1])
        if cut:
            yield out(*(x[:cut] for x in whole))
        held = [tuple(x[cut:] for x in whole)]
    if held:
        yield out(*joined())


def large(keyed: DataFrame, tables: Scratch) -> DataFrame:
    """The keys of groups over BLOCK nodes, and how many chunks they are dealt out in."""
    found = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("chunks"))
    return tables.write(found, "large")


def in_pairs(keyed: DataFrame, of: DataFrame) -> DataFrame:
    """keyed, as for links(), with the groups named by large() dealt out as pairs of chunks, each with a key of its own."""
    chunk = F.pmod(F.xxhash64(F.lit(3), "key", "node"), F.col("chunks")).cast("int")
    return (
        keyed.join(of, "key", "left")
        .withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
        .select(F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least(chunk, "other"), F.greatest(chunk, "other"))).alias("key"), *keyed.columns[1:])
    )


def in_chunks(keyed: DataFrame, of: DataFrame) -> DataFrame:
    """As in_pairs(), but each chunk by itself; a node's chunks under several keys differ."""
    chunk = F.pmod(F.xxhash64(F.lit(3), "key", "node"), F.col("chunks")).cast("int")
    return keyed.join(of, "key", "left").select(F.when(F.col("chunks").isNull(), F.col("key")).otherwise(F.xxhash64("key", chunk)).alias("key"), *keyed.columns[1:])


def dealt(keyed: DataFrame, tables: Scratch) -> DataFrame:
    """keyed, as for links(), in pairs of chunks where there are large groups."""
    of = large(keyed, tables)
    return in_pairs(keyed, of) if of.limit(1).count() else keyed


def links(keyed: DataFrame, radius: int, similar: float = SIMILAR, reach: tuple[int, int] | None = None) -> DataFrame:
    """keyed: key, node, fp and, with a sketch, bins; without repeats of key and node; large groups in chunks. Links a, b, estimate
    between nodes under one key whose fingerprints differ in up to radius bits and, with bins, may be similar (else estimate
    is 1); not all of them, but as many as join the same nodes, fewer than nodes in each group over FEW. With bins, those are
    of the best estimates, and rows with the estimate OPEN name keys (as a) with doubtful links beyond the reach. If keyed has the root of the component of each node, too, links are those between
    components, of nodes within the reach."""
    found = keyed.repartition("key").sortWithinPartitions("key", "node")
    return found.mapInArrow(partial(_link, radius, similar, reach or (0, REACH)), "a long, b long, estimate double")


def _sets(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in nonempty(batches):
        for t in utf8(b.column(1)):  # a batch for each, since a text may be very long
            h = distinct(t.lower().split(), shingle)
            yield pa.RecordBatch.from_arrays([pa.array([digest(h)], pa.uint64()).view(pa.int64()), pa.array([h.view(np.int64)], pa.list_(pa.int64()))], names=["node", "hashes"])


def whole_sets(nodes: DataFrame, prints: DataFrame, rows: DataFrame, shingle: int, tables: Scratch) -> DataFrame:
    """Of nodes: node and the hashes of its whole shingle set. rows: doc_id and text; one row is read for each node."""
    nodes = nodes.select("node").distinct()
    need = tables.write(prints.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("need")).select("need").distinct(), "need")
    hint = "broadcast" if need.count() <= BROADCAST_IDS else "shuffle_hash"
    read = rows.join(need.hint(hint), F.expr("doc_id <=> need"), "left_semi").select("doc_id", "text")
    sets = read.mapInArrow(partial(_sets, shingle), "node long, hashes array<long>").join(nodes, "node", "left_semi")
    return tables.write(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")


def checked(doubtful: DataFrame, prints: DataFrame, rows: DataFrame, shingle: int, similar: float, tables: Scratch) -> DataFrame:
    """Of links a, b those whose texts' whole shingle sets have the similarity. rows: as for whole_sets()."""
    sets = whole_sets(doubtful.select(F.explode(F.array("a", "b")).alias("node")), prints, rows, shingle, tables)
    end = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"of_{name}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return doubtful.join(end("a"), "a").join(end("b"), "b").where(both / (F.size("of_a") + F.size("of_b") - both) >= similar).select("a", "b")


def _told(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows: group, node and more; groups: group and more, once each. Joined by salts, for a group may hold most nodes."""
    salt = F.pmod(F.xxhash64(F.lit(19), "node"), F.lit(SALTS)).cast("int").alias("salt")
    each = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.select("*", salt).join(each.hint("merge"), ["group", "salt"]).drop("salt")


def parted(may: DataFrame, of: DataFrame, tables: Scratch) -> DataFrame:
    """may and of: node and root as from components(). Of the components of `may` of several ones of `of`: group, node, root."""
    both = may.select("node", F.col("root").alias("group")).union(may.select("root", "root").distinct())
    both = both.join(of.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left").select("group", "node", F.coalesce("root", "node").alias("root"))
    both = tables.write(both, "may")
    several = both.groupBy("group").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    return tables.write(_told(both, several.select("group")), "parted")


def _borne_out(nodes: np.ndarray, f: np.ndarray, s: np.ndarray, roots: np.ndarray, side: np.ndarray, sets: list[np.ndarray], radius: int, similar: float) -> Found:
    """Links between roots, of nodes of one side and the other, that whole sets bear out: as many as join the same nodes."""
    out, tree = [], np.unique(roots, return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(np.r_[0, size])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    held, others = np.zeros(len(ids), bool), np.flatnonzero(~side)
    for i in np.flatnonzero(side):
        at = others[tree[others] != tree[i]]
        at = at[near(f[at] ^ f[i], radius)]
        at = at[similarity(s[at], s[i]) >= similar - MARGIN]
        own = ids[ends[i] : ends[i + 1]]
        held[own] = True
        both = np.array([np.count_nonzero(held[ids[ends[j] : ends[j + 1]]]) for j in at], np.int64)
        held[own] = False
        for j in at[both / (size[i] + size[at] - both) >= similar]:
            if tree[j] != tree[i]:
                out.append((nodes[i], nodes[j]))
                tree[tree == tree[j]] = tree[i]
    return out


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _bear_out(radius: int, similar: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: key, node, fp, bins, root, side, hashes. One group is held, of few times HELD hashes."""
    held: list[tuple] = []

    def out():
        _, node, fp, bins, root, side, sets = zip(*held, strict=True)
        s = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, BINS)
        found = _borne_out(np.array(node), np.array(fp).view(np.uint64), s, np.array(root), np.array(side), sets, radius, similar)
        return batch(_PAIRS, [a for a, _ in found], [b for _, b in found])

    for b in nonempty(batches):
        *columns, sets = b.columns
        at = sets.offsets.to_numpy()
        flat = sets.values.to_numpy()
        for i, row in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
            if held and held[0][0] != row[0]:
                yield out()
                held = []
            held.append((*row, flat[at[i] : at[i + 1]].copy()))
    if held:
        yield out()


def borne_out(left: DataFrame, prints: DataFrame, rows: DataFrame, shingle: int, radius: int, similar: float, tables: Scratch) -> DataFrame:
    """left: group, node, root, as from parted(). Links a, b between roots of a group whose whole shingle sets have the
    similarity, as many as join the same nodes. Nodes outside a group's largest root meet all others, in chunks of either."""
    known = prints.join(left.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("fp", "bins")).alias("one"))
    known = tables.write(whole_sets(left, prints, rows, shingle, tables).join(known, "node").select("node", "one.fp", "one.bins", "hashes"), "known")
    sized = left.join(known.select("node", F.size("hashes").alias("size")), "node").groupBy("group", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    of = sized.groupBy("group").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "root", "size")).alias("main"))
    chunks = lambda n, size: F.greatest(F.least(F.ceil(n / CHUNK), F.lit(CHUNKS)), F.ceil(size / HELD)).cast("int")
    n, size, main = (F.col(c) for c in ("n", "size", "main"))
    of = of.select("group", main["root"].alias("main"), chunks(n, size).alias("all"), chunks(n - main["n"], size - main["size"]).alias("few"))
    dealt_out = tables.write(_told(left, of), "dealt")
    chunk = lambda k: F.pmod(F.xxhash64(F.lit(23), "node"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias("other")
    one = dealt_out.where("root <> main").select("*", each("all")).select(F.xxhash64("group", chunk("few"), "other").alias("key"), "node", "root", F.lit(True).alias("side"))
    two = dealt_out.select("*", each("few")).select(F.xxhash64("group", "other", chunk("all")).alias("key"), "node", "root", F.lit(False).alias("side"))
    met = one.union(two).join(known, "node").select("key", "node", "fp", "bins", "root", "side", "hashes")
    return met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(partial(_bear_out, radius, similar), "a long, b long")


def joined(keyed: DataFrame, radius: int, similar: float, prints: DataFrame, rows: DataFrame, shingle: int, tables: Scratch) -> DataFrame:
    """node, root as from components() of all links of at least the similarity between candidates under one key: sure links
    and those of the doubtful that the forests hold and whole sets bear out; then, where doubtful links join several of
    the components so found, all that whole sets bear out between these."""
    pairs = lambda found: found.where(F.col("estimate") != OPEN).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("estimate").alias("estimate"))
    keys = lambda found: found.where(F.col("estimate") == OPEN).select(F.col("a").alias("key")).distinct()
    many = large(keyed, tables)
    asked = in_chunks(keyed, many) if (split := many.limit(1).count()) else keyed
    found = tables.write(links(asked, radius, similar), "estimated")
    sure = F.col("estimate") >= similar + MARGIN
    edges = found.where(sure).select("a", "b").union(checked(pairs(found).where(~sure).select("a", "b"), prints, rows, shingle, similar, tables))
    of, may = components(edges, tables), components(pairs(found), tables)

    def rooted(frame):
        root = may.withColumnRenamed("node", "_node")
        return frame.join(root, F.col("node") == F.col("_node"), "left").select("key", "node", "fp", "bins", F.coalesce("root", "node").alias("root"))

    def sought(frame, reach):
        new = tables.write(links(rooted(frame), radius, similar, reach), "further")
        return new, components(may.toDF("a", "b").union(pairs(new).select("a", "b")), tables)

    while True:
        reach = REACH
        while keys(found).limit(1).count():
            found, may = sought(asked.join(keys(found), "key", "left_semi"), (reach, FURTHER * reach))
            reach *= FURTHER
        if not split:
            break
        # large groups of one component are done; in others chunks meet, and links between components are sought
        roots = rooted(keyed.join(many.hint("broadcast"), "key", "left_semi")).groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
        many, split = tables.write(many.join(roots.where("least < most"), "key", "left_semi"), "large"), 0
        if many.limit(1).count():
            asked = in_pairs(keyed.join(many.hint("broadcast"), "key", "left_semi"), many)
            found, may = sought(asked, (0, REACH))
    left = parted(may, of, tables)
    if left.limit(1).count():
        of = components(of.toDF("a", "b").union(borne_out(left, prints, rows, shingle, radius, similar, tables)), tables)
    return of


def classes(prints: DataFrame, radius: int = 2, rows: DataFrame | None = None, shingle: int = 3, similar: float = SIMILAR, tables: Scratch | None = None) -> DataFrame:
    """prints: doc_id, fp and perhaps sketch, bins and node, as from fingerprints() of rows with the shingle. For each distinct
    fingerprint (with a sketch, each distinct shingle set, as `node`) its component_id, the smallest doc_id that links of up
    to radius bits reach. With a sketch, candidates meet under shared shingle hashes, and links need the similarity, too:
    equal fingerprints alone join nothing."""
    name, tables = "node" if "sketch" in prints.columns else "fp", tables or Scratch()
    least = prints.groupBy(name).agg(F.min("doc_id").alias("least"))
    if "sketch" in prints.columns:
        one = prints.groupBy("node").agg(F.min(F.struct("sketch", "bins", "fp")).alias("one"))
        keyed = one.select(F.explode("one.sketch").alias("key"), "node", F.col("one.fp").alias("fp"), F.col("one.bins").alias("bins"))
        found = joined(keyed, radius, similar, prints, rows, shingle, tables)
    elif ring(radius)[1]:
        edges = links(dealt(least.select("fp", F.explode(chain_keys(F.col("fp"), radius)).alias("key")).select("key", F.col("fp").alias("node"), "fp"), tables), radius)
        found = components(edges, tables)
    else:
        raise ValueError("a radius without equal chains needs a sketch")
    # the least id of each component goes to all of its nodes, by salts, for a component may hold most nodes
    rooted = found.union(found.select("root", "root").distinct())
    best = rooted.join(least, rooted["node"] == least[name]).groupBy("root").agg(F.min("least").alias("component_id"))
    salt = lambda key: F.pmod(F.xxhash64(F.lit(19), key), F.lit(SALTS)).cast("int").alias("salt")
    each = best.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    linked = rooted.select("node", "root", salt("node")).join(each.hint("merge"), ["root", "salt"]).select(F.col("node").alias("_node"), "component_id")
    return least.join(linked, least[name] == linked["_node"], "left").select(least[name], F.when(F.col("_node").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, sketch: int = 0, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row for each document: doc_id, fp and component_id, the smallest doc_id that links reach, its own included.

    A null, empty or blank text has fingerprint 0 and is linked like any other (with a sketch, only to others without a
    word). A very long text is hashed piece by piece. Repeated rows give repeated rows. doc_id
    names a document: rows that share one but have other texts keep their own fingerprints. A null doc_id stays null and
    counts for component_id only if its component has no other. Extra columns of docs play no part. An empty table gives
    an empty one.
    """
    prints, _ = written(fingerprints(docs, shingle, sketch, id_col, text_col, similar), "fingerprints")
    tables = Scratch()
    found, _ = written(classes(prints, radius, texts(docs, id_col, text_col), shingle, similar, tables), "classes")
    tables.clear()
    name = found.columns[0]
    return prints.select("doc_id", "fp", F.col(name).alias("_of")).join(found.withColumnRenamed(name, "_of"), "_of").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
