"""The trie of conversation prefixes: which conversations share their first turns, and what sharing them saves.

Every prefix has a polynomial rolling fingerprint, a running sum of turn values times powers of a base, made by numpy
scans along sorted turns. A scan runs on a range partitioning by conversation and turn, so a conversation of any length
is spread over tasks; what a partition hands on to the next (count and sums of its last conversation) is one row for each
partition, and is put to its rows afterwards. The same scan later gives running sums along conversations.

Prefixes with equal depth and fingerprint are candidates for one node. Each member is verified against the group's
representative (the smallest conversation), turn by turn: the last turn by its SHA-256, the turns before it by the node
that they lead to. Members that differ are split off with fingerprints of another base, until no member differs; then
members of a node have equal turns at each depth.

Numbers of a subtree are summed without walking the trie: each node belongs to one conversation, its smallest member, whose
nodes are the last stretch of its path; the sum over that path from a depth on counts for the node at that depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Scratch, batch, fold, nonempty

#: Conversations share the first turns with the one whose id is the next lower multiple of FAMILY, HEAD - 1 at most.
FAMILY, HEAD = 20, 4
PRIMES = (2147483647, 2147483629)
#: A node with more than one in HOT of all rows is looked up by broadcast: of such nodes there are HOT at most.
HOT = 4096
SPACE = r"[^\x20\x09-\x0D]+"
_NO_MODULUS = (1 << 62, 1 << 62)
KEY = ("depth", "drawn", "fp")


def bases(seed: int, primes: tuple[int, int]) -> tuple[int, int]:
    """Of a seed's fingerprints, from 2 to the prime less 1."""
    return tuple(int.from_bytes(hashlib.sha256(f"{seed}/{i}".encode()).digest()[:8], "big") % (p - 2) + 2 for i, p in enumerate(primes))


def _powers(base: int, modulus: int, exponents: np.ndarray) -> np.ndarray:
    if base == 1:
        return np.ones(len(exponents), np.int64)
    low = np.empty(4096, np.int64)
    low[0] = 1
    for have in 2 ** np.arange(12):
        low[have : 2 * have] = low[:have] * pow(base, int(have), modulus) % modulus
    blocks, at = np.unique(exponents >> 12, return_inverse=True)
    high = np.array([pow(base, int(b) << 12, modulus) for b in blocks], np.int64)
    return low[exponents & 4095] * high[at] % modulus


def _scan(by: tuple[int, int], modulo: tuple[int, int], schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id, with values v0 and v1: their rank in the conversation (within this partition), and the sums of
    value * base^rank before and up to the row."""
    part, last, count, sums = TaskContext.get().partitionId(), None, 0, [0, 0]
    for b in nonempty(batches):
        c = b.column("conv_id").to_numpy()
        n = len(c)
        start = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
        if c[0] != last:
            count, sums = 0, [0, 0]
        rank = np.arange(n) - start[of]
        rank[of == 0] += count
        columns = {"part": np.full(n, part, np.int32), "rank": rank}
        for i in (0, 1):
            term = b.column(f"v{i}").to_numpy() * _powers(by[i], modulo[i], rank) % modulo[i]
            total = np.cumsum(term)
            upto = total - (total - term)[start][of]
            upto[of == 0] += sums[i]
            upto %= modulo[i]
            columns |= {f"before{i}": (upto - term) % modulo[i], f"upto{i}": upto}
            sums[i] = int(upto[-1])
        last, count = c[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else b.column(f.name) for f in schema], schema=schema)


_KEPT = {"binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def running(rows: DataFrame, order: list[Column], keep: dict[str, str], by: tuple[int, int], modulo: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows: conv_id, v0, v1 and the columns to keep. For each row `rank` (from 0, in its conversation by order), and before0,
    upto0, before1, upto1: sums of v * by^rank. And the conversations that lie in several partitions, one for each of
    these at most."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("conv_id", "v0", "v1", *keep)
    made = {"part": "int", "conv_id": "bigint", "rank": "bigint", "before0": "bigint", "upto0": "bigint", "before1": "bigint", "upto1": "bigint"} | keep
    schema = pa.schema([(n, _KEPT[t]) for n, t in made.items()])
    local = scratch.write(ranged.mapInArrow(partial(_scan, by, modulo, schema), ", ".join(f"{n} {t}" for n, t in made.items())), "running")
    edge = F.max_by(F.struct("conv_id", "rank", "upto0", "upto1"), F.struct("conv_id", "rank"))
    edges = local.groupBy("part").agg(F.min("conv_id").alias("first"), edge.alias("last")).orderBy("part").collect()  # a row for each partition
    handed, conv, n, sums = [], None, 0, (0, 0)
    for e in edges:
        if e["first"] == conv:
            handed.append((e["part"], conv, n, *sums, *(pow(b, n, m) for b, m in zip(by, modulo, strict=True))))
        last = e["last"]
        if last["conv_id"] != conv:
            n, sums = 0, (0, 0)
        sums = tuple((s + pow(b, n, m) * last[f"upto{i}"]) % m for i, (s, b, m) in enumerate(zip(sums, by, modulo, strict=True)))
        conv, n = last["conv_id"], n + last["rank"] + 1
    carried = spark.createDataFrame(handed, "part int, conv_id bigint, n bigint, s0 bigint, s1 bigint, p0 bigint, p1 bigint")
    moved = lambda c, i: F.when(F.col("n").isNull(), F.col(c)).otherwise((F.col(f"s{i}") + F.col(f"p{i}") * F.col(c)) % F.lit(modulo[i])).alias(c)
    whole = local.join(F.broadcast(carried), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("rank") + F.coalesce("n", F.lit(0))).alias("rank"), *(moved(f"{c}{i}", i) for c in ("before", "upto") for i in (0, 1)), *keep)
    return whole, carried.select("conv_id").distinct()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn (null: the least), digest of role and text, words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(SPACE)).cast("long")
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), digest.alias("digest"), words.alias("words"), F.monotonically_increasing_id().alias("nth"))


def prefixes(turns: DataFrame, seed: int, primes: tuple[int, int], scratch: Scratch) -> DataFrame:
    """All prefixes of all rebuilt conversations: conv_id, depth, fp, parent_fp (of the prefix without the last turn), digest and
    words of the last turn, ends (the prefix is the whole conversation)."""
    by = bases(seed, primes)
    value = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "digest"), F.lit(primes[i])).alias(f"v{i}")
    rows = turns.select("*", value(0), value(1))
    whole, spread = running(rows, [F.col(c) for c in ("conv_id", "turn", "digest", "nth")], {"digest": "binary", "words": "bigint"}, by, primes, scratch)
    entry = F.struct("rank", F.col("upto0").alias("s0"), F.col("upto1").alias("s1"), "digest", "words")
    convs = scratch.write(whole.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("rank") < HEAD - 1, entry))).alias("first")), "conversations")
    family = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("of"), F.col("first").alias("head"))
    h = fold(F.col("conv_id"), HEAD).cast("int")
    found = convs.join(family, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("of"), "left").withColumn("h", h)
    found = found.withColumn("head", F.when(F.col("head").isNull(), F.slice("first", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h"))))
    sums = lambda list_, n, i: F.coalesce(F.get(list_, n - 1)[f"s{i}"], F.lit(0))
    k = F.size("head")
    starts = scratch.write(found.select(
        F.col("conv_id").alias("c"), "h", "head", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depths"),
        *(sums(F.col("head"), k, i).alias(f"head{i}") for i in (0, 1)), *(sums(F.col("first"), F.col("h"), i).alias(f"skipped{i}") for i in (0, 1)),
    ), "starts")
    packed = lambda s0, s1: F.shiftleft(s0, 31).bitwiseOR(s1)
    nothing = F.lit(0).cast("bigint")
    root = starts.select(F.col("c").alias("conv_id"), nothing.alias("depth"), nothing.alias("fp"), nothing.alias("parent_fp"), F.lit(b"").alias("digest"), nothing.alias("words"), (F.col("depths") == 0).alias("ends"))
    print_ = lambda e: packed(e["s0"], e["s1"])
    shared = starts.select("c", "depths", "head", F.posexplode("head").alias("at", "e"))
    above = F.when(F.col("at") > 0, print_(F.get("head", F.col("at") - 1))).otherwise(nothing)
    heads = shared.select("c", (F.col("at") + 1).cast("bigint"), print_(F.col("e")), above, "e.digest", "e.words", F.col("at") + 1 == F.col("depths"))
    # own turns move down by h - k places, and their sums start from the shared turns' in place of the skipped ones'
    down = [F.array(*(F.lit(pow(pow(b, -1, p), j, p)) for j in range(HEAD))) for b, p in zip(by, primes, strict=True)]
    shift = F.col("h") - F.col("k")
    at = lambda c, i: F.pmod(F.col(f"head{i}") + F.pmod(F.col(f"{c}{i}") - F.col(f"skipped{i}"), F.lit(primes[i])) * F.get(down[i], shift), F.lit(primes[i]))
    small = starts.drop("head")
    wide = small.join(F.broadcast(spread), F.col("c") == F.col("conv_id"), "left_semi")
    own = whole.join(F.broadcast(wide), F.col("conv_id") == F.col("c")).unionByName(
        whole.join(F.broadcast(spread), "conv_id", "left_anti").join(small, F.col("conv_id") == F.col("c")))
    depth = F.col("rank") - shift + 1
    kept = own.where("rank >= h").select("conv_id", depth, packed(at("upto", 0), at("upto", 1)), packed(at("before", 0), at("before", 1)), "digest", "words", depth == F.col("depths"))
    return scratch.write(root.union(heads).union(kept), "prefixes")


def looked_up(rows: DataFrame, table: DataFrame, keys: tuple[str, ...], hot: Column) -> DataFrame:
    """rows with their row of table. Those rows of it that are `hot` (HOT at most) are broadcast; so no key is shuffled
    that very many rows share."""
    few, rest = table.where(hot), table.where(~hot)
    cold = rows.join(F.broadcast(few.select(*keys)), list(keys), "left_anti")
    return rows.join(F.broadcast(few), list(keys)).unionByName(cold.join(rest, list(keys)))


def grouped(paths: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): nodes by depth, drawn (the round of their fingerprint) and fp, with their representative's turn and
    parent, n_convs and n_children; members: each prefix with its node's numbers, and whether it agrees."""
    first = F.min(F.struct("conv_id", "digest", "parent_drawn", "parent_fp", "words"))
    nodes = scratch.write(paths.groupBy(*KEY).agg(F.count("*").alias("n_convs"), first.alias("r")), "nodes")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("r.parent_drawn").alias("drawn"), F.col("r.parent_fp").alias("fp")).agg(F.count("*").alias("n_children"))
    nodes = scratch.write(nodes.join(below, list(KEY), "left").select(
        *KEY, "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("r.conv_id").alias("owner"), F.col("r.digest").alias("first_digest"),
        F.col("r.parent_drawn").alias("first_parent_drawn"), F.col("r.parent_fp").alias("first_parent_fp"),
    ), "nodes")
    members = looked_up(paths, nodes, KEY, F.col("n_convs") > F.lit(paths.count() / HOT))
    agrees = (F.col("digest") == F.col("first_digest")) & (F.col("parent_drawn") == F.col("first_parent_drawn")) & (F.col("parent_fp") == F.col("first_parent_fp"))
    own = F.col("conv_id") == F.col("owner")
    saved = F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(F.lit(0)).alias("v0")
    leaf = F.when(own & (F.col("n_children") == 0), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("v1")
    return nodes, scratch.write(members.select("conv_id", *KEY, saved, leaf, agrees.alias("agrees")), "members")


def verified(turns: DataFrame, primes: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, nodes, members) whose members agree with their representatives. A conversation that differs somewhere leaves its
    nodes from the first such depth on, and gets fingerprints of the next seed there."""
    start = F.lit(0)
    paths = prefixes(turns, 0, primes, scratch).withColumns({"drawn": start, "parent_drawn": start})
    seed = 0
    while True:
        nodes, members = grouped(paths, scratch)
        differ = scratch.write(members.where("NOT agrees").groupBy(F.col("conv_id").alias("c")).agg(F.min("depth").alias("since")), "differ")
        if not differ.limit(1).count():
            return paths, nodes, members
        seed += 1
        again = prefixes(turns, seed, PRIMES, scratch).join(differ, F.col("conv_id") == F.col("c")).where("depth >= since").drop("c")
        above = paths.select("conv_id", "depth", F.col("parent_drawn").alias("old_drawn"), F.col("parent_fp").alias("old_fp"))
        again = again.join(above, ["conv_id", "depth"]).withColumn("drawn", F.lit(seed))
        top = F.col("depth") == F.col("since")
        again = again.withColumns({"parent_drawn": F.when(top, F.col("old_drawn")).otherwise(F.lit(seed)), "parent_fp": F.when(top, F.col("old_fp")).otherwise(F.col("parent_fp"))})
        stay = paths.join(differ, F.col("conv_id") == F.col("c"), "left").where("since IS NULL OR depth < since")
        paths = scratch.write(stay.select(*paths.columns).unionByName(again.select(*paths.columns)), "paths")


_ENDS = pa.schema([("depth", pa.int64()), ("drawn", pa.int32()), ("fp", pa.int64()), ("ends_sha256", pa.string())])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's sorted ids, which are not held but hashed as they come."""
    key, digest = None, None
    for b in nonempty(batches):
        done = []
        keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in KEY])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            ids = ",".join(map(str, b.column("conv_id").slice(s, e - s).to_pylist()))
            if (here := tuple(keys[:, s].tolist())) == key:
                digest.update(f",{ids}".encode())
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = here, hashlib.sha256(ids.encode())
        if done:
            yield batch(_ENDS, *zip(*done, strict=True))
    if key is not None:
        yield batch(_ENDS, *zip((*key, digest.hexdigest()), strict=True))


def ends(paths: DataFrame) -> DataFrame:
    """Of nodes at which conversations end. SHA-256 runs over the ids one after another, so a node's ids go by one task, sorted
    by Spark and streamed: 20 bytes each, and none of them kept."""
    done = paths.where("ends").select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return done.mapInArrow(_ends, "depth bigint, drawn int, fp bigint, ends_sha256 string")


def trie(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """conversations: conv_id, turn, role, text. One row for each node of the trie of rebuilt conversations: conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by number, null first, then by a digest of role and text; repeated rows are turns of their own. Null roles and
    texts are empty. Rows without a conv_id belong to no conversation and play no part, nor do extra columns, whatever
    their names. Very long texts count whole. An empty table has no members and gives no node. primes: of the first
    fingerprints; small ones collide, which costs rounds but changes nothing.
    """
    scratch = Scratch()
    # texts are read once; what is scanned are digests
    turns = scratch.write(turns_of(conversations), "turns")
    paths, nodes, members = verified(turns, primes, scratch)
    by_path, _ = running(members.select("conv_id", *KEY, "v0", "v1"), [F.col("conv_id"), F.col("depth").desc()], {"depth": "bigint", "drawn": "int", "fp": "bigint"}, (1, 1), _NO_MODULUS, scratch)
    sums = by_path.groupBy(*KEY).agg(F.sum("upto0").alias("saved_tokens"), F.sum("upto1").alias("n_leaves"))
    owners = nodes.select(F.col("depth").alias("up_depth"), F.col("drawn").alias("up_drawn"), F.col("fp").alias("up_fp"), F.col("owner").alias("parent_conv_id"), "n_children")
    placed = nodes.withColumns({"up_depth": F.col("depth") - 1, "up_drawn": F.col("first_parent_drawn"), "up_fp": F.col("first_parent_fp")}).drop("n_children")
    up = looked_up(placed.where("depth > 0"), owners, ("up_depth", "up_drawn", "up_fp"), F.col("n_children") > F.lit(nodes.count() / HOT)).select(*KEY, "parent_conv_id")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(sums, list(KEY)).join(up, list(KEY), "left").join(ends(paths), list(KEY), "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
