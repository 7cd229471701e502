"""Operators 11 to 13 against plain versions, on odd rows and on rows that partitions cut."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from linkloom.llm import audit, fingerprints, prefix_trie
from linkloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# --- 11 ---


def plain_audit(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[i] == 1} for i in (1, 2))
    out = Counter()
    rows = []
    for d, t, source in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and d > first[t],
        }
        rows.append((source or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    for part, fails, is_good, is_toxic in rows:
        for order in permutations("ABCDE"):
            key = next((i for i, f in enumerate(order) if f in fails), 5)
            for step, f in enumerate(order):
                at = (part, "".join(order), step + 1)
                out[*at, "kept"] += step < key
                out[*at, "removed"] += step == key
                out[*at, "redundant"] += step > key and f in fails
                out[*at, "unique_fails"] += fails == {f}
                out[*at, "good_lost"] += step == key and is_good
                out[*at, "toxic_lost"] += step == key and is_toxic
                out[part, f] += step == key
    return [(p, o, s, *(out[p, o, s, c] for c in audit.OUTCOMES[:-1]), out[p, o[s - 1]]) for p in {r[0] for r in rows} for o in map("".join, permutations("ABCDE")) for s in range(1, 6)]


def test_audit_of_odd_rows(spark, odd_docs):
    labels = [(1, 1, 0), (2, None, 1), (2, 0, None), (3, 1, 1), (None, 1, 1), (4, 2, 3), (6, 1, 0), (6, 0, 0), (99, 1, 1)]
    frame = spark.createDataFrame([(*r, 1, "m") for r in labels], "doc_id long, quality int, toxic int, n int, mask string")
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    more = [(None, "no id here", "c"), (20, "no id here", None), (21, "no id here", "d"), (22, "# " + "x " * 80, "d"), (23, "# " + "x " * 80, "e"), (23, "# " + "x " * 80, "e")]
    both = odd_docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
    got = sorted(map(tuple, audit.interactions(both, frame).collect()))
    assert got == sorted(plain_audit(docs + more, labels)) and len(got) == 6 * 600


def test_audit_of_nothing(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(no_docs, labels).count() == 0


def test_outcomes_partition_each_mask():
    m = audit.matrices()
    steps = m["kept"].reshape(32, 120, 5), m["removed"].reshape(32, 120, 5)
    assert (steps[0][:, :, -1] + steps[1].sum(axis=2) == 1).all()  # kept in the end, or removed once
    assert (m["removed"] + m["redundant"] == (np.arange(32)[:, None] >> np.tile(["ABCDE".index(o[s - 1]) for o, s in audit.STEPS], (32, 1)) & 1)).all()


# --- 12 ---


def plain_signature(text, k=fingerprints.K, size=fingerprints.TUPLE, draws=fingerprints.DRAWS):
    """By definition, from the operator's numbers of k-mers and pairs alone; every pair is looked at for every draw."""
    mask = (1 << 64) - 1

    def mix(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & mask
        return x ^ (x >> 32)

    k = min(k, len(text))
    grams = []
    for i in range(len(text) - k + 1 if text else 0):
        x = 0
        for c in text[i : i + k]:
            x = (x * 0x9E3779B97F4A7C15 + ord(c)) & mask
        grams.append(mix((x + k) & mask))
    seen, pairs = Counter(), []
    for g in grams:
        pairs.append(mix((g + seen[g] * 0xA0761D6478BD642F) & mask) >> 32)
        seen[g] += 1
    out = []
    for a in fingerprints._orders(draws)[:, 0].tolist():
        chosen = sorted(sorted(range(len(pairs)), key=lambda i: (pairs[i] * a & 0xFFFFFFFF, i))[:size])
        x = len(chosen)
        for i in chosen:
            x = mix((x * 0x9E3779B97F4A7C15 + grams[i]) & mask)
        out.append(x >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "ab", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaaaa", "😀é" * 40, "the cat sat on the mat and the cat " * 70], ids=len)
@pytest.mark.parametrize(("k", "size"), [(8, 2), (5, 3), (1, 1)])
def test_signature_by_definition(text, k, size):
    assert fingerprints.signature(text, k, size, 16).tolist() == plain_signature(text, k, size, 16)


def plain_neighbours(docs):
    """docs in order. The rows that are due."""
    out = []
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        n = len(t) // 3
        new = t[: len(t) - n] + following[:n]
        a, b, c = (fingerprints.signature(x) for x in (t, new, following))
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), b.astype(">u4").tobytes().hex(), float((a == b).mean()), float((a == c).mean())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_neighbours_of_odd_rows(spark, odd_docs, partitions):
    """Ranges cut between any two rows, those of one id and copies included."""
    docs = odd_docs.unionByName(spark.createDataFrame([(7, "der zweite", 1), (7, "der dritte", 1), (None, None, 1)], "doc_id long, text string, n int"), allowMissingColumns=True)
    hashed = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()
    ordered = sorted(hashed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    got = sorted(map(tuple, fingerprints.fingerprints(docs, partitions).collect()), key=repr)
    assert got == plain_neighbours([(r["doc_id"], r["text"]) for r in ordered])


def test_lone_and_no_documents(spark, no_docs):
    assert fingerprints.fingerprints(no_docs).count() == 0
    (row,) = fingerprints.fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ordered = [(r["doc_id"], r["text"] or "") for r in docs.orderBy(docs["doc_id"].desc()).collect()]
    got = QUERIES["op12_order_minhash"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == plain_neighbours(ordered)
    long = [r for r in got if r["n_chars"] >= 200]
    assert np.mean([r["near_edited"] for r in long]) > 0.2 and np.mean([r["near_next"] for r in long]) < 0.05


def test_order_counts():
    """Blocks that change places keep the set of k-mers nearly, but not their order in tuples."""
    words = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    half = len(words) // 2
    swapped = fingerprints.likeness(fingerprints.signature(words), fingerprints.signature(words[half:] + words[:half]))
    assert 0.3 < swapped < 0.75 and fingerprints.likeness(fingerprints.signature(words), fingerprints.signature(words)) == 1.0


# --- 13 ---


def plain_trie(rows):
    """rows: conv_id, turn, role, text."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    nodes, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        worth = (len(members) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += worth
    listed = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], listed(p)) for p, m in nodes.items())


def odd_conversations():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"hello {c % 3} {t // 2 % 3}") for c in (*range(0, 45), -7, -20, -21, 1 << 40) for t in range(abs(c) % 6 + 1)]
    rows += [(3, None, "system", "first of all"), (3, None, None, None), (5, 0, "user", "tie a"), (5, 0, "user", "tie b"), (5, 0, "user", "tie b"), (None, 0, "user", "nobody's"), (60, 0, "", "")]
    return rows + [(40, t, "user", "go on" if t % 5 else "word " * 3000) for t in range(10, 150)]  # a long conversation, that partitions cut


@pytest.fixture(scope="module")
def odd_turns(spark):
    return spark.createDataFrame([(*r, 7, b"x", 1) for r in odd_conversations()], "conv_id long, turn long, role string, text string, depth int, digest binary, fp int").repartition(5)


@pytest.mark.parametrize("primes", [prefix_trie.PRIMES, (5, 3)], ids=["wide", "colliding"])
def test_trie_of_odd_rows(odd_turns, primes):
    assert sorted(map(tuple, prefix_trie.trie(odd_turns, primes).collect()), key=lambda r: r[:2]) == sorted(plain_trie(odd_conversations()), key=lambda r: r[:2])


def test_trie_where_partitions_cut(spark, odd_turns):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert sorted(map(tuple, prefix_trie.trie(odd_turns).collect()), key=lambda r: r[:2]) == sorted(plain_trie(odd_conversations()), key=lambda r: r[:2])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_trie_of_nothing(odd_turns):
    assert prefix_trie.trie(odd_turns.limit(0)).count() == 0
