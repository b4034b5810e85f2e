"""The trie of rebuilt conversations against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from weft.llm import conversation_trie as trie

KIND = "conv_id long, turn int, role string, text string, c long, depth int"


def brute(rows):
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in given.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - np.fmod(c, 20))
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[b] for b in below) or 1
        saved[path] = sum(saved[b] for b in below) + ((len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0)
        ends = sorted(c for c in members[path] if built[c] == path)
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(below), leaves[path], saved[path], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, shard=trie.SHARD):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND)
    out = trie.prefix_trie(df, shard)
    assert out.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == brute(rows)
    return got


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    said = ["hello there", "", None, "a b\tc", " two  words ", "x y"]
    out = []
    for c in [*range(-25, 130), 4000]:
        # Copies, prefixes of one another, shared heads, null and repeated turns.
        seed = random.Random(c % 7)
        texts = [seed.choice(said) for _ in range(8)]
        for k in range(rng.randrange(1, 8)):
            out.append((c, rng.choice([k, k, k, None]), "user" if k % 2 else None, texts[k]))
    out += [(None, 1, "user", "nobody"), (7, 2, "user", "twice"), (7, 2, "user", "twice")]
    out += [(c, k, "user", f"long {k}") for c in (200, 201, 202) for k in range(300)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shard", [trie.SHARD, 3])
def test_equals_brute_force(spark, rows, shard):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = check(spark, rows, shard)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r[3] for r in got if r[1] == 0 and r[2] is None] == [len({c for c, *_ in rows if c is not None})]


def test_copies_and_empty_tables(spark):
    check(spark, [(c, k, "u", f"t {k}") for c in range(100, 340) for k in range(4)])
    assert trie.prefix_trie(spark.createDataFrame([], KIND)).collect() == []
    # A conversation that loses all its turns is a member of the root alone.
    check(spark, [(next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 3), 1, "u", "gone")])


@pytest.mark.parametrize("seed", range(4))
def test_findclose_equals_a_stack(seed):
    rng, bits, depth = random.Random(seed), [], 0
    while len(bits) < 3000:
        up = depth == 0 or rng.random() < (0.5 if seed < 2 else 0.7)
        bits.append(up)
        depth += 1 if up else -1
    bits += [False] * depth
    want, stack = {}, []
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    tree = trie.Parentheses(np.array(bits))
    assert {i: tree.findclose(i) for i in want} == want
