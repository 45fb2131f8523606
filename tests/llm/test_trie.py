"""The prefix trie against a plain version of its definition."""

import random
import zlib
from hashlib import sha256

import pytest

from kerbside.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, weight int"


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        made[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for p, m in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        kids = [q for q in inside if len(q) == len(p) + 1]
        ends = ",".join(map(str, sorted(c for c, s in made.items() if s == p)))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in inside if q)
        leaves = sum(not any(len(x) > len(q) and x[: len(q)] == q for x in inside) for q in inside)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bé", "", "Hello there", None])
    first = [(k, rng.choice(["user", None, ""]), word()) for k in range(9)]
    rows = []
    for c in [*range(0, 40), *range(100, 125), 203, 277, 399, -3, -105]:
        if c == 110:
            continue
        kind = rng.random()
        turns = [(k, *first[k][1:]) for k in range(rng.randint(1, 9))]
        if kind < 0.4:
            turns += [(rng.choice([None, 4, 20, 20]), rng.choice(["user", "bot"]), word()) for _ in range(rng.randint(0, 6))]
        rows += [(c, *t, 1, "x", 2) for t in turns]
    rows += [(50, k, "user", f"text {k}", 1, "x", 2) for k in range(400)]
    rows += [(51, None, None, "long " * 100_000, 1, "x", 2), (None, 1, "user", "nobody", 1, "x", 2), rows[0], rows[0]]
    rows += [(c, k, "user", "same", 1, "x", 2) for c in range(1000, 1060) for k in range(7)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_its_definition(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = conversations(seed)
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_small_tries(spark):
    for rows in ([(7, None, None, None, 1, "x", 2)], [(None, 1, "a", "b", 1, "x", 2)], []):
        got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(map(tuple, got), key=str) == plain(rows)
