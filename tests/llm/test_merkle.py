"""The manifest against a plain version of its definition."""

import random
import zlib
from hashlib import sha256

import pytest

from kerbside.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, tree string"


def H(text):
    return sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, text):
    return H("".join(map(field, (row[0], row[3], row[2], row[4], text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(tree, i, altered):
    proof = ""
    for level in tree[:-1]:
        low = i // 16 * 16
        run = level[low : low + 16]
        before, after = "".join(run[: i - low]), "".join(run[i - low + 1 :])
        proof, altered, i = proof + before + after, H(before + altered + after), i // 16
    return proof, altered


def manifest(rows):
    by = {}
    for r in rows:
        text, low = r[1], r[1]
        if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            low = text.translate(LOWER)
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, text), leaf(r, low)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (known, doc_id, own, altered) in enumerate(sorted(by[s])):
            proof, h = climb(trees[s], i, altered)
            more, h = climb(top, k, h)
            root = top[-1][0]
            out.append((doc_id if known else None, own, trees[s][-1][0], root, H(proof + more), h, h == root))
    return sorted(out, key=str)


def rows(seed, sizes):
    rng = random.Random(seed)
    out = []
    for source, n in sizes:
        for _ in range(n):
            text = rng.choice([None, "", "Aé " * rng.randint(1, 9), "plain words", "UPPER"])
            out.append((rng.randrange(10_000), text, rng.choice([None, "en"]), source, rng.choice([None, 5]), 1, "x"))
    out += [(None, "No Id", None, None, None, 1, "x"), (None, "A", "de", "s1", 3, 1, "x"), out[0], out[0]]
    out.append((77, "Long " * 400_000, "en", "s1", 1, 1, "x"))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [[("s1", 600), (None, 17), ("é", 16), ("", 1)], [(f"s{i}", 2) for i in range(300)]])
def test_manifest_equals_its_definition(spark, sizes):
    data = rows(1, sizes)
    got = merkle.manifest(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == manifest(data)


def test_manifest_of_one_row_and_of_none(spark):
    one = [(5, None, None, None, None, 1, "x")]
    assert [tuple(r) for r in merkle.manifest(spark.createDataFrame(one, SCHEMA)).collect()] == manifest(one)
    none = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns[0] == "doc_id"


def test_log_is_in_the_order_of_completion(spark):
    """Positions by the closed form are the places of the nodes as one builder completes them."""
    for n in (1, 2, 16, 17, 255, 257, 4097, 5000):
        leaves = [sha256(str(i).encode()).digest() for i in range(n)]
        log = merkle.append_log(leaves, merkle.height(n))
        assert [log[merkle.position(0, i, n)] for i in range(n)] == leaves
        assert merkle.position(merkle.height(n), 0, n) == len(log) - 1
    data = [("a", i, i, 700) for i in range(700)] + [(None, i, i, 3) for i in range(3)]
    leaves = spark.createDataFrame(data, "tree string, rank long, doc_id long, n long").selectExpr(
        "*", "unhex(sha2(concat(coalesce(tree, ''), cast(rank as string)), 256)) as digest", "null as tampered"
    )
    got = merkle.log_entries(merkle.append_logs(leaves)).collect()
    for tree, n in (("a", 700), (None, 3)):
        own = [sha256(((tree or "") + str(i)).encode()).digest() for i in range(n)]
        log = merkle.append_log(own, merkle.height(n))
        mine = sorted((r for r in got if r.tree == tree), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(log)))
        assert [bytes(r.digest) for r in mine] == log
