"""The backoff model against a plain version of its definition."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from kerbside.llm import katz

SCHEMA = "doc_id long, text string, block int, train string, bucket long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(LOWER)).split(" ")
    return [w for w in words if w] + ["</s>"]


class Plain:
    def __init__(self, texts, order):
        self.order, self.counts, self.followers, self.d = order, [Counter() for _ in range(order + 1)], {}, {}
        for text in texts:
            t = ["<s>", *tokens(text)]
            for m in range(1, order + 1):
                for i in range(max(1, m - 1), len(t)):
                    self.counts[m][tuple(t[i - m + 1 : i + 1])] += 1
        for m in range(1, order + 1):
            n = Counter(self.counts[m].values())
            self.d[m] = [0.0, *katz.discounts([n[r] for r in range(1, katz.LOW + 2)])]
            for gram, c in self.counts[m].items():
                self.followers.setdefault(gram[:-1], {})[gram[-1]] = c

    def p(self, history, word):
        """None is the unknown word."""
        seen = self.followers.get(history)
        if history and not seen:
            return self.p(history[1:], word)
        seen = seen or {}
        d = self.d[len(history) + 1]
        saved = sum(r * (1 - d[r]) for r in seen.values() if r <= katz.LOW)
        total = sum(seen.values()) + (saved <= 0)
        if seen.get(word):
            return seen[word] * (d[seen[word]] if seen[word] <= katz.LOW else 1) / total
        saved = saved if saved > 0 else 1.0
        if not history:
            return saved / total
        rest = 1 - sum(self.p(history[1:], w) for w in seen)
        return saved / total / rest * self.p(history[1:], word)

    def score(self, text):
        t = ["<s>", *tokens(text)]
        known = lambda w: w if (w,) in self.counts[1] else None
        out = 0.0
        for i in range(1, len(t)):
            out += math.log10(self.p(tuple(t[max(0, i - self.order + 1) : i]) if self.order > 1 else (), known(t[i])))
        return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "Le", "LE"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    texts = [None, "", " \t\n", "only\x0bonce", "W1 w1 w1"]
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randint(1, 40))
        if rng.random() < 0.3:
            words.append(f"rare{rng.randrange(10**6)}")
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    texts += [texts[7]] * 5 + [" ".join(rng.choices(vocabulary, weights, k=3000))]
    return [(i, t, 1, "x", 2) for i, t in enumerate(texts)] + [(None, "w1 w2", 1, "x", 2), (7, texts[12], 1, "x", 2)]


@pytest.mark.parametrize("order,bytes_", [(1, 500), (2, 300), (3, 1 << 20), (4, 1000)])
def test_scores_equal_the_definition(spark, monkeypatch, order, bytes_):
    monkeypatch.setattr(katz, "BLOCK_BYTES", bytes_)
    rows = corpus(order)
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    model = Plain([t for i, t, *_ in rows if fold(i) != 2], order)
    got = katz.scores(spark.createDataFrame(rows, SCHEMA).repartition(3), order).collect()
    of = model.counts[1]
    n, v = sum(of.values()), len(of)
    want = []
    for i, text, *_ in rows:
        t = tokens(text)
        base = sum(math.log10((of[(w,)] + 1) / (n + v + 1)) for w in t)
        want.append((str(i), fold(i) == 2, len(t), sum(of[(w,)] > 0 for w in t), n, base, model.score(text)))
    got = sorted((str(r[0]), *r[1:]) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in sorted(want)], rtol=1e-9)


def test_model_is_normalised(spark):
    """Over all words and the unknown one, after every kind of context, from the stored tables."""
    rows = [r for r in corpus(9) if r[0] is not None]
    blocks = katz._blocks(spark.createDataFrame(rows, SCHEMA), 2, 7)
    reduced, known = katz.train(blocks, 2)
    words = {r.id: r.n for r in katz.table_rows(reduced[0]).collect()}
    pairs = katz.table_rows(reduced[1]).collect()
    numbers = np.array([katz.UNKNOWN, *words])
    counts = np.array([0, *words.values()])
    single = katz._words_from_counts(counts, known[0])
    assert math.isclose(single.sum(), 1)
    hot = {int(c): (t, s) for c, t, s in zip(known[1].split, known[1].totals, known[1].seen)}
    for context in {r.context for r in pairs}:
        mine = {r.follower: r for r in pairs if r.context == context}
        one = next(iter(mine.values()))
        totals, seen = hot.get(context, (np.array([one.tokens, *one.low]), one.seen))
        n = np.array([mine[w].n if w in mine else 0 for w in numbers.tolist()])
        size = len(n)
        p = katz.probabilities(n, single, np.tile(totals, (size, 1)), np.full(size, seen), known[1].discount)
        assert math.isclose(p.sum(), 1, rel_tol=1e-9) and (p > 0).all()


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert katz.scores(none).count() == 0
    held = [(i, "some words", 1, "x", 2) for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = katz.scores(spark.createDataFrame(held, SCHEMA)).collect()
    assert len(got) == len(held)
    assert all((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0, 0) for r in got)


def test_packed_integers():
    for values in ([], [0, 0], [1, 255, 256], [2**64 - 1, 0]):
        values = np.array(values, np.uint64)
        assert katz.unpack(katz.pack(values), len(values)).tolist() == values.tolist()
    assert katz.discounts([100, 40, 20, 12, 8, 6])[0] < 1
    assert katz.discounts([0, 1, 0, 0, 0, 0]).tolist() == [(r - 0.5) / r for r in range(1, 6)]
