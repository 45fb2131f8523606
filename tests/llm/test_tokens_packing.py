"""Token ids, token files, packing and sharding: exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kerbside.llm import packing, sharding, token_files, tokens
from kerbside.llm.tokens import Encoder, tokenizer_path

ODD = [
    "", " ", "a", " a", "a ", "a  b", "a\n\nb", "a\tb c", "x y z", "I'm here's  \n  <|endoftext|> a", "\n", "a\n b",
    "é ́x ΣΑΣ Σ", "a\x1cb c", "it's 12 345, we'll\r\nok", None, "...", "a.. b", "!!, x", "\x01, a", "«a», b", "a_, b", "é, ",
    ".5, 6.", "don't. we'll, x", "A\nB", "\nA", "x" * 20_000, " a b", "a ’s b",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_whole(name):
    own = Encoder(tokenizer_path(name))
    rng = random.Random(1)
    some = ["the", "The,", "of.", "éa", "a", "x1", "12", "!!", "b.", "—", "ok,"]
    texts = ODD + ["".join(rng.choice(some) + rng.choice([" ", " ", "\n", "  "]) for _ in range(30)).strip() for _ in range(60)]
    for _ in range(2):  # pieces that are known, and not
        for text, ids in zip(texts, own.batch(pa.array(texts, pa.string()))):
            assert ids.tolist() == own.whole(text or "").tolist(), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_few_pieces_are_encoded_and_kept_at_once(name, monkeypatch):
    own = Encoder(tokenizer_path(name))
    plain, most = own._tokenizer, []

    class Counted:
        def encode(self, pieces, **options):
            most.append(len(pieces))
            return plain.encode(pieces, **options)

    texts = [" ".join(f"w{i}x{j}" for j in range(20_000)) for i in range(3)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    own._tokenizer = Counted()
    monkeypatch.setattr(tokens, "KEPT", 30_000)
    for _ in range(2):
        assert [ids.tolist() for ids in own.batch(pa.array(texts))] == want
    assert max(most) <= 1 << 12 and len(own._keys) <= 30_000


def test_token_files_round_trip(spark, tmp_path):
    texts = [t for t in ODD if t is None or len(t) < 5000] * 3
    rows = [(7 * i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(5)
    path = tokenizer_path("byte_bpe_50k.json")
    own = Encoder(path)
    token_files.write_tokens(docs, str(tmp_path / "t"), path, 2)
    back = {r.doc_id: r for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect()}
    start = 0
    for doc, text, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        want = [*own.whole(text or "").tolist(), 2]
        r = back[doc]
        assert (r.start, r.n_tokens, r.ids) == (start, len(want), want)
        start += len(want)
    for r in token_files.token_digest(docs, path, 2).collect():
        ids = np.array(back[r.doc_id].ids, "<u4")
        assert (r.start, r.ids_crc32) == (back[r.doc_id].start, zlib.crc32(ids))
    assert token_files.token_digest(docs.limit(0), path, 2).count() == 0


def test_token_files_have_page_indexes_and_encodings(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('word ', id) as text")
    token_files.write_tokens(docs, str(tmp_path / "t"), tokenizer_path("byte_bpe_50k.json"), 2)
    for f in glob.glob(str(tmp_path / "t" / "*.parquet")):
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert all(c.has_column_index and c.has_offset_index for c in columns.values() if "ids" not in c.path_in_schema)
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
        assert any("DELTA" in e for e in columns["doc_id"].encodings)
    plan = token_files.read_tokens(spark, str(tmp_path / "t"), ["doc_id", "n_tokens"])._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("seed", range(4))
def test_place_is_whole_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 97, 4096])
    counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.choice([1, 5, 60]))}
    used, seen = {}, {}
    for run in packing.place(counts, capacity):
        assert run.rank == seen.get(run.length, 0)
        seen[run.length] = run.rank + run.sequences * run.each
        for s in range(run.first, run.first + run.sequences):
            used.setdefault(s, []).extend((run.offset + i * run.length, run.length) for i in range(run.each))
    assert seen == counts
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    total = sum(n * c for n, c in counts.items())
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == max(used) + 1 <= max(large, 1.25 * total / capacity) + 3


def test_pack(spark):
    rng = random.Random(3)
    texts = [" ".join(["cat"] * rng.choice([0, 1, 5, 30, 31, 64, 200])) for _ in range(200)] + [None, ""]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(None, "dog", "x", 5), (5, texts[5], "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, length int").repartition(6)
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.pack(docs, path, 1, capacity=64).collect()
    own = Encoder(path)
    want = []
    for doc, text, *_ in rows:
        ids = np.array([*own.whole(text or "").tolist(), 1], "<u4")
        for i, a in enumerate(range(0, len(ids), 64)):
            want.append((-1 if doc is None else doc, i, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.limit(0), path, 1).count() == 0


def test_shards_fit(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 60), "hot" if i % 3 else str(i)) for i in range(400)] + [(None, None, None), (900, "z" * 3000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for key, limit in (("doc_id", 500), ("source", 900), ("doc_id", 10**9)):
        got = sharding.assign(docs, key, limit).collect()
        assert len(got) == len(rows)
        sums = {}
        for r in got:
            sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
        assert all(r.shard_bytes == sums[r.shard] and len(r.shard) == r.depth for r in got)
        assert {r.doc_id for r in got if r.over_limit} == ({900} if limit < 3000 else set())
        names = sorted(sums)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # a prefix code
        parents = {}
        for s, n in sums.items():
            for d in range(len(s)):
                parents[s[:d]] = parents.get(s[:d], 0) + n
        assert all(n > limit for n in parents.values())  # only oversized buckets were split
    sharding.write_shards(docs, str(tmp_path / "s"), "source", 900)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
    assert sharding.assign(docs.limit(0)).count() == 0
