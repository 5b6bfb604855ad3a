"""Operators 11 to 13 against brute force, and the identities that the joins and the packing rest on."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lattica.llm import decontam, jaccard, keyfilter, negatives, packing, queries, suffixes, text, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, whole string, key long"


def vectors(spark, rows, kinds=VECTORS):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], kinds).repartition(3)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12))
    rows = [(i, (centres[i % 4] + 0.7 * rng.normal(size=12)).astype(np.float32).tolist(), i % 4) for i in range(600)]
    rows += [(600 + i, rows[40 * i % 600][1], i % 3) for i in range(60)]  # copies under other labels
    return rows


# 11: hard negatives


def plain_negatives(rows, is_anchor, scale=256, positives=5, negatives_=10):
    kept = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(scale * float(np.float32(x)))) for x in v]
            kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a in [i for i in kept if is_anchor(i)]:
        order = sorted((-dot(kept[a][1], w), i) for i, (_, w) in kept.items() if i != a)
        for s, p in [(-s, i) for s, i in order if kept[i][0] == kept[a][0]][:positives]:
            found = [(-n, i) for n, i in order if kept[i][0] != kept[a][0] and 30 * s <= -100 * n <= 90 * s][:negatives_]
            out += [(a, p, k + 1, i, s, n) for k, (n, i) in enumerate(found)]
    return sorted(out)


def mined(df, step, **options):
    return sorted(map(tuple, negatives.mine_hard_negatives(df, F.col("vec_id") % step == 0, **options).collect()))


def test_negatives_equal_brute_force(spark, cloud):
    assert mined(vectors(spark, cloud), 10) == plain_negatives(cloud, lambda i: i % 10 == 0)


def test_groups_of_anchors_and_small_blocks_change_nothing(spark, cloud, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 17)
    assert mined(vectors(spark, cloud), 10, positives=3, negatives=4) == plain_negatives(cloud, lambda i: i % 10 == 0, positives=3, negatives_=4)


def test_negatives_of_odd_rows(spark, cloud):
    odd = cloud[:80] + [(None, cloud[0][1], 0), (900, None, 1), (910, [1.0, None], 1), (920, [float("nan")] * 12, 1), (930, [float("inf")] * 12, 1), (940, cloud[3][1], None), (950, [], 2), (960, [0.5], 2), (970, [0.25] * 15, 2), cloud[0], (10, cloud[1][1], 3), (10, cloud[1][1], 3)]
    assert mined(vectors(spark, odd), 10) == plain_negatives(odd, lambda i: i % 10 == 0)
    assert mined(vectors(spark, []), 10) == [] and mined(vectors(spark, cloud[1:9]), 10) == []
    with pytest.raises(ValueError):
        mined(vectors(spark, [(1, [1e9], 1)]), 10)


def test_planes_hold_the_components():
    whole = np.array([[-256, 255, 0, -1, 7] * 30, [3] * 150])
    planes = negatives.to_planes(whole, 9)
    assert planes.shape == (2, 9, 3) and (negatives.from_planes(planes)[:, :150] == whole).all()


def test_products_are_exact_at_any_density():
    rng = np.random.default_rng(1)
    whole = rng.integers(-300, 300, (40, 70))
    planes = negatives.to_planes(whole, 10)
    anchors, score = negatives.Anchors(planes), whole @ whole.T
    for low, high in ((-(1 << 60), 1 << 60), (np.sort(score[0])[-2], 1 << 60), (0, 5000)):
        n = np.arange(40)
        one, two, got = anchors.products(n, planes, np.ones((40, 40), bool), np.full(40, low), np.full(40, high))
        assert set(zip(one.tolist(), two.tolist(), got.tolist(), strict=True)) == {(i, j, int(score[i, j])) for i in range(40) for j in range(40) if low <= score[i, j] <= high}


# 12: long repeats


def plain_repeats(texts, match):
    count = Counter(t[i : i + match] for t in texts for i in range(len(t) - match + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - match + 1):
            if count[t[i : i + match]] > 1:
                gone[i : i + match] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def digests(df, **options):
    rows = suffixes.repeat_digest(df, **options)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("ab") for _ in range(300))
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(200))) for _ in range(30)] + [base[rnd.randrange(100) : rnd.randrange(100, 300)] for _ in range(30)]
    texts += ["a" * 90, "a" * 33, "ab" * 50, "", None, "x" * 31 + "y", texts[3], "é" * 40]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, lo int").repartition(3)
    want = dict(enumerate(plain_repeats([(t or "").encode() for t in texts], 32)))
    for window, batches in ((8, 3), (20, 1), (24, 6)):
        assert digests(df, match=32, window=window, batches=batches) == want


def test_repeats_of_whole_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = plain_repeats([(r.text or "").encode() for r in rows], 400)
    assert digests(queries.table(spark, sf, "documents")) == {r.doc_id: w for r, w in zip(rows, want, strict=True)}
    assert sum(w[1] for w in want) > 0


def test_repeats_without_a_filter_and_of_odd_tables(spark, monkeypatch):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(60_000))
    rows = [(None, "short"), (1, long), (1, long[500:1200]), (2, None), (2, ""), (3, "y" * 399), (3, "y" * 399)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(plain_repeats([(t or "").encode() for _, t in rows], 400))
    got = lambda: Counter(tuple(r)[1:] for r in suffixes.repeat_digest(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got() == want
    monkeypatch.setattr(keyfilter, "bits_for", lambda n: None)
    monkeypatch.setattr(suffixes, "FEW", 0)
    assert got() == want
    assert suffixes.repeat_digest(df.limit(0)).count() == 0


def test_levels_double(spark):
    family = suffixes.SuffixArrays()
    for turn in range(6):
        shared = family.add(spark.range(10 * turn, 10 * turn + 12).select(F.col("id").alias("head")))
        assert {r.head for r in shared.collect()} == (set() if turn == 0 else {10 * turn, 10 * turn + 1})
    assert [size for size, _ in family.levels] == [2, 0, 0]


def test_anchors_follow_the_repeat():
    rnd = random.Random(4)
    middle = bytes(rnd.randrange(97, 123) for _ in range(900))
    found = []
    for size in (0, 37, 211):
        data = np.frombuffer(bytes(rnd.randrange(97, 123) for _ in range(size)) + middle + b"end of it" * 9, np.uint8)
        place, first, last = suffixes.sparse_suffixes(data, np.array([0, len(data)]), 400, 100)
        assert (first[1:] == last[:-1] + 1).all() and first[0] == 0 and last[-1] == len(data) - 400
        at = np.repeat(place, last - first + 1) - np.arange(len(data) - 399)
        found.append(at[size : size + 501].tolist())
    assert found[0] == found[1] == found[2]


# 13: codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, np.floor(4096 * np.array(v, np.float32).astype(float)).astype(np.int64), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in kept), default=1)
    width = max(1, -(-dim // parts))
    kept = sorted(((i, np.pad(v, (0, parts * width - len(v))).reshape(parts, width), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1].reshape(-1).tolist()))
    data = np.array([v for _, v, _ in kept])
    books = data[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        far = ((data[:, :, None] - books[None]) ** 2).sum(-1)
        code = far.argmin(-1)
        for p in range(parts) if turn < rounds else ():
            for e in range(books.shape[1]):
                own = data[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    error = far.min(-1).sum(-1)
    by = Counter()
    for (_, _, label), x in zip(kept, error.tolist(), strict=True):
        by[label] += x
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return Counter((i, "".join(f"{c:02x}" for c in row), int(x), by[label], sha) for (i, _, label), row, x in zip(kept, code.tolist(), error, strict=True))


def coded(df, **options):
    return Counter(map(tuple, vector_codes.encode_vectors(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def test_codes_equal_plain_rounds(spark, cloud, monkeypatch):
    rows = [(i, v, None if i % 5 == 0 else label) for i, v, label in cloud]
    assert coded(vectors(spark, rows)) == plain_codes(rows)
    monkeypatch.setattr("lattica.llm.vectors.FEW_GROUPS", 0)
    assert coded(vectors(spark, rows), rounds=2) == plain_codes(rows, rounds=2)


def test_codes_of_odd_rows(spark, cloud):
    odd = cloud[:20] + [(None, cloud[0][1], 0), (900, None, 1), (910, [1.0, None], 1), (920, [float("nan")] * 12, 1), (930, [], 2), (940, [0.5], 2), (950, [0.25] * 17, None), cloud[0], cloud[0]]
    assert coded(vectors(spark, odd)) == plain_codes(odd)
    assert coded(vectors(spark, cloud[:3])) == plain_codes(cloud[:3])
    assert coded(vectors(spark, [])) == Counter()


def test_exponion_from_any_start():
    rng = np.random.default_rng(3)
    book = rng.integers(-5, 6, (16, 3))  # with ties and equal entries
    parts = rng.integers(-6, 7, (500, 3))
    far = ((parts[:, None] - book[None]) ** 2).sum(-1)
    for start in (np.zeros(500, int), rng.integers(0, 16, 500)):
        best, d2 = vector_codes.exponion(parts, start, book)
        assert (best == far.argmin(1)).all() and (d2 == far.min(1)).all()


# identities


def unkeyed_partner(head: bytes, other: bytes) -> bytes:
    """Sixteen bytes that begin with ``other`` and, without a key, share their hash with ``head``."""
    u = text.U64
    size = u(16) * u(0x9E3779B97F4A7C15)
    lanes = np.frombuffer(head + other, u)
    one, two = text.mix(np.array([lanes[0]]) ^ size), text.mix(np.array([lanes[2]]) ^ size)
    return other + (lanes[1] + (one - two) * u(0x9E3779B97F4A7C15)).tobytes()


def test_solved_collisions_stay_apart(spark):
    rnd = np.random.default_rng(2)
    apart, both = 0, []
    hashed = lambda words, key: text.Words(np.frombuffer(b"".join(words), np.uint8), 16 * np.arange(len(words) + 1), lower=False, words="all", key=key).hash
    one = [bytes(rnd.integers(128, 256, 16, np.uint8)) for _ in range(1000)]
    two = [unkeyed_partner(w, bytes(rnd.integers(128, 256, 8, np.uint8))) for w in one]
    same = [(a, b) for a, b in zip(one, two, strict=True) if min(b) > 127]  # one run of one class
    assert len(same) >= 1
    for a, b in same:
        plain, keyed = hashed([a, b], None), hashed([a, b], text.new_key())
        both.append(plain[0] == plain[1])
        apart += keyed[0] != keyed[1]
    assert all(both) and apart == len(same)
    solved = spark.createDataFrame([(1, "abcdefghijklmnop"), (2, "hwgaknhlg]2(z3^y"), (3, "x y z x y z x"), (4, "x y z x y z x y z x"), (5, "q q q q q"), (6, "q q q q q q q")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(solved).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (3, 3), 4: (3, 3), 5: (1, 5), 6: (1, 5)}
    item = spark.createDataFrame([(7, "abcdefghijklmnop")], "item_id long, text string")
    assert [r.doc_id for r in decontam.contaminated(solved, item).collect()] == [1]


def test_a_shared_set_key_starts_the_run_anew(spark, monkeypatch):
    made = []

    def key():
        made.append(text.secrets.token_bytes(16))
        return made[-1]

    checks = iter([True, False])
    monkeypatch.setattr(jaccard, "new_key", key)
    real = jaccard._summarise

    def first_clashes(shingles):
        if next(checks):
            shingles.check = lambda own, lone, count=iter(range(1 << 30)): next(count)
        return real(shingles)

    monkeypatch.setattr(jaccard, "_summarise", first_clashes)
    docs = spark.createDataFrame([(i, "one two three four five six") for i in (1, 2)], "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in jaccard.jaccard_components(docs).collect()} == {1} and len(made) == 2


def test_packing_does_not_depend_on_the_order_of_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionAll(docs.limit(20)).unionAll(docs.filter("doc_id = 3")).withColumn("text", F.when(F.col("doc_id") % 3 == 0, "the same text over and over").otherwise(F.col("text")))
    path = public_tokenizers.path("word_bpe_49k.json")
    runs = [sorted(map(tuple, packing.pack_documents(d, path, 2, shard_tokens=1 << 14).collect())) for d in (docs, docs.orderBy(F.rand(1)).repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(1))]
    assert runs[0] == runs[1] == runs[2] and len({r[5] >> 32 for r in runs[0]}) > 3
