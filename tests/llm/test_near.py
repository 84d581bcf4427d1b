"""Near copies of the pipeline, by all pairs."""

import random

import corpus_pipeline
from palisade.llm import near, simhash
from tests.compare import TABLES
from tests.llm.fixtures import ODD, odd_docs


def slow_roots(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            x, y = sets[j], sets[i]
            if 10 * len(x & y) >= 8 * len(x | y) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited():
    """Texts with copies of copies in which a few words differ."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3_000)]
    rows = []
    for _ in range(12):
        w = rng.choices(vocabulary, k=rng.choice([8, 60, 200, 400]))
        for _ in range(10):
            rows.append(" ".join(w))
            w = list(w)
            for _ in range(rng.randrange(len(w) // 30 + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
    rng.shuffle(rows)
    return [*enumerate(rows), (900, None), (901, " "), (902, "")]


def test_near_copies_by_all_pairs(spark):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near.deduplicated(docs).collect()) == [rows[i][0] for i, r in enumerate(slow_roots([t for _, t in rows])) if i == r]


def test_the_stage_finds_what_fingerprints_miss(spark):
    base = [f"word{i}" for i in range(300)]
    other = [f"new{i}" if i in (40, 90, 140, 190, 240) else w for i, w in enumerate(base)]
    far = [f"new{i}" if i % 20 == 0 else w for i, w in enumerate(base)]
    a, b = " ".join(base), " ".join(other)
    assert (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3
    docs = spark.createDataFrame([(1, a), (2, b), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, TABLES).collect()) == [1, 3]


def test_texts_not_like_the_smallest_of_their_bucket(spark):
    """A bucket of three, of which the second and third are near copies but not of the first."""
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "xy"] + [" ".join(f"y{i}" for i in range(59))]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    members = spark.createDataFrame([(i, 0, 0, 0) for i in range(3)], "rid long, t int, key long, least long")
    rows = rows.withColumn("sketch", near.signed(rows.text).sketch)
    assert [tuple(r) for r in near.links(members, rows).collect()] == [(2, 1)]


def test_near_copies_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = near.deduplicated(docs)
    assert got.schema == docs.schema
    ids = [d for d, _ in ODD]
    kept = got.collect()
    assert {r.doc_id for r in kept} <= set(ids)
    assert len([r for r in kept if not (r.text or "").split()]) == 1
    assert near.deduplicated(docs.limit(0)).count() == 0


def test_sketches_of_near_copies_are_close():
    """All pairs of similarity 0.8 or more among edited texts are within the radius; others mostly aren't."""
    rows = [t for _, t in edited() if t and t.strip()]
    sets = [near.shingles(near.words(t)) for t in rows]
    sketches = [int.from_bytes(near.sketch(near.hashes(near.words(t))), "big") for t in rows]
    far = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                assert (sketches[i] ^ sketches[j]).bit_count() <= near.RADIUS
            elif not both:
                far.append((sketches[i] ^ sketches[j]).bit_count() > near.RADIUS)
    assert sum(far) > 0.99 * len(far)


def test_buckets_in_parts(spark):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near.deduplicated(docs, split=2).collect()) == [rows[i][0] for i, r in enumerate(slow_roots([t for _, t in rows])) if i == r]


def test_near_copies_of_the_real_table(spark):
    """Of all pairs of similarity 0.8 or more in the table, every one is connected."""
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").dropDuplicates(["doc_id"])
    rows = sorted(map(tuple, docs.collect()))
    assert sorted(r.doc_id for r in near.deduplicated(docs).collect()) == [rows[i][0] for i, r in enumerate(slow_roots([t for _, t in rows])) if i == r]
