"""Quality rules, decontamination, BPE, toxicity."""

import hashlib
import random
import string
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.llm import decontaminate, quality, queries, tokenizer, toxicity
from tests.compare import TABLES, same
from tests.llm.fixtures import ODD, odd_docs, texts

PATH, PATTERN = queries.tokenizer_files()


# Quality rules


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    assert same(spark, queries.queries()[name], queries.oracle_sql()[name]) > 0


def slow_measures(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def slow_kept(rows):
    """doc_id, text of the rows (doc_id, text, lang, source) that the quality rules keep: exact fences from the sketch's cells, by sorting."""
    cell = lambda v: v if v < 64 else v >> v.bit_length() - 6 << v.bit_length() - 6
    measured, sketch = [], {}
    for d, t, lang, source in rows:
        words, chars, _, dup, repeat = slow_measures(t)
        lines = len([x for x in (t or "").split("\n") if x.encode().split()])
        marks = sum(c in string.punctuation for c in t or "")
        one = lambda a, b: a * 1000 // max(b, 1)
        rates = {"punctuation": one(marks, chars), "dup_lines": one(dup, lines), "repeats": one(repeat, words), "long_words": one(chars, words), "short_words": one(chars, words)}
        base = words < 50 or 100 * repeat > 50 * words
        measured.append((d, t, lang, source, base, rates))
        for k, v in rates.items() if not base else ():
            for key in ((lang, source), (lang,), ()):
                sketch.setdefault((k, key), Counter())[cell(v)] += 1
    out = []
    for d, t, lang, source, base, rates in measured:
        ok = not base
        for k, v in rates.items() if ok else ():
            mixed = Counter({b: 1000 * n for b, n in sketch[k, (lang, source)].items()})
            for key, weight in (((lang,), 200_000), ((), 50_000)):
                whole = sketch[k, key]
                mixed.update({b: n * weight // sum(whole.values()) for b, n in whole.items()})
            p, q, factor = quality.RULES[k]

            def quantile(percent, mixed=mixed):
                upto = 0
                for b in sorted(mixed):
                    upto += mixed[b]
                    if 100 * upto >= percent * sum(mixed.values()):
                        return b

            x, y = quantile(p), quantile(q)
            far = max(factor * abs(x - y), 5 + x // 16)
            ok &= v >= x - far if k == "short_words" else v <= x + far
        if ok:
            out.append((d, t))
    return out


def test_measures(spark):
    rows = [(d, t) for d, t in ODD if len(t or "") < 9000] + [(20 + i, t) for i, t in enumerate(texts(5, 25))]
    rows += [(90, "a b c a b c"), (91, "a b c x a b c"), (92, "a a a"), (93, "a a a a"), (94, "#x $y <b>\nq\nq\n \nq"), (95, "\x85a b \x0b c")]
    got = quality.measured(odd_docs(spark, rows).withColumn("__text", F.col("text")).withColumn("i", -F.col("fp")).drop("n_words"))
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_measures(rows[r.i][1]), rows[r.i]


@pytest.mark.parametrize("value", [0, 1, 63, 64, 65, 127, 128, 129, 1000, 123_456_789])
def test_cells(spark, value):
    got = spark.range(1).select(quality.cell(F.lit(value).cast("long"))).first()[0]
    assert got <= value
    assert value - got <= value / 32
    assert value >= 64 or got == value


def test_thresholds_follow_the_source(spark):
    """A source that marks up its texts keeps them; the same markup stands out elsewhere."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = []
    for i in range(900):
        marked = i % 3 == 0 or i in (1, 2)
        rows.append((i, " ".join(word() + ("*" if marked and j % 3 == 0 else "") for j in range(60)), "en", "wiki" if i % 3 == 0 else "news"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    lost = {r.doc_id for r in docs.select("doc_id").exceptAll(quality.filtered(docs).select("doc_id")).collect()}
    assert lost == {1, 2}
    why = {r.doc_id: r.failed for r in quality.scored(docs).filter("NOT kept").collect()}
    assert set(why) == {1, 2}
    assert all(w[0] == "punctuation" for w in why.values())


def test_fences_of_the_real_table(spark):
    """They differ by language and source in every rule, clean texts stay and the marked-up ones go."""
    tables = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = quality.measured(docs.withColumn("__text", F.col("text"))).cache()
    fences = [r.fences for r in quality.thresholds(quality.sketches(rows)).collect()]
    assert len(fences) == 80
    values = {name: len({f[name] for f in fences}) for name in quality.RULES}
    assert min(values.values()) >= 5, values
    judged = quality.judged(rows).join(spark.read.parquet(f"{tables}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in judged.filter("NOT base_failed").groupBy("quality", "kept").count().collect()}
    rows.unpersist()
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = quality.scored(docs)
    assert got.count() == len(ODD)
    assert got.filter("n_words = 0 AND kept").count() == 0
    assert quality.filtered(docs).schema == docs.schema
    assert quality.scored(docs.limit(0)).count() == 0
    assert quality.filtered(docs.limit(0)).count() == 0


# Decontamination


def slow_hits(items, docs, n=13):
    windows = {}
    for i, t in items:
        w = decontaminate.words(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for t in docs:
        w, hit, found = decontaminate.words(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (got := windows.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    found |= got
        out.append((len(w), len(hit), found))
    return out


def parts(items, window=13, most=1 << 20):
    return decontaminate.TestSet([(k, i, at, raw) for k, (i, t) in enumerate(items) for at, raw in decontaminate.in_parts(decontaminate.folded(t), most, window)], window)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=20), max_size=5), st.lists(st.lists(st.sampled_from("abcz"), max_size=60), max_size=6), st.sampled_from([2, 3, 13]))
def test_hits_by_brute_force(items, docs, window):
    items = [(i, " ".join(t)) for i, t in enumerate(items)]
    docs = [" ".join(t) for t in docs]
    got = decontaminate.judged(iter([parts(items, window)]), docs)
    assert [(r["n_words"], sum(s["end"] - s["start"] for s in r["hit"]), set(r["items"])) for r in got] == slow_hits(items, docs, window)


def test_longest_match_and_place():
    item = " ".join(f"q{i}" for i in range(30))
    text = "x y " + " ".join(f"Q{i}," for i in range(5, 25)) + " z"
    [r] = decontaminate.judged(iter([parts([(7, item)])]), [text])
    assert r["matches"] == [{"item_id": 7, "item_word": 5, "doc_word": 2, "n_words": 20}]
    assert r["longest"] == 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=3), st.lists(st.lists(st.sampled_from("abcz"), max_size=60), max_size=4))
def test_long_items_in_parts(items, docs):
    """Items longer than a block give the matches of the whole items, in shards of any size."""
    items, docs = [(i, " ".join(t)) for i, t in enumerate(items)], [" ".join(t) for t in docs]
    whole = decontaminate.judged(iter([parts(items, 3)]), docs)
    plain = lambda rows: [(r["n_words"], r["hit"], sorted(r["items"]), r["longest"]) for r in rows]
    assert plain(decontaminate.judged(iter([parts(items, 3, 15)]), docs)) == plain(whole)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(numbers):
    found = decontaminate.suffix_array(np.array(numbers, np.uint64), 16)
    assert [numbers[i : i + 16] for i in found] == sorted(numbers[i : i + 16] for i in range(len(numbers)))


def test_items_that_share_an_id():
    """They are matched each for itself, and count once."""
    text = " ".join(f"q{i}" for i in range(26))
    [r] = decontaminate.judged(iter([parts([(7, text[: text.index(" q13")]), (7, text[text.index("q13") :])])]), [text])
    assert [m["n_words"] for m in r["matches"]] == [13, 13]
    assert r["items"] == [7]


def test_colliding_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate.Symbols, "split", lambda self, raw, real=decontaminate.Symbols.split: (np.ones(len((x := real(self, raw))[0]), np.uint64), *x[1:]))
    [r] = decontaminate.judged(iter([parts([(7, "a b c")], 2)]), ["x a b d"])
    assert r["matches"] in ([{"item_id": 7, "item_word": 0, "doc_word": 1, "n_words": 2}], [])


def test_op3_by_brute_force(spark):
    c = duckdb.connect()
    items, docs = (c.sql(f"SELECT {k}, text FROM '{TABLES}/{t}.parquet'").fetchall() for k, t in (("item_id", "benchmark"), ("doc_id", "documents")))
    expected = {}
    for (d, _), (n, h, found) in zip(docs, slow_hits(items, [t for _, t in docs]), strict=True):
        expected[d] = (n, h, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), h > 0 and 20 * h >= n)
    got = {r.doc_id: tuple(r)[1:6] for r in queries.op3_decontamination(spark, TABLES).collect()}
    assert got == expected
    assert any(x[-1] for x in expected.values())


def test_benchmark_in_blocks(spark):
    items = spark.createDataFrame([(i, f"{TEXT_} {i}") for i, TEXT_ in enumerate(texts(8, 12, words=5))], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts(9, 30, words=5))), "doc_id long, text string")
    key = lambda df: sorted((r.doc_id, r.n, sorted(r.items)) for r in df.select("doc_id", decontaminate.n_hit().alias("n"), "__hits.items").collect())
    assert key(decontaminate.searched(docs, items, 3)) == key(decontaminate.searched(docs, items, 3, block_bytes=200))


def test_decontamination_of_odd_rows(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the quick brown fox jumps over the lazy dog and then some other words"), (3, "fox"), (None, "lazy dog")], "item_id long, text string")
    got = decontaminate.decontaminated(docs, items)
    assert got.schema == docs.schema
    assert got.filter("text LIKE '%quick%'").count() == 0
    assert got.filter("text IS NULL").count() == 2
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == len(ODD)
    assert decontaminate.decontaminated(docs.limit(0), items).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def plain():
    ranks = tokenizer.load_ranks(PATH)
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return tokenizer.Codec(tokenizer.load_ranks(PATH), PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("ab \n\t'sé1½.  ", max_size=80), st.integers(1, 9))
def test_encoding_by_chunks(plain, codec, text, chunk):
    ids = plain.encode_ordinary(text)
    assert codec.encode(text, chunk, chunk) == ids
    assert codec.decode(ids) == text.encode()
    n, sha, raw = codec.digests(text)
    assert (n, sha) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert raw == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text", ["a" * 9000, " " * 9000, "\n" * 500 + "x", ("word " * 900 + "\n\n") * 3, "<|endoftext|> x"])
def test_long_runs(plain, codec, text):
    assert codec.encode(text, 700, 100) == plain.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\t'sé1½.,你  ", min_size=1, max_size=30), min_size=5, max_size=40), st.integers(20, 60))
def test_chunks_that_meet(codec, plain, texts_, chunk):
    """Whatever the cuts, the chunks' pre-tokens are those of the whole; mostly they meet within the overlap."""
    text = "".join(texts_)
    parts_ = list(tokenizer.stitched(codec.pattern, text, chunk, chunk - 1))
    assert [p for part in parts_ for p in part] == codec.pattern.findall(text)
    assert codec.encode(text, chunk, chunk - 1) == plain.encode_ordinary(text)


def test_chunks_meet():
    text = "some words, and 12 more! " * 200
    assert len(list(tokenizer.stitched(tokenizer.regex.compile(PATTERN), text, 200, 60))) == 25


def slow_bpe(ranks, raw):
    parts_ = [bytes([b]) for b in raw]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts_, parts_[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts_]
        _, i = min(found)
        parts_[i : i + 2] = [parts_[i] + parts_[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.text(min_size=1, max_size=30) | st.text("aehnrst", min_size=1, max_size=60))
def test_merging_by_brute_force(codec, text):
    expected = slow_bpe(codec.ranks, text.encode("utf-8", "surrogatepass"))
    assert codec.merge_long(text.encode("utf-8", "surrogatepass")) == expected
    assert codec.merge(text.encode("utf-8", "surrogatepass")) == expected


def test_op6_by_a_plain_encoder(spark, plain):
    docs = duckdb.connect().sql(f"SELECT doc_id, text FROM '{TABLES}/documents.parquet'").fetchall()
    expected = sorted((d, len(ids := plain.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs)
    assert sorted(map(tuple, queries.op6_byte_bpe(spark, TABLES).collect())) == expected


def test_texts_of_many_chunks(spark, plain):
    """Chunks of long texts as rows; a run without a boundary goes whole."""
    rows = [(1, "some words, and 12 more! " * 400), (2, "x" * 5_000), (3, None), (4, "short"), (5, "é 你好。 " * 900), (5, "é 你好。 " * 900), (6, "\n" * 900 + "a b c " * 300)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, k int")
    got = tokenizer.round_trip(docs, PATH, PATTERN, 500, 80)
    assert got.columns == ["doc_id", "text", "k", "__bpe"]
    found = sorted((r.doc_id, r["__bpe"].n_tokens, r["__bpe"].ids_sha256, r["__bpe"].decoded_sha256) for r in got.collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert found == sorted((d, len(ids := plain.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in rows)


def test_encoding_of_odd_rows(spark, plain):
    docs = odd_docs(spark)
    got = tokenizer.round_trip(docs, PATH, PATTERN)
    for r in got.collect():
        ids = plain.encode_ordinary(r.text or "")
        assert r["__bpe"].n_tokens == len(ids)
        assert r["__bpe"].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = docs.withColumn("ids", tokenizer.encoded(F.col("text"), PATH, PATTERN)).withColumn("raw", tokenizer.decoded(F.col("ids"), PATH, PATTERN))
    assert back.filter("decode(raw, 'utf-8') <> coalesce(text, '')").count() == 0
    assert tokenizer.round_trip(docs.limit(0), PATH, PATTERN).count() == 0


# Toxicity


def test_interactions_are_learnt():
    """Neither word alone is toxic, both together are: no sum of weights tells these apart."""
    rng = random.Random(2)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(toxicity.hashed(" ".join(["foe"] * a + ["kin"] * b + rng.choices([f"n{i}" for i in range(40)], k=6))))
        y.append(int(a and not b or b and not a))
    flat = np.concatenate([np.array(r) for r in rows])
    m = toxicity.fitted(flat, np.array([len(r) for r in rows]), np.array(y))
    s = m.scores([toxicity.hashed(t) for t in ("foe n1 n2", "kin n1 n2", "foe kin n1 n2", "n1 n2", "")])
    assert s[0] > 0.5
    assert s[1] > 0.5
    assert s[2] < 0.5
    assert s[3] < 0.5


def test_scores_by_brute_force():
    """The sum over all pairs, one by one."""
    rng = np.random.default_rng(4)
    row = np.zeros(toxicity.SLOTS, np.int64)
    row[:20] = np.arange(1, 21) * (np.arange(20) % 3 > 0)
    m = toxicity.Machine(0.3, row, np.r_[0, rng.normal(size=20)], np.r_[np.zeros((1, 8)), rng.normal(size=(20, 8))])
    rows = [[], [0], [1], [1, 2, 4, 5, 0], list(range(20))]

    def slow(features):
        used = [int(row[f]) for f in features if row[f]]
        z = m.bias + sum(m.weight[i] for i in used) + sum(float(m.factors[i] @ m.factors[j]) for k, i in enumerate(used) for j in used[:k])
        return 1 / (1 + np.exp(-z))

    assert np.allclose(m.scores(rows), [slow(r) for r in rows])


def test_sampled_features_are_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(10))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, 30, 100)
    sums = got.groupBy("toxic").agg(F.sum(F.size("features")).alias("n")).collect()
    assert all(0 < r.n <= 100 for r in sums)


def test_op1_held_out(spark):
    tables = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, tables)
    labels = spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", "toxic")
    r = got.filter("held_out").join(labels, "doc_id").agg(F.sum(F.expr("predicted * toxic")).alias("hit"), F.sum("predicted").alias("said"), F.sum("toxic").alias("are")).first()
    assert r.hit >= 0.9 * r.are
    assert r.hit >= 0.9 * r.said
    assert got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_held_out_rows_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, 30)
    assert got.count() == 60
    assert got.filter(toxicity.held_out(F.col("doc_id"))).count() == 0
    assert {r.doc_id for r in docs.filter(toxicity.held_out(F.col("doc_id"))).collect()} == {i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 4 == 2}


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (4, 0), (6, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.learnt(docs, labels))
    assert got.count() == len(ODD)
    assert got.filter("__score IS NULL").count() == 0
    none = toxicity.scored(docs, toxicity.learnt(docs, labels.limit(0)))
    assert none.agg(F.max("__score")).first()[0] < 1e-9
    assert toxicity.scored(docs.limit(0), toxicity.learnt(docs.limit(0), labels)).count() == 0
