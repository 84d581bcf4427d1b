"""Line chunks, SimHash, repeated substrings by words and bytes."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisade.llm import line_dedup, queries, relative_lz, repeats, simhash, suffix_dedup, suffixes
from tests.compare import TABLES
from tests.llm.fixtures import ODD, odd_docs, texts


def documents():
    return duckdb.connect().sql(f"SELECT doc_id, text FROM '{TABLES}/documents.parquet'").fetchall()


# Line chunks


def slow_eligible(raw):
    """Chunks of two lines or more that aren't blank, by the definition: a boundary after a line whose hash (times nothing, as the window is one line) has bit 32 unset."""
    lines = raw.split(b"\n")
    full = [i for i, x in enumerate(lines) if x.split()]
    cuts, n = [0], 0
    for k, i in enumerate(full[:-1]):
        n += 1
        if n >= 2 and not xxhash.xxh64_intdigest(lines[i]) >> 32 & 1:
            cuts.append(full[k + 1])
            n = 0
    found = [(a, b - a, lines[a:b]) for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True)]
    return [(a, n, b"\n".join(ls)) for a, n, ls in found if sum(bool(x.split()) for x in ls) > 1]


def slow_lines(docs):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = set()
        for a, n, c in slow_eligible(raw):
            if c in seen:
                gone.update(range(a, a + n))
            seen.add(c)
        lines = raw.split(b"\n")
        out.append((d, len(lines), len(gone), hashlib.sha256(b"\n".join(x for i, x in enumerate(lines) if i not in gone)).hexdigest()))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d", "", " ", "e"]), max_size=30))
def test_chunks_by_the_definition(lines):
    raw = "\n".join(lines).encode()
    assert line_dedup.eligible(raw) == slow_eligible(raw)


def test_op4_by_brute_force(spark):
    expected = sorted(slow_lines(documents()))
    assert sorted(map(tuple, queries.op4_line_chunks(spark, TABLES).collect())) == expected
    assert sum(x[2] for x in expected) > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), min_size=1, max_size=60), st.lists(st.sampled_from("xyz"), max_size=5))
def test_chunks_resist_shifts(lines, more):
    whole = line_dedup.chunks("\n".join(lines).encode())
    assert [a for a, _ in whole] == [0, *np.cumsum([n for _, n in whole])[:-1]]
    assert sum(n for _, n in whole) == len(lines)
    moved = line_dedup.chunks("\n".join(more + lines).encode())
    # once both have a common boundary beyond the lines that the hash rolls over, all later ones are common
    ends = [a + n for a, n in whole]
    others = [a + n - len(more) for a, n in moved]
    common = [e for e in ends if e in others and e > line_dedup.ROLL]
    if common:
        assert [e for e in ends if e >= common[0]] == [e for e in others if e >= common[0]]


def test_lines_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = line_dedup.deduplicated(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    assert got.count() == len(ODD)
    assert got.filter("text IS NULL").count() == 2
    assert got.filter("n_chars <> length(text)").count() == 0
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
    run = "\n".join(f"line {i}" for i in range(40))
    two = line_dedup.deduplicated(spark.createDataFrame([(2, run), (1, run), (1, run)], "doc_id long, text string"))
    assert sorted((r.doc_id, len(r.text)) for r in two.collect())[:2] == [(1, len(run))] * 2
    assert min(len(r.text) for r in two.collect()) < 20


# SimHash


def slow_fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b c", "É é A", "x y z " * 300, *(t for _, t in ODD[:1])])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def slow_components(fp, radius):
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fp))]


def test_op5_by_brute_force(spark):
    docs = documents()
    fp = [slow_fingerprint(t) for _, t in docs]
    root = slow_components(fp, 3)
    least = {}
    for (d, _), r in zip(docs, root, strict=True):
        least[r] = min(least.get(r, d), d)
    expected = sorted((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(docs, fp, root, strict=True))
    assert sorted(map(tuple, queries.op5_simhash(spark, TABLES).collect())) == expected


@pytest.mark.parametrize(("radius", "split"), [(3, 2048), (3, 8), (1, 4), (6, 16)])
def test_links_in_clusters(spark, radius, split):
    """Crowded buckets, parted or not: the same components as by comparing all."""
    rng = np.random.default_rng(radius * 10 + split)
    fp = rng.integers(0, 1 << 62, 6)[rng.integers(0, 6, 260)]
    for _ in range(radius):
        fp = fp ^ (1 << rng.integers(0, 62, 260))
    fp = sorted({int(x) for x in fp})
    edges = simhash.links(spark.createDataFrame([(x,) for x in fp], "fp long"), radius, split)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    expected = slow_components(fp, radius)
    assert [found.get(x, x) for x in fp] == [fp[i] for i in expected]


def test_components_of_a_long_chain(spark):
    got = simhash.components(spark.createDataFrame([(i, i + 1) for i in range(-40, 60)] + [(100, 102), (5, 5)], "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == {(i, -40) for i in range(-39, 61)} | {(102, 100)}


def test_near_copies_go(spark):
    base = " ".join(f"word{i % 97}{i}" for i in range(900))
    near = base.replace("word11 ", "changed ")
    docs = spark.createDataFrame([(5, base, 1), (3, near, 2), (9, "something else entirely", 3), (None, base, 4)], "doc_id long, text string, fp int")
    assert sorted(map(tuple, simhash.deduplicated(docs).collect()), key=repr) == [(3, near, 2), (9, "something else entirely", 3)]


def test_simhash_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = simhash.deduplicated(docs)
    assert got.schema == docs.schema
    kept = [r.text for r in got.collect()]
    assert len([t for t in kept if not (t or "").split()]) == 1
    assert len([t for t in kept if t and "quick" in t.lower() and "\n" not in t]) == 1
    assert simhash.deduplicated(docs.limit(0)).count() == 0


# Repeated substrings


def slow_words(docs, window):
    ws = [(t or "").encode().split() for _, t in docs]
    count = Counter(tuple(w[i : i + window]) for w in ws for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, ws, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def slow_bytes(docs, window):
    """docs in order; equal (doc_id, text) count once."""
    seen, out, before = {}, [], None
    for d, t in docs:
        raw = (t or "").encode()
        if before is None or before[:2] != (d, t):
            gone = bytearray(len(raw))
            for i in range(len(raw) - window + 1):
                if raw[i : i + window] in seen:
                    gone[i : i + window] = b"\1" * window
                else:
                    seen[raw[i : i + window]] = 1
            kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
            before = (d, t, (d, len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
        out.append(before[2])
    return out


def by_words(docs, symbols, crowd=repeats.CROWD):
    return sorted((tuple(r) for r in relative_lz.parsed(docs, symbols, crowd).select("doc_id", relative_lz.digest().alias("x")).select("doc_id", "x.*").collect()), key=repr)


def by_bytes(docs, symbols, crowd=repeats.CROWD):
    return sorted((tuple(r) for r in suffix_dedup.removed(docs, symbols, crowd).select("doc_id", suffix_dedup.digest().alias("x")).select("doc_id", "x.*").collect()), key=repr)


def test_op9_by_brute_force(spark):
    expected = sorted(slow_words(documents(), 35))
    assert sorted(map(tuple, queries.op9_substrings(spark, TABLES).collect())) == expected
    assert sum(x[2] for x in expected) > 0


def test_op10_by_brute_force(spark):
    expected = sorted(slow_bytes(sorted(documents()), 100))
    assert sorted(map(tuple, queries.op10_suffixes(spark, TABLES).collect())) == expected
    assert sum(x[2] for x in expected) > 0


@pytest.mark.parametrize(("window", "gram", "words", "crowd"), [(5, 2, 3, 4), (5, 2, 3, 50_000), (4, 4, 4, 50_000), (7, 1, 12, 1), (12, 5, 2, 50_000)])
def test_short_windows(spark, window, gram, words, crowd):
    """Much repetition, windows that overlap themselves, texts in many pieces."""
    rows = list(enumerate(texts(window, 60, words)))
    rows += [(60, "w0 " * 90), (61, "w1 w0 " * 50), (62, None), (63, ""), (63, "w1 w2 w0 " * 9), (63, "w1 w2 w0 " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_words(docs, repeats.Symbols(window, gram, True), crowd) == sorted(slow_words(rows, window), key=repr)
    # rows of one doc_id go by a hash of the text: only equal ones here
    assert by_bytes(docs.filter("doc_id <> 63 OR text <> ''"), repeats.Symbols(window, gram, False), crowd) == sorted(slow_bytes([r for r in rows if r != (63, "")], window), key=repr)


def test_pieces_of_long_texts(monkeypatch):
    """Anchors of a text that goes in pieces are those of the whole; words on a cut have the hash of the whole word."""
    text = (" ".join(texts(77, 60)) + " " + "longword" * 90).encode()
    for by_word in (False, True):
        s = repeats.Symbols(9, 3, by_word)

        def found(s=s):
            out = set()
            for v, e, parts, _ in s.pieces([b"", text, b"a b", text[::-1]]):
                a = repeats.anchors(v, e, s.window, s.gram)
                for at, first, last, h in zip(a.at, a.first, a.last, a.hash, strict=True):
                    i, begin, place = parts[int(np.searchsorted(e, at, "right"))]
                    out |= {(i, int(at) + begin - place, int(w) + begin - place, int(h)) for w in range(first, last + 1)}
            return out

        whole = found()
        values = s.split(text)[0]
        monkeypatch.setattr(repeats, "PIECE", 64)
        assert found() == whole
        assert (s.split(text)[0] == values).all()
        monkeypatch.undo()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=8, max_size=8), min_size=1, max_size=30), st.integers(1, 3))
def test_suffix_sort(rows, groups):
    m = np.array([list(r.encode()) for r in rows], np.uint8)
    block = suffixes.Block(m, repeats.byte_values()[m], np.zeros(len(m), np.int64), np.full(len(m), 8))
    row, col = np.divmod(np.arange(len(m) * 8), 8)
    bucket = row % groups * 8 + col
    order = block.sort(row, col, bucket, 8)
    assert [(bucket[i], rows[row[i]][col[i] :]) for i in order] == sorted((b, rows[r][c:]) for r, c, b in zip(row, col, bucket, strict=True))
    order, shared = block.neighbours(row, col, bucket, 3, 8)
    for p in range(1, len(order)):
        i, j = order[p - 1], order[p]
        if bucket[i] == bucket[j]:
            a, b = rows[row[i]][col[i] :], rows[row[j]][col[j] :]
            assert shared[p] == next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))


def test_colliding_hashes_are_found():
    """With hashes that are all equal, the symbols decide."""
    rows = ["aaaa", "abab", "aaaa", "bbbb", "abab"]
    m = np.array([list(r.encode()) for r in rows], np.uint8)
    block = suffixes.Block(m, np.zeros(m.shape, np.uint64), np.zeros(5, np.int64), np.full(5, 4))
    row, col = np.arange(5), np.zeros(5, np.int64)
    order, shared = block.neighbours(row, col, np.zeros(5, np.int64), 4, 4)
    assert [rows[row[i]] for i in order] == sorted(rows)
    assert shared.tolist() == [0, 4, 1, 4, 0]


def covered(found):
    return {i for x in found for i in range(x["start"], x["end"])}


def test_factors_and_their_boundaries():
    assert covered(relative_lz.factored([{"start": 0, "last": 2, "end": 6}], 4)) == set(range(6))
    assert covered(relative_lz.factored([{"start": 1, "last": 2, "end": 6}], 4)) == set(range(1, 6))
    assert relative_lz.factored(None) == []
    # two passages that overlap: the second one's first windows straddle the end of the first factor
    two = [{"start": 0, "last": 2, "end": 6}, {"start": 3, "last": 5, "end": 9}]
    assert covered(relative_lz.factored(two, 4)) == set(range(9))
    assert covered(relative_lz.factored(two, 4, boundaries=False)) == set(range(6))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 8)), max_size=16), st.integers(1, 6))
def test_factors_cover_all_matching_windows(moves, window):
    reach, end = [], 0
    for i, (new, n) in enumerate(moves):
        end = max(end, min(len(moves), i + n) if new else i)
        reach.append(max(end, i))
    found = [{"start": i, "last": i, "end": e} for i, e in enumerate(reach) if e - i >= window]
    assert covered(relative_lz.factored(found, window)) == {k for i, e in enumerate(reach) if e - i >= window for k in range(i, e)}


def test_factors_need_their_boundaries(spark, monkeypatch):
    """Without the check of boundaries, words of op9's table would stay."""
    whole = by_words(spark.read.parquet(f"{TABLES}/documents.parquet"), relative_lz.WORDS)
    assert whole == sorted(slow_words(documents(), 35), key=repr)
    found = [[x.asDict() for x in r.spans] for r in repeats.spans(spark.read.parquet(f"{TABLES}/documents.parquet"), relative_lz.WORDS, relative_lz.repeating, all_copies=True).collect()]
    assert any(covered(relative_lz.factored(x)) > covered(relative_lz.factored(x, boundaries=False)) for x in found)


def test_equal_digests_of_different_contexts(spark, monkeypatch):
    """A seed whose digests collide is given up."""
    rows = list(enumerate(texts(5, 30, 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    tried = []
    real = repeats.occurrences

    def colliding(docs, symbols, bits, seed):
        out = real(docs, symbols, bits, seed)
        tried.append(seed)
        return out.withColumn("c2", F.lit(0).cast("long")).withColumn("c1", F.lit(0).cast("long")) if seed == 0 else out

    monkeypatch.setattr(repeats, "occurrences", colliding)
    assert by_words(docs, repeats.Symbols(5, 2, True)) == sorted(slow_words(rows, 5), key=repr)
    assert tried == [0, 1]


def test_repeats_of_odd_rows(spark):
    docs = odd_docs(spark)
    words, raw = relative_lz.parsed(docs), suffix_dedup.removed(docs)
    for got in (words, raw):
        assert got.drop("__spans").schema == docs.schema
        assert got.count() == len(ODD)
    assert by_words(docs.limit(0), relative_lz.WORDS) == []
    assert by_bytes(docs.limit(0), suffix_dedup.BYTES) == []
    assert by_words(docs, relative_lz.WORDS) == sorted(slow_words(ODD, 35), key=repr)
    kept = {(r.doc_id, r.kept) for r in raw.withColumn("kept", suffix_dedup.kept_bytes()).filter("text LIKE 'the quick%' AND text NOT LIKE '%second%'").select("doc_id", "kept").collect()}
    assert {(d, len(k)) for d, k in kept} == {(1, len(ODD[0][1])), (2, 0), (None, 0)}
