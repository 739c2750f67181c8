"""Jaccard join, fill-in-the-middle and collocations on small tables, against brute force."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import common, counts, middles, phrases, sets, tries

#: Extra columns whose names the operators use inside.
EXTRA = "n long, digest string, node string, output int, w1 string, key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table_of(spark, rows, lang=False):
    own = [(*r, 1, "x", "y", 2, "z", "k") for r in rows]
    return spark.createDataFrame(own, f"doc_id long, text string, {'lang string, ' * lang}{EXTRA}")


def shingles(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset() if not words else frozenset([tuple(words)]) if len(words) < n else frozenset(zip(*(words[k:] for k in range(n))))


def roots_of(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def edited(words, share, r):
    return [f"w{r.randrange(10**9)}" if r.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    """Unrelated texts, chains and clouds of near copies of many lengths, short texts, and odd rows."""
    r = random.Random(3)
    word = lambda: f"v{int(400 * r.random() ** 2)}"
    rows = []
    for size in (3, 5, 9, 10, 12, 19, 25, 40, 90, 250, 900):
        base = [word() for _ in range(size)]
        for _ in range(14):
            rows.append(" ".join(edited(base, r.choice([0, 0.005, 0.01, 0.02, 0.05]), r)))
            if r.random() < 0.3:
                base = edited(base, 0.01, r)
    rows += ["one", "one two", "ONE two", "one  two\n", "", None, "  \t ", "a a a a a a", "a a a", "naïve 日本 naïve 日本", "x " * 40_000]
    rows += [" ".join(word() for _ in range(r.randrange(4, 80))) for _ in range(60)]
    return list(enumerate(rows, 10))


def expected_components(rows, percent=90):
    own = {d: shingles(t) for d, t in rows}
    ids = list(own)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])]
    return {d: (len(own[d]), c) for d, c in roots_of(links, ids).items()}, len(links)


def test_jaccard_components_against_every_pair(spark, corpus):
    expected, links = expected_components(corpus)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in counts.jaccard_components(table_of(spark, corpus)).collect()}
    assert got == expected and links > 150 and len(set(expected.values())) > 80


def test_jaccard_components_in_small_blocks(spark, corpus, monkeypatch):
    """Clusters dealt over many pairs of blocks give the same components."""
    monkeypatch.setattr(sets, "BLOCK_MEMBERS", 3)
    expected, _ = expected_components(corpus, 80)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in counts.jaccard_components(table_of(spark, corpus), percent=80).collect()}
    assert got == expected


def test_jaccard_components_of_odd_rows(spark):
    text = " ".join(f"t{k}" for k in range(60))
    rows = [(5, text), (5, text), (5, "another text under this id altogether"), (None, text + " more"), (None, "only without an id here"), (9, text + " end"), (8, None), (8, "")]
    got = Counter((x.doc_id, x.component_id) for x in counts.jaccard_components(table_of(spark, rows)).collect())
    assert got == Counter([(5, 5), (5, 5), (5, 5), (None, 5), (None, None), (9, 5), (8, 8), (8, 8)])
    assert counts.jaccard_components(table_of(spark, rows).where("false")).count() == 0


def test_cells_hold_every_linked_pair():
    """At and just over the threshold, at sizes around the bands' borders, two linked sets share a key; and the bound holds."""
    r = np.random.default_rng(1)
    bands = counts.Bands(90)
    for n in [*range(9, 60), 95, 140, 333, 1000, 4000]:
        for _ in range(6):
            differ = int(r.integers(1, max(2, counts.difference(2 * n, 90) + 1)))
            gone = int(r.integers(0, differ + 1))
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[gone:], r.integers(0, 1 << 63, differ - gone, dtype=np.uint64)])
            same, union = n - gone, n + differ - gone
            bound = int(np.minimum(sets.point_of(a), sets.point_of(b)).sum())
            assert bound >= same
            if 100 * same >= 90 * union and same < union:
                assert set(counts.cell_keys(np.unique(a), bands).tolist()) & set(counts.cell_keys(np.unique(b), bands).tolist()), (n, differ, gone)


def test_trees_lose_no_link():
    r = np.random.default_rng(2)
    base = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (15, 60, 60, 300)]
    own = []
    for k in range(400):
        b = base[k % 4]
        keep = r.random(len(b)) > r.choice([0.01, 0.04, 0.2])
        own.append(np.unique(np.concatenate([b[keep], r.integers(0, 1 << 63, int(r.integers(0, 4)), dtype=np.uint64)])))
    points = np.stack([sets.point_of(s) for s in own])
    for side in (np.zeros(400, np.int64), r.integers(0, 2, 400)):
        every = [(i, j) for i in range(400) for j in range(i) if (side.max() == 0 or side[i] != side[j]) and 100 * len(np.intersect1d(own[i], own[j])) >= 90 * len(np.union1d(own[i], own[j]))]
        found = sets.tree_links(own, points, side, 90)
        assert roots_of(found, range(400)) == roots_of(every, range(400)) and len(found) < 400


def middle_of(doc, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(tokens)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 10**12), st.lists(st.sampled_from(["a", "Zb", " ", "é", "日", "\n", "<", "P>", "<S", "<M>", "𝒳", "1", ">"]), max_size=30).map("".join)), min_size=1, max_size=20))
def test_middles_of_one_buffer(rows):
    data, at = middles.buffer_of(pa.array([t.encode() for _, t in rows], pa.binary()))
    n, cuts, form = middles.cut_texts([d for d, _ in rows], data, at)
    written, out = middles.rewrite(data, at[:-1], cuts, at[1:], form)
    back, ends = middles.restore(written, out, form)
    for k, (doc, text) in enumerate(rows):
        expected = middle_of(doc, text)
        assert (n[k], middles.FORMS[form[k]], written[out[k] : out[k + 1]].tobytes().decode()) == (expected[0], expected[1], expected[4])
        assert back[ends[k] : ends[k + 1]].tobytes().decode() == text


def test_middles_of_a_table(spark):
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(["alpha", "b,", "ç", "x1"]) for _ in range(k))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "has <S> inside"), (None, "no id"), (7, rows[7][1]), (103, "word é " * 60_000)]
    got = middles.fill_in_middle(table_of(spark, rows))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = []
    for doc, text in rows:
        n, form, prefix, middle, output = middle_of(doc, text)
        expected.append((doc, n, form, prefix, middle, sha(output), sha(text or ""), output))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert {x.form for x in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert middles.fill_in_middle(table_of(spark, rows).where("false")).count() == 0


def collocations_of(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score), counted one by one."""
    f = {}
    for _, text, lang in rows:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        frequent = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * c >= 50 * a for q, c in frequent.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def phrase_rows():
    r = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "don't"]
    rows = []
    for k in range(240):
        text = []
        for _ in range(r.randrange(0, 40)):
            text.append(r.choice(["New York City", "of the", "to be", "a a a"]) if r.random() < 0.25 else words[int(len(words) * r.random() ** 3)])
            if r.random() < 0.15:
                text[-1] += r.choice([".", ", ", "\n", "!", "\x0b", ";;", " \t "])
        rows.append((k, " ".join(text), r.choice(["en", "de", None, "und", ""])))
    return rows + [(900, None, "en"), (901, "", "fr"), (902, "x y z " * 30_000, "long"), (None, "of the " * 30, "en")]


def test_collocations_against_counting(spark):
    rows = phrase_rows()
    df = table_of(spark, rows, lang=True)
    expected = collocations_of(rows, 10, 2000)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == sorted(expected) and len(expected) > 50
    few = collocations_of(rows, 4, 7)
    got = phrases.collocations(df, least=4, top=7, phrases=50)  # many tries
    assert sorted(map(tuple, got.collect())) == sorted(few)
    assert phrases.collocations(df.where("false")).count() == 0


def test_bitmaps_hold_every_hash(spark):
    r = np.random.default_rng(0)
    own = np.concatenate([r.integers(-(2**63), 2**63 - 1, 3000), [0, -1, 2**62, 32767, 32768, (1 << phrases.BITMAP_BITS) - 1]])
    bitmap = phrases.bitmap_of(spark.createDataFrame([(int(x),) for x in own], "h long"), "h")
    assert phrases._in_bitmap(bitmap, own).all()
    assert phrases._in_bitmap(bitmap, r.integers(-(2**63), 2**63 - 1, 10_000)).mean() < 0.01


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**30), st.integers(1, 400), st.integers(1, 60))
def test_tries_walk_as_dictionaries_do(seed, phrases_in, vocabulary):
    r = np.random.default_rng(seed)
    words = r.integers(1, 2**62, vocabulary)
    own = words[r.integers(0, vocabulary, (phrases_in, 3))]
    own[: phrases_in // 2, 2] = 0
    own = np.unique(own, axis=0)
    trie = tries.build(own)
    text = np.where(r.random(500) < 0.9, words[r.integers(0, vocabulary, 500)], 7)
    codes = trie.codes(text)
    at, states = trie.at(np.zeros(500, np.int64), codes)
    known = {tuple(x[: k + 1]) for x in own.tolist() for k in range(3) if x[k]}
    for k in range(3):
        if k:
            keep = at + k < 500
            at, states = at[keep], states[keep]
            on, states = trie.at(states, codes[at + k])
            at = at[on]
        assert at.tolist() == [i for i in range(500 - k) if tuple(text[i : i + k + 1].tolist()) in known]
        paths = trie.path(states)
        assert all(tuple(p[: k + 1]) == tuple(text[i : i + k + 1].tolist()) and not any(p[k + 1 :]) for p, i in zip(paths.tolist(), at))


def test_written_tables_leave_no_shuffle_files(spark):
    """The words' tallies and those of pairs and triples must not lie on disk together."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name)
    numbers = spark.range(5000).select(F.xxhash64("id").alias("k")).groupBy("k").count()
    assert common.materialize(numbers, "numbers").count() == 5000
    assert phrases.bitmap_of(numbers, "k").any()
    assert not files() - before and spark.conf.get(name) == setting
