"""Operator 5 against all pairs."""

import random
import re

import numpy as np
import pytest

from shoebox.llm import near_dedup
from shoebox.operators.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, n=4):
    """Component by row, with rows of one id as one node."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same = a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j])
            if same or (a and sets[j] and rows[i][0] is not None and rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("id", "n", "component_id").collect()), key=str)


def test_defined_cases(docs, rows):
    assert got(near_dedup.groups(docs)) == brute([r[:2] for r in rows])


def test_empty_table(no_docs):
    assert near_dedup.groups(no_docs).count() == 0
    assert near_dedup.keep_one(no_docs).columns == no_docs.columns


def test_keep_one_keeps_columns(docs, rows):
    out = near_dedup.keep_one(docs, n=4)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {d for d, _, c in brute([r[:2] for r in rows]) if d == c and d is not None}


def test_keep_one_of_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a, "x"), (None, b, "x"), (None, b + " more", "y"), (5, c, "x"), (5, c, "x"), (5, c, "z"), (None, c, "x"), (None, d, "q"), (None, d, "q"), (None, None, "x"), (None, None, "x"), (7, "", "x"), (7, "", "x"), (8, " ", "x")]
    out = sorted((tuple(r) for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=str)
    texts = [(i, t) for i, t, _ in out]
    assert texts.count((None, a)) == 1 and texts.count((None, b)) + texts.count((None, b + " more")) == 1
    assert texts.count((5, c)) == 1 and texts.count((None, c)) == 0 and texts.count((None, d)) == 1
    assert texts.count((None, None)) == 2 and texts.count((7, "")) == 2 and texts.count((8, " ")) == 1
    assert len(out) == 9 and set(out) <= set(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_hubs(spark, seed):
    """Copies of copies drift apart, so that components are wider than the threshold."""
    rng = random.Random(seed)
    rows, words = [], [f"w{i}" for i in range(400)]
    for family in range(6):
        text = rng.choices(words, k=rng.choice([30, 120, 300]))
        for _ in range(25):
            text = list(text)
            for _ in range(max(1, len(text) // 60)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((rng.randrange(10_000_000) * 10 + family, " ".join(text)))
    rng.shuffle(rows)
    out = near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out) == brute(rows)


def test_shuffled_texts_and_any_ids(spark, monkeypatch):
    """Where the ids wanted are too many to be broadcast; ids of all 64 bits, null and repeated ones."""
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    rng = random.Random(6)
    rows, words = [], [f"w{i}" for i in range(200)]
    ids = [None, None, -(1 << 63), (1 << 63) - 1, (1 << 62) + 5, (1 << 62) + 6, 7, 7, -3, 0]
    for k in range(12):
        text = rng.choices(words, k=60)
        for _ in range(5):
            own = list(text)
            own[rng.randrange(60)] = "other"
            rows.append((rng.choice(ids) if rng.random() < 0.7 else (1 << 62) + rng.randrange(1 << 62), " ".join(own)))
        rows += rows[-1:] * (k % 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.groups(df)) == brute(rows)
    alone = spark.createDataFrame([((1 << 62) + 5, "a b c d e f"), (None, "g h i j k l"), (1, "m n o p q r")], "doc_id long, text string")
    assert near_dedup.keep_one(alone).count() == 3 and near_dedup.groups(alone).where("component_id is null").count() == 1


def test_nodes_that_share_a_band():
    """The lanes find every equal band; near variants of one family meet across components."""
    rng = np.random.default_rng(0)
    hit = 0
    for bands in (24, 6):
        for _ in range(300):
            x, y = (rng.integers(0, 1 << 15, bands).tolist() for _ in "xy")
            if rng.random() < 0.5:
                k = rng.integers(bands)
                y[k] = x[k]
            pack = lambda v: [sum(b << 15 * i for i, b in enumerate(v[at : at + 4])) for at in range(0, bands, 4)]
            zero = False
            for at, (p, q) in enumerate(zip(pack(x), pack(y), strict=True)):
                d = (p ^ q) | sum(1 << 15 * i for i in range(bands - 4 * at, 4))
                zero |= (((d & near_dedup._OTHERS) + near_dedup._OTHERS) | d) & near_dedup._HIGHEST != near_dedup._HIGHEST
            assert zero == any(p == q for p, q in zip(x, y, strict=True))
            hit += zero
    assert hit > 200


@pytest.mark.parametrize("bands", [24, 6])
def test_variants_of_one_text(spark, bands):
    """Texts that take each paragraph from a few versions: many pairs just under and over the threshold."""
    rng = random.Random(9)
    versions = [[[f"{p}.{v}.{i}" for i in range(12)] for v in range(3)] for p in range(10)]
    rows = [(i, " ".join(w for p in versions for w in (p[0] if rng.random() < 0.8 else rng.choice(p)))) for i in range(120)]
    want = brute(rows)
    out = got(near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), bands=bands))
    assert out == want if bands == 24 else {d for d, _, _ in out} == {d for d, _, _ in want}


def test_word_hashes_of_long_texts(monkeypatch):
    """Piece by piece the hashes are those of the whole, for words longer than pieces and rows that end anywhere."""
    from shoebox.llm import text_hash

    rng = random.Random(1)
    texts = ["x" * 5000, "", " ", "".join(rng.choices("ab \n", k=3000)), "y" * 130 + " z", "w" * 64, "a b", "q" * 999, "é" * 200 + " Ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    want = text_hash.word_hashes(data, offsets)
    for piece in (1, 7, 64, 500):
        monkeypatch.setattr(text_hash, "PIECE", piece)
        got = text_hash.word_hashes(data, offsets)
        assert got[1].tolist() == want[1].tolist() and got[0].tolist() == want[0].tolist()
    assert len(want[0]) == sum(len(WORD.findall(t)) for t in texts)


def test_signature_estimates(rng=np.random.default_rng(5)):
    """Unbiased, and of lower variance than independent minima."""
    errors = []
    for _ in range(300):
        x = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        s = near_dedup.super_minhash([x[20:], x[:-20]], 128)
        errors.append((s[0] == s[1]).mean() - 160 / 200)
    assert abs(np.mean(errors)) < 0.008
    assert np.std(errors) < np.sqrt(0.8 * 0.2 / 128)


def test_signature_of_few_elements_fills_all_slots():
    s = near_dedup.super_minhash([np.array([7], np.uint64), np.array([], np.uint64), np.array([7], np.uint64)], 96)
    assert (s[0] != near_dedup._UNSET).all() and (s[0] == s[2]).all() and (s[1] == near_dedup._UNSET).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    alone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    out = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for x in root if x not in alone}


def test_a_large_group_meets_in_proportion_to_its_nodes(spark, monkeypatch):
    """Variants with one or two of a few edits in common link through one another: of 9,000 pairs only some hundreds are compared."""
    rng, rows = random.Random(3), []
    base = [f"t{i}" for i in range(90)]
    edits = [(at, f"e{at}") for at in range(4, 90, 8)]
    for k in range(240):
        own = list(base)
        for at, word in rng.sample(edits, rng.choice([1, 2, 3, 4])):
            own[at] = word
        own[-1 - k % 3] = f"own{k}"
        rows.append((k, " ".join(own)))
    tested, real = [], near_dedup._verified

    def counted(pairs, sets, similarity):
        out = real(pairs, sets, similarity)
        tested.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_verified", counted)
    assert got(near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert sum(tested) < 10 * len(rows)
