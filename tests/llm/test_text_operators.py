"""Operators 1, 3, 4, 7, 8 and 9 against plain Python, and their defined cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoebox.llm import decontamination, elias_fano, pii, quality_classifier, token_store, url_filters, warc
from shoebox.llm.common import work_folder

RULES = list(url_filters.RULES)


def plain_verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:][::-1] if fits else (None, None))


def test_url_rules(spark):
    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x#y", "x.org/a", "http://x.org", "http://x.org/", "http://org/", "http://notorg/", "ftp://q.com/fr/", "http://q.com/de/#", "http://q.com/de?", None, "", "://", "http://h?a/b", "http://a://b/c", "http://example.org.evil.com/es/", "http://example.org/en/1", "http://example.org/en/1", "http://xcom/de/", "http://É.Example.ORG/ES/", "http://\u212aELVIN.com/de/"]
    rows = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id int, url string, html string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(rows, rules, url_filters.link_edges(rows)).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_verdict(u)
        assert got[i] == (host, path, rule, verdict or "allow"), u
    assert url_filters.judge(rows.limit(0), rules, url_filters.link_edges(rows.limit(0))).count() == 0


def test_redirect_classes(spark):
    canonical = '<html><link href="{}" rel=canonical>'
    refresh = '<META http-equiv="Refresh" content="0; URL=/b">'
    pages = [
        (1, "http://q.com/de/bad", None), (2, "http://mirror.net/x", canonical.format("http://q.com/de/bad")), (3, "https://other.net/y", canonical.format("https://mirror.net/x#top")),
        (4, "http://good.org/z", canonical.format("http://mirror.net/x")), (5, "http://s.net/a", refresh), (6, "http://s.net/b", None), (7, "http://s.net/c", '<link rel="stylesheet" href="http://q.com/de/bad">'),
        (8, "http://away.net/", canonical.format("http://example.org/es/unseen")),
    ]
    rows = spark.createDataFrame(pages, "page_id int, url string, html string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r["id"]: (r["verdict"], r["decided_by"]) for r in url_filters.judge(rows, rules, url_filters.link_edges(rows)).collect()}
    assert got == {1: ("block", "rule"), 2: ("block", "redirect"), 3: ("block", "redirect"), 4: ("allow", "rule"), 5: ("allow", "default"), 6: ("allow", "default"), 7: ("allow", "default"), 8: ("block", "redirect")}


def test_targets_are_resolved(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="{}">'
    pages = [
        ("http://a/1", refresh.format("0; url='http://b/x'"), "b/x"), ("http://a/2", canonical.format("http://b/y?p=1&amp;q=2&#38;r=3"), "b/y?p=1&q=2&r=3"), ("http://h", canonical.format("a.html"), "h/a.html"),
        ("http://h/d/e/f", canonical.format("../g"), "h/d/g"), ("http://h/d/e", canonical.format("./g?x=../y"), "h/d/g?x=../y"), ("http://h/d/i?z", canonical.format("?q=1"), "h/d/i?q=1"), ("http://h/k", canonical.format("http://b/m/../../n/.."), "b/"),
        ("http://h/l?z", canonical.format("#top"), None), ("http://a/3", "<meta http-equiv=refresh content='5;URL=/b?x&amp;y'>", "a/b?x&y"), ("http://h/o", canonical.format("//b/p/.hid/..x"), "b/p/.hid/..x"),
    ]
    got = url_filters.link_edges(spark.createDataFrame([p[:2] for p in pages], "url string, html string")).collect()
    assert {(r["a"], r["b"]) for r in got} == {(u[7:] if "/" in u[7:] else u[7:] + "/", b) for u, _, b in pages if b}


def test_url_sql_on_made_links(spark):
    """The SQL and the operator agree on links of every form, on repeated pages and chains."""
    import duckdb

    link, refresh = '<link rel="canonical" href="{}">', '<meta content="0;url={}" http-equiv=refresh>'
    bad, targets = "http://q.com/de/bad", ["http://m.net/x", "../d/e", "?q=1", "#top", "//m.net/x#y", "/b/./c/../d", "a.html", "http://q.com/de/bad", "http://Q.com/de/bad?x&amp;y", "http://example.org/es/unseen", "m/../../..", "http:///none", "HTTP://away.net"]
    own = ["http://m.net/x", "http://s.net/d/f", "http://s.net", "http://good.org/z", "http://s.net/d/e?z", "no scheme", bad, None]
    pages = [(u, f.format(t)) for u in own for t in targets for f in (link, refresh, "<LINK\nhref='{}' type=x rel='canonical'>")] + [(f"http://chain.net/{i}", link.format(f"http://chain.net/{i + 1}")) for i in range(12)] + [("http://chain.net/12", link.format(bad)), (bad, None), ("http://m.net/x", None), ("http://m.net/x", link.format(bad) + refresh.format("/other"))]
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    for part in (pages, pages[-16:], pages[:60], [p for p in pages if p[0] != bad and bad not in (p[1] or "")]):
        rows = [(i, *p) for i, p in enumerate(part)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        c = duckdb.connect()
        c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        c.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
        got = url_filters.judge(df, rules, url_filters.link_edges(df)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, c.execute(url_filters.ORACLE).fetchall()))
    assert {r["decided_by"] for r in got} == {"rule", "redirect", "default"}


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = quality_classifier.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((out.predicted == out.quality).mean()) > 0.97
    assert out.score.between(0, 1).all()


def test_classifier_cases(docs, no_docs, spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    out = quality_classifier.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.scored(no_docs, model).count() == 0
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.scored(docs, quality_classifier.train(docs, labels)).count() == len(rows)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    xs = [np.unique(np.r_[rng.integers(0, 50, 20), [100 + k % 2]]) for k in range(200)]
    y = np.array([1 if k % 2 else -1 for k in range(200)])
    r = quality_classifier.log_ratios(xs, y)
    w, b = quality_classifier.dual_coordinate_descent(xs, y, r)
    assert all(np.sign((w * r)[x].sum() + b) == v for x, v in zip(xs, y))


def test_dual_coordinate_descent_finds_the_optimum():
    """No step in any of many directions lowers the hinge-loss objective, which is convex."""
    rng = np.random.default_rng(3)
    xs = [np.unique(rng.integers(0, 12, 6)) for _ in range(60)]
    y = np.where(rng.random(60) < [0.2 + 0.6 * (x[0] < 2) for x in xs], 1, -1)
    r = quality_classifier.log_ratios(xs, y)
    w, b = quality_classifier.dual_coordinate_descent(xs, y, r, epochs=5000)
    rows = np.zeros((60, 13))
    for k, x in enumerate(xs):
        rows[k, x] = r[x] / np.sqrt((r[x] ** 2).sum())
    rows[:, 12] = 1
    loss = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (rows @ v)).sum()
    own = np.append(w[:12], b)
    assert not w[12:].any() and loss(own) < loss(np.zeros(13)) - 5
    step = np.zeros(13)
    for t in range(1, 20_001):  # subgradient descent from elsewhere ends no lower
        step -= (step - ((y * (rows @ step) < 1) * y) @ rows) / t
    assert loss(own) <= loss(step) + 5e-3
    assert all(loss(own + size * d / np.linalg.norm(d)) > loss(own) - 5e-3 for d in rng.normal(size=(400, 13)) for size in (1e-3, 1e-1, 1.0))


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, docs, no_docs, rows):
    rng = random.Random(4)
    parts = ["a@b.co", "a@@b.co", "x.y%z@a-b.c.d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "4111111111111112", "+1 (578) 555-6437", "+12", "é@é.é", "漢字", "🎈", ".", "@", "+", "a b", "12", "-", " ", "\n", "a@b.co@c.de"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(600)]
    rows_in = [(i, t) for i, t in enumerate(texts)]
    got = {r["id"]: r for r in pii.find(spark.createDataFrame(rows_in, "doc_id long, text string")).collect()}
    for i, t in rows_in:
        want = plain_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), repr(t)
        assert set(want) <= set(got[i]["spans"].split(",") if got[i]["spans"] else [])
        count = Counter(x.split(":")[0] for x in want)
        assert [got[i][f"n_{k}"] for k in BASE] == [count[k] for k in BASE]
    assert pii.find(docs).count() == len(rows) and pii.find(no_docs).count() == 0


def test_random_field():
    field = pii.train(pii.labelled_rows())
    table = pii.labelled_rows()
    assert field.viterbi([s for s, _ in table]) == [y for _, y in table]
    texts = ["please call (312) 555-0123 tomorrow.", "mail max [at] firma [dot] de or so", "we paid $1,234.56 on 2021-03-04 for (a) b", "no sign at all"]
    got = [[(pii.KINDS[k], t[s:e]) for k, s, e in m] for t, m in zip(texts, pii.added_spans(texts, [[]] * 4, field))]
    assert got == [[("phone", "(312) 555-0123")], [("email", "max [at] firma [dot] de")], [], []]


def test_viterbi_is_the_best_path():
    """Against all label sequences of short windows."""
    import itertools

    field = pii.train(pii.labelled_rows()[:12], steps=20)
    for shapes in (["a", "d3-d4"], ["(d3)", "d3-d4", "a"], ["a", "AT", "a"]):
        scores, _ = field.emissions([shapes])

        def value(path):
            return field.begin[path[0]] + sum(scores[0, t, y] for t, y in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(shapes)), key=value)
        assert tuple(field.viterbi([shapes])[0]) == best


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 2**63), (1000, 10**6), (5000, 5000), (700, 2**63 + 5), (3000, 1)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e = elias_fano.EliasFano.from_bytes(elias_fano.EliasFano.encode(v).to_bytes())
    assert (e.decode() == v).all()
    assert [e.select(i) for i in range(0, n, 3)] == v[::3].tolist()
    with pytest.raises(IndexError):
        e.select(n)
    if n >= 1000 and top > n:
        assert len(e.low) + len(e.high) < n * (2 + np.log2(top / n) + 1) / 8 + 64


def test_token_store(spark, docs, no_docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_store.byte_bpe_path())
    folder = f"{work_folder(spark)}/tokens"
    token_store.write_store(docs, folder, token_store.byte_bpe_path(), shard_bytes=10_000)
    got = sorted(token_store.read_store(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    texts, at = {r[0]: r[1] or "" for r in rows}, 0
    for r in got:
        ids = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert r["start"] == at and r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_store.stored(no_docs).count() == 0


def made_sentences(seed, n):
    """Sentences of other words and numbers than the labelled table, with the spans that the field should add."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvwz", k=rng.randrange(2, 9)))
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    code = lambda letters, k: "a1" + "".join(rng.choices(letters, k=k))
    card = lambda sep: sep.join(re.findall("....", rng.choice(("4539148803436467", "6011000990139424", "5105105105105100"))))
    made = {
        "phone": [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"],
        "email": [lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()}.{word()}(at){word()}(dot)org", lambda: f"{word()} (at) {word()}.net"],
        "card": [lambda: card("/"), lambda: card(".")],
        "ip": [lambda: f"{rng.randrange(256)}[.]{rng.randrange(256)}[.]{rng.randrange(256)}[.]{rng.randrange(256)}", lambda: " . ".join(str(rng.randrange(256)) for _ in range(4))],
        "secret": [lambda: code("0123456789abcdef", 38), lambda: code("0123456789ABCDEFGHJKLMNP", 18)],
    }
    plain = ["in {y} we", "about {n} people", "page {n} of {n}", "on {y}-0{x}-1{x} they", "(see {n})", "version {x}.{x}.{x} of", "the sha {h} fixed"]
    out = []
    for _ in range(n):
        parts, spans = [word() for _ in range(rng.randrange(3, 8))], []
        for _ in range(rng.randrange(1, 3)):
            if rng.random() < 0.5:
                parts.append(rng.choice(plain).format(y=rng.randrange(1900, 2030), n=rng.randrange(1000), x=rng.randrange(1, 9), h=code("0123456789abcdef", 38)))
            else:
                kind = rng.choice(sorted(made))
                value = rng.choice(made[kind])()
                if kind == "secret":
                    parts.append(rng.choice(["token = ", "api_key: ", "secret = ", "my password: "]))
                    value, parts[-1] = f'"{value}"' if rng.random() < 0.7 else value, parts[-1].strip()
                spans.append((kind, value.strip('"')))
                parts.append(value + rng.choice(["", "", ",", ".", "!!", "###"]))
            parts += [word() for _ in range(rng.randrange(3, 6))]
        out.append((" ".join(parts), spans))
    return out


def test_field_on_held_out_sentences(capsys):
    field = pii.train(pii.labelled_rows())
    rows = made_sentences(2026, 1500)
    base = [pii.base_spans(t) for t, _ in rows]
    more = pii.added_spans([t for t, _ in rows], base, field)
    hit = found = want = 0
    for (text, spans), own in zip(rows, more):
        got = Counter((pii.ALL_KINDS[k], text[s:e]) for k, s, e in own)
        hit, found, want = hit + sum((got & Counter(spans)).values()), found + got.total(), want + len(spans)
    with capsys.disabled():
        print(f" recall {hit / want:.3f}, precision {hit / found:.3f} of {want} spans", end="")
    assert hit / want >= 0.9 and hit / found >= 0.9


def test_long_runs_of_digits_and_signs():
    field = pii.train(pii.labelled_rows(), steps=20)
    start = time.process_time()
    texts = ["1.2.3." + "5" * 1_000_000, "7" * 1_000_000, "1 2 " * 100_000, "@" * 300_000, "1.2.3.4." * 50_000, "+1 " + " " * 300_000 + "x"]
    base = [pii.base_spans(t) for t in texts]
    assert [len(b) for b in base] == [0, 0, 0, 0, 50_000, 0]
    pii.added_spans(texts, base, field)
    assert time.process_time() - start < 60
    assert pii.base_spans("1.2.3.4 0001.002.03.4 256.1.1.1.2 1.2.3.4.5.6.7.8") == [(1, 0, 7), (1, 8, 21), (1, 34, 41), (1, 42, 49)]


ODD_TEXTS = ["", " ", "a  b", "x\n\ny", " lead", "trail ", "tab\tx y", "it's 'll x", "a b\u2003c\xa0d", "<|endoftext|> hi <|endoftext|>", "n\x00ul a b", "a\x1cb c \x85 d", "é 日本 語\n x", "\nstart", "end\n", "a \nb", "a\n b", "a\r\nb c", "×, é, д, ÷; ß!!! x’, e\u0301, 1, it's, a\u3000 b", "one two three", "a\nb\nc, d", "日\u3000 本 \u2003x \xa0y\xa0 z"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_of_odd_texts(name, monkeypatch):
    import public_tokenizers

    from shoebox.llm import piece_encoder

    encoder = piece_encoder.Encoder(public_tokenizers.path(name))
    assert encoder.by_pieces == (name == "byte_bpe_50k.json")
    rng = random.Random(3)
    texts = ODD_TEXTS + ["".join(rng.choices("ab ,.é×\n\t\xa0\u2003'1s漢", k=rng.randrange(40))) for _ in range(400)]
    for most in (piece_encoder.CACHE_PIECES, 50):
        monkeypatch.setattr(piece_encoder, "CACHE_PIECES", most)
        for own in (texts, texts[22:]):
            data = np.frombuffer("".join(own).encode(), np.uint8)
            ids, counts = encoder.encode(data, np.cumsum([0, *(len(t.encode()) for t in own)]))
            assert len(ids) == counts.sum()
            for text, got in zip(own, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                assert got.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_are_tokenized_in_parts(spark, monkeypatch):
    from shoebox.llm import piece_encoder
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = ["".join(rng.choices("ab ,.é\n", k=300_000)), "x" * 20_000, "one two", None, " " * 5_000 + "end"]
    encoder = piece_encoder.Encoder(token_store.byte_bpe_path())
    data = np.frombuffer(texts[0].encode(), np.uint8)
    at, parts = 0, []
    while at < len(data):
        n = encoder.part(data[at:], 10_000)
        parts.append(encoder.encode(data[at : at + n], np.array([0, n]))[0])
        at += n
    whole = Tokenizer.from_file(token_store.byte_bpe_path()).encode(texts[0], add_special_tokens=False).ids
    assert len(parts) > 20 and np.concatenate(parts).tolist() == whole
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(5), pa.int64()), "text": pa.array(texts)})
    monkeypatch.setattr(token_store, "GROUP", 10_000)
    monkeypatch.setattr(piece_encoder.Encoder.part, "__defaults__", (10_000,))
    got = list(token_store._parts(iter([batch]), encoder))
    assert sum(len(x[0]) for x in got) == 5 and b"".join(x[2].tobytes() for x in got).decode() == "".join(t or "" for t in texts)


@pytest.mark.parametrize("bound", [warc.BROADCAST_DIGESTS, 0])
def test_warc_round_trip(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", bound)
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefghij <>&é漢\r\n", k=400_000))
    pages = [(1, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (2, "http://a/2", "x" * 100), (3, None, "x" * 99), (4, "http://a/\r\nx: y", "x" * 99), (5, "u", None), (6, "u", ""), (7, "v", long), (8, "v", long), (None, "w", long), (None, "w", "z" * 200), (9, "q", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1" * 9)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, digest string, bytes int").repartition(3)
    folder = f"{work_folder(spark)}/warc"
    files = warc.archive(warc.classified(df, 1000), folder, archive_bytes=50_000)
    for r in warc.chunked(df, 1000).where("chunk < last").collect():
        assert r["digest_so_far"] == hashlib.sha256(long.encode()[: r["bytes_so_far"]]).hexdigest() and r["bytes_so_far"] == 1000 * (r["chunk"] + 1)
    got = warc.read_chunks(spark, folder, files, chunk_bytes=777).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r["chunk"]):
        key = (r["id"], r["declared_digest"], r["kind"])
        whole.setdefault(key, {}).setdefault(r["chunk"], r)
        assert len(r["data"]) <= 777
    for (page, digest, kind), chunks in whole.items():
        data = b"".join(chunks[k]["data"] for k in range(len(chunks)))
        last = chunks[len(chunks) - 1]
        assert last["is_last"] and last["bytes_so_far"] == len(data) and last["digest_so_far"] == hashlib.sha256(data).hexdigest()
        assert kind == "revisit" or digest == last["digest_so_far"]
    kinds = Counter((r["id"], r["kind"], r["refers_to"]) for r in got if r["is_last"])
    assert kinds == Counter([(1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 7), (None, "revisit", 7), (None, "response", None), (9, "response", None)])
    assert warc.archive(warc.classified(df.limit(0)), f"{folder}0") == []
    assert warc.read_chunks(spark, f"{folder}0", []).count() == 0


def plain_words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def plain_leaks(docs, items, n=5):
    def grams(w):
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else []

    out = {}
    for doc, text in docs:
        d = grams(plain_words(text))
        for item, it in items:
            b = grams(plain_words(it))
            best = 0.0
            for s in range(max(1, len(d) - len(b) + 1)) if d and b else []:
                x, y = Counter(d[s : s + len(b)]), Counter(b)
                o = sum((x & y).values())
                best = max(best, o / (x.total() + y.total() - o))
            if best >= 0.8 - 1e-12:
                out[doc, item] = round(best, 6)
    return out


def test_decontamination(spark, docs, no_docs):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 5, 8, 20, 45, 45])))) for i in range(25)] + [(100, "one two"), (101, ""), (102, None), (103, "la la la la la la la la la la la la")]
    rows = []
    for i in range(160):
        own = rng.choices(words, k=rng.randrange(0, 120))
        if i % 2:
            passage = list((rng.choice(items)[1] or "").split())
            for _ in range(rng.choice([0, 0, 1, 2])):
                if passage:
                    passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(own) + 1)
            own[at:at] = [w.upper() + "," for w in passage]
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item"]): round(r["similarity"], 6) for r in decontamination.decontaminate(df, it).collect()}
    assert got == plain_leaks(rows, items)
    assert decontamination.clean(docs, it).columns == docs.columns
    assert decontamination.clean(no_docs, it).count() == 0
    assert decontamination.decontaminate(df, it.limit(0)).count() == 0


def test_decontamination_of_long_runs(spark):
    """Windows at about 0.8 whose difference is a run of equal words; both sides with runs as well."""
    rows, items = [], []
    for k, (m, run) in enumerate([(108, 8), (180, 16), (270, 26), (270, 22)]):
        own = [f"k{k}w{i}" for i in range(m + 4)]
        at = len(own) // 2
        items += [(k, " ".join(own)), (10 + k, " ".join([*own[:-40], *["dash"] * 40]))]
        for doc, base in ((k, own), (10 + k, own[:-40] + ["dash"] * 40)):
            for less in range(-1, 2):
                size = run - 4 + less
                rows.append((doc * 10 + less + 1, " ".join([*base[: at - size], *["zero"] * size, *base[at:]])))
    got = {(r["id"], r["item"]): round(r["similarity"], 6) for r in decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_leaks(rows, items) and len(got) > 12


def test_decontamination_with_anchors_shuffled(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    rows, items = [(1, " ".join(f"a{i}" for i in range(40))), (2, "x y z"), (1, "q " * 30)], [(5, " ".join(f"a{i}" for i in range(5, 35))), (6, "q " * 12)]
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["id"], r["item"], round(r["similarity"], 6)) for r in got) == [(1, 5, 1.0), (1, 6, 1.0)]


def test_decontamination_of_large_items_and_odd_ids(spark):
    words = [f"w{i}" for i in range(17_004)]
    large = [(1, " ".join(words))]
    out = decontamination.decontaminate(spark.createDataFrame([(5, " ".join(words[:15_004]))], "doc_id long, text string"), spark.createDataFrame(large, "item_id long, text string")).collect()
    assert [(r["id"], r["item"], round(r["similarity"], 6), r["start"]) for r in out] == [(5, 1, round(15 / 17, 6), 0)]
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    items = spark.createDataFrame([(None, a), (None, b), (3, c), (3, d)], "item_id long, text string")
    docs = spark.createDataFrame([(1, a + " " + b), (2, c), (3, d), (4, c + " " + d), (None, b), (5, "x y z")], "doc_id long, text string")
    got = sorted(((r["id"], r["item"], r["start"]) for r in decontamination.decontaminate(docs, items).collect()), key=str)
    assert got == sorted([(1, None, 0), (1, None, 20), (2, 3, 0), (3, 3, 0), (4, 3, 0), (None, None, 0)], key=str)
    assert [r["doc_id"] for r in decontamination.clean(docs, items).collect()] == [5]


def test_fingerprints_and_blocks(spark):
    rng = random.Random(8)
    arrays = [[rng.getrandbits(64) - (1 << 63) for _ in range(rng.randrange(1, 60))] for _ in range(50)]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in arrays], "x array<bigint>").select(decontamination.fingerprint(F.col("x"))).collect()]
    for a, fp in zip(arrays, got):
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in a) > len(a))
        assert fp & (1 << 64) - 1 == want
    pairs = [(x, x ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(25, 38)))) for x in (rng.getrandbits(62) for _ in range(300))]
    for radius, blocks in ((decontamination.RADIUS, decontamination.BLOCKS), (30, 1), (5, 3)):
        got = spark.createDataFrame(pairs, "a long, b long").select(decontamination.within(F.col("a"), F.col("b"), radius, blocks)).collect()
        assert [r[0] for r in got] == [(a ^ b).bit_count() <= radius for a, b in pairs]


@pytest.mark.parametrize("radius, blocks", [(decontamination.RADIUS, decontamination.BLOCKS), (31, 32), (12, 4), (5, 3)])
def test_windows_are_looked_up_by_blocks(spark, radius, blocks):
    """The join on values of blocks finds each window within the radius of its item once, and no other."""
    rng = random.Random(9)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(i, rng.getrandbits(64)) for i in range(12)]
    windows = [(w, i, fp ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 45)))) for w, (i, fp) in enumerate(items * 40)]
    index = decontamination.block_index(spark.createDataFrame([(i, signed(fp)) for i, fp in items], "item long, item_fp long"), radius, blocks)
    asked = spark.createDataFrame([(w, i, signed(fp)) for w, i, fp in windows], "start int, item long, fp long")
    got = sorted(r["start"] for r in decontamination.looked_up(asked, index, radius, blocks).collect())
    assert got == [w for w, i, fp in windows if (fp ^ items[i][1]).bit_count() <= radius]


def test_leaks_come_through_the_index_of_blocks(spark, monkeypatch):
    rows, items = [(1, " ".join(f"a{i}" for i in range(40)))], [(5, " ".join(f"a{i}" for i in range(5, 35)))]
    docs, its = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.decontaminate(docs, its).count() == 1
    whole = decontamination.block_index
    monkeypatch.setattr(decontamination, "block_index", lambda *a, **k: whole(*a, **k).limit(0))
    assert decontamination.decontaminate(docs, its).count() == 0
    assert decontamination.decontaminate(docs, its, radius=None).count() == 1


def test_radius_loses_nothing_at_the_threshold(spark):
    """Windows at exactly 0.8, in number: all within the radius; bits differ as reckoned."""
    from math import acos, comb, pi

    p = acos(8 / 9) / pi
    assert sum(comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(decontamination.RADIUS + 1, 65)) < 1e-10
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        own = [rng.getrandbits(64) - (1 << 63) for _ in range(50)]
        rows.append((own[:45], own[5:]))  # 40 of 50
    far = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select(F.bit_count(decontamination.fingerprint(F.col("a")).bitwiseXOR(decontamination.fingerprint(F.col("b"))))).toPandas().iloc[:, 0]
    assert abs(far.mean() - 64 * p) < 0.7 and far.max() <= decontamination.RADIUS


def test_very_long_urls_and_html(spark):
    rows = spark.createDataFrame([(1, "http://" + "a." * 300 + "example.org/en/1" + "x" * 200_000, None), (2, "http://q.com/de/", "<p>" * 300_000 + '<link rel="canonical" href="http://b/' + "y" * 100_000 + '">')], "page_id int, url string, html string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r["id"]: (r["verdict"], r["rule"], len(r["path"])) for r in url_filters.judge(rows, rules, url_filters.link_edges(rows)).collect()}
    assert got == {1: ("block", "example.org/en/1", 200_005), 2: ("block", "com/de/", 4)}
