"""The operators of quarry.llm against brute force, on odd cases and the smallest tables."""

import base64
import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers as P
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, byte_bpe, embeddings, language, licenses, near_text, packing, quality, secrets, simhash, token_counts, warc
from quarry.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, value string"
LONG = "Lorem ipsum dolor sit amet, " * 20_000
TEXTS = [
    None, "", " ", "word", "word", "A  two\n\n three\t x ", "ΑΣ ΣΑΣ İstanbul é é", "😀 emoji <|endoftext|> x\x1cy", "Ünïcödé ١٢٣ 中文字符",
    "password = hunter2hunter2 and token:abc12 AKIA" + "A1" * 10 + " " + "0123456789abcdef" * 2, "All rights reserved. CC-BY cc by General Public  License",
    "Licensed under the Apache License, Version 2.0. all all rights reserved", "don't we'll IT'S 1234 a--b ...", LONG, "the same five words " * 30,
    "line one here\nline one here\n\nline two", "\x00nul \x85next line",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}", None, "x", None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_byte_bpe_is_the_library(spark, docs, none):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    out = bpe.encode(docs, "text", path, bpe.lexicon(docs, "text", path), bpe.round_trip, "n_tokens long, ids_sha256 string, decoded_sha256 string", ("doc_id", "text")).collect()
    assert len(out) == docs.count()
    for r in out:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(want.encode()).hexdigest())
    assert bpe.encode(none, "text", path, bpe.lexicon(none, "text", path), bpe.round_trip, "n_tokens long, a string, b string").count() == 0


def test_lexicon_numbers_words(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["a", "ab", "abc", "bc", "tap", "taps", "top", "tops", "é"])}
    def lexicon(words):
        (tmp_path / "lexicon").write_bytes(byte_bpe.Lexicon.compiled(words))
        return byte_bpe.Lexicon(str(tmp_path / "lexicon"))

    x = lexicon(words)
    asked = [*words, b"", b"t", b"ta", b"zz", b"abcd"]
    got = x.ids_of(asked)
    assert [None if g is None else np.frombuffer(g, "<u4").tolist() for g in got] == [words.get(w) for w in asked]
    assert len(x.final) < sum(len(w) for w in words)  # suffixes are shared
    assert lexicon({}).ids_of([b"a"]) == [None]


def test_classes_of_characters_are_the_library_s():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    v = byte_bpe.vocabulary(P.path("byte_bpe_50k.json"))
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]):
        s = f"a{c}1{c}."
        if not byte_bpe.DOUBTFUL.search(s):
            assert [m.span() for m in v.words.finditer(s)] == [o for _, o in t.pre_tokenizer.pre_tokenize_str(s)], hex(ord(c))


def test_token_counts_allocate_crossings():
    n, crossing = token_counts.shares(np.array([2, 5, 9]), np.array([3, 4, 9]))
    # Bytes 2-5 lie one each in three sections: the earliest takes the token.
    assert n.tolist() == [2, 0, 1] and crossing.tolist() == [1, 0, 0]
    assert token_counts.shares(np.array([], int), np.array([3]))[0].tolist() == [0]


def test_token_counts_add_up(spark, docs):
    path = P.path("byte_bpe_50k.json")
    rows = token_counts.line_tokens(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "doc_id", "text", path).collect()
    t, by = Tokenizer.from_file(path), defaultdict(int)
    for r in rows:
        by[r.doc_id] += r.n_tokens
        assert r.start < r.end
    for i, x in enumerate(TEXTS):
        assert by[i] == (len(t.encode(x or "", add_special_tokens=False).ids) if "<|" not in (x or "") else by[i])


def line_counts(tokenizer, text):
    """Tokens of each line by brute force: a token goes to the line with most of its bytes, the earliest of equals."""
    ends = [i + 1 for i, c in enumerate(text.encode()) if c == 10]
    size = len(text.encode())
    ends += [size] if size and (not ends or ends[-1] != size) else []
    starts, n = [0, *ends[:-1]], [0] * len(ends)
    byte = [sum(len(c.encode()) for c in text[:i]) for i in range(len(text) + 1)] if len(text) < 3000 else None
    at, data = 0, text.encode()
    for i in tokenizer.encode(text, add_special_tokens=False).ids:
        piece = byte_bpe.vocabulary(P.path("byte_bpe_50k.json")).tokens[i]
        assert data[at : at + len(piece)] == piece
        shares = [max(0, min(e, at + len(piece)) - max(b, at)) for b, e in zip(starts, ends, strict=True)]
        n[shares.index(max(shares))] += 1
        at += len(piece)
    assert at == size and (byte is None or byte[-1] == size)
    return n


def test_token_counts_by_line(spark, sf):
    """All rows of op2 on the smallest tables whose texts are short enough for brute force, repeated rows and null ids too."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i, x) for i, x in enumerate(TEXTS) if "<|" not in (x or "") and len(x or "") < 3000]
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") < 3000]
    rows += [rows[9], (None, "a\nb  \n\n c")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = defaultdict(list)
    for r in token_counts.line_tokens(d, "doc_id", "text", P.path("byte_bpe_50k.json")).collect():
        out[r.doc_id].append((r.section, r.n_tokens))
    want = defaultdict(list)
    for i, x in rows:
        want[i] += list(enumerate(line_counts(t, x or "")))
    assert {k: sorted(v) for k, v in out.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert token_counts.line_tokens(d.limit(0), "doc_id", "text", P.path("byte_bpe_50k.json")).count() == 0


def test_packing(spark, docs, none):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = packing.pack(docs, "doc_id", "text", path, size=64, most=3, ids=True).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    for i, x in enumerate(TEXTS):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        own = sorted(pieces[i], key=lambda r: r.piece)[:: 2 if i == 3 else 1]
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.start == 64 * r.piece for r in own)
    assert packing.pack(none, "doc_id", "text", path).count() == 0


def test_packer_is_best_fit():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    p = packing.Packer(10, 2)
    assert [p.place(n)[0] for n in (9, 8, 7, 1)] == [0, 1, 2, 1]  # bin 0 was the fullest and closed


def test_fingerprints_and_components(spark, docs, none, sf):
    for d in (docs.where("doc_id IS NOT NULL"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        rows = d.collect()
        fps = {}
        for r in rows:
            w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
            counts = [0] * 64
            for x, n in Counter(s).items():
                h = xxhash.xxh64_intdigest(x.encode(), 42)
                counts = [c + n * (h >> b & 1) for b, c in enumerate(counts)]
            fps[r.doc_id] = sum(1 << b for b in range(64) if 2 * counts[b] > len(s))
        out = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.grouped(d, "doc_id", "text").collect()}
        assert {k: v[0] for k, v in out.items()} == fps
        assert {k: v[1] for k, v in out.items()} == brute(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert simhash.grouped(none, "doc_id", "text").count() == 0


def brute(items, linked):
    ids, label = sorted(items), {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[a] != label[b] and linked(items[a], items[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = {base}
    while len(fps) < 120:
        x = base if rng.random() < 0.5 else int(rng.choice(list(fps)))
        for b in rng.integers(0, 62, 2):
            x ^= 1 << int(b)
        fps.add(x)
    monkeypatch.setattr(simhash, "BUCKET", 5)
    got = connected_components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()
    assert {r.node: r.component for r in got} == {k: v for k, v in brute({x: x for x in fps}, lambda a, b: (a ^ b).bit_count() <= 2).items() if k in {r.node for r in got}}


def test_thresholds_cover_the_distance():
    assert sum(t + 1 for t in simhash.thresholds([[0, 1, 9, 99], [0, 50, 60, 70], [0, 2, 3, 99]], 2)) == 3
    assert simhash.thresholds([[0, 1, 9, 99], [0, 50, 60, 70], [0, 2, 3, 99]], 2) == [0, -1, 1]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (40, 0)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_text_finds_resembling_texts(spark, none):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    rows, sets = [], {}
    for g in range(12):
        base = list(rng.choice(words, 150))
        for k in range(6):
            w = list(base)
            for p in rng.integers(0, 150, k):
                w[p] = str(rng.choice(words))
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "short"), (len(rows) + 3, "short")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for i, t in rows:
        sets[i] = frozenset(near_text.shingle_hashes(t or "", 5).tolist())
    want = brute(sets, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    for crowd in (64, 2):
        assert {r.doc_id: r.component_id for r in near_text.groups(d, "doc_id", "text", crowd=crowd, bucket=3).collect()} == want
    kept = near_text.one_of_each(d.unionAll(d), "doc_id", "text")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert near_text.one_of_each(none, "doc_id", "text").count() == 0


def test_near_text_links_exactly_what_resembles(spark):
    """Short texts, for which wide fingerprints' bits say little: 12 words of which the last differs (7 of 9 shingles), and 12 of 15."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        w = [f"v{x}" for x in rng.choice(10**6, 40, replace=False)]
        rows += [w[:12], [*w[:11], w[20]], w[:16], [*w[:16], *w[30:33]]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    sets = {i: frozenset(near_text.shingle_hashes(t, 5).tolist()) for i, t in rows}
    want = {}
    for i in range(0, len(rows), 4):
        want |= brute({k: sets[k] for k in range(i, i + 4)}, lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_text.groups(d, "doc_id", "text").collect()} == want


def test_near_text_links_no_pair_below(spark):
    """300 pairs of short texts at 7 of 9 shingles: estimated by bits, some looked sure."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        w = [f"v{x}" for x in rng.choice(10**6, 13, replace=False)]
        rows += [" ".join(w[:12]), " ".join([*w[:11], w[12]])]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert near_text.groups(d, "doc_id", "text").where("doc_id <> component_id").count() == 0


def test_prefixes_meet_in_any_order():
    rng = np.random.default_rng(9)
    for n in range(1, 120):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        for drop in range(n // 5 + 1):
            b = a[rng.permutation(n)[drop:]]
            if len(b) < 0.8 * n:
                continue
            common = (a[::3], rng.integers(3, 9, len(a[::3])))
            one, two = (near_text.prefix(np.sort(x), 0.8, common) for x in (a, b))
            assert len(np.intersect1d(one, two))


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", "é" * 3_000_000), (6, "u", "\r\n\r\nWARC/1.0\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.archived(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read(index).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    for i, _, h in rows:
        assert got[i].payload_bytes == len((h or "").encode()) and (got[i].record_type == "revisit" or got[i].html == (h or ""))
    for r in index.collect():
        data = open(r.archive.removeprefix("file://"), "rb").read()[r.offset : r.offset + r.length]
        assert zlib.decompress(data, 31).startswith(warc.VERSION)
    assert warc.archived(pages.limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (None, "a"), (None, "z"), (None, "z"), (3, "b"), (3, "c")]
    pages = spark.createDataFrame([(i, None, h, 0) for i, h in rows], "page_id long, url string, html string, refers_to int")
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.archived(pages, f"file://{tmp_path}/w")).collect()), key=repr)
    b32 = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    kind = lambda i, h: ("revisit", 2) if h == "a" and i != 2 else ("response", None)
    assert got == sorted(((i, b32(h), *kind(i, h)) for i, h in rows), key=repr)


def test_warc_of_a_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    largest = {}
    for r in pages:
        largest[r.html or ""] = max(largest.get(r.html or "", r.page_id), r.page_id)
    want = {r.page_id: (len((r.html or "").encode()), base64.b32encode(hashlib.sha1((r.html or "").encode()).digest()).decode(), "response" if largest[r.html or ""] == r.page_id else "revisit", None if largest[r.html or ""] == r.page_id else largest[r.html or ""]) for r in pages}
    assert {r[0]: tuple(r)[1:5] for r in warc.op4_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == want


def test_records_whatever_the_chunks():
    raw = [warc.record(i, "u", bytes([65 + i]) * i * 7, None) for i in range(9)]
    whole = b"".join(raw)
    for size in (1, 2, 3, 5, 11, 64, 100_000):
        assert list(warc.records(whole[i : i + size] for i in range(0, len(whole), size))) == raw
    packed = b"".join(map(warc.member, raw))
    assert b"".join(warc.inflated(io.BytesIO(packed), 7)) == whole
    with pytest.raises(ValueError):
        list(warc.records(iter([whole[:-30]])))


def test_secret_base_spans_and_ownership(spark, docs, none):
    rows = {r.doc_id: r.spans for r in secrets.judged(docs, "text", "source", "doc_id", {"doc_id": "doc_id"}).collect()}
    patterns = [(k, re.compile(p, re.A), g, n) for k, p, g, n in (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))]
    for i, t in enumerate(TEXTS):
        want = sorted((m.start(), j, m.end()) for j, (_, p, g, n) in enumerate(patterns) for m in p.finditer(t or "") if len(m[g]) >= n)
        assert [(s["start"], s["rank"], s["end"]) for s in rows[i] if s["kind"] != "live"] == want
    held = [("k1", o, f"r{i}") for i, o in enumerate("abcde")] + [("k2", "a", "r1"), ("k2", "a", "r1")] + [("k3", "a", "r1"), ("k3", "b", "r2")]
    got = {r.value: (r.n_owners, r.n_repos, r.verdict) for r in secrets.ownership(spark.createDataFrame(held, "value string, owner string, repo string")).collect()}
    assert got == {"k1": (5, 5, "example"), "k2": (1, 1, "live"), "k3": (2, 2, "shared")}
    clean = {r.doc_id: r.text for r in secrets.redacted(docs, "text", "source", "doc_id").collect()}
    assert clean[9] == "[REDACTED] and token:abc12 [REDACTED] [REDACTED]" and clean[0] is None and clean[3] == "word"
    assert secrets.redacted(none, "text", "source", "doc_id").count() == 0


def test_secret_columns_of_a_table(spark, sf):
    """op5's base columns, computed from the contract's patterns alone."""
    patterns = [("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    texts_ = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in secrets.op5_secrets(spark, sf).collect():
        found = sorted((m.start(), j, m.end(), k) for j, (k, p, g, n) in enumerate(patterns) for m in re.compile(p, re.A).finditer(texts_[r.doc_id]) if len(m[g]) >= n)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(f[1] == j for f in found) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))


def test_own_spans_of_many_tokens():
    rng = np.random.default_rng(2)
    text = " ".join("".join(rng.choice(list("0123456789abcdefXYZ"), int(rng.integers(10, 50)))) if rng.random() < 0.5 else f"token={rng.integers(1 << 60):x}" for _ in range(400))
    base = secrets.base_spans(text)
    want = [m.span() for m in secrets.LONG_TOKEN.finditer(text) if secrets.looks_random(m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
    assert [(s, e) for s, _, e, _ in secrets.own_spans(text, base)] == want and want


def test_keys_of_many_documents_or_two_owners_are_found(spark):
    """A key in many documents of its owner, one copied to a second owner, and an example that four have."""
    many, copied, example = (f"ghp_{x}9Xq2LmZ7tRw4Kc8Vb1Ns6Yd3Hf5Jg0Pa" for x in ("One1", "Two2", "Ex4m"))
    rows = [(many, "a")] * 12 + [(copied, "a"), (copied, "b")] + [(example, o) for o in "abcd"]
    d = spark.createDataFrame([(i, f"Authorization: Bearer {k} end", "en", o, None, None, None) for i, (k, o) in enumerate(rows)], SCHEMA)
    found = {r.doc_id: [(s["kind"], s["verdict"]) for s in r.spans] for r in secrets.judged(d, "text", "source", "doc_id", {"doc_id": "doc_id"}).collect()}
    assert [found[i] for i in range(len(rows))] == [[("live", "live")]] * 12 + [[("live", "shared")]] * 2 + [[]] * 4
    clean = {r.doc_id: r.text for r in secrets.redacted(d, "text", "source", "doc_id").collect()}
    assert [clean[i] == "Authorization: Bearer [REDACTED] end" for i in range(len(rows))] == [True] * 14 + [False] * 4


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    rows, centre = [], rng.standard_normal((6, 16))
    for i in range(240):
        v = centre[i % 6] + rng.standard_normal(16) * (0.08 if i % 4 else 0.4)
        rows.append((i, v.tolist(), i % 3))
    rows += [(240, rows[0][1], 0), (241, rows[0][1], 1), (242, rows[0][1], None), (243, None, 0), (244, [0.0] * 16, 0), (245, [float("nan")] + [1.0] * 15, 0), (246, [None] + [1.0] * 15, 0), (247, [], 0), (248, [1.0, 2.0], 0), (249, [2.0, 4.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.grouped(d, "vec_id", "embedding", "label").collect()}
    unit = {i: embeddings.unit(v) for i, v, l in rows if l is not None}
    label = {i: l for i, _, l in rows}

    def linked(a, b):
        return label[a] == label[b] and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.98 - 1e-12

    items = {i: i for i, _, l in rows if l is not None}
    part = brute(items, linked) | {242: 242}
    links = {i: sum(linked(i, j) for j in items if j != i) if i in items else 0 for i, _, _ in rows}
    assert got == {i: (links[i], part[i]) for i, _, _ in rows}
    assert embeddings.grouped(d.limit(0), "vec_id", "embedding", "label").count() == 0


def test_embeddings_repeated_and_null_ids(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, a, 0), (1, b, 0), (2, [2.0, 0.0, 0.2], 0), (None, a, 0), (None, [0.0, 0.0, 1.0], 0), (5, b, None), (5, None, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in embeddings.grouped(d, "vec_id", "embedding", "label").collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (1, 0, 1), (2, 3, 1), (None, 3, 1), (None, 0, None), (5, 0, 5), (5, 0, 5)], key=repr)


def test_planes_grow_and_keep_the_recall():
    for n in (0, 10, 10**5, 10**7, 10**9):
        planes, tables = embeddings.shape(n, 0.98)
        assert 14 <= planes <= 30 and 1 - (1 - (1 - np.arccos(0.98) / np.pi) ** planes) ** tables >= 0.9999 - 1e-12


def test_quality_of_odd_texts(spark, docs, none):
    rows = {r.doc_id: r for r in quality.judge(docs, "text", "source", {"doc_id": "doc_id"}).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {x for x in g if g.count(x) > 1} if len(g) < 3000 else set(g)
        at = {k + j for k, x in enumerate(g) if x in twice for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(at))
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines, rows[i].n_repeat_words) == want
        assert rows[i].base_failed == (len(w) < 10 or 100 * len(at) > 20 * len(w))
    assert quality.passed(none, "doc_id", "text", "source").count() == 0
    assert quality.passed(docs, "doc_id", "text", "source").columns == docs.columns


def test_bad_hosts_lose_soft_failures(spark):
    good = " ".join(f"word{i}" for i in range(30))
    soft = " ".join(f"### w{i} $$$" for i in range(30))
    rows = [(i, good, "g") for i in range(20)] + [(20, soft, "g")] + [(30 + i, soft, "b") for i in range(20)] + [(60, good, "b")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), "text", "source", {"doc_id": "doc_id"}).collect()}
    assert got[20] and got[60] and not any(got[30 + i] for i in range(20))


def test_cross_parsing_is_greedy_longest_match():
    model = language.Model({"x": "abracadabra alakazam", "y": "hocus pocus simsalabim"})

    def phrases(sample, text):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in sample:
                k += 1
            n, i = n + 1, i + k
        return n

    for t in ("abra kadabra", "hocus", "salabim abra"):
        rates, _ = model.phrase_rates([t])
        assert rates[0].tolist() == [phrases(f" {s} ", f" {t} ") / (len(t) + 2) for s in ("abracadabra alakazam", "hocus pocus simsalabim")]


def test_parse_of_whole_texts_in_both_forms(spark):
    """Real texts of any length, blocks by blocks, against a plain longest-match parse; and tables against searched arcs."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").limit(60).collect()
    samples = language.sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", "lang")
    samples = {k: v[:4000] for k, v in samples.items()}
    found = [r.text for r in rows] + ["", "12 34", "中文 字符 abc", "x" * 700]
    tables, arcs = language.Model(samples), language.Model(samples, cells=0)
    assert all(a.table is not None for a in tables.automata) and all(a.table is None for a in arcs.automata)
    rates, lettered = tables.phrase_rates(found)
    assert (arcs.phrase_rates(found)[0] == rates).all()
    clean = lambda x: " " + re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in x)).strip() + " "
    known = {c for v in samples.values() for c in clean(v)}
    for name, column in zip(tables.names, rates.T, strict=True):
        sample = re.sub(" +", " ", clean(samples[name]))
        for x, rate in zip(found, column.tolist(), strict=True):
            t = re.sub(" +", " ", clean(x)) if clean(x).strip() else " "
            if any(len(c) != 1 for c in t) or len(t) != len(" ".join(t.split()).join("  ")) or len(x) > 5000:
                continue
            n = 0
            for at in range(0, len(t), language.BLOCK):
                block, i = t[at : at + language.BLOCK], 0
                while i < len(block):
                    k = 1
                    if block[i] in known and block[i] in sample:
                        while i + k < len(block) and block[i : i + k + 1] in sample:
                            k += 1
                    n, i = n + 1, i + k
            assert abs(rate - n / len(t)) < 1e-9, (name, x[:50])


def test_sample_with_a_repeated_id(spark):
    """20,000 rows of one id don't crowd out another language; all of one text count once."""
    rows = [(7, f"aa word {i}" if i % 2 else "aa same", "aa") for i in range(20_000)] + [(i, f"zz other {i}", "zz") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.sample(d, "doc_id", "text", "lang")
    assert sorted(samples) == ["aa", "zz"] and samples["aa"].count("same") <= 1 and samples["zz"].count("other") > 100


def test_language_accuracy_and_odd_texts(spark, docs, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.op8_language(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    odd = {r.doc_id: r for r in language.identify(docs, "text", language.sample(docs, "doc_id", "text", "lang"), ("doc_id",)).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == "und" and odd[0].score == 0.0
    assert language.recognised(none, "doc_id", "text", "lang").count() == 0
    assert language.recognised(docs, "doc_id", "text", "lang").columns == docs.columns


def test_samples_hold_every_language_and_all_places(spark):
    rows = [(100 * k + i, ("opening " * 40 + f"word{k} " * 200) if k == 0 else f"talk{k} of language {k}", f"l{k:02}") for k in range(80) for i in range(30)]
    samples = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert sorted(samples) == [f"l{k:02}" for k in range(80)]
    assert "word0" in samples["l00"] and "opening" in samples["l00"]


def test_unlike_all_languages(spark):
    """Labelled documents stay; random letters, strings of consonants and a language without labels go."""
    rng = np.random.default_rng(5)
    drawn = lambda letters, n: "".join(rng.choice(list(letters), n))
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
    turkish = "butun insanlar hur haysiyet ve haklar bakimindan esit dogarlar akil ve vicdana sahiptirler ve birbirlerine karsi kardeslik zihniyeti ile hareket etmelidirler"
    odd = [drawn("abcdefghijklmnopqrstuvwxyz     ", n) for n in (150, 400, 3000)] + [drawn("bcdfghjklmnpqrstvwxz    ", n) for n in (150, 400, 3000)] + [finnish, turkish]
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    extra = spark.createDataFrame([(10**9 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")
    out = language.recognised(d.unionByName(extra, allowMissingColumns=True), "doc_id", "text", "lang")
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    lettered = {r.doc_id for r in d.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert lettered <= kept and not any(x >= 10**9 for x in kept)


def test_licenses(spark, docs, none):
    rows = {r.doc_id: r for r in licenses.scan(docs, "doc_id", "text").collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for label, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        assert (rows[i].n_words, rows[i].n_base, rows[i].first_word, rows[i].last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert rows[i].base_labels == ",".join(sorted({x for _, x in at}))
    assert rows[11].labels == "apache-2.0,reserved" and rows[10].labels == "cc-by,gpl,reserved"
    assert licenses.scan(none, "doc_id", "text").count() == 0


def test_clashing_names(spark):
    """Columns with the names that stages use inside."""
    rows = [(i, f"some words of text number {i} that are long enough for every rule here {i}", "en", "s", 1) for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    inner = ("__lang", "__score", "__rate", "__text", "__a", "__b", "__ka", "__kb", "__t", "__cuts", "__gone", "__twice", "__host")
    d = d.select("*", *(F.lit("x").alias(c) for c in inner))
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns and all(r[c] == "x" for r in out.collect() for c in inner)
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() == 6


def test_pipeline_against_brute_force(spark, sf):
    """Each stage on what the one before it kept, and the whole, on the smallest tables."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id: r for r in stages["language id"](spark, docs, sf).collect()}
    # Language: clean labelled texts stay, texts without a letter go, labels stay as they are.
    assert {i for i, r in rows.items() if r.lang and any(c.isalpha() for c in r.text or "")} <= set(kept)
    assert not any(not any(c.isalpha() for c in rows[i].text or "") for i in kept)
    assert all(kept[i].lang == rows[i].lang for i in kept if rows[i].lang)

    good = {r.doc_id: r for r in stages["quality rules"](spark, spark.createDataFrame(list(kept.values()), docs.schema), sf).collect()}
    measures, hosts = {}, defaultdict(list)
    for i, r in kept.items():
        t = r.text
        w = re.findall("[^\x20\x09-\x0d]+", t)
        g = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        chars, symbols, twice = sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
        base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        soft = chars < 2 * len(w) or chars > 15 * len(w) or 100 * symbols > 10 * chars or 100 * twice > 30 * len(lines)
        measures[i] = base, soft
        hosts[r.source].append(base or soft)
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean, var = sum(rates) / len(rates), np.var(rates)
    weight = max(mean * (1 - mean) / var - 1 if var else 10.0, 0.0)
    bad = {h for h, x in hosts.items() if (sum(x) + mean * weight) / (len(x) + weight) > 0.5}
    assert set(good) == {i for i, (base, soft) in measures.items() if not base and not (soft and kept[i].source in bad)}

    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) for i, r in good.items() for w in [re.sub("[A-Z]", lambda m: m[0].lower(), r.text).split()]}
    groups = brute(sets, lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b))
    distinct = {r.doc_id: r for r in stages["near duplicates"](spark, spark.createDataFrame(list(good.values()), docs.schema), sf).collect()}
    assert set(distinct) == set(groups.values())

    clean = {r.doc_id: r for r in stages["secret scans"](spark, spark.createDataFrame(list(distinct.values()), docs.schema), sf).collect()}
    holders = defaultdict(set)
    spans = {}
    for i, r in distinct.items():
        base = secrets.base_spans(r.text)
        spans[i] = base + secrets.own_spans(r.text, base)
        for x in spans[i]:
            holders[x[3]].add(r.source)
    for i, r in distinct.items():
        text, cuts = r.text, sorted((s, e) for s, _, e, x in spans[i] if len(holders[x]) < 4)
        out, done = "", 0
        for s, e in cuts:
            if s >= done:
                out += text[done:s] + "[REDACTED]"
            done = max(done, e)
        assert clean[i].text == out + text[done:] and clean[i].n_chars == len(clean[i].text)

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        pieces[r.doc_id] += r.length
    assert dict(pieces) == {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in clean.items()}


def test_pipeline_on_small_tables(spark, sf, docs, none):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).count() > 0
    for d in (docs, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, sf)
            assert out.columns == d.columns
            out.count()


@pytest.mark.parametrize("name", ["op4_warc", "op6_embeddings", "op7_quality"])
def test_same_rows_as_sql(spark, sf, name):
    import duckdb

    from quarry.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
