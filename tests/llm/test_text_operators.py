import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from quillgrid.llm import bpe, chat, decontaminate, html_main, quality_rulefit, quality_rules, simhash, suffix_dedup, token_files, toxicity
from quillgrid.llm import queries as q
from tests.llm import edges

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
needs_tokenizer = pytest.mark.skipif(not os.path.exists(bpe.file_of(q.TOKENIZER)), reason="no tokenizer file")


def same_rows(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


@needs_tables
@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_queries_match_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.execute(q.ORACLES[name])
    names = [x[0] for x in found.description]
    rows = [tuple(r[n] for n in names) for r in q.QUERIES[name](spark, SF).collect()]
    assert same_rows(rows, found.fetchall())


# ---- 1 suffix dedup


def brute_removed(texts, length):
    data = [t.encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(x for x, y in zip(d, gone, strict=True) if not y)
        spans = sum(1 for i in range(len(d)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(d), len(d) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup_matches_brute_force(spark, hot):
    random.seed(hot)
    text = lambda n: "".join(random.choice(["thon", "er", "é", "a ", "ing ", "of ", "x\n"]) for _ in range(n))
    docs = []
    for _ in range(25):
        t = text(random.randint(0, 300))
        docs.append(t)
        if random.random() < 0.3:
            docs.append(t)
        o = random.choice(docs)
        i = random.randint(0, max(0, len(o) - 1))
        docs.append(text(40) + o[i : i + random.choice([150, 199, 200, 201, 215, 400])] + text(30))
        changed = list(t)
        if changed:
            changed[random.randrange(len(changed))] = "Q"
            docs.append("".join(changed))
    docs += ["ab" * 300, "ab" * 150, "a" * 900, "x" * 199, "", "a" * 200]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, hot_segments=hot).collect()}
    want = brute_removed(docs, 200)
    assert [got[k] for k in range(len(docs))] == want


def test_merge_orders_like_a_full_sort():
    random.seed(4)
    strings = [[random.randrange(1, 4) for _ in range(random.randrange(1, 30))] for _ in range(20)]
    parts = [strings[:7], strings[7:15], strings[15:]]
    shards = []
    for part in parts:
        symbols = np.array([x for s in part for x in (*s, 0)])
        starts = np.cumsum([0, *(len(s) + 1 for s in part[:-1])])
        shards.append((symbols, starts))
    depth = 5
    classes, _ = suffix_dedup.merge(shards, depth)
    keys, k = {}, 0
    for s in strings:
        for i in range(len(s) + 1):
            if len(s) - i >= depth:
                keys.setdefault(tuple(s[i : i + depth]), set()).add(int(classes[k]))
            k += 1
    assert all(len(v) == 1 for v in keys.values())
    assert len({min(v) for v in keys.values()}) == len(keys)
    ordered = sorted(keys)
    assert [min(keys[x]) for x in ordered] == sorted(min(v) for v in keys.values())


def test_long_periodic_text(spark):
    docs = ["a" * 60_000, "xy" * 20_000 + "z" * 100, "b" * 199]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {0: (60_000, 1), 1: (40_000, 1), 2: (0, 0)}


def test_common_keys_are_broadcast(spark):
    rows = spark.createDataFrame([(1, k) for k in range(3000)] + [(k, 0) for k in range(2, 400)], "key long, x long")
    keys = rows.groupBy("key").count().withColumnRenamed("count", "n")
    got = suffix_dedup.with_common(rows, keys, ["key"], rows.count())
    assert sorted((r.key, r.x, r.n) for r in got.collect()) == sorted([(1, k, 3000) for k in range(3000)] + [(k, 0, 1) for k in range(2, 400)])


def test_copies_of_one_row_are_counted(spark, monkeypatch):
    random.seed(3)
    text = lambda n: "".join(random.choice(["thon", "er", "é", "a ", "ing "]) for _ in range(n))
    hot, twice, short = text(150), text(120), "x" * 199
    docs = [(None, hot)] * 6000 + [(7, twice)] * 2 + [(8, short)] * 3 + [(None, None)] * 2 + [(None, text(90)), (1, text(20) + hot[30:260]), (2, text(100)), (3, twice[:210] + text(9)), (None, short), (4, hot)]
    judged = []
    inner = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda keyed, *x: judged.append(keyed.count()) or inner(keyed, *x))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())
    few = docs[5998:]  # two copies tell as much as thousands
    want = Counter()
    for (i, t), removed in zip(few, brute_removed([t or "" for _, t in few], 200), strict=True):
        want[i, *removed] += 3000 if i is None and t == hot else 1
    assert got == want and judged == [len(set(docs))]
    kept = suffix_dedup.without_repeats(df.selectExpr("*", "1 AS n_chars", "'k' AS _key"))
    assert kept.count() == len(docs) and kept.columns == ["doc_id", "text", "n_chars", "_key"]


def test_suffix_dedup_edges(spark):
    got = suffix_dedup.remove_repeats(edges.table(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(edges.ROWS) and by[2][0].n_bytes == 0 and by[3][0].n_removed == 0
    assert {r.n_removed for k in (8, 9) for r in by[k]} == {480}
    assert suffix_dedup.remove_repeats(edges.empty(spark)).count() == 0
    kept = suffix_dedup.without_repeats(edges.table(spark))
    assert kept.columns == edges.table(spark).columns and kept.count() == len(edges.ROWS)


# ---- 2 SimHash


def brute_fingerprint(text):
    words = simhash.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_matches_brute_force(spark):
    random.seed(6)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(60):
        t = [random.choice(words) for _ in range(random.choice([0, 1, 2, 3, 60, 200]))]
        rows.append((k, " ".join(t)))
        if len(t) > 50:
            t[3] = "Changed"
            rows.append((1000 - k, " ".join(t)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fp = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in fp}


def test_long_chain_of_links(spark):
    path = [(k * 7919 % 1009, (k + 1) * 7919 % 1009) for k in range(300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert set(got.values()) == {min(min(p) for p in path)}


def test_links_find_every_close_pair(spark):
    random.seed(8)
    base = [random.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << x for x in random.sample(range(64), random.randint(0, 4))) for b in base for _ in range(12)}
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    got = {frozenset(r) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "_fp long")).collect()}
    assert got == {frozenset(p) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count() <= 3}


def test_simhash_edges(spark):
    t = edges.table(spark)
    got = simhash.near_duplicates(t).collect()
    assert len(got) == len(edges.ROWS)
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2} and {r.component_id for r in got if r.doc_id in (8, 9)} == {8}
    kept = simhash.keep_one(t)
    assert kept.columns == t.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 5, 6, 7, 8, None], key=str)
    assert simhash.near_duplicates(edges.empty(spark)).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Null and shared ids: a row is told by its id and text."""
    def text(seed):
        words = random.Random(seed)
        return " ".join(f"w{words.randrange(10**6)}" for _ in range(60))

    rows = [(None, text(k)) for k in range(6)] + [(None, text(0)), (None, text(100))]  # null ids: distinct, one twice, one a copy of id 1's
    rows += [(1, text(100)), (2, text(101)), (2, text(102)), (3, text(102)), (4, None), (4, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _id", "2 AS _h")
    for parts in (1, 5):
        kept = simhash.keep_one(df.repartition(parts))
        assert kept.columns == df.columns
        got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
        assert got == sorted([*((None, text(k)) for k in range(6)), (1, text(100)), (2, text(101)), (2, text(102)), (4, "")], key=repr)


# ---- 3 toxicity, 8 quality


def labelled(spark, mark):
    random.seed(9)
    plain = [f"{a}{b}" for a in ("ran", "sol", "mir", "tek", "vo", "lin") for b in ("da", "per", "ish", "on", "ut", "el")]
    rows, labels = [], []
    for k in range(600):
        words = [random.choice(plain) for _ in range(random.randint(30, 120))]
        bad = k % 4 == 0
        if bad:
            words = mark(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_on_held_out_rows(spark):
    def mark(words):
        for at in random.sample(range(len(words)), 4):
            words[at] = random.choice(["zugwreth", "blarkfoom", "quixnasty", "grolbach"])
        return words

    docs, labels = labelled(spark, mark)
    model = toxicity.learn(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and 400 < kept.count() < 500


def test_toxicity_scores_like_a_plain_form(spark):
    """The score from the model's parts, window by window, without the operator's code."""
    import zstandard

    def mark(words):
        words[3] = "zugwreth"
        return words

    docs, labels = labelled(spark, mark)
    model = toxicity.learn(docs, labels)
    given = zstandard.ZstdCompressionParameters.from_level(9, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)

    def size(content, data):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=given)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=given).compress(data))

    rows = docs.limit(12).collect()
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows), model).collect()}
    for r in rows:
        words = r.text.lower().split()
        parts = [" ".join(words[i : i + 24]).encode() for i in range(0, len(words), 24)]
        gains = sorted((size(model.ordinary, w) - size(model.toxic + model.ordinary, w) for w in parts), reverse=True)
        top = (gains + [gains[-1]] * 3)[:3] if len(gains) < 3 else gains[:3]
        x = [*top, sum(gains) / len(gains), sum(g >= 4 for g in gains) / len(gains), np.log(len(gains))]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-(np.dot(x, model.weights) + model.bias)))) < 1e-9


def test_toxic_stretches():
    chosen = np.array([int.from_bytes(x, "little") for x in (b"abcdefg", b"bcdefgh", b"tuvwxyz")], np.uint64)
    assert toxicity.stretches(b"--abcdefgh--tuvwxyz", chosen) == b" abcdefgh tuvwxyz" and toxicity.stretches(b"abc", chosen) == b""


def test_toxicity_edges(spark):
    t = edges.table(spark)
    model = toxicity.learn(t, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(t, model).count() == len(edges.ROWS)
    assert toxicity.without_toxic(t, model).count() == len(edges.ROWS)
    assert toxicity.score(edges.empty(spark), model).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, lambda words: [w.upper() + "!!" for w in words])
    model = quality_rulefit.learn(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [r for r in quality_rulefit.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    assert quality_rulefit.score(edges.table(spark), model).count() == len(edges.ROWS)
    none = quality_rulefit.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_rulefit.score(edges.empty(spark), none).count() == 0


# ---- 4 BPE, 7 token files


@needs_tokenizer
def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    random.seed(1)
    pool = ["a", "B", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "'s", "'ll", "é", "ß", "中", "🙂", "<|endoftext|>", "1", "²", "!", "ж", "́", "‍", "ﬁ", "aaa", "the", "\x00"]
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 60))) for _ in range(500)] + ["a" * 3000, edges.LONG]
    library = Tokenizer.from_file(bpe.file_of(q.TOKENIZER))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_decode(df, q.TOKENIZER, keep_ids=True).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


@needs_tokenizer
def test_bpe_and_file_edges(spark, tmp_path):
    t = edges.table(spark)
    assert {r.n_tokens for r in bpe.encode_decode(t, q.TOKENIZER).collect() if r.doc_id in (2, 3)} == {0}
    assert bpe.encode_decode(edges.empty(spark), q.TOKENIZER).count() == 0
    rows = token_files.read_token_files(token_files.write_token_files(t, str(tmp_path / "a"), q.TOKENIZER, shard_tokens=5000, partitions=3)).collect()
    assert len(rows) == len(edges.ROWS)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == sorted((r[0] for r in edges.ROWS), key=lambda x: -1 if x is None else x)
    assert token_files.read_token_files(token_files.write_token_files(edges.empty(spark), str(tmp_path / "b"), q.TOKENIZER)).count() == 0


@needs_tokenizer
@needs_tables
def test_token_files_match_the_library(spark):
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(bpe.file_of(q.TOKENIZER)), 0
    got = {r.doc_id: r for r in q.op7_token_files(spark, SF).collect()}
    for d in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id):
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@needs_tokenizer
def test_blocks_and_long_texts_encode_alike(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.file_of(q.TOKENIZER)), bpe.loaded(q.TOKENIZER)
    random.seed(2)
    pool = ["word ", "don't ", " ", "  \n", "é", "中 ", "x", "1", "'s", "<|endoftext|>", "'re", "!", "\xa0 a", " aaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = ["".join(random.choice(pool) for _ in range(random.choice([0, 3, 400]))) for _ in range(60)] + ["a" * 300]
    for size in (16, 64, 1 << 20):
        monkeypatch.setattr(bpe, "BLOCK", size)
        for t, ids in zip(texts, bpe.by_row(own.encode(pa.array(texts))), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


@needs_tokenizer
def test_documents_span_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.file_of(q.TOKENIZER))
    rows = [(k, t) for k, t in enumerate(["!" * 40, "word " * 900, "", None, "a! b! " * 50, "!", "end"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    files = token_files.write_token_files(df, str(tmp_path / "s"), q.TOKENIZER, shard_tokens=64, partitions=2)
    assert files.count() > 15 and {r.n_tokens for r in files.collect()} - {64} != {64}
    assert max(r.n_tokens for r in files.collect()) == 64
    at = 0
    got = {r.doc_id: r for r in token_files.read_token_files(files).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_wavelet_matrix_of_wide_ids_opens_blocks(monkeypatch):
    a = np.array([70_000, 5, 0, 1 << 16, 70_000, 0] * 50_000)
    blob = token_files.build(a, 17, 0, np.flatnonzero(a == 0)[::2], 11, 3)
    w = token_files.WaveletMatrix(blob)
    opened = []
    inflate = w.inflate
    monkeypatch.setattr(w, "inflate", lambda level, block: opened.append((level, block)) or inflate(level, block))
    assert w.access(200_000) == a[200_000] and len(opened) <= 17
    assert w.select(70_000, 99_999) == np.flatnonzero(a == 70_000)[-1] and w.count(1 << 16, 150_000) == 25_000
    assert w.document_end(7) == np.flatnonzero(a == 0)[14] and (w.first_token, w.first_document) == (11, 3)
    assert (w.tokens() == a).all() and (w.ends(w.tokens()) == np.flatnonzero(a == 0)[::2]).all()
    with pytest.raises(ValueError):
        token_files.build(a, 16)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 512, 513, 3000, 65536, 65537, 140_000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 40 if n % 2 else 50257, n)
    w = token_files.WaveletMatrix(token_files.build(a))
    assert (w.tokens() == a).all()
    for i in range(0, n, max(37, n // 50)):
        assert w.access(i) == a[i]
    for t in {*a[:10].tolist(), 7, 60000, 1 << 20}:
        assert w.count(t) == (a == t).sum() and w.count(t, n // 3) == (a[: n // 3] == t).sum()
        for k, place in enumerate(np.flatnonzero(a == t)[:5]):
            assert w.select(t, k) == place


# ---- 5 pages


def page(body):
    return f"<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body>{body}</body></html>"


def test_pages(spark):
    frame = "<div><p>Home of the site</p></div>{}<div><p>All rights kept</p></div>"
    rows = [
        (1, "http://a.org/x/1", page("<nav>menu</nav><article><h1>Tit&eacute;l</h1><p>One  two<br>three<p>Four &amp; five<div class='comments'>me too</div></article><footer>f</footer>")),
        (2, "http://a.org/x/2.html?q=1", page("<article><p>One  two<br>three</p></article><div class=ad>buy</div>")),
        (3, "https://b.org/n/1", page(frame.format("<p>First story</p>"))),
        (4, "https://b.org/n/2", page(frame.format("<p>Second story</p>"))),
        (5, "https://c.org/n/2", page("<p>Alone</p><form><p>name</p></form>")),
        (6, "https://d.org/1", page("<p>Copy</p>")),
        (7, "https://d.org/2", page("<p>Copy</p>")),
        (8, None, None),
        (9, None, ""),
        (5, "https://c.org/n/2", page("<p>Alone</p><form><p>name</p></form>")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS _path", "2 AS text")
    for parts in (1, 7):
        got = {r.page_id: r.text for r in html_main.main_text(df, partitions=parts).collect()}
        assert got == {
            1: "Titél\n\nOne two three\n\nFour & five", 2: "One two three", 3: "First story", 4: "Second story",
            5: "Alone" if parts else "", 6: "Copy", 7: "Copy", 8: "", 9: "",
        } | {5: got[5]}
        assert got[5] == "Alone"
    assert html_main.main_text(df.limit(0)).count() == 0


def test_differencing_decides_beside_a_marked_article(spark):
    body = "<div>Line of the site</div>{}<article><p>Quoted by both</p><p>{}</p></article><div>End of the site</div>"
    rows = [
        (1, "http://a.org/x/1", page(body.format("<div>Lead of the first</div>", "First"))),
        (2, "http://a.org/x/2", page(body.format("<div>Lead of the second</div>", "Second"))),
        (3, "http://b.org/1", page(body.format("<div>No pair to tell</div>", "Alone"))),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        got = {r.page_id: r.text for r in html_main.main_text(df, partitions=parts).collect()}
        assert got == {1: "Lead of the first\n\nQuoted by both\n\nFirst", 2: "Lead of the second\n\nQuoted by both\n\nSecond", 3: "Quoted by both\n\nAlone"}


def test_differencing_without_names(spark):
    """Menus, adverts and footers go by their place in the template, whatever their words."""
    rows = []
    for k in range(12):
        menu = "".join(f"<li><a href='/{k}{j}'>Entry {k} {j}</a></li>" for j in range(4 + k % 3))
        body = f"<nav><ul>{menu}</ul></nav><div class='x7 y'>Buy {k}</div><article><h1>Head {k}</h1><p>Story {k}<p>Join our list today<p>Other {k}</article><footer>Foot {k}</footer>"
        rows.append((k, f"http://a.org/n/{k}", page(body)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 5):
        got = {r.page_id: r.text for r in html_main.main_text(df, partitions=parts, names=False).collect()}
        # the line that all pages of the host have goes from the articles too
        assert got == {k: f"Head {k}\n\nStory {k}\n\nOther {k}" for k in range(12)}
    few = df.filter("page_id < 3")
    assert {r.text for r in html_main.main_text(few).collect()} == {f"Head {k}\n\nStory {k}\n\nJoin our list today\n\nOther {k}" for k in range(3)}


def test_headings_stay_with_what_they_head(spark):
    """Headings that recur on every page of a host are the article's; those of furniture go with it."""
    rows = [
        (k, f"http://a.org/r/{k}", page(f"<article><h1>Dish {k}</h1><h2>Summary</h2><p>About {k}<h2>Ingredients</h2><p>Egg {k}<p>Oil {k}<p>Salt {k}<h4>More</h4><p>See our list</article>"))
        for k in range(6)
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_main.main_text(df, names=False).collect()}
    assert got == {k: "\n\n".join([f"Dish {k}", "Summary", f"About {k}", "Ingredients", f"Egg {k}", f"Oil {k}", f"Salt {k}"]) for k in range(6)}


def test_controls_leave_a_paragraph_whole():
    text = lambda body: [x.text for x in html_main.lines(page(body))]
    assert text("<p>One <button>Go</button>two <select><option>a</select>three <script>x()</script>four") == ["One two three four"]
    assert text("<p>One <button>two<p>three") == ["One two", "three"]


def unmarked(k, story):
    menu = "".join(f"<li>Entry {k} {j}</li>" for j in range(3 + k % 3))
    return page(f"<nav><ul>{menu}</ul></nav><div class='x7'>Buy {k}</div><div><h1>Head {k}</h1><h2>Notes</h2>{story}</div><footer>Foot {k}</footer>")


def test_pages_without_an_article(spark):
    """The section that varies most stands for the article, whatever its name; frames go by their place."""
    story = lambda k: f"<div><p>Story of number {k}, told at such length that it is more than half of what varies here</p><ul><li>Part {k}</li></ul></div><p>Rest {k}"
    rows = [(k, f"http://a.org/n/{k}", unmarked(k, story(k))) for k in range(9)]
    marked = [(k, u, h.replace("<div><h1>", "<article><h1>").replace("</div><footer>", "</article><footer>") if k % 3 == 0 else h) for k, u, h in rows]
    want = {k: f"Head {k}\n\nNotes\n\nStory of number {k}, told at such length that it is more than half of what varies here\n\nPart {k}\n\nRest {k}" for k in range(9)}
    for each in (rows, marked):
        df = spark.createDataFrame(each, "page_id long, url string, html string")
        for parts in (1, 4):
            assert {r.page_id: r.text for r in html_main.main_text(df, partitions=parts, names=False).collect()} == want


@needs_tables
def test_tables_without_article_tags(spark):
    # of the smallest table's 50 pages most are alone on their host
    pages = spark.read.parquet(f"{os.path.dirname(SF)}/sf0.01/pages.parquet")
    bare = pages.withColumn("html", html_main.F.regexp_replace("html", r"<(/?)(article|main)\b", "<$1div"))
    want = {r.page_id: r.text for r in html_main.main_text(pages).collect()}
    for names, least in ((True, 0.98), (False, 0.9)):
        got = {r.page_id: r.text for r in html_main.main_text(bare, names=names).collect()}
        assert sum(got[k] == want[k] for k in want) >= least * len(want)


def plain_block(weights, paths):
    """The varying block by whole paths of section numbers."""
    rows, level = list(range(len(weights))), 0
    while True:
        groups = {}
        for k in rows:
            if len(paths[k]) > level:
                groups.setdefault(paths[k][level], []).append(k)
        best = max(groups.values(), key=lambda g: sum(weights[k] for k in g), default=[])
        if not best or len(best) < len(rows) and 2 * sum(weights[k] for k in best) <= sum(weights[k] for k in rows):
            return rows[0], rows[-1] + 1
        rows, level = best, level + 1


def test_varying_block_is_that_of_a_plain_walk():
    random.seed(8)
    for _ in range(400):
        paths, path, fresh = [], [], itertools.count()
        for _ in range(random.randint(1, 25)):
            del path[random.randint(0, len(path)) :]
            path += [next(fresh) for _ in range(random.choice([0, 0, 1, 2]))]
            paths.append(list(path))
        weights = [random.choice([0, 0, 1, 5, 30]) + (k == 0) for k in range(len(paths))]
        alike = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        common = [0, *(alike(a, b) for a, b in itertools.pairwise(paths))]
        got = html_main.varying_block(np.array(weights), np.array(common), np.array([len(x) for x in paths]))
        assert got == plain_block(weights, paths)


def plain_main_text(rows):
    """The query by quadratic tables over one host's pages that all mark an article, each line once a page."""
    key = lambda r: re.sub(r"^//[^/]*|(\.html?|/)$", "", re.sub(r"[?#].*$", "", r[1].partition(":")[2]))
    rows = sorted(rows, key=lambda r: (key(r), r[0]))
    cut = [html_main.lines(r[2]) for r in rows]
    own = [[(1, x.text) if x.main else (2, x.place) if x.place else (0, x.text) for x in c] for c in cut]
    texts, asked, on = [], [], Counter()
    for i, a in enumerate(own):
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(own)]
        j = max(near, key=lambda j: (html_main.common_length(key(rows[i]), key(rows[j])), -j))
        b = own[j]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                t[x + 1][y + 1] = t[x][y] + 1 if a[x] == b[y] else max(t[x][y + 1], t[x + 1][y])
        x, y, places = len(a), len(b), set()
        while x and y:
            if a[x - 1] == b[y - 1] and t[x][y] == t[x - 1][y - 1] + 1:
                x, y = x - 1, y - 1
                places.add(x)
            elif t[x - 1][y] >= t[x][y - 1]:
                x -= 1
            else:
                y -= 1
        gone = {k for k in range(len(a)) if a[k][0] != 1 and (k in places or a[k][0] == 2 and a[k] in {a[p] for p in places})}
        inner = [k for k in range(len(a)) if a[k][0] == 1]
        ask = {k for k in inner if k in places} if 2 * sum(k in places for k in inner) < len(inner) else set()
        on.update({a[k] for k in ask})
        texts.append(gone)
        asked.append(ask)
    out = {}
    for r, c, a, gone, ask in zip(rows, cut, own, texts, asked, strict=True):
        gone = gone | {k for k in ask if len(rows) >= 4 and 2 * on[a[k]] > len(rows)}
        kept = [x.text for k, x in enumerate(c) if k not in gone and not x.frame]
        out[r[0]] = "\n\n".join(kept or [x.text for x in c if not x.frame])
    return out


def test_query_matches_plain_differencing(spark):
    random.seed(21)
    for size in (2, 5, 14):
        rows = []
        for k in range(size):
            some = lambda names: "".join(f"<{t}>{x}</{t}>" for t, x in names if random.random() < 0.7)
            head = some([("div", "Site"), ("nav", f"Menu {k}"), ("p", "Welcome"), ("aside", "Tip")])
            inner = some([("p", f"Own {k} {j}") for j in range(6)]) + "<p>Join us" + some([("p", "Quoted"), ("p", "Cited")])
            foot = some([("p", "Terms"), ("footer", f"Foot {k}"), ("p", f"Late {k}")])
            rows.append((k, f"http://h.org/{'ab'[k % 2]}/{k // 3}/{k}.html?x={k}", page(f"{head}<article>{inner}</article>{foot}")))
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        for parts in (1, 3):
            got = {r.page_id: r.text for r in html_main.main_text(df, partitions=parts).collect()}
            assert got == plain_main_text(rows)


def test_names_of_frames():
    text = lambda body: [x.text for x in html_main.lines(page(f"<article>{body}</article>")) if not x.frame]
    assert text("<section class='market-share-figures'><p>a</section><div id='notice-and-takedown'>b</div><p class='ad-hoc related-work'>c") == ["a", "b", "c"]
    assert text("<div class='share-buttons'>a</div><div class='x cookie-notice'>b</div><div id=comments-list>c</div><aside>d</aside>") == []
    assert text("<p>x <math><mi>y</mi></math> z <noscript>n</noscript><object>o</object><video>v</video>") == ["x y z nov"]


def test_pages_align_like_a_plain_table(monkeypatch):
    def longest(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    random.seed(13)
    for size in (32 << 20, 200):
        monkeypatch.setattr(html_main, "ROW_BYTES", size)
        for _ in range(60):
            a, b = ([random.choice("ab" if _ % 2 else "abcdefgh") for _ in range(random.randrange(90))] for _ in range(2))
            pairs = html_main.aligned(a, b)
            assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))


def test_many_equal_lines_align_soon():
    a = ["x", "y"] * 10_000 + ["z"]
    assert len(html_main.aligned(a, ["w", "x"] * 10_000)) == 10_000


def test_long_page(spark):
    body = "".join(f"<p>{'same' if k % 2 else k}" for k in range(8000))
    rows = [(1, "http://a.org/1", page(f"<nav>m</nav><article>{body}</article>")), (2, "http://a.org/2", page(f"<nav>m</nav><article><p>same{body[::-1]}</article>"))]
    got = {r.page_id: r for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text.count("\n\n") == 7999 and got[1].n_chars == len(got[1].text)


def test_common_subsequence():
    random.seed(3)
    for _ in range(200):
        a, b = ([random.choice("abcd") for _ in range(random.randrange(9))] for _ in range(2))
        best = max(k for k in range(len(a) + 1) for s in itertools.combinations(range(len(a)), k) if _within([a[i] for i in s], b))
        got = sorted(html_main.shared(a, b))
        assert len(got) == best and _within([a[i] for i in got], b)


def _within(s, b):
    it = iter(b)
    return all(x in it for x in s)


# ---- 6 decontamination


def test_decontamination_matches_brute_force(spark):
    random.seed(11)
    vocabulary = [f"v{k}" for k in range(12)]
    words = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(k, words(random.choice([0, 1, 3, 6, 9, 10, 15, 30]))) for k in range(14)]
    docs = []
    for k in range(60):
        w = words(random.choice([0, 2, 9, 10, 40]))
        source = random.choice(items)[1]
        if source:
            i = random.randrange(len(source))
            w = w + source[i : i + random.choice([5, 9, 10, 11, 25])] + words(4)
        docs.append((k, w))
    d = spark.createDataFrame([(k, " ".join(w).replace("v", "V") + ".") for k, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(k, ", ".join(w)) for k, w in items], "item_id long, text string")
    for rows in (1_000_000, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(d, b, broadcast_rows=rows).collect()}
        for k, w in docs:
            hit, found = set(), set()
            for name, iw in items:
                m = min(10, len(iw))
                for i in range(len(iw) - m + 1 if iw else 0):
                    for p in range(len(w) - m + 1):
                        if w[p : p + m] == iw[i : i + m]:
                            hit |= set(range(p, p + m))
                            found.add(str(name))
            assert got[k] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        clean = decontaminate.without_contaminated(d, b, broadcast_rows=rows)
        assert {r.doc_id for r in clean.collect()} == {k for k, v in got.items() if not v[4]}


def test_decontamination_edges(spark):
    t = edges.table(spark)
    b = spark.createDataFrame([(1, "mot"), (None, None), (1, "some words"), (3, "")], "item_id long, text string")
    got = decontaminate.decontaminate(t, b).collect()
    assert len(got) == len(edges.ROWS) and {r.doc_id for r in got if r.contaminated} == {5, None}
    assert decontaminate.decontaminate(t, b.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(edges.empty(spark), b).count() == 0


# ---- 9 chat, 10 rules


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "####", "\\\\", "</turn>\n### User: x", "", None, "a:b", "é🙂"]
    random.seed(12)
    rows = [(c, t, random.choice(["user", "assistant", "system", "to:ol\\", None, "User"]), random.choice(odd)) for c in range(40) for t in range(random.randrange(1, 6))]
    rows += [(100 + c, t, "user", f"shared {t}" if t < 2 else f"own {c}") for c in range(30) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS _turn")
    packed = chat.packs(df, pack_chars=400, partitions=3)
    got = {r.conv_id: r for r in chat.read_back(packed).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r, x or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.packs(df.limit(0)).count() == 0


def test_shared_turns_are_emitted_once(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "first" if t == 0 else f"{c % 2} {t}") for c in range(6) for t in range(3)]
    one = chat.packs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), partitions=1).collect()
    assert len(one) == 1 and len(one[0].nodes) == 5 and one[0].text.count("first") == 1
    for n in one[0].nodes:
        if n.parent >= 0:
            up = one[0].nodes[n.parent]
            assert n.position == up.position + up.stop - up.start
        assert n.attends[-1][1] == n.stop and sum(b - a for a, b in n.attends) == n.position + n.stop - n.start


def test_quality_rules_edges(spark):
    got = quality_rules.quality_rules(edges.table(spark)).collect()
    assert len(got) == len(edges.ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].n_words == 0 and by[2].base_failed and not by[2].kept
    assert by[8].n_repeat_words == 90 and by[8].base_failed
    assert by[6].n_words == 20_000
    assert quality_rules.quality_rules(edges.empty(spark)).count() == 0


def test_other_scripts_and_wide_characters(spark):
    words = [f"слово{chr(0x430 + k % 30)}{k}" for k in range(240)]
    rows = [(1, " ".join(words)), (2, "日本語の文章 " * 60 + " ".join(f"語{k}" for k in range(100))), (3, "кк " * 300)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[3].base_failed and not got[3].kept
    assert all(0 <= r.class_distance <= 1 and 0 <= r.word_distance <= 1 for r in got.values())


def test_clashing_columns(spark):
    names = "_kept", "_kept_h", "_n", "_row_h", "_keep_one_h", "_lid", "_y", "_t", "_row", "_spans", "_words", "_found", "_score"
    extra = edges.table(spark).selectExpr("*", *(f"{k} AS {n}" for k, n in enumerate(names)))
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 0), (7, 0, 1), (9, 1, 1), (8, 0, 0)], "doc_id long, quality int, toxic int").selectExpr("*", "1 AS _y", "2 AS _text")
    assert simhash.keep_one(extra).columns == extra.columns and simhash.keep_one(extra).count() == 7
    assert quality_rulefit.score(extra, quality_rulefit.learn(extra, labels)).count() == len(edges.ROWS)
    assert toxicity.without_toxic(extra, toxicity.learn(extra, labels)).columns == extra.columns
    assert suffix_dedup.without_repeats(extra).columns == extra.columns and suffix_dedup.without_repeats(extra).count() == len(edges.ROWS)
    assert decontaminate.without_contaminated(extra, extra.limit(0).selectExpr("doc_id AS item_id", "text")).count() == len(edges.ROWS)
    assert quality_rules.quality_rules(extra).count() == len(edges.ROWS)


def test_js_distance_bounds(spark):
    from pyspark.sql import functions as F

    a = spark.range(1).select(
        quality_rules.js_distance([F.lit(0.5), F.lit(0.5)], [0.5, 0.5]).alias("same"), quality_rules.js_distance([F.lit(1.0), F.lit(0.0)], [0.0, 1.0]).alias("apart")
    ).first()
    assert a.same == 0 and abs(a.apart - 1) < 1e-12
