import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SCHEMA, documents, frame

DOCS = documents()


def test_exact_dedup(spark):
    from quern.llm.exact_dedup import deduplicate, exact_dedup

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in DOCS:
        groups[norm(r[1])].append(r[0])
    for moduli in (None, (3, 5), (2, 2)):  # weak moduli make collisions
        got = exact_dedup(frame(spark, DOCS), **({"moduli": moduli} if moduli else {})).collect()
        assert len(got) == len(DOCS)
        want = Counter()
        for t, ids in groups.items():
            keep = min((i for i in ids if i is not None), default=None)
            for i in ids:
                want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    long = " ".join(map(str, range(40_000)))  # several chunks; one differs in the last chunk, one in the first
    texts = [long, long + "  x", long.replace(" ", "\t"), long + "\nx", long, "y" + long[1:], "a" * (1 << 16), "a" * ((1 << 16) + 1), "a " * (1 << 15) + " "]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(2)
    for moduli in ((2147483647, 2147483629), (3, 5)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(df, moduli=moduli).collect()}
        same = {i: [j for j, u in enumerate(texts) if norm(u) == norm(t)] for i, t in enumerate(texts)}
        assert got == {i: (min(v), len(v), hashlib.sha256(norm(texts[i]).encode()).hexdigest()) for i, v in same.items()}
    kept = deduplicate(frame(spark, DOCS))
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_compose(spark):
    from quern.llm.exact_dedup import Fingerprint, combine_chunks

    f, rng = Fingerprint(), np.random.default_rng(1)
    data = rng.bytes(200_001)
    whole = f.of(data)
    h = [0, 0]
    for b in data[:3000]:
        h = [(v * x + b) % p for v, x, p in zip(h, f.bases, f.moduli, strict=True)]
    assert f.of(data[:3000]) == (3000, *h)
    cuts = [0, 5, 5, 70_000, 130_000, len(data)]
    parts = [f.of(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    left = parts[0]
    for p in parts[1:]:
        left = f.combine(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = f.combine(p, right)
    assert left == right == whole
    rows = [(7, i, bytearray(data[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))] + [(8, 0, None)]
    got = {r.key: (r.n_bytes, r.fp1, r.fp2) for r in combine_chunks(spark.createDataFrame(rows, "key long, chunk_no int, data binary").repartition(4)).collect()}
    assert got == {7: whole, 8: (0, 0, 0)}


def brute_links(rows, t=0.8):
    def shingles(x):
        w = (x or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            c = len(sets[i] & sets[j])
            if c >= t * (len(sets[i]) + len(sets[j]) - c) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            r = find(i)
            low[r] = min(low.get(r, rows[i][0]), rows[i][0])
    return Counter((r[0], None if r[0] is None else low[find(i)], links[i]) for i, r in enumerate(rows))


def test_jaccard_join(spark):
    from quern.llm.jaccard_join import jaccard_join, keep_one, least_matches

    want = brute_links(DOCS)
    for options in ({}, {"bucket_rows": 3, "block_rows": 4}):
        got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(frame(spark, DOCS), **options).collect())
        assert got == want
    stay = keep_one(frame(spark, DOCS)).collect()
    assert len(stay) >= len({c for _, c, _ in want if c is not None})
    assert {r.doc_id for r in stay} >= {c for _, c, _ in want if c is not None}
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_join(empty).count() == 0 and keep_one(empty).count() == 0
    m = least_matches(96, 0.8, 1e-6)
    assert m[96] > m[48] > m[8] >= 0  # more values, more matches asked for


def test_join_hot(spark):
    from quern.llm.hot import join_hot

    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3])], "k int, i int")
    keys = spark.createDataFrame([(1, 50, "a"), (2, 3, "b")], "k int, n int, v string")
    for how, want in (("inner", {"a": 50, "b": 3}), ("left", {"a": 50, "b": 3, None: 1})):
        assert Counter(r.v for r in join_hot(rows, keys, ["k"], "n", 54, how, least=10).collect()) == want


@pytest.mark.parametrize("hub", [100_000, 3])
def test_components(spark, monkeypatch, hub):
    from quern.llm import components
    from quern.llm.components import connected_components

    monkeypatch.setattr(components, "HUB", hub)

    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def test_warc(spark):
    from quern.llm.warc import read_chunks, read_records, write_warc

    pages = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n" + "ab" * 100_000), (6, "u", "x"), (None, "n", "x"), (9, "u", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as dup").repartition(3)
    for least in (0, 5):
        first = {}
        for i, _, h in sorted(pages, key=lambda r: (r[0] is None, r[0])):
            first.setdefault(h or "", i)
        want = {}
        for i, _, h in pages:
            b = (h or "").encode()
            again = first[h or ""] != i and len(b) >= least
            want[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)
        m = write_warc(df, revisit_bytes=least)
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_records(m).collect()}
        assert got == want
    chunks = read_chunks(m).where("record_id like '<urn:page:5:%'").orderBy("chunk_no").collect()
    assert b"".join(c.data for c in chunks) == pages[4][2].encode() and len(chunks) > 2
    sha = hashlib.sha1()
    for c in chunks:
        sha.update(c.data)
        assert c.digest == base64.b32encode(sha.digest()).decode()
    assert read_records(write_warc(df.limit(0))).count() == 0
    twice = spark.createDataFrame([(1, "a", "p" * 200_000), (1, "b", "q" * 200_000)], "page_id long, url string, html string")
    chunks = read_chunks(write_warc(twice)).groupBy("record_id").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("c"), F.countDistinct("chunk_no").alias("d")).collect()
    assert [r.n for r in chunks] == [200_000] * 2 and all(r.c == r.d for r in chunks)  # rows that repeat an id keep their chunks apart


def test_sharding(spark):
    from quern.llm.sharding import fisher_yates, read_shards, shuffle_to_shards, write_shards

    for bucket_bytes in (1 << 30, 3000):
        got = shuffle_to_shards(frame(spark, DOCS), bucket_bytes=bucket_bytes).collect()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        sizes = [len(by[s]) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1
        want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in DOCS)
        assert Counter((r.doc_id, r["__size"], r["__crc32"]) for r in got) == want
    assert shuffle_to_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    places = [{(r.shard, r.slot, r.doc_id, r["__crc32"]) for r in shuffle_to_shards(frame(spark, DOCS, extra=False).repartition(n), bucket_bytes=3000).collect()} for n in (1, 5)]
    assert places[0] == places[1]  # the seed decides, not how the rows are dealt
    clash = frame(spark, DOCS).selectExpr("*", "'x' as shard", "7 as slot", "1 as __bucket")
    path = write_shards(clash, bucket_bytes=3000)
    back = read_shards(spark, path, clash.schema)
    assert back.count() == len(DOCS) and {r.shard for r in back.collect()} <= set(range(16))
    for shard in (0, 7):  # a shard is a folder of its own
        alone = spark.read.parquet(f"{path}/shard={shard}").collect()
        assert sorted(r.slot for r in alone) == list(range(len(alone)))
    assert sorted(fisher_yates(50, 3)) == list(range(50)) and list(fisher_yates(50, 3)) != list(fisher_yates(50, 4))


def test_token_store(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quern.llm.token_store import lookup, lookup_all, read_store, write_store

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [*DOCS, (500, "a b\x1cc don't I'LL <|endoftext|> x<|startoftext|>y z ǅ İ ẞ ́x", "en", "s", 0)]
    enc = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows]
    for size in (1 << 30, 8000):
        m = write_store(frame(spark, rows), path, shard_bytes=size)
        got = read_store(m).collect()
        crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for i, x in enc)
        order = sorted(got, key=lambda r: r.start)
        assert [r.doc_id for r in order] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
        at = 0
        for r in order:
            assert r.start == at
            at += r.n_tokens
    asked = [5, 500, 99999, -3]
    found = lookup(m, asked)
    want = {k: Counter(tuple(x) for i, x in enc if i == k) for k in (5, 500)}
    assert {k: Counter(tuple(d.tolist()) for d in docs) for k, docs in found.items()} == want
    got = lookup_all(m, spark.createDataFrame([(k,) for k in [*asked, 5, None]], "doc_id long")).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((k, x) for k, c in want.items() for x in c.elements())
    assert lookup(m, []) == {} and lookup_all(m.limit(0), spark.range(3), "id").count() == 0
    assert read_store(write_store(spark.createDataFrame([], SCHEMA), path)).count() == 0


def test_encoder_equals_tokenizer():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from quern.llm.token_store import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e, rng = Tokenizer.from_file(path), encoder(path), random.Random(3)
    pieces = ["'s", "'LL", "don't", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "12", "\u00bd", "\u00b2", "\u2460", "\u2167", "\u0130", "\u1e9e", "\u01c5", "\u0301", "\u00e9", "e\u0301", "\ufb01", "\u6f22", "\U0001f600", "_", "--", "\u2026", "\u2028", "\u200b", "<|endoftext|>", "<|", "A", "z", "\u03a3", "\u03c2", "\u00ad", "\u0660", "\ufeff", "x" * 40]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert e.encode(text) == e.pack(t.encode(text, add_special_tokens=False).ids), repr(text)


def test_perfect_hash():
    from quern.llm.token_store import NULL_KEY, Index, build_index, index_bytes

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 3000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        _, _, slot = build_index(keys)
        assert sorted(slot) == list(range(len(keys)))
    ids = np.array([0, 4, 4, 9])
    i = Index(index_bytes(ids, np.array([True, False, False, False]), np.array([0, 1, 3, 6, 10]), 2))
    assert i.find(np.array([NULL_KEY, 4, 9, 5])).tolist() == [0, 1, 3, -1]


def brute_best_fit(lengths, src, clu, capacity, per):
    """A plain scan for the tightest compatible bin; of bins with one residual the one that has had it longest."""
    bins, out = [], [0] * len(lengths)
    for now, i in enumerate(sorted(range(len(lengths)), key=lambda i: -lengths[i])):
        ok = [b for b in bins if b["left"] >= lengths[i] and b["src"][src[i]] < per and (clu[i] is None or clu[i] not in b["clu"])]
        if not ok:
            bins.append({"left": capacity, "since": now, "src": Counter(), "clu": set(), "id": len(bins)})
            ok = [bins[-1]]
        b = min(ok, key=lambda b: (b["left"], b["since"]))
        b["left"], b["since"] = b["left"] - lengths[i], now
        b["src"][src[i]] += 1
        b["clu"].add(clu[i])
        out[i] = b["id"]
    return out


def test_packing(spark):
    import public_tokenizers

    from quern.llm.packing import best_fit, pack, sequences
    from quern.llm.token_store import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    coder = encoder(path)
    ids_of = lambda t: coder.encode(t or "") + coder.pack([1]) * bool(coder.encode(t or ""))
    df = spark.createDataFrame(DOCS, SCHEMA).selectExpr("*", "'z' as bin", "'q' as ids").coalesce(1)
    order = df.collect()
    for cap, per in ((50, 1), (2048, 4)):
        got = pack(df, path, capacity=cap, per_source=per, group_rows=40).collect()
        whole = defaultdict(bytes)
        for r in got:  # pieces come in input order, so repeated ids stay apart
            whole[r.doc_id] += bytes(r.ids)
        want = defaultdict(bytes)
        for r in order:
            want[r.doc_id] += ids_of(r.text)
        assert whole == want
        bins, at = defaultdict(list), 0
        for s in range(0, len(order), 40):  # every group against the plain scan
            pieces = [(r.source, " ".join((r.text or "").lower().split()), p, min(cap, n - p)) for r in order[s : s + 40] for n in [len(ids_of(r.text)) // 2] for p in range(0, max(n, 1), cap)]
            fit = brute_best_fit([p[3] for p in pieces], [p[0] for p in pieces], [p[1:3] for p in pieces], cap, per)
            mine = got[at : at + len(pieces)]
            assert [(r.source, r.start, r.length, int(r.bin.split("-")[2])) for r in mine] == [(p[0], p[2], p[3], b) for p, b in zip(pieces, fit, strict=True)]
            at += len(pieces)
        assert at == len(got)
        for r in got:
            assert r.at == sum(x.length for x in bins[r.bin])
            bins[r.bin].append(r)
        assert all(sum(x.length for x in v) == v[0].bin_fill <= cap for v in bins.values())
        made = {r.bin: r for r in sequences(df, path, capacity=cap, per_source=per, group_rows=40).collect()}
        assert {b: (bytes(r.ids), r.doc_ids, r.lengths) for b, r in made.items()} == {b: (b"".join(bytes(x.ids) for x in v), [x.doc_id for x in v if x.length], [x.length for x in v if x.length]) for b, v in bins.items() if v[0].bin_fill}
    rng = np.random.default_rng(5)
    for per in (1, 2):
        for n, top in ((300, 31), (300, 5), (1, 3)):
            lengths, src = rng.integers(0, top, n).tolist(), rng.choice(["a", "a", "b", "c", None], n).tolist()
            clu = [None if c == 7 else int(c) for c in rng.integers(0, 200, n)]
            assert best_fit(lengths, src, clu, 40, per) == brute_best_fit(lengths, src, clu, 40, per)
    given = pack(frame(spark, DOCS).withColumn("class", F.lit(1)), path, cluster_col="class").where("length > 0 and piece = 0").groupBy("bin").count()
    assert {r["count"] for r in given.collect()} == {1}  # one cluster: never two in a bin
    assert pack(frame(spark, DOCS), path, group_ids=100).count() >= len(DOCS)
    assert pack(spark.createDataFrame([], SCHEMA), path).count() == 0 and sequences(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_language_id(spark):
    from quern.llm.language_id import codewords, identify, keep_identified

    words = {"en": "the and of with that this have from they which", "de": "der und nicht mit sich auf ist von werden über", "fr": "les des une dans pour que qui est avec être", "es": "los las una para con que por está como más", "it": "gli della che non una per con sono più anche", "pl": "nie jest się na że do jak być dla przez", "sv": "och att det som är för inte på med jag"}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words[k].split(), 30)), k, "s", 0) for i, k in enumerate(rng.choice(list(words), 500).tolist())]
    rows += [(1000, None, "en", "s", 0), (1001, "123 !!", "en", "s", 0), (1002, "", None, "s", 0), (None, "the and of with", None, "s", 0)]
    signs = ["\u00bd \u00b2", "\u2460 \u2167 \u00b3", "\u0663\u0664 \u4e00"[:2], "_ -- \u20ac"]  # number signs are no letters
    rows += [(1003 + i, x, "en", "s", 0) for i, x in enumerate(signs)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "2 as lang_pred").repartition(3)
    got = identify(df).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in range(1000, 1007)] == ["und"] * 7 and all(by[i].score == 0 for i in range(1000, 1007)) and by[None].lang_pred == "en" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    kept = keep_identified(df).collect()
    assert {r.doc_id for r in kept} == set(range(500)) | {None} and {(r.score, r.lang_pred) for r in kept} == {(1, 2)}
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0
    for n in (1, 2, 4, 9, 30):
        c = codewords(n)
        assert len({tuple(r) for r in c}) == n


def test_language_id_held_out(spark):
    """Held-out accuracy on the given table, labels of the fold that isn't learned from."""
    import os

    from quern.llm.language_id import identify

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    docs = spark.read.parquet(path)
    got = identify(docs).where("held_out and lang_pred <> 'und'").select("doc_id", "lang_pred").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right > 0.95


def test_language_training_is_bounded(spark):
    from quern.llm.language_id import training_rows

    rows = [(i, f"text {i}", "hot" if i % 3 else f"l{i % 7}", "s", 0) for i in range(6000)]
    got = Counter(r.lang for r in training_rows(spark.createDataFrame(rows, SCHEMA), 50, 4).collect())
    assert len(got) == 4 and got["hot"] == 50 and max(got.values()) == 50


def brute_mixture(blocks, weights):
    """Every slot by plain earliest deadline first in fractions; ties by the order of the sources."""
    from fractions import Fraction

    left, out = dict(blocks), []
    while live := [s for s in blocks if left[s]]:
        total = sum(Fraction(weights[s]) for s in live)
        w = {s: Fraction(weights[s]) / total for s in live}
        done, t = dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            ready = [s for s in live if (done[s] / w[s]).__floor__() <= t]
            s = min(ready, key=lambda s: (((done[s] + 1) / w[s]).__ceil__(), live.index(s)))
            out.append(s)
            done[s], left[s], t = done[s] + 1, left[s] - 1, t + 1
    return out


def test_mixing_equals_brute_force(spark):
    from quern.llm.mixing import mix

    for n, weights in (({"a": 40, "b": 25, "c": 7}, {"a": 1, "b": 3.7, "c": 0.0123}), ({"a": 30, "b": 30}, {"a": 0.5, "b": 0.25}), ({"x": 9}, {"x": 2}), ({"a": 50, "b": 20, "c": 20, "d": 3}, {"a": 1 / 3, "b": 0.1, "c": 0.1, "d": 5})):
        rows = [(i, s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
        got = mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1, bucket_rows=9, weights=weights).collect()
        assert [r.source for r in sorted(got, key=lambda r: r["__slot"])] == brute_mixture(n, weights)


def test_mixing_ties(spark):
    """Null and equal ids are told apart by the other columns, and spread over the salted buckets."""
    from quern.llm.mixing import mix

    rows = [(None if i % 2 else 7, f"t{i}", "en", "s", 0) for i in range(200)]
    order = [[r.text for r in sorted(mix(spark.createDataFrame(rows, SCHEMA).repartition(k), bucket_rows=20).collect(), key=lambda r: r["__at"])] for k in (1, 5)]
    assert order[0] == order[1] and sorted(order[0]) == sorted(r[1] for r in rows)


def test_pfair_bound_over_many_slots():
    from quern.llm.mixing import edf, whole

    weights = whole({"a": 1, "b": 3.7, "c": 0.0123})
    w, total, done = list(weights.values()), sum(weights.values()), [0] * 3
    for t, i in enumerate(edf(w, [0] * 3), 1):
        done[i] += 1
        assert all(abs(d * total - t * x) < total for d, x in zip(done, w, strict=True))  # under one block, in whole numbers
        if t == 100_000:
            break


def test_mixing(spark):
    from quern.llm.mixing import edf_period, mix, mixed, plan, rounded

    for weights in ({"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 1000, "b": 1}, {"a": 1}):
        share = rounded(weights, 64)
        order = edf_period(share, 64)
        for s, n in share.items():
            done = 0
            for t, x in enumerate(order):
                done += x == s
                assert abs(done - (t + 1) * n / 64) < 1  # less than one block from the due share
    table = plan({"a": 30, "b": 200, "c": 7}, {"a": 2, "b": 1, "c": 1}, 64)
    assert max(r[0] for r in table) <= 2
    for size in (1, 4):
        got = mix(frame(spark, DOCS), block_rows=size, bucket_rows=7).collect()
        assert len(got) == len(DOCS) and len({r["__at"] for r in got}) == len(DOCS)
        slots = defaultdict(set)
        for r in got:
            slots[r["__slot"]].add((r.source, r["__block"]))
        assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
        seen = defaultdict(list)
        for r in sorted(got, key=lambda r: r["__slot"]):
            seen[r.source].append(r["__block"])
        assert all(v == sorted(v) for v in seen.values())
    n = Counter(r[3] for r in DOCS)
    total = sum(v**0.5 for v in n.values())
    order = [s for _, s in sorted((r["__slot"], r.source) for r in mix(frame(spark, DOCS), block_rows=1).collect())]
    for t in range(1, 20):  # before any source runs out
        for s in n:
            assert abs(order[:t].count(s) - t * n[s] ** 0.5 / total) < 1.1
    assert sorted(map(str, mixed(frame(spark, DOCS)).collect())) == sorted(map(str, frame(spark, DOCS).collect()))
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        mix(frame(spark, DOCS), max_sources=2)


@pytest.mark.parametrize("n,weights", [({"a": 9000, "b": 2600, "c": 300, "d": 40}, None), ({"a": 6000, "b": 3}, {"a": 4000, "b": 1}), ({"a": 3000, "b": 2000, "c": 900}, {"a": 0.1, "b": 0.7, "c": 1 / 3})])
def test_mixing_keeps_true_weights(spark, n, weights):
    from quern.llm.mixing import mix

    rows = [(i, s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1, bucket_rows=700, weights=weights).collect()
    order = sorted((r["__slot"], r["__at"], r.source) for r in got)
    assert [x[0] for x in order] == [x[1] for x in order] == list(range(len(rows)))
    w, left = weights or {s: k**0.5 for s, k in n.items()}, dict(n)
    done, t = Counter(), 0
    for _, _, s in order:
        done[s] += 1
        t += 1
        left[s] -= 1
        total = sum(w[x] for x in w if left[x] or done[x])
        assert all(abs(done[x] - t * w[x] / total) < 1 + 1e-9 for x in w if left[x] or done[x])
        if not left[s]:  # the next phase
            done, t = Counter(), 0


def test_top_k(spark):
    from quern.llm.topk import top_k

    rng = np.random.default_rng(6)
    for n, dim, scale in ((300, 8, 1.0), (2000, 16, 0.05), (60, 3, 1e6), (90, 3, 1e9), (5, 2, 1.0)):
        v = (rng.normal(size=(n, dim)) * scale).astype(np.float32)
        if n > 20:
            v[5] = v[6] = v[20]
        rows = [(int(i), v[i].tolist()) for i in range(n)]
        bad = [(n + 20, None), (n + 40, []), (n + 60, [None] * dim), (n + 80, [float("nan")] * dim), (n + 100, [float("inf")] * dim), (None, v[0].tolist()), (n + 120, v[1].tolist() + [1.0])]
        df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as block", "3 as kind", "4 as dim").repartition(3)
        z = np.floor(64 * v.astype(np.float64)).astype(np.int64)
        z = z.astype(object) if scale > 1e8 else z
        clamp = lambda x: min(max(int(x), -(2**63)), 2**63 - 1)
        want = set()
        for q in range(0, n, 20):
            s = z @ z[q]
            order = sorted((i for i in range(n) if i != q), key=lambda i: (-clamp(s[i]) if scale > 1e8 else -s[i], i))[:20]
            want |= {(q, r + 1, i, clamp(s[i])) for r, i in enumerate(order)}
        for block in (16384, 100):
            assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, block_rows=block).collect()} == want
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    huge = [(0, [1e17, -3e300]), (1, [2e17, -1.0]), (2, [-1e17, 1e300])]
    got = {(r.vec_id, r.score) for r in top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()}
    assert got == {(1, 2**63 - 1), (2, -(2**63))}


def test_top_k_stops_early():
    from quern.llm.topk import Lists, block_top_k

    rng = np.random.default_rng(9)
    v = (rng.exponential(1.0, (5000, 4)) ** 3 * 64).astype(np.int64)  # few large values, so the front falls fast
    q = np.abs((rng.normal(size=(20, 4)) * 64).astype(np.int64))
    got, read = block_top_k(Lists(v), np.arange(5000), q, np.full(20, -1), 10)
    for x, (at, s) in zip(q, got, strict=True):
        full = v @ x
        assert at.tolist() == sorted(range(5000), key=lambda i: (-full[i], i))[:10] and s.tolist() == full[at].tolist()
    assert (read < 5000).all() and read.min() < 1000


def brute_repeats(rows, width):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[p : p + width] for b in data for p in range(len(b) - width + 1))
    out = Counter()
    for r, b in zip(rows, data, strict=True):
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p + 1 : p + width + 1] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out[(r[0], len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("crowd,batch", [(2000, 1 << 20), (1, 3000)])
def test_suffix_dedup(spark, monkeypatch, crowd, batch):
    from quern.llm import suffix_dedup as sd

    monkeypatch.setattr(sd, "CROWD", crowd)
    monkeypatch.setattr(sd, "BATCH", batch)
    rng = np.random.default_rng(7)
    passage = "".join(rng.choice(list("abcdé"), 320))
    rows = [*DOCS, *((700 + i, "".join(rng.choice(list("abc"), 90)) + passage[: 199 + i] + "".join(rng.choice(list("xyz"), 70)), "en", "s", 0) for i in range(12))]
    rows += [(750, "a" * 900, "en", "s", 0), (751, "ab" * 300 + "c" + "ab" * 200, "en", "s", 0), (752, passage[:200], "en", "s", 0), (753, "q" * 199, "en", "s", 0)]
    got = sd.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 200)
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("crowd", [2000, 1])
def test_suffix_dedup_keeps_buckets_whole(spark, monkeypatch, crowd):
    from quern.llm import suffix_dedup as sd

    monkeypatch.setattr(sd, "CROWD", crowd)
    monkeypatch.setattr(sd, "BATCH", 3000)
    rng = np.random.default_rng(11)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    line = min((text(64) for _ in range(5000)), key=lambda t: int(sd.gram_hashes(np.frombuffer(t.encode(), np.uint8))[0]))  # wins all windows
    rows = []
    for i in range(30):  # pairs that share 210 bytes around the line and differ beyond
        left, right = text(70), text(76)
        rows += [(1000 + 2 * i + j, text(150) + left + line + right + text(150), "en", "s", 0) for j in range(2)]
    rows += [rows[0]] * 40  # rows that repeat both id and text
    got = sd.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 200)


def test_suffix_dedup_large_homes(spark):
    """Buckets whose rows outgrow a batch, with the default limits: 4,890 documents around three 64-byte lines, pairs share a window."""
    from quern.llm import suffix_dedup as sd

    rng = np.random.default_rng(13)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    low = lambda t: int(sd.gram_hashes(np.frombuffer(t.encode(), np.uint8))[0])
    rows = []
    for n in (2000, 890, 2000):
        line = min((text(64) for _ in range(3000)), key=low)
        for _ in range(n // 2):
            left, right = text(68), text(68)  # 200 bytes with the line
            rows += [(len(rows) + j, text(68) + left + line + right + text(68), "en", "s", 0) for j in range(2)]
    assert len(rows) == 4890
    want = brute_repeats(rows, 200)
    for parts in (1, 4):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_suffix_dedup_long_text(spark, monkeypatch):
    from quern.llm import suffix_dedup as sd

    monkeypatch.setattr(sd, "PIECE", 5000)  # borders that a passage crosses
    rng = np.random.default_rng(14)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = text(700)
    rows = [(1, text(4700) + passage + text(9500) + passage + text(2000), "en", "s", 0), (2, text(9900) + passage[100:450] + text(30_000), "en", "s", 0)]
    got = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 200)


def test_suffix_array():
    from quern.llm.suffix_array import suffix_array

    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 4, 5, 50, 333):
        for top in (1, 2, 5, 200):
            s = rng.integers(1, top + 1, n)
            assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    s = np.tile(rng.integers(1, 4, 17), 20)
    got = [s[i : i + 12].tolist() for i in suffix_array(s, 12)]
    assert got == sorted(got)


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = str(tmp_path)
    spark.createDataFrame(DOCS, SCHEMA).repartition(2).write.parquet(f"{d}/documents.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    counts = []
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, d)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3]
    got = spark.read.parquet(f"{d}/mixing").collect()
    assert all(re.search(r"[^\W\d_]", r.text or "") for r in got)
    norm = [re.sub(r"\s+", " ", r.text) for r in got]
    assert len(set(norm)) == len(norm)
    links = brute_links([(i, r.text) for i, r in enumerate(got)])
    assert sum(n for _, _, n in links) <= 2 * len(got)
    assert corpus_pipeline.run(spark, d).count() == counts[-1]


def test_release_drops_what_workers_keep():
    from quern.llm import _io, token_store

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_store.encoder(path) is token_store.encoder(path)
    _io.trim()
    assert path in _io.kept
    _io.release()
    assert not _io.kept


def test_mixing_starts_no_other_workers(spark):
    """The plan of the mixture reaches the executors as Arrow; rows from a list would go through Python workers of another kind."""
    from quern.llm.mixing import mix

    out = mix(spark.range(500).selectExpr("id as doc_id", "concat('s', id % 3) as source"))
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 500


def test_recent_keys_stay():
    from quern.llm.token_store import Recent

    made = Counter()

    def make(key):
        made[key] += 1
        return key.encode()

    r = Recent(make, 100)
    for i in range(5000):
        assert r["often"] == b"often" and r[f"k{i}"] == b"k%d" % i
        assert len(r) + len(r.older) <= 200
    assert made["often"] == 1  # clearing at the limit made it anew each time
    assert r["x" * 65] == b"x" * 65 and "x" * 65 not in r


def test_pieces_by_ranges():
    import random

    from quern.llm.token_store import PIECES, UNSAFE

    plain = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\xb2\xb3\xb9\xbc\xbd\xbe]+|[\\d\xb2\xb3\xb9\xbc\xbd\xbe]|(?:[^\\x09-\\x0d\\x20\x85\xa0\\w]|_)+")
    known, rng = [c for c in map(chr, range(0x2200)) if not UNSAFE.match(c)], random.Random(4)
    for text in ["".join(known), *("".join(rng.choice(known + ["'s", "'ll", "a", " "] * 40) for _ in range(60)) for _ in range(500))]:
        assert PIECES.findall(text.lower()) == plain.findall(text.lower())
