"""Token ids as raw binary shards with a minimal perfect hash index for each shard.

A shard holds the ids of a range of doc_ids in ascending order as little-endian unsigned integers
(two bytes each where the vocabulary allows, else four) and, beside it, an index file:

    magic, version, bytes an id, documents n, keys m, hash seeds (m pilots), then the arrays
    doc_id[n], null flag[n], offset[n + 1] (in ids), pilot[buckets], entry[m], fingerprint[m]

The index is hash-and-displace: keys fall into buckets, largest first, and each bucket gets the first
pilot that sends all its keys to free slots of 0..m-1. entry[slot] is the position of the key's first
document, fingerprint[slot] 32 other bits of its hash, so a key that is not stored is refused but for
a chance of 2^-32, without reading the keys. Documents that repeat a doc_id follow one another.

Defined results: null text is empty (the end id alone); null doc_ids come first; rows that repeat a
doc_id are separate documents in order of their text's hash; extra columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quern.llm._io import kept, make_dir, open_fs, work_dir, written

MAGIC = b"QTOK0001"
NULL_KEY = -(2**63)
#: More shards are never made, so their key bounds (20 bytes each) can be broadcast; from 12 TB of text on shards grow.
MOST_SHARDS = 500_000
BUCKET_KEYS = 4
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    z = x.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def build_index(keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, pilots, slot of each key) for distinct int64 keys; slots are 0..len(keys)-1, each used once."""
    m = len(keys)
    n_buckets = max(1, -(-m // BUCKET_KEYS))
    for seed in range(50):
        h = mix(keys, seed)
        bucket = (h % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        free, slot, pilots = np.ones(m, bool), np.empty(m, np.int64), np.zeros(n_buckets, np.uint32)
        for b in np.argsort(-np.diff(at), kind="stable"):
            mine = order[at[b] : at[b + 1]]
            if not len(mine):
                break
            for start in range(0, 1 << 22, 256):
                tries = np.arange(start, start + 256)
                s = (mix((h[mine][:, None] ^ mix(tries, 77)[None, :]).view(np.int64), 3) % np.uint64(m)).astype(np.int64)
                ok = free[s].all(0)
                if len(mine) > 1:
                    t = np.sort(s, axis=0)
                    ok &= (t[1:] != t[:-1]).all(0)
                if ok.any():
                    p = int(np.argmax(ok))
                    pilots[b], slot[mine] = tries[p], s[:, p]
                    free[s[:, p]] = False
                    break
            else:
                break
        else:
            return seed, pilots, slot
        if not free.any():
            return seed, pilots, slot
    raise RuntimeError("no perfect hash found")


class Index:
    """A shard's index as read back: find() gives the first document of each key, or -1."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, np.int64, 5, len(MAGIC))
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token index")
        self.width, n, m, buckets, self.seed = (int(x) for x in head)
        at = len(MAGIC) + 40

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_id, self.offset, self.entry = take("<i8", n), take("<i8", n + 1), take("<i8", m)
        self.pilots, self.fingerprint, self.null = take("<u4", buckets), take("<u4", m), take("u1", n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.entry):
            return np.full(len(keys), -1)
        h = mix(keys, self.seed)
        p = self.pilots[(h % np.uint64(len(self.pilots))).astype(np.int64)]
        s = (mix((h ^ mix(p, 77)).view(np.int64), 3) % np.uint64(len(self.entry))).astype(np.int64)
        return np.where(self.fingerprint[s] == (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32), self.entry[s], -1)


def index_bytes(doc_id: np.ndarray, null: np.ndarray, offset: np.ndarray, width: int) -> bytes:
    keys = np.where(null, NULL_KEY, doc_id)
    keys, first = np.unique(keys, return_index=True)
    seed, pilots, slot = build_index(keys)
    entry, prints = np.empty(len(keys), "<i8"), np.empty(len(keys), "<u4")
    entry[slot], prints[slot] = first, (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)
    head = np.array([width, len(doc_id), len(keys), len(pilots), seed], "<i8")
    return b"".join([MAGIC, *(a.tobytes() for a in (head, doc_id.astype("<i8"), offset.astype("<i8"), entry, pilots.astype("<u4"), prints, null.astype("u1")))])


#: Characters that this module splits and folds as the tokenizer does (no special form under NFC, known classes).
UNSAFE = re.compile("[^\\x00-\\x1b\\x20-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u21ff]")


def _pieces() -> re.Pattern:
    """The pre-tokenizer's pieces over those characters in lower case: letters, single digits, contractions, other runs.

    The classes are spelt out as ranges, which the engine looks up in tables; categories are evaluated one after the other.
    """
    known = sorted({ord(x) for c in map(chr, range(0x2200)) if not UNSAFE.match(c) for x in c.lower()})

    def ranges(pattern: str) -> str:
        out: list[list[int]] = []
        for c in known:
            if re.match(pattern, chr(c)):
                if out and out[-1][1] == c - 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
        return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out) + "]"

    letter, digit, other = map(ranges, ("[^\\W\\d_\xb2\xb3\xb9\xbc\xbd\xbe]", "[\\d\xb2\xb3\xb9\xbc\xbd\xbe]", "[^\\x09-\\x0d\\x20\x85\xa0\\w]|_"))
    return re.compile(f"{letter}+|{digit}|'(?:[stmd]|re|ve|ll)|{other}+")


PIECES = _pieces()
PROBE = "It's 12\u00bd o'clock -- D\u00e9j\u00e0 VU_x,\tna\u00efve \u2026end\u0130 we'LL"


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Recent(dict):
    """make(key) of the keys asked for last, `limit` to twice as many of them; keys of over `longest` characters aren't kept.

    At the limit the keys become the older ones; an older one that is asked for again comes back, the others go at the next limit.
    """

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key: str) -> bytes:
        out = self.older.pop(key, None)
        if out is None:
            out = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = out
        return out


class Encoder:
    """Whole texts to packed ids by way of their pieces, each encoded by the tokenizer's model and kept for a while.

    That needs a tokenizer that lower-cases, drops white space and never joins pieces; a probe text decides,
    and other tokenizers get whole texts. Texts with other characters are cut at blanks, which no piece
    spans, and texts that may hold special tokens go to the tokenizer whole.
    """

    LIMIT = 100_000

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.letters = _byte_letters()
        self.pieces, self.chunks = Recent(self._piece, self.LIMIT), Recent(self._chunk, self.LIMIT // 5)
        self.specials = [t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        try:
            self.by_piece = self._pieces(PROBE) == self._whole(PROBE)
        except Exception:  # noqa: BLE001  a model without that alphabet
            self.by_piece = False

    def pack(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii() and piece.isprintable()  # the alphabet leaves these as they are
        ids = [t.id for t in self.model.tokenize(piece if plain else "".join(map(self.letters.__getitem__, piece.encode())))]
        return struct.pack(f"<{len(ids)}{self.kind.char}", *ids)

    def _whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))

    def _chunk(self, chunk: str) -> bytes:
        return self._whole(chunk) if UNSAFE.search(chunk) else self._pieces(chunk)

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(s in text for s in self.specials):
            return self._whole(text)
        if not UNSAFE.search(text):
            return self._pieces(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> Encoder:
    """One for each worker process, so that its pieces serve all its tasks until other work releases it."""
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def write_store(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, shard_bytes: int = 24 << 20) -> DataFrame:
    """Write the shards; returns the manifest (shard, data, index, n_docs, n_ids, low, high), one row for each shard, in doc_id order.

    low and high are the least and greatest key of the shard (a null doc_id has the key NULL_KEY).

    A task that is run again writes other files; only the ones in the manifest count.
    """
    spark = docs.sparkSession
    where = make_dir(work_dir(spark, "tokens"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 32)).first()[0] or 0
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ranged = slim.repartitionByRange(min(max(1, -(-total // shard_bytes)), MOST_SHARDS), *order).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        coder, ids, nulls, counts, out = None, [], [], [], None
        fs, path = open_fs(where)
        name = uuid.uuid4().hex
        for x in batches:
            if not x.num_rows:
                continue
            if coder is None:
                coder = encoder(tokenizer)
                end = coder.pack([end_id])
                out = fs.open_output_stream(f"{path}/{name}.ids")
            for s in range(0, x.num_rows, 512):
                part = x.slice(s, 512)
                got = [coder.encode(t or "") for t in part.column("text").to_pylist()]
                out.write(b"".join(y for g in got for y in (g, end)))
                counts.append(np.array([len(g) // coder.kind.itemsize + 1 for g in got]))
            ids.append(np.asarray(x.column("doc_id").fill_null(0)))
            nulls.append(np.asarray(x.column("doc_id").is_null()))
        if coder is not None:
            out.close()
            n = np.concatenate(counts)
            doc_ids, null = np.concatenate(ids), np.concatenate(nulls)
            with fs.open_output_stream(f"{path}/{name}.idx") as f:
                f.write(index_bytes(doc_ids, null, np.concatenate([[0], np.cumsum(n)]), coder.kind.itemsize))
            keys = np.where(null, NULL_KEY, doc_ids)
            whole = [pa.array([int(v)], pa.int64()) for v in (len(n), n.sum(), keys.min(), keys.max())]
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{where}/{name}.ids"]), pa.array([f"{where}/{name}.idx"]), *whole], ["shard", "data", "index", "n_docs", "n_ids", "low", "high"])

    return written(ranged.mapInArrow(write, "shard int, data string, index string, n_docs long, n_ids long, low long, high long"), "manifest")


class Shard:
    """Keyed access to one shard by a fixed number of small reads for each key; nothing is scanned or loaded whole."""

    def __init__(self, index_uri: str, data_uri: str):
        fs, path = open_fs(index_uri)
        self.index = fs.open_input_file(path)
        fs, path = open_fs(data_uri)
        self.data = fs.open_input_file(path)
        head = self._read(0, len(MAGIC) + 40)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token index")
        self.width, self.n, self.m, self.buckets, self.seed = (int(x) for x in np.frombuffer(head, "<i8", 5, len(MAGIC)))
        self.at = {}
        at = len(MAGIC) + 40
        for name, count, size in (("doc_id", self.n, 8), ("offset", self.n + 1, 8), ("entry", self.m, 8), ("pilot", self.buckets, 4), ("fingerprint", self.m, 4), ("null", self.n, 1)):
            self.at[name] = at
            at += count * size

    def _read(self, at: int, n: int) -> bytes:
        self.index.seek(at)
        return self.index.read(n)

    def _value(self, name: str, i: int, kind: str) -> int:
        size = np.dtype(kind).itemsize
        return int(np.frombuffer(self._read(self.at[name] + i * size, size), kind)[0])

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of all documents of the key, in order; none where the fingerprint or the stored key differs."""
        if not self.m:
            return []
        k = np.array([key], np.int64)
        h = mix(k, self.seed)
        pilot = np.array([self._value("pilot", int(h[0] % np.uint64(self.buckets)), "<u4")], np.uint32)
        slot = int(mix((h ^ mix(pilot, 77)).view(np.int64), 3)[0] % np.uint64(self.m))
        if self._value("fingerprint", slot, "<u4") != int(mix(k, 1000)[0] >> np.uint64(32)):
            return []
        out, at = [], self._value("entry", slot, "<i8")
        while at < self.n and (NULL_KEY if self._value("null", at, "u1") else self._value("doc_id", at, "<i8")) == key:
            start, end = np.frombuffer(self._read(self.at["offset"] + 8 * at, 16), "<i8")
            self.data.seek(int(start) * self.width)
            out.append(np.frombuffer(self.data.read(int(end - start) * self.width), f"<u{self.width}"))
            at += 1
        return out

    def close(self) -> None:
        self.index.close()
        self.data.close()


def lookup(manifest: DataFrame, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of all documents of each key that the store holds, by key bounds, index and seek."""
    wanted = sorted({int(k) for k in keys})
    if not wanted:
        return {}
    near = manifest.where(F.exists(F.lit(np.array(wanted, np.int64)), lambda k: (k >= F.col("low")) & (k <= F.col("high"))))
    out: dict[int, list[np.ndarray]] = {}
    for r in near.orderBy("shard").toLocalIterator():  # a key's shards; few, as bounds overlap only in a repeated key
        shard = Shard(r["index"], r["data"])
        for k in wanted:
            if r["low"] <= k <= r["high"] and (docs := shard.get(k)):
                out.setdefault(k, []).extend(docs)
        shard.close()
    return out


def lookup_all(manifest: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """doc_id, nth, ids (array of int) of each asked key: a distributed lookup. A task opens a shard once for its keys.

    A key finds its shards by binary search in the shards' key bounds, of which there are MOST_SHARDS at most.
    """
    bounds = manifest.select("shard", "low", "high").orderBy("shard").toArrow()
    shared = keys.sparkSession.sparkContext.broadcast(tuple(np.asarray(bounds[c]) for c in ("shard", "low", "high")))

    def meet(batches):
        shard, low, high = shared.value
        for x in batches:
            key = np.asarray(x.column(0))
            first, last = np.searchsorted(high, key, "left"), np.searchsorted(low, key, "right")
            n = np.maximum(last - first, 0)
            at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.record_batch([pa.array(np.repeat(key, n)), pa.array(shard[at].astype(np.int32) if len(shard) else np.empty(0, np.int32))], ["key", "shard"])

    asked = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null").distinct()
    met = asked.mapInArrow(meet, "key long, shard int").join(manifest.select("shard", "data", "index"), "shard")

    def read(batches):
        now, shard = None, None
        for x in batches:
            rows = []
            for key, index, data in zip(*(x.column(c).to_pylist() for c in ("key", "index", "data")), strict=True):
                if index != now:
                    if shard:
                        shard.close()
                    now, shard = index, Shard(index, data)
                rows += [(key, n, ids) for n, ids in enumerate(shard.get(key))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].astype(np.int64) for r in rows], pa.list_(pa.int64()))], ["doc_id", "nth", "ids"])
        if shard:
            shard.close()

    return met.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(read, "doc_id long, nth int, ids array<long>")


def read_store(manifest: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, from the files alone.

    Each key goes through the index, whose entry says where the key's documents begin; the raw ids are streamed
    from the shard a few MB at a time, in the order of the entries.
    """
    starts = manifest.withColumn("before", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids"))  # a row for each shard
    n = max(1, manifest.count())

    def read(batches):
        for x in batches:
            for data, index_at, before in zip(*(x.column(c).to_pylist() for c in ("data", "index", "before")), strict=True):
                fs, path = open_fs(index_at)
                with fs.open_input_file(path) as f:
                    index = Index(f.read())
                keys = np.where(index.null, NULL_KEY, index.doc_id)
                distinct, repeats = np.unique(keys, return_counts=True)
                first = index.find(distinct)
                if (first < 0).any():
                    raise RuntimeError(f"{index_at}: a stored key isn't found")
                place = np.repeat(first, repeats) + np.arange(len(keys)) - np.repeat(np.cumsum(repeats) - repeats, repeats)
                begin, end, owner = index.offset[place], index.offset[place + 1], np.repeat(distinct, repeats)
                if (begin[1:] != end[:-1]).any():
                    raise RuntimeError(f"{index_at}: the entries leave a gap")
                fs, path = open_fs(data)
                with fs.open_input_stream(path) as f:
                    for s in range(0, len(keys), 2000):
                        e = min(s + 2000, len(keys))
                        crcs = []
                        for d in range(s, e):
                            left, crc = int(end[d] - begin[d]), 0
                            while left:
                                raw = f.read(min(left, 1 << 20) * index.width)
                                ids = np.frombuffer(raw, f"<u{index.width}")
                                if not len(ids):
                                    raise EOFError(data)
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                                left -= len(ids)
                            crcs.append(crc)
                        yield pa.record_batch([pa.array(owner[s:e], mask=index.null[place[s:e]].astype(bool)), pa.array(begin[s:e] + before), pa.array((end - begin)[s:e]), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
