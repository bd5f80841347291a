"""N-gram Jaccard join by parity sketches: exact links and their components.

A document's set is its distinct 5-word shingles (64-bit hashes). Equal sets are one class from the start. For other
pairs with Jaccard similarity of at least 0.8:

* Size bands. Sizes are cut at bounds that grow by RATIO; a set enters its own band and, if a partner could be
  there, the next one. In a band, linked sets differ by at most ``k = min(n / 4, (n + largest) / 9)`` elements.
* Parity sketch. Each shingle belongs to one of the band's buckets, by the leading bits of its hash; a bucket holds the XOR
  of its shingles' hashes. Every element of the symmetric difference changes one bucket, so the number of differing
  buckets (the sketches' Hamming distance) is at most the symmetric difference.
* Pigeonhole. Of a set's m non-empty buckets at most k differ from a linked set's, so m - k at least agree: (band, bucket,
  XOR) is the join key. A set with m <= k also enters its least n / 5 + 1 shingles as keys (prefix filter), which finds pairs of
  two such sets.
* Texts are read and shingled once for this. Tasks gather keys in chunks and send packed runs of them to buckets by range of
  keys; a bucket returns the keys that several sets share. A key with more than FEW members is common. Where a
  chunk has that many by itself, it sends one for all and returns the rest directly, so no bucket meets them all.
* Links. Members of a key are compared with the key's first member (those of a common key with the chunk's first one, and these
  with each other's). Where a key still spans several components, its members are compared in all pairs between components; a
  set with common keys is compared with a member, drawn by hash, of one of them.
* The rest, exactly. A set with fewer than m - k common keys has an agreeing bucket in another key with each of its
  partners, so nothing is lost. Only pairs of two sets that are mostly common text remain (fewer than k + 1 own buckets); in each
  group of such sets, the bit sketches of those outside the group's largest component meet those of the whole group, in blocks.

Candidates first meet the Hamming bound on parity sketches of one bit a bucket, with at least as many bits as elements;
what is left is verified on the full shingle sets, made again from these sets' texts alone.

Edge cases: null, empty and blank texts have no shingles and link with nothing (each its own component, repeated
rows of one doc_id together); fewer than five words are one shingle; repeated rows are equal sets; rows with a null
doc_id belong to classes but never name one, alone they have a null component; an empty table gives no rows. Very long texts
are hashed in blocks (``words``). Other columns are carried by ``without_near_copies`` and ignored elsewhere, so
their names can't clash. Ties: among equal texts the least doc_id counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, release, saved, step, tidy, width
from .components import components, moved
from .words import mix, words_of

WORDS = 5
LINK, OF = 80, 100
RATIO = 2.0
BUCKETS = 0.36
#: More members make a key common.
FEW = 32
#: Sets of a block that are compared with ROWS sets in a task.
BLOCK, ROWS = 2048, 4096
#: Keys of a chunk; chunks whose keys meet in a task.
CHUNK, FAN = 1_000_000, 512
#: Ids that may be broadcast: 8 bytes each, some megabytes in all. More are joined by shuffling.
BROADCAST_IDS = 500_000
#: The band of a key is its last BAND_BITS bits; keys have KEY_BITS.
BAND_BITS, KEY_BITS = 5, 56

_U = np.uint64
_POWERS = [_U(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    h, cuts = words_of(texts)
    runs = h[: max(0, len(h) - WORDS + 1)] * _POWERS[0]
    for k in range(1, WORDS):
        runs += h[k : k + len(runs)] * _POWERS[k]
    runs = mix(runs)
    ends = cuts.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a >= WORDS:
            s = np.sort(runs[a : b - WORDS + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]
        elif b > a:
            short = np.full(1, b - a, _U)
            for k in range(a, b):
                short = short * _POWERS[4] + h[k]
            yield mix(short)
        else:
            yield h[:0]


def shingles(text: str | None) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string())))


def set_id(s: np.ndarray) -> int:
    """A set's id: a signed 64-bit hash of all its elements."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), 7) - (1 << 63) if len(s) else 0


def bands(most: int) -> list[int]:
    """Lower bounds of bands up to one that holds ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * RATIO)))
    return out


#: Sets have fewer than 2^30 elements, so a band fits BAND_BITS bits.
_BOUNDS = bands(1 << 30)


def differ_most(n: int, largest: int) -> int:
    """Most elements by which a set of n and a linked one of at most ``largest`` differ."""
    return min(n // 4, (n + largest) // 9)


def _key(x: np.ndarray, band: int) -> np.ndarray:
    return (mix(x) >> _U(64 - KEY_BITS + BAND_BITS)) << _U(BAND_BITS) | _U(band)


def keys(s: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
    """(band, keys, spare): the join keys of a set in each band; spare is how many of them agree with any partner at
    least (1 where the prefix keys guard the set)."""
    n, out = len(s), []
    if n < 4:
        return out  # a single differing element is too much already
    own = int(np.searchsorted(_BOUNDS, n, "right")) - 1
    for band in (own, own + 1):
        low, high = _BOUNDS[band], _BOUNDS[band + 1] - 1
        if OF * n < LINK * low:
            continue
        k = differ_most(n, high)
        count = max(2, math.ceil(1.25 * BUCKETS * low), math.ceil(differ_most(high, high) * 1.15) + 2)
        where = ((s >> _U(32)) * _U(count)) >> _U(32)
        first = np.empty(n, bool)
        first[0] = True
        np.not_equal(where[1:], where[:-1], out=first[1:])
        starts = np.flatnonzero(first)
        parity = np.bitwise_xor.reduceat(s * _POWERS[1], starts)
        found = _key(parity + mix(where[starts] + _U(band << 32)), band)
        if len(starts) <= k:
            found = np.concatenate([found, _key(s[: n - math.ceil(LINK * n / OF) + 1] ^ _U(0x5BF0_3635_0000_0000), band)])
        out.append((band, found, max(1, len(starts) - k)))
    return out


def sketch(s: np.ndarray) -> bytes:
    """One bit for each element's hash, XORed: as many bits as elements at least, a power of two."""
    bits = max(256, 1 << max(0, (len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference: the longer sketch is folded to the shorter one's length first."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if OF * min(len(a), len(b)) < LINK * max(len(a), len(b)) or not len(a):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return OF * both >= LINK * (len(a) + len(b) - both)


# Rows that tasks send to buckets: documents (kind 0), members of common keys (1) and pairs of their first members with the
# others (2) only pass, runs of keys (3) are met.
SENT = "bucket int, chunk long, kind int, doc_id long, set_id long, n int, band int, own int, next int, runs int, blob binary"
# What buckets return: documents (0), members of shared keys (1: key, set_id, common), pairs of a key's first member and another (2: key, set_id).
MET = "kind int, key long, common boolean, doc_id long, set_id long, n int, band int, own int, next int, blob binary"


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def pack(k: np.ndarray, ids: np.ndarray, many: np.ndarray) -> bytes:
    """Sorted keys, their members' set_ids, and whether a member stands for many."""
    there, at = np.unique(ids, return_inverse=True)
    head = np.array([len(k), len(there)], np.int64).tobytes()
    return pa.compress(head + _planes(np.diff(k, prepend=_U(0))) + _planes((at.astype(np.uint32) << np.uint32(1)) | many) + there.tobytes(), codec="lz4", asbytes=True)


def unpack(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(blob, decompressed_size=size, codec="lz4", asbytes=True)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 16).reshape(8, n).T).view(_U).reshape(-1)
    at = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 16 + 8 * n).reshape(4, n).T).view(np.uint32).reshape(-1)
    there = np.frombuffer(raw, np.int64, m, 16 + 12 * n)
    return np.cumsum(gaps, dtype=_U), there[at >> np.uint32(1)], (at & np.uint32(1)).astype(bool)


def _size(k: np.ndarray, ids: np.ndarray) -> int:
    return 16 + 12 * len(k) + 8 * len(np.unique(ids))


def grouped(k: np.ndarray, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct members in the order of keys and set_ids, and where each key starts."""
    order = np.lexsort((ids, k))
    k, ids, many = k[order], ids[order], many[order]
    fresh = np.empty(len(k), bool)
    fresh[:1] = True
    fresh[1:] = (k[1:] != k[:-1]) | (ids[1:] != ids[:-1])
    if not fresh.all():
        starts = np.flatnonzero(fresh)
        k, ids, many = k[starts], ids[starts], np.logical_or.reduceat(many, starts)
    fresh = np.empty(len(k), bool)
    fresh[:1] = True
    fresh[1:] = k[1:] != k[:-1]
    return k, ids, many, np.flatnonzero(fresh)


def folded(k: np.ndarray, ids: np.ndarray, many: np.ndarray) -> tuple[tuple, tuple]:
    """Members with those of each key that has more than FEW folded into the least; and all members of such keys."""
    k, ids, many, starts = grouped(k, ids, many)
    sizes = np.diff(starts, append=len(k))
    if not (sizes > FEW).any():
        return (k, ids, many), (k[:0], ids[:0])
    hot = np.repeat(sizes > FEW, sizes)
    first = np.zeros(len(k), bool)
    first[starts] = True
    keep = ~hot | first
    return (k[keep], ids[keep], (many | hot)[keep]), (k[hot], ids[hot])


def _rows(schema: str, size: int, /, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(size, kinds[t]) for c, t in names], [c for c, _ in names])


def _sent(chunk: int, buckets: int, k: np.ndarray, ids: np.ndarray, many: np.ndarray, passing: int) -> Iterator[pa.RecordBatch]:
    """A chunk's runs for each bucket, and its common keys' members."""
    (k, ids, many), (hot, of) = folded(k, ids, many)
    ends = np.searchsorted(_bucket(k, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        at = slice(ends[b], ends[b + 1])
        yield _rows(SENT, 1, bucket=[b], chunk=[chunk], kind=[3], runs=[_size(k[at], ids[at])], blob=[pack(k[at], ids[at], many[at])])
    for at in range(0, len(hot), CHUNK):
        part = slice(at, at + CHUNK)
        none = np.zeros(len(hot[part]), bool)
        yield _rows(SENT, 1, bucket=[passing], chunk=[chunk], kind=[1], runs=[_size(hot[part], of[part])], blob=[pack(hot[part], of[part], none)])
    if len(hot):
        starts = np.flatnonzero(np.concatenate([[True], hot[1:] != hot[:-1]]))
        a, b = star_pairs(of, starts)
        yield _rows(SENT, 1, bucket=[passing], chunk=[chunk], kind=[2], runs=[16 * len(a)], blob=[pa.compress(a.tobytes() + b.tobytes(), codec="lz4", asbytes=True)])


def star_pairs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of each key's first member, the least set_id, with the others."""
    a = np.repeat(ids[starts], np.diff(starts, append=len(ids)))
    others = np.ones(len(ids), bool)
    others[starts] = False
    a, b = a[others], ids[others]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _bucket(k: np.ndarray, buckets: int) -> np.ndarray:
    return (((k >> _U(KEY_BITS - 32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def sketched(docs: DataFrame, buckets: int) -> DataFrame:
    """SENT rows of documents (doc_id, text). A chunk enters a set once, however many copies it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        chunk, passing = task << 24, -1 - task
        seen, ks, of, total = set(), [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, ns, bits, where, own, after = [], [], [], [], [], []
                for s in shingle_sets(part.column(1)):
                    i = set_id(s)
                    spare = {}
                    found = keys(s)
                    for band, k, least in found:
                        spare[band] = least
                        if i not in seen:
                            ks.append(k)
                            of.append((i, len(k)))
                            total += len(k)
                    seen.add(i)
                    band = found[0][0] if found else 0
                    ids.append(i)
                    ns.append(len(s))
                    bits.append(sketch(s))
                    where.append(band)
                    own.append(spare.get(band))
                    after.append(spare.get(band + 1))
                n = part.num_rows
                yield _rows(SENT, n, bucket=np.full(n, passing, np.int32), kind=np.zeros(n, np.int32), doc_id=part.column(0).cast(pa.int64()), set_id=ids, n=ns, band=where, own=own, next=after, blob=bits)
                if total >= CHUNK:
                    yield from _sent(chunk, buckets, np.concatenate(ks), _repeated(of), np.zeros(total, bool), passing)
                    chunk, seen, ks, of, total = chunk + 1, set(), [], [], 0
        if total:
            yield from _sent(chunk, buckets, np.concatenate(ks), _repeated(of), np.zeros(total, bool), passing)

    return docs.select("doc_id", "text").transform(mapped(run, SENT))


def _repeated(of: list[tuple[int, int]]) -> np.ndarray:
    return np.repeat(np.array([i for i, _ in of], np.int64), [n for _, n in of])


def _runs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [unpack(b, n) for b, n in zip(t.column("blob").to_pylist(), t.column("runs").to_pylist(), strict=True)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _folded_again(buckets: int):
    """Runs of up to FAN chunks become one, with common keys folded, so that a bucket meets few runs."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        if bucket < 0:
            return t
        chunk = t.column("chunk")[0].as_py()
        return pa.Table.from_batches(_sent(chunk, buckets, *_runs(t), -1 - bucket))

    return run


def _met(t: pa.Table) -> pa.Table:
    """What a bucket's keys share."""
    schema = _rows(MET, 0).schema
    if t.column("bucket")[0].as_py() < 0:
        out = []
        for batch in t.to_batches():
            docs = batch.filter(pc.equal(batch.column("kind"), 0))
            out.append(_rows(MET, docs.num_rows, **{c: docs.column(c) for c in ("kind", "doc_id", "set_id", "n", "band", "own", "next", "blob")}))
            stars = batch.filter(pc.equal(batch.column("kind"), 2))
            for b, n in zip(stars.column("blob").to_pylist(), stars.column("runs").to_pylist(), strict=True):
                pair = np.frombuffer(pa.decompress(b, decompressed_size=n, codec="lz4", asbytes=True), np.int64).reshape(2, -1)
                out.append(_rows(MET, pair.shape[1], kind=np.full(pair.shape[1], 2, np.int32), key=pair[0], set_id=pair[1]))
            hot = batch.filter(pc.equal(batch.column("kind"), 1))
            for b, n in zip(hot.column("blob").to_pylist(), hot.column("runs").to_pylist(), strict=True):
                k, ids, _ = unpack(b, n)
                out.append(_rows(MET, len(k), kind=np.ones(len(k), np.int32), key=k.view(np.int64), common=np.ones(len(k), bool), set_id=ids))
        return pa.Table.from_batches(out, schema)
    k, ids, many, starts = grouped(*_runs(t))
    sizes = np.diff(starts, append=len(k))
    common = np.logical_or.reduceat(many, starts) | (sizes > FEW)
    # of keys that aren't common and have the same members, one is enough
    sign = np.add.reduceat(mix(ids.view(_U)), starts) + sizes.astype(_U)
    plain = np.flatnonzero(~common & (sizes > 1))
    one = np.zeros(len(starts), bool)
    one[plain[np.unique(sign[plain], return_index=True)[1]]] = True
    rows = np.repeat(one | common, sizes)
    n = int(rows.sum())
    out = [_rows(MET, n, kind=np.ones(n, np.int32), key=k[rows].view(np.int64), common=np.repeat(common, sizes)[rows], set_id=ids[rows])]
    starts = np.flatnonzero(np.concatenate([[True], k[rows][1:] != k[rows][:-1]])) if n else np.zeros(0, np.int64)
    a, b = star_pairs(ids[rows], starts)
    out.append(_rows(MET, len(a), kind=np.full(len(a), 2, np.int32), key=a, set_id=b))
    del k, ids, many
    tidy()
    return pa.Table.from_batches(out, schema)


def met(docs: DataFrame) -> DataFrame:
    """MET rows of documents (doc_id, text), saved."""
    parts = docs.rdd.getNumPartitions()
    buckets = max(width(docs.sparkSession), 3 * parts)
    sent, groups = sketched(docs, buckets), parts
    while groups > FAN:
        groups = -(-groups // FAN)
        sent = sent.groupBy("bucket", F.pmod(F.xxhash64("chunk"), F.lit(groups))).applyInArrow(_folded_again(buckets), SENT)
    out = saved(sent.groupBy("bucket").applyInArrow(_met, MET), "met-keys")
    release(docs.sparkSession)
    return out


FULL = "set_id long, shingles binary"


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id and shingles of the wanted sets (doc_id, set_id), from the text of each set's first document."""
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    texts = docs.select("doc_id", "text").join(side, "doc_id").select("set_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, raw, there = [], [], set()
                for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1)), strict=True):
                    if i not in there and set_id(s) == i:  # repeated doc_ids may have other texts
                        there.add(i)
                        ids.append(i)
                        raw.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], ["set_id", "shingles"])

    # repeated rows may give a set twice, which gives links twice
    return saved(texts.transform(mapped(run, FULL)), "full-sets")


def _good(test):
    """Keeps the rows (a, b, ...) that pass a test of the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                good = [test(*row) for row in zip(*(part.column(c).to_pylist() for c in range(2, part.num_columns)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sides(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with the columns of both sets."""
    a, b = (rows.select(F.col("set_id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in columns)) for k in "ab")
    return pairs.join(a, "a").join(b, "b")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of set_ids that are linked, saved."""
    fit = _sides(pairs, sets, "n", "sketch").where(F.least("n_a", "n_b") * OF >= F.greatest("n_a", "n_b") * LINK)
    near = saved(fit.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").transform(mapped(_good(lambda m, n, p, q: 9 * apart(p, q) <= m + n), "a long, b long")), "near-pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    full = full_sets(docs, saved(sets.join(wanted, "set_id", "left_semi").where("doc_id is not null").select("doc_id", "set_id"), "near-sets"))
    sides = _sides(near, full, "shingles").select("a", "b", "shingles_a", "shingles_b")
    out = saved(sides.transform(mapped(_good(lambda p, q: linked(np.frombuffer(p, _U), np.frombuffer(q, _U))), "a long, b long")), "links")
    release(docs.sparkSession)
    return out


def _rooted(rows: DataFrame, roots: DataFrame, column: str = "set_id") -> DataFrame:
    """rows with the root of their set's component so far (itself if it has no link)."""
    r = roots.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    return rows.join(r, rows[column] == r["_id"], "left").withColumn("root", F.coalesce("_root", column)).drop("_id", "_root")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _drawn(members: DataFrame, salt: int) -> DataFrame:
    """Pairs of sets with a member, drawn by hash, of one of their keys: the one whose hash is least."""
    one = members.groupBy("set_id").agg(F.min_by("key", F.xxhash64("key", F.lit(salt))).alias("key"))
    heads = one.groupBy("key").agg(F.min_by("set_id", F.xxhash64("set_id", F.lit(salt))).alias("head"))
    return one.join(heads, "key").where("set_id <> head").select(*_ordered("set_id", "head"))


def set_roots(found: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, root) of the sets that have links; root is one of the component's sets."""
    members = found.where("kind = 1").select("key", "set_id", "common")
    pairs = found.where("kind = 2").select(F.col("key").alias("a"), F.col("set_id").alias("b"))
    first = saved(pairs.distinct(), "first-pairs")
    roots = components(verified(first, sets, docs))
    # keys that still span components
    placed = _rooted(members, roots)
    span = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rows = saved(placed.join(span, "key", "left_semi").distinct(), "open-keys")
    few = rows.where("not common").groupBy("key").agg(F.collect_list(F.struct("set_id", "root")).alias("m"))
    few = few.select(F.explode("m").alias("p"), "m").select("p", F.explode("m").alias("q")).where("p.root < q.root").select(*_ordered("p.set_id", "q.set_id"))
    open_common = rows.where("common").select("key", "set_id")
    second = saved(few.unionByName(_drawn(open_common, 1)).unionByName(_drawn(open_common, 2)).distinct().join(first, ["a", "b"], "left_anti"), "second-pairs")
    if not second.isEmpty():
        roots = moved(roots, components(_between(verified(second, sets, docs), roots)))
    # sets that may have partners they share common keys with only
    spare = F.when(F.col("key").bitwiseAND((1 << BAND_BITS) - 1) == F.col("band"), F.col("own")).otherwise(F.col("next"))
    counted = open_common.groupBy("set_id", F.col("key").bitwiseAND((1 << BAND_BITS) - 1).alias("key")).agg(F.count(F.lit(1)).alias("n_common"))
    poor = saved(counted.join(sets.select("set_id", "band", "own", "next"), "set_id").where(F.col("n_common") >= spare).select("set_id").distinct(), "poor-sets")
    if poor.isEmpty():
        return roots
    held = open_common.join(poor, "set_id", "left_semi")
    heads = held.groupBy("key").agg(F.min("set_id").alias("b"))
    groups = components(held.join(heads, "key").select(F.col("set_id").alias("a"), "b").distinct())
    grouped_sets = saved(_rooted(groups.select(F.col("id").alias("set_id"), F.col("root").alias("grp")), roots), "poor-groups")
    last = saved(block_pairs(grouped_sets, sets).distinct(), "last-pairs")
    if last.isEmpty():
        return roots
    return moved(roots, components(_between(verified(last, sets, docs), roots)))


def _between(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links drawn between the roots of what they join."""
    out = _rooted(links, roots, "a").select(F.col("root").alias("a"), "b")
    return _rooted(out, roots, "b").select("a", F.col("root").alias("b"))


def block_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """members: set_id, grp, root. Pairs between components that pass the sketch bound: those outside the group's largest
    component against the whole group, BLOCK of them by ROWS of it in a task. Sketches alone are copied, not sets."""
    parts = members.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("grp").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.sum("size").alias("all"), (F.sum("size") - F.max("size")).alias("others")).where("others > 0")
    rows = members.join(largest, "grp").join(sets.select("set_id", "n", "sketch"), "set_id")
    blocks, slices = F.ceil(F.col("others") / BLOCK).cast("int"), F.ceil(F.col("all") / ROWS).cast("int")
    mine = lambda n, salt: F.pmod(F.xxhash64("set_id", F.lit(salt)), n).cast("int")
    what = ["grp", "set_id", "root", "n", "sketch"]
    asked = rows.where("root <> largest").select(*what, F.lit(True).alias("asks"), mine(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    held = rows.select(*what, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), mine(slices, 2).alias("slice"))

    def run(t: pa.Table) -> pa.Table:
        asks = np.array(t.column("asks").to_pylist(), bool)
        ids, roots, n = (t.column(c).to_numpy().astype(np.int64) for c in ("set_id", "root", "n"))
        raw = t.column("sketch").to_pylist()
        sizes = np.array([len(r) for r in raw])
        a, b = [], []
        for x in np.unique(sizes[asks]):
            for y in (x // 2, x, 2 * x):
                ask, have = np.flatnonzero(asks & (sizes == x)), np.flatnonzero(~asks & (sizes == y))
                if not len(ask) or not len(have):
                    continue
                w = min(x, y) // 8
                p, q = (_folded_bits(raw, at, w) for at in (ask, have))
                for i, bits in zip(ask, p, strict=True):
                    far = np.bitwise_count(q ^ bits).sum(1, dtype=np.int64)
                    small, large = np.minimum(n[have], n[i]), np.maximum(n[have], n[i])
                    near = have[(roots[have] != roots[i]) & (OF * small >= LINK * large) & (9 * far <= small + large)]
                    a.append(np.full(len(near), ids[i]))
                    b.append(ids[near])
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return asked.unionByName(held).groupBy("grp", "block", "slice").applyInArrow(run, "a long, b long")


def _folded_bits(raw: list[bytes], at: np.ndarray, words: int) -> np.ndarray:
    """Sketches of one length as rows of so many words."""
    bits = np.frombuffer(b"".join(raw[i] for i in at), _U).reshape(len(at), -1, words)
    return np.bitwise_xor.reduce(bits, axis=1)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = met(docs)
    held = found.where("kind = 0")
    sets = held.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "band", "own", "next")), F.first("blob").alias("sketch"))
    sets = saved(sets, "sets")
    with step(docs.sparkSession) as keep:
        roots = keep(set_roots(found, sets, docs), "roots")
    placed = _rooted(sets.where("doc_id is not null").select("set_id", "doc_id"), roots)
    # the least doc_id of a component of sets; a hot component is one group of sums, not of rows
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = saved(placed.join(least, "root").select(F.col("set_id").alias("_set"), "component_id"), "class-names")
    # one row a set: sets are joined by id, empty ones not at all; a set of thousands of copies is split by AQE
    out = held.join(names, (held["set_id"] == names["_set"]) & (held["n"] > 0), "left").drop("_set")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "set_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs, the same columns, with one row of each component: the one that names it. Rows without words stay.

    Of rows that repeat doc_id and text one stays; a component of rows without doc_id keeps one row of each text.
    """
    found = classes(docs)
    ids = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_keep"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
