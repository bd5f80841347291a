"""LM scoring: a probabilistic suffix tree over words.

A text is its words (A-Z lower-cased) and an end; its start counts as a word that is never predicted. The tree holds contexts,
the last one to DEPTH words, with counts of next words. Level by level, a string of words is counted only if its parts were
kept, and kept if it occurs LEAST times in the training texts, however many those are: the tree grows with the corpus.
A context is retained if the divergence test finds a kept next word, likely enough after it, whose probability
differs from that after the context without its first word by the factor FAR. Suffixes of retained contexts are retained.

Next-word distributions are smoothed by those of the next shorter context (Witten-Bell); words that aren't kept after a
context share the rest by the shorter context. The root is add-one smoothed over the V training words and one
unknown word. Scores use the longest retained suffix of what precedes a word.

No task holds the tree. Texts are encoded once into chunks of about CHUNK words. For each level a chunk sends the sorted
hashes of its distinct strings, with their training counts, to buckets by range of hashes; a bucket adds them up and answers every
chunk in the order asked: the count of kept strings, and which one chunk counts the string for its context. So a
chunk knows all that the divergence test asks for its strings. In the end chunks send, for their contexts, how many kept words
follow, how often, and whether one of them differs; that, for a context's suffixes too, decides what is retained. A frequent string
costs a bucket one row a chunk.

Strings are known by KEY_BITS-bit hashes. Edge cases: null and blank texts are the end alone; an empty training set leaves the
unknown word only; an empty table gives no rows; repeated rows count as often as they occur, each with a score of its own; null
doc_ids are training rows (their remainder isn't 2); other columns are ignored. A very long text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, release, saved, step, tidy, width
from .words import mix, words_of

DEPTH = 3
LEAST = 2
FAR = 1.5
LIKELY = 1e-4
KEY_BITS = 56
_U = np.uint64
_SHIFT = _U(64 - KEY_BITS)
#: Hashes that stand for the end and the start of a text.
END, START = (int(x) for x in mix(np.array([0x5DEECE66D, 0xB5297A4D], _U)) >> _SHIFT)
#: Words of a chunk, and of all chunks for each bucket, about.
CHUNK, BUCKET = 1_000_000, 1_500_000
#: In place of a level: what contexts are followed by.
CONTEXTS = 99


def held_out(doc_id: Column) -> Column:
    """Rows the model doesn't learn from: crc32 of doc_id as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def longer(context: np.ndarray, last: np.ndarray, words: int) -> np.ndarray:
    """The hash of a string of so many words from that of all but its last word and the last word's."""
    return mix(context * _U(0x9E3779B97F4A7C15) + last * _U(0xC2B2AE3D27D4EB4F) + _U(words)) >> _SHIFT


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order; for each key its place among them; for each distinct key a place where it stands."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ranked[first], at, order[first]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 8-byte values as byte planes, compressed."""
    return pa.compress(b"".join(_planes(np.ascontiguousarray(c)) for c in columns), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n * columns, codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(p.reshape(8, n).T).view(np.int64).reshape(-1) for p in raw.reshape(columns, 8 * n)]


def pack_keys(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Sorted keys, as differences, and columns."""
    return pack([np.diff(keys, prepend=_U(0)).view(np.int64), *columns])


def unpack_keys(blob: bytes, n: int, columns: int) -> list[np.ndarray]:
    gaps, *rest = unpack(blob, n, columns + 1)
    return [np.cumsum(gaps.view(_U), dtype=_U), *rest]


CHUNKS = "chunk long, n int, vocabulary binary, tokens binary, total int, doc_ids array<long>, held array<boolean>, sizes array<int>"
PARTS = "chunk long, level int, bucket int, n int, tokens long, words long, blob binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_(), "double": pa.float64()}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(list(c), _KINDS[t]) for c, (_, t) in zip(columns, names, strict=True)], [c for c, _ in names])


def encoded(docs: DataFrame) -> DataFrame:
    """Chunks of docs (doc_id, held, text): distinct words with training counts, and the words by their places there."""

    def row(number: int, ids: list, held: list, sizes: list, words: list) -> pa.RecordBatch:
        vocabulary, at, _ = distinct(np.concatenate(words))
        train = np.repeat(~np.concatenate(held), np.concatenate(sizes))
        chunk = (TaskContext.get().partitionId() << 32) + number
        blob = pack_keys(vocabulary, [np.bincount(at[train], minlength=len(vocabulary))])
        tokens = pa.compress(_planes(at.astype(np.uint32)), codec="zstd", asbytes=True)
        return _table(CHUNKS, [(chunk, len(vocabulary), blob, tokens, len(at), ids, np.concatenate(held).tolist(), np.concatenate(sizes).tolist())]).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total, number = ([], [], [], []), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                h, cuts = words_of(part.column(2))
                size = np.diff(cuts) + 1
                words = np.full(len(h) + len(size), END, _U)
                words[np.arange(len(h)) + np.repeat(np.arange(len(size)), size - 1)] = h >> _SHIFT
                found[0].extend(part.column(0).to_pylist())
                for column, x in zip(found[1:], (np.array(part.column(1).to_pylist(), bool), size, words), strict=True):
                    column.append(x)
                total += len(words)
                if total >= CHUNK:
                    yield row(number, *found)
                    found, total, number = ([], [], [], []), 0, number + 1
        if total:
            yield row(number, *found)

    return docs.transform(mapped(run, CHUNKS))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> _U(KEY_BITS - 32)) * _U(buckets) >> _U(32)


def _sent(chunk: int, level: int, buckets: int, keys: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """Parts of sorted keys for each bucket."""
    ends, rows = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1, dtype=_U)), []
    for b in np.flatnonzero(np.diff(ends)).tolist():
        at = slice(ends[b], ends[b + 1])
        rows.append((chunk, level, b, int(ends[b + 1] - ends[b]), None, None, pack_keys(keys[at], [c[at] for c in columns])))
    return rows


class _Chunk:
    """A chunk's words in one row of positions, with one before each text for its start; levels are filled in as answers come.
    ``keys[k]``, ``counts[k]``, ``kept[k]`` belong to the string of k + 1 words that ends at each position."""

    def __init__(self, table: pa.Table, answers: pa.Table, totals: tuple[int, int, int], buckets: int, depth: int) -> None:
        r = table.to_pylist()[0]
        self.depth = depth
        self.number, self.doc_ids, self.held, self.buckets = r["chunk"], r["doc_ids"], r["held"], buckets
        self.tokens, self.words, texts = totals
        raw = np.frombuffer(pa.decompress(r["tokens"], decompressed_size=4 * r["total"], codec="zstd", asbytes=True), np.uint8)
        at = np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).reshape(-1)
        self.sizes = np.array(r["sizes"])
        ends = np.cumsum(self.sizes + 1)
        self.starts = ends - self.sizes - 1
        self.left = np.arange(ends[-1]) - np.repeat(self.starts, self.sizes + 1)
        self.train = np.repeat(~np.array(self.held, bool), self.sizes + 1)
        self.word = self.left > 0
        self.answers: dict[int, list] = {}
        for a in sorted(answers.to_pylist(), key=lambda a: a["bucket"]):
            self.answers.setdefault(a["level"], []).append((a["blob"], a["n"]))
        key, n = np.full(ends[-1], START, _U), np.full(ends[-1], texts)
        key[self.word] = unpack_keys(r["vocabulary"], r["n"], 1)[0][at]
        n[self.word] = self._answer(0, 1)[0][at]
        self.keys, self.counts, self.kept = [key], [n], [(n >= LEAST) | ~self.word]
        self.root = (n + 1) / (self.tokens + self.words + 1)
        self.counted: list[tuple] = []

    def _answer(self, level: int, columns: int) -> list[np.ndarray]:
        found = [unpack(blob, n, columns) for blob, n in self.answers.get(level, [])]
        return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * columns

    def after(self, k: int) -> np.ndarray:
        """Positions after a kept context of k words.

        A context that occurs as often as it does without its first word is followed by the same words as often, so it differs in
        none. As a longest context it can't be retained as another's suffix either, and is left out.
        """
        ok = self.left >= k
        ok[1:] &= self.kept[k - 1][:-1]
        if k == self.depth > 1:
            ok[1:] &= self.counts[k - 1][:-1] != self.counts[k - 2][:-1]
        return np.flatnonzero(ok)

    def strings(self, k: int) -> tuple[np.ndarray, ...]:
        """Positions where a string of k + 1 words is counted, its distinct hashes, which one each has, and where each stands."""
        at = self.after(k)
        at = at[self.kept[k - 1][at]]
        keys, which, first = distinct(longer(self.keys[k - 1][at - 1], self.keys[0][at], k + 1))
        return at, keys, which, at[first]

    def ask(self, k: int) -> list[tuple]:
        at, keys, which, _ = self.strings(k)
        return _sent(self.number, k, self.buckets, keys, [np.bincount(which[self.train[at]], minlength=len(keys))])

    def learn(self, k: int) -> None:
        """Takes in the answers of level k: counts of kept strings, and which of them this chunk counts for their contexts."""
        at, keys, which, first = self.strings(k)
        answer = self._answer(k, 1)[0]
        key, n = np.zeros(len(self.left), _U), np.zeros(len(self.left), np.int64)
        key[at], n[at] = keys[which], answer[which] >> 1
        self.keys.append(key)
        self.counts.append(n)
        self.kept.append(n >= LEAST)
        self.counted.append(first[(answer & 1).astype(bool)])

    def contexts(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct contexts of all lengths; the positions after contexts, for each length; and which context each has."""
        at = [self.after(k) for k in range(1, self.depth + 1)]
        keys, which, _ = distinct(np.concatenate([self.keys[k][a - 1] for k, a in enumerate(at)]))
        return keys, at, np.split(which, np.cumsum([len(a) for a in at])[:-1])

    def ask_contexts(self) -> list[tuple]:
        """For each context: kept next words that this chunk counts, how often they occur, and whether one differs."""
        keys, at, which = self.contexts()
        depth = self.depth
        place = np.zeros((depth, len(self.left)), np.int64)
        for k in range(depth):
            place[k, at[k]] = which[k]
        kinds, kept, differ = (np.zeros(len(keys), np.int64) for _ in range(3))
        for k in range(1, depth + 1):
            i = self.counted[k - 1]
            n, count = self.counts[k][i], self.counts[k - 1][i - 1]
            kinds += np.bincount(place[k - 1, i], minlength=len(keys))
            kept += np.bincount(place[k - 1, i], n, len(keys)).astype(np.int64)
            p = n / np.maximum(count, 1)
            shorter = self.root[i] if k == 1 else self.counts[k - 1][i] / np.maximum(self.counts[k - 2][i - 1], 1)
            far = i[(p >= LIKELY) & ((p >= FAR * shorter) | (p * FAR <= shorter))]
            for j in range(k):
                differ[place[j, far]] = 1
        return _sent(self.number, CONTEXTS, self.buckets, keys, [kinds, kept, differ])

    def scores(self) -> pa.Table:
        _, at, which = self.contexts()
        kinds, kept = self._answer(CONTEXTS, 2)
        p = self.root.copy()
        for k in range(1, self.depth + 1):
            retained = kinds[which[k - 1]] > 0
            i, c = at[k - 1][retained], which[k - 1][retained]
            count, n = self.counts[k - 1][i - 1], np.where(self.kept[k][i], self.counts[k][i], 0)
            total = np.maximum(count + kinds[c], 1).astype(float)
            p[i] = n / total + np.maximum(count - kept[c] + kinds[c], 0.5) / total * p[i]
        add = lambda x: np.add.reduceat(np.where(self.word, x, 0), self.starts)
        columns = [self.doc_ids, self.held, self.sizes, add(self.counts[0] > 0), add(np.log10(self.root)), add(np.log10(p))]
        names = [c.split() for c in SCORES.split(", ")]
        return pa.Table.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(columns, names, strict=True)], [c for c, _ in names])


def _answered(t: pa.Table) -> pa.Table:
    """Adds up a bucket's parts of one level and answers each chunk."""
    rows = sorted(t.select(["chunk", "level", "bucket", "n", "blob"]).to_pylist(), key=lambda r: r["chunk"])
    level, bucket = rows[0]["level"], rows[0]["bucket"]
    columns = 3 if level == CONTEXTS else 1
    keys, *values = (np.concatenate(c) for c in zip(*(unpack_keys(r["blob"], r["n"], columns) for r in rows), strict=True))
    order = np.argsort(keys)
    new = np.empty(len(keys), bool)
    new[0] = True
    ranked = keys[order]
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    first = np.minimum.reduceat(order, starts)
    sums = [np.add.reduceat(v[order], starts) for v in values]
    out = []
    if level == CONTEXTS:
        kinds, kept, differ = sums
        answers = [np.where(differ > 0, x, 0)[which] for x in (kinds, kept)]
    else:
        n = sums[0]
        if level:
            answer = (np.where(n >= LEAST, n, 0) << 1)[which]
            # the first chunk that asks counts the string
            answer[first[n >= LEAST]] |= 1
            answers = [answer]
        else:
            answers = [n[which]]
            out.append((None, level, bucket, 0, int(n.sum()), int((n > 0).sum()), b""))
    ends = np.cumsum([r["n"] for r in rows])
    for r, end in zip(rows, ends.tolist(), strict=True):
        at = slice(end - r["n"], end)
        out.append((r["chunk"], level, bucket, r["n"], None, None, pack([a[at] for a in answers])))
    return _table(PARTS, out)


def _words(chunks: DataFrame, buckets: int) -> DataFrame:
    """Parts of level 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, counts = unpack_keys(r["vocabulary"], r["n"], 1)
                yield from _table(PARTS, _sent(r["chunk"], 0, buckets, keys, [counts])).to_batches()

    return chunks.select("chunk", "n", "vocabulary").transform(mapped(run, PARTS))


def _asking(k: int, depth: int, buckets: int, totals: tuple[int, int, int]):
    """A chunk's parts of level k; after the last level, those of its contexts."""

    def run(c: pa.Table, a: pa.Table) -> pa.Table:
        chunk = _Chunk(c, a, totals, buckets, depth)
        for j in range(1, min(k, depth + 1)):
            chunk.learn(j)
        out = _table(PARTS, chunk.ask(k) if k <= depth else chunk.ask_contexts())
        del chunk
        tidy()
        return out

    return run


def scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs: doc_id, held (not learned from), text. SCORES and train_tokens of every row."""
    with step(docs.sparkSession) as keep:
        return keep(_scores(docs, depth), "lm-scores")


def _scores(docs: DataFrame, depth: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held", "text")
    chunks = saved(encoded(rows), "lm-chunks")
    size = chunks.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)).alias("texts")).first()
    buckets = max(1, min(width(spark), size.n // (BUCKET // 8)), -(-size.n // BUCKET))
    totals = (0, 0, int(size.texts))
    both = lambda: chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    for k in range(depth + 2):
        asked = both().applyInArrow(_asking(k, depth, buckets, totals), PARTS) if k else _words(chunks, buckets)
        found = saved(asked.groupBy("bucket").applyInArrow(_answered, PARTS), "lm-answers")
        if k == 0:
            sums = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
            totals = (int(sums.tokens), int(sums.words), totals[2])
            answers = found.where("chunk is not null")
        else:
            answers = answers.unionByName(found)
        # Spark holds on to the step that ran last, so an empty one runs before this one's shuffle files are let go of
        del asked
        spark.range(1).count()
        release(spark)

    def score(c: pa.Table, a: pa.Table) -> pa.Table:
        chunk = _Chunk(c, a, totals, buckets, depth)
        for j in range(1, depth + 1):
            chunk.learn(j)
        out = chunk.scores()
        del chunk
        tidy()
        return out

    return both().applyInArrow(score, SCORES).withColumn("train_tokens", F.lit(totals[0]).cast("long"))


def scored(docs: DataFrame) -> DataFrame:
    """All documents, learning from those that aren't held out."""
    out = scores(docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
