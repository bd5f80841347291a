"""Token ids of public tokenizers, encoded fast: a text is cut where the tokenizer's own pre-tokenizer always cuts
it, and each distinct piece of a column is encoded once and remembered.

``words`` (white space is dropped, letters lower-cased) cuts at white space. ``bytes`` cuts before single spaces, which
go with what follows; a text with two spaces in a row isn't cut. Cuts are only used in texts of characters for
which this holds beyond doubt (``PLAIN``); any other text is encoded whole. Cutting, finding the distinct pieces of a column and
putting ids together are array operations; the library encodes what a worker hasn't met. The memory of pieces is emptied when
it is full, which changes speed only.

Strings of special tokens in a text count as ordinary text. Null and empty texts have no ids. Texts of any length are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import memory

#: What is not printable ASCII, tab, newline, carriage return, or a printable Latin letter or sign (other white space, and
#: the one letter whose lower-case form is two characters).
NOT_PLAIN = r"[^\t\n\r\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{20ac}]"
MEMORY = 700_000
#: Bytes of text that are encoded at once, about.
PART = 6 << 20
#: Signs that part from a letter or digit before them.
SIGNS = pa.array(list(".,;:!?"))
#: Pieces that are encoded as one text.
JOINED = 500


class _Memory:
    """Ids of distinct pieces, each encoded with ``before`` in front. Known pieces are one Arrow array, whose look-up is an array operation;
    the older half is forgotten when it is full."""

    def __init__(self, model: Tokenizer, before: str, joined: bool) -> None:
        self.model, self.before, self.joined = model, before, joined
        # where pieces begin with a space, ids that begin with one show where they begin
        self.spaced = np.array([(model.id_to_token(i) or "").startswith("\u0120") for i in range(model.get_vocab_size())])
        self.known, self.flat, self.ends = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after another, and how many each has."""
        if len(self.known) > MEMORY:
            half = len(self.known) // 2
            # copied, so that the old buffers go
            self.known = pa.concat_arrays([self.known.slice(half), pa.array([], pa.string())])
            self.flat, self.ends = self.flat[self.ends[half] :].copy(), self.ends[half:] - self.ends[half]
        at = pc.index_in(pieces, self.known)
        fresh = pc.is_null(at)
        new = pieces.filter(fresh)
        at = np.array(at.fill_null(0), np.int64)
        if len(new):
            at[np.asarray(fresh)] = np.arange(len(self.known), len(self.known) + len(new))
            ids, sizes = self._encoded(new.to_pylist())
            self.known = pa.concat_arrays([self.known, new])
            self.flat = np.concatenate([self.flat, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        sizes = self.ends[at + 1] - self.ends[at]
        return self.flat[spread(self.ends[at], sizes)], sizes

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces, JOINED of them as one text; those whose cuts wouldn't hold there go alone."""
        size, found = JOINED if self.joined else 1, []
        for run in [pieces[at : at + size] for at in range(0, len(pieces), size)]:
            # two spaces in a row aren't cut
            for part in [run] if self.joined and (not self.before or "" not in run) else [[p] for p in run]:
                found.append(self._one(part))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _one(self, run: list[str]) -> tuple[np.ndarray, np.ndarray]:
        e = self.model.encode(self.before + " ".join(run), add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        if len(run) == 1:
            return ids, np.array([len(ids)])
        if self.before:
            return ids, np.diff(np.flatnonzero(self.spaced[ids]), append=len(ids))
        lengths = np.fromiter(map(len, run), np.int64, len(run)) + 1
        starts = np.fromiter((a for a, _ in e.offsets), np.int64, len(ids))
        return ids, np.bincount(np.searchsorted(np.cumsum(lengths) - lengths, starts, "right") - 1, minlength=len(run))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of all runs, one after another."""
    before = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    kind = np.int32 if n < 1 << 31 and (len(starts) == 0 or int(starts.max()) < 1 << 31) else np.int64
    out = np.repeat((starts - before).astype(kind), sizes)
    out += np.arange(n, dtype=kind)
    return out


class Encoder:
    def __init__(self, path: str, cut: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.cut = cut
        bytes_ = cut == "bytes"
        self.later = _Memory(self.model, " " if bytes_ else "", True)
        # a text's first piece has no space before it; nor has a sign
        self.first = _Memory(self.model, "", not bytes_)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of one text."""
        return self.column(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the places where each text's begin (one more than texts)."""
        texts = texts.fill_null("")
        whole = np.asarray(pc.match_substring_regex(texts, NOT_PLAIN))
        if self.cut == "bytes":
            whole = whole | np.asarray(pc.match_substring(texts, "  "))
        size = np.zeros(len(texts), np.int64)
        cut_ids, size[~whole] = self._cut(texts.filter(pa.array(~whole)))
        if not whole.any():
            return cut_ids, np.concatenate([[0], np.cumsum(size)])
        found = [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        size[whole] = [len(f) for f in found]
        cuts = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(cuts[-1], np.uint32)
        out[spread(cuts[:-1][~whole], size[~whole])] = cut_ids
        out[spread(cuts[:-1][whole], size[whole])] = np.concatenate(found)
        return out, cuts

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of texts that may be cut."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.cut == "words":
            lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts)))
        else:
            lists = pc.split_pattern(texts, " ")
        counts = np.diff(np.asarray(lists.offsets))
        coded = lists.flatten().dictionary_encode()
        first = np.cumsum(counts) - counts
        code = np.asarray(coded.indices)
        flat, size = self._pieces(coded.dictionary, self.later)
        if self.cut == "bytes":
            heads = pc.take(coded, pa.array(first)).dictionary_decode().dictionary_encode()
            code = code.copy()
            code[first] = np.asarray(heads.indices) + len(size)
            more, sizes = self._pieces(heads.dictionary, self.first)
            flat, size = np.concatenate([flat, more]), np.concatenate([size, sizes])
        starts = np.cumsum(size) - size
        return flat[spread(starts[code], size[code])], np.add.reduceat(np.append(size[code], 0), first) * (counts > 0)

    def _pieces(self, pieces: pa.Array, memory: _Memory) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of distinct pieces. A sign after a letter or digit is a piece of its own to all tokenizers here."""
        last = pc.index_in(pc.utf8_slice_codeunits(pieces, -1), SIGNS)
        ends = pc.and_(pc.is_valid(last), pc.utf8_is_alnum(pc.utf8_slice_codeunits(pieces, -2, -1)))
        stems = pc.if_else(ends, pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
        flat, size = memory.ids(stems.dictionary)
        more, sizes = self.first.ids(SIGNS)
        n = len(size)
        flat, size = np.concatenate([flat, more]), np.concatenate([size, sizes])
        starts = np.cumsum(size) - size
        # each piece is its stem, and its sign if it has one
        both = np.empty((len(pieces), 2), np.int64)
        both[:, 0], both[:, 1] = np.asarray(stems.indices), n + np.asarray(last.fill_null(0))
        sizes = size[both]
        sizes[~np.asarray(ends), 1] = 0
        return flat[spread(starts[both.ravel()], sizes.ravel())], sizes.sum(1)


def parts(batches: Iterable[pa.RecordBatch], column: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs whose texts have about ``most`` bytes; a longer text is a run of its own."""
    held, size = [], 0
    for batch in batches:
        for part in _runs(batch, column, most):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > most * 5 // 4:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _runs(batch: pa.RecordBatch, column: int, most: int) -> list[pa.RecordBatch]:
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    # equal runs, so that the last one isn't a small rest
    step = max(1, -(-int(sizes.sum()) // max(1, -(-int(sizes.sum()) // most))))
    part = (np.cumsum(sizes) - sizes) // step
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return [batch.slice(a, b - a) for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True)]


_open: dict[tuple[str, str], Encoder] = memory("tokens")


def encoder(path: str, cut: str) -> Encoder:
    """One per worker process and vocabulary file."""
    if (path, cut) not in _open:
        _open[path, cut] = Encoder(path, cut)
    return _open[path, cut]
