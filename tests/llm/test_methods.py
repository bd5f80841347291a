"""Operators against brute force, exact round trips, and damaged input."""

import random

import numpy as np
import pytest

from pixelloom.llm import fingerprints, html, lm, media, mixing, packing, simjoin, tokens, toxicity
from pixelloom.llm.queries import vocabulary


def test_ogg_round_trip_and_damage():
    r = random.Random(1)
    for n in (0, 2, 192, 8160, 60_000, 600_000):
        payload = r.randbytes(n)
        clip = media.encode(payload)
        assert media.decode(clip)[0] == payload
        hurt = bytearray(clip)
        hurt[len(hurt) // 2] ^= 1
        with pytest.raises(media.OggError):
            media.decode(bytes(hurt))
        with pytest.raises(media.OggError):
            media.decode(clip[:-1])


def test_ogg_checksum_bit_by_bit():
    def slow(data):
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    for data in (b"", b"a", bytes(range(256)), b"OggS" * 99):
        assert media.page_checksum(data) == slow(data)


def test_sainte_lague_against_one_seat_at_a_time():
    r = random.Random(2)
    for _ in range(60):
        votes = [r.randint(0, 1000) for _ in range(r.randint(1, 9))]
        seats = r.randint(0, 60)
        won = [0] * len(votes)
        for _ in range(seats if any(votes) else 0):
            won[max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
        assert mixing.sainte_lague(votes, seats) == won


def test_targets_fill_up_to_the_limit():
    t = mixing.targets([10, 100, 1000], [3, 1, 2])
    assert t[0] == 20 and sum(t) == 1665 and all(x <= 2 * n for x, n in zip(t, [10, 100, 1000], strict=True))


def test_packing_keeps_items_and_capacity():
    r = random.Random(3)
    lengths = [r.randint(1, 100) for _ in range(300)]
    p, _ = packing.evolve(lengths, 100, 7)
    assert sorted(i for b in p.bins for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) == 100 - f <= 100 for b, f in zip(p.bins, p.free, strict=True))
    best = packing.best_fit(lengths, sorted(range(300), key=lambda i: -lengths[i]), 100)
    assert len(p.bins) <= len(best.bins)


def test_generations_beat_best_fit_where_it_misses_the_bound():
    r = random.Random(8)
    lengths = [r.randint(1200, 1600) for _ in range(600)]
    order = sorted(range(600), key=lambda i: -lengths[i])
    first, ran = packing.evolve(lengths, 4096, 1)
    assert ran > 0 and len(first.bins) < len(packing.best_fit(lengths, order, 4096).bins)
    # an island goes on from its migrants, and loses nothing
    again, _ = packing.evolve(lengths, 4096, 2, [packing.assignment(first, 600)])
    assert len(again.bins) <= len(first.bins)


def test_crossover_injects_whole_bins():
    r = random.Random(9)
    lengths = [r.randint(1, 60) for _ in range(80)]
    a, b = (packing.best_fit(lengths, r.sample(range(80), 80), 100) for _ in range(2))
    child = packing.crossover(a, b, lengths, 100, random.Random(1))
    assert sorted(i for x in child.bins for i in x) == list(range(80)) and all(f >= 0 for f in child.free)
    assert any(sorted(x) in [sorted(y) for y in b.bins] for x in child.bins)


def test_tokens_equal_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = ["".join(r.choice("ab '\n\t\r1,.é  it's'S’Aßü-_\\\"²　\x85日") for _ in range(r.randint(0, 60))) for _ in range(400)]
    # texts that are cut: plain letters and signs, single spaces beside other white space
    texts += ["".join(r.choice("ab \n\t\r1'é.,a.b!") for _ in range(r.randint(0, 14))) for _ in range(5000)]
    texts += [None, "", " ", "  ", " a", "a ", "\n \n", "<|endoftext|>", "word " * 50_000, "x" * 100_000]
    for name, cut in (("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")):
        own, t = tokens.encoder(vocabulary(name), cut), Tokenizer.from_file(vocabulary(name))
        t.encode_special_tokens = True
        ids, cuts = own.column(pa.array(["cut away", *texts]).slice(1))
        for x, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
            assert ids[a:b].tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_memory_of_pieces_turns_over(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "MEMORY", 40)
    own = tokens.Encoder(vocabulary("byte_bpe_50k.json"), "bytes")
    texts = [f"one two{i % 7} three{i}. one" for i in range(300)]
    for part in (texts[:100], texts[:100], texts[100:], texts):
        ids, cuts = own.column(pa.array(part))
        for x, a, b in zip(part, cuts[:-1], cuts[1:], strict=True):
            assert ids[a:b].tolist() == own.model.encode(x, add_special_tokens=False).ids


def test_digest_is_a_bounded_difference():
    a, b = fingerprints.digest(b"the same text again and again"), fingerprints.digest(bytes(range(256)))
    assert fingerprints.difference(a, a) == 0 and 0 < fingerprints.difference(a, b) <= fingerprints.MOST
    assert fingerprints.difference(a, b) == fingerprints.difference(b, a)


def _edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_automaton_against_edit_distance():
    r = random.Random(5)
    words = ["stupid", "moron", "worthless", "idiot"]
    lexicon = toxicity.Lexicon([(w, False, 1.0 + i) for i, w in enumerate(words)])
    for _ in range(600):
        w = list(r.choice(words))
        for _ in range(r.randint(0, 2)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randint(0, 1)] = r.choice(["", "x", "s"])
        w = "".join(w)
        near = [(_edits(w, x), x) for x in words if w == x or (len(x) >= toxicity.FUZZY_FROM and _edits(w, x) <= 1)]
        got = lexicon.match(w)
        assert (got[0] > 0) == bool(near)
        if near:
            assert got[1] == min(near)[0]


def test_stems_match_beginnings():
    lexicon = toxicity.Lexicon([("lowei", True, 2.0)])
    assert lexicon.match("loweischaft") == (2.0, 0) and lexicon.match("lower")[0] == 0


def _links(texts):
    sets = [simjoin.shingles(t) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(sets[j]) and simjoin.linked(sets[i], sets[j])}


def test_join_against_all_pairs(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts = []
    for _ in range(30):
        base = [r.choice(vocab) for _ in range(r.choice([6, 12, 40, 200]))]
        if r.random() < 0.5:
            base += passage.split()
        for _ in range(r.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 60))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            texts.append(" ".join(copy))
    # a group of near copies that is larger than FEW, so that hot keys and blocks are used
    base = [r.choice(vocab) for _ in range(120)]
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(len(copy))] = r.choice(vocab)
        texts.append(" ".join(copy))
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in _links(texts):
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simjoin.classes(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_sketch_bounds_the_difference():
    r = np.random.default_rng(7)
    for n, m in ((5, 9), (300, 320), (5000, 700)):
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], r.integers(0, 1 << 62, m).astype(np.uint64)]))
        real = len(np.setxor1d(a, b))
        assert simjoin.apart(simjoin.sketch(a), simjoin.sketch(b)) <= real


def test_lm_keys_round_trip():
    keys = np.unique(np.random.default_rng(8).integers(0, 1 << 56, 5000).astype(np.uint64))
    counts = np.where(np.arange(len(keys)) % 50 == 0, 1 << 40, 2)
    k, c = lm.unpack_keys(lm.pack_keys(keys, [counts]), len(keys), 1)
    assert (k == keys).all() and (c == counts).all()


def test_labeller_on_pages_it_has_not_seen():
    xs, ys = html.training_set(77_000_000, 120)
    found = html.labeller().label(xs)
    right = np.concatenate([f == (y > 0) for f, y in zip(found, ys, strict=True)])
    assert right.mean() > 0.97


def test_labeller_gradient():
    xs, ys = html.training_set(78_000_000, 4)
    net = html.Labeller(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = html.padded(xs)
    y = np.zeros(mask.shape, np.float32)
    for i, v in enumerate(ys):
        y[i, : len(v)] = v
    _, g = net.gradients(x, mask, y)
    for name in ("o", "hf", "xb"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, d = net.w[name][at], 1e-3
        net.w[name][at] = old + d
        up = net.gradients(x, mask, y)[0]
        net.w[name][at] = old - d
        down = net.gradients(x, mask, y)[0]
        net.w[name][at] = old
        assert abs((up - down) / (2 * d) - g[name][at]) < 0.05 * abs(g[name][at]) + 1e-4
