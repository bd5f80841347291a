"""Terms are found for frequent and rare entities, in small and large tables."""

from pixelloom.llm import pii

FILL = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango".split()


def _text(i, *more):
    return " ".join([*(FILL[(i * k + k) % len(FILL)] for k in range(1, 6)), f"case{i}x", *more])


def _sanitised(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in pii.sanitised(df).collect()}


def test_a_table_of_any_size_has_terms(spark):
    own = [_text(i, "Zebulon zeb@mail.org", "end") for i in range(5)]
    for rows in (40, 300, 2000):
        got = _sanitised(spark, own + [_text(i) for i in range(5, rows)])
        assert all("Zebulon" not in got[i] and "[EMAIL]" in got[i] for i in range(5))
        assert all(got[i] == _text(i) for i in range(5, rows))


def test_a_frequent_entity_has_terms(spark):
    got = _sanitised(spark, [_text(i, "Zebulon hot@mail.org", "end") if i % 3 == 0 else _text(i) for i in range(300)])
    assert all("Zebulon" not in t for t in got.values())
    assert all(got[i] == _text(i) for i in range(300) if i % 3)


def test_every_occurrence_of_a_term_of_any_length_and_distance(spark):
    far = " ".join(FILL) + " " + " ".join(reversed(FILL))
    own = [_text(i, "Kim X7 Zebulon", far, "zeb@mail.org", far, "kim.") for i in range(8)]
    other = [_text(8, "(KIM, zebulon"), *(_text(i, far) for i in range(9, 60))]
    got = _sanitised(spark, own + other)
    for i in range(9):
        assert not {"kim", "x7", "zebulon"} & set(got[i].lower().replace(".", " ").replace("(", " ").replace(",", " ").split())
        assert far in got[i] or i == 8
    assert all(got[i] == _text(i, far) for i in range(9, 60))


def test_terms_are_generalised_or_removed_by_their_share(spark):
    """A name that is with the entity in all its texts goes; one, a number and a code that are so in most texts become their classes."""
    own = [_text(i, "Zebulon zeb@mail.org Yolanda 4711 x9y wombat", "end") for i in range(9)]
    other = [_text(i, "Yolanda 4711 x9y wombat") for i in range(9, 13)]
    got = _sanitised(spark, own + other + [_text(i) for i in range(13, 400)])
    for i in range(13):
        assert "Zebulon" not in got[i] and got[i].split()[-4:] == ["[NAME]", "[NUMBER]", "[CODE]", "[WORD]"], got[i]
    assert all(got[i] == _text(i) for i in range(13, 400))


def test_disclosure_against_plain_counts(spark):
    """The terms found are those of plain Python's counts over documents."""
    import math
    import random
    import re
    from collections import Counter, defaultdict

    r = random.Random(5)
    texts = []
    for i in range(300):
        words = [r.choice(FILL) for _ in range(12)]
        if i % 10 == 0:
            words += ["amber@mail.org", r.choice(["Quill", "Quill", "tango"])]
        if i % 15 == 1:
            words += ["+49 30 1234567", "Basalt"]
        if i % 40 == 2:
            words += ["Quill"]
        texts.append(" ".join([*words, f"case{i}"]))
    terms = [set(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    entities = [{m for m in ("amber@mail.org", "+49 30 1234567") if m in t} for t in texts]
    df, n, both = Counter(t for s in terms for t in s), Counter(e for s in entities for e in s), defaultdict(Counter)
    for s, es in zip(terms, entities, strict=True):
        for e in es:
            both[e].update(s)
    expected = set()
    for e, c in both.items():
        seen = {t: k for t, k in c.items() if k >= pii.SUPPORT}
        for t, k in seen.items():
            p, q = k / df[t], n[e] / len(texts)
            bits = df[t] * (p * math.log2(p / q) + ((1 - p) * math.log2((1 - p) / (1 - q)) if p < 1 else 0)) if p > q else 0
            if p >= pii.GENERALISE and bits >= math.log2(len(seen) * pii.DOUBT):
                expected.add(t)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = set()
    for x in pii.spans(rows).collect():
        for s in filter(None, x.spans.split(",")):
            kind, a, b = s.split(":")
            if kind == "term":
                found.add(texts[x.doc_id][int(a) : int(b)].lower())
    # parts of the entities themselves are inside base spans
    assert expected and found == {t for t in expected if t not in ("amber", "mail", "org", "49", "30", "1234567")}
