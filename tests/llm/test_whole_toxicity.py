"""Misspelled and disguised words are hits whatever their length; usual words near an entry aren't."""

from pixelloom.llm import toxicity

ENTRIES = [(w, False, 3.0) for w in ("moron", "idiot", "trash", "scum", "stupid")]


def test_short_and_disguised_words():
    lexicon = toxicity.Lexicon(ENTRIES, frozenset(["crash"]))
    for word in ("morron", "idiott", "trassh", "scumm", "stup1d", "idi0t", "st*pid", "1diot", "mor_on", "tr@sh"):
        assert toxicity.TOKEN.findall(f"a {word}, b")[1] == word
        assert lexicon.match(word) == (3.0, 1), word
        assert toxicity.features(f"well {word} there", lexicon)[1] > 0
    assert lexicon.match("stupid_thing")[0] and lexicon.match("moron99")[1] == 0
    assert lexicon.match("crash") == (0.0, 0) and lexicon.match("harmless") == (0.0, 0)


def test_words_that_clean_documents_use_are_plain(spark):
    docs = [(i, f"you moron number word{i}" if i % 2 else f"the morons and a maroon boat {i}") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert "morons" in model.plain and "moron" not in model.plain
    assert toxicity.Lexicon(model.entries, model.plain).match("morron")[1] == 1
