"""PII: information-theoretic sanitisation, in DataFrame expressions alone.

Base spans are found by pattern and validity: e-mail addresses, IPv4 addresses, payment cards (Luhn), phone numbers. They are the protected
entities. Terms (runs of letters, marks and digits, of any length) are counted over the corpus by document: how many documents
hold the term and the entity, and how many hold the term at all. The share of the two is P(entity | term). Where the term
was seen with the entity in at least SUPPORT different texts, the share reaches GENERALISE, and so many texts
would hold the entity by chance, at its own P(entity), for fewer than 1 / DOUBT of the terms tried with it (in bits:
texts times divergence), all of the term's occurrences in all documents become spans too: they are generalised to
their class (name, word, number, code), or removed from REMOVE on. Exact copies are one text here.

Patterns are written so that matching is linear in the text (possessive runs, and no second start inside a run that has
failed) and finds exactly the leftmost non-overlapping matches of the plain patterns; for cards, those of twelve digits or more, as
shorter ones fail. Positions are code points.

Edge cases: null text is empty and stays null in sanitised output; repeated rows are rows of their own; documents without
entities change where they hold a disclosing term; words of scripts without spaces are whole runs; texts of any length and any number of
matches are read whole; of matches of two kinds at one place the first kind comes first (ties); a null doc_id stays null; other columns
travel in a struct, so their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that each kind needs: texts without it aren't searched.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SUPPORT = 3
DOUBT = 10
GENERALISE, REMOVE = 0.5, 0.8
TERM = r"[\p{L}\p{M}\p{N}]++"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def placed(text: Column, pattern: str | Column, good: Callable[[Column], Column] = lambda value: F.lit(True)) -> Column:
    """array of (start, value) of a pattern's matches that are good, from the lengths of the gaps between matches and of the matches.

    Lengths are added up in blocks of about the square root of the matches' number, and then over blocks, so that no
    array grows by one element a match; the matches are found once, as a lambda's argument.
    """
    whole = F.lit(f"({pattern})") if isinstance(pattern, str) else F.concat(F.lit("("), pattern, F.lit(")"))
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, whole, F.lit(1)).alias("value"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        own = F.array(F.struct(at.alias("start"), x["value"].alias("value")))
        return F.struct((at + F.coalesce(F.length(x["value"]), F.lit(0))).alias("at"), F.when(x["value"].isNotNull() & good(x["value"]), F.concat(s["out"], own)).otherwise(s["out"]).alias("out"))

    def over(s: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda m: F.struct((m["start"] + s["at"]).alias("start"), m["value"].alias("value")))
        return F.struct((s["at"] + block["at"]).alias("at"), F.concat(s["out"], F.array(moved)).alias("out"))

    def all_of(x: Column) -> Column:
        # there is one gap more than matches, so at least one element
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1), lambda i: F.aggregate(F.slice(x, i * size + 1, size), state, step))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,value:string>>>").alias("out"))
        return F.flatten(F.aggregate(blocks, start, over, lambda s: s["out"]))

    return F.get(F.transform(F.array(found), all_of), F.lit(0))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check sum of a string of digits is right."""
    r = F.reverse(number)

    def one(i: Column) -> Column:
        d = F.substring(r, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda n, i: n + one(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(value)).between(12, 19), luhn(digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    parts = []
    for rank, kind in enumerate(KINDS):
        need = NEEDS[kind]
        maybe = F.contains(text, F.lit(need)) if need else text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")
        good = placed(text, PATTERNS[kind], lambda v, kind=kind: valid(kind, v))
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))
        parts.append(F.when(maybe, spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_base(docs: DataFrame) -> DataFrame:
    """docs with _spans, and _entities: the hashes of the row's different entities, or null."""
    out = docs.withColumn("_spans", base_spans(F.coalesce("text", F.lit(""))))
    entities = F.array_distinct(F.transform("_spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    return out.withColumn("_entities", F.when(F.size("_spans") > 0, entities))


def evidence(places: str, share: str, base: Column) -> Column:
    """Bits against a term's being with the entity by chance: its texts times the divergence of share from base."""
    s, p = F.col(share), F.least(base, F.lit(1.0))
    without = F.when((s < 1) & (p < 1), (1 - s) * F.log2((1 - s) / (1 - p))).otherwise(0.0)
    return F.when(s > p, F.col(places) / s * (s * F.log2(s / p) + without)).otherwise(0.0)


def terms_of(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)))


def disclosing(marked: DataFrame) -> DataFrame:
    """(term, share) of terms that reveal an entity. marked: _row, text, _entities of all rows."""
    mentions = marked.where("_entities is not null").select("_row", F.xxhash64("text").alias("place"), F.explode("_entities").alias("entity"))
    mentions = saved(mentions, "pii-mentions")
    # an entity in fewer texts than SUPPORT can't have a term
    entity = mentions.groupBy("entity", "place").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places")).where(F.col("places") >= SUPPORT)
    entity = saved(entity.select("entity", "n"), "pii-entities")
    known = mentions.join(entity.select("entity"), "entity").groupBy("_row").agg(F.collect_list(F.struct("entity", "place")).alias("found"))
    held = marked.where("_entities is not null").select("_row", "text").join(known, "_row")
    pairs = held.select("found", F.explode(terms_of(F.col("text"))).alias("term")).select("term", F.inline("found"))
    seen = pairs.groupBy("term", "entity", "place").agg(F.count(F.lit(1)).alias("n")).groupBy("term", "entity").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("both")).where(F.col("places") >= SUPPORT)
    seen = saved(seen, "pii-pairs")
    # all words are counted before any join: partial counts are what is shuffled, whatever terms are in question
    frequency = marked.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = F.lit(float(max(1, marked.count())))
    tried = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("tried"))
    reveals = seen.join(frequency, "term").join(entity, "entity").join(tried, "entity").withColumn("share", F.col("both") / F.col("df"))
    reveals = reveals.where((F.col("share") >= GENERALISE) & (evidence("places", "share", F.col("n") / total) >= F.log2(F.col("tried") * DOUBT)))
    return saved(reveals.groupBy("term").agg(F.max("share").alias("share")), "pii-terms")


def general(term: Column) -> Column:
    """The class that a term is generalised to: a number, a code of letters and digits, a name (a capital first), or a word."""
    return F.when(term.rlike(r"^\p{N}+$"), "[NUMBER]").when(term.rlike(r"\p{N}"), "[CODE]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def occurrences(marked: DataFrame, reveals: DataFrame) -> DataFrame:
    """(_row, _terms) of rows that hold disclosing terms: start, end and share of every occurrence outside base spans."""
    words = marked.select("_row", F.explode(terms_of(F.col("text"))).alias("term"))
    by_row = words.join(reveals, "term").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("_shares"))
    # terms are letters, marks and digits, so they stand for themselves in a pattern
    found = by_row.withColumn("_pattern", F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(F.map_keys("_shares"), "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])")))
    rows = marked.select("_row", "text", "_spans").join(found, "_row")
    own = F.filter(placed(F.col("text"), F.col("_pattern")), lambda t: ~F.exists("_spans", lambda s: (s["start"] < t["start"] + F.length(t["value"])) & (t["start"] < s["end"])))
    terms = F.transform(own, lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["value"])).alias("end"), F.coalesce(F.element_at("_shares", F.lower(t["value"])), F.array_max(F.map_values("_shares"))).alias("share"), general(t["value"]).alias("general")))
    return rows.select("_row", terms.alias("_terms"))


def analysed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with _spans (base) and _terms (start, end, share), row by row."""
    marked = with_base(docs).select(*dict.fromkeys([*keep, "text"]), "_spans", "_entities").withColumn("_row", F.monotonically_increasing_id())
    marked = saved(marked, "pii-base")
    by_row = saved(occurrences(marked, disclosing(marked.select("_row", "text", "_entities"))), "pii-spans")
    return marked.select(*keep, "_spans", "_row").join(by_row, "_row", "left").drop("_row")


def all_spans() -> Column:
    """Base spans and terms (rank after all base kinds) by start; a term's value says what becomes of it: its class, or nothing."""
    rank = len(KINDS)
    terms = F.transform("_terms", lambda t: F.struct(t["start"].alias("start"), F.lit(rank).alias("rank"), F.lit("term").alias("kind"), t["end"].alias("end"), F.when(t["share"] >= REMOVE, F.lit("")).otherwise(t["general"]).alias("value")))
    return F.array_sort(F.concat("_spans", F.coalesce(terms, F.array().cast(SPAN))))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans, and how many spans there are, of every row."""
    rows = analysed(docs.select("doc_id", "text"), ["doc_id"])
    counts = [F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(joined(F.col("_spans")).cast("binary"), 256).alias("base_sha256"), joined(all_spans()).alias("spans"), F.size(all_spans()).cast("long").alias("n_spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs, the same columns, with every span's text replaced: base spans by their kind, terms generalised or removed."""
    cols = docs.columns
    # other columns travel in one struct, so that their names can't clash
    inner = docs.select("text", F.struct(*[F.col(c) for c in cols if c != "text"]).alias("_rest"))
    rows = analysed(inner, ["text", "_rest"]).withColumn("_all", all_spans())
    text = F.col("text")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        # overlapping spans are one hole in the text, named by the first
        put = F.when(x["kind"] == "term", x["value"]).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(gap, put))).otherwise(s["out"]).alias("out"))

    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    clean = F.when(F.size("_all") > 0, F.aggregate("_all", state, step, rest)).otherwise(text)
    out = rows.withColumn("_text", clean)
    back = {"text": F.col("_text")}
    if "n_chars" in cols:
        back["n_chars"] = F.when(F.size("_all") > 0, F.length("_text").cast("long")).otherwise(F.col("_rest.n_chars"))
    return out.select(*[back.get(c, F.col(f"_rest.{c}")).alias(c) for c in cols])
