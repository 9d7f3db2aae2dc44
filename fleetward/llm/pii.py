"""Personal data: patterns for four kinds, and information-theoretic sanitisation of the words that give them away.

Every expression is a built-in Spark function. A pattern's matches come from
regexp_extract_all and the gaps between them from split by the same pattern; their lengths
in code points add up to positions.

Protected entities are the values found, and the part of a value that its owner shares with
few others: an address's domain, an ip's first two parts, a card's first six digits, a phone
number without its last four. Over all different texts, counts of texts with an entity (n_e),
with a word (n_t) and with both, at any distance (n_te), tell what the word discloses:

    p(e) = n_e / n        p(e|t) = (n_te + k p(e)) / (n_t + k)        PMI = log2(p(e|t) / p(e))

The estimate is smoothed by k = PRIOR texts of the prior. A word is a span of kind "term"
wherever it stands in a text that holds the entity, if knowing it leaves at most
log2(1 / BELIEF) bits of the entity's information (p(e|t) >= BELIEF) and tells MIN_BITS at
least. With two texts of the prior, one text in which a word and an entity meet is no
evidence of a bond between them: it takes two that both have, and no other with the word, or
more. A word of many texts is none, unless most of them hold the same entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetward.llm.common import packed, small_side, stage, text_of

# The kinds in order and their patterns. They match what the plain patterns match; possessive
# repetition and the look-behind keep a long run of one character class from being scanned again and again.
PATTERNS = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
MARKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}
#: The disclosure threshold; texts of the prior that smooth it; least bits that a word tells; a word's least letters.
BELIEF = 0.5
PRIOR = 2
MIN_BITS = 3.0
MIN_TERM = 3
_WORD = "\\p{L}++"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _luhn(x: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's test."""
    back = F.rpad(F.reverse(x), 20, "0")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "card":
        n = F.length(_digits(x))
        return F.when(n.between(12, 19), _luhn(_digits(x))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    if kind == "ip":
        return F.forall(F.split(x, "\\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Valid matches as array<struct<s, e, x>>: start, end (exclusive), the match."""
    pattern = F.lit(PATTERNS[kind])
    gaps = F.split(text, PATTERNS[kind], -1)
    empty = F.array().cast("array<struct<s:int,e:int,x:string>>")
    found = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(0)), gaps,
        lambda x, gap: F.struct(F.length(gap).alias("gap"), F.length(x).alias("n"), x.alias("x"), (x.isNotNull() & _valid(kind, x)).alias("ok")),
    )

    def add(acc: Column, m: Column) -> Column:
        s = acc["at"] + m["gap"]
        one = F.array(F.struct(s.alias("s"), (s + m["n"]).alias("e"), m["x"].alias("x")))
        return F.struct((s + F.coalesce(m["n"], F.lit(0))).alias("at"), F.when(m["ok"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    summed = F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    sign = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    return F.when(sign, summed).otherwise(empty)


def _base(rows: DataFrame) -> DataFrame:
    """Adds to rows with a text t: h1 and h2 (its hash) and base: array<struct<s, o, e, kind, x>> in order."""
    out = rows.withColumns({kind: _spans(kind, F.col("t")) for kind in PATTERNS})
    tagged = [F.transform(kind, _tagged(o, kind)) for o, kind in enumerate(PATTERNS)]
    return out.withColumns({"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(7), "t"), "base": F.array_sort(F.concat(*tagged))}).drop(*PATTERNS)


def _tagged(o: int, kind: str):
    return lambda m: F.struct(m["s"].alias("s"), F.lit(o).alias("o"), m["e"].alias("e"), F.lit(kind).alias("kind"), m["x"].alias("x"))


def _replaced(text: Column, spans: Column, put) -> Column:
    """The text with put(span) in place of each span; where spans overlap, of the first one."""

    def step(acc: Column, m: Column) -> Column:
        new = m["s"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["s"] - acc["at"]), put(m))
        return F.struct(F.greatest(acc["at"], m["e"]).alias("at"), F.when(new, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def _masked() -> Column:
    """The text with blanks for its base spans, as long as it was: overlapping spans end where the furthest does."""
    t = F.col("t")

    def step(acc: Column, m: Column) -> Column:
        out = F.concat(acc["out"], F.substring(t, acc["at"] + 1, m["s"] - acc["at"]), F.repeat(F.lit(" "), m["e"] - F.greatest(acc["at"], m["s"])))
        return F.struct(F.greatest(acc["at"], m["e"]).alias("at"), out.alias("out"))

    done = F.aggregate("base", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return F.when(F.size("base") == 0, t).otherwise(done)


def _words(text: Column) -> Column:
    """Different words of a text, in small letters, of MIN_TERM letters at least."""
    found = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda x: F.length(x) >= MIN_TERM), F.lower))


def _placed(text: Column, wanted: Column) -> Column:
    """Places of the wanted words in a text, as array<struct<s, o, e, kind, x>>."""
    gaps = F.split(text, _WORD, -1)
    found = F.zip_with(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), gaps, lambda x, gap: F.struct(F.length(gap).alias("gap"), F.length(x).alias("n"), x.alias("x")))
    empty = F.array().cast("array<struct<s:int,o:int,e:int,kind:string,x:string>>")

    def add(acc: Column, m: Column) -> Column:
        s = acc["at"] + m["gap"]
        e = s + F.coalesce(m["n"], F.lit(0))
        one = F.array(F.struct(s.alias("s"), F.lit(len(PATTERNS)).alias("o"), e.alias("e"), F.lit("term").alias("kind"), F.lower(m["x"]).alias("x")))
        return F.struct(e.alias("at"), F.when(F.array_contains(wanted, F.lower(m["x"])), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])


def _entities(m: Column) -> Column:
    """What a span protects: the value, and the part that few share."""
    low, digits, kind = F.lower(m["x"]), _digits(m["x"]), m["kind"]
    value = F.when(kind.isin("card", "phone"), digits).otherwise(low)
    part = F.when(kind == "email", F.substring_index(low, "@", -1)).when(kind == "ip", F.substring_index(low, ".", 2)).when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 4))
    return F.array(F.concat(kind, F.lit("="), value), F.concat(kind, F.lit("~"), part))


def _once(based: DataFrame) -> list[DataFrame]:
    """The different texts (h1, h2, t, base), in two tables: those that occur once, and one row of each other."""
    rows = based.select("h1", "h2", "t", "base")
    again = small_side(stage(rows.groupBy("h1", "h2").count().where(F.col("count") > 1).select("h1", "h2"), "pii-copies", few=True), 32)
    return [rows.join(again, ["h1", "h2"], "left_anti"), rows.join(again, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])]


def _text_counts(texts: list[DataFrame]) -> DataFrame:
    """(term, n_t): in how many different texts each word stands, summed in the tasks before it is shuffled."""
    counts = [x.select(F.explode(_words(_masked())).alias("term")).groupBy("term").agg(F.count("*").alias("n")) for x in texts]
    return counts[0].unionByName(counts[1]).groupBy("term").agg(F.sum("n").alias("n_t"))


def _belief(n_te: Column, n_t: Column, share: Column) -> Column:
    return (n_te + PRIOR * share) / (n_t + PRIOR)


def _told(n_te: Column, n_t: Column, share: Column) -> Column:
    """Whether so many texts of a word with an entity, of so many with the word, disclose the entity."""
    return (_belief(n_te, n_t, share) >= BELIEF) & (F.log2(_belief(n_te, n_t, share) / share) >= MIN_BITS)


def _flagged(based: DataFrame) -> DataFrame:
    """(h1, h2, words): for each text that has any, the words that disclose an entity of the text."""
    col = F.col
    texts = _once(based)
    # A single number each: texts in all, and what bounds the words that any entity lets through.
    n = float(max(sum(x.count() for x in texts), 1))
    held = texts[0].unionByName(texts[1]).where(F.size("base") > 0)
    held = held.select("h1", "h2", F.explode(F.array_distinct(F.flatten(F.transform("base", _entities)))).alias("entity"))
    held = stage(held, "pii-held", few=True)
    share = col("n_e") / n
    shared = held.groupBy("entity").agg(F.count("*").alias("n_e")).where(_told(col("n_e"), col("n_e"), share))
    shared = stage(shared.withColumns({"share": share, "most": (col("n_e") + PRIOR * share) / BELIEF - PRIOR}), "pii-shared", few=True)
    bound = shared.agg(F.max("most").alias("most"), F.max("share").alias("share")).first()
    holders = stage(held.join(small_side(shared, 64 + F.octet_length("entity")), "entity"), "pii-holders", few=True)
    # Counts and words grow with the corpus, so they meet by a shuffle at every size.
    counts = _text_counts(texts).where((col("n_t") <= (bound["most"] or 0.0) + 1e-6) & (_belief(col("n_t"), col("n_t"), F.lit(bound["share"] or 0.0)) >= BELIEF - 1e-9))
    terms = [x.where(F.size("base") > 0).select("h1", "h2", F.explode(_words(_masked())).alias("term")) for x in texts]
    terms = stage(terms[0].unionByName(terms[1]).join(counts, "term"), "pii-terms", few=True)
    pairs = holders.join(terms, ["h1", "h2"]).where(col("n_t") <= col("most") + 1e-6).groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.max("n_t").alias("n_t"), F.max("share").alias("share"))
    secret = stage(pairs.where(_told(col("n_te"), col("n_t"), col("share"))).select("entity", "term"), "pii-disclosing", few=True)
    marked = holders.select("h1", "h2", "entity").join(terms.select("h1", "h2", "term"), ["h1", "h2"]).join(secret, ["entity", "term"])
    return marked.groupBy("h1", "h2").agg(F.collect_set("term").alias("words"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def _with_terms(based: DataFrame) -> DataFrame:
    """Adds all: base and term spans in order. Only texts that hold an entity are shuffled to meet their words."""
    flagged = stage(_flagged(based), "pii-flagged", few=True)
    held = based.where(F.size("base") > 0).join(flagged, ["h1", "h2"], "left")
    every = F.array_sort(F.concat("base", _placed(_masked(), F.col("words"))))
    held = held.withColumn("all", F.when(F.col("words").isNull(), F.col("base")).otherwise(every)).drop("words")
    return held.unionByName(based.where(F.size("base") == 0).withColumn("all", F.col("base")))


def find(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Null text counts as empty, with no spans; copies of a text get the same spans and count once in the
    statistics; repeated rows and null ids stay; an empty table gives no rows. Other columns are left out.
    """
    out = _with_terms(stage(_base(docs.select("doc_id", text_of().alias("t"))), "pii-base"))
    count = lambda kind: F.size(F.filter("all", lambda m: m["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in PATTERNS),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), count("term").alias("n_term"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by a mark of its kind; where spans overlap, the first one's mark.

    Null text stays null; all rows and columns stay, whatever their names; repeated rows and null ids are like
    others; an empty table stays empty.
    """
    based = _base(packed(docs).withColumn("t", text_of("row.text"))).drop("t")
    out = _with_terms(stage(based, "pii-base").withColumn("t", text_of("row.text")))
    mark = lambda m: reduce(lambda c, k: c.when(m["kind"] == k, F.lit(MARKS[k])), MARKS, F.when(F.lit(False), F.lit("")))
    text = F.when(F.col("row.text").isNotNull(), _replaced(F.col("t"), F.col("all"), mark))
    return out.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
