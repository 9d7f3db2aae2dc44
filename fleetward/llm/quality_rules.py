"""Quality rules: count-based limits, then distribution divergence from language references.

Every expression is a built-in Spark function. A document's histogram of character
classes and its histogram of common words are held against references of the language
whose common words it uses most (the last by name among equals, so a text without any
is held against that one); references are sums over all documents of the input.
The distance is Jensen-Shannon's (square root of the divergence, base 2, 0 to 1).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetward.llm.common import BLANKS, packed, stage, text_of, words_of

# The commonest words of four languages.
COMMON_WORDS = {
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "be", "at", "by", "this", "are", "from", "or"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur"],
}
SYMBOLS = "[#*$%&|<>]"
#: Positions of 3-word windows are packed into so many bits beside their hash; longer texts take the other way.
POSITION_BITS = 21
#: Distances beyond which a document is rejected, and the words it must have to be judged.
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.30
MIN_WORDS_CLASSES = 50
MIN_WORDS_COMMON = 100
#: A reference needs so many words of its language in all; else the language is not judged.
MIN_REFERENCE_WORDS = 2000

CLASSES = ["lower", "upper", "digit", "blank", "stop", "mark"]
_P = "__qr_"


def _n(column: Column) -> Column:
    return column.cast("long")


def _removed(text: Column, pattern: str) -> Column:
    """Code points of text that the pattern covers."""
    return _n(F.length(text) - F.length(F.regexp_replace(text, pattern, "")))


def _hits(words: Column, own: list[str]) -> Column:
    return F.size(F.filter(words, lambda x: x.isin(own)))


def measured(docs: DataFrame) -> DataFrame:
    """docs with columns __qr_*: base counts and histograms. Layered, so that each array is computed once."""
    p, col, get = _P, F.col, F.get
    mask = (1 << POSITION_BITS) - 1
    out = docs.withColumn(p + "t", text_of())
    out = out.withColumn(p + "w", words_of(col(p + "t")))
    grams = F.transform(
        F.slice(col(p + "w"), 1, F.greatest(F.size(p + "w") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, get(col(p + "w"), i + 1), get(col(p + "w"), i + 2)),
    )
    out = out.withColumn(p + "g", grams)
    packed = F.transform(col(p + "g"), lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    out = out.withColumn(p + "s", F.sort_array(packed))
    near = lambda x, y: F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS)
    alike = F.filter(col(p + "s"), lambda x, i: near(x, get(col(p + "s"), i - 1)) | near(x, get(col(p + "s"), i + 1)))
    places = F.when(
        F.size(p + "g") < mask, F.transform(alike, lambda x: x.bitwiseAND(F.lit(mask)).cast("int"))
    ).otherwise(F.transform(col(p + "g"), lambda h, i: i))
    out = out.withColumn(p + "c", places)
    # The packed hashes are cut short; what they hold alike is compared by the whole hash.
    whole = F.sort_array(F.transform(col(p + "c"), lambda i: F.struct(get(col(p + "g"), i).alias("h"), i.alias("i"))))
    out = out.withColumn(p + "m", whole)
    same = F.filter(
        col(p + "m"),
        lambda x, i: (x["h"] == get(col(p + "m"), i - 1)["h"]) | (x["h"] == get(col(p + "m"), i + 1)["h"]),
    )
    covered = F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    lines = F.filter(F.split(col(p + "t"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    out = out.withColumn(p + "lines", lines)
    low = F.transform(col(p + "w"), lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))))
    every = sorted({x for own in COMMON_WORDS.values() for x in own})
    out = out.withColumn(p + "f", F.filter(low, lambda x: x.isin(every)))
    hits = [F.struct(_hits(col(p + "f"), own).alias("n"), F.lit(k).alias("k")) for k, own in COMMON_WORDS.items()]
    out = out.withColumn(p + "lang", F.array_max(F.array(*hits)))
    own_words = reduce(lambda c, k: c.when(col(p + "lang")["k"] == k, F.array(*map(F.lit, COMMON_WORDS[k]))), COMMON_WORDS, F.when(F.lit(False), None))
    n = F.size(p + "w")
    t = col(p + "t")
    letters = _removed(t, "\\p{L}+")
    out = out.withColumns(
        {
            p + "n_words": _n(n),
            p + "word_chars": _n(F.coalesce(F.length(F.array_join(p + "w", "")), F.lit(0))),
            p + "n_symbols": _removed(t, SYMBOLS + "+"),
            p + "n_dup_lines": _n(F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))),
            p + "n_repeat_words": _n(F.size(covered)),
            p + "k": col(p + "lang")["k"],
            p + "letters": letters,
            p + "upper": _removed(t, "\\p{Lu}+"),
            p + "digit": _removed(t, "\\p{Nd}+"),
            p + "stop": _removed(t, "[.,;:?'\"()-]+"),
            p + "own": F.transform(own_words, lambda w: _n(F.size(F.filter(col(p + "f"), lambda x: x == w)))),
        }
    )
    chars = _n(F.length(t))
    blank = chars - col(p + "word_chars")
    classes = F.array(
        col(p + "letters") - col(p + "upper"), col(p + "upper"), col(p + "digit"), blank, col(p + "stop"),
        F.greatest(chars - blank - col(p + "letters") - col(p + "digit") - col(p + "stop"), F.lit(0)),
    )
    own = F.coalesce(col(p + "own"), F.array().cast("array<bigint>"))
    total = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumns({p + "classes": classes, p + "common": F.concat(own, F.array(col(p + "n_words") - total))})


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def references(measures: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Shares by language, summed over all documents. At most one row a language comes to the driver."""
    p = _P
    # A condition in the sums, not a filter: Spark would push that below the projections that build the arrays.
    fit = lambda x: F.sum(F.when(~base_failed(), x))
    sums = [fit(F.get(p + "classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    width = max(len(x) for x in COMMON_WORDS.values()) + 1
    sums += [fit(F.get(p + "common", F.lit(i))).alias(f"w{i}") for i in range(width)]
    rows = measures.groupBy(p + "k").agg(*sums).collect()
    out = {}
    for row in rows:
        classes = [row[f"c{i}"] or 0 for i in range(len(CLASSES))]
        common = [row[f"w{i}"] or 0 for i in range(len(COMMON_WORDS[row[p + "k"]]) + 1)]
        if sum(common) >= MIN_REFERENCE_WORDS:
            out[row[p + "k"]] = ([x / sum(classes) for x in classes], [x / sum(common) for x in common])
    return out


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts from reference shares; null if there are no counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    both = F.zip_with(counts, reference, lambda n, q: part(n / total, q) + part(q, n / total))
    return F.when(total > 0, F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0))))


def base_failed() -> Column:
    n = F.col(_P + "n_words")
    return (n < 50) | (100 * F.col(_P + "n_repeat_words") > 50 * n)


def with_verdict(measures: DataFrame, refs: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """Adds __qr_base_failed, __qr_class_distance, __qr_word_distance (null: not judged) and __qr_kept."""
    p, col = _P, F.col
    pick = lambda at: reduce(
        lambda c, k: c.when(col(p + "k") == k, F.array(*map(F.lit, refs[k][at]))), refs, F.when(F.lit(False), F.array().cast("array<double>"))
    )
    n = col(p + "n_words")
    out = measures.withColumns(
        {
            p + "base_failed": base_failed(),
            p + "class_distance": F.when(n >= MIN_WORDS_CLASSES, js_distance(col(p + "classes"), pick(0))),
            p + "word_distance": F.when(n >= MIN_WORDS_COMMON, js_distance(col(p + "common"), pick(1))),
        }
    )
    far = (F.coalesce(col(p + "class_distance"), F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce(col(p + "word_distance"), F.lit(0.0)) > MAX_WORD_DISTANCE)
    return out.withColumn(p + "kept", ~col(p + "base_failed") & ~far)


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, kept, the language and both distances.

    Null text counts as empty; an empty text fails the base rule; repeated rows are judged alike; an empty
    table gives no rows. Other columns of docs are left out, whatever their names.
    """
    p = _P
    keep = [F.col("doc_id"), *(F.col(p + x) for x in [*MEASURES, "k", "classes", "common"])]
    measures = stage(measured(docs.select("doc_id", "text")).select(*keep), "quality-rules")
    out = with_verdict(measures, references(measures))
    names = [*MEASURES, "base_failed", "kept"]
    return out.select("doc_id", *(F.col(p + x).alias(x) for x in names), F.col(p + "k").alias("judged_as"), *(F.col(p + x).alias(x) for x in ("class_distance", "word_distance")))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs. References come from all rows of docs.

    Null and empty texts fail the base rule and go; repeated rows stay or go together; null ids are like others;
    columns stay, whatever their names; an empty table stays empty. Texts are measured once: rows are staged with
    their measures.
    """
    p = _P
    measures = measured(packed(docs, "text")).select("row", *(F.col(p + x) for x in [*MEASURES, "k", "classes", "common"]))
    measures = stage(measures, "quality-rows")
    judged = with_verdict(measures, references(measures))
    return judged.where(p + "kept").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def oracle_sql() -> str:
    """judge() in DuckDB's SQL, with both distances to six digits."""
    blank = " \\t\\n\\x0B\\f\\r"
    words = {k: "[" + ", ".join(f"'{w}'" for w in own) + "]" for k, own in COMMON_WORDS.items()}
    gone = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    hits = ", ".join(f"{{'n': len(list_filter(lw, lambda x: list_contains({own}, x))), 'k': '{k}'}}" for k, own in words.items())
    own = "CASE lang " + " ".join(f"WHEN '{k}' THEN {own}" for k, own in words.items()) + " END"
    mark = "[.,;:?''\"()-]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{blank}]+') AS w FROM documents),
g AS (SELECT k, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) AS h FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
c AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, h) AS n FROM g) WHERE n > 1),
r AS (SELECT k, count(DISTINCT j) AS rep FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM c) GROUP BY k),
n AS (SELECT k, count(*) - count(DISTINCT x) AS dup FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^{blank}]') GROUP BY k),
l AS (SELECT *, list_transform(w, lambda x: lower(rtrim(x, '.,;:!?'))) AS lw FROM d),
m AS (
  SELECT k, doc_id, t, lw, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {gone(SYMBOLS + "+")} AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words,
    list_extract(list_reverse_sort([{hits}]), 1).k AS lang, {gone(chr(92) + "p{L}+")} AS letters, {gone(chr(92) + "p{Lu}+")} AS upper_, {gone(chr(92) + "p{Nd}+")} AS digit, {gone(mark)} AS stop
  FROM l LEFT JOIN r USING (k) LEFT JOIN n USING (k)),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, length(t) - word_chars AS blank,
    list_transform({own}, lambda v: len(list_filter(lw, lambda x: x = v))) AS own FROM m),
v AS (SELECT *, [letters - upper_, upper_, digit, blank, stop, greatest(length(t) - blank - letters - digit - stop, 0)] AS cl, list_append(own, n_words - list_sum(own)) AS co FROM q),
e AS (SELECT k, lang, base_failed, kind, i, x, sum(x) OVER (PARTITION BY k, kind) AS total FROM (
  SELECT k, lang, base_failed, 1 AS kind, unnest(range(1, 7)) AS i, unnest(cl)::BIGINT AS x FROM v UNION ALL SELECT k, lang, base_failed, 2, unnest(range(1, len(co) + 1)), unnest(co)::BIGINT FROM v)),
f AS (SELECT lang, kind, i, sum(x) AS x, sum(sum(x)) OVER (PARTITION BY lang, kind) AS total FROM e WHERE NOT base_failed GROUP BY 1, 2, 3),
z AS (SELECT k, e.kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + s)) ELSE 0 END + CASE WHEN s > 0 THEN s * log2(2 * s / (p + s)) ELSE 0 END) / 2, 0)) AS dist
  FROM (SELECT e.k, e.kind, e.x / e.total::DOUBLE AS p, f.x / f.total::DOUBLE AS s FROM e JOIN f USING (lang, kind, i)
    WHERE e.total > 0 AND lang IN (SELECT lang FROM f WHERE kind = 2 GROUP BY 1 HAVING any_value(total) >= {MIN_REFERENCE_WORDS})) e GROUP BY 1, 2),
o AS (SELECT v.*, CASE WHEN n_words >= {MIN_WORDS_CLASSES} THEN a.dist END AS cd, CASE WHEN n_words >= {MIN_WORDS_COMMON} THEN b.dist END AS wd FROM v LEFT JOIN z a ON a.k = v.k AND a.kind = 1 LEFT JOIN z b ON b.k = v.k AND b.kind = 2)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(cd, 0) > {MAX_CLASS_DISTANCE}::DOUBLE OR coalesce(wd, 0) > {MAX_WORD_DISTANCE}::DOUBLE) AS kept, lang AS judged_as, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM o"""
