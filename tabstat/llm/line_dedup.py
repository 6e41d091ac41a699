"""Operator 10: near-duplicate lines by a deletion-neighbourhood join, in SQL
functions only.

A line is a run of words (separated by blanks). A line goes if it equals an
earlier line, whatever its length, or if both have ``min_words`` words or more
and it is within one word edit (a word changed, added or left out) of an
earlier line. Earlier means by document id (null first), then document, then
line number.

1. Equal lines are collapsed to their first occurrence.
2. Of two lines within one edit, the first or the last half is equal, so only
   lines that share a half-line hash with another line go on.
3. Every such line emits itself and all its variants with one word left out as
   hashed keys. Lines with the same variant at the same place differ in that
   word at most; a line whose variant is another whole line has one word more.
   The variants are made once and written with an 8-byte number of the line;
   those that meet no other line end there. The earliest line of each key
   comes from an aggregate, so a key shared by very many lines makes no pairs.
4. Each line and its earliest partner are compared word by word.

Cases: null and empty texts have no lines; lines without a word always stay;
in rows that repeat id and text the same lines go (they are one document); a
text whose lines all go becomes empty, and ``dedup_lines`` can drop it; empty
tables give empty results; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .shared import identity, sized

MIN_WORDS = 8  # of lines that are compared within an edit


def _words(line: str) -> str:
    """Words of a line whose blanks are spaces; one character to split on
    needs no regular expression per line."""
    return f"array_remove(split({line}, ' '), '')"


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, ln, words) of each line with a word."""
    text = F.col(text_col).cast("string")
    for blank in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    base = docs.select(F.col(id_col).alias("id"), *identity(F.col(id_col), F.col(text_col)), text.alias("text"))
    # one row per document: rows that repeat id and text have the same lines
    lines = base.select("id", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return lines.select("id", "k1", "k2", "ln", F.expr(_words("line")).alias("words")).where(F.size("words") > 0)


def _halves() -> Column:
    """Keys of the halves of a line of n words as seen by lines of n and of
    n + 1 words."""
    return F.expr("""flatten(transform(array(size(words), size(words) - 1), g -> array(
        xxhash64(g, 'head', slice(words, 1, int(g / 2))),
        xxhash64(g, 'tail', slice(words, size(words) - (g - int(g / 2)) + 1, g - int(g / 2))))))""")


def _prefixes(values: str) -> str:
    """SQL for the xor of the values before each place and, at the end, of all.
    By blocks of 128, so that the work stays linear for long lines."""
    add = "array(0L), (a, x) -> concat(a, array(element_at(a, -1) ^ x))"
    blocks = f"transform(sequence(0, int(ceil(size({values}) / 128)) - 1), b -> aggregate(slice({values}, b * 128 + 1, 128), {add}))"
    return f"""transform(array({blocks}), v -> transform(array(aggregate(transform(v, y -> element_at(y, -1)), {add})), t ->
        transform(sequence(0, size({values})), i -> get(t, int(i / 128)) ^ coalesce(get(get(v, int(i / 128)), i % 128), 0L))))[0][0]"""


def _variant_keys() -> Column:
    """Key of the line and keys of its variants with one word left out. A line
    is hashed as the xor of its (word, place) hashes; a variant takes the
    hashes before the word and, from the next place down, those after it."""
    here, down = "transform(words, (w, i) -> xxhash64(w, i))", "transform(words, (w, i) -> xxhash64(w, i - 1))"
    n = "size(words)"
    return F.expr(f"""transform(array(struct({here} AS a, {down} AS b)), s -> transform(array(struct({_prefixes('s.a')} AS a, {_prefixes('s.b')} AS b)), p -> concat(
        array(xxhash64(get(p.a, {n}), {n})),
        transform(sequence(0, {n} - 1), i -> xxhash64(get(p.a, i) ^ get(p.b, {n}) ^ get(p.b, i + 1), {n} - 1)))))[0][0]""")


def within_one(a: str, b: str) -> Column:
    """True if word arrays a and b are within one edit."""
    at = f"coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false), 0), least(size({a}), size({b})) + 1)"
    rest = lambda x, skip: f"slice({x}, int({at}) + {skip}, size({x}))"
    return F.expr(f"""CASE size({a}) - size({b})
        WHEN 0 THEN {rest(a, 1)} = {rest(b, 1)}
        WHEN 1 THEN {rest(a, 1)} = {rest(b, 0)}
        WHEN -1 THEN {rest(a, 0)} = {rest(b, 1)}
        ELSE false END""")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, k1, k2, n_lines, removed): per document with a line, how many it
    has and the sorted numbers (from 0) of those that go."""
    lines = line_table(docs, id_col, text_col)
    place = F.struct("id", "k1", "k2", "ln")
    halves = F.when(F.size("words") >= min_words, _halves())
    seen = lines.select("id", "k1", "k2", "ln", F.xxhash64("words").alias("h1"), F.hash("words").alias("h2"), halves.alias("halves"))
    seen = materialize(seen.distinct() if _repeats(docs, id_col, text_col) else seen, "lines")

    first = seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times"), F.first("halves").alias("halves"))
    first = materialize(first, "first_lines")
    keys = first.select("first", F.explode("halves").alias("key"))
    common = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    survivors = keys.join(common, "key", "left_semi").select("first.*").distinct()
    survivors = sized(materialize(survivors, "half_matches"), 64)

    # the words of the surviving lines, once each
    wanted = survivors.select("k1", "k2").distinct()
    texts = docs.select(F.col(id_col).alias(id_col), F.col(text_col), *identity(F.col(id_col), F.col(text_col)))
    texts = texts.join(sized(materialize(wanted, "half_match_docs"), 32), ["k1", "k2"], "left_semi")
    again = line_table(texts, id_col, text_col).select("k1", "k2", "ln", "words")
    full = again.join(survivors, ["k1", "k2", "ln"]).select(place.alias("place"), "words").dropDuplicates(["place"])
    full = materialize(full.withColumn("line", F.monotonically_increasing_id()), "line_words")

    variants = materialize(full.select("line", F.posexplode(_variant_keys()).alias("at", "key")), "variants")
    # most keys have one line only: those go before the lines' places move
    met = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    places = sized(full.select("line", "place"), 72)
    variants = materialize(variants.join(met, "key", "left_semi").join(places, "line").select("place", "at", "key"), "met_variants")
    same = variants.groupBy("key", "at").agg(F.min("place").alias("same"))
    by_key = same.groupBy("key").agg(F.min(F.when(F.col("at") == 0, F.col("same"))).alias("whole"), F.min(F.when(F.col("at") > 0, F.col("same"))).alias("longer"))
    judged = variants.join(same, ["key", "at"]).join(by_key, "key")
    partner = F.when(F.col("at") == 0, F.col("longer")).otherwise(F.least("same", "whole"))
    links = judged.select("place", partner.alias("partner")).where("partner < place").groupBy("place").agg(F.min("partner").alias("partner"))
    pairs = links.join(full, "place").join(full.select(F.col("place").alias("partner"), F.col("words").alias("others")), "partner")
    near = pairs.where(within_one("words", "others")).select(F.col("place").alias("first"), F.lit(True).alias("near"))

    verdict = first.where("times > 1").select("first").join(near, "first", "full_outer")
    verdict = verdict.join(first.select("first", "h1", "h2"), "first").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    judged = seen.select("id", "k1", "k2", "ln", "h1", "h2").join(verdict, ["h1", "h2"], "left")
    gone = F.when(F.col("first").isNotNull() & (F.col("near") | (place != F.col("first"))), F.col("ln"))
    return judged.groupBy("id", "k1", "k2").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(gone)).alias("removed"))


def _repeats(docs: DataFrame, id_col: str, text_col: str) -> bool:
    """Whether rows repeat id and text; without such rows no line row repeats."""
    counts = docs.groupBy(*identity(F.col(id_col), F.col(text_col))).count()
    return counts.where("count > 1").limit(1).count() > 0


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                drop_empty: bool = False) -> DataFrame:
    """docs with the duplicate lines left out of the text; ``length_col``, if
    given, gets the new number of characters; ``drop_empty`` drops documents
    of which no word is left."""
    found = duplicate_lines(docs, id_col, text_col).where(F.size("removed") > 0)
    found = materialize(found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("removed").alias("__removed")), "removed_lines")
    keys = identity(F.col(id_col), F.col(text_col))
    joined = docs.select("*", keys[0].alias("__k1"), keys[1].alias("__k2")).join(found, ["__k1", "__k2"], "left")
    lines = F.split(F.col(text_col), "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__removed")
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn(text_col, text)
    if length_col:
        out = out.withColumn(length_col, F.when(F.col("__removed").isNull(), F.col(length_col)).otherwise(F.char_length(text_col).cast(docs.schema[length_col].dataType)))
    if drop_empty:
        out = out.where(F.col("__removed").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*docs.columns)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = duplicate_lines(docs).select("k1", "k2", "n_lines", "removed")
    keys = docs.select("doc_id", *identity(F.col("doc_id"), F.col("text")))
    out = keys.join(found, ["k1", "k2"], "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
                      F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.array_join(F.transform("removed", lambda i: i.cast("string")), ","), F.lit("")).alias("removed_lines"))


# Brute force over all pairs of distinct lines of close length is too slow in
# SQL on long tables, so the oracle joins on halves and compares word by word.
ORACLE = r"""
WITH l AS (SELECT doc_id, ln - 1 AS ln, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)),
ok AS (SELECT doc_id, ln, w, array_to_string(w, ' ') AS k, len(w) AS n FROM l WHERE len(w) > 0),
f AS (SELECT k, any_value(w) AS w, any_value(n) AS n, min((doc_id, ln)) AS p FROM ok GROUP BY k),
h AS (SELECT k, w, n, p, g, unnest([('head', array_to_string(w[1:g//2], ' ')), ('tail', array_to_string(w[n - (g - g//2) + 1:n], ' '))]) AS half
      FROM (SELECT *, unnest([n, n - 1]) AS g FROM f WHERE n >= 8)),
c AS (SELECT DISTINCT a.k, a.w AS aw, b.w AS bw FROM h a JOIN h b ON a.g = b.g AND a.half = b.half AND b.p < a.p),
near AS (SELECT DISTINCT k FROM c WHERE
      (len(aw) = len(bw) AND len(list_filter(range(1, len(aw) + 1), lambda i: aw[i] <> bw[i])) <= 1)
   OR (len(aw) = len(bw) + 1 AND len(list_filter(range(1, len(aw) + 1), lambda i: array_to_string(aw[1:i-1], ' ') || ' ' || array_to_string(aw[i+1:], ' ') = array_to_string(bw[1:i-1], ' ') || ' ' || array_to_string(bw[i:], ' '))) > 0)
   OR (len(bw) = len(aw) + 1 AND len(list_filter(range(1, len(bw) + 1), lambda i: array_to_string(bw[1:i-1], ' ') || ' ' || array_to_string(bw[i+1:], ' ') = array_to_string(aw[1:i-1], ' ') || ' ' || array_to_string(aw[i:], ' '))) > 0)),
j AS (SELECT ok.doc_id, ok.ln, (ok.doc_id, ok.ln) <> f.p OR near.k IS NOT NULL AS gone
      FROM ok JOIN f ON f.k = ok.k LEFT JOIN near ON near.k = ok.k),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(CAST(ln AS VARCHAR), ',' ORDER BY ln) FILTER (WHERE gone) AS removed_lines FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id
"""
