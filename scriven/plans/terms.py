"""Queries of glossary terms over texts: where terms stand, and words that nearly are one. The glossary is made of the tables' own frequent words."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriven.functions.text import norm_text, raw_tokens
from scriven.operators import glossary as G
from scriven.operators.tables import kept

from .base import query, table, turns

_WORD = "[\\p{L}\\p{M}\\p{N}]+"
_NORM = "translate(lower(nfc_normalize(coalesce(text, ''))), 'şţё', 'șțе')"
_RAW = "translate(nfc_normalize(coalesce(text, '')), 'şŞţŢ', 'șȘțȚ')"


def _glossary(docs):
    """Frequent words and pairs of words as terms, each under one of three languages by its length; capitalised words as abbreviations. Also all words of the texts."""
    c = F.col
    t = docs.select(norm_text(F.coalesce("text", F.lit(""))).alias("n"), raw_tokens(F.coalesce("text", F.lit(""))).alias("r"))
    lang = lambda x: F.get(F.array(*map(F.lit, G.LANGUAGES)), F.length(x) % 3)
    short = lambda x, k: F.expr(f"substring({x}, 1, length({x}) - {k})")
    # words are counted in one pass, in lower case and as they stand
    each = kept(t.select(F.explode(F.arrays_zip(c("n").alias("w"), c("r").alias("raw"))).alias("x")).groupBy("x.w", "x.raw").count())
    one = each.where("w IS NOT NULL").groupBy("w").agg(F.sum("count").alias("count")).where("count >= 12 AND length(w) >= 7").select("w", F.array(short("w", 2)).alias("stems"), F.lit(False).alias("abbr"))
    pairs = F.arrays_zip(c("n").alias("a"), F.slice("n", F.lit(2), F.greatest(F.size("n"), F.lit(1))).alias("b"))
    two = t.select(F.explode(pairs).alias("p")).select("p.*").where("length(a) >= 4 AND length(b) >= 3")
    two = two.groupBy("a", "b").count().where("count >= 15").select(F.concat_ws(" ", "a", "b").alias("w"), F.array(short("a", 1), c("b")).alias("stems"), F.lit(False).alias("abbr"))
    big = each.where("raw RLIKE '^[A-Z][a-z]{4,}$'").groupBy(c("raw").alias("w")).agg(F.sum("count").alias("count")).where("count >= 20").select("w", F.array("w").alias("stems"), F.lit(True).alias("abbr"))
    return one.unionByName(two).unionByName(big).select(c("w").alias("concept"), lang(c("w")).alias("lang"), c("w").alias("text"), "abbr", "stems"), each.where("w IS NOT NULL").select(c("w").alias("word")).distinct()


_GLOSSARY_SQL = f"""texts AS (SELECT doc_id, regexp_extract_all({_NORM}, '{_WORD}') AS n, regexp_extract_all({_RAW}, '{_WORD}') AS r FROM documents
), tokens AS (SELECT doc_id, unnest(range(len(n))) AS i, unnest(n) AS w, unnest(r) AS raw FROM texts
), pairs AS (SELECT w AS a, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM tokens
), glossary AS (
  SELECT w, [left(w, length(w) - 2)] AS stems, false AS abbr FROM tokens GROUP BY w HAVING count(*) >= 12 AND length(w) >= 7
  UNION ALL SELECT a || ' ' || b, [left(a, length(a) - 1), b], false FROM pairs WHERE b IS NOT NULL GROUP BY a, b HAVING count(*) >= 15 AND length(a) >= 4 AND length(b) >= 3
  UNION ALL SELECT raw, [raw], true FROM tokens WHERE regexp_full_match(raw, '[A-Z][a-z]{{4,}}') GROUP BY raw HAVING count(*) >= 20
), terms AS (SELECT w AS concept, (['ro', 'ru', 'en'])[length(w) % 3 + 1] AS lang, stems, abbr FROM glossary)"""


@query(f"""WITH RECURSIVE {_GLOSSARY_SQL}, own AS (SELECT * FROM terms WHERE lang IN ('ro', 'en')
), first_fits AS (
  SELECT t.doc_id, t.i, g.* FROM own g JOIN (SELECT *, unnest(range(greatest(length(w) - 5, 1), length(w) + 1)) AS k FROM tokens) t ON NOT g.abbr AND g.stems[1] = left(t.w, t.k)
  UNION ALL SELECT t.doc_id, t.i, g.* FROM own g JOIN tokens t ON g.abbr AND g.stems[1] = t.raw
), fits AS (
  SELECT f.* FROM first_fits f LEFT JOIN tokens t ON t.doc_id = f.doc_id AND t.i = f.i + 1 AND len(f.stems) = 2
  WHERE len(f.stems) = 1 OR (starts_with(t.w, f.stems[2]) AND length(t.w) - length(f.stems[2]) <= 5)
), best AS (
  SELECT doc_id, i, concept, lang, len(stems) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY len(stems) DESC, concept, lang, abbr) AS k FROM fits) WHERE k = 1
), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM best
), walk(doc_id, k, free, keep) AS (
  SELECT doc_id, k, i + n, true FROM numbered WHERE k = 1
  UNION ALL SELECT b.doc_id, b.k, CASE WHEN b.i >= w.free THEN b.i + b.n ELSE w.free END, b.i >= w.free FROM walk w JOIN numbered b ON b.doc_id = w.doc_id AND b.k = w.k + 1
)
SELECT doc_id, concept, lang, concept AS term, i AS first, i + n AS last FROM numbered JOIN walk USING (doc_id, k) WHERE keep""")
def terms_found(spark, d):
    docs = table(spark, d, "documents")
    terms, vocabulary = _glossary(docs)
    return G.find_terms(docs.select("doc_id", "text"), ["doc_id"], "text", terms, ["ro", "en"], vocabulary)


def _said_words(spark, d):
    """Words as said, with their signs, of each turn; every third turn is Russian, which has none of these stems."""
    t = turns(spark, d)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\n]+"), lambda w: w != "")
    return t.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "en").otherwise("ro").alias("lang"), words.alias("words"))


def _frequent(words):
    """Words of eight letters and more that stand four times: as stems, half of them without their last letters."""
    c = F.col
    w = words.select(F.explode("words").alias("w")).select(F.explode(norm_text(c("w"))).alias("w")).groupBy("w").count().where("count >= 4 AND length(w) >= 8")
    stem = F.when(F.length("w") % 2 == 0, c("w")).otherwise(F.expr("substring(w, 1, length(w) - 2)"))
    return w.select(c("w").alias("concept"), F.explode(F.array(F.lit("ro"), F.lit("en"))).alias("lang"), c("w").alias("text"), F.lit(False).alias("abbr"), F.array(stem).alias("stems"))


_ENDINGS_SQL = " UNION ALL ".join(f"SELECT '{lang}' AS lang, unnest({sorted(set(G.ENDINGS[lang].split()) | set(G.MORE_ENDINGS[lang].split()))!r}) AS e" for lang in ("ro", "en"))
_LCS = "list_reduce(string_split(b, ''), lambda r, y: list_reduce(range(1, length(a) + 1), lambda acc, i: acc || [CASE WHEN a[i] = y THEN r[i] + 1 ELSE greatest(r[i + 1], acc[-1]) END], [0::BIGINT]), list_transform(range(length(a) + 1), lambda z: 0::BIGINT))[-1]"
_BARE = "strip_accents({})"


@query(f"""WITH said AS (
  SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'en' ELSE 'ro' END AS lang, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n]+'), lambda w: w <> '') AS words FROM conversations
), each AS (SELECT conv_id, turn, lang, unnest(range(len(words))) AS place, unnest(words) AS said FROM said
), normed AS (SELECT *, regexp_extract_all({_NORM.replace("text", "said")}, '{_WORD}') AS n FROM each
), frequent AS (SELECT w FROM (SELECT unnest(n) AS w FROM normed) GROUP BY w HAVING count(*) >= 4 AND length(w) >= 8
), stems AS (
  SELECT lang, st, bool_or(bare) AS bare FROM (SELECT unnest(['ro', 'en']) AS lang, CASE WHEN length(w) % 2 = 0 THEN w ELSE left(w, length(w) - 2) END AS st, length(w) % 2 = 0 AS bare FROM frequent) GROUP BY ALL
), vocabulary AS (SELECT DISTINCT lang, n[1] AS w FROM normed WHERE len(n) = 1 AND length(n[1]) >= 6 AND regexp_matches(regexp_extract(n[1], '\\p{{L}}'), '\\p{{Latin}}')
), unknown AS (SELECT * FROM vocabulary v WHERE NOT EXISTS (SELECT 1 FROM stems s WHERE s.lang = v.lang AND starts_with(v.w, s.st) AND length(v.w) - length(s.st) <= 5)
), endings AS ({_ENDINGS_SQL}
), cuts AS (
  SELECT u.lang, u.w, length(u.w) - length(e.e) AS cut, e.e AS ending FROM unknown u JOIN endings e ON e.lang = u.lang AND ends_with(u.w, e.e) AND length(u.w) > length(e.e)
  UNION ALL SELECT lang, w, length(w), '' FROM unknown
), near AS (
  SELECT c.*, s.st, left(c.w, c.cut) AS a, s.st AS b FROM cuts c JOIN stems s ON s.lang = c.lang AND abs(length(c.w) - length(s.st)) <= 9 AND c.cut BETWEEN greatest(length(s.st) - 4, 1) AND length(s.st) + 4
    AND (c.ending <> '' OR s.bare) AND (levenshtein(left(c.w, c.cut), s.st) <= 0.12 * (c.cut + length(s.st)) OR {_BARE.format("left(c.w, c.cut)")} = {_BARE.format("s.st")})
), scored AS (SELECT lang, w, st, cut, ending, CASE WHEN {_BARE.format("a")} = {_BARE.format("b")} THEN 99.0::DOUBLE ELSE 200.0::DOUBLE * {_LCS} / (length(a) + length(b)) END AS score FROM near
), best AS (
  SELECT lang, w, st, max({{'score': score, 'cut': cut, 'ending': ending}}) AS b FROM scored GROUP BY ALL HAVING max(score) >= 88
), ranked AS (SELECT *, row_number() OVER k AS place, lead(b.score) OVER k AS next FROM best WINDOW k AS (PARTITION BY lang, w ORDER BY b.score DESC, st DESC, b.ending DESC)
), fixes AS (SELECT lang, w, st || b.ending AS new, round(b.score, 1) AS score FROM ranked WHERE place = 1 AND (next IS NULL OR b.score - next >= 3)
), hits AS (
  SELECT n.conv_id, n.turn, n.place, substr(n.said, instr(lower(n.said), left(f.w, 1)), length(f.w)) AS own, f.new, f.score FROM normed n JOIN fixes f ON len(n.n) = 1 AND f.lang = n.lang AND f.w = n.n[1]
)
SELECT conv_id, turn, place::INT AS place, own AS said, CASE WHEN upper(left(own, 1)) = left(own, 1) THEN upper(left(new, 1)) || substr(new, 2) ELSE new END AS corrected, score
FROM hits JOIN (SELECT DISTINCT w FROM fixes) f ON lower(own) = f.w""")
def corrected_words(spark, d):
    words = _said_words(spark, d)
    out = G.corrected(words, ["conv_id", "turn"], _frequent(words))
    return out.select("conv_id", "turn", F.inline("corrections")).toDF("conv_id", "turn", "place", "said", "corrected", "score")
