"""Conversation structure repair: the cheapest edits that give a conversation the order `(s?(ua)+)?` of role initials.

Windows over a conversation mark each row's first fault (blank, duplicate, truncated). The rows are then collected as
sorted structs, and one `aggregate()` carries four (cost, audit) structs, one for each state that the roles so far can be in:
nothing yet, a leading s, an open u, a closed pair. Each step takes the least struct by cost, then audit, so the result is the
cheapest string of edits and among equally cheap ones the least in ASCII. Everything is DataFrame expressions: no Python on executors.

The audit kept inside the fold has a letter of its own for an inserted or rerolled assistant (J, S beside I, R): the state already tells
the two apart, so the order of audits is the same, and the edits can be read back without the states.

A conversation is one value, as the fold needs it: it must fit into a row (2 GB), and the four audits are copied at each of its
turns, so a conversation of n turns moves about 2 n^2 bytes.

Defined cases: null role or text is one space, also a null conv_id or turn inside the key of the damage; null turns come first, rows of one
turn stand in order of role, then text; a null conv_id is a conversation; rows that are repeated are damaged alike and are
duplicates; roles count by their first character, an empty role has no initial; turns so far apart that the gap passes 2^63 give
null gaps; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: What an edit costs; a truncated row that stays adds `TRUNCATED`.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 40
VISIBLE = "[^\\x20\\x09-\\x0D]"
LAST_VISIBLE = "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z"


def damaged(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with every row's damage done; a dropped row stays with `live` false, so that its conversation does."""
    c, text_of = F.col, lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = turns.select(c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"))
    kind = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    rows = rows.withColumn("kind", kind)
    text = F.when(c("kind") == 1, "").when(c("kind") == 2, F.translate("text", ".!?", "")).otherwise(c("text"))
    role = F.when(c("kind") == 4, "user").otherwise(c("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (c("kind") != 0).alias("live"), F.explode(F.sequence(F.lit(1), F.when(c("kind") == 3, 2).otherwise(1)))).drop("col")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows of `damaged` in order: pos, initial, fault (blank, duplicate, truncated or null), illegal (pair with the row before), new_turn."""
    c = F.col
    order = [c("turn").asc_nulls_first(), "role", "text"]
    whole, same = Window.partitionBy("conv_id", "live").orderBy(*order), Window.partitionBy("conv_id", "live", "role", "text").orderBy(c("turn").asc_nulls_first())
    rows = rows.withColumn("initial", F.substring("role", 1, 1)).withColumn("nth", F.row_number().over(same))
    blank = ~F.regexp_like("text", F.lit(VISIBLE))
    cut = ~F.regexp_extract("text", LAST_VISIBLE, 1).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(c("nth") > 1, "duplicate").when(cut, "truncated")
    before = F.lag("initial").over(whole)
    rows = rows.withColumn("pos", F.row_number().over(whole)).withColumn("fault", fault)
    return rows.withColumn("illegal", before.isNotNull() & ~F.concat(before, c("initial")).isin("su", "ua", "au")).withColumn("new_turn", c("turn").isNotNull() & ~F.coalesce(c("turn") == F.lag("turn").over(whole), F.lit(False)))


def _plus(state: Column, cost, letters: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letters)).alias("audit"))


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _inserted(s: Column) -> Column:
    """The four states where turns may be inserted next; more than two in a row only return to where they began."""
    user = F.least(s.user, *[_plus(s[x], INSERT, "I") for x in ("empty", "system", "pair")])
    pair = F.least(s.pair, _plus(s.user, INSERT, "J"), *[_plus(s[x], 2 * INSERT, "IJ") for x in ("empty", "system")])
    return F.struct(s.empty.alias("empty"), s.system.alias("system"), user.alias("user"), pair.alias("pair"))


def _moved(s: Column, t: Column) -> Column:
    """The four states after one row: deleted, kept where its initial may stand, or given the role that may stand there."""
    never = F.lit(NEVER)
    stays = F.when(t.must_go, never).otherwise(F.when(t.cut, F.lit(TRUNCATED)).otherwise(F.lit(0)).cast("long"))
    kept = lambda initial: F.when(t.initial == initial, stays).otherwise(never)
    opens = F.least(s.empty, s.system, s.pair)
    return F.struct(
        _plus(s.empty, DELETE, "D").alias("empty"),
        F.least(_plus(s.system, DELETE, "D"), _plus(s.empty, kept("s"), "K")).alias("system"),
        F.least(_plus(s.user, DELETE, "D"), _plus(opens, kept("u"), "K"), _plus(opens, stays + REROLE, "R")).alias("user"),
        F.least(_plus(s.pair, DELETE, "D"), _plus(s.user, kept("a"), "K"), _plus(s.user, stays + REROLE, "S")).alias("pair"),
    )


def repaired(rows: DataFrame) -> DataFrame:
    """Rows of `with_faults` to one row a conversation: counts of faults, cost, audit, and turns: array of (role, text) as repaired."""
    c, count = F.col, lambda x: F.count_if(c("live") & x).cast("long")
    turn = F.when(c("live"), F.struct("pos", "initial", F.coalesce(c("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"), F.coalesce(c("fault") == "truncated", F.lit(False)).alias("cut"), "role", "text"))
    at = F.when(c("live"), c("turn"))
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("_turns"),
        F.try_subtract(F.try_add(F.try_subtract(F.max(at), F.min(at)), F.lit(1)), count(c("new_turn"))).alias("_gaps"),
        F.count(at).alias("_dated"),
        *[count(c("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(c("illegal")).alias("illegal"),
    )
    state = lambda cost: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("audit"))
    start = F.struct(state(0).alias("empty"), state(NEVER).alias("system"), state(NEVER).alias("user"), state(NEVER).alias("pair"))
    end = F.aggregate("_turns", start, lambda s, t: _let(_inserted(s), lambda i: _moved(i, t)), lambda s: _let(_inserted(s), lambda i: F.least(i.empty, i.pair)))
    whole = whole.withColumn("_end", end)
    # the letters before and of each row, and what is inserted after the last
    of_rows = F.regexp_extract_all(c("_end.audit"), F.lit("[IJ]*[KRSD]"), F.lit(0))
    made = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda x: x.isin("I", "J")), lambda x: F.struct(F.when(x == "I", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    edit = lambda op: F.right(op, F.lit(1))
    own = lambda t, op: F.when(edit(op) == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(F.when(edit(op) == "R", "user").when(edit(op) == "S", "assistant").otherwise(t.role).alias("role"), t.text.alias("text"))))
    turns = F.concat(F.flatten(F.zip_with("_turns", of_rows, lambda t, op: F.concat(made(op), own(t, op)))), made(F.regexp_extract(c("_end.audit"), "[IJ]*\\z", 0)))
    return whole.select("conv_id", F.when(c("_dated") > 0, c("_gaps")).otherwise(F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", c("_end.cost").alias("cost"), F.translate("_end.audit", "JS", "IR").alias("audit"), turns.alias("turns"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repaired(with_faults(damaged(table(spark, sf_dir, "conversations"))))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    return out.select(*[x for x in out.columns if x != "turns"], F.sha2(text, 256).alias("repaired_sha256"))


#: The same rows by a recursive walk over numbered rows. DuckDB has no crc32: its table is made by eight shifts of each byte.
OP12_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) ORDER BY b) AS t
  FROM range(256) r(b)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_transform(range(length(key)), lambda i: unicode(key[i + 1])::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM keyed, crc_table
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM rows_
), faults AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM numbered
), paired AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM faults
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM paired GROUP BY conv_id
), walk AS (
  -- state: e nothing, s a leading s, u an open u, p a closed pair
  SELECT conv_id, 0::BIGINT AS pos, {'c': 0, 'a': ''} AS e, {'c': 1000000, 'a': ''} AS s, {'c': 3, 'a': 'I'} AS u, {'c': 6, 'a': 'II'} AS p, ''::VARCHAR AS out_e, ''::VARCHAR AS out_s, 'user:'::VARCHAR AS out_u, 'user:' || chr(10) || 'assistant:' AS out_p
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, e.v, s.v, u.v, p.v, e.o, s.o, u.o, p.o FROM (
    SELECT conv_id, pos, e, s, u0 AS u_, p0 AS p_,
      least({'v': u0.v, 'o': u0.o}, {'v': {'c': e.v.c + 3, 'a': e.v.a || 'I'}, 'o': e.o || nl_e || 'user:'}, {'v': {'c': s.v.c + 3, 'a': s.v.a || 'I'}, 'o': s.o || nl_s || 'user:'}, {'v': {'c': p0.v.c + 3, 'a': p0.v.a || 'I'}, 'o': p0.o || nl_p || 'user:'}) AS u,
      least({'v': p0.v, 'o': p0.o}, {'v': {'c': u0.v.c + 3, 'a': u0.v.a || 'I'}, 'o': u0.o || chr(10) || 'assistant:'}, {'v': {'c': e.v.c + 6, 'a': e.v.a || 'II'}, 'o': e.o || nl_e || 'user:' || chr(10) || 'assistant:'}, {'v': {'c': s.v.c + 6, 'a': s.v.a || 'II'}, 'o': s.o || nl_s || 'user:' || chr(10) || 'assistant:'}) AS p
    FROM (SELECT *, CASE WHEN e.o = '' THEN '' ELSE chr(10) END AS nl_e, CASE WHEN s.o = '' THEN '' ELSE chr(10) END AS nl_s, CASE WHEN p0.o = '' THEN '' ELSE chr(10) END AS nl_p FROM (
      SELECT w.conv_id, f.pos,
        {'v': {'c': w.e.c + 4, 'a': w.e.a || 'D'}, 'o': w.out_e} AS e,
        least({'v': {'c': w.s.c + 4, 'a': w.s.a || 'D'}, 'o': w.out_s}, {'v': {'c': w.e.c + stay + CASE WHEN initial = 's' THEN 0 ELSE 1000000 END, 'a': w.e.a || 'K'}, 'o': f.role || ':' || f.text}) AS s,
        least({'v': {'c': w.u.c + 4, 'a': w.u.a || 'D'}, 'o': w.out_u},
              {'v': {'c': w.e.c + stay + CASE WHEN initial = 'u' THEN 0 ELSE 1000000 END, 'a': w.e.a || 'K'}, 'o': f.role || ':' || f.text}, {'v': {'c': w.e.c + stay + 3, 'a': w.e.a || 'R'}, 'o': 'user:' || f.text},
              {'v': {'c': w.s.c + stay + CASE WHEN initial = 'u' THEN 0 ELSE 1000000 END, 'a': w.s.a || 'K'}, 'o': w.out_s || chr(10) || f.role || ':' || f.text}, {'v': {'c': w.s.c + stay + 3, 'a': w.s.a || 'R'}, 'o': w.out_s || chr(10) || 'user:' || f.text},
              {'v': {'c': w.p.c + stay + CASE WHEN initial = 'u' THEN 0 ELSE 1000000 END, 'a': w.p.a || 'K'}, 'o': w.out_p || chr(10) || f.role || ':' || f.text}, {'v': {'c': w.p.c + stay + 3, 'a': w.p.a || 'R'}, 'o': w.out_p || chr(10) || 'user:' || f.text}) AS u0,
        least({'v': {'c': w.p.c + 4, 'a': w.p.a || 'D'}, 'o': w.out_p},
              {'v': {'c': w.u.c + stay + CASE WHEN initial = 'a' THEN 0 ELSE 1000000 END, 'a': w.u.a || 'K'}, 'o': w.out_u || chr(10) || f.role || ':' || f.text}, {'v': {'c': w.u.c + stay + 3, 'a': w.u.a || 'R'}, 'o': w.out_u || chr(10) || 'assistant:' || f.text}) AS p0
      FROM walk w JOIN (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END AS stay FROM faults) f
        ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1)))
), ends AS (
  SELECT conv_id, pos, least({'v': e, 'o': out_e}, {'v': p, 'o': out_p}) AS best FROM walk
)
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.v.c::BIGINT AS cost, best.v.a AS audit, sha256(best.o) AS repaired_sha256
FROM ends LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ends.conv_id
WHERE ends.pos = coalesce(n, 0)
"""
