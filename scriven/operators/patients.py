"""A meeting cut by patient and topic: proposed starts are checked against what was said, missed ones are found, and each
stretch between two starts becomes windows with context.

What is looked for in a line is a column of one scan over the turns. The two walks that depend on what came
before, over proposals and over the few turns that name a place or announce a topic, are ordered folds of those rows alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriven.functions.repairs import fix_bed_numbers, patient_ids, place_name, plain_label

from .folds import ordered_fold


# fixed values: words that announce a patient or a topic, that open a topic at a line's beginning, that a patient's label has, and
# labels of an unnamed opening
NEW_PATIENT = (
    "pat(?:ul|ului)?|salon\\w*|box\\w*|bocs\\w*|rezerv\\w*|izolator\\w*|pacient\\w*|caz(?:ul)?|următor\\w*|trecem|"
    "палат\\w*|бокс\\w*|пациент\\w*|больн\\w*|следующ\\w*|дальше|bed|room|patient|next"
)
NEW_TOPIC = (
    "punct\\w*|trecem|organizatoric\\w*|administrativ\\w*|protocol\\w*|echipament\\w*|buget\\w*|gărzi|gard\\w*|grafic\\w*|incident\\w*|"
    "audit\\w*|instruir\\w*|farmaci\\w*|agend\\w*|subiect\\w*|anunț\\w*|пункт\\w*|вопрос\\w*|оборудован\\w*|дежурств\\w*|аптек\\w*|"
    "item|agenda|schedule|equipment|pharmacy|budget|staff|roster|training|supply|supplies"
)
ANNOUNCES_TOPIC = "punct\\w*|organizatoric\\w*|administrativ\\w*|item|agenda|пункт\\w*|вопрос\\w*"
PATIENT_LABEL = "pacient\\w*|pat(?:ul)?|box\\w*|bocs\\w*|salon\\w*|rezerv\\w*|bolnav\\w*"
FIRST_PATIENT = "primul pacient"
UNNAMED = "pacientul discutat la începutul ședinței (identifică-l din fragment)"


@dataclass(frozen=True)
class Cutting:
    """near: seconds within which two starts are one; named_within: in which an opening gets its name, or a start moves back to its
    announcement; cue: whether a start needs words in the transcript; places: whether places and announcements there open starts."""

    near: float = 15
    named_within: float = 90
    cue: bool = True
    places: bool = True
    max_tokens: int = 1200
    context: int = 2


def _words(pattern: str) -> str:
    return f"(?iU)\\b(?:{pattern})\\b"


def _head(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.regexp_replace(text, "(?U)^\\s+", ""), "(?U)\\s+"), 1, n), " ")


def cued_turns(turns: DataFrame) -> DataFrame:
    """turns(job, id, start, end, line, tokens_est) with pos, and what a line's beginning says: near, places, announces."""
    c, w = F.col, Window.partitionBy("job").orderBy("id")
    said = F.when(F.instr("line", ": ") > 0, F.expr("substring(line, instr(line, ': ') + 2)")).otherwise(c("line"))
    t = turns.withColumn("line", F.coalesce("line", F.lit(""))).withColumn("pos", F.row_number().over(w) - 1).withColumn("said", said)
    t = t.withColumn("ten", _head(c("said"), 10)).withColumn("six", _head(c("said"), 6))
    t = t.withColumn("near", F.concat_ws(" ", "ten", F.lead("ten").over(w))).withColumn("places", F.filter(patient_ids(c("six")), lambda x: ~F.startswith(x, F.lit("pac:"))))
    announces = c("said").rlike(f"(?iU)^\\W*(?:\\w+\\W+){{0,3}}?(?:{ANNOUNCES_TOPIC})\\b")
    # time never runs back for a search of the first turn at or after a moment
    return t.withColumn("announces", announces).withColumn("reached", F.max("start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("ten", "said")


def placed_proposals(cued: DataFrame, proposals: DataFrame) -> DataFrame:
    """proposals(job, n, at, label, cue, not_before) beside the first turn that begins at most a second before: pos, start and what is asked of it.

    A proposal without a time or label, or before its part of the meeting (not_before), or after the last turn, is none.
    """
    c = F.col
    label = fix_bed_numbers(F.trim(F.coalesce("label", F.lit(""))))
    p = proposals.select("job", "n", c("at").cast("double").alias("at"), label.alias("label"), F.coalesce("cue", F.lit("")).alias("cue"), c("not_before").cast("double").alias("not_before"))
    p = p.where("at IS NOT NULL AND label <> '' AND (not_before IS NULL OR at >= not_before)")
    both = cued.select("job", c("reached").alias("moment"), "pos", F.struct("pos", "start", "near").alias("turn")).unionByName(p.select("job", (c("at") - 1).alias("moment"), F.struct("n", "at", "label", "cue").alias("p")), allowMissingColumns=True)
    later = Window.partitionBy("job").orderBy(F.desc("moment"), F.desc_nulls_last("pos"))
    hit = both.withColumn("turn", F.last("turn", True).over(later)).where("p IS NOT NULL AND turn IS NOT NULL").select("job", "p.*", "turn.*")
    found = lambda pattern: c("near").rlike(_words(pattern))
    return hit.select(
        "job", "n", "at", "label", "cue", "pos", "start", patient_ids(F.concat_ws(" ", "label", "cue")).alias("ids"), plain_label(c("label")).alias("plain"), c("label").rlike(_words(PATIENT_LABEL)).alias("patient"),
        F.startswith(F.lower("label"), F.lit(FIRST_PATIENT)).alias("opening"), found(NEW_PATIENT).alias("patient_cue"), found(NEW_TOPIC).alias("topic_cue"),
    )


START = "job long, pos long, start double, label string, cue string, ids array<string>, how string, from_pos long"


def chosen_starts(placed: DataFrame, rule: Cutting = Cutting()) -> DataFrame:
    """The proposals that are starts, how = 'proposed', and those without a cue in the transcript, how = 'no cue'."""

    def same(a, b) -> bool:
        if a.ids or b.ids:
            return bool(set(a.ids) & set(b.ids))
        short, long = sorted((a.plain, b.plain), key=len)
        return bool(short) and (short == long or long.startswith(short + " "))

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        held, place, n = None, None, 0  # the last start, whose label may still change, and where it stands
        row = lambda r, at, how: (*key, at[0], at[1], r.label, r.cue, r.ids, how, None)
        for r in rows:
            if held is not None:
                since = r.start - place[1]
                if since < rule.near or same(held, r):
                    continue
                if n == 1 and held.opening and r.patient and since < rule.named_within:
                    held = r
                    continue
                wanted = r.patient_cue if r.patient else r.topic_cue if held.patient else True
                if rule.cue and not wanted:
                    yield row(r, (r.pos, r.start), "no cue")
                    continue
                yield row(held, place, "proposed")
            held, place, n = r, (r.pos, r.start), n + 1
        if held is not None:
            yield row(held, place, "proposed")

    return ordered_fold(placed, ["job"], ["at", "n"], fold, START)


def completed_starts(cued: DataFrame, starts: DataFrame, rule: Cutting = Cutting()) -> DataFrame:
    """starts with those that the transcript has besides: how = 'place' where a line begins with another place, 'moved' where a start goes back to the
    line that announces it, 'opening' for what comes before the first. Jobs with a single start have none."""
    c = F.col
    none = lambda kind: F.lit(None).cast(kind)
    turn = lambda kind, label, cue: ["job", F.lit(kind).alias("kind"), c("pos").cast("long").alias("pos"), c("start").cast("double").alias("start"), label.alias("label"), cue.alias("cue"), c("places").alias("ids"), none("string").alias("how")]
    events = starts.where("how = 'proposed'").select("job", F.lit(1).alias("kind"), "pos", "start", "label", "cue", "ids", "how")
    first = cued.where("pos = 0").select(*turn(0, none("string"), none("string")))
    events = events.unionByName(first)
    if rule.places:
        events = events.unionByName(cued.where(F.size("places") > 0).select(*turn(2, place_name(F.get("places", F.lit(0))), c("six")))).unionByName(cued.where("announces").select(*turn(3, none("string"), none("string"))))

    def with_places(rows: Iterator) -> Iterator[tuple]:
        last = None
        for r in rows:
            if r.kind == 1:
                last = r.start, set(r.ids)
                yield 1, r.pos, r.start, r.label, r.cue, r.ids, r.how, None
            elif r.kind != 2:
                yield r.kind, r.pos, r.start, None, None, None, None, None
            elif last and r.start - last[0] >= rule.near and not last[1] & set(r.ids):
                last = r.start, set(r.ids)
                yield 1, r.pos, r.start, r.label, r.cue, r.ids, "place", None

    def with_announced(rows: Iterator) -> Iterator[tuple]:
        last, open_ = None, []  # the last start's time; announcements behind it that the next start may move to
        for r in rows:
            kind, pos, at = r[:3]
            if kind == 3:
                if last is not None and at - last >= rule.near:
                    open_.append((pos, at))
                continue
            if kind == 1:
                back = next((i for i, (_, t) in enumerate(open_) if at - t < rule.named_within), None)
                if back is not None:
                    (to, at), open_ = open_[back], open_[back + 1 :]
                    r = (1, to, at, *r[3:6], "moved", pos)
                    open_ = [x for x in open_ if x[1] - at >= rule.near]
                else:
                    open_ = []
                last = at
            yield r

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        began, only, many = None, None, False
        for r in with_announced(with_places(rows)):
            if r[0] == 0:
                began = r[2]
                continue
            out = [r]
            if only is None and not many and r[1] > 0:
                out = [(1, 0, began, *r[3:])] if r[2] - began < rule.near else [(1, 0, began, UNNAMED, "", [], "opening", None), r]
            for x in out:
                if many:
                    yield (*key, *x[1:])
                elif only is None:
                    only = x
                else:
                    many = True
                    yield (*key, *only[1:])
                    yield (*key, *x[1:])

    return ordered_fold(events, ["job"], ["pos", "kind"], fold, START)


def patient_windows(turns: DataFrame, proposals: DataFrame, rule: Cutting = Cutting()) -> DataFrame:
    """turns(job, id, start, end, line, tokens_est) and proposals(job, n, at, label, cue, not_before) to windows (job, index, label, cue, first, last,
    overlap_turns, start, end, tokens_est, text): each stretch between starts, cut by max_tokens, behind up to `context` turns.

    A job of fewer than two starts, or of one turn, has no window: its token windows stand for it.
    """
    c, w = F.col, Window.partitionBy("job").orderBy("pos")
    cued = cued_turns(turns)
    starts = completed_starts(cued, chosen_starts(placed_proposals(cued, proposals), rule), rule)
    t = cued.join(starts.select("job", "pos", "label", "cue", F.lit(1).alias("opens")), ["job", "pos"], "left")
    t = t.withColumn("fragment", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("fragment IS NOT NULL")

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        held, label, cue, chunk, tokens = None, None, None, 0, 0
        for r in rows:
            if r.opens:
                label, cue = r.label, r.cue
            if held is not None and tokens + r.tokens_est > rule.max_tokens:
                yield (*key, chunk, *held, label, cue)
                held, tokens, chunk = None, 0, chunk + 1
            held = (r.pos, r.start, r.pos, r.end) if held is None else (*held[:2], r.pos, r.end)
            tokens += r.tokens_est
        yield (*key, chunk, *held, label, cue)

    rows = t.select("job", "fragment", "pos", c("start").cast("double").alias("start"), c("end").cast("double").alias("end"), "tokens_est", "opens", "label", "cue")
    chunks = ordered_fold(rows, ["job", "fragment"], ["pos"], fold, "job long, fragment long, chunk long, first long, start double, last long, end double, label string, cue string")
    chunks = chunks.withColumn("index", F.row_number().over(Window.partitionBy("job").orderBy("first")) - 1)
    held = chunks.withColumn("pos", F.explode(F.sequence(F.greatest(c("first") - rule.context, F.lit(0)), "last")))
    lines = held.join(cued.select("job", c("pos").cast("long").alias("pos"), "id", "line", "tokens_est"), ["job", "pos"])
    own = c("pos") >= c("first")
    out = lines.groupBy("job", "index").agg(
        F.any_value("label").alias("label"), F.any_value("cue").alias("cue"), F.min(F.when(own, c("id"))).alias("first"), F.max("id").alias("last"), F.count_if(~own).alias("overlap_turns"),
        F.any_value("start").alias("start"), F.any_value("end").alias("end"), F.sum("tokens_est").alias("tokens_est"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("text"),
    )
    return out


# fixed values: how a new patient or topic is announced, and places that name one
SAYS_PATIENT = re.compile(r"\b(pacient\w*|patul|următor\w*|пациент\w*|следующ\w*|next patient)\b", re.I)
SAYS_TOPIC = re.compile(r"\b(acum|trecem|subiect\w*|punctul|теперь|переходим|тема|next|topic)\b", re.I)
SAYS_PLACE = re.compile(r"\b(?:pat(?:ul)?|box[aăe]?|salon(?:ul)?)\s+(?:nr\.?\s*)?\d+", re.I)


def cue_fragments(lines: DataFrame, apart: float, max_tokens: int, context: int) -> DataFrame:
    """lines(job, id, at, text, tokens_est) to fragments (job, fragment, chunk, first, last, label, context_from).

    A line starts a fragment if its first ten words, or the next line's, announce a patient, or its first four a topic,
    or it names a place that the fragment before does not; and if the last start is `apart` seconds back. Long
    fragments are cut by the token budget; context_from is up to `context` lines earlier.
    """

    def opens(text: str, after: str, label: str | None) -> tuple[bool, str | None]:
        head, following = text.split(), after.split()
        place = SAYS_PLACE.search(text)
        name = " ".join(place[0].lower().split()) if place else None
        cue = SAYS_PATIENT.search(" ".join(head[:10])) or SAYS_PATIENT.search(" ".join(following[:10])) or SAYS_TOPIC.search(" ".join(head[:4]))
        return bool((name and name != label) or (cue and (name is None or name != label))), name

    def fold(key: tuple, rows: Iterator) -> Iterator[tuple]:
        fragment, chunk, first, last, tokens, label, began = -1, 0, None, None, 0, None, None
        current = next(rows, None)
        while current is not None:
            after = next(rows, None)
            start, name = opens(current.text or "", (after.text or "") if after is not None else "", label)
            far = began is None or current.at - began >= apart
            if first is None or (start and far):
                if first is not None:
                    yield (*key, fragment, chunk, first, last, label, max(first - context, 0))
                fragment, chunk, tokens, label, began = fragment + 1, 0, 0, name, current.at
                first = current.id
            elif tokens and tokens + current.tokens_est > max_tokens:
                yield (*key, fragment, chunk, first, last, label, max(first - context, 0))
                chunk, tokens, first = chunk + 1, 0, current.id
            tokens, last, current = tokens + current.tokens_est, current.id, after
        if first is not None:
            yield (*key, fragment, chunk, first, last, label, max(first - context, 0))

    return ordered_fold(lines.select("job", "id", "at", "text", "tokens_est"), ["job"], ["id"], fold, "job long, fragment long, chunk long, first long, last long, label string, context_from long")
