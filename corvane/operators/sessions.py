"""Conversation state: recent turns, rolling summaries, agenda coverage and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..plans.folds import fold


def clean_turns(turns: DataFrame) -> DataFrame:
    """Turns as they are stored: bounded text, known sources and roles, confidence within 0 to 1; empty ones go."""
    out = turns.withColumn("text", T.bounded(F.col("text"), 2000)).where("text <> ''")
    out = out.withColumn("source", T.one_of(F.col("source"), T.TURN_SOURCES)).withColumn("speaker_role", T.one_of(F.col("speaker_role"), T.SPEAKER_ROLES))
    return out.withColumn("speaker_confidence", T.strength(F.col("speaker_confidence")))


def recent(turns: DataFrame, session: str, order: str, text: str = "text", turns_kept: int = 12, budget: int = 3000) -> DataFrame:
    """The newest turns of a session, back until the characters taken reach the budget; the one that reaches it stays."""
    back = W.partitionBy(session).orderBy(F.desc(order))
    rows = turns.withColumn("_n", F.row_number().over(back)).withColumn("_before", F.coalesce(F.sum(F.length(text)).over(back.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.where((F.col("_n") <= turns_kept) & (F.col("_before") < budget)).drop("_n", "_before")


def summary(turns: DataFrame, session: str, order: str, text: str = "text", turns_kept: int = 12, points: int = 12, held: int = 30, important: str = T.IMPORTANT) -> DataFrame:
    """(session, order, priority, point): what older turns leave, the most important and newest, in the session's order.

    Letting go of the least (priority, order) whenever there are more than held points leaves the held greatest seen.
    """
    newest = W.partitionBy(session).orderBy(F.desc(order))
    old = turns.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") > turns_kept).withColumn("priority", T.importance(F.col(text), important))
    best = W.partitionBy(session).orderBy(F.desc("priority"), F.desc(order))
    few = old.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= min(points, held))
    return few.select(session, order, "priority", T.bounded(F.col(text), 180).alias("point"))


def point_coverage(turns: DataFrame, points: DataFrame, session: str, order: str, least_overlap: int = 3, least_score: float = 0.5, samples: int = 3) -> DataFrame:
    """(session, order, section, point, score, overlap, covered) after every turn of the speaker.

    turns: session, order, text; points: section, point, text. Of the last samples turns the one with the best (score,
    overlap) is taken first and only then held against the thresholds, so a very short turn can hide a longer one while
    both are recent. What is covered stays covered. Points are a session's agenda: their size is checked by the caller.
    """
    p = points.select("section", "point", T.match_terms(F.col("text")).alias("wanted"))
    t = turns.select(session, order, T.match_terms(F.col("text")).alias("said"))
    score, overlap = T.coverage(F.col("wanted"), F.col("said"))
    rows = t.crossJoin(p).select(session, order, "section", "point", F.struct(score.alias("score"), overlap.alias("overlap")).alias("_m"))
    here = W.partitionBy(session, "section", "point").orderBy(order)
    best = rows.withColumn("_m", F.max("_m").over(here.rowsBetween(-(samples - 1), 0)))
    hit = ((F.col("_m.overlap") >= least_overlap) & (F.col("_m.score") >= least_score)).cast("int")
    covered = F.max(hit).over(here.rowsBetween(W.unboundedPreceding, 0)) == 1
    return best.select(session, order, "section", "point", F.col("_m.score").alias("score"), F.col("_m.overlap").alias("overlap"), covered.alias("covered"))


def section_strength(turns: DataFrame, sections: DataFrame, covered: DataFrame, session: str, order: str) -> DataFrame:
    """(session, order, section, strength, hit, overlap, full): how well a turn fits each section; sections: section, title."""
    s = sections.select("section", T.section_title(F.col("title")).alias("key"), T.match_terms(F.col("title")).alias("wanted"))
    t = turns.select(session, order, T.section_title(F.col("text")).alias("spoken"), T.match_terms(F.col("text")).alias("said"))
    score, overlap = T.coverage(F.col("wanted"), F.col("said"))
    rows = t.crossJoin(s).withColumn("ts", score).withColumn("to", overlap)
    inside = (F.instr("spoken", F.col("key")) > 0) | ((F.length("spoken") >= 4) & (F.instr("key", F.col("spoken")) > 0))
    rows = rows.withColumn("hit", (F.length("key") >= 2) & (inside | ((F.col("to") >= 2) & (F.col("ts") >= 0.35))))
    per = covered.groupBy(session, order, "section").agg(F.max(F.struct("score", "overlap")).alias("_b"), F.bool_and("covered").alias("full"))
    out = rows.join(per, [session, order, "section"], "left")
    best, more = F.coalesce("_b.score", F.lit(0.0)), F.coalesce("_b.overlap", F.lit(0))
    return out.select(session, order, "section", (F.when(F.col("hit"), 1.5).otherwise(F.col("ts") * 0.6) + best).alias("strength"), "hit", F.greatest(more, "to").alias("overlap"), F.coalesce("full", F.lit(False)).alias("full"))


def progress(strengths: DataFrame, session: str, order: str) -> DataFrame:
    """(session, current, started, completed) after a session's turns: the cursor only moves forward.

    A turn's best section at or behind the cursor (strongest, then first) becomes the current one if its title was said
    or the content matches strongly; skipped sections count as complete. The cursor depends on its own past, so a
    session's turns are streamed in order, with one turn's sections and the cursor in memory; sessions are independent.
    """
    per_turn = strengths.groupBy(session, order).agg(F.array_sort(F.collect_list(F.struct("section", "strength", "hit", "overlap", "full"))).alias("_s"))
    kinds = dict(strengths.dtypes)

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        current, started, completed = state
        ahead = [x for x in row[2] if x["section"] >= current]
        best = max(ahead, key=lambda x: (x["strength"], -x["section"], x["hit"], x["overlap"])) if ahead else None
        now = current
        if best is not None and best["section"] > current and (best["hit"] or best["strength"] >= 0.72 and best["overlap"] >= 5):
            now = int(best["section"])
            completed = completed | set(range(current, now))
        if best is not None and best["section"] == now and (best["hit"] or best["strength"] >= 0.5):
            started = started | {now}
        if any(x["section"] == now and x["full"] for x in row[2]):
            completed = completed | {now}
        return (now, started, completed), (row[0], row[1], now, sorted(started), sorted(completed))

    turns = fold(per_turn.select(session, order, "_s"), session, order, lambda: (0, frozenset(), frozenset()), step, f"{session} {kinds[session]}, {order} {kinds[order]}, current bigint, started array<bigint>, completed array<bigint>")
    last = turns.groupBy(session).agg(F.max_by(F.struct("current", "started", "completed"), order).alias("_p"))
    return last.select(session, "_p.current", "_p.started", "_p.completed")


def projection(state: DataFrame, covered: DataFrame, sections: DataFrame, points: DataFrame, session: str) -> DataFrame:
    """A session's progress to show: section, title, status, covered and remaining points, next title, whether closing is allowed.

    covered: (session, section, point) that are covered at the end; state: progress().
    """
    n = sections.agg(F.max("section").alias("last"))
    here = state.crossJoin(F.broadcast(n)).withColumn("section", F.least("current", "last"))
    pts = points.select("section", "point", T.bounded(F.col("text"), 240).alias("text")).join(here.select(session, "section"), "section")
    marked = pts.join(covered.select(session, "section", "point", F.lit(True).alias("yes")), [session, "section", "point"], "left")
    lists = marked.groupBy(session).agg(*[F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("point", "text")))), lambda x: x["text"]).alias(k) for k, c in (("covered_points", F.col("yes").isNotNull()), ("remaining_points", F.col("yes").isNull()))])
    title = sections.select("section", T.bounded(F.col("title"), 160).alias("title"))
    rows = here.join(lists, session, "left").join(title, "section", "left").join(title.select((F.col("section") - 1).alias("section"), F.col("title").alias("next_title")), "section", "left")
    done = (F.size("remaining_points") == 0) & (F.size("covered_points") > 0)
    started = F.array_contains("started", F.col("section"))
    before = F.when(F.col("last") > 0, F.forall(F.sequence(F.lit(0).cast("long"), F.col("last") - 1), lambda i: F.array_contains("completed", i))).otherwise(True)
    status = F.when(done, "completed").when(started | (F.size("covered_points") > 0), "in_progress").otherwise("not_started")
    return rows.select(session, "section", "title", status.alias("status"), "covered_points", "remaining_points", F.coalesce("next_title", F.lit("")).alias("next_title"), ((F.col("section") == F.col("last")) & started & done & before).alias("closing_allowed"))


def set_section(index: Column, last: Column) -> Column:
    """struct<current, started, completed> after a section is chosen by hand: all earlier ones count as complete."""
    at = F.least(index, last)
    return F.struct(at.alias("current"), F.array(at).alias("started"), F.when(at > 0, F.sequence(F.lit(0).cast("long"), at - 1)).otherwise(F.array().cast("array<long>")).alias("completed"))


#: What an answer may be.
KINDS = ["answer", "continue_section", "next_section", "clarify", "correction", "close", "none"]
ADVICE = "action string, kind string, say_now string, confidence string, needs_verification string, evidence_refs array<string>"


def advice(raw: Column, trigger: Column, allowed: Column, closing_allowed: Column, limit: int = 120) -> Column:
    """struct<action, kind, say_now, needs_verification, confidence, evidence_refs> of a model's JSON answer; hold for what isn't fit to show.

    allowed: the request's evidence ids. Unknown ids are dropped and ask for verification.
    """
    text = F.trim(F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*|\s*```$", ""))
    v = F.from_json(text, ADVICE)
    action = F.lower(F.trim(F.coalesce(v["action"], F.lit("hold"))))
    kind = F.lower(F.trim(F.coalesce(v["kind"], F.lit("none"))))
    kind = F.when(kind.isin(KINDS), kind).otherwise("none")
    asked = trigger.isin("question", "manual_answer")
    say = T.clean_model_output(F.coalesce(v["say_now"], F.lit("")), limit)
    given = F.coalesce(v["evidence_refs"], F.array().cast("array<string>"))
    refs = F.array_distinct(F.filter(given, lambda r: F.array_contains(allowed, r)))
    unknown = F.exists(given, lambda r: r.isNull() | ~F.array_contains(allowed, r))
    closing = ~asked & (((kind == "close") & ~closing_allowed) | (~closing_allowed & T.is_closing(say)))
    hold = v.isNull() | (action != "show") | (asked & ~kind.isin("answer", "clarify")) | (say == "") | closing
    verify = F.coalesce(F.lower(F.trim(v["needs_verification"])) == "true", F.lit(False)) | ((kind.isin("answer", "correction") | asked) & (F.size(refs) == 0)) | F.coalesce(unknown, F.lit(False))
    none = F.array().cast("array<string>")
    shown = F.struct(F.lit("show").alias("action"), kind.alias("kind"), say.alias("say_now"), verify.alias("needs_verification"), T.strength(v["confidence"].try_cast("double")).alias("confidence"), refs.alias("evidence_refs"))
    held = F.struct(F.lit("hold").alias("action"), F.lit("none").alias("kind"), F.lit("").alias("say_now"), F.lit(False).alias("needs_verification"), F.lit(0.0).alias("confidence"), none.alias("evidence_refs"))
    return F.when(F.coalesce(hold, F.lit(True)), held).otherwise(shown)
