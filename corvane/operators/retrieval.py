"""Ranked retrieval over document chunks: units, chunking, BM25, caps and budgets, overviews, section points."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

K1, B, PHRASE_BONUS = 1.5, 0.75, 4.0


def postings(chunks: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(chunk_id, term, tf, length) of chunks (chunk_id, text)."""
    rows = chunks.select("chunk_id", (T.tokens(F.col("text")) if tokens is None else tokens).alias("t")).where(F.size("t") > 0)
    return rows.select("chunk_id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("chunk_id", "length", "term").agg(F.count("*").alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df, cf): chunks that hold a term, and how often it occurs."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def ordered_sum(term: Column | str, part: Column) -> Column:
    """The sum of parts in the order of their terms: equal chunks get equal scores to the last bit, however rows are dealt.

    An aggregate; it gathers a part for each term of a query that a chunk holds.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(term).alias("term") if isinstance(term, str) else term.alias("term"), part.alias("part"))))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"])


def bm25(chunks: DataFrame, query: str, phrase_bonus: float = PHRASE_BONUS) -> DataFrame:
    """(chunk_id, score) of the chunks that share a term with the query; a term counts twice at most.

    Only postings of the query's terms are shuffled: each chunk's length and its terms' frequencies are found where the
    chunk is read.
    """
    spark = chunks.sparkSession
    q = spark.range(1).select(T.bounded(F.lit(query), 4000).alias("q")).select(T.tokens(F.col("q")).alias("t"), T.folded(T.clean(F.col("q"))).alias("phrase")).first()
    weights: dict[str, int] = {}
    for t in q["t"]:
        weights[t] = min(weights.get(t, 0) + 1, 2)
    stats = chunks.agg(F.count("*").alias("n"), F.avg(T.token_count(F.col("text"))).alias("mean"))  # without making tokens
    if not weights:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    names = sorted(weights)
    wanted = F.array(*[F.lit(t) for t in names])
    rows = chunks.select("chunk_id", T.tokens(F.col("text")).alias("t"), F.instr(T.folded(F.col("text")), q["phrase"]).alias("at"))
    hits = rows.where(F.arrays_overlap("t", wanted)).select("chunk_id", "at", F.size("t").alias("length"), F.filter("t", lambda x: F.array_contains(wanted, x)).alias("t"))
    tf = hits.select("chunk_id", "at", "length", F.explode("t").alias("term")).groupBy("chunk_id", "at", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    weight = F.create_map(*[F.lit(x) for t in names for x in (t, weights[t])])
    joined = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest(F.col("mean"), F.lit(1.0)))) * weight[F.col("term")]
    bonus = F.when((F.col("at") > 0) & F.lit(len(q["phrase"]) >= 4), F.lit(float(phrase_bonus))).otherwise(0.0)
    return joined.groupBy("chunk_id", "at").agg(ordered_sum("term", part).alias("s")).select("chunk_id", (F.col("s") + bonus).alias("score")).where("score > 0")


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best by score, then chunk id as text; a limit that is the feature."""
    return scored.orderBy(F.desc("score"), F.asc(F.col("chunk_id").cast("string"))).limit(k)


def select_evidence(scored: DataFrame, chunks: DataFrame, top_k: int = 4, max_chars: int = 2200, per_document: int = 3) -> DataFrame:
    """(ref_id, chunk_id, document_id, score, excerpt): best first, at most so many of a document, within a budget of characters.

    Only the last excerpt can be cut. A chunk whose redacted text is empty takes no place: that is one without a text, as
    redaction puts something in place of what it takes. So chunks are ranked by key, and only those chosen are redacted.
    """
    rows = scored.join(chunks.where("text <> ''").select("chunk_id", "document_id"), "chunk_id")
    best = [F.desc("score"), F.asc(F.col("chunk_id").cast("string"))]
    capped = rows.withColumn("in_document", F.row_number().over(W.partitionBy("document_id").orderBy(*best))).where(F.col("in_document") <= per_document)
    few = capped.orderBy(*best).limit(top_k)  # the window below sees top_k rows
    few = chunks.select("chunk_id", "text").join(F.broadcast(few), "chunk_id").withColumn("excerpt", T.redact(F.col("text")))
    one = W.orderBy(*best)
    few = few.withColumn("rank", F.row_number().over(one)).withColumn("before", F.coalesce(F.sum(F.length("excerpt")).over(one.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    few = few.where(F.col("before") < max_chars)
    return few.select(F.concat(F.lit("R"), F.col("rank").cast("string")).alias("ref_id"), "chunk_id", "document_id", "score", F.left("excerpt", (F.lit(max_chars) - F.col("before")).cast("int")).alias("excerpt"))


def retrieve(chunks: DataFrame, query: str, top_k: int = 4, max_chars: int = 2200) -> DataFrame:
    """bm25() and select_evidence() over chunks (chunk_id, document_id, text)."""
    return select_evidence(bm25(chunks, query), chunks, top_k, max_chars)


def overview(chunks: DataFrame, per_document: int = 520, total: int = 4800, first: int = 64) -> DataFrame:
    """(document_id, overview): each document's chunks in order, cut to so many characters, while a running budget lasts.

    A document's first chunks nearly always are enough and are all that is redacted; where they aren't, as redaction
    shortens them too much, all of its chunks are taken.
    """
    rank = F.row_number().over(W.partitionBy("document_id").orderBy("ordinal"))
    shown = lambda c: c.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("c")).select("document_id", F.size("c").alias("n"), T.bounded(F.array_join(F.transform("c", lambda x: x["text"]), " "), per_document).alias("overview"))
    some = shown(chunks.withColumn("_r", rank).where(F.col("_r") <= first))
    enough = (F.length("overview") >= per_document) | (F.col("n") < first)
    rest = shown(chunks.join(some.where(~enough).select("document_id"), "document_id", "left_semi"))
    rows = some.where(enough).unionByName(rest)
    # a running sum over all documents, at least a character each: so many documents fit that a limit comes first
    few = rows.where("overview <> ''").orderBy("document_id").limit(total)
    before = F.coalesce(F.sum(F.length("overview")).over(W.orderBy("document_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("before", before).where(F.col("before") < total)
    return few.select("document_id", F.left("overview", (F.lit(total) - F.col("before")).cast("int")).alias("overview"))


def split_text(text: str, target: int = 750, most: int = 1000, overlap: int = 100) -> list[str]:
    """Chunks of a cleaned text: whole up to most characters; else sentences packed greedily, each chunk led by its predecessor's end.

    A sentence longer than most is cut into windows of its own. The last packed chunk is cut at most characters, as an
    overlap can make it longer; one before it isn't.
    """
    import re

    if len(text) <= most:
        return [text] if text else []
    out: list[str] = []
    held = ""
    for sentence in (s.strip() for s in re.split(r"(?<=[。！？!?；;])", text)):
        if len(sentence) > most:
            out += [held] if held else []
            held = ""
            out += [sentence[i : i + most] for i in range(0, len(sentence), most - overlap)]
        elif held and len(held) + len(sentence) > target:
            out.append(held)
            held = held[-overlap:] + sentence
        else:
            held += sentence
    return out + ([held[:most]] if held else [])


def chunk(units: DataFrame, target: int = 750, most: int = 1000) -> DataFrame:
    """(document_id, locator, ordinal, chunk_id, text) of units (document_id, unit, locator, text); ordinals run through a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(parts=[split_text(t or "", target, most) for t in b["text"]])[["document_id", "unit", "locator", "parts"]]

    kinds = dict(units.dtypes)
    cleaned = units.select("document_id", "unit", "locator", T.clean(F.col("text")).alias("text"))
    rows = cleaned.mapInPandas(run, f"document_id {kinds['document_id']}, unit {kinds['unit']}, locator string, parts array<string>")
    rows = rows.select("document_id", "unit", "locator", F.posexplode("parts").alias("piece", "text"))
    ordinal = F.row_number().over(W.partitionBy("document_id").orderBy("unit", "piece"))
    return rows.withColumn("ordinal", ordinal).select("document_id", "locator", "ordinal", F.concat_ws(":", F.col("document_id").cast("string"), F.col("ordinal").cast("string")).alias("chunk_id"), "text")


NOISE = r"(?i)网页预设|测试专用|观察点|建议依次输入|测试说明|反馈观察表|不要上传|不理想："
POINT_NOISE = r"(?U)观察点|停顿\s*\d|不要念|测试时只念|这份讲稿"
BARE_LOCATOR = r"(?U)^(?:正文|第\s*\d+.*|段落\s*\d+|幻灯片\s*\d+)$"


def section_points(records: DataFrame, title: str, most: int = 4) -> DataFrame:
    """(point, text): speaking points for one section, drawn from records (ordinal, locator, text); see points_of()."""
    return points_of(records.select(F.lit(0).alias("section"), F.lit(title).alias("title"), "ordinal", "locator", "text"), "section", most).drop("section")


def points_of(records: DataFrame, section: str, most: int = 4) -> DataFrame:
    """(section, point, text): speaking points for many sections at once, drawn from records (section, title, ordinal, locator, text).

    Each section by itself: records under the heading closest to each part of its title come first; else any whose heading
    matches; else the first two under a real heading; else the first. Their sentences are taken in turns, one of each
    record, without repeats. Ordinals are distinct in a section.
    """
    head = F.element_at(F.split("locator", "·", -1), 1)
    has = lambda a, b: (F.instr(b, a) > 0) | (F.instr(a, b) > 0)
    key = F.col("key")
    some = F.filter(F.transform(F.split("title", "以及|与|和|及|/", -1), T.section_title), lambda p: F.length(p) >= 2)
    rows = records.where(~F.concat_ws("\n", "locator", F.left("text", F.lit(100))).rlike(NOISE))
    rows = rows.withColumns({"at": T.section_title(head), "key": T.section_title(F.col("title")), "parts": some})
    hit = (key != "") & (F.col("at") != "") & (has(key, F.col("at")) | F.exists("parts", lambda p: has(p, F.col("at"))))
    rows = rows.withColumns({"hit": hit, "bare": T.clean(head).rlike(BARE_LOCATOR), "parts": F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.filter(F.array(key), lambda k: k != ""))})
    near = rows.where("hit").select("*", F.posexplode("parts").alias("part_at", "part")).where((F.instr("at", F.col("part")) > 0) | (F.instr("part", F.col("at")) > 0))
    order = F.struct((F.col("at") != F.col("part")).alias("a"), F.abs(F.length("at") - F.length("part")).alias("b"), F.col("ordinal").alias("c"))
    closest = near.groupBy(section, "part_at").agg(F.min_by("ordinal", order).alias("ordinal")).groupBy(section, "ordinal").agg(F.min("part_at").alias("place"))
    tagged = rows.join(closest, [section, "ordinal"], "left").withColumn("class", F.when(F.col("place").isNotNull(), 0).when(F.col("hit"), 1).when(~F.col("bare"), 2).otherwise(3))
    tagged = tagged.withColumn("nth", F.row_number().over(W.partitionBy(section, "class").orderBy("ordinal")))
    # unmatched records: two under a real heading, or, if there are none, the first of all
    tagged = tagged.where((F.col("class") < 2) | ((F.col("class") == 2) & (F.col("nth") <= 2)) | ((F.col("class") == 3) & (F.col("nth") == 1)))
    chosen = tagged.withColumn("least", F.min("class").over(W.partitionBy(section))).where(F.col("class") == F.col("least")).withColumn("place", F.coalesce("place", "ordinal"))
    sentences = F.split(T.strip_heading(F.col("text"), F.col("locator")), r"(?U)(?<=[。！？!?；;])\s*", -1)
    points = F.array_distinct(F.filter(F.transform(sentences, lambda s: T.bounded(F.regexp_replace(s, r"^[ >\-*•\t]+", ""), 240)), lambda p: (F.length(p) >= 10) & ~p.rlike(POINT_NOISE) & (T.section_title(p) != key)))
    flat = chosen.select(section, "place", F.posexplode(points).alias("turn", "text"))
    kept = flat.groupBy(section, "text").agg(F.min(F.struct("turn", "place")).alias("o"))
    return kept.withColumn("point", F.row_number().over(W.partitionBy(section).orderBy("o"))).where(F.col("point") <= most).select(section, "point", "text")
