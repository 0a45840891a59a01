"""A meeting's knowledge base, map and requests: ingestion as a whole, sections with points, what a model is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..sources.documents import read_office, read_units
from . import blocks
from . import retrieval as R
from . import sessions as S

#: What a file may be, and what a session holds.
SUFFIXES = [".txt", ".md", ".pptx", ".docx", ".pdf"]
MAX_BYTES, MAX_CHARS, MAX_FILES, MAX_SECTIONS = 25 << 20, 500_000, 10, 16
SLICES = 64
TRIGGERS = ["question", "manual_answer", "manual_next", "next_line", "manual"]


def ingest(files: DataFrame, documents: DataFrame | None = None, max_bytes: int = MAX_BYTES, max_chars: int = MAX_CHARS, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, problems) that one batch of files (path, content: binary) adds; see ingest_all()."""
    one = lambda d: d if d is None else d.withColumn("_batch", F.lit(0))
    return tuple(t.drop("_batch") for t in ingest_all(one(files), "_batch", one(documents), max_bytes, max_chars, max_files))


def ingest_all(files: DataFrame, batch: str, documents: DataFrame | None = None, max_bytes: int = MAX_BYTES, max_chars: int = MAX_CHARS, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, problems) that batches of files (batch, path, content: binary) add, each to a knowledge base of its own.

    Nothing of a batch is added if there is any problem in it; others don't suffer. A document is its content: copies in a
    batch are one (the first path's), and what documents (batch, document_id) holds already is passed over. problems:
    batch, path, reason (suffix, empty, size, unreadable, chars, files). documents: batch, document_id, name, kind, sha256,
    chunk_count. chunks: batch and the columns of retrieval.chunk(). A null content is empty; files of no batch (null) are
    left out. A batch's files are counted, not gathered.
    """
    c = F.col
    rows = files.where(c(batch).isNotNull()).select(batch, "path", "content", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).alias("suffix"), F.coalesce(F.length("content"), F.lit(0)).alias("size"), F.sha2("content", 256).alias("sha256"))
    reason = F.when(~c("suffix").isin(SUFFIXES), "suffix").when(c("size") == 0, "empty").when(c("size") > max_bytes, "size")
    rows = rows.withColumn("reason", reason)
    fresh = rows.where("reason IS NULL").groupBy(batch, F.left("sha256", F.lit(16)).alias("own_id")).agg(F.min_by(F.struct("path", "content", "suffix", "sha256"), "path").alias("f")).select(batch, "own_id", "f.*")
    if documents is not None:
        fresh = fresh.join(documents.select(batch, c("document_id").alias("own_id")), [batch, "own_id"], "left_anti")
    # one id for a document of a batch, while units and chunks are made
    fresh = fresh.withColumn("document_id", F.concat(c(batch).cast("string"), F.lit("/"), "own_id"))
    units = read_units(fresh)
    long = units.groupBy("document_id").agg(F.sum(F.length("text")).alias("chars")).where(c("chars") > max_chars)
    closed = read_office(fresh.where(~c("suffix").isin(".txt", ".md"))).where("problem LIKE 'refused%'").select("document_id").distinct()
    path_of = lambda d, why: d.join(fresh.select("document_id", batch, "path"), "document_id").select(batch, "path", F.lit(why).alias("reason"))
    held = fresh.groupBy(batch).agg(F.count("*").alias("n"))
    if documents is not None:
        held = held.join(documents.groupBy(batch).agg(F.count("*").alias("m")), batch, "left").select(batch, (c("n") + F.coalesce("m", F.lit(0))).alias("n"))
    many = held.where(c("n") > max_files).select(batch, F.lit("").alias("path"), F.lit("files").alias("reason"))
    problems = rows.where("reason IS NOT NULL").select(batch, "path", "reason").unionByName(path_of(closed, "unreadable")).unionByName(path_of(long, "chars")).unionByName(many)
    # a batch may hold most of all rows, so its documents meet its verdict in so many slices
    slices = lambda d: d.withColumn("_slice", F.pmod(F.xxhash64("document_id"), F.lit(SLICES)).cast("int"))
    faulty = problems.select(batch).distinct().withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    chunks = R.chunk(units).join(fresh.select("document_id", batch, "own_id"), "document_id")
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    name = T.bounded(F.regexp_extract("path", r"([^/]+)$", 1), 180)
    new = fresh.join(counts, "document_id", "left").select(batch, c("own_id").alias("document_id"), name.alias("name"), F.substring("suffix", 2, 9).alias("kind"), "sha256", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    chunks = chunks.select(batch, c("own_id").alias("document_id"), "locator", "ordinal", F.concat_ws(":", "own_id", c("ordinal").cast("string")).alias("chunk_id"), "text")
    only = lambda d: slices(d).join(faulty, [batch, "_slice"], "left_anti").drop("_slice")
    return only(new), only(chunks), problems


def without(documents: DataFrame, chunks: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """A knowledge base without one document. Tables don't change, so a session keeps what it was given."""
    return tuple(t.where(~F.col("document_id").eqNullSafe(F.lit(document_id))) for t in (documents, chunks))


def listing(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, name, chunks, chars) of every document, those without chunks too."""
    per = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return documents.select("document_id", "name").join(per, "document_id", "left").select("document_id", "name", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("chars", F.lit(0)).alias("chars"))


def meeting_map(spark: SparkSession, agenda: list[str], focus: list[str], chunks: DataFrame) -> DataFrame:
    """(section, title, points) of an agenda, sixteen entries at most; without one, of the focus points as one section.

    An entry's own points count; else what retrieval finds under its title (chunks: chunk_id, document_id, locator, text);
    else the title stands for itself. Empty entries are left out, numbers stay those of the agenda. All sections are
    ranked in one plan: chunks are tokenised once, whatever the number of sections.
    """
    entries = agenda[:MAX_SECTIONS] or (["会议重点：" + "；".join(focus[:6])] if focus else [])
    e = F.col("entry")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(entries)], "section int, entry string").select("section", T.agenda_title(e).alias("title"), T.agenda_points(e).alias("points")).where("title <> ''")
    asked = rows.where(F.size("points") == 0).select("section", F.col("title").alias("query"))
    hits = evidence(asked, chunks, "section", top_k=10, phrase_bonus=R.PHRASE_BONUS)
    records = excerpts(hits, chunks.select("chunk_id", "locator", "text"), "section", 8000).join(F.broadcast(rows.select("section", "title")), "section")
    points = R.points_of(records.select("section", "title", F.col("rank").alias("ordinal"), "locator", F.col("excerpt").alias("text")), "section")
    found = points.groupBy("section").agg(F.transform(F.array_sort(F.collect_list(F.struct("point", "text"))), lambda p: p["text"]).alias("found"))
    own = F.array(T.bounded(F.col("title"), 160))
    return rows.join(F.broadcast(found), "section", "left").select("section", "title", F.when(F.size("points") > 0, F.col("points")).otherwise(F.coalesce(F.slice("found", 1, 6), own)).alias("points"))


def task(trigger: Column, remaining: Column, next_title: Column, closing_allowed: Column) -> Column:
    """What kind of answer a request asks for: answer, continue, transition, close, supplement, prompt_continue, prompt_transition, prompt or decide."""
    left, after = F.size(remaining) > 0, next_title != ""
    return (
        F.when(trigger.isin("question", "manual_answer"), "answer")
        .when(trigger == "manual_next", F.when(left, "continue").when(after, "transition").when(closing_allowed, "close").otherwise("supplement"))
        .when(trigger == "next_line", F.when(left, "prompt_continue").when(after, "prompt_transition").otherwise("prompt"))
        .otherwise("decide")
    )


def requests(turns: DataFrame, progress: DataFrame, session: str, order: str, trigger: str, focus: list[str], latest: str = "") -> DataFrame:
    """(session, trigger, recent_turns, rolling_summary, latest_text, query, task) of every session that has a progress row.

    turns: session, order, text; progress: sessions.projection(). Recent turns are the newest within twelve and 3,000
    characters, in order, cut to 600; the summary is of older ones. The query for retrieval joins the latest text, the
    last three recent turns, the section's title, the first two points that remain (or the next title) and the focus.
    """
    kind = trigger.strip().lower() if trigger.strip().lower() in TRIGGERS else "manual"
    lists = lambda d, x: d.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, x))), lambda t: t[x]).alias(f"_{x}"))
    recent = lists(S.recent(turns.select(session, order, "text"), session, order), "text")
    older = lists(S.summary(turns, session, order).where("point <> ''"), "point")
    none = F.array().cast("array<string>")
    rows = progress.join(recent, session, "left").join(older, session, "left").withColumn("_text", F.coalesce("_text", none))
    said = T.bounded(F.lit(latest), 800)
    rows = rows.withColumn("latest_text", F.when(said != "", said).otherwise(F.coalesce(F.try_element_at("_text", F.lit(-1)), F.lit(""))))
    some = F.filter("remaining_points", lambda p: F.trim(p) != "")
    goal = F.when(F.size(some) > 0, F.slice(some, 1, 2)).when(F.col("next_title") != "", F.array("next_title")).otherwise(none)
    last = F.slice("_text", F.greatest(F.size("_text") - 2, F.lit(1)), F.lit(3))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.array("title")).otherwise(none)
    parts = F.concat(F.array("latest_text"), last, title, goal, F.array(*map(F.lit, focus[:8])).cast("array<string>"))
    return rows.select(
        session,
        F.lit(kind).alias("trigger"),
        F.transform("_text", lambda t: T.bounded(t, 600)).alias("recent_turns"),
        F.coalesce("_point", none).alias("rolling_summary"),
        "latest_text",
        F.array_join(parts, "\n").alias("query"),
        task(F.lit(kind), some, F.col("next_title"), F.col("closing_allowed")).alias("task"),
    )


#: So many queries and chunks meet in a task.
QUERIES_OF_BLOCK, CHUNKS_OF_BLOCK = 32768, 32768


def evidence(queries: DataFrame, chunks: DataFrame, key: str, top_k: int = 4, per_document: int = 3, phrase_bonus: float = 0.0, digits: int | None = None) -> DataFrame:
    """(key, rank, chunk_id, document_id, score) for many queries (key, query) at once: BM25, capped by document.

    Blocks of queries meet blocks of chunks, and a pair of blocks gives each query's best; these are ranked, by scores
    rounded to so many digits if any are given. With a phrase_bonus the queries must be few (an agenda): their texts go
    to every chunk as one row, and a chunk that holds a whole query of four characters or more gets the bonus.
    """
    text = T.bounded(F.col("query"), 4000)
    if phrase_bonus:
        scored = _with_phrases(queries, chunks, key, text, phrase_bonus)
        scored = scored if digits is None else scored.withColumn("score", F.round("score", digits))
    else:
        asked, rows = queries.select(key, T.tokens(text).alias("t")), chunks.select("chunk_id", "document_id", T.tokens(F.col("text")).alias("t"))
        scored = blocks.evidence(asked, rows, key, QUERIES_OF_BLOCK, CHUNKS_OF_BLOCK, R.K1, R.B, top_k, per_document, digits)
    best = [F.desc("score"), F.asc(F.col("chunk_id").cast("string"))]
    capped = scored.withColumn("_d", F.row_number().over(W.partitionBy(key, "document_id").orderBy(*best))).where(F.col("_d") <= per_document)
    return capped.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*best))).where(F.col("rank") <= top_k).select(key, "rank", "chunk_id", "document_id", "score")


def _with_phrases(queries: DataFrame, chunks: DataFrame, key: str, text: Column, phrase_bonus: float) -> DataFrame:
    """(key, chunk_id, document_id, score) of all chunks that share a term with a query, by joins."""
    q = queries.select(key, F.explode(T.tokens(text)).alias("term")).groupBy(key, "term").agg(F.least(F.count("*"), F.lit(2)).alias("w"))
    rows = chunks.select("chunk_id", "document_id", T.tokens(F.col("text")).alias("t"), "text")
    phrases = queries.select(key, T.folded(T.clean(text)).alias("phrase")).where(F.length("phrase") >= 4)
    rows = rows.crossJoin(F.broadcast(phrases.agg(F.collect_list(F.struct(key, "phrase")).alias("phrases"))))  # one row
    said = F.array_sort(F.transform(F.filter("phrases", lambda p: F.instr(T.folded(F.col("text")), p["phrase"]) > 0), lambda p: p[key]))
    stats = F.broadcast(chunks.agg(F.count("*").alias("n"), F.avg(T.token_count(F.col("text"))).alias("mean")))  # one row
    rows = rows.select("chunk_id", "document_id", said.alias("said"), "t")  # a step of its own: beside explode() it would run for every token
    rows = rows.select("chunk_id", "document_id", "said", F.size("t").alias("length"), F.explode("t").alias("term"))
    tf = rows.join(q.select("term").distinct(), "term", "left_semi").groupBy("chunk_id", "document_id", "said", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("length") / F.greatest(F.col("mean"), F.lit(1.0))))
    hits = tf.join(df, "term").crossJoin(stats).withColumn("part", part).join(q, "term")
    scored = hits.groupBy(key, "chunk_id", "document_id", F.array_contains("said", F.col(key)).alias("whole")).agg(R.ordered_sum("term", F.col("part") * F.col("w")).alias("score"))
    return scored.withColumn("score", F.col("score") + F.when(F.col("whole"), F.lit(float(phrase_bonus))).otherwise(0.0))


def excerpts(hits: DataFrame, chunks: DataFrame, key: str, max_chars: int = 2200) -> DataFrame:
    """hits (key, rank, chunk_id) with the chunks' other columns and an excerpt instead of the text: redacted, best first, while each key's budget of characters lasts.

    Only the last excerpt of a key can be cut; ranks stay.
    """
    shown = chunks.join(hits, "chunk_id").withColumn("excerpt", T.redact(F.col("text"))).drop("text")
    before = F.coalesce(F.sum(F.length("excerpt")).over(W.partitionBy(key).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shown = shown.withColumn("before", before).where(F.col("before") < max_chars)
    return shown.withColumn("excerpt", F.left("excerpt", (F.lit(max_chars) - F.col("before")).cast("int"))).drop("before")
