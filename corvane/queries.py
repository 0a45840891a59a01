"""Registered queries of the library over whole tables, each beside the SQL it is held against.

The tables stand in for an operator's shape, not for its domain: documents are chunks, sources are documents,
conversations are sessions, embeddings are sample arrays, events are streams. Where a rule can't fire on the tables' own
text (questions, secrets, codes), the query puts what fires it around the tables' texts and numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import lineage as L
from .functions import paths as P
from .functions import text as T
from .operators import admission as AD
from .operators import evaluation as E
from .operators import hooks as HK
from .operators import meeting as MT
from .operators import metrics as M
from .operators import quality as Q
from .operators import retrieval as R
from .operators import sessions as S
from .operators import signal as G
from .sources import media as MD
from .sources import sinks as K
from .streaming import batch as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL for the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The same rows for SQL."""

    def lit(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") v({names})"


TOKENS = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-zA-Z][a-zA-Z0-9_.+-]*|[0-9]+(?:\.[0-9]+)?')"


#: The redactions for DuckDB, whose patterns can't look around: what stands beside a match is put back.
SQL_REDACTIONS = [
    (r"(?i)\b(?:api[_-]?key|access[_-]?token|token|password|passwd|secret)\s*[:=]\s*(?:bearer\s+)?[^\s,;，；]+", "[凭据]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{8,}=*", "[凭据]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{16,}\b", "[凭据]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[凭据]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "[凭据]"),
    (r"(?i)DASHSCOPE_API_KEY\s*=\s*\S+|\bsk-[A-Za-z0-9_-]{8,}\b", "[密钥]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[邮箱]"),
    (r"(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])", r"\1[手机号]\2"),
    (r"(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])", r"\1[身份证]\2"),
    (r"(^|[^\w.])/(?:Users|home|private|var|tmp|etc|opt|Volumes)/[^\s,;，；]+", r"\1[路径]"),
    (r"(?i)\b[a-z]:\\[^\s,;，；]+", "[路径]"),
]


def redacted(x: str) -> str:
    """The same redactions of an SQL expression."""
    for pattern, put in SQL_REDACTIONS:
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return x


CLEANED = r"trim(regexp_replace({0}, '[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ' ', 'g'))"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), "text")


# --- retrieval

QUERY = "the that and thing edre with the nder sur la"
WEIGHTS = [("the", 2), ("that", 1), ("and", 1), ("thing", 1), ("edre", 1), ("with", 1), ("nder", 1), ("sur", 1), ("la", 1)]
SCORES = f"""
    d AS (SELECT doc_id::VARCHAR AS chunk_id, source AS document_id, text, {TOKENS.format("text")} AS t FROM documents),
    s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    q AS (SELECT * FROM {values(WEIGHTS, "term, w")}),
    tf AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM d) JOIN q USING (term) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sc AS (SELECT chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(mean, 1.0))) * w ORDER BY term) AS score
           FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY chunk_id)"""


@query(f"WITH {SCORES} SELECT chunk_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM sc ORDER BY score DESC, chunk_id LIMIT 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top(R.bm25(chunks(spark, sf_dir), QUERY), 10)
    return best.select("chunk_id", F.round("score", 6).alias("score"), F.row_number().over(W.orderBy(F.desc("score"), "chunk_id")).cast("long").alias("rank"))


@query(f"WITH {SCORES} SELECT chunk_id, round(score, 6) AS score FROM sc")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(chunks(spark, sf_dir), QUERY).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""
    WITH {SCORES},
    capped AS (SELECT sc.*, document_id, text, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS k FROM sc JOIN d USING (chunk_id)),
    few AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM capped WHERE k <= 3 QUALIFY rank <= 12),
    shown AS (SELECT * EXCLUDE (text), {redacted("text")} AS text FROM few),
    run AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM shown)
    SELECT 'R' || rank AS ref_id, chunk_id, document_id, round(score, 6) AS score, left(text, greatest(20000 - before, 0)::BIGINT) AS excerpt FROM run WHERE before < 20000""")
def bm25_doc_cap_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.retrieve(chunks(spark, sf_dir), QUERY, top_k=12, max_chars=20_000)
    return out.withColumn("score", F.round("score", 6))


PHRASE = "of the"


@query(f"""
    WITH d AS (SELECT doc_id::VARCHAR AS chunk_id, replace(lower(text), 'ß', 'ss') AS low, {TOKENS.format("text")} AS t FROM documents),
    s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    tf AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN ('of', 'the') GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sc AS (SELECT chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(mean, 1.0))) ORDER BY term) AS score FROM tf JOIN df USING (term), s GROUP BY chunk_id)
    SELECT chunk_id, round(score + CASE WHEN contains(low, '{PHRASE}') THEN 4.0 ELSE 0.0 END, 6) AS score FROM sc JOIN d USING (chunk_id)""")
def bm25_phrase_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(chunks(spark, sf_dir), PHRASE).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""
    WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM documents) GROUP BY ALL)
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_stats(R.postings(chunks(spark, sf_dir)))


@query(f"""
    WITH c AS (SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS t FROM documents GROUP BY source),
    o AS (SELECT source AS document_id, left({redacted(CLEANED.format("t"))}, 520) AS overview FROM c),
    r AS (SELECT *, coalesce(sum(length(overview)) OVER (ORDER BY document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WHERE overview <> '')
    SELECT document_id, left(overview, (4800 - before)::BIGINT) AS overview FROM r WHERE before < 4800""")
def material_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return R.overview(d.select(F.col("source").alias("document_id"), F.col("doc_id").alias("ordinal"), "text"))


@query()
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return R.chunk(d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("unit"), F.lit("正文").alias("locator"), "text"))


@query("""
    WITH r AS (SELECT doc_id, sha256(text) AS h, length(text) AS n, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS k FROM documents)
    SELECT doc_id, left(h, 16) AS document_id FROM r WHERE k = 1""")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # the first of each hash is a grouped minimum: copies are combined before the shuffle
    return d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.left("h", F.lit(16)).alias("document_id"))


# --- text functions


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g')) AS clean FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {redacted('text')} AS redacted FROM documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


#: What a secret looks like around a number of the table: what stands before, the number's column, its width, what stands behind.
SECRET_FORMS = [
    ("api_key = k", "event_id", 0, ", x"), ("Authorization: Bearer abcdefgh", "event_id", 0, "=="), ("ghp_0123456789abcdef", "user_id", 0, "!"), ("AKIA", "event_id", 16, ""), ("key sk-abcdefgh", "user_id", 0, " end"), ("mail u", "user_id", 0, "@c.org now"),
    ("call 138", "event_id", 8, "."), ("id 1101011990", "event_id", 7, "X"), ("see /home/u", "user_id", 0, "/x.txt, ok"), ("at C:\\temp\\e", "event_id", 0, " y"), ("2138", "event_id", 8, ""), ("dashscope_api_key = s", "event_id", 0, " d"), ("nothing ", "event_id", 0, " here"),
]


@query("WITH t AS (SELECT event_id AS id, CASE event_id % " + str(len(SECRET_FORMS)) + " " + " ".join(f"WHEN {i} THEN '{a}' || " + (f"lpad({c}::VARCHAR, {n}, '0')" if n else f"{c}::VARCHAR") + f" || '{b}'" for i, (a, c, n, b) in enumerate(SECRET_FORMS)) + f" END AS text FROM events) SELECT id, {redacted('text')} AS redacted FROM t")
def redact_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = None
    for i, (before, column, width, behind) in enumerate(SECRET_FORMS):
        number = F.col(column).cast("string")
        form = F.concat(F.lit(before), F.lpad(number, width, "0") if width else number, F.lit(behind))
        held = F.col("event_id") % len(SECRET_FORMS) == i
        text = F.when(held, form) if text is None else text.when(held, form)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), T.redact(text).alias("redacted"))


@query("SELECT page_id, left(" + redacted(CLEANED.format(r"regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]{1,200}>', '', 'g'), '```', ''), '**', ''), '__', ''), '^\s{0,3}#{1,6}\s*', '')")) + ", 2000) AS stripped FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.clean_model_output(F.col("html"), 2000).alias("stripped"))


@query(r"SELECT page_id, contains(lower(html), '<script') OR contains(lower(html), 'javascript:') OR regexp_matches(lower(html), '\son[a-z]+\s*=') AS unsafe, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages".replace('\\"', '"'))
def html_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.unsafe_html(T.strip_remote_tags(F.col("html"))).alias("unsafe"), T.escape_html(F.col("url")).alias("escaped"))


#: What is put before a turn's text: important words, questions, and neither.
NOTES = ["决定下周完成 ", "负责人是谁？", "是吗? ", "好的 ", "未完成 的部分 "]
NOTED_TEXT = "CASE turn % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(NOTES)) + " END || text"


@query(f"WITH t AS (SELECT conv_id, turn, {NOTED_TEXT} AS text FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(text, '决定|结论|承诺|下一步|行动项|负责人|截止|风险|问题|阻塞|指标|结果|完成|未完成|需要核实') THEN 2 WHEN regexp_matches(text, '[?？]') THEN 1 ELSE 0 END AS priority FROM t")
def importance_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.array(*map(F.lit, NOTES))[(F.col("turn") % 5).cast("int")], "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.importance(text).alias("priority"))


NUMBER = "CASE l_linenumber WHEN 1 THEN l_quantity * 1000000 WHEN 2 THEN l_quantity / 100000 WHEN 3 THEN l_quantity WHEN 4 THEN -l_quantity / 8 WHEN 5 THEN l_quantity + 0.5 END"


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber, {NUMBER} AS x FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN x IS NOT NULL THEN format('{{:g}}', x) WHEN l_linenumber = 6 THEN 'n/a' ELSE 'not_applicable' END AS key FROM x")
def number_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("l_linenumber") == 6, "n/a").otherwise(F.concat(F.lit(" "), F.expr(NUMBER).cast("string")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.key_of_number(x).alias("key"))


#: What is put behind a turn's last letter: ends of questions, words of questions, closings, and neither.
ENDINGS = ["？", "吗。", "，怎么办", "，以上就是全部", " 谢谢大家", "。", " Is it done ?", "呢"]
ASKED = "regexp_replace(text, '[^a-zA-Z]+$', '') || CASE turn % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ENDINGS)) + " END"


@query(f"""WITH t AS (SELECT conv_id, turn, {ASKED} AS text FROM conversations)
    SELECT conv_id, turn, regexp_matches(text, '[?？]\\s*$') OR regexp_matches(text, '[吗么呢嘛]\\s*[。！!]?\\s*$') OR regexp_matches(text, '为什么|怎么|如何|能否|可否|是否|是不是|有没有|多少|谁|哪里|哪个|哪些|什么时候|几点') AS question,
        regexp_matches(text, '以上就是|谢谢(?:大家|各位|老师)') AS closing FROM t""")
def question_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.regexp_replace("text", "[^a-zA-Z]+$", ""), F.array(*map(F.lit, ENDINGS))[(F.col("turn") % 8).cast("int")])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_question(text).alias("question"), T.is_closing(text).alias("closing"))


HAN = "语音识别的结果和我的数据是在这里"


@query(f"""
    WITH t AS (SELECT conv_id, turn, text, string_split(substring('{HAN}', 1 + (turn % 11)::BIGINT, 1 + (conv_id % 6)::BIGINT), '') AS h FROM conversations),
    k AS (SELECT *, {TOKENS.format("text")} || list_filter(h, lambda c: NOT contains('{T.HAN_STOP}', c)) || list_filter(list_transform(range(1, len(h)), lambda i: h[i] || h[i + 1]), lambda p: NOT (contains('{T.HAN_STOP}', p[1]) AND contains('{T.HAN_STOP}', p[2]))) AS x FROM t)
    SELECT conv_id, turn, len(x)::INTEGER AS n, array_to_string(x, '|') AS tokens FROM k""")
def han_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    han = F.substring(F.lit(HAN), (F.col("turn") % 11 + 1).cast("int"), (F.col("conv_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.concat("text", F.lit(" "), han)).alias("x"))
    return rows.select("conv_id", "turn", F.size("x").alias("n"), F.array_join("x", "|").alias("tokens"))


@query("SELECT doc_id, source AS title, lang || '|a' || doc_id % 5 AS points FROM documents")
def agenda_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.concat("source", F.lit("："), "lang", F.lit("；a"), (F.col("doc_id") % 5).cast("string"), F.lit(" ;"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", T.agenda_title(e).alias("title"), F.array_join(T.agenda_points(e), "|").alias("points"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}\x1c-\x1f]')) AS n_tokens, len(list_filter(regexp_split_to_array(text, '[\n\r,，;；]+'), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12)) <> '')) AS n_items FROM documents")
def diff_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.diff_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(T.split_list(F.col("text"))).cast("long").alias("n_items"))


@query("""SELECT l_orderkey, l_linenumber, format('{:.1f}%', l_discount * 100) AS pct, CASE WHEN abs(l_tax - l_discount) * 100 <= 1e-12 THEN '持平' WHEN l_tax > l_discount THEN '下降 ' || format('{:.1f}', (l_tax - l_discount) * 100) || ' 个百分点（改善）'
    ELSE '上升 ' || format('{:.1f}', (l_discount - l_tax) * 100) || ' 个百分点（变差）' END AS change FROM lineitem""")
def rate_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.percent_text(F.col("l_discount")).alias("pct"), T.change_text(F.col("l_tax"), F.col("l_discount")).alias("change"))


# --- error rates and differences


@query(r"""
    WITH p AS (SELECT b.item_id, regexp_replace(lower(b.text), '[^a-z0-9]', '', 'g') AS r, regexp_replace(lower(d.text), '[^a-z0-9]', '', 'g') AS h FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)
    SELECT item_id, levenshtein(r, h)::BIGINT AS edits, round(levenshtein(r, h) / length(r), 6) AS cer, (length(r) - length(h))::BIGINT AS del_less_ins FROM p""")
def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_only = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    pairs = b.join(d.select(F.col("doc_id").alias("item_id"), F.col("text").alias("t")), "item_id").select("item_id", ascii_only(F.col("text")).alias("reference"), ascii_only(F.col("t")).alias("hypothesis"))
    out = M.error_rates(pairs)
    return out.select("item_id", (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("edits"), F.round("cer", 6).alias("cer"), (F.col("deletions") - F.col("insertions")).alias("del_less_ins"))


@query()
def text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return b.join(d.select(F.col("doc_id").alias("item_id"), F.col("text").alias("t")), "item_id").select("item_id", M.text_diff("text", "t").alias("diff"))


# --- evaluation

WAY = "CASE WHEN l_tax IS NULL OR l_discount IS NULL THEN 'unavailable' WHEN abs(l_tax - l_discount) <= 1e-12 THEN 'tied' WHEN l_tax > l_discount THEN 'improved' ELSE 'worsened' END"
STATE = "CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'partial' ELSE 'failed' END"


@query(f"""
    WITH r AS (SELECT l_tax::DOUBLE AS b, l_discount::DOUBLE AS a, {WAY} AS w, {STATE} AS s, l_linestatus AS status, l_linenumber::VARCHAR AS line FROM lineitem),
    e AS (SELECT 'overall' AS level, '' AS key, * FROM r UNION ALL SELECT 'status', status, * FROM r UNION ALL SELECT 'line', line, * FROM r)
    SELECT level, key, count(*) AS n, count(*) FILTER (s = 'success') AS success, count(*) FILTER (s = 'partial') AS partial, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (w = 'improved') AS improved,
        count(*) FILTER (w = 'tied') AS tied, count(*) FILTER (w = 'worsened') AS worsened, count(*) FILTER (w = 'unavailable') AS unavailable, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS paired,
        round(median(b), 6) AS before_median, round(median(a), 6) AS after_median FROM e GROUP BY level, key""")
def eval_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "N", "partial").otherwise("failed")
    out = E.summarize(li, F.col("l_tax"), F.col("l_discount"), state, status=F.col("l_linestatus"), line=F.col("l_linenumber"))
    return out.withColumn("before_median", F.round("before_median", 6)).withColumn("after_median", F.round("after_median", 6))


@query(f"SELECT l_linestatus, {WAY} AS direction, count(*) AS n FROM lineitem GROUP BY ALL")
def direction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus", M.direction(F.col("l_tax"), F.col("l_discount")).alias("direction")).agg(F.count("*").alias("n"))


@query("""
    WITH g AS (SELECT lang AS split, count(*) AS n FROM documents GROUP BY lang), w AS (SELECT * FROM (VALUES ('en', 620), ('fr', 145), ('xx', 1)) v(split, expected))
    SELECT split, coalesce(n, 0)::BIGINT AS n, coalesce(expected, 0)::BIGINT AS expected, coalesce(n, 0) = coalesce(expected, 0) AS ok FROM g FULL JOIN w USING (split)""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.split_counts(table(spark, sf_dir, "documents"), F.col("lang"), {"en": 620, "fr": 145, "xx": 1})


@query("""
    SELECT doc_id, 'missing' AS side FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
    UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""")
def coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def _speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("speaker"), F.col("c_custkey").alias("i"))


MIXES = """m AS (SELECT 'c' || c_custkey AS speaker, sentence, ['fan', 'keyboard', 'traffic'][(c_custkey + j) % 3 + 1] AS noise, snr, CASE sentence WHEN 'S03' THEN 'locked_test' ELSE 'dev' END AS split
    FROM customer, (VALUES (0, 'S01'), (1, 'S02'), (2, 'S03')) x(j, sentence), (VALUES (5), (0), (-5)) y(snr))"""


@query(f"WITH {MIXES} SELECT * FROM m")
def latin_square_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mixes(_speakers(spark, sf_dir))


@query(f"""
    WITH {MIXES},
    a AS (SELECT DISTINCT 'clean' AS kind, 'raw/clean/spk' || speaker || '/clean_spk' || speaker || '_' || lower(sentence) || '.wav' AS path FROM m UNION ALL SELECT DISTINCT 'noise', 'raw/noise/noise_' || noise || '_take01.wav' FROM m
        UNION ALL SELECT 'mix', 'controlled/' || split || '/mix_spk' || speaker || '_' || lower(sentence) || '_' || noise || '_' || CASE snr WHEN 5 THEN 'snrp05' WHEN 0 THEN 'snr000' ELSE 'snrm05' END || '.wav' FROM m
        UNION ALL SELECT 'real', 'raw/real/real_spkc' || c_custkey || '_' || ['fan', 'keyboard', 'traffic'][c_custkey % 3 + 1] || '_r01.wav' FROM customer)
    SELECT kind, count(*) AS n, count(DISTINCT path) AS paths, min(path) AS first_path, max(path) AS last_path FROM a GROUP BY kind""")
def frozen_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    speakers = _speakers(spark, sf_dir)
    noise = F.array(*map(F.lit, E.NOISES))[(F.col("i") % 3).cast("int")]
    files = E.artifacts_of(E.mixes(speakers), speakers.select("speaker", noise.alias("noise")))
    return files.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@query("""
    WITH p AS (SELECT p_partkey AS key, row_number() OVER (ORDER BY p_partkey) AS i FROM part), r AS (SELECT * FROM (VALUES ('r1', 0), ('r2', 1), ('r3', 2)) v(rater, r))
    SELECT rater, 'T' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END AS blind_id, key, CASE WHEN (i - 1 + r) % 2 = 0 THEN 'original' ELSE 'enhanced' END AS a_role,
        CASE WHEN (i - 1 + r) % 2 = 0 THEN 'enhanced' ELSE 'original' END AS b_role FROM p, r""")
def blind_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.blind_assignments(table(spark, sf_dir, "part"), ["r1", "r2", "r3"], "p_partkey")


@query("""
    WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i FROM part), r AS (SELECT * FROM (VALUES ('r1', 0), ('r2', 1), ('r3', 2)) v(rater, r)),
    g AS (SELECT rater, count(*) FILTER ((i - 1 + r) % 2 = 0) AS original_a, count(*) FILTER ((i - 1 + r) % 2 = 1) AS enhanced_a FROM p, r GROUP BY rater)
    SELECT *, abs(original_a - enhanced_a) <= 1 AS ok FROM g""")
def blind_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.balance(blind_assignment(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'failed' WHEN event_type = 'error' OR value < 50 OR user_id % 7 = 0 THEN 'partial' ELSE 'success' END AS status FROM events""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    there = lambda ok: F.when(ok, "x")
    codes = F.when(c("event_type") == "error", F.array(F.lit("CACHE_USED"), F.lit("ASR_EMPTY"))).when(c("event_type") == "click", F.array(F.lit("EVENT_FAILED")))
    out = E.status(c("event_id") % 11 != 0, there(c("event_id") % 13 != 0), codes, there(c("value") >= 50), F.lit("x"), there(c("user_id") % 7 != 0), F.lit("x"))
    return table(spark, sf_dir, "events").select("event_id", out.alias("status"))


# --- quality


@query("SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) WHERE doc_id > first")
def dup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "doc_id")
    return Q.duplicates(d, "h", "doc_id").select("doc_id", "first")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_l_suppkey, count(DISTINCT l_returnflag) AS n_l_returnflag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1 OR count(DISTINCT l_returnflag) > 1")
def cell_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cell_conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey", "l_returnflag")


@query("""
    SELECT o_orderkey, 'PRICE' AS code, '' AS message FROM orders WHERE NOT coalesce(o_totalprice BETWEEN 1000 AND 400000, false)
    UNION ALL SELECT o_orderkey, 'STATUS', o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)
    UNION ALL SELECT o_orderkey, 'PRIORITY', '' FROM orders WHERE NOT coalesce(regexp_matches(o_orderpriority, '^[1-3]'), false)""")
def dq_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rules = [Q.rule(~c("o_totalprice").between(1000, 400000), "PRICE"), Q.rule(~c("o_orderstatus").isin("F", "O"), "STATUS", c("o_orderstatus")), Q.rule(~c("o_orderpriority").rlike("^[1-3]"), "PRIORITY")]
    return Q.check_rows(table(spark, sf_dir, "orders"), "o_orderkey", rules)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def dq_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.orphans(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT count(DISTINCT nullif(o_orderstatus, '')) AS versions, count(*) FILTER (coalesce(trim(o_orderstatus), '') = '') AS blank, count(DISTINCT nullif(o_orderstatus, '')) = 1 AND count(*) FILTER (coalesce(trim(o_orderstatus), '') = '') = 0 AS ok FROM orders")
def distinct_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.one_version(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("""
    WITH r AS (SELECT sha256('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}') AS d FROM part),
    g AS (SELECT left(d, 4) AS k, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM r GROUP BY ALL)
    SELECT sum(n)::BIGINT AS rows, sha256(string_agg(k || d, chr(10) ORDER BY k)) AS identity FROM g""")
def dataset_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.identity(table(spark, sf_dir, "part"), "p_partkey", "p_name").withColumnRenamed("n", "rows")


@query("SELECT n_nationkey, ('0x' || left(sha256('20260101|' || n_name || '|' || n_regionkey || '|fan'), 8))::BIGINT AS seed FROM nation")
def mix_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", L.mix_seed(F.lit(20260101), F.col("n_name"), F.col("n_regionkey").cast("string"), F.lit("fan")).alias("seed"))


@query("SELECT n_nationkey, (('0x' || left(sha256(n_nationkey || '|noise-offset'), 16))::HUGEINT % 480001)::BIGINT AS at FROM nation")
def noise_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", L.noise_offset(F.col("n_nationkey"), F.lit(480000)).alias("at"))


@query("""
    WITH r AS (SELECT event_id, event_id % 8 AS kind, event_id % 61 AS a, event_id % 37 AS b, event_id % 53 AS size FROM events),
    s AS (SELECT *, CASE WHEN kind IN (0, 6) THEN 200 WHEN size = 0 THEN 416 WHEN kind = 1 AND a < size AND b >= a THEN 206 WHEN kind = 2 AND a < size THEN 206 WHEN kind = 3 AND b > 0 THEN 206 ELSE 416 END AS status FROM r)
    SELECT event_id, status::INTEGER AS status, CASE WHEN status = 200 THEN 0 WHEN status = 206 THEN CASE WHEN kind = 3 THEN greatest(size - b, 0) ELSE a END END::BIGINT AS first,
        CASE WHEN status = 200 THEN greatest(size - 1, 0) WHEN status = 206 THEN CASE WHEN kind = 1 THEN least(b, size - 1) ELSE size - 1 END END::BIGINT AS last FROM s""")
def range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    a, b = (n % 61).cast("string"), (n % 37).cast("string")
    forms = [F.lit(None).cast("string"), F.concat(F.lit("bytes="), a, F.lit("-"), b), F.concat(F.lit("bytes="), a, F.lit("-")), F.concat(F.lit("bytes=-"), b), F.lit("bytes=-"), F.lit("items=0-1"), F.lit(""), F.lit("bytes=1-2,4-5")]
    header = F.array(*forms)[(n % 8).cast("int")]
    return table(spark, sf_dir, "events").select("event_id", L.byte_range(header, n % 53).alias("r")).select("event_id", "r.*")


# --- sessions


@query("""
    WITH r AS (SELECT *, row_number() OVER w AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
    SELECT conv_id, turn, text FROM r WHERE n <= 4 AND before < 300""")
def recent_turns_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recent(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", turns_kept=4, budget=300)


@query(r"""
    WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
    o AS (SELECT *, CASE WHEN regexp_matches(text, '决定|结论|承诺|下一步|行动项|负责人|截止|风险|问题|阻塞|指标|结果|完成|未完成|需要核实') THEN 2 WHEN regexp_matches(text, '[?？]') THEN 1 ELSE 0 END AS priority FROM r WHERE n > 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY priority DESC, turn DESC) AS k FROM o)
    SELECT conv_id, turn, priority, left(""" + redacted(CLEANED.format("text")) + """, 180) AS point FROM k WHERE k <= 2""")
def rolling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(table(spark, sf_dir, "conversations"), "conv_id", "turn", turns_kept=3, points=2)


TERMS = "list_distinct(list_filter(" + TOKENS + ", lambda x: length(x) >= 2 OR regexp_matches(x, '[a-zA-Z0-9]')))"
#: A session's agenda, by words of the tables: section, point, title, text.
PLAN = [
    (0, 0, "the thing of the", "the thing and that of the reed"), (0, 1, "the thing of the", "on the and with thes"), (0, 2, "the thing of the", "in that for are"),
    (1, 0, "la eau et le", "la eau de les sur par"), (1, 1, "la eau et le", "et en le tion"), (1, 2, "la eau et le", "pour dans est que"),
    (2, 0, "der die und", "der die und das ver mit"), (2, 1, "der die und", "que los de la el"), (2, 2, "der die und", "nicht eine der für"),
]
COVER = f"""
    t AS (SELECT conv_id, turn, {TERMS.format("text")} AS said FROM conversations), p AS (SELECT section, point, {TERMS.format("text")} AS wanted FROM {values(PLAN, "section, point, title, text")}),
    m AS (SELECT conv_id, turn, section, point, len(list_intersect(said, wanted)) AS n, least(len(said), len(wanted)) AS low FROM t, p),
    s AS (SELECT *, CASE WHEN low > 0 THEN n / low ELSE 0.0 END AS score, CASE WHEN low > 0 THEN n ELSE 0 END AS overlap FROM m)"""


@query(f"WITH {COVER} SELECT conv_id, turn, section, point, round(score, 6) AS score, overlap FROM s")
def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.match_terms(F.col("text")).alias("said"))
    p = _points(spark).select("section", "point", T.match_terms(F.col("text")).alias("wanted"))
    score, overlap = T.coverage(F.col("wanted"), F.col("said"))
    return t.crossJoin(F.broadcast(p)).select("conv_id", "turn", "section", "point", F.round(score, 6).alias("score"), overlap.cast("long").alias("overlap"))


def _points(spark: SparkSession) -> DataFrame:
    """A fixed agenda of three sections, as a session has."""
    return literal(spark, PLAN, "section long, point long, title string, text string")


@query(f"""
    WITH {COVER},
    b AS (SELECT *, max(struct_pack(score, overlap)) OVER (PARTITION BY conv_id, section, point ORDER BY turn ROWS 2 PRECEDING) AS m2 FROM s)
    SELECT conv_id, turn, section, point, round(m2.score, 6) AS score, m2.overlap AS overlap, max(CASE WHEN m2.overlap >= 2 AND m2.score >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, section, point ORDER BY turn) = 1 AS covered FROM b""")
def agenda_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.point_coverage(table(spark, sf_dir, "conversations"), _points(spark), "conv_id", "turn", least_overlap=2, least_score=0.1)
    return out.withColumn("score", F.round("score", 6)).withColumn("overlap", F.col("overlap").cast("long"))


@query()
def agenda_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, points = table(spark, sf_dir, "conversations"), _points(spark)
    sections = points.where("point = 0").select("section", "title")
    covered = S.point_coverage(turns, points, "conv_id", "turn", least_overlap=2, least_score=0.1)
    state = S.progress(S.section_strength(turns, sections, covered, "conv_id", "turn"), "conv_id", "turn")
    return S.projection(state, covered.where("covered").select("conv_id", "section", "point").distinct(), sections, points, "conv_id")


# --- signals

SAMPLES = "list_transform(embedding, lambda x: x::DOUBLE * 2)"


@query(f"""
    WITH e AS (SELECT vec_id, {SAMPLES} AS x FROM embeddings), r AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms FROM e)
    SELECT vec_id, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS peak, round(rms, 6) AS rms, CASE WHEN rms > 0 THEN round(20 * log10(rms), 6) END AS rms_dbfs,
        round(len(list_filter(x, lambda v: abs(v) >= 0.6)) / len(x), 6) AS clipped, round(len(list_filter(x, lambda v: abs(v) <= 0.05)) / len(x), 6) AS silent FROM r""")
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform(G.doubles(F.col("embedding")), lambda v: v * 2)
    out = table(spark, sf_dir, "embeddings").select("vec_id", G.levels(x, clip=0.6, silence=0.05).alias("l")).select("vec_id", "l.*")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("peak", "rms", "rms_dbfs", "clipped", "silent")])


PAIRS = "p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", G.doubles(F.col("embedding")).alias("e"))
    return e.where("vec_id % 2 = 0").withColumnRenamed("e", "x").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("y")), "vec_id")


@query(f"""
    WITH {PAIRS}, m AS (SELECT vec_id, list_transform(list_zip(x, y), lambda v: 3 * (0.25 * v[1] + 0.75 * v[2])) AS z FROM p), k AS (SELECT vec_id, z, list_max(list_transform(z, lambda v: abs(v))) AS top FROM m)
    SELECT vec_id, list_transform(z, lambda v: round(CASE WHEN top > 0.99 THEN v * (0.99 / top) ELSE v END, 6)) AS mixed FROM k""")
def dry_wet_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = lambda c: F.transform(c, lambda v: v * 3)
    return _pairs(spark, sf_dir).select("vec_id", F.transform(G.dry_wet(loud(F.col("x")), loud(F.col("y")), 0.75), lambda v: G.rounded(v, 6)).alias("mixed"))


@query(f"""
    WITH {PAIRS}, i AS (SELECT vec_id, list_transform(x, lambda v: round_even(v * 30000, 0)) AS x, list_transform(y, lambda v: round_even(v * 30000, 0)) AS y FROM p),
    c AS (SELECT vec_id, list_transform(x, lambda v: v - list_sum(x) / len(x)) AS x, list_transform(y, lambda v: v - list_sum(y) / len(y)) AS y FROM i),
    w AS (SELECT *, sqrt((list_sum(list_transform(x, lambda v: v * v)) / len(x)) / ((list_sum(list_transform(y, lambda v: v * v)) / len(y)) * pow(10, -0.5))) AS alpha FROM c),
    m AS (SELECT vec_id, alpha, list_transform(list_zip(x, y), lambda v: v[1] + alpha * v[2]) AS z FROM w), k AS (SELECT *, list_max(list_transform(z, lambda v: abs(v))) / 32768 AS top FROM m)
    SELECT vec_id, round(alpha, 6) AS alpha, round(CASE WHEN top <= 0.98 THEN 1.0 ELSE 0.98 / top END, 6) AS gain FROM k""")
def snr_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcm = lambda c: F.transform(c, lambda v: F.rint(v * 30000))
    out = _pairs(spark, sf_dir).select("vec_id", G.snr_mix(pcm(F.col("x")), pcm(F.col("y")), -5.0).alias("m"))
    return out.select("vec_id", F.round("m.alpha", 6).alias("alpha"), F.round("m.gain", 6).alias("gain"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round_even(least(greatest(x::DOUBLE * 4, -1), 1) * 32767, 0)::INTEGER) AS pcm FROM embeddings")
def pcm16_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", G.pcm16(F.transform(G.doubles(F.col("embedding")), lambda v: v * 4)).alias("pcm"))


@query("""
    WITH f AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE label IS NOT NULL),
    n AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id, k) - 1 AS pos FROM f), b AS (SELECT label, pos // 48 AS block, list(v ORDER BY pos) AS s FROM n GROUP BY label, pos // 48)
    SELECT label, block, len(s) AS n, round(list_sum(s), 6) AS total, round(s[1], 6) AS first FROM b WHERE len(s) = 48""")
def frame_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("label", "vec_id", G.doubles(F.col("embedding")).alias("x"))
    out = B.reblock(e, "label", "vec_id", "x", 48)
    return out.select("label", "block", F.size("samples").cast("long").alias("n"), F.round(G.total(F.col("samples")), 6).alias("total"), F.round(F.col("samples")[0], 6).alias("first"))


@query("""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
    SELECT vec_id, list_transform(range(0, 32), lambda i: round(x[floor(i * 63 / 31)::INT + 1] + (x[least(floor(i * 63 / 31)::INT + 2, 64)] - x[floor(i * 63 / 31)::INT + 1]) * (i * 63 / 31 - floor(i * 63 / 31)), 6)) AS y FROM e""")
def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(G.resample(F.col("embedding"), 2, 1), lambda v: G.rounded(v, 6)).alias("y"))


@query("SELECT vec_id, 1 + (64 - 16) // 12 AS frames, round(list_sum(embedding[37:52]::DOUBLE[]), 6) AS fourth FROM embeddings")
def sliding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = G.frames(F.col("embedding"), 16, 12)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(f).cast("long").alias("frames"), F.round(G.total(f[3]), 6).alias("fourth"))


@query()
def stft_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.spectrogram(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32, 16)


@query("""
    WITH r AS (SELECT user_id, value::DOUBLE AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
    SELECT user_id, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS most, round(avg(v) / 0.016, 4) AS realtime FROM r WHERE n <= 4096 GROUP BY user_id""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.latency(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return out.select("user_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "most")], F.round("realtime", 4).alias("realtime"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, value::DOUBLE / 500 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    g(user_id, k, event_id, gain) AS (
        SELECT user_id, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM e GROUP BY user_id
        UNION ALL SELECT e.user_id, e.k, e.event_id, g.gain + (1 - exp(-(1 / 16000.0::DOUBLE) / (CASE WHEN abs(e.v) < pow(10, -48 / 20.0::DOUBLE) THEN 40.0 WHEN least(greatest(0.1 / greatest(abs(e.v), 1e-8), pow(10, -6 / 20.0::DOUBLE)), pow(10, 12 / 20.0::DOUBLE)) < g.gain THEN 40.0 ELSE 350.0 END / 1000.0::DOUBLE)))
            * (CASE WHEN abs(e.v) < pow(10, -48 / 20.0::DOUBLE) THEN least(g.gain, 1.0) ELSE least(greatest(0.1 / greatest(abs(e.v), 1e-8), pow(10, -6 / 20.0::DOUBLE)), pow(10, 12 / 20.0::DOUBLE)) END - g.gain) FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)
    SELECT user_id, event_id, round(gain, 6) AS gain FROM g WHERE k > 0""")
def gain_leveler(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.array(F.col("value").cast("double") / 500).alias("x"))
    return G.level_stream(e, "user_id", "event_id", "x").select("user_id", "event_id", F.round("gain", 6).alias("gain"))


# --- streams

FIRES = "WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS s, event_type = 'purchase' AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT user_id, ts, min(event_type) AS event_type FROM events GROUP BY ALL))"


@query(f"""{FIRES}, f(user_id, k, s, last, trigger) AS (
        SELECT user_id, 0::BIGINT, NULL::DOUBLE, '-infinity'::DOUBLE, NULL::VARCHAR FROM e GROUP BY user_id
        UNION ALL SELECT e.user_id, e.k, e.s, CASE WHEN e.q OR e.s - f.last >= 54000 THEN e.s ELSE f.last END, CASE WHEN e.q THEN 'question' WHEN e.s - f.last >= 54000 THEN 'next_line' END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, round(s, 3) AS s, trigger FROM f WHERE trigger IS NOT NULL""")
def advice_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_type").alias("event_type"))
    e = e.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"), (F.col("event_type") == "purchase").alias("q"))
    return B.rate_limit(e, "user_id", "s", "q", 15 * 3600.0).withColumn("s", F.round("s", 3))


JOB = "CASE event_type WHEN 'purchase' THEN 'manual_answer' WHEN 'click' THEN 'question' WHEN 'view' THEN 'manual_next' ELSE 'next_line' END"


@query(f"""
    WITH j AS (SELECT event_id // 7 AS slot, event_id, {JOB} AS trigger FROM events), p AS (SELECT *, CASE trigger WHEN 'manual_answer' THEN 100 WHEN 'question' THEN 95 WHEN 'manual_next' THEN 90 ELSE 20 END AS pr FROM j)
    SELECT slot, event_id, trigger FROM p QUALIFY row_number() OVER (PARTITION BY slot ORDER BY pr DESC, event_id DESC) = 1""")
def priority_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    job = F.when(t == "purchase", "manual_answer").when(t == "click", "question").when(t == "view", "manual_next").otherwise("next_line")
    return B.priority_slot(table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 7).alias("slot"), "event_id", job.alias("trigger")), "slot", "event_id")


@query("""
    WITH e AS (SELECT event_id, user_id, event_type, event_id % 3 > 0 AS is_final FROM events)
    SELECT event_id, is_final FROM e QUALIFY NOT is_final OR row_number() OVER (PARTITION BY is_final, user_id, event_type ORDER BY event_id) = 1""")
def final_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 3 > 0).alias("is_final"))
    return B.drop_repeated_finals(e, "event_id", "user_id", "event_type").select("event_id", "is_final")


@query("""
    SELECT user_id, CASE WHEN arg_max(event_id % 3 > 0, event_id) THEN '' ELSE arg_max(event_type, event_id) END AS partial, count(*) FILTER (event_id % 3 > 0) AS finals FROM events GROUP BY user_id""")
def latest_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("text"), (F.col("event_id") % 3 > 0).alias("is_final"))
    return B.latest_partial(e, "user_id", "event_id")


@query("""
    WITH b AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS h, event_type, value::DOUBLE AS value FROM events), w AS (SELECT h - k AS h, event_type, value FROM b, (VALUES (0), (1)) v(k))
    SELECT to_timestamp(h * 3600)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def hopping_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.hopping_counts(table(spark, sf_dir, "events"), "ts", "2 hours", "1 hour", "event_type", value="value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
    WITH v AS (SELECT user_id, count(*) AS now FROM events GROUP BY user_id), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events)
    SELECT r.* FROM r JOIN v USING (user_id) WHERE now - version BETWEEN 0 AND 2""")
def stale_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    results = e.withColumn("version", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return B.keep_current(results, e.groupBy("user_id").agg(F.count("*").alias("now")), "user_id", "version", 2)


@query("""
    WITH o AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o)
    SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.utterances(table(spark, sf_dir, "events"), "ts", "user_id", "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'view' AS take, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    q(user_id, k, event_id, queue, item, fate) AS (
        SELECT user_id, 0::BIGINT, NULL::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::VARCHAR FROM e GROUP BY user_id
        UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.take THEN q.queue[2:] WHEN len(q.queue) < 3 THEN list_append(q.queue, e.event_id) ELSE list_append(q.queue[2:], e.event_id) END,
            CASE WHEN e.take OR len(q.queue) >= 3 THEN q.queue[1] END, CASE WHEN e.take AND len(q.queue) > 0 THEN 'taken' WHEN e.take THEN 'underrun' WHEN len(q.queue) >= 3 THEN 'dropped' END FROM q JOIN e ON e.user_id = q.user_id AND e.k = q.k + 1)
    SELECT user_id, event_id, item, fate FROM q WHERE fate IS NOT NULL""")
def queue_drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", "take").otherwise("put").alias("op"), F.col("event_id").alias("item"))
    return B.bounded_queue(e, "user_id", "event_id", 3, "drop_oldest")


BLOCKS = "e AS (SELECT user_id, event_id, value::DOUBLE AS v, event_type = 'error' AS bad, event_type = 'purchase' AS mark FROM events)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.array(F.col("value").cast("double")).alias("x"), (t == "error").alias("bad"), (t == "purchase").alias("mark"))


@query(f"WITH {BLOCKS} SELECT user_id, event_id, CASE WHEN bool_or(mark) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0.0 ELSE v END AS v FROM e")
def fault_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.isolate(_blocks(spark, sf_dir), "user_id", "event_id", "x", "mark").select("user_id", "event_id", (F.col("x")[0] + 0.0).alias("v"))


@query(f"""
    WITH {BLOCKS}, n AS (SELECT *, sum(mark::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM e), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY event_id) - 1 AS place FROM n)
    SELECT user_id, event_id, epoch::BIGINT AS epoch, place::BIGINT AS place, CASE WHEN place < 3 THEN 0.0 ELSE v END AS v FROM p""")
def resync_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.resync(_blocks(spark, sf_dir), "user_id", "event_id", "x", "mark")
    return out.select("user_id", "event_id", "epoch", F.col("place").cast("long").alias("place"), (F.col("x")[0] + 0.0).alias("v"))


@query("""
    WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS x, len(embedding) AS n, sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id) AS t FROM embeddings WHERE label IS NOT NULL),
    o AS (SELECT *, round_even(t * 3 / 7, 0)::INT AS total, (round_even(t * 3 / 7, 0) - round_even((t - n) * 3 / 7, 0))::INT AS k FROM e)
    SELECT label, vec_id, total, k, round(x[1], 6) AS first, round(x[n], 6) AS last FROM o""")
def streamed_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("label", "vec_id", G.doubles(F.col("embedding")).alias("x"))
    out = B.resample_stream(e, "label", "vec_id", "x", 7, 3)
    return out.select("label", "vec_id", "total", F.size("x").alias("k"), F.round(F.col("x")[0], 6).alias("first"), F.round(F.element_at("x", -1), 6).alias("last"))


QUEUED = """
    WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'view' AS take, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    q(user_id, k, event_id, queue, due, gone, item, fate) AS (
        SELECT user_id, 0::BIGINT, NULL::BIGINT, []::BIGINT[], false, []::BIGINT[], NULL::BIGINT, NULL::VARCHAR FROM e GROUP BY user_id
        UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.take AND q.due THEN [-1]::BIGINT[] WHEN e.take THEN q.queue[2:] WHEN len(q.queue) < 3 THEN list_append(q.queue, e.event_id) ELSE q.queue END,
            CASE WHEN e.take THEN false ELSE q.due OR len(q.queue) >= 3 END, CASE WHEN e.take AND q.due THEN q.queue ELSE []::BIGINT[] END,
            CASE WHEN e.take AND q.due THEN -1 WHEN e.take THEN q.queue[1] WHEN len(q.queue) >= 3 THEN e.event_id END,
            CASE WHEN e.take AND (q.due OR q.queue[1] = -1) THEN 'silence' WHEN e.take AND len(q.queue) > 0 THEN 'taken' WHEN e.take THEN 'underrun' WHEN len(q.queue) >= 3 THEN 'dropped' END
        FROM q JOIN e ON e.user_id = q.user_id AND e.k = q.k + 1),
    f AS (SELECT user_id, event_id, nullif(item, -1) AS item, fate FROM q WHERE fate IS NOT NULL UNION ALL SELECT user_id, event_id, nullif(unnest(gone), -1), 'drained' FROM q)"""


@query(f"{QUEUED} SELECT user_id, event_id, item, fate FROM f")
def queue_drop_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", "take").otherwise("put").alias("op"), F.col("event_id").alias("item"))
    return B.bounded_queue(e, "user_id", "event_id", 3, "drop_new", prefill=2, resync_on_drop=True)


@query("""
    WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN event_id // 64 END AS now, CASE WHEN event_type <> 'purchase' THEN event_id // 64 - event_id % 3 END AS version FROM events),
    s AS (SELECT *, last_value(now IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM e)
    SELECT user_id, event_id, version FROM s WHERE since - version BETWEEN 0 AND 1""")
def current_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = F.col("event_type") == "purchase"
    at = F.floor(F.col("event_id") / 64)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(sets, at).alias("now"), F.when(~sets, at - F.col("event_id") % 3).alias("version"))
    return B.current_at(e, "user_id", "event_id", most=1).select("user_id", "event_id", "version")


@query("""
    WITH f AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), s AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id, k) - 1 AS pos FROM f),
    c AS (SELECT label, vec_id, len(embedding) AS n, sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id) AS t FROM embeddings),
    o AS (SELECT label, vec_id, t, unnest(range(round_even((t - n) * 3 / 7, 0)::BIGINT, round_even(t * 3 / 7, 0)::BIGINT)) AS k FROM c), p AS (SELECT *, (k + 0.5::DOUBLE) * 7 / 3 - 1 AS p FROM o),
    y AS (SELECT p.*, a.v + (coalesce(b.v, a.v) - a.v) * (p.p - floor(p.p)) AS y FROM p JOIN s a ON a.label IS NOT DISTINCT FROM p.label AND a.pos = greatest(floor(p.p), 0) LEFT JOIN s b ON b.label IS NOT DISTINCT FROM p.label AND b.pos = floor(p.p) + 1)
    SELECT label, vec_id, round_even(any_value(t) * 3 / 7, 0)::BIGINT AS total, count(*) AS n, round(sum(y), 6) AS sum, round(arg_min(y, k), 6) AS first, round(arg_max(y, k), 6) AS last FROM y GROUP BY label, vec_id""")
def carried_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", G.doubles(F.col("embedding")).alias("x"))
    out = B.resample_carried(e, "label", "vec_id", "x", 7, 3)
    return out.select("label", "vec_id", "total", F.size("x").cast("long").alias("n"), F.round(G.total(F.col("x")), 6).alias("sum"), F.round(F.col("x")[0], 6).alias("first"), F.round(F.element_at("x", -1), 6).alias("last"))


# --- meetings: knowledge, maps, requests


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("corpus/"), "source", F.lit("/"), F.format_string("%08d", "doc_id"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))


@query("""
    WITH f AS (SELECT sha256(text) AS sha256, min(printf('%08d', doc_id) || '.txt') AS any_name, min(struct_pack(p := 'corpus/' || source || '/' || printf('%08d', doc_id) || '.txt', n := printf('%08d', doc_id) || '.txt')) AS f FROM documents GROUP BY ALL)
    SELECT left(sha256, 16) AS document_id, f.n AS name, 'txt' AS kind, sha256 FROM f""")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, _, _ = MT.ingest(_files(spark, sf_dir), max_files=1 << 40)
    return new.select("document_id", "name", "kind", "sha256")


BATCHES = """
    f AS (SELECT doc_id // 16 * 2 + CASE WHEN doc_id % 16 < 5 THEN 0 ELSE 1 END AS session, printf('%08d', doc_id) || CASE WHEN doc_id % 97 = 0 THEN '.bin' ELSE '.txt' END AS name, text, CASE WHEN doc_id % 97 = 0 THEN 'suffix' WHEN coalesce(text, '') = '' THEN 'empty' END AS reason FROM documents),
    u AS (SELECT session, sha256(text) AS sha256, min(name) AS name FROM f WHERE reason IS NULL GROUP BY ALL),
    p AS (SELECT session, 'in/' || name AS path, reason FROM f WHERE reason IS NOT NULL UNION ALL SELECT session, '', 'files' FROM u GROUP BY session HAVING count(*) > 10)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of sessions, five and eleven by turns, each with a knowledge base of its own."""
    d = F.col("doc_id")
    session = F.floor(d / 16) * 2 + F.when(d % 16 < 5, 0).otherwise(1)
    return table(spark, sf_dir, "documents").select(session.alias("session"), F.concat(F.format_string("in/%08d", d), F.when(d % 97 == 0, ".bin").otherwise(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))


@query(f"WITH {BATCHES} SELECT session, left(sha256, 16) AS document_id, name, sha256 FROM u WHERE session NOT IN (SELECT session FROM p)")
def ingest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MT.ingest_all(_batches(spark, sf_dir), "session")[0].select("session", "document_id", "name", "sha256")


@query(f"WITH {BATCHES} SELECT * FROM p")
def ingest_too_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MT.ingest_all(_batches(spark, sf_dir), "session")[2]


@query("""
    SELECT source AS document_id, source AS name, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM documents
    WHERE source <> (SELECT min(source) FROM documents) GROUP BY source""")
def knowledge_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    first = c.agg(F.min("document_id")).first()[0]
    documents, rest = MT.without(c.select("document_id", F.col("document_id").alias("name")).distinct(), c, first)
    return MT.listing(documents, rest)


AGENDA_MAP = ["一、背景：现状；问题；现状", "  ", "zqxj vkwp", "Plan: build; ship", "the thing and that reed", "sur la nder"]
PLANNED = [(0, "一、背景", "现状|问题"), (2, "zqxj vkwp", None), (3, "Plan", "build|ship"), (4, "the thing and that reed", None), (5, "sur la nder", None)]


@query(rf"""
    WITH a AS (SELECT section, title, points AS own FROM {values(PLANNED, "section, title, points")}),
    q AS (SELECT section, lower(title) AS phrase, term, least(count(*), 2) AS w FROM (SELECT section, title, unnest({TOKENS.format("title")}) AS term FROM a WHERE own IS NULL) GROUP BY ALL),
    d AS (SELECT doc_id::VARCHAR AS chunk_id, source AS document_id, CASE WHEN doc_id % 3 = 0 THEN '正文' ELSE 'part ' || doc_id || ' · x' END AS locator, text, {TOKENS.format("text")} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    tf AS (SELECT chunk_id, document_id, length, term, count(*) AS tf FROM (SELECT chunk_id, document_id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sc AS (SELECT section, phrase, chunk_id, document_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(mean, 1.0))) * w ORDER BY term) AS s FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY ALL),
    sb AS (SELECT section, chunk_id, document_id, locator, text, s + CASE WHEN contains(replace(lower(text), 'ß', 'ss'), phrase) THEN 4.0 ELSE 0.0 END AS score FROM sc JOIN d USING (chunk_id, document_id)),
    few AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM sb QUALIFY row_number() OVER (PARTITION BY section, document_id ORDER BY score DESC, chunk_id) <= 3) QUALIFY rank <= 10),
    shown AS (SELECT section, rank, locator, {redacted("text")} AS x FROM few),
    budget AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY section ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM shown),
    r AS (SELECT section, rank, left(x, (8000 - before)::BIGINT) AS x, CASE locator WHEN '正文' THEN 3 ELSE 2 END AS class FROM budget WHERE before < 8000),
    c AS (SELECT section, rank, {CLEANED.format("x")} AS x FROM (SELECT *, min(class) OVER (PARTITION BY section) AS least, row_number() OVER (PARTITION BY section, class ORDER BY rank) AS nth FROM r) WHERE class = least AND nth <= 4 - class),
    l AS (SELECT section, rank, found AS x FROM (SELECT section, rank, list_filter(list_transform(string_split(regexp_replace(x, '([。！？!?；;])\s*', '\1' || chr(1), 'g'), chr(1)), lambda y: left({redacted(CLEANED.format("regexp_replace(y, '^[ >*•\t-]+', '')"))}, 240)), lambda y: length(y) >= 10) AS found FROM c)),
    o AS (SELECT section, rank, text, row_number() OVER (PARTITION BY section, rank ORDER BY place) AS turn FROM (SELECT section, rank, text, min(place) AS place FROM (SELECT section, rank, unnest(x) AS text, generate_subscripts(x, 1) AS place FROM l) GROUP BY ALL)),
    k AS (SELECT * FROM (SELECT section, text, min(struct_pack(a := turn, b := rank)) AS o FROM o GROUP BY section, text) QUALIFY row_number() OVER (PARTITION BY section ORDER BY o) <= 4),
    f AS (SELECT section, string_agg(text, '|' ORDER BY o) AS points FROM k GROUP BY section)
    SELECT section::INTEGER AS section, title, coalesce(own, f.points, title) AS points FROM a LEFT JOIN f USING (section)""")
def meeting_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    locator = F.when(F.col("chunk_id").cast("long") % 3 == 0, "正文").otherwise(F.concat(F.lit("part "), "chunk_id", F.lit(" · x")))
    out = MT.meeting_map(spark, AGENDA_MAP, [], chunks(spark, sf_dir).withColumn("locator", locator))
    return out.select("section", "title", F.array_join("points", "|").alias("points"))


SAID_BY = f"""
    t AS (SELECT conv_id, turn, text, row_number() OVER w AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
    r AS (SELECT conv_id, list(text ORDER BY turn) AS x FROM t WHERE n <= 12 AND before < 3000 GROUP BY conv_id),
    p AS (SELECT conv_id, x, array_to_string([x[-1]] || x[-3:] || ['the thing', 'reed and that'] || ['latency'], chr(10)) AS query FROM r)"""


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return rows.withColumns({"title": F.lit("the thing"), "remaining_points": F.array(F.lit("reed and that")), "next_title": F.lit("end"), "closing_allowed": F.lit(False)})


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return MT.requests(turns, _progress(spark, sf_dir), "conv_id", "turn", "manual_next", ["latency"])


@query(f"WITH {SAID_BY} SELECT conv_id, 'manual_next' AS trigger, len(x)::BIGINT AS n_recent, x[-1] AS latest_text, query, 'continue' AS task FROM p")
def meeting_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("conv_id", "trigger", F.size("recent_turns").cast("long").alias("n_recent"), "latest_text", "query", "task")


@query(f"""
    WITH {SAID_BY},
    q AS (SELECT conv_id, term, least(count(*), 2) AS w FROM (SELECT conv_id, unnest({TOKENS.format("left(" + CLEANED.format("query") + ", 4000)")}) AS term FROM p) GROUP BY ALL),
    d AS (SELECT doc_id::VARCHAR AS chunk_id, source AS document_id, {TOKENS.format("text")} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    tf AS (SELECT chunk_id, document_id, length, term, count(*) AS tf FROM (SELECT chunk_id, document_id, len(t) AS length, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sc AS (SELECT conv_id, chunk_id, document_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(mean, 1.0))) * w ORDER BY term), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, document_id ORDER BY score DESC, chunk_id) AS c FROM sc)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, document_id, score FROM k WHERE c <= 3 QUALIFY rank <= 4""")
def session_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = MT.evidence(_requests(spark, sf_dir), chunks(spark, sf_dir), "conv_id", digits=6)
    return out.select("conv_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "document_id", "score")


# --- what may pass

@query("""SELECT doc_id, '{"audio":{"channels":' || doc_id % 3 || ',"peak_limit":0.99}' || CASE WHEN doc_id % 2 = 0 THEN ',"asr":{"model":"' || lang || '"}' ELSE '' END || '}' AS shown FROM documents""")
def public_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    asr = F.when(n % 2 == 0, F.concat(F.lit(',"asr":{"api_key":"k","model":"'), "lang", F.lit('"}'))).otherwise("")
    given = F.concat(F.lit('{"audio":{"secret":"x","channels":'), (n % 3).cast("string"), F.lit(',"peak_limit":0.99},"keys":{"a":1}'), asr, F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", AD.public_config(given).alias("shown"))


@query("SELECT doc_id, 'attempt=' || doc_id % 9 || CASE WHEN doc_id % 2 = 0 THEN ';recoverable=true' ELSE '' END || CASE doc_id % 3 WHEN 0 THEN ';track=before' WHEN 1 THEN ';track=full' ELSE '' END AS shown FROM documents")
def safe_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    boolean, track = F.when(n % 2 == 0, "true").otherwise('"yes"'), F.array(F.lit(" Before"), F.lit("full"), F.lit("other"))[(n % 3).cast("int")]
    given = F.concat(F.lit('{"Attempt":'), (n % 9).cast("string"), F.lit(',"path":"/home/me","recoverable":'), boolean, F.lit(',"count":"nan","track":"'), track, F.lit('","source":"'), "source", F.lit('"}'))
    m = F.array_sort(F.transform(F.map_entries(AD.safe_details(given)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(m, ";").alias("shown"))


@query("SELECT coalesce(nullif(trim(event_type), ''), 'unknown') AS event_type, count(*) AS n FROM events GROUP BY ALL")
def warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AD.warning_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT doc_id, doc_id % 3 = 0 AS frozen FROM documents")
def frozen_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    files = d.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    use = F.when(F.col("doc_id") % 3 == 0, "main_demo").when(F.col("doc_id") % 3 == 1, "other").otherwise("p1_demo")
    digest = F.when(F.col("doc_id") % 3 == 2, F.lit("")).otherwise(F.upper("sha256"))
    return AD.frozen_demos(files, files.select("path", use.alias("intended_use"), digest.alias("sha256"))).select("doc_id", "frozen")


BITS = [f"CASE event_id // {3**i} % 3 WHEN 0 THEN false WHEN 1 THEN true END" for i in range(4)]


@query(f"WITH e AS (SELECT event_id, {', '.join(f'{x} AS b{i}' for i, x in enumerate(BITS))} FROM events) SELECT event_id, coalesce(b0, false) AND CASE WHEN coalesce(b1, true) THEN coalesce(b3, false) ELSE coalesce(b2, false) END AS may FROM e")
def cache_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = [F.expr(x.replace("//", "div")) for x in BITS]
    return table(spark, sf_dir, "events").select("event_id", AD.may_cache(*bits).alias("may"))


ROLES = ["original_audio", "mixed_audio", "full_audio", "spectrogram_image", "waveform_image"]


@query("""
    WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'success' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'partial' END AS s, event_id % 3 > 0 AS o, event_id % 5 > 0 AS m, event_id % 7 > 0 AS f, event_id % 4 > 0 AS p, event_id % 9 > 0 AS w, event_id % 11 > 0 AS b, event_id % 13 > 0 AS a FROM events),
    k AS (SELECT *, coalesce(s IN ('success', 'partial'), false) AS shown FROM e)
    SELECT event_id, CASE WHEN NOT shown OR NOT (o OR m) THEN 'failed' WHEN NOT (o AND m) THEN 'partial' WHEN s = 'success' AND NOT (p AND w AND b AND a) THEN 'partial' ELSE s END AS status,
        array_to_string(list_filter([CASE WHEN shown AND NOT o THEN 'UI_FILE_DELIVERY_FAILED:original_audio' END, CASE WHEN shown AND NOT m THEN 'UI_FILE_DELIVERY_FAILED:mixed_audio' END, CASE WHEN shown AND NOT f THEN 'UI_FILE_DELIVERY_OPTIONAL:full_audio' END,
            CASE WHEN s = 'success' AND NOT b THEN 'UI_RESULT_INCOMPLETE:transcript_before' END, CASE WHEN s = 'success' AND NOT a THEN 'UI_RESULT_INCOMPLETE:transcript_after' END, CASE WHEN s = 'success' AND NOT p THEN 'UI_RESULT_INCOMPLETE:spectrogram' END, CASE WHEN s = 'success' AND NOT w THEN 'UI_RESULT_INCOMPLETE:waveform' END], lambda x: x IS NOT NULL), '|') AS missing FROM k""")
def presentation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = F.col("event_id"), F.col("event_type")
    state = F.when(t.isin("view", "click"), "success").when(t == "error", "failed").when(t == "purchase", "partial")
    given = F.array_compact(F.array(*[F.when(n % k > 0, F.lit(r)) for r, k in zip(ROLES, (3, 5, 7, 4, 9), strict=True)]))
    args = (state, given, n % 11 > 0, n % 13 > 0)
    return table(spark, sf_dir, "events").select("event_id", AD.presentation(*args).alias("status"), F.array_join(AD.missing_parts(*args), "|").alias("missing"))


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN abs(l_discount - 0.05) > 1e-6 THEN 'STRENGTH' END, CASE WHEN l_quantity < 25 THEN 'RUNTIME' END, CASE WHEN l_returnflag = 'R' THEN 'MODEL' END,
    CASE WHEN l_partkey % 20000 > 9600 OR l_suppkey % 3 = 0 THEN 'LENGTH' END], lambda x: x IS NOT NULL), '|') AS problems FROM lineitem""")
def output_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    model = F.when(c("l_returnflag") == "R", "other").otherwise(" Base ")
    full, mixed = 48000 + c("l_partkey") % 20000, F.when(c("l_suppkey") % 3 > 0, F.lit(48000))
    out = AD.output_problems(c("l_discount"), F.lit(0.05), c("l_quantity") - 25, model, F.lit("base"), F.lit(48000), full, mixed)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(out, "|").alias("problems"))


# --- evidence, media, paths, functions that a caller gives


@query("""
    SELECT doc_id, '{"stage":"' || source || '","Path":"<redacted>","attempt":' || CASE WHEN doc_id % 4 = 0 THEN '"<redacted>"' ELSE (doc_id % 7)::VARCHAR END || ',"retryable":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE '"<redacted>"' END
        || ',"trail":[' || repeat('{"deep":', (doc_id % 6)::INT) || '"<redacted>"' || repeat('}', (doc_id % 6)::INT) || ',' || doc_id || ',null,{"note":"<redacted>","empty":null,"cache":null,"count":' || n_chars || ',"more":[[true]]}]}' AS shown FROM documents""")
def evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    deep = (n % 6).cast("int")
    attempt = F.when(n % 4 == 0, '"many"').otherwise((n % 7).cast("string"))
    tail = F.concat(F.lit(",null,"), F.to_json(F.struct(F.left("text", F.lit(40)).alias("note"))).substr(F.lit(1), F.length(F.to_json(F.struct(F.left("text", F.lit(40)).alias("note")))) - 1), F.lit(',"empty":null,"cache":null,"count":'), F.col("n_chars").cast("string"), F.lit(',"more":[[true]]}]}'))
    given = F.concat(F.lit('{"stage":"'), "source", F.lit('","Path":["/home/me",1],"attempt":'), attempt, F.lit(',"retryable":'), F.when(n % 2 == 0, "true").otherwise("1"), F.lit(',"trail":['), F.repeat(F.lit('{"deep":'), deep), F.to_json(F.array("lang")).substr(2, 4), F.repeat(F.lit("}"), deep), F.lit(","), n.cast("string"), tail)
    return table(spark, sf_dir, "documents").select("doc_id", AD.evidence(given).alias("shown"))


@query("""
    SELECT vec_id, CASE WHEN vec_id % 8 < 4 THEN 'wav' ELSE 'png' END AS kind, CASE vec_id % 8 WHEN 1 THEN 'length' WHEN 2 THEN 'length' WHEN 3 THEN 'format' WHEN 5 THEN 'checksum' WHEN 6 THEN 'chunk' WHEN 7 THEN 'pixels' END AS problem,
        CASE vec_id % 8 WHEN 0 THEN 44 + 2 * len(embedding) WHEN 1 THEN 43 + 2 * len(embedding) WHEN 2 THEN 44 + 2 * len(embedding) WHEN 3 THEN 44 + 2 * len(embedding) END AS bytes FROM embeddings""")
def media_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of the vectors: whole ones, and some cut, with a wrong length, format or checksum, something behind the end, or without pixels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", G.doubles(F.col("embedding")).alias("x"))
    files = K.encode_wav(e.where("vec_id % 8 < 4"), "vec_id", "x").withColumn("kind", F.lit("wav")).unionByName(K.encode_png(e.where("vec_id % 8 >= 4"), "vec_id", "x", 8).withColumn("kind", F.lit("png")))
    c, n = F.col("content"), F.length("content")
    part = lambda a, b: F.substring(c, a, b)
    put = lambda at, byte: F.concat(F.substring(c, F.lit(1), F.lit(at)), F.unhex(F.lit(byte)), F.substring(c, F.lit(at + 2), n))
    k = F.col("vec_id") % 8
    data = F.when(k == 1, F.substring(c, F.lit(1), n - 1)).when(k == 2, put(4, "00")).when(k == 3, put(22, "02")).when(k == 5, put(29, "FF")).when(k == 6, F.concat(c, F.unhex(F.lit("00")))).when(k == 7, F.concat(part(1, 33), F.substring(c, n - 11, F.lit(12)))).otherwise(c)
    out = MD.check_media(files.withColumn("content", data), "vec_id")
    return out.select("vec_id", "kind", "problem", F.when(F.col("kind") == "wav", F.col("bytes")).alias("bytes"))


@query("""
    WITH p AS (SELECT page_id, split_part(split_part(split_part(url, '//', 2), '?', 1), '#', 1) AS path, page_id % 6 AS up FROM pages), w AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
    SELECT page_id, '/' || array_to_string(['site'] || parts, '/') AS full, CASE WHEN up <= len(parts) THEN coalesce(nullif(array_to_string(parts[1:len(parts) - up], '/'), ''), '.') END AS below FROM w""")
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "//([^?#]*)", 1)
    up = F.repeat(F.lit("../"), (F.col("page_id") % 6).cast("int"))
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", P.resolved(F.lit("/site/./a/.."), path).alias("full"), P.in_folder(F.lit("/site"), F.concat(F.lit("site//./"), path, F.lit("/"), up)).alias("below"))


@query("""
    WITH p AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN p_partkey - 1 ELSE p_partkey END AS asset_id, p_partkey % 7 AS s, p_partkey % 5 AS o, p_partkey % 3 AS h, p_partkey AS p FROM part),
    r AS (SELECT *, CASE WHEN s IN (2, 4, 6) THEN 'src/' || p WHEN s = 3 THEN 'src/' || p // 20 * 20 END AS f, CASE o WHEN 2 THEN 'src/' || p WHEN 3 THEN 'raw/' || p // 30 || '.wav' WHEN 4 THEN 'raw/' || p || '.wav' END AS t FROM p)
    SELECT asset_id, 'SOURCE_BLANK' AS code FROM r WHERE s = 0 UNION ALL SELECT asset_id, 'OUTPUT_BLANK' FROM r WHERE o = 0 UNION ALL SELECT asset_id, 'SOURCE_OUTSIDE' FROM r WHERE s IN (1, 5) UNION ALL SELECT asset_id, 'OUTPUT_OUTSIDE' FROM r WHERE o = 1
    UNION ALL SELECT asset_id, 'SAME_PATH' FROM r WHERE f = t UNION ALL SELECT asset_id, 'SOURCE_CHANGED' FROM r WHERE h = 2 UNION ALL SELECT asset_id, 'ASSET_REPEATED' FROM r GROUP BY asset_id HAVING count(*) > 1
    UNION ALL SELECT asset_id, 'SOURCE_REPEATED' FROM (SELECT asset_id, min(asset_id) OVER (PARTITION BY f) AS m FROM r WHERE f IS NOT NULL) WHERE asset_id > m UNION ALL SELECT asset_id, 'OUTPUT_REPEATED' FROM (SELECT asset_id, min(asset_id) OVER (PARTITION BY t) AS m FROM r WHERE t IS NOT NULL) WHERE asset_id > m""")
def conversion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    n = p.cast("string")
    sources = [F.lit(" "), F.concat(F.lit("../x/"), n), F.concat(F.lit("/srv/data/src/"), n), F.concat(F.lit("data/src/"), (F.floor(p / 20) * 20).cast("string")), F.concat(F.lit("./src//a/../"), n), F.concat(F.lit("/srv/database/"), n), F.concat(F.lit("src/"), n)]
    outputs = [F.lit(""), F.concat(F.lit("/tmp/"), n), F.concat(F.lit("src/"), n), F.concat(F.lit("raw/"), F.floor(p / 30).cast("string"), F.lit(".wav")), F.concat(F.lit("raw/../raw/"), n, F.lit(".wav"))]
    now = F.sha2("p_name", 256)
    listed = F.when(p % 3 == 0, "").when(p % 3 == 1, F.upper(now)).otherwise(F.sha2(F.lit("x"), 256))
    ledger = table(spark, sf_dir, "part").select(F.when(p % 50 == 0, p - 1).otherwise(p).alias("asset_id"), F.array(*sources)[(p % 7).cast("int")].alias("source"), F.array(*outputs)[(p % 5).cast("int")].alias("output"), listed.alias("sha256"), now.alias("current_sha256"))
    return Q.conversion_plan(ledger, "/srv/data")


def _loud(samples, labels, gate: float):
    """A detector for the query below: one event where a window gets loud; it fails on windows of just one sample."""
    if len(samples) == 1:
        raise ValueError("too short")
    if max(samples) >= gate:
        yield labels[0], max(samples) / 480, 0.0, len(samples) / 2 - 2


@query("""
    WITH b AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS h, event_type, value::DOUBLE AS v FROM events), w AS (SELECT event_type, h - k AS h, v FROM b, (VALUES (0), (1)) x(k)), g AS (SELECT event_type, h, count(*) AS n, max(v) AS top FROM w GROUP BY ALL)
    SELECT event_type, to_timestamp(h * 3600)::TIMESTAMP AS start, CASE WHEN n > 1 THEN 'loud' END AS label, CASE WHEN n > 1 THEN round(top / 480, 6) END AS score, CASE WHEN n > 1 THEN n / 2 - 2 END AS end_seconds,
        CASE WHEN n = 1 THEN 'raised: ValueError' WHEN top > 480 OR n < 4 THEN 'range' END AS fault FROM g WHERE n = 1 OR top >= 300""")
def detected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.array_sort(F.collect_list(F.col("value").cast("double"))).alias("samples"))
    found = HK.detect(e.select("event_type", F.col("w.start").alias("start"), "samples"), "samples", _loud, ["loud"], gate=300.0)
    return found.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "label", F.round("score", 6).alias("score"), "end_seconds", "fault")


def _counted(row: dict) -> dict | list:
    """A function for the query below, which breaks its contract in every way."""
    n = row["doc_id"] % 7
    if n == 0:
        raise LookupError
    if n == 1:
        return []
    return {"status": "done" if n == 2 else "partial" if n == 3 else "success", "source": row["source"], "share": float("nan") if n == 4 else row["n_chars"]}


@query("""
    WITH d AS (SELECT doc_id, source, n_chars, doc_id % 7 AS n FROM documents)
    SELECT doc_id, CASE n WHEN 3 THEN 'partial' WHEN 5 THEN 'success' WHEN 6 THEN 'success' ELSE 'failed' END AS status, CASE WHEN n IN (3, 5, 6) THEN '{"share":' || n_chars || ',"source":"' || source || '","status":"' || CASE n WHEN 3 THEN 'partial' ELSE 'success' END || '"}' END AS result,
        CASE n WHEN 0 THEN 'raised: LookupError' WHEN 1 THEN 'mapping' WHEN 2 THEN 'status' WHEN 4 THEN 'json' END AS fault FROM d""")
def processed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HK.process(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "source", "n_chars"], _counted)


@query("""
    WITH r AS (SELECT doc_id AS d, n_chars, ['success', 'partial', 'failed', 'success'][doc_id % 4 + 1] AS status FROM documents)
    SELECT 'j' || d AS job_id, coalesce(status <> 'failed' AND d % 23 <> 0 AND d % 11 <> 0 AND d % 13 <> 0 AND n_chars % 5 > 0 AND (status = 'partial' OR (d % 3 <> 0 AND d % 5 <> 0 AND d % 7 <> 0)) AND d % 17 <> 0 AND (d % 19 <> 0 OR status = 'partial'), false) AS ok FROM r""")
def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each document, broken by its number: other folders, missing and empty files, results saved by others."""
    d = F.col("doc_id")
    job = F.concat(F.lit("j"), d.cast("string"))
    own = F.concat(F.lit("o/"), F.when(d % 23 == 0, "x").otherwise("j"), d.cast("string"))
    at = lambda name, folder=own: F.concat(folder, F.lit("/" + name))
    full = F.when(d % 11 == 0, at("f.wav", F.concat(F.lit("o/y"), d.cast("string")))).otherwise(at("f.wav"))
    status = F.array(*map(F.lit, ["success", "partial", "failed", "success"]))[(d % 4).cast("int")]
    paths = {"original_audio_path": at("a.wav"), "full_output_path": full, "mixed_output_path": at("m.wav"), "waveform_path": F.when(d % 3 != 0, at("w.png")), "spectrogram_path": at("s.png")}
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", job.alias("job_id"), status.alias("status"), F.create_map(*[x for k, v in paths.items() for x in (F.lit(k), v)]).alias("paths"))
    results = rows.withColumns({"before": d % 5 != 0, "after": d % 7 != 0, "saved_job_id": F.when(d % 17 == 0, "j").otherwise(F.col("job_id")), "saved_status": F.when(d % 19 == 0, "partial").otherwise(F.col("status"))})
    files = rows.select("doc_id", "n_chars", F.explode("paths").alias("role", "path")).where("path IS NOT NULL AND NOT (role = 'mixed_output_path' AND doc_id % 13 = 0)")
    return AD.cached_ok(results, files.select("path", F.when(F.col("role") == "original_audio_path", F.col("n_chars") % 5).otherwise(1).alias("bytes")))


@query("""
    WITH l AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN p_partkey - 1 ELSE p_partkey END AS q, p_name, p_brand FROM part WHERE p_partkey % 31 <> 0),
    e AS (SELECT p_partkey AS q, sha256(p_name) AS want FROM part WHERE p_partkey % 29 <> 0),
    j AS (SELECT *, CASE WHEN p % 13 = 0 THEN 'blank' WHEN p % 17 = 0 THEN 'out' WHEN p % 19 = 0 THEN 'none' ELSE 'own' END AS src, CASE WHEN p % 23 = 0 THEN 'bad' WHEN p % 43 = 0 THEN 'other' ELSE 'own' END AS ssha, CASE WHEN p % 47 = 0 THEN sha256('x') WHEN p % 53 = 0 THEN '' ELSE sha256(p_name) END AS std FROM l JOIN e USING (q))
    SELECT 'a' || q AS asset_id, 'CONSENT' AS code FROM j WHERE p % 11 = 0 UNION ALL SELECT 'a' || q, 'PATH' FROM j WHERE p % 7 = 0 OR p <> q UNION ALL SELECT 'a' || q, 'SOURCE_BLANK' FROM j WHERE src = 'blank' UNION ALL SELECT 'a' || q, 'SOURCE_OUTSIDE' FROM j WHERE src = 'out'
    UNION ALL SELECT 'a' || q, 'SOURCE_MISSING' FROM j WHERE src = 'none' UNION ALL SELECT 'a' || q, 'SOURCE_DIGEST' FROM j WHERE ssha = 'bad' UNION ALL SELECT 'a' || q, 'STANDARD_DIGEST' FROM j WHERE std = '' UNION ALL SELECT 'a' || q, 'SOURCE_CHANGED' FROM j WHERE src = 'own' AND ssha = 'other'
    UNION ALL SELECT 'a' || q, 'STANDARD_CHANGED' FROM j WHERE std <> '' AND std <> want UNION ALL SELECT '', 'ASSET_BLANK' FROM l WHERE q IS NULL UNION ALL SELECT 'a' || q, 'ASSET_REPEATED' FROM l WHERE q IS NOT NULL GROUP BY q HAVING count(*) > 1
    UNION ALL SELECT 'a' || q, 'ASSET_MISSING' FROM e WHERE q NOT IN (SELECT q FROM l WHERE q IS NOT NULL) UNION ALL SELECT DISTINCT 'a' || q, 'ASSET_UNEXPECTED' FROM l WHERE q NOT IN (SELECT q FROM e)""")
def consent_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    n = p.cast("string")
    a = lambda x: F.concat(F.lit("a"), x.cast("string"))
    part = table(spark, sf_dir, "part")
    ledger = part.where(p % 31 != 0).select(
        F.when(p % 37 == 0, " ").when(p % 41 == 0, a(p - 1)).otherwise(a(p)).alias("asset_id"),
        F.when(p % 13 == 0, "").when(p % 17 == 0, F.concat(F.lit("source_original/../"), n)).when(p % 19 == 0, F.concat(F.lit("/srv/data/source_original/none"), n)).otherwise(F.concat(F.lit("source_original/./"), n, F.lit(".wav"))).alias("source_original_path"),
        F.when(p % 7 == 0, "std/none.wav").when(p % 5 == 0, F.concat(F.lit("./std//x/../"), n, F.lit(".wav"))).otherwise(F.concat(F.lit("std/"), n, F.lit(".wav"))).alias("relative_path"),
        F.when(p % 11 == 0, F.lit(None)).when(p % 3 == 0, " YES").otherwise("yes").alias("consent_status"),
        F.when(p % 23 == 0, "zz").when(p % 43 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.upper(F.sha2("p_brand", 256))).alias("source_original_sha256"),
        F.when(p % 47 == 0, F.sha2(F.lit("x"), 256)).when(p % 53 == 0, "").otherwise(F.sha2("p_name", 256)).alias("standardized_sha256"),
    )
    expected = part.where(p % 29 != 0).select(a(p).alias("asset_id"), F.concat(F.lit("/srv/data/std/"), n, F.lit(".wav")).alias("path"), F.sha2("p_name", 256).alias("sha256"))
    originals = part.select(F.concat(F.lit("source_original/"), n, F.lit(".wav")).alias("path"), F.sha2("p_brand", 256).alias("sha256"))
    return Q.consent_problems(ledger, expected, originals, "/srv/data/")


@query("""
    WITH d AS (SELECT doc_id, 'audio/' || source || '/' || doc_id || '.wav' AS path, CASE WHEN doc_id % 17 <> 0 THEN sha256(text) END AS now, CASE WHEN doc_id % 19 = 0 THEN sha256('x') ELSE sha256(text) END AS listed FROM documents)
    SELECT path, 'NO_RECORD' AS code FROM d WHERE doc_id % 13 = 0 UNION ALL SELECT path, 'NOT_PUBLIC' FROM d WHERE doc_id % 13 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0)
    UNION ALL SELECT path, 'FILE_MISSING' FROM d WHERE doc_id % 13 <> 0 AND now IS NULL UNION ALL SELECT path, 'DIGEST' FROM d WHERE doc_id % 13 <> 0 AND now IS DISTINCT FROM listed AND now IS NOT NULL""")
def licence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, now = F.col("doc_id"), F.sha2("text", 256)
    rows = table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("audio/"), "source", F.lit("/"), d.cast("string"), F.lit(".wav")))
    records = rows.where(d % 13 != 0).select("path", F.when(d % 7 == 0, "no").when(d % 11 != 0, "yes").alias("public"), F.when(d % 19 == 0, F.sha2(F.lit("x"), 256)).otherwise(now).alias("sha256"), d.alias("line"))
    return Q.licence_problems(rows.select("path", F.when(d % 17 != 0, now).alias("sha256")), records)


@query("""
    WITH s AS (SELECT min(source) AS low, max(source) AS high FROM documents), d AS (SELECT doc_id, source, sha256(lang) AS config, sha256(CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE source END) AS checkpoint, low, high FROM documents, s),
    f AS (SELECT doc_id, 'config_sha256' AS field, config AS got, CASE WHEN source <> high THEN sha256('en') END AS want FROM d UNION ALL SELECT doc_id, 'checkpoint_sha256', checkpoint, CASE WHEN source <> high AND source <> low THEN sha256(source) END FROM d)
    SELECT doc_id, field, CASE WHEN want IS NULL THEN 'EXPECTATION_EMPTY' ELSE 'MISMATCH' END AS code FROM f WHERE want IS DISTINCT FROM got OR want IS NULL""")
def model_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are documents and models sources: one model is expected by no checkpoint, one not at all."""
    d = table(spark, sf_dir, "documents")
    runs = d.select("doc_id", "source", F.sha2("lang", 256).alias("config_sha256"), F.sha2(F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("source")), 256).alias("checkpoint_sha256"))
    models = d.groupBy("source").agg(F.lit(1)).crossJoin(F.broadcast(d.agg(F.min("source").alias("low"), F.max("source").alias("high"))))  # one row
    expected = models.where("source <> high").select("source", F.concat(F.lit(" "), F.upper(F.sha2(F.lit("en"), 256))).alias("config_sha256"), F.when(F.col("source") != F.col("low"), F.sha2("source", 256)).otherwise(" ").alias("checkpoint_sha256"))
    return Q.fingerprint_problems(runs, expected, "doc_id", "source", ["config_sha256", "checkpoint_sha256"])


@query("""
    WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL), m AS (SELECT conv_id, map_from_entries(list((turn, text))) AS m FROM t WHERE text IS NOT NULL GROUP BY conv_id)
    SELECT conv_id, sha256(""" + " || ".join(f"'t{i}' || chr(0) || coalesce(m[{i}], '<missing>') || chr(0)" for i in (2, 0, 1, 40)) + """) AS fingerprint FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN m USING (conv_id)""")
def code_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    return L.code_fingerprint(files, "conv_id", ["t2", "t0", "t1", "t40"])
