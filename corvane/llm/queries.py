"""The registered queries of this subpackage, with production parameters, over whole tables; and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chats, spelling
from .decontaminate import contaminated
from .embeddings import near_duplicates as near_vectors
from .html_text import extract
from .lines import drop_repeated_lines
from .mixing import schedule
from .negatives import mine
from .packing import pack
from .pii import digest, find
from .repeats import remove_repeats
from .simhash import near_duplicates
from .tables import table
from .toxicity import toxicity


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), length=2048)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, bits=4, seed=42)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"), seed=17, budget_share=1.0, entropy=0.95, repetition=4.0)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"), width=3)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation beside the table's: control strings in both texts.
MARKED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame(MARKED, "conv_id long, turn long, role string, text string"))
    return chats.digest(chats.render(chats.messages(chats.log_of(rows))))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least=6, occurrences=5, divisor=199, factor=5)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.withColumn("label", label), F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=10, low=30, high=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_substring": op2_substring,
    "op3_pii": op3_pii,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_lines": op7_lines,
    "op8_html": op8_html,
    "op9_embeddings": op9_embeddings,
    "op10_toxicity": op10_toxicity,
    "op11_chats": op11_chats,
    "op12_spelling": op12_spelling,
    "op13_negatives": op13_negatives,
}

ORACLES: dict[str, str] = {
    "op2_substring": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        win AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
        firsts AS (SELECT s, min(struct_pack(d := doc_id, p := p)) AS f FROM win GROUP BY s HAVING count(*) > 1),
        late AS (SELECT win.doc_id, win.p FROM win JOIN firsts USING (s) WHERE struct_pack(d := win.doc_id, p := win.p) > f),
        gone AS (SELECT DISTINCT doc_id, p + k AS q FROM late, range(0, 20) t(k)),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
        agg AS (
            SELECT words.doc_id, count(gone.q) AS r, coalesce(string_agg(word, ' ' ORDER BY words.q) FILTER (gone.q IS NULL), '') AS kept
            FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.q = words.q GROUP BY words.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id
    """,
    "op7_lines": r"""
        WITH d AS (SELECT doc_id, coalesce(string_split(text, chr(10)), []) AS w FROM documents),
        win AS (SELECT doc_id, p, array_to_string(w[p:p + 2], chr(10)) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
        firsts AS (SELECT s, min(struct_pack(d := doc_id, p := p)) AS f FROM win GROUP BY s HAVING count(*) > 1),
        late AS (SELECT win.doc_id, win.p FROM win JOIN firsts USING (s) WHERE struct_pack(d := win.doc_id, p := win.p) > f),
        gone AS (SELECT DISTINCT doc_id, p + k AS q FROM late, range(0, 3) t(k)),
        lines AS (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) AS q FROM d),
        agg AS (
            SELECT lines.doc_id, count(gone.q) AS r, coalesce(string_agg(line, chr(10) ORDER BY lines.q) FILTER (gone.q IS NULL), '') AS kept
            FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.q = lines.q GROUP BY lines.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN agg ON agg.doc_id = d.doc_id
    """,
    "op11_chats": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>))', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS body FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op13_negatives": r"""
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score QUALIFY rank <= 10
    """,
}
