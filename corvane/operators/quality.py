"""Data-quality rules: codes for each row, set-level checks, duplicates, joins against measurements and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import paths as P
from ..functions.lineage import is_digest
from ..functions.text import truthy

ISSUE = "array<struct<code:string,message:string>>"


def rule(bad: Column, code: str, message: str | Column = "") -> Column:
    """An issue where bad holds; unknown counts as bad."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(code).alias("code"), text.alias("message")))


def check_rows(rows: DataFrame, key: str, rules: list[Column]) -> DataFrame:
    """(key, code, message): all rules in one pass over the rows, no shuffle."""
    return rows.select(F.col(key), F.inline(F.array_compact(F.array(*rules)).cast(ISSUE)))


def duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, first): rows whose key an earlier row has, and where that is. The first is a grouped minimum, so a key's rows aren't gathered."""
    first = rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.select(key, order).join(first, key).where(F.col(order) > F.col("first"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cell_conflicts(rows: DataFrame, cell: list[str], *values: str) -> DataFrame:
    """Cells whose rows don't agree on a value."""
    out = rows.groupBy(*cell).agg(*[F.count_distinct(v).alias(f"n_{v}") for v in values])
    return out.where(" OR ".join(f"n_{v} > 1" for v in values))


def one_version(rows: DataFrame, column: str) -> DataFrame:
    """One row: the distinct non-empty versions, how many rows have none, ok if there is exactly one and none lacks it."""
    blank = F.coalesce(F.trim(column), F.lit("")) == ""
    out = rows.agg(F.count_distinct(F.when(~blank, F.col(column))).alias("versions"), F.count_if(blank).alias("blank"))
    return out.withColumn("ok", (F.col("versions") == 1) & (F.col("blank") == 0))


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key no parent has."""
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def match_measured(manifest: DataFrame, measured: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(sample_id, code): manifest rows (sample_id, path, sample_rate, channels, duration_seconds) against measurements by path."""
    m = measured.select("path", F.col("sample_rate").alias("r"), F.col("channels").alias("c"), F.col("duration_seconds").alias("d"))
    joined = manifest.join(m, "path", "left")
    slack = F.greatest(F.lit(tolerance), 1 / F.col("r"))
    known = F.col("r").isNotNull()
    wrong = (F.col("sample_rate") != F.col("r")) | (F.col("channels") != F.col("c")) | (F.abs(F.col("duration_seconds") - F.col("d")) > slack)
    return check_rows(joined, "sample_id", [rule(~known, "MANIFEST_UNREADABLE"), rule(known & F.coalesce(wrong, known), "MANIFEST_AUDIO_META")])


def match_expected(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows with the artifact of their sample_id, or else of their path: by (kind, found_by)."""
    by_id = expected.select(F.col("sample_id"), F.col("kind").alias("k1")).dropDuplicates(["sample_id"])
    by_path = expected.select(F.col("path"), F.col("kind").alias("k2")).dropDuplicates(["path"])
    out = rows.join(by_id, "sample_id", "left").join(by_path, "path", "left")
    found_by = F.when(F.col("k1").isNotNull(), "sample_id").when(F.col("k2").isNotNull(), "path").otherwise("none")
    return out.withColumn("kind", F.coalesce("k1", "k2")).withColumn("found_by", found_by).drop("k1", "k2")


#: Required columns and what a manifest's cells may hold.
CONSENTS = ["self_recorded", "licensed"]
SOURCE_TYPES = ["controlled_mix", "clean_control", "real"]


def manifest_issues(rows: DataFrame) -> DataFrame:
    """(sample_id, code, message) of a manifest's rows, cell by cell; set-level codes come from manifest_set_issues()."""
    c = F.col
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    number = lambda x: c(x).try_cast("double")
    mix = c("source_type") == "controlled_mix"
    rules = [
        rule(blank("sample_id") | blank("split") | blank("source_type"), "MANIFEST_REQUIRED"),
        rule(blank("consent_or_license"), "MANIFEST_CONSENT"),
        rule(c("clean_path").startswith("/") | c("clean_path").contains("..") | c("mixed_path").startswith("/") | c("mixed_path").contains(".."), "MANIFEST_PATH"),
        rule(blank(F.coalesce(F.nullif("mixed_path", F.lit("")), c("clean_path"))), "MANIFEST_PRIMARY_PATH"),
        rule(F.regexp_extract(F.coalesce(F.nullif("mixed_path", F.lit("")), c("clean_path")), r"([^/]+)\.wav$", 1) != c("sample_id"), "MANIFEST_SAMPLE_ID"),
        rule(~is_digest(c("sha256")), "MANIFEST_HASH"),
        rule((number("sample_rate") != 48000) | (number("channels") != 1), "MANIFEST_AUDIO_META"),
        rule(~c("source_type").isin(SOURCE_TYPES), "MANIFEST_SEMANTICS"),
        rule(truthy(c("is_locked")).isNull() | truthy(c("is_demo_candidate")).isNull(), "MANIFEST_BOOLEAN"),
        rule(truthy(c("is_locked")).isNotNull() & (truthy(c("is_locked")) != (c("split") == "locked_test")), "MANIFEST_LOCKED"),
        rule((c("split") == "locked_test") & F.coalesce(truthy(c("is_demo_candidate")), F.lit(False)), "MANIFEST_DEMO_CANDIDATE"),
        rule(F.when(mix, blank("clean_path") | blank("noise_path") | blank("mixed_path")).otherwise(~blank("noise_path")), "MANIFEST_PATH_SEMANTICS"),
        rule(F.when(mix, (number("noise_offset_seconds") < 0) | (number("mix_alpha") <= 0) | ~((number("final_gain") > 0) & (number("final_gain") <= 1))).otherwise(False), "MANIFEST_MIX_META"),
        rule(F.when(mix, ~number("snr_db").isin(5.0, 0.0, -5.0)).otherwise(~blank("snr_db")), "MANIFEST_SNR"),
    ]
    return check_rows(rows, "sample_id", rules)


def manifest_set_issues(rows: DataFrame, expected_rows: int = 33) -> DataFrame:
    """(sample_id, code, message) that need more than one row: duplicate ids and paths, versions, cells, the number of rows."""
    path = F.coalesce(F.nullif("mixed_path", F.lit("")), F.col("clean_path"))
    out = []
    for code, key in (("MANIFEST_DUPLICATE_ID", F.col("sample_id")), ("MANIFEST_DUPLICATE_PATH", path)):
        out.append(rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min("sample_id").alias("sample_id")).where("n > 1").select("sample_id", F.lit(code).alias("code"), F.concat_ws(" ", F.lit("rows:"), F.col("n").cast("string")).alias("message")))
    version = one_version(rows, "dataset_version").where("NOT ok").select(F.lit("").alias("sample_id"), F.lit("MANIFEST_VERSION").alias("code"), F.col("versions").cast("string").alias("message"))
    count = rows.agg(F.count("*").alias("n")).where(F.col("n") != expected_rows).select(F.lit("").alias("sample_id"), F.lit("MANIFEST_ROW_COUNT").alias("code"), F.col("n").cast("string").alias("message"))
    cells = cell_conflicts(rows.where("source_type = 'controlled_mix'"), ["speaker_id", "sentence_id"], "mix_seed", "noise_offset_seconds").select(F.concat_ws("/", "speaker_id", "sentence_id").alias("sample_id"), F.lit("MANIFEST_MIX_CELL").alias("code"), F.lit("").alias("message"))
    for part in (version, count, cells):
        out.append(part)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def wav_issues(measured: DataFrame) -> DataFrame:
    """(path, code, message) of measured files (path, kind, sample_rate, channels, bits, duration_seconds, peak, rms_dbfs, clipped, truncated)."""
    c, full = F.col, 32767 / 32768
    rules = [
        rule(c("sample_rate") != 48000, "WAV_SAMPLE_RATE"),
        rule(c("channels") != 1, "WAV_CHANNELS"),
        rule(c("bits") != 16, "WAV_BIT_DEPTH"),
        rule(F.when(c("kind") == "noise", ~c("duration_seconds").between(45, 60)).otherwise(~c("duration_seconds").between(1, 60)), "WAV_DURATION"),
        rule(c("truncated"), "WAV_TRUNCATED"),
        rule(c("peak") == 0, "WAV_SILENT"),
        rule((c("peak") > 0) & (c("rms_dbfs") < -60.0), "WAV_NEAR_SILENT"),
        rule(c("peak") >= full, "WAV_CLIPPED"),
        rule((c("kind") == "mix") & (c("peak") > 0.981), "WAV_MIX_PEAK"),
        rule((c("kind") == "clean") & (c("peak") > 10 ** (-3 / 20)) & (c("peak") < full), "WAV_CLEAN_PEAK_HIGH", "warning"),
    ]
    return check_rows(measured, "path", rules)


def report(issues: DataFrame, expected: int, checked: DataFrame) -> DataFrame:
    """One row: files expected, checked, issues, ok."""
    n = checked.agg(F.count("*").alias("checked"))
    e = issues.agg(F.count_if(F.col("message") != "warning").alias("errors"), F.count_if(F.col("message") == "warning").alias("warnings"))
    return n.crossJoin(e).select(F.lit(expected).cast("long").alias("expected"), "checked", "errors", "warnings", ((F.col("checked") == expected) & (F.col("errors") == 0)).alias("ok"))


def preview(codes: Column, most: int = 5) -> Column:
    """The first codes of an array, and how many more there are."""
    more = F.size(codes) - most
    return F.concat(F.array_join(F.slice(codes, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))


def latest_by(rows: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The newest rows of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= keep).drop("_n")


def conversion_plan(ledger: DataFrame, folder: str) -> DataFrame:
    """(asset_id, code) of what keeps a ledger (asset_id, source, output, sha256, current_sha256) from being converted below folder.

    Blank assets, sources and outputs, paths that leave the folder, a source that is its output, assets, sources and
    outputs that repeat (all but the first by asset_id; assets all), and sources that changed since they were listed.
    """
    c, top = F.col, F.lit(folder)
    rows = ledger.select("asset_id", F.trim(F.coalesce("source", F.lit(""))).alias("source"), F.trim(F.coalesce("output", F.lit(""))).alias("output"), F.lower(F.trim(F.coalesce("sha256", F.lit("")))).alias("listed"), F.lower(F.coalesce("current_sha256", F.lit(""))).alias("now"))
    rows = rows.withColumn("from", P.in_folder(top, c("source"))).withColumn("to", P.in_folder(top, c("output")))
    rules = [
        rule((c("source") == ""), "SOURCE_BLANK"),
        rule((c("output") == ""), "OUTPUT_BLANK"),
        rule((c("source") != "") & c("from").isNull(), "SOURCE_OUTSIDE"),
        rule((c("output") != "") & c("to").isNull(), "OUTPUT_OUTSIDE"),
        rule(F.coalesce(c("from") == c("to"), F.lit(False)), "SAME_PATH"),
        rule((c("listed") != "") & (c("listed") != c("now")), "SOURCE_CHANGED"),
    ]
    own = check_rows(rows, "asset_id", rules).select("asset_id", "code")
    again = rows.groupBy("asset_id").agg(F.count("*").alias("n")).where("n > 1").select("asset_id", F.lit("ASSET_REPEATED").alias("code"))
    for path, code in (("from", "SOURCE_REPEATED"), ("to", "OUTPUT_REPEATED")):
        placed = rows.where(c(path).isNotNull()).select("asset_id", path)
        again = again.unionByName(duplicates(placed, path, "asset_id").select("asset_id", F.lit(code).alias("code")))
    return own.unionByName(again)


def consent_problems(ledger: DataFrame, expected: DataFrame, originals: DataFrame, root: str, masters: str = "source_original") -> DataFrame:
    """(asset_id, code) of all that keeps a consent ledger from covering the expected assets exactly.

    ledger: asset_id, source_original_path, relative_path, consent_status, source_original_sha256, standardized_sha256;
    expected: asset_id, path, sha256 (of the standardised file); originals: path, sha256. Paths are absolute, or start in
    root. Codes: ASSET_BLANK, ASSET_REPEATED, ASSET_MISSING, ASSET_UNEXPECTED; of rows that meet an asset CONSENT, PATH,
    SOURCE_BLANK, SOURCE_OUTSIDE (of the masters' folder), SOURCE_MISSING, SOURCE_DIGEST and STANDARD_DIGEST (none),
    SOURCE_CHANGED, STANDARD_CHANGED. A null is blank; a repeated id is reported once and its rows are judged each.
    An expected id or an original's path that is listed twice counts by its least path and digest. No rows, no problems
    but what is missing.
    """
    c = F.col
    text = lambda x: F.trim(F.coalesce(x, F.lit("")))
    top = P.normal(F.lit(root))
    absolute = lambda x: P.resolved(top, x)
    names = ["source_original_path", "relative_path", "consent_status", "source_original_sha256", "standardized_sha256"]
    rows = ledger.select(text(c("asset_id")).alias("asset_id"), *[text(c(n)).alias(n) for n in names])
    known = rows.where("asset_id <> ''")
    want = expected.groupBy("asset_id").agg(F.min(F.struct(absolute(c("path")).alias("path"), F.lower("sha256").alias("sha256"))).alias("want"))
    there = originals.groupBy(absolute(c("path")).alias("original")).agg(F.min(F.lower("sha256")).alias("original_sha256"))
    code = lambda d, name: d.select("asset_id", F.lit(name).alias("code"))
    joined = known.withColumn("original", F.when(c("source_original_path") != "", absolute(c("source_original_path")))).join(want, "asset_id").join(there, "original", "left")
    folder = P.normal(F.concat(top, F.lit("/" + masters)))
    inside = P.within(folder, c("original"))
    source, standard = F.lower("source_original_sha256"), F.lower("standardized_sha256")
    found = inside & c("original_sha256").isNotNull()
    rules = [
        rule(F.lower("consent_status") != "yes", "CONSENT"),
        rule(absolute(c("relative_path")) != c("want.path"), "PATH"),
        rule(c("source_original_path") == "", "SOURCE_BLANK"),
        rule(F.coalesce(~inside, F.lit(False)), "SOURCE_OUTSIDE"),
        rule(F.coalesce(inside & c("original_sha256").isNull(), F.lit(False)), "SOURCE_MISSING"),
        rule(~is_digest(source), "SOURCE_DIGEST"),
        rule(~is_digest(standard), "STANDARD_DIGEST"),
        rule(F.coalesce(found & is_digest(source) & (source != c("original_sha256")), F.lit(False)), "SOURCE_CHANGED"),
        rule(is_digest(standard) & ~standard.eqNullSafe(c("want.sha256")), "STANDARD_CHANGED"),
    ]
    out = check_rows(joined, "asset_id", rules).select("asset_id", "code")
    for part in (
        code(rows.where("asset_id = ''"), "ASSET_BLANK"),
        code(repeated(known, "asset_id"), "ASSET_REPEATED"),
        code(want.join(known, "asset_id", "left_anti"), "ASSET_MISSING"),
        code(known.select("asset_id").distinct().join(want, "asset_id", "left_anti"), "ASSET_UNEXPECTED"),
    ):
        out = out.unionByName(part)
    return out


def licence_problems(tracked: DataFrame, records: DataFrame) -> DataFrame:
    """(path, code): tracked files (path, sha256: null if the file is gone) against licence records (path, public, sha256) of exactly the same path.

    NO_RECORD ends the matter; else NOT_PUBLIC (anything but yes), FILE_MISSING, DIGEST. Of records that share a path the
    last in order (line) counts, as in a mapping.
    """
    c = F.col
    last = records.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct("public", "sha256"), "line").alias("record"))
    joined = tracked.select("path", c("sha256").alias("now")).join(last, "path", "left")
    has = c("record").isNotNull()
    rules = [
        rule(~has, "NO_RECORD"),
        rule(has & ~c("record.public").eqNullSafe("yes"), "NOT_PUBLIC"),
        rule(has & c("now").isNull(), "FILE_MISSING"),
        rule(has & c("now").isNotNull() & ~c("record.sha256").eqNullSafe(c("now")), "DIGEST"),
    ]
    return check_rows(joined, "path", rules).select("path", "code")


def fingerprint_problems(actual: DataFrame, expected: DataFrame, row: str, key: str, digests: list[str]) -> DataFrame:
    """(row, field, code): digests that runs (row, key) have against those expected for the key; whatever isn't known to agree fails.

    EXPECTATION_EMPTY where none is given (a key without any expectation too), else MISMATCH. Case and white space around
    don't count; a null is empty. One row of expectations for each key; runs are judged each.
    """
    said = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    # one model may have most runs, so runs meet their expectation in so many slices
    sliced = actual.withColumn("_slice", F.pmod(F.xxhash64(row), F.lit(64)).cast("int"))
    want = expected.select(key, F.struct(*digests).alias("want"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_slice"))
    joined = sliced.join(want, [key, "_slice"], "left")
    one = lambda f: F.when(said(F.col(f"want.{f}")) == "", "EXPECTATION_EMPTY").when(said(F.col(f"want.{f}")) != said(F.col(f)), "MISMATCH")
    found = F.array(*[F.struct(F.lit(f).alias("field"), one(f).alias("code")) for f in digests])
    return joined.select(row, F.inline(found)).where("code IS NOT NULL")
