"""Evaluation tables: manifests, status, grouped summaries, coverage, matrices, blind assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .metrics import direction

STATUSES = ["success", "partial", "failed"]
DIRECTIONS = ["improved", "tied", "worsened", "unavailable"]
#: The noise of each (speaker, sentence), a Latin square; SNRs in dB; sentences of the locked split.
SPEAKERS, SENTENCES, NOISES, SNRS = ["A", "B", "C"], ["S01", "S02", "S03"], ["fan", "keyboard", "traffic"], [5, 0, -5]
#: The noise of each speaker's real take.
REAL = {"A": "traffic", "B": "fan", "C": "keyboard"}
SPLIT_COUNTS = {"dev": 18, "locked_test": 9, "real": 3, "clean_control": 3}
#: Warning codes that make a result partial.
DEGRADERS = ["ASR_BEFORE_FAILED", "ASR_AFTER_FAILED", "ASR_EMPTY", "VIS_FAILED"]


def audio_path(source_type: Column, clean_path: Column, mixed_path: Column) -> Column:
    return F.when(source_type == "clean_control", clean_path).otherwise(mixed_path)


def primary_path(clean_path: Column, mixed_path: Column) -> Column:
    return F.coalesce(F.nullif(mixed_path, F.lit("")), clean_path)


def status(enhanced: Column, mixed: Column, codes: Column, before: Column, after: Column, waveform: Column, spectrogram: Column) -> Column:
    """failed without a mix; partial with a degrading warning or anything missing; else success."""
    weak = F.arrays_overlap(F.coalesce(codes, F.array().cast("array<string>")), F.array(*map(F.lit, DEGRADERS)))
    return F.when(~enhanced | mixed.isNull(), "failed").when(weak | before.isNull() | after.isNull() | waveform.isNull() | spectrogram.isNull(), "partial").otherwise("success")


def input_warnings(original_rate: Column, rate: Column, original_channels: Column, channels: Column, clipped: Column, rms_dbfs: Column, silent: Column, rms_limit: float = -60.0) -> Column:
    """Codes of what an input's levels call for, in this order."""
    rules = [
        (original_rate.isNotNull() & (original_rate != rate), "INPUT_RESAMPLED"),
        (original_channels.isNotNull() & (original_channels != channels), "INPUT_STEREO_DOWNMIXED"),
        (clipped > 0, "INPUT_CLIPPED"),
        (F.coalesce(rms_dbfs <= rms_limit, F.lit(False)) | F.coalesce(silent >= 0.98, F.lit(False)), "INPUT_NEAR_SILENT"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))


def complete_transcript(segments: Column) -> Column:
    """Whether every segment (start, end, text) has a text and doesn't end before it starts."""
    return segments.isNotNull() & F.forall(segments, lambda s: s["text"].isNotNull() & s["start"].isNotNull() & (s["end"] >= s["start"]))


def summary_columns(before: Column, after: Column, state: Column) -> list[Column]:
    """Counts zero-filled over the fixed keys, and exact medians over rows that have both rates."""
    way, paired = direction(before, after), before.isNotNull() & after.isNotNull()
    return [
        F.count("*").alias("n"),
        *[F.count_if(state == s).alias(s) for s in STATUSES],
        *[F.count_if(way == d).alias(d) for d in DIRECTIONS],
        F.count_if(paired).alias("paired"),
        F.median(F.when(paired, before)).alias("before_median"),
        F.median(F.when(paired, after)).alias("after_median"),
    ]


def summarize(records: DataFrame, before: Column, after: Column, state: Column, **groups: Column) -> DataFrame:
    """summary_columns() overall and by each group: (level, key, ...). Blank keys are not_applicable."""
    names = list(groups)
    rows = records.select(before.cast("double").alias("_b"), after.cast("double").alias("_a"), state.alias("_s"), *[F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("not_applicable")).alias(n) for n, c in groups.items()])
    # one aggregation over an entry for each level, so the table is read once
    entries = F.array(F.struct(F.lit("overall").alias("level"), F.lit("").alias("key")), *[F.struct(F.lit(n).alias("level"), F.col(n).alias("key")) for n in names])
    return rows.select("_b", "_a", "_s", F.inline(entries)).groupBy("level", "key").agg(*summary_columns(F.col("_b"), F.col("_a"), F.col("_s")))


def split_counts(rows: DataFrame, split: Column, expected: dict[str, int]) -> DataFrame:
    """(split, n, expected, ok) over what there is and what there should be."""
    spark = rows.sparkSession
    want = spark.createDataFrame(list(expected.items()), "split string, expected long")
    got = rows.groupBy(split.alias("split")).agg(F.count("*").alias("n"))
    out = got.join(want, "split", "full").select("split", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return out.withColumn("ok", F.col("n") == F.col("expected"))


def coverage(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """(key, side): missing are wanted and not there, unexpected the other way round."""
    missing = want.select(key).distinct().join(have.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(have.select(key).distinct().join(want.select(key), key, "left_anti").withColumn("side", F.lit("unexpected")))


def mixes(speakers: DataFrame, sentences: list[str] = SENTENCES, noises: list[str] = NOISES, snrs: list[int] = SNRS, locked: str = "S03") -> DataFrame:
    """(speaker, sentence, noise, snr, split): every speaker (speaker, i from 0) with each sentence at each SNR.

    Noises follow a Latin square: in a row of as many speakers or sentences as there are noises, each occurs once. The
    short lists are unfolded beside the speakers' rows; nothing is joined.
    """
    said = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(x).alias("sentence")) for j, x in enumerate(sentences)])
    rows = speakers.select("speaker", "i", F.inline(said)).select("*", F.explode(F.array(*map(F.lit, snrs))).alias("snr"))
    noise = F.element_at(F.array(*map(F.lit, noises)), ((F.col("i") + F.col("j")) % len(noises) + 1).cast("int"))
    return rows.select("speaker", "sentence", noise.alias("noise"), "snr", F.when(F.col("sentence") == locked, "locked_test").otherwise("dev").alias("split"))


def matrix(spark: SparkSession) -> DataFrame:
    """The 27 mixes of the fixed speakers, sentences and SNRs."""
    return mixes(spark.createDataFrame(list(enumerate(SPEAKERS)), "i int, speaker string"))


def artifacts_of(mixed: DataFrame, real: DataFrame) -> DataFrame:
    """(kind, path, split) of all files that mixes() and real takes (speaker, noise) need: clean takes, noises, mixes, real takes."""
    low = F.lower("sentence")
    snr = F.concat(F.when(F.col("snr") > 0, "snrp").when(F.col("snr") < 0, "snrm").otherwise("snr0"), F.lpad(F.abs("snr").cast("string"), 2, "0"))
    clean = mixed.select("speaker", "sentence").distinct().select(F.lit("clean").alias("kind"), F.concat(F.lit("raw/clean/spk"), "speaker", F.lit("/clean_spk"), "speaker", F.lit("_"), low, F.lit(".wav")).alias("path"), F.lit("").alias("split"))
    noise = mixed.select("noise").distinct().select(F.lit("noise"), F.concat(F.lit("raw/noise/noise_"), "noise", F.lit("_take01.wav")), F.lit(""))
    mix = mixed.select(F.lit("mix"), F.concat(F.lit("controlled/"), "split", F.lit("/mix_spk"), "speaker", F.lit("_"), low, F.lit("_"), "noise", F.lit("_"), snr, F.lit(".wav")), F.col("split"))
    takes = real.select(F.lit("real"), F.concat(F.lit("raw/real/real_spk"), "speaker", F.lit("_"), "noise", F.lit("_r01.wav")), F.lit("real"))
    return clean.union(noise).union(mix).union(takes)


def artifacts(spark: SparkSession) -> DataFrame:
    """artifacts_of() the fixed matrix: all 42 files."""
    return artifacts_of(matrix(spark), spark.createDataFrame(list(REAL.items()), "speaker string, noise string"))


def blind_assignments(pairs: DataFrame, raters: list[str], order: str, phase: int = 0) -> DataFrame:
    """(rater, blind_id, key, a_role, b_role): sides alternate over pairs and raters, so each rater's counts differ by one at most.

    order: the pairs' key. Pairs are numbered over the whole table in two steps: counts of each range partition, then
    places within it, so no task holds all pairs. Raters are a given list, an entry for each of them.
    """
    # a fixed number of partitions, which adaptive execution doesn't merge: both uses see the same ones
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = pairs.select(F.col(order).alias("key")).repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()).select("key", "part")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "before")  # a row for each partition
    numbered = parts.join(F.broadcast(before), "part").withColumn("i", F.row_number().over(W.partitionBy("part").orderBy("key")) + F.col("before"))
    entries = F.array(*[F.struct(F.lit(r).alias("rater"), F.lit(k).alias("r")) for k, r in enumerate(raters)])
    rows = numbered.select("key", "i", F.inline(entries))
    first = (F.col("i") - 1 + F.col("r") + phase) % 2 == 0
    return rows.select("rater", F.format_string("T%03d", F.col("i")).alias("blind_id"), "key", F.when(first, "original").otherwise("enhanced").alias("a_role"), F.when(first, "enhanced").otherwise("original").alias("b_role"))


def balance(assigned: DataFrame) -> DataFrame:
    """(rater, original_a, enhanced_a, ok) of blind assignments."""
    out = assigned.groupBy("rater").agg(F.count_if(F.col("a_role") == "original").alias("original_a"), F.count_if(F.col("a_role") == "enhanced").alias("enhanced_a"))
    return out.withColumn("ok", F.abs(F.col("original_a") - F.col("enhanced_a")) <= 1)


def latest_checkpoint(files: DataFrame, path: str = "path") -> DataFrame:
    """The checkpoint of the highest epoch in its name, one marked best before others."""
    epoch = F.regexp_extract(path, r"(?:epoch|model)[_-]?(\d+)", 1).try_cast("int")
    rows = files.select(F.col(path).alias("path"), epoch.alias("epoch"), F.col(path).rlike(r"\.best$").cast("int").alias("best")).where("epoch IS NOT NULL")
    return rows.agg(F.max_by("path", F.struct("best", "epoch")).alias("path"))
