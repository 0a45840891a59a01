"""What may pass: allow-listed configurations and warning details, cached results, presentation, output contracts."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of evidence that name places (by a part of the key), and those whose texts, booleans or numbers may be shown.
PLACES = ["path", "dir", "cache", "file", "url", "uri"]
SHOWN_TEXTS = ["code", "component", "exception_type", "module", "stage", "status"]
SHOWN_BOOLEANS = ["recoverable", "retryable"]
SHOWN_NUMBERS = ["attempt", "attempts", "count", "exit_code", "run_index"]
#: What a shown text may not hold, how long it may be, and what stands for what is hidden.
TELLING, MAX_SHOWN, HIDDEN = ["://", "\\", "/", "token=", "cache", "outputs"], 80, "<redacted>"
#: The fields of a configuration that may be shown, by section, with their types.
PUBLIC = {
    "audio": "target_sample_rate int, channels int, pcm_subtype string, min_duration_seconds double, max_duration_seconds double, peak_limit double",
    "enhancement": "backend string, model string, checkpoint_sha256 string, config_sha256 string, default_strength double, strengths map<string,double>, default_playback_track string, default_asr_after_track string",
    "asr": "backend string, model string, checkpoint_sha256 string, language string, task string, device string, temperature double, condition_on_previous_text boolean, initial_prompt string, fp16_on_cuda boolean",
    "comparison": "loudness_dsp_matching boolean, same_player_volume boolean, report_rms_dbfs boolean, report_peak_abs boolean",
}
#: Details of a warning that may be shown: numbers, booleans, names of tracks and roles.
NUMBERS = "attempt attempts count runs sample_rate channels duration_seconds runtime_seconds total_seconds strength peak_abs rms_dbfs clipped_ratio silent_ratio".split()
BOOLEANS = "recoverable required cache_hit cold_start".split()
NAMES = {"track": ["before", "after", "original", "mixed", "full"], "role": ["original", "mixed", "full", "spectrogram", "waveform", "transcript_before", "transcript_after"]}
#: Uses of a demo file that allow its result to be cached.
DEMO_USES = ["development_only", "main_demo", "boundary_demo", "p1_demo"]
#: What a result must deliver, and what it may.
REQUIRED, PICTURES = ["original_audio", "mixed_audio"], ["spectrogram_image", "waveform_image"]


def public_config(x: Column, allowed: dict[str, str] = PUBLIC) -> Column:
    """JSON text of a configuration with only the allowed fields; null fields and unknown sections are left out."""
    schema = ", ".join(f"{section}: struct<{', '.join(': '.join(f.split(' ', 1)) for f in fields.split(', '))}>" for section, fields in allowed.items())
    return F.to_json(F.from_json(x, f"struct<{schema}>"))


def safe_details(x: Column) -> Column:
    """map<string,string> of a warning's details (JSON object text): known keys in lower case, with values of their kind."""
    raw = F.transform_keys(F.from_json(x, "map<string,string>"), lambda k, _: F.lower(F.trim(k)))
    number = lambda v: F.when(~v.isin("true", "false"), v.try_cast("double"))

    def value(k: Column, v: Column) -> Column:
        low = F.lower(F.trim(v))
        out = F.when(k.isin(BOOLEANS) & v.isin("true", "false"), v)
        n = number(v)
        out = out.when(k.isin(NUMBERS) & n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string")))
        for name, names in NAMES.items():
            out = out.when((k == name) & low.isin(names), low)
        return out

    return F.map_filter(F.transform_values(F.coalesce(raw, F.create_map().cast("map<string,string>")), value), lambda _, v: v.isNotNull())


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def _may_show(key: str, x: Any) -> bool:
    """Whether the value of a known key is of the kind that the key shows."""
    if key in SHOWN_TEXTS:
        return isinstance(x, str) and len(x) <= MAX_SHOWN and not any(t in x.lower() for t in TELLING) and all(c.isascii() and (c.isalnum() or c in "._:-") for c in x)
    return isinstance(x, bool) if key in SHOWN_BOOLEANS else _is_number(x)


def hide(x: Any, key: str | None = None) -> Any:
    """A value of parsed JSON, at any depth, with what may not be shown hidden. key: the key under which it stands in an object, if any."""
    low = None if key is None else key.lower()
    if x is None:
        return None
    if low is not None and any(p in low for p in PLACES):
        return HIDDEN
    if low in (*SHOWN_TEXTS, *SHOWN_BOOLEANS, *SHOWN_NUMBERS):
        return x if _may_show(low, x) else HIDDEN
    if isinstance(x, dict):
        return {k: hide(v, k) for k, v in x.items()}
    if isinstance(x, list):
        return [hide(v) for v in x]
    return x if key is None and (isinstance(x, bool) or _is_number(x)) else HIDDEN


def evidence(x: Column) -> Column:
    """JSON text of evidence with what may not be shown hidden, at any depth; null for what is no JSON.

    Values under keys that name places go, whatever they are; known keys show texts, booleans or numbers of their kind;
    objects and lists are gone through; bare numbers and booleans in lists stay; nulls stay; all else is hidden.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(hide(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return None

        return texts.map(one, na_action="ignore")

    return run(x)


def warning_counts(warnings: DataFrame, code: str = "code") -> DataFrame:
    """(code, n) of warnings, by code; blank ones are unknown."""
    return warnings.groupBy(F.coalesce(F.nullif(F.trim(code), F.lit("")), F.lit("unknown")).alias(code)).agg(F.count("*").alias("n")).orderBy(code)


def frozen_demos(files: DataFrame, demos: DataFrame) -> DataFrame:
    """files (path, sha256) with frozen: whether a demo of an allowed use has the path and the digest."""
    known = demos.where(F.col("intended_use").isin(DEMO_USES) & (F.coalesce("sha256", F.lit("")) != "")).groupBy("path").agg(F.collect_set(F.lower("sha256")).alias("_d"))
    return files.join(known, "path", "left").withColumn("frozen", F.coalesce(F.array_contains("_d", F.lower("sha256")), F.lit(False))).drop("_d")


def may_cache(enabled: Column, demo_only: Column, allow_user_audio: Column, frozen: Column) -> Column:
    """Whether a result may be cached: of a frozen demo, or, where demos aren't all, by a consent of its own."""
    no = lambda c, other: F.coalesce(c, F.lit(other))
    return no(enabled, False) & F.when(no(demo_only, True), no(frozen, False)).otherwise(no(allow_user_audio, False))


def presentation(status: Column, delivered: Column, before: Column, after: Column) -> Column:
    """A result's status as it is shown, never better than it is: delivered: roles that were; before, after: whether transcripts are complete."""
    has = lambda r: F.array_contains(delivered, r)
    n = sum(has(r).cast("int") for r in REQUIRED)
    whole = before & after & has(PICTURES[0]) & has(PICTURES[1])
    kept = F.when(n == 0, "failed").when(n < len(REQUIRED), "partial").when((status == "success") & ~whole, "partial").otherwise(status)
    return F.when(F.coalesce(status, F.lit("")).isin("success", "partial"), kept).otherwise("failed")


def missing_parts(status: Column, delivered: Column, before: Column, after: Column) -> Column:
    """Codes with roles of what a shown result lacks, in order: required files, the full track, then transcripts and pictures of a success."""
    lacks = lambda r: ~F.array_contains(delivered, r)
    shown = F.coalesce(status, F.lit("")).isin("success", "partial")
    rules = [(shown & lacks(r), f"UI_FILE_DELIVERY_FAILED:{r}") for r in REQUIRED] + [(shown & lacks("full_audio"), "UI_FILE_DELIVERY_OPTIONAL:full_audio")]
    rules += [((status == "success") & ~c, f"UI_RESULT_INCOMPLETE:{r}") for r, c in (("transcript_before", before), ("transcript_after", after))]
    rules += [((status == "success") & lacks(r), f"UI_RESULT_INCOMPLETE:{r.removesuffix('_image')}") for r in PICTURES]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))


def output_problems(strength: Column, wanted: Column, runtime: Column, model: Column, model_wanted: Column, frames: Column, full_frames: Column, mixed_frames: Column, rate: int = 48_000) -> Column:
    """Codes of what an enhancement's output breaks: another strength, a runtime that is none, another model, lengths more than 0.2 s off."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    near = lambda x: F.abs(x - frames) <= int(rate * 0.2)
    rules = [
        (bad((F.abs(strength - wanted) <= 1e-6) & ~F.isnan(strength)), "STRENGTH"),
        (bad((runtime >= 0) & ~F.isnan(runtime) & (runtime < float("inf"))), "RUNTIME"),
        (bad(F.lower(F.trim(model)) == F.lower(F.trim(model_wanted))), "MODEL"),
        (bad(near(full_frames) & near(mixed_frames)), "LENGTH"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in rules]))


def cached_ok(results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(job_id, ok): whether a cached result may be used. results: job_id, status, paths (map of role to path), before, after, saved_job_id, saved_status; artifacts: path, bytes.

    A result that isn't failed has its audio, in one folder named like the job; every path that it names is a file with
    something in it; a success has both pictures and both transcripts; and the result saved beside is the same job's, of
    the same status.
    """
    p = F.col("paths")
    audio = ["original_audio_path", "full_output_path", "mixed_output_path"]
    pictures = ["waveform_path", "spectrogram_path"]
    named = results.select("job_id", F.explode(F.map_values(F.map_filter("paths", lambda _, v: v.isNotNull()))).alias("path"))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    there = named.join(artifacts.select("path", "bytes"), "path", "left").groupBy("job_id").agg(F.bool_and(F.coalesce(F.col("bytes") > 0, F.lit(False))).alias("all_there"), F.collect_set(F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).alias("parents"), F.min(folder).alias("folder"))
    has = lambda names: F.forall(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at(p, n), F.lit("")) != "")
    success = F.col("status") == "success"
    ok = F.col("status").isin("success", "partial") & has(audio) & F.col("all_there") & (F.size("parents") == 1) & (F.col("folder") == F.col("job_id"))
    ok = ok & (~success | (has(pictures) & F.col("before") & F.col("after"))) & F.col("saved_job_id").eqNullSafe(F.col("job_id")) & F.col("saved_status").eqNullSafe(F.col("status"))
    return results.join(there, "job_id", "left").select("job_id", F.coalesce(ok, F.lit(False)).alias("ok"))
