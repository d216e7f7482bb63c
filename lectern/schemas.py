"""Fixed values of the narration model, and the dimension tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# They must be these for results to agree.
ABBREVIATIONS = ("Dr.", "Doç.", "Prof.", "Sn.", "Bay.", "Bayan.", "örn.", "vb.", "vs.", "bkz.", "No.", "Mad.")
UNKNOWN_TITLE, UNKNOWN_AUTHOR, DEFAULT_LANGUAGE = "Bilinmeyen Kitap", "Bilinmeyen Yazar", "tr"
CHAPTER_PREFIX = "Bolum "
MIN_CHAPTER_CHARS, MIN_CHUNK_CHARS = 20, 80
MIN_ARTIFACT_BYTES, MIN_ARTIFACT_SECONDS = 1024, 0.05
WARMUP_CHUNKS, LOG_EVERY = 10, 25
TARGET_REALTIME, TIE_RATIO = 4.0, 0.03
VRAM_RESERVE_GB, VRAM_WORKER_GB, MAX_WORKERS = 2.0, 2.5, 4
VOICE_MODES, PERFORMANCE_MODES = ("builtin", "clone"), ("optimized", "deepspeed", "compatibility")
MIN_SPEED, MAX_SPEED = 0.7, 1.6
DROPPED = ("script", "style", "nav", "svg", "noscript")
NO_TITLE = "Alt bolumler"
COVER_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")

# Fixed values too.
#: id, chunk limit, needs a reference recording, needs a licence acknowledgement, has built-in speakers
ENGINES = (("trendyol", 760, False, False, False), ("xtts", 220, False, True, True), ("mms", 320, False, True, False))
#: key, bitrate, sample rate
PRESETS = (("low", "32k", 22050), ("standard", "64k", 44100), ("high", "128k", 48000))


def engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENGINES, "engine_id string, max_chars int, needs_reference boolean, needs_licence boolean, has_speakers boolean")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "quality_key string, bitrate string, sample_rate int")
