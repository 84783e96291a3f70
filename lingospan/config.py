"""Settings shared by the end-to-end jobs, and the session used by tests, bench and examples."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# Language lists and defaults of the evaluation protocol.
EVAL_LANGUAGES = ["en", "de", "zh", "ar", "ru", "hi"]
SPLITS = ["train", "validation", "test"]
PAIR_MAX_LENGTH = 128
TOKEN_SEQUENCE_MAX_LENGTH = 256
BATCH_SIZE = 16
ERRORS_PER_LANGUAGE = 15


@dataclass(frozen=True)
class Config:
    """One run of train -> evaluate -> mine errors."""

    data_dir: str = "data/raw/xnli"
    fallback_dirs: tuple[str, ...] = ()
    checkpoint_dir: str = "checkpoints"
    output_dir: str = "error_analysis"
    source_lang: str = "en"
    eval_langs: list[str] = field(default_factory=lambda: list(EVAL_LANGUAGES))
    train_split: str = "train"
    eval_split: str = "validation"
    max_length: int = PAIR_MAX_LENGTH
    errors_per_language: int = ERRORS_PER_LANGUAGE
    num_features: int = 1 << 14
    max_iter: int = 20


def build_session(app: str = "lingospan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings win unless named in ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # No stack trace per column expression: plans of many expressions build several times faster.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables under the shared folder named in ``spark.checkpoint.dir``.

    A machine-local temporary folder is used only in local mode with the setting absent.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="lingospan-")
    return f"{base.rstrip('/')}/lingospan/{name}-{uuid.uuid4().hex}"
