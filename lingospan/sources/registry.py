"""Known datasets and how to open them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lingospan.schemas import NER_DDL, PAIRS_DDL, PARAPHRASE_DDL
from lingospan.sources.readers import load_first_existing, load_languages

# Public dataset names, their paths, default configurations and tasks.
DATASETS = {
    "xnli": {
        "path": "xnli",
        "config": "all_languages",
        "task": "does one sentence follow from another (three classes)",
    },
    "wikiann": {"path": "wikiann", "config": "en", "task": "names of people, places and organisations, word by word"},
    "paws-x": {
        "path": "google-research-datasets/paws-x",
        "config": "en",
        "task": "do two sentences mean the same (two classes)",
    },
}

SCHEMAS = {"xnli": PAIRS_DDL, "wikiann": NER_DDL, "paws-x": PARAPHRASE_DDL}


@dataclass
class Catalog:
    """Opens registered datasets under one or more base folders, the first existing one winning."""

    spark: SparkSession
    bases: Sequence[str]

    def task(self, name: str) -> str:
        return DATASETS[name]["task"]

    def open(self, name: str, languages: Sequence[str] | None = None) -> DataFrame:
        if name not in DATASETS:
            raise KeyError(f"unknown dataset {name}; known: {sorted(DATASETS)}")
        folders = [f"{base.rstrip('/')}/{name}" for base in self.bases]
        # The folder of the default configuration first, then one that holds all of the dataset.
        paths = [p for folder in folders for p in (f"{folder}/{DATASETS[name]['config']}", folder)]
        df = load_first_existing(self.spark, paths) if languages is None else load_languages(self.spark, paths, languages)
        self._check(name, df)
        return df

    @staticmethod
    def _check(name: str, df: DataFrame) -> None:
        """Raise unless the table has the declared columns; types may be wider, further columns are kept."""
        wanted = set(T.StructType.fromDDL(SCHEMAS[name]).fieldNames())
        if missing := wanted - set(df.columns):
            raise ValueError(f"{name}: columns {sorted(missing)} are missing")

    def register_views(self, names: Sequence[str] | None = None) -> list[str]:
        """Temporary views (``-`` becomes ``_``) over the registered datasets."""
        views = []
        for name in names or list(DATASETS):
            view = name.replace("-", "_")
            self.open(name).createOrReplaceTempView(view)
            views.append(view)
        return views

