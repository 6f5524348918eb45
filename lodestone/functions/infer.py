"""External model stages behind one interface: a stage maps batches of rows, its model is loaded once per worker."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET_TYPES = ("person", "political_party", "government", "administration", "public_institution", "media", "social_group", "international_org", "foreign_country_or_govt", "other", "unclear_or_none")


def run_stage(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], fields: str) -> DataFrame:
    """``df`` with the columns ``fields`` that ``load()(batch)`` returns, in row order; batches are Arrow's."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or load()
            out = model(pdf)
            if len(out) != len(pdf):
                raise ValueError("a stage must return one row per input row")
            yield pd.concat([pdf.reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, schema)


def stub_classifier(text: str, words: Sequence[str] = ("lie", "lying", "liar", "untrue", "half-truths")) -> Callable:
    """A deterministic stand-in: LABEL_1 if a word of the list occurs; its score is of the predicted class, in [0.5, 1), six digits."""

    def load() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def model(pdf: pd.DataFrame) -> pd.DataFrame:
            t = pdf[text].fillna("").str.lower()
            hit = t.map(lambda s: any(w in s for w in words))
            score = t.map(lambda s: round(0.5 + (zlib.crc32(s.encode()) % 499_999) / 1_000_000, 6))
            return pd.DataFrame({"lie_label": hit.map({True: "LABEL_1", False: "LABEL_0"}), "lie_score": score})

        return model

    return load


def stub_translator(text: str) -> Callable:
    def load() -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda pdf: pd.DataFrame({"translated": pdf[text]})

    return load


def validate_targets(df: DataFrame, kind: str = "target_type", text: str = "target_text") -> DataFrame:
    """Unknown types become ``unclear_or_none``, whose text is empty; other texts are cut at 300 characters."""
    k = F.when(F.col(kind).isin(*TARGET_TYPES), F.col(kind)).otherwise("unclear_or_none")
    return df.withColumns({kind: k, text: F.when(k == "unclear_or_none", "").otherwise(F.substring(F.coalesce(text, F.lit("")), 1, 300))})
