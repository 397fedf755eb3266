"""Removing personal data from listing rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stallwise import vocab
from stallwise.functions.text import mask


def mask_columns(df: DataFrame, columns: Sequence[str], pattern=vocab.PHONE_PATTERN,
                 replacement=vocab.PHONE_MASK) -> DataFrame:
    return df.withColumns({c: mask(c, pattern, replacement) for c in columns})


def strip_private(df: DataFrame, *, fields=vocab.PRIVATE_FIELDS, features="features",
                  private_features=vocab.PRIVATE_FEATURES, text_feature=vocab.LISTING_TEXT_FEATURE,
                  text_columns=("description",), pattern=vocab.PHONE_PATTERN, replacement=vocab.PHONE_MASK) -> DataFrame:
    """Blank private columns, drop private attributes and mask phone numbers in texts."""
    types = dict(df.dtypes)
    new = {c: F.lit(None).cast(types[c]) for c in fields if c in types}
    new.update({c: mask(c, pattern, replacement) for c in text_columns if c in types})
    if features in types:
        kept = F.map_filter(features, lambda k, v: ~k.isin(*private_features))
        new[features] = F.transform_values(
            kept, lambda k, v: F.when(k == text_feature, mask(v, pattern, replacement)).otherwise(v))
    return df.withColumns(new)
