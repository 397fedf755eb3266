"""Addresses: splitting, normalising and sound-alike street keys."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from stallwise import vocab
from stallwise.functions.text import strip, strip_marks


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _parts(address: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: strip(p))
    return F.filter(trimmed, lambda p: p != "")


def split_parts(parts: Column) -> tuple[Column, Column]:
    """(street, house) of the trimmed, non-empty parts of an address."""
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    before = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    has_house = (F.size(parts) >= 2) & last.rlike("(?U)" + vocab.HOUSE_PATTERN)
    tail = "(?U)" + vocab.STREET_AND_HOUSE
    tailed = last.rlike(tail)
    street = (F.when(has_house, before).when(tailed, F.regexp_extract(last, tail, 1)).otherwise(last))
    house = (F.when(has_house, last).when(tailed, F.regexp_extract(last, tail, 2)).otherwise(F.lit("")))
    return F.regexp_replace(street, vocab.SECTOR_PREFIX, ""), house


def split_address(address) -> tuple[Column, Column]:
    """(street, house): a numeric last part is the house, else the trailing token of the last part."""
    return split_parts(_parts(_c(address)))


def address_parts(address) -> Column:
    return _parts(_c(address))


def apartment(address) -> Column:
    return F.nullif(F.regexp_extract(_c(address), vocab.APARTMENT_PATTERN, 1), F.lit(""))


def norm_house(house) -> Column:
    packed = F.regexp_replace(F.lower(F.coalesce(_c(house), F.lit(""))), r"\s+", "")
    return F.translate(packed, *vocab.HOUSE_LETTERS)


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _sounds(word: Column) -> Column:
    cyrillic = F.translate(_replaced(word, vocab.CYRILLIC_SOUNDS), *vocab.CYRILLIC_LETTERS)
    latin = _replaced(strip_marks(F.translate(word, *vocab.LATIN_MARKED)), vocab.LATIN_SOUNDS)
    spoken = F.when(word.rlike("[а-яё]"), cyrillic).otherwise(latin)
    return F.regexp_replace(F.regexp_replace(spoken, f"[{vocab.VOWELS}]", ""), r"(.)\1+", "$1")


def street_key(street) -> Column:
    """Consonant key of a street name, equal for Latin and Cyrillic spellings of the same sounds."""
    text = strip(F.translate(F.lower(F.coalesce(_c(street), F.lit(""))), ".,", "  "))
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: ~w.isin(*vocab.STREET_WORDS))
    return F.array_join(F.transform(words, _sounds), "")


def contained(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def edit_similarity(a, b) -> Column:
    """Native score of two street keys: containment 1, else 1 - edit distance / longer length."""
    a, b = _c(a), _c(b)
    longer = F.greatest(F.length(a), F.length(b))
    return (F.when((a == "") | (b == ""), F.lit(0.0)).when(contained(a, b), F.lit(1.0))
            .otherwise(1.0 - F.try_divide(F.levenshtein(a, b).cast("double"), longer)))


def _codes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, padded to one width with 0, and their lengths."""
    wide = np.array(texts, dtype=np.str_)
    size = np.char.str_len(wide)
    return wide.view(np.uint32).reshape(len(wide), -1), size


def _longest_blocks(a, b, lo_a, hi_a, lo_b, hi_b):
    """Start in a, start in b and length of the longest equal run within each pair's ranges, the earliest in a, then in b."""
    n, width = len(a), b.shape[1]
    place = np.arange(width)
    inside = (place >= lo_b[:, None]) & (place < hi_b[:, None])
    run = np.zeros((n, width + 1), np.int32)  # equal characters up to the one before
    size, start_a, start_b = (np.zeros(n, np.int32) for _ in range(3))
    for i in range(int(hi_a.max(initial=0))):
        equal = inside & (a[:, i: i + 1] == b) & ((lo_a <= i) & (i < hi_a))[:, None]
        run[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        j = run.argmax(axis=1)
        k = run[np.arange(n), j]
        better = k > size
        size[better], start_a[better], start_b[better] = k[better], i + 1 - k[better], j[better] - k[better]
    return start_a, start_b, size


def matching_ratio(first: pd.Series, second: pd.Series) -> np.ndarray:
    """Twice the characters in matching blocks over all characters, for many pairs at once.

    The longest common run of a pair is a block; what lies left and what lies right of it in both texts are two
    new pairs. All open pairs of a round are searched together.
    """
    (a, size_a), (b, size_b) = _codes(first), _codes(second)
    matched = np.zeros(len(a), np.int64)
    pair, lo_a, hi_a, lo_b, hi_b = np.arange(len(a)), np.zeros(len(a), np.int64), size_a, np.zeros(len(a), np.int64), size_b
    while len(pair):
        at_a, at_b, k = _longest_blocks(a[pair], b[pair], lo_a, hi_a, lo_b, hi_b)
        np.add.at(matched, pair, k)
        sides = [np.concatenate(x) for x in ((pair, pair), (lo_a, at_a + k), (at_a, hi_a), (lo_b, at_b + k), (at_b, hi_b))]
        open_ = np.tile(k > 0, 2) & (sides[1] < sides[2]) & (sides[3] < sides[4])
        pair, lo_a, hi_a, lo_b, hi_b = (x[open_] for x in sides)
    return 2.0 * matched / np.maximum(size_a + size_b, 1)


@F.pandas_udf(DoubleType())
def _matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series(np.zeros(len(a)))
    todo = (a.notna() & b.notna()).to_numpy()
    if todo.any():
        out[todo] = matching_ratio(a[todo], b[todo])
    return out


def ratio_similarity(a, b, at_least: float = 0.0) -> Column:
    """Containment 1, else the matching-blocks ratio; 0 where the lengths alone keep it below ``at_least``."""
    a, b = _c(a), _c(b)
    shorter, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    open_ = (a != "") & (b != "") & ~contained(a, b) & (2.0 * shorter >= F.lit(float(at_least)) * both)
    ratio = _matching_ratio(F.when(open_, a), F.when(open_, b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(contained(a, b), F.lit(1.0)).otherwise(ratio)
