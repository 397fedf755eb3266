"""Labels, ages and tags of a listing; grouping expressions of the trend cube."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from stallwise import vocab


def as_ntz(stamp: str) -> Column:
    """A literal wall-clock timestamp (listing times carry no zone)."""
    return F.lit(stamp).cast("timestamp_ntz")


def age_days(posted, as_of: Column) -> Column:
    posted = F.col(posted) if isinstance(posted, str) else posted
    return F.datediff(as_of.cast("date"), posted.cast("date"))


def age_bucket(age: Column, new_days=3) -> Column:
    return (F.when(age.isNull(), F.lit(None).cast("string"))
            .when(age == 0, "today").when(age <= new_days, "new").otherwise("older"))


def is_new(first_seen, baseline) -> Column:
    """Seen after the first finished run of its profile (no run at all: everything is new)."""
    return F.when(baseline.isNull(), first_seen.isNotNull()).otherwise(
        F.coalesce(first_seen > baseline, F.lit(False)))


def display_tags(*, is_new, age, terms, business, stock, developer, new_days=3) -> Column:
    """Ordered array of the tags that apply."""
    def text(c):
        return F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.array_compact(F.array(
        F.when(is_new, "new in base"),
        F.when(age == 0, "posted today").when(
            age <= new_days, F.concat(F.lit("posted "), age.cast("string"), F.lit(" days ago"))),
        F.when(terms.cast("int") != 0, "terms"),
        F.when(business.cast("int") != 0, "agency"),
        text(stock), text(developer)))


def rooms_label(rooms="rooms_n") -> Column:
    r = F.col(rooms)
    return (F.when(r.isNull(), F.lit(None).cast("string")).when(r == 0, vocab.STUDIO)
            .when(r >= 5, vocab.ROOMS_TOP)
            .otherwise(F.concat(r.cast("string"), F.lit(vocab.ROOMS_SUFFIX))))


def area_band(area="area", bands=vocab.AREA_BANDS) -> Column:
    a = F.col(area)
    out = F.when(a.isNull() | (a <= 0), F.lit(None).cast("string"))
    for edge, label in bands:
        out = out.otherwise(label) if edge is None else out.when(a < edge, label)
    return out


def floor_band(floor="floor", floors_total="floors_total") -> Column:
    f, t = F.col(floor), F.col(floors_total)
    return (F.when(f.isNull(), F.lit(None).cast("string")).when(f == 1, vocab.FLOOR_FIRST)
            .when(f >= t, vocab.FLOOR_LAST).otherwise(vocab.FLOOR_MIDDLE))


def author_label(author="author_type", business="owner_is_business", authors=None) -> Column:
    authors = authors or vocab.AUTHORS
    a = F.col(author)
    return (F.when(F.coalesce(a, F.lit("")) != "", a)
            .when(F.coalesce(F.col(business).cast("int"), F.lit(0)) == 1, authors["business"])
            .otherwise(authors["private"]))


def trend_groups(features="features", authors=None, kind_feature=None) -> dict[str, Column]:
    """The nine grouping expressions; NULL stands for "not specified"."""
    kind = kind_feature or vocab.FEATURE_NAMES["premise"]

    def filled(name):
        return F.nullif(F.col(name), F.lit(""))
    return {
        "none": F.lit(vocab.ALL_LISTINGS),
        "rooms": rooms_label(),
        "district": filled("district"),
        "housing": filled("housing_stock"),
        "author": author_label(authors=authors),
        "area": area_band(),
        "floor": floor_band(),
        "developer": filled("developer"),
        "kind": F.nullif(F.col(features)[kind], F.lit("")),
    }
