"""Column functions over free text and HTML fragments."""
from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Mapping
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from stallwise import vocab
from stallwise.functions.maps import bind, lookup


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _found(text: Column, pattern: str, group=0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_int(text) -> Column:
    """First signed run of digits ("1 200" gives 1); none gives NULL."""
    return _found(_c(text).cast("string"), r"-?\d+").try_cast("bigint")


def first_number(text) -> Column:
    """First decimal number, comma or point as separator."""
    hit = _found(_c(text).cast("string"), r"-?\d+(?:[.,]\d+)?")
    return F.translate(hit, ",", ".").try_cast("double")


def digits_only(text) -> Column:
    """All digits of the text read as one number."""
    return F.nullif(F.regexp_replace(_c(text), "[^0-9]", ""), F.lit("")).try_cast("bigint")


def rooms_number(text, studio_marker=vocab.STUDIO_MARKER) -> Column:
    text = _c(text)
    return F.when(text.contains(studio_marker), F.lit(0).cast("bigint")).otherwise(first_int(text))


def contains_any(text, markers: Iterable[str] = vocab.TERMS_MARKERS) -> Column:
    """1 if the lower-cased text contains one of the markers.

    The text is lowered once and searched as bytes per marker; an alternation pattern would retry
    every marker at every position.
    """
    def found(low):
        return reduce(lambda a, b: a | b, [low.contains(m) for m in dict.fromkeys(markers)])
    hit = F.transform(F.array(F.lower(_c(text))), found)[0]
    return F.coalesce(hit.cast("int"), F.lit(0))


def id_from_text(text) -> Column:
    return _found(_c(text), r"(\d{6,})", 1)


def mask(text, pattern=vocab.PHONE_PATTERN, replacement=vocab.PHONE_MASK) -> Column:
    return F.regexp_replace(_c(text), pattern, replacement)


def strip(text) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


@cache
def _entities() -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Finders of the standard's entities by name, and of those that need no semicolon."""
    from html.entities import html5
    return lookup(html5), lookup({k: v for k, v in html5.items() if not k.endswith(";")}, 512)


def _numbered(code: Column) -> Column:
    """The character of a numeric reference; the C1 range means the Windows characters, as browsers read it."""
    windows = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    low = F.from_json(F.lit(json.dumps({str(n): c for n, c in windows.items()})), "map<string,string>")
    none = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
            | (code % 0x10000 >= 0xFFFE))
    return (F.when(code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd")
            .when(code.between(0x80, 0x9F), low[code.cast("string")]).when(none, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def unescape(text) -> Column:
    """All named and numeric HTML entities decoded, JVM-side: the text is cut at ``&`` and each piece looked up."""
    named, bare = _entities()

    def numbered(seg):
        number = F.regexp_extract(seg, r"^#([xX][0-9a-fA-F]+|[0-9]+);?", 1)
        digits = F.regexp_extract(number, r"([0-9a-fA-F]+)$", 1)
        read = F.when(number.rlike("^[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        code = F.when(F.length(digits) > 12, F.lit(0x110000).cast("bigint")).otherwise(read.cast("bigint"))
        rest = F.regexp_replace(seg, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")
        return F.when(number != "", F.concat(_numbered(code), rest)).otherwise(F.concat(F.lit("&"), seg))

    def spelled(x):
        seg, name = x["seg"], x["name"]
        tail = lambda n: F.substr(seg, n + 1)
        # the whole name, else the longest name that is a beginning
        starts = [F.when(F.length(name) > n, F.concat(bare(F.substring(name, 1, n)), tail(F.lit(n)))) for n in range(6, 1, -1)]
        return F.coalesce(F.when(name != "", F.concat(named(name), tail(F.length(name)))), *starts, F.concat(F.lit("&"), seg))

    def piece(seg):
        name = F.regexp_extract(seg, "^([^\t\n\f <&#;]{1,32};?)", 1)
        return F.when(seg.startswith("#"), numbered(seg)).otherwise(bind(F.struct(seg.alias("seg"), name.alias("name")), spelled))

    def decoded(t):
        parts = F.split(t, "&", -1)
        joined = F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece)), "")
        return F.when(t.contains("&"), joined).otherwise(t)
    return bind(_c(text), decoded)


def html_clean(text) -> Column:
    """Tags out, entities decoded, white space collapsed."""
    return strip(F.regexp_replace(unescape(F.regexp_replace(_c(text), "<[^>]+>", "")), r"(?U)\s+", " "))


#: Stands between joined texts. Spaces around it keep it apart from the names of entities.
CUT = "\x01"


def _joined(texts: str) -> Column:
    return F.concat(F.lit(f"{CUT} "), F.array_join(texts, f" {CUT} ", CUT + CUT), F.lit(f" {CUT}"))


def _parted(df: DataFrame, name: str, parts: str, texts: str, single: Callable[[Column], Column]) -> DataFrame:
    """The parts of a joined text, if they are as many as its texts; else each text on its own."""
    whole = F.size(parts) == F.size(texts) + 2
    return df.withColumn(name, F.when(whole, F.slice(parts, F.lit(2), F.size(texts))).otherwise(F.transform(texts, single)))


def html_clean_all(df: DataFrame, name: str, texts: str) -> DataFrame:
    """Add ``html_clean`` of every text of an array column; the texts are cleaned joined, in one go, not one by one.

    No step makes or drops the sign between the texts, so the number of pieces tells whether it, or a NULL, was among
    them; such rows are cleaned text by text.
    """
    joined = F.col("__joined")
    step = df.withColumn("__joined", _joined(texts))
    step = step.withColumn("__joined", F.when(joined.contains("<"), F.regexp_replace(joined, f"<[^>{CUT}]+>", "")).otherwise(joined))
    step = step.withColumn("__joined", F.when(joined.contains("&"), unescape(joined)).otherwise(joined))
    step = step.withColumn("__cleaned", F.split(F.regexp_replace(joined, r"(?U)\s+", " "), f" ?{CUT} ?"))
    return _parted(step, name, "__cleaned", texts, html_clean).drop("__joined", "__cleaned")


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    import html
    return text.map(html.unescape, na_action="ignore")


def html_clean_full(text) -> Column:
    """As ``html_clean``, with Python's own decoder (Arrow batches of strings)."""
    out = _unescape(F.regexp_replace(_c(text), "<[^>]+>", ""))
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def _folding() -> tuple[str, str]:
    """Letters below U+2000 that decompose to exactly one base letter, and their bases."""
    src, dst = [], []
    for cp in range(0xA0, 0x2000):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _folding()


def strip_marks(text) -> Column:
    """Diacritics removed, JVM-side, for all single-letter decompositions."""
    return F.translate(F.regexp_replace(_c(text), r"\p{M}", ""), _FOLD_FROM, _FOLD_TO)


def plain(text) -> Column:
    return strip(F.lower(strip_marks(text)))


def plain_all(df: DataFrame, name: str, texts: str) -> DataFrame:
    """Add ``plain`` of every text of an array column, folded joined as ``html_clean_all`` cleans them."""
    folded = F.split(F.lower(strip_marks(_joined(texts))), rf"(?U)\s*{CUT}\s*")
    return _parted(df.withColumn("__folded", folded), name, "__folded", texts, plain).drop("__folded")


@F.pandas_udf(StringType())
def _decompose(text: pd.Series) -> pd.Series:
    import unicodedata as ud

    def fold(s):
        return "".join(c for c in ud.normalize("NFKD", s) if not ud.combining(c)).lower().strip()
    return text.map(fold, na_action="ignore")


def plain_full(text) -> Column:
    """As ``plain`` including ligatures and other letters that decompose to several."""
    text = _c(text)
    # pure ASCII needs no decomposition; only the rest pays for the Arrow round trip
    return F.when(text.rlike(r"^\p{ASCII}*$"), strip(F.lower(text))).otherwise(_decompose(text))


def breadcrumb(*names, sep=" / ") -> Column:
    return F.concat_ws(sep, *[F.nullif(_c(n), F.lit("")) for n in names])


def media_urls(names, base: str, size: str) -> Column:
    """Image URLs of one size for an array of media names."""
    return F.transform(_c(names), lambda n: F.concat(F.lit(f"{base}/{size}/"), n))


def resize_urls(urls, old: str, new: str) -> Column:
    return F.transform(_c(urls), lambda u: F.replace(u, F.lit(old), F.lit(new)))


def renamed(text, renames: Mapping[str, str] = vocab.DISTRICT_RENAMES) -> Column:
    text, out = _c(text), None
    for old, new in renames.items():
        out = F.when(text == old, new) if out is None else out.when(text == old, new)
    return text if out is None else out.otherwise(text)


def renamed_in_map(features, key=vocab.DISTRICT_FEATURE,
                   renames: Mapping[str, str] = vocab.DISTRICT_RENAMES) -> Column:
    """The same renames applied to one entry of an attribute map."""
    return F.transform_values(_c(features), lambda k, v: F.when(k == key, renamed(v, renames)).otherwise(v))


def message_fields(name, email, body) -> dict[str, Column]:
    """Trimmed and truncated message fields."""
    def cut(c, n):
        return F.substring(strip(F.coalesce(_c(c), F.lit(""))), 1, n)
    return {"name": cut(name, vocab.NAME_MAX), "email": cut(email, vocab.EMAIL_MAX),
            "body": cut(body, vocab.BODY_MAX)}


def first_problem(name, email, body) -> Column:
    """First rule a message breaks, NULL if it breaks none."""
    f = message_fields(name, email, body)
    return (F.when(F.length(f["name"]) < vocab.NAME_MIN, "name too short")
            .when(~f["email"].rlike(vocab.EMAIL_PATTERN), "bad e-mail")
            .when(F.length(f["body"]) < vocab.BODY_MIN, "body too short"))
