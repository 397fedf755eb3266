"""Polymorphic values of raw payloads, kept as JSON text."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from stallwise import vocab
from stallwise.functions.maps import bind
from stallwise.functions.text import CUT


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _path(value: Column, key: str) -> Column:
    return F.get_json_object(value, f"$['{key}']")


def _is_object(value: Column) -> Column:
    return F.substring(F.ltrim(value), 1, 1) == "{"


def _is_number(value: Column) -> Column:
    return F.trim(value).rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$")


def _as_number(value: Column) -> Column:
    return F.when(_is_number(value), F.trim(value).try_cast("double"))


def money_amount(value) -> Column:
    """Number of a money value: a bare number or an object's ``value``; anything else is NULL."""
    value = _c(value)
    # a quoted number inside the object is text and does not count as an amount
    quoted = value.rlike(r'"value"\s*:\s*"')
    inner = F.when(~quoted, _as_number(_path(value, "value")))
    return F.when(_is_object(value), inner).otherwise(_as_number(value))


def money_unit(value, prefix=vocab.UNIT_PREFIX) -> Column:
    value = _c(value)
    code = F.coalesce(F.nullif(_path(value, "unit"), F.lit("")), _path(value, "measurement"), F.lit(""))
    return F.when(_is_object(value), F.replace(code, F.lit(prefix), F.lit(""))).otherwise(F.lit(""))


def money_text(value) -> Column:
    """The amount as text, as a flat export prints it."""
    value = _c(value)
    bare = F.when(value.isNull(), F.lit("")).otherwise(value)
    return F.when(_is_object(value), F.coalesce(_path(value, "value"), F.lit(""))).otherwise(bare)


def unit_label(code, labels: Mapping[str, str] = vocab.UNITS, prefix=vocab.UNIT_PREFIX) -> Column:
    """Printed unit of a unit code; unknown codes only lose their prefix."""
    code = _c(code)
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(known[code], F.replace(F.coalesce(code, F.lit("")), F.lit(prefix), F.lit("")))


def parsed_object(value) -> Column:
    """The parsed value of a feature value that is an object; NULL for any other."""
    return F.when(_is_object(_c(value)), F.try_parse_json(_c(value)))


def read_parts(value, parsed) -> dict[str, Column]:
    """A feature value given as JSON text: the text, its first sign and its ``parsed_object``."""
    value = _c(value)
    return {"value": value, "first": F.substring(F.ltrim(value), 1, 1), "v": _c(parsed)}


def read_value(value) -> Column:
    """As ``read_parts``, in one column that is computed once."""
    return bind(_c(value), lambda v: F.struct(*[c.alias(name) for name, c in read_parts(v, parsed_object(v)).items()]))


def key_of(read: Column | Mapping[str, Column], key: str, kind="string") -> Column:
    """A key of a value that was read; NULL where the value is no object or lacks it."""
    return F.when(read["first"] == "{", F.try_variant_get(read["v"], f"$.{key}", kind))


def _amount(read: Column | Mapping[str, Column]) -> Column:
    """The amount of an object as its JSON spells it."""
    return F.get_json_object(read["value"], "$.value")


def value_text(read: Column | Mapping[str, Column], labels: Mapping[str, str] = vocab.UNITS) -> Column:
    """Readable text of a value that was read.

    Objects: translation, else phone list, else coordinates, else amount + unit (+ bargain mark),
    else the JSON itself. Arrays are joined with commas. Scalars are printed, booleans and nulls as
    True, False and None.
    """
    value, v = read["value"], read["v"]

    def key(name, kind="string"):
        # a key stands in the text as it is, unless escaped
        return F.when(value.contains(name) | value.contains("\\"), F.try_variant_get(v, f"$.{name}", kind))

    def priced(p):
        unit = unit_label(F.coalesce(F.nullif(key("unit"), F.lit("")), key("measurement")), labels)
        kind = F.schema_of_variant(p)
        amount = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(_amount(read))).otherwise(_amount(read))
        bargain = F.coalesce(key("bargain"), F.lit("")).isin("true", "1")
        return F.when(p.isNotNull(), F.concat(F.trim(F.concat_ws(" ", amount, unit)), F.when(bargain, vocab.BARGAIN_SUFFIX).otherwise("")))

    def item(s, x):
        return F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(s)).otherwise(F.coalesce(s, F.lit("None")))
    listed = F.array_join(F.zip_with(F.from_json(value, "array<string>"), F.from_json(value, "array<variant>"), item), ", ")
    point = F.concat(F.get_json_object(value, "$.lat"), F.lit(", "), F.get_json_object(value, "$.lon"))
    shown = F.coalesce(key("translated"), F.array_join(key("phone_numbers", "array<string>"), ", "),
                       F.when(key("lat").isNotNull(), point), bind(key("value", "variant"), priced),
                       F.when(F.trim(value) == "{}", "").otherwise(value))
    plain = F.trim(value)
    return (F.when(value.isNull(), F.lit("")).when(read["first"] == "{", shown)
            .when(read["first"] == "[", F.when(plain == "[]", "").otherwise(listed))
            .when(plain.isin("", "null"), "").when(plain.isin("true", "false"), F.initcap(plain))
            .when(~value.contains('"'), value).otherwise(F.regexp_replace(value, r'^"|"$', "")))


#: An object of nothing but a translation without escapes, as most values are.
_TRANSLATION = r'^\{"translated":"([^"\\]+)"\}$'


def feature_text(value, labels: Mapping[str, str] = vocab.UNITS) -> Column:
    """Readable text of a feature value given as JSON text; a plain translation is cut out without parsing."""
    plain = F.nullif(F.regexp_extract(_c(value), _TRANSLATION, 1), F.lit(""))
    return F.coalesce(plain, bind(read_value(value), lambda r: value_text(r, labels)))


#: Stands before texts that were cut out of joined values.
_DONE = "\x02"
_JOINED_TRANSLATION = rf'{CUT}\{{"translated":"([^"\\{CUT}]+)"\}}(?={CUT})'


def feature_texts(df: DataFrame, name: str, values: str) -> DataFrame:
    """Add ``feature_text`` of every value of an array column.

    Plain translations are cut out of the joined values in one go; only other values are read one by one. Where a value
    holds one of the signs that join and mark, all are read on their own.
    """
    joined, pieces = F.col("__joined"), F.col("__pieces")
    step = df.withColumn("__joined", F.concat(F.lit(CUT), F.array_join(values, CUT, ""), F.lit(CUT)))
    step = step.withColumn("__pieces", F.split(F.regexp_replace(joined, _JOINED_TRANSLATION, f"{CUT}{_DONE}$1"), CUT, -1))

    def shown(piece):
        return (F.when(piece.startswith(_DONE), F.substr(piece, F.lit(2))).when(piece == "", "")
                .otherwise(bind(read_value(piece), lambda r: value_text(r))))
    whole = (F.size(pieces) == F.size(values) + 2) & ~joined.contains(_DONE)
    texts = F.when(whole, F.transform(F.slice(pieces, F.lit(2), F.size(values)), shown)).otherwise(F.transform(values, lambda v: feature_text(v)))
    return step.withColumn(name, texts).drop("__joined", "__pieces")


def amount_of(read: Column | Mapping[str, Column]) -> Column:
    """``money_amount`` of a value that was read: a quoted number inside an object is text."""
    kind = F.schema_of_variant(F.try_variant_get(read["v"], "$.value", "variant"))
    return F.when(read["first"] == "{", F.when(kind != "STRING", _as_number(_amount(read)))).otherwise(_as_number(read["value"]))


def amount_text_of(read: Column | Mapping[str, Column]) -> Column:
    """``money_text`` of a value that was read."""
    return F.when(read["first"] == "{", F.coalesce(_amount(read), F.lit(""))).otherwise(F.coalesce(read["value"], F.lit("")))


def unit_of(read: Column | Mapping[str, Column]) -> Column:
    """The unit code of a value that was read, empty where it has none."""
    return F.coalesce(F.nullif(key_of(read, "unit"), F.lit("")), key_of(read, "measurement"), F.lit(""))
