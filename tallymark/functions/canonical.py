"""Canonical JSON text, from which documents and rows take their identities.

Keys in code-point order, no spaces, no escapes but those JSON needs, numbers as whole numbers or as the shortest decimal that
reads back as the same double: ``1.0``, ``1e-07``, ``1.5e+300``. Typed columns are printed by Spark's own functions; only documents of unknown shape
go through a JSON parser in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def json_string(c: Column) -> Column:
    """A string in quotes, with escapes for quotes, backslashes and control characters only; null for null.

    Spark prints the hex letters of control characters as capitals. Where a string has such ones, escaped backslashes are set aside as a
    character that JSON text never holds, and the codes are lowered.
    """
    quoted = F.to_json(F.array(c))
    text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    pieces = F.split(F.replace(text, F.lit("\\\\"), F.lit("\x01")), r"(?=\\u00)")
    lowered = F.transform(pieces, lambda x: F.when(x.startswith("\\u00"), F.concat(F.lower(F.substring(x, 1, 6)), F.substring(x, 7, 1 << 30))).otherwise(x))
    return F.when(c.rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), F.replace(F.array_join(lowered, ""), F.lit("\x01"), F.lit("\\\\"))).when(c.isNotNull(), text)


def json_double(c: Column) -> Column:
    """The shortest decimal that reads back as the same double, written as ``json.dumps`` does; null for null.

    The JVM's own text reads back too but may have a digit or two more than needed, so digits are rounded off while the value stays.
    """
    size = F.abs(c)
    parts = F.split(size.cast("string"), "E")
    fraction = F.element_at(F.split(parts[0], r"\."), 2)
    whole = F.when((size < 9.2e18) & (size == F.floor(size)), F.struct(size.cast("long").alias("d"), F.lit(0).alias("e")))  # exact, where the JVM rounds twice
    first = F.struct(F.regexp_replace(parts[0], r"\.", "").cast("long").alias("d"), (F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(0)) - F.length(fraction)).alias("e"))

    ten = lambda k: F.pow(F.lit(10.0), k).cast("decimal(20,0)")

    def cut(start: Column, k: Column) -> Column:
        """``start`` without its last ``k`` digits, rounded once."""
        half = F.when(k > 0, 5 * ten(k - 1)).otherwise(F.lit(0))
        return F.call_function("div", start["d"].cast("decimal(20,0)") + half, ten(k))

    def fewest(start: Column) -> Column:
        same = lambda k: F.concat_ws("E", cut(start, k).cast("string"), (start["e"] + k).cast("string")).cast("double") == size
        # two decimals of 15 digits or fewer are never one normal double, so such a text is the shortest but for its zeros
        long = F.aggregate(F.sequence(F.lit(1), F.lit(18)), F.lit(0), lambda a, k: F.when((k == a + 1) & (ten(k) <= start["d"]) & same(k), k).otherwise(a))
        k = F.when((start["d"] < 10**15) & (size > 2.3e-308), F.lit(0)).otherwise(long)
        return F.transform(F.array(k), lambda k: _python_digits(cut(start, k).cast("string"), start["e"] + k))[0]

    best = F.transform(F.array(F.coalesce(whole, first)), fewest)[0]
    text = F.when(size == 0, "0.0").when(size == float("inf"), "Infinity").otherwise(best)
    minus = F.when((c < 0) | (c.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(F.isnan(c), "NaN").when(c.isNotNull(), F.concat(minus, text))


def _python_digits(all_digits: Column, exponent: Column) -> Column:
    """``digits * 10 ** exponent`` in plain notation from 1e-4 up to 1e16, else with an exponent of two digits or more."""
    digits = F.regexp_replace(all_digits, "0+$", "")
    n = F.length(digits)
    point = F.length(all_digits) + exponent
    zeros = lambda k: F.repeat(F.lit("0"), k)
    plain = F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits)).when(point >= n, F.concat(digits, zeros(point - n), F.lit(".0")))
    plain = plain.otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    power = point - 1
    mantissa = F.when(n == 1, digits).otherwise(F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), n)))
    size = F.abs(power).cast("string")
    signed = F.concat(F.when(power < 0, "-").otherwise("+"), F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))
    return F.when((power >= -4) & (power < 16), plain).otherwise(F.concat(mantissa, F.lit("e"), signed))


def json_token(c: Column) -> Column:
    """A number that :func:`from_json` has read as a string: whole numbers stay whole, others are printed as doubles; null is ``null``."""
    whole = F.when(c == "-0", "0").otherwise(c)
    return F.when(c.isNull(), "null").when(c.rlike(r"^-?[0-9]+$"), whole).otherwise(F.coalesce(json_double(c.try_cast("double")), F.lit("null")))


def object_text(fields: Mapping[str, Column]) -> Column:
    """An object of texts that are JSON already; null ones are ``null``."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + json.dumps(name, ensure_ascii=False) + ":"), F.coalesce(fields[name], F.lit("null"))]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """The canonical text of a column of type ``kind``; nulls are ``null``, of structs, arrays and maps of strings inside each other."""
    if isinstance(kind, T.StructType):
        text = object_text({f.name: canonical_json(c[f.name], f.dataType) for f in kind.fields})
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda k: F.concat(json_string(k), F.lit(":"), canonical_json(F.element_at(c, k), kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(c)), entry), ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        text = c.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = json_double(c.cast("double"))
    elif isinstance(kind, T.IntegralType):
        text = c.cast("string")
    elif isinstance(kind, T.StringType):
        text = json_string(c)
    else:
        raise TypeError(f"{kind.simpleString()} has no JSON form")
    return F.coalesce(F.when(c.isNotNull(), text), F.lit("null"))


def row_identity(columns: Mapping[str, tuple[Column, T.DataType]]) -> Column:
    """SHA-256 of the canonical object of typed columns."""
    return F.sha2(object_text({n: canonical_json(c, t) for n, (c, t) in columns.items()}), 256)


def document_text(text: Column, without: str = "") -> Column:
    """The canonical text of a JSON object of any shape, without its top-level field ``without``; null if it is no JSON object."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        def one(value: str | None) -> str | None:
            try:
                document = json.loads(value) if value is not None else None
            except ValueError:
                return None
            if not isinstance(document, dict):
                return None
            document.pop(without, None)
            return json.dumps(document, ensure_ascii=False, separators=(",", ":"), sort_keys=True)

        return texts.map(one)

    return canonical(text)
