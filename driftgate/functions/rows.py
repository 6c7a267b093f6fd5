"""Row images: canonical text, fingerprints and column-by-column differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgate.functions.hashing import hex_slice


def exact_double_text(column: Column) -> Column:
    """Text of a double that tells any two different numbers apart: sign, 53-bit mantissa and power of two.

    Other engines can repeat it, since scaling by powers of two is exact; their shortest decimal texts differ.
    """
    x = column.cast("double")
    size = F.abs(x)
    near = F.floor(F.log2(size))
    power = F.when(F.pow(F.lit(2.0), near) > size, near - 1).when(F.pow(F.lit(2.0), near + 1) <= size, near + 1).otherwise(near)
    mantissa = (size / F.pow(F.lit(2.0), power) * F.lit(float(1 << 52))).cast("bigint")
    sign = F.when(x < 0, "-").otherwise("")
    infinite = size == float("inf")
    return (
        F.when(F.isnan(x), "nan").when(infinite, F.concat(sign, F.lit("inf"))).when(x == 0, "0")
        .when(x.isNotNull(), F.concat(sign, mantissa.cast("string"), F.lit("p"), power.cast("string")))
    )


def fixed_text(column: Column, digits: int) -> Column:
    """A double with no or one digit after the point, rounded from its binary value, halves to even, as C's printf does.

    ``format_string`` rounds the shortest decimal text of a double, halves up: 48.65 lies below what it is written as.
    """
    if digits not in (0, 1):
        raise ValueError(digits)
    size = F.abs(column)
    whole = F.floor(size)
    one = F.lit(1 << 58)  # the fraction times 2^58 is whole, except far below any digit shown
    parts = ((size - whole) * F.lit(float(1 << 58))).cast("bigint") * F.lit(10**digits)
    down, rest = F.call_function("div", parts, one), parts % one
    shown = whole.cast("bigint") * F.lit(10**digits) + down
    up = (rest > F.lit(1 << 57)) | ((rest == F.lit(1 << 57)) & (shown % 2 == 1))
    shown = shown + F.when(up, 1).otherwise(0)
    text = F.concat(F.call_function("div", shown, F.lit(10)).cast("string"), F.lit("."), (shown % 10).cast("string")) if digits else shown.cast("string")
    text = F.concat(F.when(column.cast("string").startswith("-"), "-").otherwise(""), text)
    # doubles from here on have no fraction
    return F.when(size < F.lit(float(1 << 53)), text).otherwise(F.format_string(f"%.{digits}f", column))


def canonical_value(column: Column, kind: T.DataType) -> Column:
    """Text of a value that does not depend on how an engine prints numbers or times, and loses nothing."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return exact_double_text(column)
    if isinstance(kind, T.DecimalType):
        # values beyond 38 digits keep their own text instead of failing or vanishing
        fixed = column.try_cast(f"decimal(38,{max(6, kind.scale)})").cast("string")
        return F.coalesce(fixed, column.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def shown_value(column: Column, kind: T.DataType) -> Column:
    """Text of a value for people: as canonical, but doubles in their usual decimal form."""
    return column.cast("string") if isinstance(kind, (T.FloatType, T.DoubleType)) else canonical_value(column, kind)


def canonical_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """JSON text of a row: keys sorted, every value a string or null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns or df.columns)
    fields = [canonical_value(F.col(f"`{n}`"), kinds[n]).alias(n) for n in names]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def text_bytes(df: DataFrame) -> Column:
    """Size of a row as the UTF-8 bytes of its canonical text."""
    return F.octet_length(canonical_row(df)).cast("bigint")


_WIDTHS = {
    T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8,
    T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16,
}


def value_bytes(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value: its width, or the bytes of its text; 0 for null."""
    if type(kind) in _WIDTHS:
        size = F.when(column.isNotNull(), F.lit(_WIDTHS[type(kind)]))
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType) and type(kind.elementType) in _WIDTHS:
        size = F.when(column.isNotNull(), F.size(column) * _WIDTHS[type(kind.elementType)])
    else:
        size = F.octet_length(F.to_json(column))
    return F.coalesce(size, F.lit(0)).cast("bigint")


def row_bytes(df: DataFrame) -> Column:
    """Size of a row: the sum of its values' bytes. No text is made of numbers, so only long columns are looked at."""
    return sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("bigint"))


def row_hash(df: DataFrame, method: str = "xxhash64", columns: list[str] | None = None) -> Column:
    """Fingerprint of a row as a bigint.

    ``xxhash64`` hashes the canonical values directly and is the fast choice
    between two Spark tables; ``md5`` hashes the canonical text, which any other
    engine can repeat (15 hex digits, so the result is never negative).
    """
    if method == "md5":
        return hex_slice(F.md5(canonical_row(df, columns)), 1, 15)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(columns or df.columns)
    values = []
    for name in names:
        kind = kinds[name]
        column = F.col(f"`{name}`")
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.FloatType):
            column = column.cast("double")
        elif isinstance(kind, T.MapType):
            column = F.to_json(column)
        values.append(column)
    # xxhash64 skips nulls, so the pattern of nulls is hashed along with the values.
    nulls = F.concat(*[F.when(F.col(f"`{n}`").isNull(), "1").otherwise("0") for n in names])
    return F.xxhash64(nulls, *values)


def _comparable(left: Column, left_kind, right: Column, right_kind) -> tuple[Column, Column]:
    """Values of one type are compared as they are, others by their text."""
    if left_kind == right_kind and not isinstance(left_kind, T.MapType):
        return left, right
    return canonical_value(left, left_kind), canonical_value(right, right_kind)


def _compared(edge, target, blank_is_null: bool):
    """Per column of either side: name, the two values, and whether they are the same."""
    nothing = (F.lit(None).cast("string"), T.StringType())
    for name in sorted(set(edge) | set(target)):
        left, right = edge.get(name, nothing), target.get(name, nothing)
        a, b = _comparable(*left, *right)
        if blank_is_null:
            if isinstance(left[1], T.StringType):
                a = F.nullif(a, F.lit(""))
            if isinstance(right[1], T.StringType):
                b = F.nullif(b, F.lit(""))
        yield name, left, right, a.eqNullSafe(b)


def rows_differ(
    edge: dict[str, tuple[Column, T.DataType]],
    target: dict[str, tuple[Column, T.DataType]],
    blank_is_null: bool = True,
) -> Column:
    """True when any column differs; stops at the first one and builds no text."""
    answer = F.lit(False)
    for _, _, _, same in _compared(edge, target, blank_is_null):
        answer = answer | ~same
    return answer


def row_diff(
    edge: dict[str, tuple[Column, T.DataType]],
    target: dict[str, tuple[Column, T.DataType]],
    blank_is_null: bool = True,
) -> Column:
    """Map of the columns that differ to both values as text, over the union of names.

    Text is only made for columns that differ. With ``blank_is_null`` empty text
    and null are equal.
    """
    entries = []
    for name, (left, left_kind), (right, right_kind), same in _compared(edge, target, blank_is_null):
        values = F.struct(
            shown_value(left, left_kind).alias("edge"), shown_value(right, right_kind).alias("target")
        )
        entries.append(F.when(~same, F.struct(F.lit(name).alias("key"), values.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))
