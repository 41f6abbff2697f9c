"""String, date, hash, array and JSON functions of the request catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of the canonical request text, in their fixed order.
HASH_KEYS = (
    "variableName", "pressureLevels", "years", "months", "days", "hours", "areaCovered", "mapTypes",
    "mapLevels", "fileFormat", "noData", "noMaps", "omp", "mpi", "nThreads", "nProces",
)
ARRAY_KEYS = (
    "pressureLevels", "years", "months", "days", "hours", "areaCovered", "mapTypes", "mapLevels",
)
TEXT_KEYS = ("variableName", "fileFormat")
# Keys passed on to the configuration step.
CONFIG_KEYS = ("requestHash", *HASH_KEYS)
# Fixed lookup: variable name -> short name.
VARIABLES = {"geopotential": "z", "temperature": "t", "u-component_of_wind": "u"}
# Fixed lookup: extension -> content type.
MIME_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "gif": "image/gif", "svg": "image/svg+xml", "txt": "text/plain", "csv": "text/csv",
    "nc": "application/x-netcdf", "json": "application/json",
}
DEFAULT_MIME = "application/octet-stream"
PREVIEW_EXTENSIONS = ("jpg", "jpeg", "png", "svg", "gif", "pdf")
DATA_FOLDER = "/fields"
# Texts read as numbers; an empty one counts as zero. Checked before the cast, because a failing
# cast costs an exception per element.
NUMBER = r"^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)?\s*$"


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def variable_code(name: Column) -> Column:
    return F.try_element_at(literal_map(VARIABLES), F.lower(name))


def sort_numeric_or_text(arr: Column) -> Column:
    """Numeric order when every element is a number, else text order ignoring case first."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def number(v: Column) -> Column:
        return F.coalesce(v.try_cast("double"), F.lit(0.0))

    numeric = F.sort_array(F.transform(arr, lambda v, i: F.struct(number(v).alias("n"), i.alias("p"), v.alias("v"))))
    text = F.sort_array(F.transform(arr, lambda v: F.struct(
        F.lower(v).alias("n"), F.translate(v, upper + lower, lower + upper).alias("p"), v.alias("v"),
    )))
    # one look at the whole array settles the usual case of plain digits
    digits = F.array_join(arr, "\x1f").rlike(r"^\d+(\x1f\d+)*$")
    return F.when(F.size(arr) <= 1, arr).when(digits | F.forall(arr, lambda v: v.rlike(NUMBER)), F.transform(numeric, lambda e: e["v"])).otherwise(
        F.transform(text, lambda e: e["v"])
    )


def sorted_json(arr: Column) -> Column:
    """JSON text of the sorted array. Digits of one length and lower-case words, the usual cases, sort as plain text and need no
    escapes; one look at the joined array tells them."""
    joined = F.array_join(arr, "\x1f")
    digits = joined.rlike(r"^[0-9]+(\x1f[0-9]+)*$") & F.forall(arr, lambda v: F.length(v) == F.length(F.get(arr, F.lit(0))))
    whole = F.length(joined) - F.length(F.replace(joined, F.lit("\x1f"), F.lit(""))) == F.size(arr) - 1  # no null, no mark inside
    plain = (digits | joined.rlike(r"^[a-z]+(\x1f[a-z]+)*$")) & whole
    return F.when(plain, F.concat(F.lit('["'), F.array_join(F.sort_array(arr), '","'), F.lit('"]'))).otherwise(F.to_json(sort_numeric_or_text(arr)))


def _json_text(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def canonical_request(columns: list[str]) -> Column:
    """JSON text of the hash keys present, nulls skipped, arrays sorted."""
    parts = []
    for key in HASH_KEYS:
        if key not in columns:
            continue
        c = F.col(key)
        if key in ARRAY_KEYS:
            body = sorted_json(c)
        elif key in TEXT_KEYS:
            body = _json_text(c)
        else:
            body = c.cast("string")
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f'"{key}":'), body)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def with_request_hash(df: DataFrame, out: str = "requestHash") -> DataFrame:
    return df.withColumn(out, F.sha2(canonical_request(df.columns), 256))


def two_digits(arr: Column) -> Column:
    return F.transform(arr, lambda v: F.format_string("%02d", v.cast("int")))


def compact_ranges(values: Column) -> Column:
    """Runs of consecutive integers as ``a-b`` (or ``a``), joined with '-', two digits each."""
    s = F.sort_array(F.transform(values, lambda v: v.cast("int")))
    n = F.size(s)
    first = F.filter(s, lambda v, i: (i == 0) | (v != F.get(s, i - 1) + 1))
    last = F.filter(s, lambda v, i: (i == n - 1) | (F.get(s, i + 1) != v + 1))
    runs = F.transform(F.arrays_zip(first.alias("a"), last.alias("b")), lambda r: F.when(
        r["a"] == r["b"], F.format_string("%02d", r["a"]),
    ).otherwise(F.format_string("%02d-%02d", r["a"], r["b"])))
    return F.array_join(runs, "-")


def source_file_name(folder: str = DATA_FOLDER) -> Column:
    def dashed(c: str) -> Column:
        return F.array_join(two_digits(F.coalesce(F.col(c), F.array().cast("array<string>"))), "-")

    return F.concat(
        F.lit(folder + "/"), F.coalesce("variableName", F.lit("")), F.lit("_"),
        F.array_join("pressureLevels", "-"), F.lit("hPa_"), dashed("years"), F.lit("-"), dashed("months"),
        F.lit("-("), compact_ranges(F.coalesce(F.col("days"), F.array().cast("array<string>"))), F.lit(")_"),
        dashed("hours"), F.lit("UTC.nc"),
    )


def instant_date_from_name(name: Column, t: Column) -> Column:
    """Date of the t-th instant of a file named by its dates: with a day range the hours cycle
    through the listed ones, otherwise the instant is the hour."""
    hours = F.regexp_extract_all(F.regexp_extract(name, r"_((?:\d{2}-)+\d{2}UTC)$", 1), F.lit(r"(\d{2})"), 1)
    span = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}_\d{2}_)", 1)
    n = F.size(hours)
    day = F.substring(span, 9, 2).try_cast("int") + F.floor(F.try_divide(t, n)).cast("int")
    many = F.concat(
        F.regexp_extract(name, r"(\d{4}-\d{2}-)", 1), F.lpad(day.cast("string"), 2, "0"), F.lit("_"),
        F.get(hours, F.try_mod(t, n).cast("int")), F.lit("UTC"),
    )
    one = F.concat(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}_)", 1), F.lpad(t.cast("string"), 2, "0"), F.lit("UTC"))
    return F.when(span != "", many).otherwise(one)


def extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def file_kind(name: Column) -> Column:
    return F.when(F.lower(name).rlike(r"\.(" + "|".join(PREVIEW_EXTENSIONS) + ")$"), "image").otherwise("data")


def content_type(name: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(MIME_TYPES), extension(name)), F.lit(DEFAULT_MIME))


def inline(mime: Column) -> Column:
    return mime.startswith("image/") | mime.isin("application/pdf", "text/plain")


def encode_component(c: Column) -> Column:
    """Percent-encoding of one path component."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def proxy_url(request_hash: Column, file: Column, base: str = "") -> Column:
    return F.concat(F.lit(f"{base}/api/files/proxy/"), encode_component(request_hash), F.lit("/"), encode_component(file))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def build_envelope(status: Column, message: Column, content: Column) -> Column:
    return F.to_json(F.struct(status.alias("status"), message.alias("message"), content.alias("content")))


def parse_envelope(df: DataFrame, body: str, content_schema: str) -> DataFrame:
    """Adds ``status``, ``content`` (a struct) and ``malformed``. The content may be an object or
    a JSON text; a missing one is an empty object."""
    outer = F.from_json(
        F.col(body), "status string, message string, content string, _bad string",
        {"columnNameOfCorruptRecord": "_bad"},
    )
    inner = F.from_json(
        F.coalesce(F.col("_o.content"), F.lit("{}")), content_schema + ", _bad string",
        {"columnNameOfCorruptRecord": "_bad"},
    )
    out = df.withColumn("_o", outer).withColumn("content", inner)
    return out.withColumns({
        "status": F.col("_o.status"),
        "malformed": F.col("_o").isNull() | F.col("_o._bad").isNotNull() | F.col("content._bad").isNotNull(),
    }).drop("_o")
