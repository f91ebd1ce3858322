"""Column functions on variants read from JSON; none raises on a value of another shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: phrases of a failed command.
FAILURE = r"""(?i)\b(script failed|command failed|exit(?:ed)? (?:code|status) [1-9]|isError["']?\s*:\s*true)\b"""


def at(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a path, null if absent, JSON null or of another kind; objects and arrays as strings are JSON."""
    return F.try_variant_get(v, path, kind)


def let(v: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; f may use it often without repeating its expression."""
    return F.get(F.transform(F.array(v), f), F.lit(0))


def given(v: Column, *paths: str) -> Column:
    """The first variant at the paths that is there and no JSON null."""
    found = F.array(*[at(v, p, "variant") for p in paths])
    return F.get(F.filter(found, lambda x: x.isNotNull() & ~F.is_variant_null(x)), F.lit(0))


def kind_of(v: Column) -> Column:
    """STRING, BIGINT, OBJECT<...>, ARRAY<...> and so on, the empty string for null."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def raw(v: Column) -> Column:
    """A string as it is, everything else as JSON."""
    return at(v, "$")


def json_of(v: Column) -> Column:
    return F.to_json(v)


def string_at(v: Column, path: str) -> Column:
    """The string at a path, null for other kinds."""
    return let(at(v, path, "variant"), lambda x: F.when(kind_of(x) == "STRING", raw(x)))


def items(v: Column) -> Column:
    """The elements of an array, none for other kinds."""
    return F.coalesce(at(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def keys(v: Column) -> Column:
    return F.sort_array(F.map_keys(at(v, "$", "map<string,variant>")))


def _plain(v: Column) -> Column:
    named = F.when(kind_of(v).startswith("OBJECT"), raw(given(v, "$.text", "$.message", "$.content", "$.output")))
    return F.coalesce(named, raw(v), F.lit(""))


def text_of(v: Column) -> Column:
    """Null is empty, elements are joined by newlines, an object is its text, message, content or output, else JSON."""

    def inner(x: Column) -> Column:
        return F.coalesce(F.when(kind_of(x).startswith("OBJECT"), given(x, "$.text", "$.message", "$.content", "$.output")), x)

    def shown(x: Column) -> Column:
        return F.when(kind_of(x).startswith("ARRAY"), F.array_join(F.transform(items(x), _plain), "\n")).otherwise(_plain(x))

    return let(let(v, inner), shown)


def content_text(v: Column) -> Column:
    """The text blocks of a message, joined by newlines."""

    def block(b: Column) -> Column:
        said = F.when(at(b, "$.type").isin("input_text", "output_text", "text"), F.coalesce(at(b, "$.text"), at(b, "$.input_text"), at(b, "$.output_text")))
        return F.coalesce(F.when(kind_of(b) == "STRING", raw(b)).otherwise(said), F.lit(""))

    def shown(x: Column) -> Column:
        return F.when(kind_of(x).startswith("ARRAY"), F.array_join(F.filter(F.transform(items(x), block), lambda t: t != ""), "\n")).otherwise(text_of(x))

    return let(v, shown)


def unwrapped(v: Column) -> Column:
    """JSON that stands in a string is parsed, null if it can't be; other kinds stay."""
    return let(v, lambda x: F.when(kind_of(x) == "STRING", F.try_parse_json(raw(x))).otherwise(x))


def output_status(v: Column) -> Column:
    """By a numeric exit code, else an error mark, else a phrase of failure in the text."""

    def by_code(code: Column) -> Column:
        return F.when(kind_of(code).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.when(at(code, "$", "double") == 0, "COMPLETED").otherwise("FAILED"))

    def by_mark(x: Column) -> Column:
        marked = (kind_of(at(x, "$.isError", "variant")) == "BOOLEAN") & (at(x, "$.isError") == "true")
        return F.coalesce(by_code_of(x), F.when(F.coalesce(marked, F.lit(False)) | ~F.coalesce(at(x, "$.error"), F.lit("false")).isin("false", "", "0"), "FAILED"))

    def by_code_of(x: Column) -> Column:
        return let(given(x, "$.exit_code", "$.exitCode", "$.status"), by_code)

    return let(v, lambda x: F.coalesce(let(unwrapped(x), by_mark), F.when(text_of(x).rlike(FAILURE), "FAILED"), F.lit("COMPLETED")))
