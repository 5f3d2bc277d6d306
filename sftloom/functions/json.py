"""JSON in model replies and data files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, strip_fences


def _between(text: Column, left: str, right: str) -> Column:
    first, last = F.instr(text, left), F.length(text) - F.instr(F.reverse(text), right) + 1
    return F.when((first > 0) & (F.instr(text, right) > 0) & (last > first), F.substring(text, first, last - first + 1))


def _whole(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing more; Spark's parser alone would stop after the first value."""
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return let(values, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def extract_json(text: Column | str) -> Column:
    """First of the outermost object and the outermost array that parses, as a variant; null where neither does."""
    return let(strip_fences(col(text)), lambda t: F.coalesce(_whole(_between(t, "{", "}")), _whole(_between(t, "[", "]"))))


def parse_scores(text: Column | str, dimensions: list[str]) -> Column:
    """Map of the configured dimensions that a judge's reply has; what is no number counts as 0; null without any."""

    def of(reply: Column) -> Column:
        def entry(d: str) -> Column:
            value = F.try_variant_get(reply, f"$['{d}']", "string")
            return F.when(value.isNotNull(), F.struct(F.lit(d).alias("k"), F.coalesce(value.try_cast("double"), F.lit(0.0)).alias("v")))

        return let(F.filter(F.array(*map(entry, dimensions)), lambda e: e.isNotNull()), lambda found: F.when(F.size(found) > 0, F.map_from_entries(found)))

    return let(extract_json(text), of)


def items(text: Column | str, wrappers: tuple[str, ...] = ("items", "candidates", "instructions", "plan")) -> Column:
    """The objects of a reply: an array's, a wrapper's, or the object itself."""

    def of(reply: Column) -> Column:
        wrapped = [F.try_variant_get(reply, f"$.{w}", "array<variant>") for w in wrappers]
        return F.coalesce(F.try_variant_get(reply, "$", "array<variant>"), *wrapped, F.array(reply))

    return let(extract_json(text), of)
