"""Helpers on id sets (arrays), attribute maps and their text forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(ids: Column) -> Column:
    return F.sort_array(F.array_distinct(ids))


def same_set(a: Column, b: Column) -> Column:
    return canonical(a) == canonical(b)


def set_to_string(ids: Column) -> Column:
    return F.array_join(canonical(ids), " ")


def hyperedge_to_string(src: Column, dst: Column) -> Column:
    return F.concat_ws(";", set_to_string(src), set_to_string(dst))


def set_from_string(text: Column) -> Column:
    return canonical(F.transform(F.filter(F.split(F.trim(text), " +"), lambda x: x != ""), lambda x: x.cast("bigint")))


def sides_from_string(text: Column, separator: str = ";") -> tuple[Column, Column]:
    parts = F.split(text, r"\Q" + separator + r"\E")
    return set_from_string(F.get(parts, F.lit(0))), set_from_string(F.get(parts, F.lit(1)))


def pid_from_string(text: Column, separator: str = ";") -> Column:
    return F.trim(F.substring_index(text, separator, 1)).cast("int")


def hyperedge_from_partitioned(text: Column, separator: str = ";") -> Column:
    """The text after the partition number and its separator."""
    parts = F.split(text, r"\Q" + separator + r"\E")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), separator)


def count_degree(src: Column, dst: Column) -> Column:
    return F.size(src) + F.size(dst)


def count_degrees(src: Column, dst: Column) -> Column:
    return F.struct(F.size(src).alias("src"), F.size(dst).alias("dst"))


def union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def count_intersection(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def size_difference(a: Column, b: Column) -> Column:
    return F.size(a) - F.size(b)


def init_map(ids: Column, kind: str = "bigint") -> Column:
    return F.map_from_arrays(ids, F.transform(ids, lambda _: F.lit(None).cast(kind)))


def map_to_string(m: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"], e["value"])), separator)


def frequencies(values: Column) -> Column:
    """value -> how often it stands in the array"""
    keys = F.array_distinct(values)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(values, lambda x: x == k))))


def merge_sum(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def divide(dividend: Column, m: Column) -> Column:
    return F.transform_values(m, lambda _, v: F.when(v > 0, dividend / v).otherwise(F.lit(0.0)))


def get_or_else(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def map_put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def map_on(m: Column, f) -> Column:
    return F.transform_values(m, f)


def average(x: Column) -> Column:
    return F.avg(x)


def root_of_squares(x: Column) -> Column:
    """sqrt of the sum of squared distances from the mean, not divided by the count."""
    return F.sqrt(F.var_pop(x) * F.count(x))


def effective_count(src: Column, dst: Column) -> Column:
    return F.floor(F.size(src) * F.lit(2.5) + F.size(dst)).cast("int")
