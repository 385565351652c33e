"""Text clean-up, token counts and name building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's ``re`` sees it: Java's Unicode class and the four
# separators U+001C to U+001F that it leaves out.
WHITESPACE = r"\s\x1c-\x1f"

# One token is a run of letters, digits and underscores, or one other character
# that is not white space: Python's ``\w+|[^\w\s]`` spelled out for Java.
TOKEN = rf"(?U)[\p{{L}}\p{{N}}_]+|[^{WHITESPACE}]"

# The pooling variants in the order their names are joined.
POOLERS = ("cls", "max", "mean")


def strip_comments(code: Column) -> Column:
    """Delete triple-quoted blocks (double quotes first, then single), then ``#`` to the line end.

    Patterns only: a ``#`` or a triple quote inside a string literal counts too,
    and an unclosed triple quote stays.
    """
    code = F.regexp_replace(code, '(?s)""".*?"""', "")
    code = F.regexp_replace(code, "(?s)'''.*?'''", "")
    return F.regexp_replace(code, r"#[^\n]*", "")


def flatten_ws(code: Column) -> Column:
    """Each run of white space becomes one space; the ends are not trimmed."""
    return F.regexp_replace(code, f"(?U)[{WHITESPACE}]+", " ")


def token_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit(TOKEN)).cast("int")


def truncate_tokens(code: Column, limit: int) -> Column:
    """The first ``limit`` tokens, as an array."""
    return F.slice(F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0)), 1, limit)


def within_limits(code: Column, tokens: Column, max_chars: int = 800, max_tokens: int = 510) -> Column:
    return (F.length(code) <= max_chars) & (tokens <= max_tokens)


def pooler_tag(model_path: Column) -> Column:
    """All pooling names found anywhere in a model path, left to right, joined by ``-``."""
    return F.array_join(F.regexp_extract_all(model_path, F.lit(f"({'|'.join(POOLERS)})"), F.lit(1)), "-")


def pooler_name(cls: Column, max: Column, mean: Column) -> Column:
    """Names of the enabled poolers, in the fixed order, joined by ``-``."""
    flags = zip((cls, max, mean), POOLERS, strict=True)
    return F.concat_ws("-", *[F.when(flag, F.lit(name)) for flag, name in flags])


def data_label(set_names: Column) -> Column:
    """``_`` becomes ``-`` inside each set name; the names are joined by ``-``."""
    return F.array_join(F.transform(set_names, lambda name: F.replace(name, F.lit("_"), F.lit("-"))), "-")


def report_name(run_label: Column, set_names: Column, poolers: Column) -> Column:
    """``<run>_<sets>_<poolers>.csv``."""
    return F.concat(F.concat_ws("_", run_label, data_label(set_names), F.array_join(poolers, "-")), F.lit(".csv"))


def decoded_uri(uri: Column) -> Column:
    """A file URI with its percent codes resolved (``+`` is a plain character in a path)."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def path_dir(path: Column) -> Column:
    """Name of the directory that holds the file (second part from the end)."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def path_file(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(path_file(path), ".", 1)


def model_slug(model_name: Column) -> Column:
    return F.replace(model_name, F.lit("/"), F.lit("-"))


def pair_key(source: Column, target: Column) -> Column:
    return F.concat_ws("_", source.cast("string"), target.cast("string"))


def cluster_name(cluster: Column) -> Column:
    return F.when(cluster == -1, F.lit("noise")).otherwise(F.concat(F.lit("cluster-"), cluster.cast("string")))


def backticked(name: str) -> Column:
    """A column whose name may hold ``-`` or dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(names: Sequence[str]) -> list[Column]:
    return [backticked(name) for name in names]
