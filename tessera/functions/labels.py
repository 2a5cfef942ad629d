"""Small scalars of reports and sheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provider types that run in the cloud, and sizes by aspect.
CLOUD = ("google", "gemini", "openai-compatible", "openai", "anthropic", "claude")
ASPECTS = {"portrait": (576, 1024), "9:16": (576, 1024), "wide": (1024, 576), "16:9": (1024, 576), "square": (768, 768), "1:1": (768, 768)}


def column_letter(i: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA; up to three letters."""
    letter = lambda n: F.chr(F.lit(65) + n)
    two, three = i - 26, i - 26 - 26 * 26
    return (
        F.when(i < 26, letter(i))
        .when(two < 26 * 26, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def truncated_label(text: Column, most: int) -> Column:
    """From four bytes on, texts of more than `most` bytes end in an ellipsis after most - 1 of them, whole characters."""
    if most < 4:
        return text
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most - 1).cast("string")), "�+$", "")
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)


def aspect_size(aspect: Column) -> Column:
    """struct<width, height> of an aspect; unknown ones are square."""
    sizes = F.create_map(*[x for k, (w, h) in ASPECTS.items() for x in (F.lit(k), F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")))])
    return F.coalesce(F.element_at(sizes, aspect), F.element_at(sizes, F.lit("square")))


def progress_percent(completed: Column, total: Column) -> Column:
    """-1 where the total is not known."""
    return F.when(total > 0, F.floor(completed * 100 / total)).otherwise(-1).cast("int")


def is_cloud(provider: Column) -> Column:
    return provider.isin(*CLOUD)


def any_cloud(providers: Column) -> Column:
    """Aggregate: whether one is in the cloud; without any, yes."""
    return F.coalesce(F.bool_or(is_cloud(providers)), F.lit(True))
