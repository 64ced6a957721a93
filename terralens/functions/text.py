"""Caption text and file-name expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

WORD_OR_PUNCTUATION = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"


def normalise(caption):
    """Delete ``. , ! ?`` and lower-case."""
    return F.lower(F.translate(caption, ".,!?", ""))


def tokenise(text):
    """Words and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit(f"({WORD_OR_PUNCTUATION})"), F.lit(1))


def untokenise(tokens):
    return F.array_join(tokens, " ")


def replace_word(tokens, old, new):
    return F.transform(tokens, lambda x: F.when(x == old, new).otherwise(x))


def stem(path):
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def add_prefix(path, prefix):
    """Put ``prefix`` before the file name, the folder stays."""
    return F.concat(F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), prefix, F.regexp_extract(path, r"([^/]*)$", 1))


def change_extension(path, extension):
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(f".{extension}"))


def class_caption(best, add_probability=True):
    """``i) class (p)%`` lines of ranked ``struct(p, name)`` entries."""

    def line(e, i):
        rank = (i + 1).cast("string")
        if add_probability:
            return F.format_string("%s) %s (%.2f)%%", rank, e["name"], e["p"] * 100)
        return F.format_string("%s) %s", rank, e["name"])

    return F.array_join(F.transform(best, line), "\n")
