"""Keys and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_session(x: Column) -> Column:
    """Trimmed, ``#`` as a space, one space between words, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(x), "#", " "), r"\s+", " "))


def canonical_game(x: Column) -> Column:
    """``game<n>`` from the first run of digits, else trimmed and lower case."""
    n = F.regexp_extract(x, r"(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("game"), F.regexp_replace(n, "^0+(?=[0-9])", ""))).otherwise(F.lower(F.trim(x)))


def loose_session(x: Column) -> Column:
    """As :func:`canonical_session`, with ``_`` and ``-`` as spaces and without a file suffix."""
    t = F.regexp_replace(x, r"\.(txt|json|mp4)$", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"[#_\-]", " "), r"\s+", " ")))


def encoded_session(x: Column) -> Column:
    """Trimmed, every single space as ``#`` (runs are kept)."""
    return F.regexp_replace(F.trim(x), " ", "#")


def game_id(source: Column, session: Column, game: Column) -> Column:
    """``source / session / game`` from trimmed parts; null if one is null."""
    return F.concat(F.trim(source), F.lit(" / "), F.trim(session), F.lit(" / "), F.trim(game))


def game_parts(x: Column) -> Column:
    """(source, session, game) of a game id; a session that holds the separator loses its rest."""
    p = F.split(x, " / ")
    return F.struct(F.get(p, 0).alias("source"), F.get(p, 1).alias("session"), F.get(p, 2).alias("game"))


def name_key(x: Column) -> Column:
    """The key under which roster spellings meet: trimmed lower case."""
    return F.lower(F.trim(x))


def bare_label(x: Column) -> Column:
    """A speaker label without brackets, arrows, colons and case."""
    return F.trim(F.regexp_replace(F.lower(x), r"\([^)]*\)|>>|:", ""))


def safe_path(x: Column) -> Column:
    """A name with path separators, colons and spaces as ``_``."""
    return F.regexp_replace(F.trim(x), r"[/\\: ]", "_")


def slug(x: Column) -> Column:
    """Lower case words joined by ``-``."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def model_size(x: Column) -> Column:
    """The ``31B`` in a model name, null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(x, r"(?i)(\d+b)", 1)), F.lit(""))


def content_hash(*cols: Column) -> Column:
    """The first 12 hex digits of the SHA-256 of the columns joined by a zero character."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *cols), 256), 1, 12)


def hash_rank(*cols: Column) -> Column:
    """A reproducible pseudo-random integer in [0, 2**32) of the columns joined by ``:``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def stage_of(model_dir: Column) -> Column:
    """(model, stage) of a directory name ``model__ft_stage``; stage ``base`` without a suffix."""
    p = F.split(model_dir, "__ft_")
    return F.struct(F.get(p, 0).alias("model"), F.coalesce(F.get(p, 1), F.lit("base")).alias("stage"))


def word_role(x: Column) -> Column:
    """Each word capitalised, single spaces."""
    return F.initcap(F.regexp_replace(F.trim(x), r"\s+", " "))


def folded(x: Column) -> Column:
    """Without case, accents of Western languages and outer or double spaces."""
    return F.translate(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def prompt_version(x: Column) -> Column:
    """``v<n>`` of a version in any spelling, null without a number."""
    n = F.regexp_extract(x, r"(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("v"), n))
