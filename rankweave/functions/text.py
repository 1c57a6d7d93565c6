"""Text and skill-cell functions: Column in, Column out, no Python on executors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def lookup(col: Column, table: Mapping[str, object], default: Column | None = None) -> Column:
    """Value of a small fixed table, else the default (the column itself)."""
    lit = lambda x: repr(float(x)) + "D" if isinstance(x, float) else "'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = F.expr("map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in table.items()) + ")")
    return F.coalesce(F.try_element_at(pairs, col), col if default is None else default)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once a row; Spark would else repeat it wherever, and in lambdas as often as, it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_typography(col: Column) -> Column:
    """Typographic quotes, dashes and their mis-decoded forms as ASCII."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), vocab.TYPOGRAPHY.items(), col)


def canonical_skill(col: Column) -> Column:
    """Canonical name of a skill: aliases, abbreviations, one ending cut, abbreviations again."""
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), "['\"]", ""), r"\s+", " "))
    cut = lambda t: F.coalesce(*[F.when(F.endswith(t, F.lit(x)) & (F.length(t) > len(x)), F.trim(F.substring(t, F.lit(1), F.length(t) - len(x)))) for x in vocab.SUFFIXES], t)
    return let(s, lambda a: let(lookup(a, vocab.ALIASES), lambda b: let(lookup(b, vocab.ABBREVIATIONS), lambda c: let(cut(c), lambda d: F.trim(lookup(d, vocab.ABBREVIATIONS))))))


def normal_token(col: Column) -> Column:
    return lookup(F.lower(F.trim(col)), vocab.ABBREVIATIONS)


def normal_text(col: Column) -> Column:
    """Words in lower case with characters outside a-z0-9+# cut, abbreviations written out."""
    words = F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"\s+"), lambda w: w != "")
    clean = F.transform(words, lambda w: lookup(F.regexp_replace(w, "[^a-z0-9+#]", ""), vocab.ABBREVIATIONS))
    return F.array_join(F.filter(clean, lambda w: w != ""), " ")


def bm25_tokens(col: Column, parts_of_compounds: bool = False) -> Column:
    """Tokens `[a-z0-9][a-z0-9+#_]*`, abbreviations written out as words.

    A skill of several words is indexed as one token with underscores, which a query never gives;
    `parts_of_compounds` adds its words, so that the two meet.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z0-9][a-z0-9+#_]*"), F.lit(0))
    # Only a short token can be an abbreviation, so the table is searched for few.
    words = F.flatten(F.transform(found, lambda t: F.when(F.length(t) <= 7, F.split(lookup(t, vocab.ABBREVIATIONS), " ")).otherwise(F.array(t))))
    if not parts_of_compounds:
        return words
    return F.flatten(F.transform(words, lambda t: F.when(F.contains(t, F.lit("_")), F.concat(F.array(t), F.split(t, "_"))).otherwise(F.array(t))))


def simple_tokens(col: Column) -> Column:
    """Words of more than one character, anything but letters and digits parts them."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 1)


def level_weight(col: Column) -> Column:
    return lookup(F.lower(F.trim(col)), vocab.PROFICIENCY, F.lit(vocab.DEFAULT_PROFICIENCY))


def weight_level(col: Column) -> Column:
    out = F.when(col >= vocab.LEVELS[0][0], vocab.LEVELS[0][1])
    for least, name in vocab.LEVELS[1:]:
        out = out.when(col >= least, name)
    return out.otherwise(vocab.LOWEST_LEVEL)


def skill_cell(col: Column) -> Column:
    """Array of (skill, weight) of a cell such as `Python (Expert), SQL (Basic)`.

    With at least one level in the cell, skills without one are left out; without any, the cell is a
    plain list with weight 1.
    """
    pattern = r"([^,(]+?)\s*\(\s*([^)]+?)\s*\)"
    text = F.coalesce(col, F.lit(""))
    names, levels = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    pairs = F.transform(F.arrays_zip(names.alias("n"), levels.alias("l")), lambda p: F.struct(canonical_skill(p["n"]).alias("skill"), level_weight(p["l"]).alias("weight")))
    plain = F.transform(F.split(text, r"[,;|]+"), lambda t: F.struct(canonical_skill(t).alias("skill"), F.lit(vocab.DEFAULT_PROFICIENCY).alias("weight")))
    named = lambda a: F.filter(a, lambda p: p["skill"] != "")
    return let(named(pairs), lambda p: F.when(F.size(p) > 0, p).otherwise(named(plain)))


def skill_copies(weight: Column) -> Column:
    """How often a skill's token counts in the index: twice its weight, half to even, once at least."""
    return F.greatest(F.lit(1), F.bround(2 * weight, 0).cast("int"))


def paren_list(col: Column) -> Column:
    """A comma list whose items may hold commas in parentheses; a closing (…) is cut from each item."""
    items = F.split(F.coalesce(col, F.lit("")), r",(?![^(]*\))")
    return F.filter(F.transform(items, lambda s: F.trim(F.regexp_replace(F.trim(s), r"\s*\([^)]*\)\s*$", ""))), lambda s: s != "")


def years(col: Column) -> Column:
    return col.try_cast("double")


def string_list(col: Column) -> Column:
    """Null or a comma list to an array of items that are not blank."""
    return F.when(col.isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(col, ","), lambda s: F.trim(s)), lambda s: s != ""))


def normal_id(col: Column) -> Column:
    """Trimmed id without a trailing .0; blank or nan is null."""
    s = F.regexp_replace(F.trim(col.cast("string")), r"\.0$", "")
    return F.when((s != "") & (F.lower(s) != "nan"), s)


def number_or_zero(col: Column) -> Column:
    return F.coalesce(col.cast("string").try_cast("double"), F.lit(0.0))


def present(col: Column) -> Column:
    """Null where a text is blank or the literal nan."""
    return F.when((F.trim(col) != "") & (F.lower(F.trim(col)) != "nan"), col)


def overlaps(items: Column, wanted: Column) -> Column:
    """Items that hold one of the wanted strings, or are part of one, in any case of letters."""
    return F.filter(items, lambda s: F.exists(wanted, lambda q: (q != "") & (F.contains(F.lower(s), q) | F.contains(q, F.lower(s)))))


def paragraph(name: Column, parts: Sequence[tuple[str, Column]]) -> Column:
    """A row as one sentence list; blank parts are left out."""
    return F.concat_ws(" ", F.concat(F.coalesce(present(name), F.lit("")), F.lit(".")), *[F.when(present(c).isNotNull(), F.concat(F.lit(f"{label}: "), c, F.lit("."))) for label, c in parts])
