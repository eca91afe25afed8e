"""Column functions for text: normalisation, limits, phrases, similarity, widths.

Everything here is a built-in expression except ``term_key``, which needs Unicode NFKC and runs as
Arrow batches for terms beyond ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from segloom.functions import values as V


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside array lambdas.

    A plain expression used in a lambda is evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Java's Unicode \\s knows every Python whitespace character but these four
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def _spaced(c: Column) -> Column:
    return F.translate(c, _SEPARATORS, " " * len(_SEPARATORS))


def strip(c) -> Column:
    """Remove Unicode whitespace at both ends (plain ``trim`` only removes U+0020)."""
    return F.btrim(_col(c), F.lit(V.WHITESPACE))


def lstrip(c) -> Column:
    return F.ltrim(_col(c), F.lit(V.WHITESPACE))


def rstrip(c) -> Column:
    return F.rtrim(_col(c), F.lit(V.WHITESPACE))


def is_blank(c) -> Column:
    return strip(F.coalesce(_col(c), F.lit(""))) == ""


def clean_text(c) -> Column:
    """One line: CR and LF become single spaces, ends stripped, null is empty."""
    return strip(F.translate(F.coalesce(_col(c), F.lit("")), "\r\n", "  "))


def collapse_ws(c) -> Column:
    """Every whitespace run to one space."""
    return F.regexp_replace(_spaced(_col(c)), r"(?U)\s+", " ")


def fold(c) -> Column:
    """Casefold: lower case, with the letters whose folded form is not their lower case written out."""
    out = F.translate(F.lower(_col(c)), "".join(V.FOLD_LETTERS), "".join(V.FOLD_LETTERS.values()))
    for letter, written in V.FOLD_SEQUENCES.items():
        out = F.replace(out, F.lit(letter), F.lit(written))
    return out


def norm_text(c) -> Column:
    """Matching form: whitespace collapsed, stripped, casefolded. Never shown to users."""
    return fold(strip(collapse_ws(F.coalesce(_col(c), F.lit("")))))


@F.pandas_udf(StringType())
def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def term_key(c) -> Column:
    """Identity of a glossary term: trimmed, NFKC, casefolded.

    ASCII terms stay in the JVM; only the others cross to Python.
    """
    t = strip(c)
    ascii_only = F.length(t) == F.octet_length(t)
    return F.coalesce(_nfkc_casefold(F.when(~ascii_only, t)), F.lower(t))


def has_letters(c) -> Column:
    return _col(c).rlike(r"\p{L}")


def has_cjk(c) -> Column:
    return _col(c).rlike(f"[{V.CJK_CLASS}]")


def letter_words(c) -> Column:
    """Number of whitespace-separated words that hold at least one letter."""
    return F.regexp_count(_spaced(_col(c)), F.lit(r"(?U)\S*\p{L}\S*"))


def looks_like_prose(c) -> Column:
    """A function word stands alone (edge punctuation aside), or 4+ words end a sentence."""
    text = _col(c)
    return has_function_word(norm_text(text)) | (
        rstrip(text).rlike(r"[.!?]\z") & (letter_words(text) >= 4)
    )


def has_function_word(norm) -> Column:
    """Whether a text in matching form has a function word standing alone."""
    punct = r"[.,;:!?()\[\]'\"]*"
    return _col(norm).rlike(f"(?:^| ){punct}(?:{'|'.join(V.FUNCTION_WORDS)}){punct}(?: |$)")


def char_limit(source, pct: int) -> Column:
    n = F.length(clean_text(source)).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.floor(n * pct / 100)).cast("int")


def approx_tokens(c) -> Column:
    n = F.length(F.coalesce(_col(c), F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def batch_tokens(texts, context, glossary_terms) -> Column:
    """Prompt estimate of one batch; 200 covers instructions and padding."""
    return approx_tokens(texts) + approx_tokens(context) + approx_tokens(glossary_terms) + F.lit(200)


def output_token_budget(n) -> Column:
    estimate = F.greatest(F.lit(0), _col(n).cast("int")) * 120 + 256
    return F.greatest(F.lit(1024), F.least(F.lit(8192), estimate))


def length_bucket(length) -> Column:
    n = _col(length)
    expr = F.lit(V.LENGTH_BUCKET_LAST)
    for label, upper in reversed(V.LENGTH_BUCKETS):
        expr = F.when(n <= upper, F.lit(label)).otherwise(expr)
    return expr


def sanitize_html(c, max_length: int = 10000) -> Column:
    text = F.coalesce(_col(c), F.lit(""))
    cut = F.when(
        F.length(text) > max_length, F.concat(F.substring(text, 1, max_length), F.lit("..."))
    ).otherwise(text)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        cut = F.replace(cut, F.lit(raw), F.lit(entity))
    return cut


def sanitize_name(c, max_length: int = 200, fallback: str = "file") -> Column:
    """Keep letters, digits, ``-_. ``; cap the length but keep the last extension."""
    kept = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^\p{L}\p{N}\-_. ]", "")
    name = F.trim(F.regexp_replace(kept, " +", " "))
    ext = F.substring_index(name, ".", -1)
    room = F.lit(max_length) - F.length(ext) - 1
    stem = F.substring(name, F.lit(1), F.least(room, F.length(name) - F.length(ext) - 1))
    capped = F.when(
        F.contains(name, F.lit(".")) & (room > 0), F.concat(stem, F.lit("."), ext)
    ).otherwise(F.substring(name, 1, max_length))
    out = F.when(F.length(name) > max_length, capped).otherwise(name)
    return F.when(out == "", F.lit(fallback)).otherwise(out)


def normalize_ws(c) -> Column:
    return F.translate(_col(c), V.STYLE_SPACES, " " * len(V.STYLE_SPACES))


def md_escape(c) -> Column:
    lf = F.translate(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    return F.replace(F.replace(lf, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def width_units(c) -> Column:
    """Text width in hundredths of the font size, counted per glyph class."""
    text = F.coalesce(_col(c), F.lit(""))
    total = F.length(text)

    def without(chars: str) -> Column:
        return total - F.length(F.translate(text, chars, ""))

    cjk = total - F.length(F.regexp_replace(text, f"[{V.CJK_CLASS}]+", ""))
    space, narrow, wide = without(V.WHITESPACE), without(V.NARROW_GLYPHS), without(V.WIDE_GLYPHS)
    return (
        total * V.WIDTH_OTHER
        + cjk * (V.WIDTH_CJK - V.WIDTH_OTHER)
        + space * (V.WIDTH_SPACE - V.WIDTH_OTHER)
        + narrow * (V.WIDTH_NARROW - V.WIDTH_OTHER)
        + wide * (V.WIDTH_WIDE - V.WIDTH_OTHER)
    )


def char_width(c) -> Column:
    """Width factor of a single character."""
    return width_units(c) / F.lit(100.0)


def text_width(c, pt) -> Column:
    return width_units(c) * _col(pt) / F.lit(100.0)


def _common_prefix(a: Column, b: Column) -> Column:
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    first_difference = F.array_position(same, F.lit(False))
    return F.when(
        (F.length(a) == 0) | (F.length(b) == 0), F.lit(0)
    ).when(first_difference == 0, F.length(a)).otherwise((first_difference - 1).cast("int"))


def digest(text: Column) -> Column:
    """128 bits of SHA-256, a short key for equal texts of any length."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def changed_phrase(old, new) -> Column:
    """What an edit changed: struct(old_phrase, new_phrase) without the shared ends."""
    a, b = _col(old), _col(new)
    prefix = _common_prefix(a, b)
    rest_a = F.substring(a, prefix + 1, F.length(a))
    rest_b = F.substring(b, prefix + 1, F.length(b))
    suffix = _common_prefix(F.reverse(rest_a), F.reverse(rest_b))
    return F.struct(
        strip(F.substring(rest_a, F.lit(1), F.length(rest_a) - suffix)).alias("old_phrase"),
        strip(F.substring(rest_b, F.lit(1), F.length(rest_b) - suffix)).alias("new_phrase"),
    )


def is_meaningful_phrase(c) -> Column:
    """Strong enough to be carried to other segments without a person looking."""
    text = strip(c)
    alnum = F.regexp_replace(text, r"[^\p{L}\p{N}]", "")
    n = F.length(alnum)
    digits_only = alnum.rlike(r"^[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]+$")
    shouting = text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")
    return (
        F.when((n == 0) | digits_only, F.lit(False))
        .when(text.rlike(f"[{V.PHRASE_CJK_CLASS}]"), n >= 3)
        .otherwise((n >= 4) | ((n >= 2) & shouting))
    )


def char_grams(c: Column, n: int) -> Column:
    """All runs of ``n`` characters, built from shifted character arrays in linear time."""
    chars = F.split(c, "")
    grams = chars
    for k in range(1, n):
        shifted = F.slice(chars, F.lit(k + 1), F.greatest(F.lit(0), F.size(chars)))
        grams = F.zip_with(grams, shifted, lambda a, b: F.concat(a, b))
    return F.filter(grams, lambda g: F.length(g) == n)


def bigram_dice(a, b) -> Column:
    """Sorensen-Dice over character bigrams counted with multiplicity."""
    x, y = _col(a), _col(b)

    def count(grams: Column, g: Column) -> Column:
        return F.size(F.filter(grams, lambda v: v == g))

    def score(v: Column) -> Column:
        shared = F.aggregate(
            F.array_distinct(v["gx"]), F.lit(0), lambda acc, g: acc + F.least(count(v["gx"], g), count(v["gy"], g))
        )
        return shared * F.lit(2.0) / (F.size(v["gx"]) + F.size(v["gy"]))

    empty = (F.length(x) < 2) | (F.length(y) < 2)
    return F.when(empty, F.when(x == y, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        let(F.struct(char_grams(x, 2).alias("gx"), char_grams(y, 2).alias("gy")), score)
    )


def relative_position(start, end, length) -> Column:
    ratio = (_col(start) + _col(end)) / F.lit(2.0) / _col(length)
    return (
        F.when(_col(length) <= 0, F.lit("unknown"))
        .when(ratio < 0.33, F.lit("front"))
        .when(ratio > 0.67, F.lit("back"))
        .otherwise(F.lit("middle"))
    )


def is_neutral_color(c) -> Column:
    """Base text colour? Takes ``default``-like names, ``scheme:name`` or ``#RRGGBB``."""
    color = _col(c)
    channels = [F.conv(F.substring(color, p, 2), 16, 10).cast("int") for p in (2, 4, 6)]
    spread = F.greatest(*channels) - F.least(*channels)
    return (
        F.when(color.startswith("scheme:"), F.substring(color, 8, 1000).isin(V.NEUTRAL_SCHEMES))
        .when(
            color.startswith("#"),
            F.when(color.rlike("^#[0-9A-Fa-f]{6}$"), spread <= V.NEUTRAL_SPREAD).otherwise(F.lit(False)),
        )
        .otherwise(F.lit(True))
    )


def _lookup(c: Column, table: dict[str, str], default: str) -> Column:
    expr = None
    for key, value in table.items():
        expr = (F if expr is None else expr).when(c == key, F.lit(value))
    return expr.otherwise(F.lit(default))


def direction_code(source_lang, target_lang) -> Column:
    return F.concat(
        _lookup(_col(source_lang), V.DIRECTION_ISO, "xx"),
        F.lit("_to_"),
        _lookup(_col(target_lang), V.DIRECTION_ISO, "xx"),
    )


def map_lang_code(c) -> Column:
    return _lookup(F.lower(_col(c)), V.LANGUAGE_NAMES, V.DEFAULT_LANGUAGE)


def infer_target(c) -> Column:
    return F.when(_col(c) == "한국어", F.lit("영어")).otherwise(F.lit("한국어"))


def severity_rank(c) -> Column:
    expr = None
    for name, rank in V.SEVERITY_RANK.items():
        expr = (F if expr is None else expr).when(_col(c) == name, F.lit(rank))
    return expr.otherwise(F.lit(V.NO_SEVERITY_RANK))


def wrap_to_weights(text, weights) -> Column:
    """Split a text over ``size(weights)`` lines in proportion to the weights, as one fold over them.

    A line ends at the white space nearest to its share of what is left (the left one of two equally near), looked for
    within a quarter of the share but four characters at least; without any, at the share itself. As long as
    there are enough characters, each line to come keeps one.
    """
    n = F.size(_col(weights))
    steps = F.transform(F.slice(_col(weights), 1, F.greatest(n - 1, F.lit(0))), lambda w, i: F.struct(w.cast("long").alias("w"), (n - 1 - i).alias("later")))
    start = F.struct(
        strip(text).alias("rest"), F.array().cast("array<string>").alias("lines"),
        F.aggregate(_col(weights), F.lit(0).cast("long"), lambda total, w: total + w).alias("share"),
    )

    def line(state: Column, step: Column) -> Column:
        rest, size = state["rest"], F.length(state["rest"])
        room = size - step["later"]
        share = F.bround(size * step["w"] / F.greatest(state["share"], F.lit(1))).cast("int")

        def cut_at(want: Column) -> Column:
            reach = F.greatest(F.lit(4), F.floor(want / 4).cast("int"))
            low, high = F.greatest(F.lit(1), want - reach), F.least(size - 1, want + reach)
            places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            spaces = F.filter(places, lambda at: F.instr(F.lit(V.WHITESPACE), F.substr(rest, at + 1, F.lit(1))) > 0)
            best = F.array_min(F.transform(spaces, lambda at: F.struct(F.abs(at - want).alias("far"), at.alias("at"))))
            end = F.greatest(F.lit(1), F.least(room, F.coalesce(best["at"], want)))
            return F.struct(
                lstrip(F.substr(rest, end + 1, size)).alias("rest"),
                F.concat(state["lines"], F.array(strip(F.substr(rest, F.lit(1), end)))).alias("lines"),
                (state["share"] - step["w"]).alias("share"),
            )

        empty = F.struct(
            rest.alias("rest"), F.concat(state["lines"], F.array(F.lit(""))).alias("lines"), (state["share"] - step["w"]).alias("share")
        )
        return F.when(room > 0, let(F.greatest(F.lit(1), F.least(room, share)), cut_at)).otherwise(empty)

    done = F.aggregate(steps, start, line, lambda s: F.concat(s["lines"], F.array(s["rest"])))
    return F.when(_col(text).isNotNull() & _col(weights).isNotNull(), done)
