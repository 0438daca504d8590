"""Scalar functions on gloss and model text, as Spark expressions.

White space and line breaks are spelled out as classes, so that Java's regular expressions see what
Unicode-aware string functions see. Functions map null to null unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, line breaks, and the pairs of variant characters.
SPACE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
VARIANTS = ("臺着菸祐", "台著煙佑")
TOKEN_MARKS = "。，、？！；：「」『』（）"
SENTENCE_MARKS = "。，？?"
LABELS = "Gloss|gloss|手語|TSL"
QUOTES = "「」\"'"
END_MARKS = "。．.!?！？"
END_NOTE = r"[（(][^（）()]*[）)]$"
VARIANT = r"^(.+?)_([A-Za-z]{1,2}\d?)$"
PLACEHOLDER = "＿"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str, chars: str = SPACE) -> Column:
    """Without the characters of a regular-expression class at both ends."""
    return F.regexp_replace(_col(value), f"^[{chars}]+|[{chars}]+$", "")


def norm_variants(value: Column | str) -> Column:
    """Variant characters as one."""
    return F.translate(_col(value), *VARIANTS)


def tokens(value: Column | str) -> Column:
    """Glosses between slashes; blank ones dropped, the others not trimmed."""
    return F.filter(F.split(F.translate(_col(value), "／", "/"), "/"), lambda t: t.rlike(f"[^{SPACE}]"))


def gloss_text(glosses: Column | str) -> Column:
    return F.array_join(_col(glosses), "/")


def slash_parts(value: Column | str) -> Column:
    """Parts between runs of slashes, empty ones dropped."""
    return F.filter(F.split(_col(value), "/+"), lambda t: t != "")


def clauses(value: Column | str) -> Column:
    """Parts between double slashes."""
    return F.split(_col(value), "//")


def base_name(name: Column | str) -> Column:
    """A name without its variant suffix."""
    return F.regexp_replace(_col(name), VARIANT, "$1")


def variant_of(name: Column | str) -> Column:
    """The variant suffix of a name, null without one."""
    return F.nullif(F.regexp_extract(_col(name), VARIANT, 2), F.lit(""))


def clean_token(token: Column | str) -> Column:
    """A token without marks and white space anywhere; ``++`` stays."""
    return F.regexp_replace(_col(token), f"[{TOKEN_MARKS}{SPACE}]+", "")


def words_between_marks(value: Column | str) -> Column:
    """Four sentence marks count as white space; the words between."""
    spaced = F.translate(_col(value), SENTENCE_MARKS, " " * len(SENTENCE_MARKS))
    return F.filter(F.split(spaced, f"[{SPACE}]+"), lambda t: t != "")


def first_true(*values: Column | str) -> Column:
    """The first value that is neither null nor empty, else the last."""
    *first, last = map(_col, values)
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in first], last)


def prefix_of(value: Column | str, mark: str = "/") -> Column:
    return F.split_part(_col(value), F.lit(mark), F.lit(1))


def group_key(source: Column | str, key: Column | str, dialogue: Column | str, corpus: Column | str, headword: Column | str, template: Column | str) -> Column:
    """What must stay together: corpus rows by dialogue, dictionary sentences by headword, synthetic rows by template, others alone."""
    source, key = _col(source), _col(key)
    talk = F.regexp_replace(first_true(dialogue, prefix_of(corpus), key), r"P\d+$", "")
    return (
        F.when(source == "tslcorpus", F.concat(F.lit("corpus:"), talk))
        .when(source == "twtsl-sentence", F.concat(F.lit("twtsl:"), first_true(headword, key)))
        .when(source == "synth", F.concat(F.lit("synth:"), first_true(template, key)))
        .otherwise(F.concat(source, F.lit(":"), key))
    )


def prefixed_url(path: Column | str, host: str) -> Column:
    """Absolute paths with their host; others as they are."""
    path = _col(path)
    return F.when(path.startswith("/"), F.concat(F.lit(host), path)).otherwise(path)


def numbered(prefix: str, width: int, number: Column | str) -> Column:
    """``prefix`` and a number padded with zeros; longer numbers aren't cut."""
    return F.format_string(f"{prefix}%0{width}d", _col(number))


def id_number(key: Column | str, skip: int) -> Column:
    """The number after the first ``skip`` characters of an id."""
    return F.substring(_col(key), skip + 1, 18).try_cast("bigint")


def filled(template: Column | str, **slots: Column | str) -> Column:
    """``{NAME}`` in a template replaced by its value, null by nothing."""
    out = _col(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(_col(value), F.lit("")))
    return out


def parse_prediction(raw: Column | str) -> Column:
    """The gloss line of a model's answer: the first cleaned line with a slash, else the last that isn't empty; '' for null and blank answers."""

    def clean(line: Column) -> Column:
        out = strip(strip(strip(line), "`"))
        out = F.regexp_replace(out, f"^(?:{LABELS})[：:][{SPACE}]*", "")
        out = strip(F.replace(F.translate(out, "／", "/"), F.lit(" "), F.lit("")), QUOTES)
        out = F.regexp_replace(out, END_NOTE, "")
        return F.regexp_replace(out, f"[{END_MARKS}]+$", "")

    lines = F.filter(F.transform(F.split(strip(raw), LINE_BREAK), clean), lambda x: x != "")
    return F.coalesce(F.get(F.filter(lines, lambda x: x.contains("/")), 0), F.try_element_at(lines, F.lit(-1)), F.lit(""))


def file_tag(model: Column | str) -> Column:
    return F.replace(_col(model), F.lit(":"), F.lit("_"))


def banner(text: Column | str, statement: Column | str, mark: str = "｜") -> Column:
    """The text before the first mark, and a statement after it."""
    return F.concat(prefix_of(text, mark), F.lit(mark), _col(statement))


def scalar_or_list(values: Column | str) -> Column:
    """The JSON of an array as its writer has it: null for none, the value for one, a list for several."""
    values = _col(values)
    size = F.size(values)
    return F.when(values.isNull() | (size <= 0), F.lit("null")).when(size == 1, F.regexp_extract(F.to_json(values), r"(?s)^\[(.*)\]$", 1)).otherwise(F.to_json(values))


def list_or_words(field: Column | str) -> Column:
    """A JSON field that is a list of strings or one string: the list, or the string's words, with slashes as spaces.

    Broken JSON and null give an empty array.
    """
    v = F.try_parse_json(_col(field))
    kind = F.schema_of_variant(v)
    words = F.filter(F.split(F.translate(F.try_variant_get(v, "$", "string"), "／/", "  "), f"[{SPACE}]+"), lambda t: t != "")
    return F.coalesce(F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<string>")).when(kind == "STRING", words), F.array().cast("array<string>"))
