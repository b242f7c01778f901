r"""Text functions as Column expressions: all of them stay inside code generation.

White space is Unicode's and the separators 0x1c to 0x1f wherever texts are stripped or squeezed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import vocabulary as v

SPACE = r"[\s\x1c-\x1f]"


def let(c: Column, body) -> Column:
    """``body`` over a value that is computed once, however often it is used; else nested uses would multiply the plan."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


#: Unicode's white space and the separators 0x1c to 0x1f: fixed values.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def normalize_text(c: Column) -> Column:
    """Wide spaces and line ends made plain, runs of blanks squeezed, three or more line feeds made two, stripped."""
    c = F.regexp_replace(F.regexp_replace(c, "　", " "), r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def normalize_paragraph(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "　", " "), rf"(?U){SPACE}+", " "))


def strip_bracket_heading(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)^【[^】]+】\s*", ""))


def join_filled(parts: Column, separator: str = "\n") -> Column:
    """The non-empty strings of an array, joined."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), separator)


def stable_id(*parts: Column) -> Column:
    """md5 of the parts joined by ``::``; a null part is empty (concat_ws alone would skip it)."""
    return F.md5(F.concat_ws("::", *(or_empty(p.cast("string")) for p in parts)))


def node_id(label: Column, name: Column) -> Column:
    return F.concat(label, F.lit(":"), stable_id(label, name))


def canonical_id(label: Column, name: Column) -> Column:
    return F.concat(label, F.lit(":canonical:"), stable_id(label, name))


def alias_of(value: Column, label: Column, aliases: Mapping[str, Mapping[str, str]]) -> Column:
    """The value's other name under its label, else the value: one literal map, keyed by both."""
    entries = [F.lit(x) for name, known in aliases.items() for k, to in known.items() for x in (f"{name}\x1f{k}", to)]
    return let(value, lambda x: F.coalesce(F.create_map(*entries)[F.concat(or_empty(label), F.lit("\x1f"), x)], x)) if entries else value


def without_suffix(value: Column, suffixes: Sequence[str]) -> Column:
    """Without the first listed suffix that leaves four characters or more, for values of over four."""
    def cut(x: Column) -> Column:
        out = x
        for s in reversed(suffixes):
            out = F.when(x.endswith(s) & (F.length(x) - len(s) >= 4), F.substring(x, F.lit(1), F.length(x) - len(s))).otherwise(out)
        return F.when(F.length(x) > 4, out).otherwise(x)

    return let(value, cut)


def normalize_name(name: Column, label: Column | None = None, *, strip_suffixes: bool = True, aliases: Mapping[str, Mapping[str, str]] = v.NAME_ALIASES, suffixes: Sequence[str] = v.WEAK_SUFFIXES) -> Column:
    """One pass of name normalization; not idempotent, so callers apply it as often as the data's way demands."""
    name = or_empty(name.cast("string"))
    value = F.translate(F.regexp_replace(name, rf"(?U){SPACE}+", ""), "（），；", "(),;")
    value = F.regexp_replace(value, "^[。；;，,、:：]+|[。；;，,、:：]+$", "")
    if label is not None:
        value = alias_of(value, label, aliases)
    if strip_suffixes:
        value = without_suffix(value, suffixes)
    if label is not None:
        value = alias_of(value, label, aliases)
    return let(value, lambda x: F.when(x == "", strip(name)).otherwise(x))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def culture_label(entity_type: Column, label: Column) -> Column:
    """The standard label of a cultural defect by the first keyword group that hits; other labels stripped."""
    label = strip(or_empty(label))
    out = label
    for words, name in reversed(v.CULTURE_LABELS):
        out = F.when(contains_any(label, words), name).otherwise(out)
    return F.when(entity_type == "SafetyCultureDefect", out).otherwise(label)


def between(c: Column, left: str, right: str) -> Column:
    """What stands between the first ``left`` and the next ``right``; empty without both."""
    start = F.instr(c, left)
    rest = F.substring(c, start + len(left), F.length(c))
    return F.when((start > 0) & (F.instr(rest, right) > 0), F.substring_index(rest, right, 1)).otherwise("")


def first_evidence(c: Column, marker: str = "事故文本：", low: int = 6, high: int = 120) -> Column:
    """The first sentence of ``low`` to ``high`` characters after the marker; else the first ``high`` characters."""
    at = F.instr(c, marker)
    value = strip(F.when(at > 0, F.substring(c, at + len(marker), F.length(c))).otherwise(c))
    parts = F.transform(F.split(value, "[\n。]"), strip)
    return F.coalesce(F.get(F.filter(parts, lambda x: F.length(x).between(low, high)), F.lit(0)), F.substring(value, 1, high))


def evidence_spans(c: Column, most: int = 360) -> Column:
    """Sentences as an array of (span_id, text); those of over ``most`` characters in fixed windows."""
    parts = F.filter(F.transform(F.split(or_empty(c), "[\n。；;]+"), strip), lambda x: x != "")

    def windows(x: Column, i: Column) -> Column:
        name = F.format_string("S%03d", i + 1)
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda k: F.struct(F.concat(name, F.lit("_"), (k + 1).cast("string")).alias("span_id"), F.substring(x, k * most + 1, F.lit(most)).alias("text")))
        return F.when(F.length(x) > most, cut).otherwise(F.array(F.struct(name.alias("span_id"), x.alias("text"))))

    return F.flatten(F.transform(parts, windows))


def is_severe(c: Column, words: Sequence[str] = v.SEVERE_KEYWORDS) -> Column:
    return contains_any(or_empty(c), words).cast("int")


def normalize_answer(c: Column) -> Column:
    return F.when(F.lower(strip(or_empty(c.cast("string")))).isin(*v.YES_WORDS), "yes").otherwise("no")


def feature_column(label: Column, name: Column) -> Column:
    prefix = F.coalesce(F.create_map(*(F.lit(x) for kv in v.FEATURE_LABELS.items() for x in kv))[label], F.lit("x"))
    return F.concat(F.lit("x_"), prefix, F.lit("_"), F.substring(stable_id(label, normalize_name(name, label)), 1, 10))


def layer_column(label: Column) -> Column:
    return F.concat(F.lit("layer_"), label)


def dot_id(c: Column) -> Column:
    safe = F.regexp_replace(c, "[^0-9A-Za-z_]", "_")
    return F.when(safe == "", "v").when(safe.rlike("^[0-9]"), F.concat(F.lit("v_"), safe)).otherwise(safe)


def hms(seconds: Column) -> Column:
    """HH:MM:SS, clamped at 0, halves to even, hours beyond 24 kept."""
    s = F.bround(F.greatest(seconds.cast("double"), F.lit(0.0)), 0).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
