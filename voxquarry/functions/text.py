"""Column functions that turn a free-text finding into typed slots.

Everything here is a plain Catalyst expression: no UDF, no join.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def _any_contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _first_case(conditions: list[tuple[Column, Column]], default: Column) -> Column:
    (cond, value), *rest = conditions
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out.otherwise(default)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def kw_first(text: Column, pairs: list[tuple[str, str]], default: str) -> Column:
    """Canonical value of the first dictionary keyword contained in ``lower(text)``."""
    low = F.lower(text)
    return _first_case(
        [(F.contains(low, F.lit(kw)), F.lit(canon)) for kw, canon in pairs], F.lit(default)
    )


def anatomy(text: Column, pairs=vocab.ANATOMY_KEYWORDS) -> Column:
    return kw_first(text, pairs, "unknown")


def finding(text: Column, pairs=vocab.FINDING_KEYWORDS) -> Column:
    return kw_first(text, pairs, "lesion")


def laterality(text: Column) -> Column:
    low = F.lower(text)
    left, right = F.contains(low, F.lit("left")), F.contains(low, F.lit("right"))
    return (
        F.when(_any_contains(low, vocab.BILATERAL_WORDS) | (left & right), "bilateral")
        .when(left, "left")
        .when(right, "right")
        .otherwise("none")
    )


def spine_level(text: Column, levels=vocab.SPINE_LEVELS) -> Column:
    """First vertebral level, in list order, present as a whole word; '' if none."""
    low = F.lower(text)
    return _first_case(
        [(low.rlike(rf"\b{lv.lower()}\b"), F.lit(lv)) for lv in levels], F.lit("")
    )


def organ_level(text: Column, anatomy_col: Column, fallback: Column) -> Column:
    """upper/lower/middle for lung and kidney, else ``fallback`` (the spine level)."""
    low = F.lower(text)
    paired = anatomy_col.isin("lung", "kidney")
    return (
        F.when(paired & _any_contains(low, ["upper", "apex"]), "upper")
        .when(paired & _any_contains(low, ["lower", "base"]), "lower")
        .when(paired & F.contains(low, F.lit("middle")), "middle")
        .otherwise(fallback)
    )


def count_focality(text: Column) -> Column:
    words = vocab.MULTIPLE_WORDS + vocab.BILATERAL_WORDS
    return F.when(_any_contains(F.lower(text), words), "multiple").otherwise("single")


def target_form(text: Column, anatomy_col: Column, finding_col: Column, count_col: Column) -> Column:
    return (
        F.when(finding_col.isin("enlargement", "cirrhosis", "ascites"), "diffuse")
        .when(
            anatomy_col.isin("spine", "bone")
            | finding_col.isin("osteophyte", "spondylosis", "fracture"),
            "bony",
        )
        .when(
            _any_contains(F.lower(text), vocab.DIFFUSE_WORDS) | (finding_col == "emphysema"),
            "diffuse",
        )
        .when((count_col == "multiple") & (finding_col != "mass"), "multifocal")
        .otherwise("focal")
    )


def post_rule(finding_col: Column, form_col: Column) -> Column:
    return (
        F.when(finding_col.isin("enlargement", "cirrhosis", "ascites"), "organ_roi")
        .when(form_col == "focal", "keep_nearest")
        .otherwise("keep_multi")
    )


PACKET_FIELDS = ["anatomy", "side", "level", "target_form", "finding_type", "count", "post_rule"]


def with_packet(df, text: str = "text"):
    """Append the parsed slots as flat columns named like ``PACKET_FIELDS``."""
    t = F.col(text)
    return (
        df.withColumns(
            {
                "anatomy": anatomy(t),
                "side": laterality(t),
                "finding_type": finding(t),
                "count": count_focality(t),
            }
        )
        .withColumn("level", organ_level(t, F.col("anatomy"), spine_level(t)))
        .withColumn(
            "target_form", target_form(t, F.col("anatomy"), F.col("finding_type"), F.col("count"))
        )
        .withColumn("post_rule", post_rule(F.col("finding_type"), F.col("target_form")))
    )


def parse_packet(df, text: str = "text", out: str = "packet"):
    """Append one struct column holding all slots."""
    slots = with_packet(df.select("*"), text)
    return slots.withColumn(out, F.struct(*PACKET_FIELDS)).drop(*PACKET_FIELDS)


def finding_regex(text: Column, terms=vocab.FINDING_TERMS, singular=vocab.FINDING_SINGULAR) -> Column:
    """First listed finding term present as whole words, in the singular; else 'lesion'."""
    low = F.lower(text)
    return _first_case(
        [(low.rlike(rf"\b{re.escape(t)}\b".replace(r"\ ", " ")), F.lit(singular.get(t, t))) for t in terms],
        F.lit("lesion"),
    )


def short_keyword(text: Column, words=vocab.SHORT_KEYWORDS, default: str | None = "lesion") -> Column:
    low = F.lower(text)
    return _first_case(
        [(F.contains(low, F.lit(w)), F.lit(w)) for w in words], F.lit(default).cast("string")
    )


def first_sentence(text: Column) -> Column:
    return F.concat(strip(F.substring_index(text, ".", 1)), F.lit("."))


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` whitespace-separated words, and one more piece if there are further ones.

    The split stops after them (a leading blank piece is allowed for), so a
    long text is not cut into all its words.
    """
    return F.filter(F.split(text, r"\s+", n + 2), lambda w: w != "")


def shorten_text(text: Column, phrases=vocab.FILLER_PHRASES, max_chars: int = 80, max_words: int = 15) -> Column:
    bare = F.regexp_replace(text, r"\([^)]*\)", "")
    for phrase in phrases:
        bare = F.replace(bare, F.lit(phrase), F.lit(""))
    def head(words: Column, whole: Column) -> Column:
        return strip(
            F.when(F.size(words) > max_words, F.array_join(F.slice(words, 1, max_words), " ")).otherwise(whole)
        )

    def first_chunk(t: Column) -> Column:
        return F.when(F.length(t) > max_chars, strip(F.substring_index(t, ",", 1))).otherwise(t)

    return let(strip(bare), lambda t: let(first_chunk(t), lambda c: let(first_words(c, max_words), lambda w: head(w, c))))


def anatomy_keyword(text: Column, terms=vocab.ANATOMY_TERMS, fallback_words: int = 5) -> Column:
    """Longest contained term (list order breaks ties), else the first words."""
    low = F.lower(text)
    by_length = sorted(terms, key=lambda t: -len(t))
    return _first_case(
        [(F.contains(low, F.lit(t)), F.lit(t)) for t in by_length],
        F.array_join(F.slice(first_words(text, fallback_words), 1, fallback_words), " "),
    )


def text_truncate(text: Column, n: int = 120) -> Column:
    return F.substring(text, 1, n)
