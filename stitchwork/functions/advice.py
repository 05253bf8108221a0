"""Advice text: quality gates, domain isolation, occasions, tag blocks, chat markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stitchwork.functions.text import (
    contains_any, first_rule, fixed, lines, literals, starts_with_any, strip, word_count)
from stitchwork.rules import advice as A
from stitchwork.rules import garments as G

_BANNED = "(?iU)(" + "|".join(A.BANNED_PATTERNS) + ")"
_UNOBSERVABLE = "(?iU)(" + "|".join(A.UNOBSERVABLE_PATTERNS) + ")"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _match(pattern: str, stems: list[str]) -> Column:
    """First match or the empty text; every match holds a stem, so most rows skip the pattern."""
    return F.when(contains_any(F.lower("_content"), stems), F.regexp_extract("_content", pattern, 1)).otherwise("")


def _stage(df: DataFrame, text: Column, score: Column) -> DataFrame:
    """Shared facts of an answer as columns, so every rule below reads them instead of recomputing them."""
    content = strip(F.coalesce(text, F.lit("")))
    one = df.withColumns({"_content": content, "_missing": text.isNull(), "_score": score})
    two = one.withColumns({"_low": F.lower("_content"), "_lines": lines("_content"), "_wc": word_count("_content"),
                           "_banned": _match(_BANNED, A.BANNED_STEMS),
                           "_unobs": _match(_UNOBSERVABLE, A.UNOBSERVABLE_STEMS)})
    numbered = F.transform("_lines", lambda x, i: F.struct((i + 1).alias("n"), word_count(x).alias("w"),
                                                           starts_with_any(x, ["- ", "• ", "* "]).alias("b")))
    three = two.withColumns({"_lines": numbered, "_chatter": starts_with_any(F.col("_low"), A.CHATTER_OPENERS)})
    return three.withColumns({"_n": F.size("_lines"), "_bare": F.size(F.filter("_lines", lambda s: ~s["b"])),
                              "_long": F.filter("_lines", lambda s: s["w"] > A.MAX_LINE_WORDS)})


def _rules(low_label: str) -> dict[str, Column]:
    c = F.col
    n, wc = c("_n").cast("string"), c("_wc").cast("string")
    return {
        "short": F.when(c("_wc") < A.MIN_WORDS, _text("too short (", wc, f" words, need >= {A.MIN_WORDS})")),
        "long": F.when(c("_wc") > A.MAX_WORDS, _text("too long (", wc, f" words, need <= {A.MAX_WORDS})")),
        "opener": F.when(c("_chatter"), _text("meta-chatter opener: '", F.substring("_content", 1, 30), "...'")),
        "plain": F.when(c("_bare") != 0, _text("non-checklist format (", c("_bare").cast("string"),
                                               " lines lack bullet prefix)")),
        "adaptive": F.when((c("_score") >= 9.0) & (c("_n") > 3),
                           _text("high score (", fixed(c("_score"), 1), ") should have 2-3 polish tips, got ", n))
        .when((c("_score") < 9.0) & (c("_n") < 3),
              _text(f"{low_label} score (", fixed(c("_score"), 1), ") should have 3-5 fixes, got ", n))}


def _line_reason(s: Column) -> Column:
    return _text("line ", s["n"].cast("string"), " too long (", s["w"].cast("string"), " words, need <= 15)")


def review(df: DataFrame, text: Column, score: Column) -> DataFrame:
    """Add ``reasons`` (every reason, the soft verb warning last) and ``passed`` (no hard reason)."""
    staged, r, c = _stage(df, text, score), _rules("low/average"), F.col
    n = c("_n").cast("string")
    hard = F.concat(
        F.array_compact(F.array(
            r["short"], r["long"], r["opener"],
            F.when(c("_banned") != "", _text("banned genetics/body-shape phrase: '", c("_banned"), "'")),
            F.when(c("_unobs") != "", _text("unobservable item mentioned: '", c("_unobs"), "'")), r["plain"],
            F.when(c("_n") < 2, _text("too few checklist items (", n, ", need >= 2)"))
            .when(c("_n") > 5, _text("too many checklist items (", n, ", need <= 5)")))),
        F.transform("_long", _line_reason), F.array_compact(F.array(r["adaptive"])))
    hard = (F.when(c("_missing"), F.array(F.lit("no assistant message found")))
            .when(c("_content") == "", F.array(F.lit("empty assistant response"))).otherwise(hard))
    warn = F.when(~c("_missing") & (c("_content") != "") & ~contains_any("_low", A.ACTION_VERBS),
                  F.array(F.lit(A.NO_VERB_WARNING))).otherwise(F.array().cast("array<string>"))
    checked = staged.withColumns({"_hard": hard, "_warn": warn})
    return checked.select(*df.columns, F.concat("_hard", "_warn").alias("reasons"), (F.size("_hard") == 0).alias("passed"))


def first_failure(df: DataFrame, text: Column, score: Column, name: str = "reason") -> DataFrame:
    """Add the first failing reason at generation time, null when accepted."""
    staged, r, c = _stage(df, text, score), _rules("lower"), F.col
    reason = F.coalesce(
        F.when(c("_content") == "", "empty response"), r["opener"],
        F.when(c("_banned") != "", _text("forbidden genetics/body-shape phrase: '", c("_banned"), "'")),
        F.when(c("_unobs") != "", _text("unobservable item mentioned: '", c("_unobs"), "'")),
        r["short"], r["long"], r["plain"],
        F.when((c("_n") < 2) | (c("_n") > 5),
               _text("bullet count out of range (", c("_n").cast("string"), " lines, need 2-5)")),
        F.when(F.size("_long") > 0, _line_reason(F.try_element_at("_long", F.lit(1)))), r["adaptive"])
    return staged.select(*df.columns, reason.alias(name))


def canonical_occasion(raw: Column, variant: str = "script") -> Column:
    """Free text to one of ten occasions: exact name, then ordered keywords, then the default."""
    clean = F.lower(strip(F.coalesce(raw, F.lit(""))))
    if variant == "app":
        return first_rule(clean, A.APP_OCCASION_RULES, A.DEFAULT_OCCASION)
    exact = None
    for name in A.OCCASIONS:
        hit = clean == name.lower()
        exact = F.when(hit, name) if exact is None else exact.when(hit, name)
    return F.coalesce(exact, first_rule(clean, A.OCCASION_RULES, A.DEFAULT_OCCASION))


def _domain(category: Column) -> tuple[Column, Column]:
    return category.contains("Grooming"), category.contains("Men")


def _fallbacks(category: Column, score: Column, table: dict) -> Column:
    grooming, men = _domain(category)
    high = score >= A.FALLBACK_SCORE
    both = lambda who: F.when(high, literals(table[(who, True)])).otherwise(literals(table[(who, False)]))
    return F.when(grooming & men, both("men")).when(grooming, both("women")).otherwise(both("outfit"))


def isolate_domain(category: Column, text: Column, score: Column) -> Column:
    """Drop lines about the other domain; top up to two lines from the fallbacks.

    Lines are cut into single words of letters, so two-word entries of the
    word lists never match.
    """
    grooming, _ = _domain(category)
    kept = _own_lines(F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda x: x != ""), grooming,
                      A.OUTFIT_WORDS, A.GROOMING_WORDS, "(?U)\\b[a-z]+\\b")
    fallback = _fallbacks(category, score, A.FALLBACK_LINES)
    missing = F.array_except(fallback, kept)
    topped = F.concat(kept, F.slice(missing, F.lit(1), F.greatest(F.lit(2) - F.size(kept), F.lit(0))))
    return F.array_join(F.when(F.size(kept) < 2, topped).otherwise(kept), "\n")


def isolate_domain_app(category: Column, advice_lines: Column, score: Column) -> Column:
    """App variant: both fallbacks are added, then at most four lines stay."""
    grooming, _ = _domain(category)
    kept = _own_lines(advice_lines, grooming, A.APP_OUTFIT_WORDS, A.APP_GROOMING_WORDS, "[\\p{L}\\p{M}\\p{N}]+")
    return F.slice(F.when(F.size(kept) < 2, F.concat(kept, _fallbacks(category, score, A.APP_FALLBACK_LINES)))
                   .otherwise(kept), 1, 4)


def _own_lines(all_lines: Column, grooming: Column, outfit: list[str], groom: list[str], token: str) -> Column:
    def clean(words: list[str]) -> Column:
        return F.filter(all_lines, lambda x: ~F.arrays_overlap(
            F.regexp_extract_all(F.lower(x), F.lit(token), F.lit(0)), literals(words)))
    return F.when(grooming, clean(outfit)).otherwise(clean(groom))


def priority_defect(category: Column, row: dict[str, Column]) -> Column:
    """Field with the highest severity above 0, earlier fields win ties, null if none."""
    def worst(fields: list[str]) -> Column:
        rated = [F.struct(F.coalesce(row[f].cast("int"), F.lit(0)).alias("s"), F.lit(-i).alias("o"),
                          F.lit(f).alias("n")) for i, f in enumerate(fields) if f in row]
        top = F.array_max(F.array(*rated))
        return F.when(top["s"] > 0, top["n"])
    grooming, men = category.endswith("Grooming"), category.startswith("Men")
    return (F.when(grooming & men, worst(A.GROOMING_DEFECTS + [A.MEN_DEFECT]))
            .when(grooming, worst(A.GROOMING_DEFECTS + [A.WOMEN_DEFECT])).otherwise(worst(A.OUTFIT_DEFECTS)))


def _level(row: dict, field: str, label: str) -> Column:
    value = F.coalesce(row[field].cast("int"), F.lit(0))
    return F.when(value > 0, _text(label + ": ", row[field].cast("string")))


def _mark(row: dict, field: str, word: str) -> Column:
    return F.when(F.coalesce(row[field].cast("int"), F.lit(0)) > 0, word)


def _joined(label: str, parts: list[Column]) -> Column:
    body = F.concat_ws(", ", *parts)
    return F.when(body != "", _text(f"- {label}: ", body))


def _or(row: dict, field: str, default) -> Column:
    return F.coalesce(row[field].cast("string"), F.lit(str(default)))


def tag_prompt(category: Column, occasion: Column, row: dict[str, Column], kind: str) -> Column:
    """Tag block of one label row. ``kind`` is ``outfit`` or ``grooming``; absent lines vanish."""
    women = category.startswith("Women")
    optional = lambda f: F.when(row[f].isNotNull(), _text(f"- {f}: ", row[f])) if f in row else F.lit(None)
    if kind == "outfit":
        worn = lambda f: F.coalesce(row[f], F.lit("none"))
        tags = [
            _text("- top: ", _or(row, "upper_type", "unknown"), " (pattern: ", _or(row, "upper_pattern", "solid"), ")"),
            F.when(~worn("mid_type").isin("none", ""), _text("- outer: ", worn("mid_type"))),
            F.when(~worn("lower_type").isin("none", ""),
                   _text("- bottoms: ", worn("lower_type"), " (pattern: ", _or(row, "lower_pattern", "solid"), ")")),
            _text("- shoes: ", _or(row, "footwear_type", "unknown")),
            _text("- formality: ", _or(row, "formality", "casual")),
            _joined("fit", [_level(row, "fit_baggy", "baggy_level"), _level(row, "fit_tight", "tight_level"),
                            _mark(row, "fit_tailored", "tailored")]),
            _joined("fabric", [_level(row, "fabric_wrinkled", "wrinkled_level"), _mark(row, "fabric_crisp", "crisp")]),
            _joined("footwear_condition", [_level(row, "footwear_worn", "worn_level"),
                                           _mark(row, "footwear_polished", "polished")]),
            optional("color_harmony"), optional("posture"), optional("lighting")]
    else:
        zero = lambda f: _or(row, f, 0)
        tags = [
            _text("- hair: ", _or(row, "hair_length", "short"), " (styled: ", zero("hair_styled"), ", untidy_level: ",
                  zero("hair_untidy"), ")"),
            _text("- skin: (neglected_level: ", zero("skin_neglected"), ", healthy: ", zero("skin_healthy"), ")"),
            _text("- eyebrows: (unkempt_level: ", zero("eyebrows_unkempt"), ", groomed: ", zero("eyebrows_groomed"),
                  ")"),
            F.when(women, _text("- makeup: ", _or(row, "makeup_style", "none"), " (uneven_level: ",
                                zero("makeup_uneven"), ")"))
            .otherwise(_text("- facial_hair: ", _or(row, "facial_hair_style", "clean_shaven"), " (untidy_level: ",
                             zero("facial_hair_untidy"), ")")),
            optional("posture"), optional("lighting")]
    head = [_text("Occasion: ", occasion), _text("Gender/Vibe: ", F.when(women, "Female").otherwise("Male")),
            F.lit("Tags:")]
    tail = [_text("- priority_defect: ", F.coalesce(priority_defect(category, row), F.lit("none"))),
            _text("- overall_score: ", fixed(F.coalesce(row["score"], F.lit(5.0)), 1), "/10")]
    return F.concat_ws("\n", *head, *tags, *tail)


def chat_prompt(system: Column, tag_block: Column) -> Column:
    return _text("<|im_start|>system\n", system, "<|im_end|>\n<|im_start|>user\n", tag_block,
                 "<|im_end|>\n<|im_start|>assistant\n")


def vocabulary_floor() -> list[str]:
    """Every term a vocabulary must keep: classes, signals, occasions, tag words."""
    terms = set()
    for gender in ("man", "woman"):
        for slot in ("upper", "mid", "lower", "footwear"):
            terms.update(G.classes_of(gender, slot))
    terms.discard("none")
    for values in (G.PATTERNS, G.FORMALITY_CLASSES, G.HAIR_LENGTHS, G.FACIAL_HAIR_STYLES, G.MAKEUP_STYLES,
                   A.OCCASIONS, A.POSTURES, A.LIGHTINGS, A.HARMONIES, A.TAG_WORDS):
        terms.update(values)
    return sorted(terms)
