"""Scores of findings and of extracted blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .ajax import count


def dynamic_code(code: Column) -> Column:
    """Struct of dynamic_code_detected, dynamic_count and dynamic_pattern: all matches, and the first group that matched."""
    counts = [(name, count(code, p)) for name, p in P.DYNAMIC_GROUPS]
    total = sum((c for _, c in counts[1:]), counts[0][1]).cast("long")
    first = F.coalesce(*(F.when(c > 0, F.lit(name)) for name, c in counts), F.lit(""))
    return F.struct((total > 0).alias("dynamic_code_detected"), total.alias("dynamic_count"), first.alias("dynamic_pattern"))


def logic_density_score(code: Column, ajax_detected: Column) -> Column:
    """Two for each logic structure, one for network calls, one for each listener; minus two where only selectors are seen."""
    low = F.lower(code)
    score = 2 * count(low, P.LOGIC) + F.when(ajax_detected, 1).otherwise(0) + count(low, P.LISTENERS)
    return F.when((count(low, P.SELECTORS) > 0) & (score < 2), score - 2).otherwise(score).cast("long")


def complexity(score: Column) -> Column:
    return F.when(score >= 5, "High").when(score >= 2, "Medium").otherwise("Low")


def server_severity(code: Column) -> Column:
    tests = (("High", P.SEVERITY_HIGH), ("Medium", P.SEVERITY_MEDIUM), ("Low", P.SEVERITY_LOW))
    return F.coalesce(*(F.when(code.rlike(P.JAVA + p), F.lit(name)) for name, p in tests), F.lit("None"))


def functionality(code: Column, ajax_detected: Column) -> Column:
    low = F.lower(code)
    out = F.when(ajax_detected, F.lit("Data/Network Operation"))
    for name, words in P.FUNCTIONALITY:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = out.when(hit, F.lit(name))
    return out.otherwise("General Logic")


def refactor_status(severity: Column, complexity_: Column) -> Column:
    return F.when(severity == "High", "Skipped (Blocked)").when(severity == "Medium", "Skipped (Rewrite)").when(complexity_ == "High", "Manual Review").otherwise("Ready")


def recommended_method(severity: Column, complexity_: Column) -> Column:
    return (
        F.when(severity == "High", "Remove Server Dependencies First")
        .when(severity == "Medium", "Refactor Server Config (API)")
        .when(complexity_ == "High", "Convert to Component (Complex Logic)")
        .otherwise("Move to separate file")
    )


def target_filename(rel_path: Column, code_type: Column, start: Column, end: Column, category: Column) -> Column:
    """Where a block should be extracted to: only letters and digits stay of its type."""
    kind = F.regexp_replace(code_type, r"(?U)[^\p{Alnum}]", "")
    return _block_name(F.translate(rel_path, "/.", "__"), kind, start, end, category)


def bundle_filename(rel_path: Column, code_type: Column, start: Column, end: Column, category: Column) -> Column:
    """The name that the bundler writes: what isn't a letter or digit of the type becomes an underscore."""
    kind = F.regexp_replace(code_type, r"(?U)[^\p{Alnum}]", "_")
    return _block_name(F.translate(F.replace(rel_path, F.lit(":"), F.lit("")), "/\\.", "___"), kind, start, end, category)


def _block_name(path: Column, kind: Column, start: Column, end: Column, category: Column) -> Column:
    ext = F.when(category == "JS", ".js").otherwise(".css")
    return F.concat(path, F.lit("_"), kind, F.lit("_L"), start.cast("string"), F.lit("-L"), end.cast("string"), ext)


def parse_extracted_filename(name: Column) -> Column:
    """Struct of original_path, line_range, code_type, start_line and end_line, read out of an extracted file's name."""
    group = lambda k: F.regexp_extract(name, P.EXTRACTED_NAME, k)
    ok = name.rlike(P.EXTRACTED_NAME)
    return F.struct(
        F.when(ok, F.translate(group(1), "_", "/")).otherwise(name).alias("original_path"),
        F.when(ok, F.concat(group(3), F.lit("-"), group(4))).otherwise("Unknown").alias("line_range"),
        F.when(ok, group(2)).otherwise("Unknown").alias("code_type"),
        F.when(ok, F.nullif(group(3), F.lit("")).try_cast("long")).otherwise(0).alias("start_line"),
        F.when(ok, F.nullif(group(4), F.lit("")).try_cast("long")).otherwise(0).alias("end_line"),
    )


def razor_tokens(code: Column) -> Column:
    """All value tokens, pattern by pattern."""
    return F.concat(*(F.regexp_extract_all(code, F.lit("(?Ud)" + p), F.lit(0)) for p in P.RAZOR_VALUES))


def razor_state(code: Column) -> Column:
    """C with control flow, else B with values, else A."""
    return F.when(code.rlike(P.JAVA + "(?:" + "|".join(P.RAZOR_CONTROL) + ")"), "C").when(code.rlike("(?Ud)(?:" + "|".join(P.RAZOR_VALUES) + ")"), "B").otherwise("A")


def is_ajax_simple(code: Column) -> Column:
    return code.rlike(P.JAVA + "(?:" + "|".join(P.SIMPLE_AJAX) + ")")


def classify_code(name: Column, code: Column) -> Column:
    """Struct of state, complexity, status, action, reason, razor_tokens (how many) and is_ajax of an extracted block."""
    raw, css = razor_state(code), name.endswith(".css")
    tokens = F.when(raw == "B", razor_tokens(code)).otherwise(F.array().cast("array<string>"))
    hard_css = css & (raw == "B") & F.exists(tokens, lambda t: t.contains("@") & t.contains("("))
    state = F.when(hard_css, "C").otherwise(raw)
    ajax = ~css & is_ajax_simple(code)
    n = F.size(tokens)
    blocked, bridge = "Manual Intervention Required", "Auto-Refactor via Bridge"
    reason = (
        F.when(hard_css, "CSS contains complex Razor logic")
        .when(css & (state == "B"), "CSS contains simple Razor URL references")
        .when(css & (state == "C"), "CSS contains Razor control flow")
        .when(state == "A", "No server-side logic detected")
        .when((state == "B") & ajax, F.concat(F.lit("AJAX call with "), n.cast("string"), F.lit(" Razor tokens - Bridge Pattern applicable")))
        .when(state == "B", F.concat(F.lit("Contains "), n.cast("string"), F.lit(" Razor value tokens - Bridge Pattern applicable")))
        .otherwise("Contains Razor control flow - cannot auto-refactor")
    )
    return F.struct(
        state.alias("state"),
        F.when(state == "A", "High").when(state == "B", "Medium").otherwise("Low").alias("complexity"),
        F.when(state == "A", "Ready").when(state == "B", "Bridgeable").otherwise("Blocked").alias("status"),
        F.when(state == "A", F.when(css, "Externalized - Clean CSS").otherwise("Externalized - Clean Code")).when(state == "B", bridge).otherwise(blocked).alias("action"),
        reason.alias("reason"),
        n.cast("long").alias("razor_tokens"),
        F.when(ajax, "Yes").otherwise("No").alias("is_ajax"),
    )
