"""Network calls in code: matches with their lines, classification, endpoints and server dependencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .arrays import let, running_sums

#: Characters from which a text is reduced to what is near needles.
LONG_TEXT = 1000
MATCHES = "array<struct<line:long,text:string>>"
DETAILS = "array<struct<line:long,code_snippet:string,category:string,capability:string,difficulty:string,is_counted:string,endpoint:string>>"


def count(content: Column, pattern: str) -> Column:
    return F.regexp_count(content, F.lit(P.JAVA + pattern))


def _feeds(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def matches(content: Column, pattern: str) -> Column:
    """All matches in order with their 1-based line: line feeds in the pieces and matches before it, plus one."""
    p = P.JAVA + pattern

    def lines(texts: Column) -> Column:
        pieces = F.slice(F.split(content, p, -1), 1, F.size(texts))
        ends = running_sums(F.zip_with(texts, pieces, lambda t, b: _feeds(b) + _feeds(t)))
        rows = F.zip_with(texts, ends, lambda t, end: F.struct((end - _feeds(t) + 1).alias("line"), t.alias("text")))
        return F.when(F.size(texts) > 0, rows).otherwise(F.array()).cast(MATCHES)

    return let(F.regexp_extract_all(content, F.lit(p), F.lit(0)), lines)


def has_needle(text: Column) -> Column:
    """Whether a text holds any of AJAX_NEEDLES, letters folded as the patterns fold them."""

    def test(low: Column) -> Column:
        hit = F.lit(False)
        for n in P.AJAX_NEEDLES:
            hit = hit | (low.rlike(n[3:]) if n.startswith("re:") else low.contains(n))
        return hit

    plain = text
    for odd, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        plain = F.replace(plain, F.lit(odd), F.lit(letter))
    return let(F.lower(plain), test)


def near_needles(content: Column) -> Column:
    """The text with all pieces but those with a needle, and the ones after these, reduced to a mark and their line feeds.

    No match is lost or made: a mark is no part of any, and pieces end where no match runs on but into the next one.
    """
    mark = F.lit("\u0001")
    less = lambda p: F.when(p.contains("\n"), F.regexp_replace(p, r"[^\n]+", "\u0001")).otherwise(mark)

    def of_pieces(pieces: Column) -> Column:
        kept = lambda live: F.transform(pieces, lambda p, k: F.when(F.get(live, k) | F.coalesce(F.get(live, k - 1), F.lit(False)), p).otherwise(less(p)))
        return F.array_join(let(F.transform(pieces, has_needle), kept), "")

    whole = F.lower(content).contains(P.IFRAME)
    return F.when(whole, content).otherwise(let(F.regexp_extract_all(content, F.lit(P.AJAX_PIECE), F.lit(0)), of_pieces))


def ajax_matches(content: Column) -> Column:
    """Matches of the network calls; in longer texts the alternation runs only near texts that one of its parts needs."""
    near = F.when(F.length(content) < LONG_TEXT, content).otherwise(near_needles(content))
    return F.when(has_needle(content), let(near, lambda text: matches(text, P.AJAX_FAST))).otherwise(F.array().cast(MATCHES))


def _rules(profile: str):
    for texts, no, capability, category, counted, difficulty, other in P.AJAX_RULES:
        if profile == "static":
            if other.get("skip"):
                continue
            counted, difficulty = other.get("counted", counted), other.get("difficulty", difficulty)
        yield texts, no, capability, category, counted, difficulty


def classify(text: Column, profile: str = "depth") -> Column:
    """Struct of category, capability, difficulty and is_counted (Yes or No) by the first rule that the match's text meets."""
    if profile not in ("depth", "static"):
        raise ValueError("profile is depth or static")
    row = lambda cap, cat, yes, hard: F.struct(F.lit(cat).alias("category"), F.lit(cap).alias("capability"), F.lit(hard).alias("difficulty"), F.lit("Yes" if yes else "No").alias("is_counted"))

    def first(low: Column) -> Column:
        chain = None
        for texts, no, cap, cat, yes, hard in _rules(profile):
            hit = low.contains(texts[0])
            for t in texts[1:]:
                hit = hit | low.contains(t)
            if no:
                hit = hit & ~low.contains(no)
            chain = F.when(hit, row(cap, cat, yes, hard)) if chain is None else chain.when(hit, row(cap, cat, yes, hard))
        return chain.otherwise(row(*P.AJAX_DEFAULT))

    return let(F.lower(text), first)


def classify_sql(text: str, field: int, profile: str = "depth") -> str:
    """The same rules as a SQL CASE; field 0 to 3: capability, category, counted, difficulty."""
    out = ["case"]
    quote = lambda x: "'" + ("Yes" if x is True else "No" if x is False else x).replace("'", "''") + "'"
    for texts, no, *made in _rules(profile):
        test = " or ".join(f"contains(lower({text}), {quote(t)})" for t in texts)
        out.append(f"when ({test})" + (f" and not contains(lower({text}), {quote(no)})" if no else "") + f" then {quote(made[field])}")
    return " ".join([*out, f"else {quote(P.AJAX_DEFAULT[field])} end"])


def endpoint(code: Column, match: Column) -> Column:
    """The url that a call goes to, from the first 1000 characters of its code; markers where it isn't literal."""
    head = F.substring(code, 1, 1000)
    got = lambda p: F.nullif(F.regexp_extract(head, P.JAVA + p, 1), F.lit(""))
    none = F.lit(None).cast("string")
    special = (
        F.when(match.contains("fetch"), F.coalesce(got(P.FETCH_TEMPLATE), got(P.FETCH_LITERAL)))
        .when(match.contains("jquery") | match.contains("$"), got(P.JQUERY_LITERAL))
        .when(match.contains("axios"), got(P.AXIOS_LITERAL))
        .otherwise(none)
    )
    literal = got(P.URL_PROPERTY)
    own = F.when(literal.contains("@") | literal.contains("<%"), F.lit("Server-Generated")).otherwise(literal)
    variable = F.when(got(P.URL_VARIABLE).isNotNull(), F.lit("Dynamic/Variable"))
    return F.coalesce(special, got(P.URL_TEMPLATE), own, got(P.URL_CONCAT), variable, F.lit("Unknown/Dynamic"))


def details(code: Column, first_line: Column, profile: str = "static", with_endpoint: bool = True) -> Column:
    """All matches of a piece of code, classified; lines count from ``first_line``."""

    def one(m: Column) -> Column:
        return let(
            classify(m["text"], profile),
            lambda c: F.struct(
                (first_line + m["line"] - 1).cast("long").alias("line"),
                F.substring(m["text"], 1, 100).alias("code_snippet"),
                c["category"].alias("category"),
                c["capability"].alias("capability"),
                c["difficulty"].alias("difficulty"),
                c["is_counted"].alias("is_counted"),
                (endpoint(code, m["text"]) if with_endpoint else F.lit(None).cast("string")).alias("endpoint"),
            ),
        )

    return F.transform(ajax_matches(code), one)


def has_server_deps(code: Column) -> Column:
    return code.rlike(P.JAVA + "(?:" + "|".join(P.SERVER_DEPENDENCIES) + ")")


def is_inline_ajax(path: Column) -> Column:
    """False in .js files only."""
    return ~F.lower(path).endswith(".js")


def counted(details_: Column) -> Column:
    return F.size(F.filter(details_, lambda d: d["is_counted"] == "Yes")).cast("long")
