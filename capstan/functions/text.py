"""Scalar text functions as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to one letter, and what they fold to, place by place.
FOLD_FROM = (
    "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝ"
    "àáâãäåçèéêëìíîïðñòóôõöøùúûüýÿ"
    "ĀāĄąĆćČčĎďĐđĒēĘęĚěĞğİıŁłŃńŇňŌōŐőŘřŚśŞşŠšŤťŪūŮůŰűŹźŻżŽž"
)
FOLD_TO = (
    "AAAAAACEEEEIIIIDNOOOOOOUUUUY"
    "aaaaaaceeeeiiiidnoooooouuuuyy"
    "AaAaCcCcDdDdEeEeEeGgIiLlNnNnOoOoRrSsSsSsTtUuUuUuZzZzZz"
)
# Letters that fold to two.
FOLD_PAIRS = (("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("Þ", "Th"), ("þ", "th"))
# English month names, in order.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Causes of a failed download and the words by which they are told.
DOWNLOAD_CAUSES = (
    ("rate_limited", "429|too many|rate"),
    ("tls", "SSL|TLS|certificate|handshake|UNEXPECTED_EOF"),
    ("dns", "could not|unable to resolve|name not|getaddrinfo"),
    ("timeout", "timeout|timed out|connection (refused|reset)"),
    ("forbidden", "403|forbidden"),
)


def fold_latin(x: Column) -> Column:
    """Latin letters without their marks; all else that is not ASCII is dropped."""
    out = F.translate(x, FOLD_FROM, FOLD_TO)
    for a, b in FOLD_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


# Greek and Cyrillic letters and their Latin images without marks, place by place. Capitals follow from these.
CYRILLIC, CYRILLIC_TO = "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґўџљњћђј", "abvgdeezzijklmnoprstufhccss\"y'euaiiegudlnccj"
GREEK, GREEK_TO = "αβγδεζηικλμνξοπρσςτυωϊϋ", "abgdezeiklmnxoprsstyoiy"
GREEK_MARKED, GREEK_PLAIN = "άέήίόύώΐΰ", "αεηιουωϊϋ"
# Letters that become two.
GREEK_PAIRS = {"θ": "th", "φ": "ph", "χ": "ch", "ψ": "ps"}


def romanise(x: Column) -> Column:
    """Greek and Cyrillic letters in Latin ones without marks; all else as it is.

    The longest match counts: `ου`, `αυ`, `ευ` and `ηυ` have a u, and `γ` before `γ`, `κ`, `ξ` or `χ` is an n; with a
    diaeresis or an accent on the first vowel they are letters of their own.
    """
    both = lambda s: s + s.upper()
    letter = {a: b for a, b in zip(GREEK + CYRILLIC, GREEK_TO + CYRILLIC_TO)}
    capital = {a.upper(): b.upper() for a, b in letter.items() if len(a.upper()) == 1 and a.upper() != a and a != "ς"}
    out = F.regexp_replace(x, "(?<=[αεηοΑΕΗΟ])[υύ]", "u")
    out = F.regexp_replace(F.regexp_replace(out, "(?<=[αεηοΑΕΗΟ])[ΥΎ]", "U"), "γ(?=[γκξχΓΚΞΧ])", "n")
    out = F.translate(F.regexp_replace(out, "Γ(?=[γκξχΓΚΞΧ])", "N"), both(GREEK_MARKED[:-2]) + GREEK_MARKED[-2:], both(GREEK_PLAIN[:-2]) + GREEK_PLAIN[-2:])
    for a, b in GREEK_PAIRS.items():
        out = F.replace(F.replace(out, F.lit(a), F.lit(b)), F.lit(a.upper()), F.lit(b.capitalize()))
    table = letter | capital
    out = F.translate(out, "".join(table), "".join(table.values()))
    return F.when(x.rlike("[\\u0370-\\u03ff\\u0400-\\u04ff]"), out).otherwise(x)


def to_ascii(x: Column) -> Column:
    """Romanised and folded text of printable ASCII alone; null becomes empty, letters of other scripts are dropped."""
    return F.regexp_replace(fold_latin(romanise(F.coalesce(x, F.lit("")))), r"[^\x20-\x7E]", "")


def ascii_fallback(x: Column, force: bool = False) -> Column:
    """Valid UTF-8 as it is, else (or where forced) its ASCII form; null stays null."""
    if force:
        return F.when(x.isNotNull(), to_ascii(x))
    return F.when(F.is_valid_utf8(x), x).otherwise(F.when(x.isNotNull(), to_ascii(F.make_valid_utf8(x))))


def html_to_text(html: Column) -> Column:
    """Text of a page with its lines: nine replacements in order."""
    # Fixed values.
    steps = (
        (r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "),
        (r"(?i)</(?:p|div|h[1-6]|tr|li|br)>|<br\s*/?>", "\n"),
        (r"<[^>]+>", " "),
        (r"&nbsp;", " "),
        (r"&amp;", "&"),
        (r"&#8217;|&rsquo;", "'"),
        (r"[ \t]+", " "),
        (r" ?\n ?", "\n"),
        (r"\n{3,}", "\n\n"),
    )
    for pattern, by in steps:
        html = F.regexp_replace(html, pattern, by)
    return html


def anchor_text(html: Column) -> Column:
    """Inner text of a link: tags removed, four entities decoded, blanks collapsed."""
    # The entities and what they stand for.
    out = F.regexp_replace(html, r"<[^>]+>", "")
    for pattern, by in ((r"&amp;", "&"), (r"&#0?39;|&rsquo;", "'"), (r"&nbsp;", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.btrim(out)


def trimmed(x: Column) -> Column:
    """Without blanks at both ends, nor commas, semicolons and colons at the end."""
    return F.regexp_replace(F.regexp_replace(x, r"^[ \t\r\n]+", ""), r"[ \t\r\n,;:]+$", "")


def flat(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def to_iso_date(x: Column) -> Column:
    """First `Month D, YYYY` anywhere as YYYY-MM-DD, an ISO date as it is, else empty. Days are not checked."""
    pattern = r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(F.regexp_extract(x, pattern, 1)))
    day = F.nullif(F.regexp_extract(x, pattern, 2), F.lit("")).cast("int")
    named = F.format_string("%s-%02d-%02d", F.regexp_extract(x, pattern, 3), month.cast("int"), day)
    found = F.regexp_extract(x, pattern, 0) != ""
    return F.when(x.isNull(), "").when(found & (month > 0), named).when(found, "").when(x.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), x).otherwise("")


def download_causes(message: Column) -> Column:
    """All causes that a download error's message names, in the listed order."""
    return F.array_compact(F.array(*(F.when(message.rlike("(?i)" + p), F.lit(c)) for c, p in DOWNLOAD_CAUSES)))


def url_encode(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def upper_first(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def file_extension(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"\.([^.]+)$", 1))


def base_name(x: Column) -> Column:
    return F.regexp_extract(x, r"([^/]*)$", 1)


def words_only(x: Column) -> Column:
    """Runs of what is no letter or digit as single spaces."""
    return F.btrim(F.regexp_replace(x, r"[^A-Za-z0-9]+", " "))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sha256(x: Column) -> Column:
    """Lower-case hex digest; null stays null."""
    return F.sha2(x.cast("binary"), 256)


def sha256_check(actual: Column, expected: Column) -> Column:
    return F.struct(actual.alias("actual"), expected.alias("expected"), actual.eqNullSafe(expected).alias("match"))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end) of all matches, in characters, from the lengths of what lies between them."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def further(s: Column, x: Column) -> Column:
        a = s["at"] + x["g"]
        return F.when(x["h"].isNull(), s).otherwise(F.struct((a + x["h"]).alias("at"), F.concat(s["found"], F.array(F.struct(a.alias("start"), (a + x["h"]).alias("end")))).alias("found")))

    return F.when(F.size(hits) > 0, F.aggregate(sizes, state, further)["found"]).otherwise(none)
