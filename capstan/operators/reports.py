"""Typed fields of investigation reports, and the rules that settle how many subject officials one has.

All are column expressions; an empty string means "not stated".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import flat, html_to_text, match_spans, to_iso_date, trimmed

# The fields, whether each is a count, and what it holds.
FIELDS = (
    ("police_service", False, "police service involved"),
    ("date_of_incident_iso", False, "date of the incident"),
    ("date_siu_notified_iso", False, "date of notification"),
    ("date_of_director_decision_iso", False, "date of the director's decision"),
    ("siu_investigators", True, "investigators assigned"),
    ("siu_forensics_investigators", True, "forensic investigators assigned"),
    ("number_of_subject_officers", True, "subject officials"),
    ("number_of_witness_officials", True, "witness officials"),
    ("number_of_civilian_witnesses", True, "civilian witnesses"),
    ("age_affected", False, "age of the affected person"),
    ("sex_gender_affected", False, "sex or gender of the affected person"),
    ("charges_recommended", False, "TRUE, FALSE or not stated"),
    ("directors_name", False, "name of the director"),
    ("location_of_call", False, "municipality of the call"),
    ("specific_injuries", False, "injuries named"),
    ("relevant_legislation", False, "acts named"),
)

# Headings, phrases and patterns of the reports.
DATE = r"[A-Z][a-z]+\s+\d{1,2},?\s+\d{4}"
SERVICE = r"((?:[A-Z][A-Za-z'\-]+\s+){1,5}(?:Police Service|Provincial Police|Police|Constabulary))"
SERVICE_LEAD = r"^(?:The|A|An|Of|And|On|In|By|To|With|From|That|This|Local)\s+"
SERVICE_SHORT = (("OPP", "Ontario Provincial Police"), ("TPS", "Toronto Police Service"), ("RCMP", "RCMP"), ("NRPS", "Niagara Regional Police Service"))
NOTIFY_NEAR = ("notified", "contacted the siu", "notification of the siu")
LOCATION = r"in the (Township|City|Town|Municipality|Region) of ([A-Z][A-Za-z \-]+?)(?:[\.,]|\s+(?:on|at|when))"
AGE_SEX = r"(?i)\b(\d{1,3})[\s\-]year[\s\-]old\s+(woman|man|female|male|girl|boy|person|individual|youth|child|adult)\b"
INJURY = r"(?i)((?:fractured?|broken|lacerat\w+|gunshot|stab\w+|burns?)[^\n]{1,200}?(?:rib|leg|arm|skull|wrist|ankle|jaw|nose|tooth|finger|spine|vertebra)[^\n]{0,80})"
ACT = r"Section\s+\d+(?:\([^)]+\))?,?\s+([A-Z][^\n,]{2,80}?)(?:\s*[-]|\s*$|\n)"
NO_CHARGES = ("no charges", "shall issue", "none shall issue", "no basis for charges", "no reasonable grounds", "do not lay", "decline to lay", "lack the necessary grounds")
CHARGES = ("charged with", "criminal charges have been laid", "charges have been laid")
DIRECTOR = r"([A-Z][A-Za-z.'\-]+(?:\s+[A-Z][A-Za-z.'\-]+){1,3})\s*,?\s*\n?\s*Director\b"
ENGLISH = ("The Investigation", "Notification of the SIU", "Mandate engaged", "Civilian Witnesses", "Witness Officers", "Subject Officers", "Analysis and Director's Decision", "Witness Officials")
FRENCH = ("L'enquête", "Exercice du mandat", "Éléments de preuve", "Dispositions législatives pertinentes", "Témoins civils", "Agents impliqués", "Mandat de l'UES")
PRIVACY = r"(?is)this information may include.*?(?:affected person|evidence)\.?"
GLOSSARY = r"(?is)who,?\s+in the (?:opinion of the SIU Director|SIU Director(?:'|’)?s opinion),?.{0,120}?not a subject offic(?:er|ial)[^.]*\.?"
ORDINALS = (r"\bSO\s*#\s*(\d{1,2})\b", r"(?i)subject offic(?:er|ial)\s*#\s*(\d{1,2})\b")
ROSTER = r"(?s)Subject Offic(?:er|ial)s\b(.{0,2500})"
ROSTER_END = r"\n\s{0,3}(?:Witness Offic(?:er|ial)s|Civilian Witness(?:es)?|Service Employee Witness|Incident Narrative|Materials [Oo]btained|The Scene|Evidence\n|Nature of Injur)"
ROSTER_ENTRY = r"\bSO\s*(?:#\s*\d{1,2})?\s{0,3}(?:Interviewed|Declined|Did not consent|Not interviewed)"
FIRST_ORDINAL = r"\bSO\s*#\s*1\b|subject offic(?:er|ial)\s*#\s*1\b"
PLURAL = r"(?i)\bthe\s+(\d{1,2}|one|two|three|four|five|six|seven|eight|nine|ten)\s+subject offic(?:er|ial)s\b"
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
THE_SO, THE_SUBJECT = r"\b[Tt]he SO\b", r"(?i)\bthe subject offic(?:er|ial)\b"
MANY = r"(?i)\bthe SOs\b|the subject offic(?:er|ial)s\b"
NOBODY = r"(?i)no subject offic(?:er|ial)s?\b|(?:did not|not|never)\s+designated?\s+(?:a\s+|any\s+)?subject offic"


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIELDS), "name string, is_count boolean, description string")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands there: searches are not copied into what reads them."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _or_else(*options: Column) -> Column:
    """The first that is not empty, else empty."""
    out = F.lit("")
    for option in reversed(options):
        rest = out
        out = _once(option, lambda v: F.when(v != "", v).otherwise(rest))
    return out


def section(text: Column, header: str, ends: tuple[str, ...]) -> Column:
    """What follows the first line that is the header, up to the first line that is one of ``ends``."""
    stop = "|".join(rf"\Q{e}\E" for e in ends)
    return _first(text, rf"(?dms)^[ \t]*\Q{header}\E[ \t]*\n(.*?)(?=^[ \t]*(?:{stop})[ \t]*\n|\z)")


def team_count(text: Column, label: str) -> Column:
    return _first(text, rf"(?i)Number of {label}[^0-9\n]{{0,30}}(\d+)")


def count_tagged(text: Column, prefix: str) -> Column:
    """The highest number of a tag such as `SO #2`; 1 for a bare mention, else empty."""

    def of(line: Column) -> Column:
        found = F.transform(F.regexp_extract_all(line, F.lit(rf"\b{prefix}\s*#?\s*(\d+)\b"), F.lit(1)), lambda n: n.try_cast("int"))
        return _once(F.coalesce(F.array_max(found), F.lit(0)), lambda most: F.when(most > 0, most.cast("string")).when(line.rlike(rf"\b{prefix}\b"), "1").otherwise(""))

    return _once(text, lambda t: F.when(t == "", "").otherwise(_once(flat(t), of)))


def police_service(text: Column) -> Column:
    """The capitalised phrase ending in a police word that occurs most often; ties go to the longer, then the first."""

    def clean(name: Column) -> Column:
        name = trimmed(name)
        for _ in range(3):
            name = F.regexp_replace(name, SERVICE_LEAD, "")
        return name

    names = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SERVICE), F.lit(1)), clean), lambda n: n != "")

    def ranked(found: Column) -> Column:
        return F.transform(F.array_distinct(found), lambda n: F.struct((-F.size(F.filter(found, lambda m: m == n))).alias("times"), (-F.length(n)).alias("size"), n.alias("name")))

    short = F.lit("")
    for tag, full in reversed(SERVICE_SHORT):
        short = F.when(text.rlike(rf"\b{tag}\b"), F.lit(full)).otherwise(short)
    return F.coalesce(F.array_min(_once(names, ranked))["name"], short)


def incident_date(text: Column) -> Column:
    """First `On <date>` of the narrative, else of the investigation, that stands near no notification."""
    ends = ("Nature of Injuries", "Evidence", "The Team", "Analysis and Director", "Relevant Legislation")
    pattern = rf"\b[Oo]n\s+({DATE})"

    def of(body: Column) -> Column:
        def far(span: Column) -> Column:
            first = F.greatest(span["start"] - 50, F.lit(0))
            near = F.lower(F.substr(body, first + 1, span["end"] + 80 - first))
            clear = F.lit(True)
            for phrase in NOTIFY_NEAR:
                clear = clear & ~F.contains(near, F.lit(phrase))
            return clear

        spans = F.filter(match_spans(body, pattern), far)
        found = _once(F.get(spans, F.lit(0)), lambda one: F.substr(body, one["start"] + 1, one["end"] - one["start"]))
        return F.coalesce(F.replace(_first(found, pattern), F.lit(","), F.lit("")), F.lit(""))

    return _or_else(*(_once(section(text, header, ends), of) for header in ("Incident Narrative", "The Investigation")))


def notified_date(text: Column) -> Column:
    notice = section(text, "Notification of the SIU", ("The Team", "Incident Narrative", "Evidence"))

    def of(body: Column) -> Column:
        forms = (
            _first(body, rf"\b[Oo]n\s+(?:[A-Z][a-z]+,?\s+)?({DATE})[^\n]{{0,200}}?(?:notified|contacted)\s+the\s+SIU"),
            _first(body, rf"(?:notified|contacted)\s+the\s+SIU[^\n]{{0,200}}?[Oo]n\s+({DATE})"),
            _first(notice, rf"On\s+({DATE})"),
        )
        return F.replace(_or_else(*forms), F.lit(","), F.lit(""))

    return _once(_or_else(section(text, "The Investigation", ("The Team", "Incident Narrative")), text), of)


def decision_date(text: Column) -> Column:
    return _or_else(F.replace(_first(text, rf"Date:\s*({DATE})"), F.lit(","), F.lit("")), _first(text, r"Date:\s*(\d{4}-\d{2}-\d{2})"))


def location(text: Column) -> Column:
    line = flat(_or_else(section(text, "The Investigation", ("The Team", "Incident Narrative")), text))
    return _once(line, lambda x: _once(_first(x, LOCATION), lambda kind: F.when(kind == "", "").otherwise(F.concat(kind, F.lit(" of "), trimmed(_first(x, LOCATION, 2))))))


def legislation(text: Column) -> Column:
    body = section(text, "Relevant Legislation", ("Analysis and Director", "News Releases"))
    return F.array_join(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(ACT), F.lit(1)), trimmed)), "; ")


def _has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def charges_of_section(body: Column) -> Column:
    return _once(F.lower(body), lambda low: F.when(low == "", "").when(_has_any(low, NO_CHARGES), "FALSE").when(_has_any(low, CHARGES), "TRUE").otherwise(""))


def charges(text: Column) -> Column:
    ends = ("Endnotes", "News Release", "Note:")
    return charges_of_section(_or_else(*(section(text, f"Analysis and Director{mark}s Decision", ends) for mark in ("'", "’"))))


def director(text: Column) -> Column:
    return _once(trimmed(_first(text, DIRECTOR)), lambda name: F.when(F.contains(F.lower(name), F.lit("the")), "").otherwise(name))


def language(text: Column) -> Column:
    def marks(phrases: tuple[str, ...]) -> Column:
        return sum((F.contains(text, F.lit(p)).cast("int") for p in phrases), F.lit(0))

    e, f = marks(ENGLISH), marks(FRENCH)
    return F.when((e >= 2) & (e > f), "en").when((f >= 2) & (f > e), "fr").otherwise("unknown")


def fields(text: Column) -> dict[str, Column]:
    """All fields of a report's text, by name."""
    subject = _or_else(
        section(text, "Subject Officers", ("Incident Narrative", "Evidence", "Witness Officers")),
        section(text, "Subject Officials", ("Incident Narrative", "Evidence", "Witness Officials")),
    )
    witness = _or_else(
        section(text, "Witness Officers", ("Incident Narrative", "Evidence", "Subject Officers")),
        section(text, "Witness Officials", ("Incident Narrative", "Evidence", "Subject Officials")),
    )
    civilian = section(text, "Civilian Witnesses", ("Incident Narrative", "Evidence", "Witness Officers", "Witness Officials"))
    nobody = lambda w: (w != "") & F.lower(flat(w)).rlike("no police officers? witness")
    return {
        "_language": language(text),
        "police_service": police_service(text),
        "date_of_incident_iso": _once(incident_date(text), to_iso_date),
        "date_siu_notified_iso": _once(notified_date(text), to_iso_date),
        "date_of_director_decision_iso": _once(decision_date(text), to_iso_date),
        "siu_investigators": team_count(text, "SIU Investigators"),
        "siu_forensics_investigators": team_count(text, "SIU Forensic Investigators"),
        "number_of_subject_officers": count_tagged(_or_else(subject, text), "SO"),
        "number_of_witness_officials": _once(witness, lambda w: F.when(nobody(w), "0").otherwise(count_tagged(w, "WO"))),
        "number_of_civilian_witnesses": count_tagged(civilian, "CW"),
        "age_affected": _first(text, AGE_SEX),
        "sex_gender_affected": F.lower(_first(text, AGE_SEX, 2)),
        "charges_recommended": charges(text),
        "directors_name": director(text),
        "location_of_call": location(text),
        "specific_injuries": trimmed(_first(text, INJURY)),
        "relevant_legislation": legislation(text),
    }


def parse_reports(df: DataFrame, html: str = "html", is_text: bool = False) -> DataFrame:
    """``df`` with the fields, from HTML or from text. The text is made once and not copied into each field."""
    body = F.coalesce(F.col(html), F.lit(""))
    texts = df.select("*", F.explode(F.array(body if is_text else html_to_text(body))).alias("_text"))
    return texts.select(*df.columns, *(c.alias(n) for n, c in fields(F.col("_text")).items()))


def without_boilerplate(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), PRIVACY, " "), GLOSSARY, " ")


def _highest(text: Column) -> Column:
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ORDINALS))
    return F.coalesce(F.array_max(F.transform(found, lambda n: n.cast("int"))), F.lit(0))


def subject_officials(report: Column) -> Column:
    """Struct of count (null where a person must read it) and reason. Rules go from the roster to single mentions."""
    body = without_boilerplate(report)
    after = _first(body, ROSTER)
    roster = _first(after, rf"(?s)\A(.*?)(?={ROSTER_END}|\z)")
    ordinal, entries = _highest(roster), F.size(F.regexp_extract_all(roster, F.lit(ROSTER_ENTRY), F.lit(0)))
    listed, anywhere = F.greatest(ordinal, entries), _highest(body)
    word = F.lower(_first(body, PLURAL))
    spelled = F.array_position(F.array(*(F.lit(n) for n in NUMBERS)), word).cast("int")
    number = F.when(spelled > 0, spelled).otherwise(word.try_cast("int"))
    the_so, the_subject = (F.size(F.regexp_extract_all(body, F.lit(p), F.lit(0))) for p in (THE_SO, THE_SUBJECT))

    def result(count: Column, *reason: Column) -> Column:
        return F.struct(count.cast("int").alias("count"), F.concat(*(r.cast("string") for r in reason)).alias("reason"))

    return (
        F.when(listed > 0, result(listed, F.lit("section: max(ordinal "), ordinal, F.lit(", entries "), entries, F.lit(")")))
        .when((anywhere > 0) & body.rlike(FIRST_ORDINAL), result(anywhere, F.lit("max ordinal SO #"), anywhere))
        .when(word != "", result(number, F.lit("plural cue '"), _first(body, PLURAL, 0), F.lit("'")))
        .when((the_so + the_subject >= 1) & ~body.rlike(MANY), result(F.lit(1), F.lit("singular present: 'the SO'x"), the_so, F.lit(" 'the subject official'x"), the_subject))
        .when(body.rlike(NOBODY), result(F.lit(0), F.lit("zero: witness-officer-only / 'not a subject official'")))
        .otherwise(result(F.lit(None), F.lit("UNRESOLVED: 'the SO'x"), the_so, F.lit(" 'the subj off'x"), the_subject))
    )
