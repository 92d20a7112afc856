"""Secret scans: fixed patterns, and multipart credentials linked by an interval join within scopes.

The base spans are matches of three patterns. Besides them, weak candidates (identifiers such as account names and mail addresses, short
or unlabelled secrets, endpoints such as addresses of services and machines) are collected with their positions; on their own they mean
little. A scope is the interval between two blank lines, as far as REACH code points around a part. The intervals of parts and scopes
are joined by one sorted sweep over a text's starts, and a weak candidate is reported only if its scope also holds a part
of a complementary role: a secret beside an identifier or an endpoint, either of these beside a secret. Texts without any
secret are not searched for the other parts.

All of it is DataFrame functions. Positions come from the lengths of what lies between matches.

Defined results: null counts as an empty text without spans; rows that repeat are each given their spans (rows
with one id and different texts are kept apart); empty tables give empty tables; parts that start at one place are
ordered by kind; very long texts are matched whole, with work near linear in their matches; extra columns pass through,
those named like the outputs are replaced. Spans count code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import held, staged, table

#: Base kinds in the order in which they are listed.
BASE_KINDS = ("assign", "access", "hex")
#: The patterns of the base kinds. A base match that is too short is dropped.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6

#: Weak candidates by kind: role and pattern.
WEAK = {
    "identifier": ("identifier", r"""(?i:access_?key_?id|client_?id|user_?name|user|login|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""),
    "credential": ("secret", r"""(?i:pwd|pass|private_?key|access_?key|auth|credential|signature)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""),
    "opaque": ("secret", r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{16,}={0,2}"),
    "endpoint": ("endpoint", r"""(?i:https?|ftp|ssh|jdbc:[a-z]{1,20}|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]{3,}"""),
    "mailbox": ("identifier", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"),
    "machine": ("endpoint", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])(?::[0-9]{1,5})?"),
}
ROLE_OF_BASE = {"assign": "secret", "access": "identifier", "hex": "secret"}
ROLES = ("identifier", "secret", "endpoint")
#: What a weak candidate of a role needs within reach: all roles of one of the sets.
NEEDS = {"identifier": (("secret",),), "secret": (("identifier",), ("endpoint",)), "endpoint": (("secret",),)}
#: Code points between a candidate and its complement.
REACH = 400
BLANK_LINE = r"\n[\x20\t]*\n"
#: Outputs that are gathered at a time while an array is scanned.
BLOCK = 128


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often and in whatever lambda it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scanned(steps: Column, state: Column, step, kind: str) -> Column:
    """What ``step(state, element)``, a struct of the next ``state`` and of ``out`` (of type ``kind``), gives out along an array.

    An array that grows by one element is copied each time; outputs are therefore gathered in blocks, and the blocks
    put together at the end, so the work stays near linear in the array.
    """
    empty = F.array().cast(f"array<{kind}>")

    def inside(acc: Column, element: Column) -> Column:
        return let(step(acc["state"], element), lambda done: F.struct(done["state"].alias("state"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

    def blocks_of(whole: Column) -> Column:
        def block(acc: Column, i: Column) -> Column:
            done = F.aggregate(F.slice(whole, i * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["state"].alias("state"), empty.alias("out")), inside)
            return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(whole) / BLOCK).cast("int") - 1))
        return F.flatten(F.aggregate(numbers, F.struct(state.alias("state"), F.array(empty).alias("out")), block)["out"])

    return let(steps, blocks_of)


_SPAN = "struct<start:int,end:int,size:int>"


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, size) of the matches, leftmost and non-overlapping, in code points; size is the group's length."""

    def step(at: Column, x: Column) -> Column:
        first = at + x["gap"]
        end = first + x["hit"]
        return F.struct(end.alias("state"), F.struct(first.alias("start"), end.alias("end"), x["size"].alias("size")).alias("out"))

    def spans(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
        steps = F.zip_with(pairs, sizes, lambda p, v: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), F.length(v).alias("size")))
        return scanned(steps, F.lit(0), step, _SPAN)

    none = F.array().cast(f"array<{_SPAN}>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(none))
    return F.when(text.rlike(pattern), found).otherwise(none)  # most texts need one pass only


def _named(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start and then kind."""
    assigned = F.filter(spans_of(text, ASSIGN, 1), lambda s: s["size"] >= LEAST_ASSIGNED)
    return F.array_sort(F.concat(_named(assigned, "assign", 0), _named(spans_of(text, ACCESS), "access", 1), _named(spans_of(text, HEX), "hex", 2)))


def find_parts(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """own (the row without its text, as a struct), id, text_key, base, weak and breaks (where blank lines end a scope)."""
    ranked = [(kind, role, p, len(BASE_KINDS) + i) for i, (kind, (role, p)) in enumerate(WEAK.items())]
    some = lambda met: F.concat(*(_named(spans_of(F.col("body"), p), kind, i) for kind, role, p, i in ranked if met(role)))
    own = F.struct(*(c for c in docs.columns if c != text))
    texts = docs.select(own.alias("own"), F.col(id_column).alias("id"), F.xxhash64(F.col(text)).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = held(texts, base_spans(F.col("body")).alias("base"), some(lambda role: role == "secret").alias("secrets"))
    # Without a secret nothing links.
    any_secret = (F.size("secrets") > 0) | F.exists("base", lambda s: s["kind"].isin(*(k for k, r in ROLE_OF_BASE.items() if r == "secret")))
    weak = F.when(any_secret, F.concat("secrets", some(lambda role: role != "secret"))).otherwise(F.slice("secrets", 1, 0))
    found = held(found, weak.alias("weak")).drop("secrets")
    breaks = F.when(F.size("weak") > 0, _named(spans_of(F.col("body"), BLANK_LINE), "break", -1)).otherwise(F.slice("weak", 1, 0))
    return held(found, breaks.alias("breaks")).drop("body")


def link(parts: DataFrame, reach: int | None = REACH) -> DataFrame:
    """One row for each id and text_key with ``linked``, the weak candidates whose complements stand in their scope.

    ``reach`` bounds the code points between a candidate and its complement; None leaves it to the scope.
    """
    key = ["id", "text_key"]
    role = F.create_map(*(x for k, r in [*ROLE_OF_BASE.items(), *((k, r) for k, (r, _) in WEAK.items())] for x in (F.lit(k), F.lit(r))))
    rows = parts.filter(F.size("weak") > 0).select(*key, F.explode(F.concat("base", "weak", "breaks")).alias("part")).select(*key, "part.*").distinct().withColumn("role", role[F.col("kind")])
    is_base, is_break = F.col("rank").between(0, len(BASE_KINDS) - 1), F.col("rank") < 0
    # A weak candidate that meets a base span is that span's own text: some base span that starts before its end ends
    # after its start. Weak rows stand at their end, base rows at their start, behind the weak ones of the same place.
    at = Window.partitionBy(*key).orderBy(F.when(is_base, F.col("start")).otherwise(F.col("end")), is_base).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("met", F.coalesce(F.max(F.when(is_base, F.col("end"))).over(at), F.lit(0)))
    rows = rows.filter(is_base | is_break | (F.col("met") <= F.col("start"))).drop("met")
    # A scope's interval begins behind a blank line; parts belong to the scope of their start.
    rows = rows.withColumn("scope", F.count(F.when(is_break, 1)).over(Window.partitionBy(*key).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0))).filter(~is_break)
    scope, order = Window.partitionBy(*key, "scope"), ("start", "rank", "end")
    if reach is None:
        near = {r: F.max(F.col("role") == r).over(scope) for r in ROLES}
    else:
        ahead = scope.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        behind = scope.orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
        near = {}
        for r in ROLES:
            last, first = F.max(F.when(F.col("role") == r, F.col("end"))).over(ahead), F.min(F.when(F.col("role") == r, F.col("start"))).over(behind)
            near[r] = F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(first - F.col("end") <= reach, F.lit(False))
    rows = rows.select("*", *(c.alias(f"near_{r}") for r, c in near.items()))
    enough = F.lit(False)
    for r, sets in NEEDS.items():
        for needed in sets:
            met = F.col("role") == r
            for n in needed:
                met = met & F.col(f"near_{n}")
            enough = enough | met
    span = F.struct("start", "rank", "end", "kind")
    return rows.filter(enough & (F.col("rank") >= len(BASE_KINDS))).groupBy(*key).agg(F.array_sort(F.collect_set(span)).alias("linked"))


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``docs`` without its text but with text_key, base and linked (arrays of start, rank, end, kind)."""
    parts = staged(find_parts(docs, text, id_column), "secret-parts")  # spans only: the texts are read and matched once
    found = link(parts).select(F.col("id").alias("linked_id"), F.col("text_key").alias("linked_key"), "linked")
    none = F.slice("base", 1, 0)
    some = parts.filter(F.size("weak") > 0).join(found, F.col("id").eqNullSafe(F.col("linked_id")) & (F.col("text_key") == F.col("linked_key")), "left").drop("linked_id", "linked_key")
    some = some.withColumn("linked", F.coalesce("linked", none))
    rest = parts.filter(F.size("weak") == 0).withColumn("linked", none)
    kept = [f"own.{c}" for c in docs.columns if c not in (text, "text_key", "base", "linked")]
    return some.unionByName(rest).select(*kept, "text_key", "base", "linked")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with its spans (sorted by start, at least one) replaced by ``mark``, spans that overlap by one.

    Finding a place in a text takes time in proportion to the place, so the text is cut into blocks of spans first.
    """

    def step(far: Column, s: Column) -> Column:
        """What lies before the span, and whether the span opens a mark of its own."""
        out = F.struct(far.alias("from"), F.greatest(far, s["start"]).alias("to"), (s["start"] >= far).alias("marks"))
        return F.struct(F.greatest(far, s["end"]).alias("state"), out.alias("out"))

    def pieces(part: Column) -> Column:
        first = F.element_at(part, 1)["from"]

        def of(own: Column) -> Column:
            return F.transform(part, lambda c: F.concat(F.substr(own, c["from"] - first + 1, c["to"] - c["from"]), F.when(c["marks"], F.lit(mark)).otherwise(F.lit(""))))

        return let(F.substr(text, first + 1, F.element_at(part, -1)["to"] - first), of)

    def whole(cuts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(cuts) / BLOCK).cast("int") - 1)
        return F.array_join(F.flatten(F.transform(numbers, lambda i: let(F.slice(cuts, i * BLOCK + 1, F.lit(BLOCK)), pieces))), "")

    cuts = scanned(spans, F.lit(0), step, "struct<from:int,to:int,marks:boolean>")
    return F.concat(let(cuts, whole), F.substr(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1, F.length(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in BASE_KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "linked"))).alias("spans"),
    )
