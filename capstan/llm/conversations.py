"""Conversation structure repair: the cheapest edits that turn a sequence of turns into `(s?(ua)+)?`, by a higher-order fold.

Windows over a conversation's turns derive the fault flags; turns are collected, in order, into arrays of small codes, and
`aggregate()` carries four (cost, audit) structs, one for each state of the grammar: nothing yet, a system turn, a user turn, an
assistant turn. Every step is a `least` of native structs, so equal costs go to the ASCII-least audit. Of two audits of equal cost
over the same turns none begins with the other (an insertion costs something), so the least prefix stays the least whole.

The fold runs over blocks of turns, from each of the four states a block can be entered in, and a second fold chains the blocks: a
conversation of any length costs no quadratic concatenation and no row holds its texts. Texts are left out until the edits are known;
then only the turns that stay are joined back, and their lines pass in order through an incremental SHA-256. As such a hash
is sequential, a conversation's lines pass through one task, as a stream.

Defined results: a null id is a conversation of its own; null roles, texts and turns count as one space, but null turns come
first and are no turn numbers; an empty text is blank. Turns of equal number are ordered by role and then by the SHA-256 of
their text. A turn with an empty role has no initial, so it can be kept anywhere. Equal rows are duplicates of the first of them. Turns of any length are read whole, and a conversation may have any number of them. An empty
table gives an empty table; other columns do not take part and are not returned, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import small_batches, staged, table

#: What each edit costs, and what a truncated turn adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns of one block.
BLOCK = 256
#: Letters of an audit. KEPT_ASIDE stands for a kept turn of neither user nor assistant until the end: it sorts between K and R, so no
#: comparison changes.
KEPT_ASIDE = "L"
STATES = ("start", "system", "user", "assistant")
#: White space between words, and pairs of initials that may stand next to each other.
SPACES = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after the damage: dropped, emptied, stripped of end marks, repeated or made a user's."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    marked = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("damage"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.filter("damage != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) in order, without their texts: conv_id, pos, turn, role, digest, blank, duplicate,
    truncated, illegal, new_turn, first. One shuffle, of narrow rows; all windows share it."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    narrow = turns.select("conv_id", "turn", "role", _digest().alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest", "nth")
    initial = F.substring("role", 1, 1)
    nth = narrow.withColumn("nth", F.row_number().over(same))
    fresh = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))
    pair = F.concat(F.lag(initial).over(order), initial)
    return nth.select(
        "conv_id", F.row_number().over(order).cast("long").alias("pos"), "turn", "role", "digest", "blank",
        (~F.col("blank") & (F.col("nth") > 1)).alias("duplicate"), (~F.col("blank") & (F.col("nth") == 1) & F.col("open")).alias("truncated"),
        F.coalesce(~pair.isin(*LEGAL), F.lit(False)).alias("illegal"), fresh.alias("new_turn"), (F.col("nth") == 1).alias("first"),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plus(state: Column, cost: Column | int, letter: Column | str) -> Column:
    """A (cost, audit) with one more edit; null if the state cannot be reached."""
    cost, letter = (F.lit(x) if isinstance(x, (int, str)) else x for x in (cost, letter))
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost.cast("long")).alias("cost"), F.concat(state["audit"], letter).alias("audit")))


def _vector(*states: Column) -> Column:
    return F.struct(*(s.alias(n) for s, n in zip(states, STATES)))


def _closed(v: Column) -> Column:
    """The best way into each state when turns may be inserted next; two insertions are the most that can help."""
    user = F.least(v["user"], _plus(v["start"], INSERT, "I"), _plus(v["system"], INSERT, "I"), _plus(v["assistant"], INSERT, "I"))
    return _let(user, lambda u: _vector(v["start"], v["system"], u, F.least(v["assistant"], _plus(u, INSERT, "I"))))


def _entered(state: Column) -> Column:
    """A block entered in ``state`` (its number), before its first turn."""
    begun = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return _closed(_vector(*(F.when(state == k, begun) for k in range(4))))


def _step(v: Column, code: Column) -> Column:
    """One turn. ``code``: -1 must go, else 0 to 4 for system, user, assistant, other, no initial, and 8 more if truncated."""
    stays, extra, kind = code >= 0, F.when(code >= 8, TRUNCATED).otherwise(0), F.pmod(code, F.lit(8))

    def said(state: Column, as_kind: int) -> Column:
        own = kind == as_kind
        return F.when(stays, _plus(state, F.when(own, extra).otherwise(extra + REROLE), F.when(own, "K").otherwise("R")))

    # Without an initial a turn can stay anywhere.
    gone = [F.least(_plus(v[n], DELETE, "D"), F.when(stays & (kind == 4), _plus(v[n], extra, KEPT_ASIDE))) for n in STATES]
    system = F.least(gone[1], F.when(stays & (kind == 0), _plus(v["start"], extra, KEPT_ASIDE)))
    user = F.least(gone[2], said(F.least(v["start"], v["system"], v["assistant"]), 1))
    return _let(_vector(gone[0], system, user, F.least(gone[3], said(v["user"], 2))), _closed)


def _chained(v: Column, block: Column) -> Column:
    """A vector carried through a block: ``block`` holds the vectors that leave it, for each state it is entered in."""

    def through(name: str) -> Column:
        def way(k: int) -> Column:
            out = F.get(block, F.lit(k))[name]
            return F.when(v[STATES[k]].isNotNull() & out.isNotNull(), F.struct((v[STATES[k]]["cost"] + out["cost"]).alias("cost"), F.concat(v[STATES[k]]["audit"], out["audit"]).alias("audit")))

        return F.least(*(way(k) for k in range(4)))

    return _vector(*(through(n) for n in STATES))


def repairs(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of ``turns`` (see ``numbered``)."""
    kind = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).when(F.col("role") == "", 4).otherwise(3)
    code = F.when(F.col("blank") | F.col("duplicate"), -1).otherwise(kind + F.when(F.col("truncated"), 8).otherwise(0))
    flags = ("blank", "duplicate", "truncated", "illegal", "new_turn")
    blocks = turns.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK)).groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", code.cast("int").alias("code")))).alias("turns"), *(F.count_if(c).alias(c) for c in flags), F.max("turn").alias("most"), F.min("turn").alias("least")
    )
    entries = F.when(F.col("block") == 0, F.array(F.lit(0))).otherwise(F.array(*(F.lit(k) for k in range(4))))
    ways = F.transform(entries, lambda e: F.aggregate(F.col("turns"), _entered(e), lambda v, t: _step(v, t["code"])))
    whole = blocks.select("conv_id", "block", ways.alias("ways"), *flags, "most", "least").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "ways"))).alias("blocks"), *(F.sum(c).alias(c) for c in flags), F.max("most").alias("most"), F.min("least").alias("least")
    )
    end = F.aggregate("blocks", _entered(F.lit(0)), lambda v, b: _chained(v, b["ways"]))
    best = F.least(end["start"], end["assistant"])
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("new_turn"), F.lit(0)).cast("long")
    return whole.withColumn("best", best).select("conv_id", gaps.alias("gaps"), *flags[:4], F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))


def edits(audits: DataFrame) -> DataFrame:
    """conv_id, pos, letter and lines of the inserted turns before it, for each turn of an audit (and its end, without a letter)."""
    pieces = audits.select("conv_id", F.posexplode(F.split("audit", "(?<=[^I])")).alias("at", "piece"))
    inserted = F.length(F.regexp_replace("piece", "[^I]", ""))
    letter = F.regexp_replace("piece", "I", "")
    said = inserted + letter.isin("K", "R").cast("int")
    before = F.sum(said).over(Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - said
    cut = pieces.select("conv_id", (F.col("at") + 1).cast("long").alias("pos"), letter.alias("letter"), inserted.alias("inserted"), before.alias("before"))
    name = lambda k: F.when((F.col("before") + k) % 2 == 0, "user").otherwise("assistant")
    lines = F.when(F.col("inserted") > 0, F.transform(F.sequence(F.lit(0), F.col("inserted") - 1), lambda k: F.concat(name(k), F.lit(":"))))
    return cut.select("conv_id", "pos", "letter", F.coalesce(lines, F.array().cast("array<string>")).alias("lines"), name(F.col("inserted")).alias("rerole"))


def _hash_of_lines(lines: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: over each conversation's ``lines`` (conv_id, pos, lines) in order, as a stream."""
    small_batches(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, digest, begun, open_ = None, None, hashlib.sha256(), False, False
        for batch in batches:
            ids, shas = [], []
            for conv, pos, body in zip(*(batch.column(k) for k in range(3))):
                conv, pos = conv.as_py(), pos.as_py()
                if open_ and conv != own:
                    ids.append(own)
                    shas.append(digest.hexdigest())
                if not open_ or conv != own:
                    own, at, digest, begun, open_ = conv, None, hashlib.sha256(), False, True
                if pos == at:  # the same turn from an equal row
                    continue
                at = pos
                for line in body.as_py():
                    if begun:
                        digest.update(b"\n")
                    digest.update(line.encode())
                    begun = True
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(shas)], names=["conv_id", "repaired_sha256"])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([own], batch.schema.field(0).type), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.mapInArrow(run, f"conv_id {lines.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repaired_lines(turns: DataFrame, order: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, pos and the lines `role:text` of the repaired conversations. ``order``: of ``numbered``; ``turns`` have the texts."""
    done = edits(audits).withColumnsRenamed({"conv_id": "of", "pos": "at"})
    kept = order.filter("first").select("conv_id", "pos", "role", "digest").join(done.filter("letter in ('K', 'R', 'L')"), F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("at") == F.col("pos")))
    kept = kept.select("of", "at", "lines", F.col("role").alias("own"), F.col("digest").alias("key"), F.when(F.col("letter") == "R", F.col("rerole")).otherwise(F.col("role")).alias("says"))
    texts = turns.select("conv_id", "role", "text", _digest().alias("digest"))
    met = F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("own") == F.col("role")) & (F.col("key") == F.col("digest"))
    spoken = texts.join(kept, met).select("conv_id", F.col("at").alias("pos"), F.concat("lines", F.array(F.concat("says", F.lit(":"), "text"))).alias("lines"))
    silent = done.filter("letter not in ('K', 'R', 'L') and size(lines) > 0").select(F.col("of").alias("conv_id"), F.col("at").alias("pos"), "lines")
    return spoken.unionByName(silent)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``repairs`` finds for ``turns`` (conv_id, turn, role, text), and the ``repaired_lines``."""
    order = staged(numbered(turns), "turns")
    found = staged(repairs(order), "repairs")
    return found.withColumn("audit", F.translate("audit", KEPT_ASIDE, "K")), repaired_lines(turns, order, found.select("conv_id", "audit"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, lines = repair(damaged(rows))
    hashes = _hash_of_lines(lines).withColumnRenamed("conv_id", "hashed")
    every = rows.select(F.col("conv_id").alias("original")).distinct()
    joined = every.join(found, F.col("original").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("original").eqNullSafe(F.col("hashed")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        F.col("original").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
