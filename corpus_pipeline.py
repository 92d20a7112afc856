"""From raw documents to tokens: five stages, each over all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capstan.llm import byte_bpe, decontaminate, jaccard, language, secrets
from capstan.llm.staging import staged, table

#: Tables hold at least doc_id, text, lang, source and n_chars; all stages but the last keep a table's columns, whatever else it has: a row
#: travels as one struct, so no helper meets a column of its name. An empty table stays one. Texts of any length are read whole. Rows
#: that repeat, and several texts of one id, are each a row of their own, but where a stage says otherwise.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised; rejected ones go. The model learns from the rows at hand.

    Null texts, and those without letters, have no language and go; without labelled rows nothing can be recognised, and all go.
    """
    model = language.fit(docs)
    names = docs.columns
    # Predicted columns may not meet those of the table: only the text goes in beside the row.
    whole = docs.select(F.struct(*names).alias("row"), F.col("text").alias("_text"))
    return language.predict(whole, model, text="_text", drop_text=True).filter("accepted").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity from 0.8 on): the one with the least
    id, null last, of equal ids the least text hash; of rows equal in both, the first in the order of their other columns.

    Documents without words (null and empty texts too) are in no group and stay, and no id or text is taken for another's.
    """
    found = jaccard.components(docs.select("doc_id", "text", F.xxhash64("text").alias("key")), gram=5, percent=80)
    named = staged(found.select(F.col("doc_id").alias("id"), "key", "group"), "groups")  # texts do not travel with the groups
    # The first of each group, by a minimum that is combined before the shuffle.
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("key").alias("key"))
    first = named.filter("group is not null").groupBy("group").agg(F.min(order).alias("first")).select("first.id", "first.key", F.lit(True).alias("first"))
    alone = named.filter("group is null").select("id", "key", F.lit(False).alias("first")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    kept = rows.join(staged(first.unionByName(alone), "firsts"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")))
    # Rows equal in id and text are one document, unless they have no words.
    orderly = [f"row.{f.name}" for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.name not in ("doc_id", "text")]
    again = Window.partitionBy("own_id", "own_key").orderBy(*(orderly or ["own_id"]))
    return kept.withColumn("nth", F.row_number().over(again)).filter("nth = 1 or not first").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that overlap with no benchmark item; null and empty texts overlap with none, nor does anything with an empty benchmark."""
    return decontaminate.remove_overlapping(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark, spans that meet by one; all documents stay, null texts as they are, and n_chars follows the new text."""
    found = secrets.scan(docs.select("doc_id", "text"))
    some = found.filter((F.size("base") > 0) | (F.size("linked") > 0)).select("doc_id", "text_key", F.array_sort(F.concat("base", "linked")).alias("spans")).dropDuplicates(["doc_id", "text_key"])
    some = some.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "spans")
    own = F.struct(*(c for c in docs.columns if c != "text"))  # the text itself travels once
    rows = docs.select(own.alias("row"), F.col("text").alias("body"), F.xxhash64("text").alias("text_key"))
    joined = rows.join(some, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    changed = F.col("spans").isNotNull()
    text = F.when(changed, secrets.masked(F.col("body"), F.col("spans"), "[secret]")).otherwise(F.col("body"))
    done = joined.select("row", changed.alias("changed"), text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*((new[c] if c in new else F.col(f"row.{c}")).alias(c) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its bytes; null and empty texts have none."""
    path = byte_bpe.default_ranks()
    encoded = byte_bpe.encode(docs.select("doc_id", "text"), path).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).select("doc_id", "text_sha256", "token_ids")
    decoded = byte_bpe.decode(encoded, path)
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"), "token_ids")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_masking),
    ("byte_bpe", tokens),
]

#: The trained language model, the masks' hashes and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
