"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` applies them to ``documents``.

Edge cases: documents without words go with the quality rules; of rows with equal id and text one
stays, a row with a null id like any other; null languages and sources are groups of their own;
columns beyond those of ``documents`` pass through all but the last stage; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import bpe, minhash, mixing, pii, quality
from fieldmark.llm.common import carried, drop, stored

#: Stages 2 and 5 can't be stated in SQL (sketches, merges); tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their language's and source's fences."""
    inner = carried(docs, "lang", "source", "text")
    judged = quality.judged(stored(quality.measured(inner).drop("text"), "measured"))
    return judged.where("_kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    found = minhash.near_duplicates(docs, size=5, percent=80).where("kept and text_key = first_key")
    row = lambda id_, key: [F.col(id_).isNull().alias("_none"), F.coalesce(id_, F.lit(0)).alias("_id"), key.alias("_key")]
    stay = found.select(*row("doc_id", F.col("text_key")))
    # one exchange of the texts serves the join and what is left of rows with equal id and text
    keyed = carried(docs, *row("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))))
    return keyed.join(stay, ["_none", "_id", "_key"], "left_semi").dropDuplicates(["_none", "_id", "_key"]).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data generalised and revealing terms removed; ``n_chars`` follows."""
    out = pii.redacted(pii.sanitised(carried(docs, "doc_id", "text", without=("text",))))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    inner = carried(docs, "doc_id", "text", "source")
    mixed = mixing.mix(inner, keep=["row"], weights=(5, 2, 1), cap=3)
    times = F.explode(F.when(F.col("_mix.copies") > 0, F.sequence(F.lit(1), F.col("_mix.copies").cast("int"))))
    return mixed.select("row", times.alias("nth")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode_decode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "text"))
    back = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", "lang", "source", "ids", "n_tokens", back.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix_sources),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
