"""A corpus pipeline of five stages over `documents`: language, line dedup, near-duplicate groups, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns the columns of docs
(the last one returns token digests). Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.llm import byte_bpe, language_crf, line_dedup, mix_sources, ngram_join
from quarryflow.llm.common import Scratch, documents, hinted
from quarryflow.llm.queries import vocabulary
from quarryflow.sources.scratch import temporary_tables

#: A document whose best language has a mean marginal below this has no language.
LEAST_SCORE = 0.4


def _named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns by number, and the number of each column: no name can clash with one that an operator uses."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of docs under their own names, n_chars (if there) following the text."""
    column = lambda c: F.length(names["text"]).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(names[c])
    return rows.select(*(column(c).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; texts without letters, null texts and mixtures without a main language go."""
    plain, names = _named(docs)
    keep = tuple(n for c, n in names.items() if c != "doc_id")
    named = language_crf.identify(plain, id_col=names["doc_id"], text_col=names["text"], lang_col=names["lang"], keep=keep)
    known = named.where((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select(*(F.col(names[c]).alias(c) for c in docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; a document that loses all its words with them goes too."""
    plain, names = _named(docs)
    kept = line_dedup.dedup_lines(plain, id_col=names["doc_id"], text_col=names["text"])
    return _back(kept.where((F.col("n_removed") == 0) | F.col(names["text"]).rlike(line_dedup.SOLID)), docs, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one stays, that of the least id (null last), of several with that id the one of
    the least hash of the text; of rows equal in id and text, one. Documents of one id that are not similar all stay."""
    scratch = Scratch(spark, "groups")
    plain, names = _named(docs)
    i, text = names["doc_id"], names["text"]
    rows = scratch.write(ngram_join.similar_groups(plain, id_col=i, text_col=text), "rows")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th")
    first = scratch.write(rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "first"), "first")
    losers = rows.join(hinted(first, 48), "root").where(place != F.col("first")).select(F.col("id").alias("lid"), F.col("th").alias("lth")).distinct()
    losers = scratch.write(losers, "losers")
    own = plain.withColumn("th", F.xxhash64(text))
    kept = own.join(hinted(losers, 24), F.col(i).eqNullSafe(F.col("lid")) & (F.col("th") == F.col("lth")), "left_anti")
    repeated = scratch.write(rows.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("rid"), F.col("th").alias("rth")), "repeated")
    if repeated.isEmpty():
        return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
    again = F.col(i).eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))
    single, several = kept.join(hinted(repeated, 24), again, "left_anti"), kept.join(hinted(repeated, 24), again, "left_semi")
    # Columns may be of types without an order, such as maps; their text has one.
    one = several.groupBy(i, "th").agg(F.min_by(F.struct(*names.values()), F.to_json(F.struct(*names.values()))).alias("row")).select("row.*")
    return single.select(*names.values()).unionByName(one).select(*(F.col(n).alias(c) for c, n in names.items()))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    plain, names = _named(docs)
    key = F.concat_ws(":", F.coalesce(F.col(names["doc_id"]).cast("string"), F.lit("null")), F.xxhash64(names["text"]).cast("string"))
    keyed = plain.withColumn("key", key)
    scratch = Scratch(spark, "copies")
    mixed = mix_sources.mix_sources(keyed, id_col="key", text_col=names["text"], source_col=names["source"])
    copies = scratch.write(mixed.groupBy("key").agg(F.max("copies").alias("copies")).where("copies > 0"), "copies")
    chosen = keyed.join(hinted(copies, 48), "key")
    taken = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*(F.col(n).alias(c) for c, n in names.items()))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of identifiers and of the text decoded from them."""
    return byte_bpe.digest_column(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]

#: Forward-backward, dynamic programming and byte-pair merging have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with temporary_tables():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
