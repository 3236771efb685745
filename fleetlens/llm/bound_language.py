"""op2: the language of every document, learned from the labels of two thirds of them."""

from pyspark.sql import functions as F

from fleetlens.llm.language_id import held_out, identify, learn
from fleetlens.llm.queries import query, table


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), samples).drop("text")
