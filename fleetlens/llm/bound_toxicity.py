"""op11: toxicity of every document, learned from the labels of four fifths of them."""

from pyspark.sql import functions as F

from fleetlens.llm.queries import query, table
from fleetlens.llm.toxicity import held_out, learn, score


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return score(docs, learn(docs.where("NOT held_out"), labels)).drop("text")
