"""op6: all documents mixed to weights of 5, 2 and 1."""

from fleetlens.llm.mixing import mix
from fleetlens.llm.queries import query, table

WEIGHTS = (5, 2, 1)


@query("op6_mix_sources")
def op6_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), WEIGHTS).drop("text", "source")
