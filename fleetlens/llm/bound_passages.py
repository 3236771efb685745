"""op10: passages that repeat across all documents."""

from fleetlens.llm.queries import query, table
from fleetlens.llm.substring_dedup import repeated_passages


@query("op10_repeated_passages")
def op10_repeated_passages(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
