"""op5: the nearest neighbours of every hundredth vector."""

from pyspark.sql import functions as F

from fleetlens.llm.neighbours import nearest
from fleetlens.llm.queries import query, table


@query("op5_nearest_neighbours")
def op5_nearest_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
