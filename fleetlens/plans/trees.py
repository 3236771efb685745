"""XML documents as rows of numbered nodes, and joins along their structure.

A document is cut into its tags, which get their positions. The level of a tag is the number of elements open before it,
a running sum; an element ends at the next tag of its level. So every element has an interval (entry, leave) and a level:
one node lies below another if its entry lies in the other's interval, and `n` levels below it if the levels say
so. Documents of any depth and shape need no schema, no walk and no Python; a document is the unit that is
sorted, never all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comments, character data and declarations are matched first, so that what looks like a tag in them is none.
TAG = r"""<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<[?!][^>]*>|<(?:[^<>"']|"[^"]*"|'[^']*')*>"""
#: References that server documents contain; another numeric one stays as it is written.
REFERENCES = (("&#xD;", "\r"), ("&#xd;", "\r"), ("&#13;", "\r"), ("&#xA;", "\n"), ("&#xa;", "\n"), ("&#10;", "\n"), ("&#x9;", "\t"), ("&#9;", "\t"),
              ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def attribute(tag: Column | str, name: str) -> Column:
    """The value of an attribute of a tag, null where it has none."""
    tag = F.col(tag) if isinstance(tag, str) else tag
    found = F.regexp_extract_all(tag, F.lit(rf"""\s{name}\s*=\s*("[^"]*"|'[^']*')"""), F.lit(1))
    raw = F.get(found, F.lit(0))
    value = F.translate(F.substr(raw, F.lit(2), F.length(raw) - 2), "\r\n\t", "   ")
    for reference, char in REFERENCES:
        value = F.replace(value, F.lit(reference), F.lit(char))
    return value


def nodes(documents: DataFrame, keys: Sequence[str], document: str, names: Sequence[str]) -> DataFrame:
    """keys, `copy`, entry, leave, level, name, tag of the elements called one of `names`, of every document.

    A document is told by its keys and its text; `copies` rows that repeat both are read as one and come back as the
    numbers of `copy`. Documents whose tags do not balance have no nodes. Name spaces do not matter.
    """
    keys = list(keys)
    distinct = documents.where(F.col(document).isNotNull()).groupBy(*keys, document).agg(F.count(F.lit(1)).alias("_copies"))
    cut = distinct.select(*keys, F.xxhash64(document).alias("_text"), "_copies", F.posexplode(F.regexp_extract_all(document, F.lit(TAG), F.lit(0))).alias("entry", "tag"))
    # other tags only count, so they travel without their attributes
    cut = cut.where(~F.col("tag").startswith("<?") & ~F.col("tag").startswith("<!")).withColumns({
        "name": F.regexp_extract("tag", r"^</?\s*(?:[^\s/>:]+:)?([^\s/>]+)", 1),
        "step": F.when(F.col("tag").startswith("</"), -1).when(F.col("tag").endswith("/>"), 0).otherwise(1)})
    cut = cut.withColumn("tag", F.when(F.col("name").isin(*names) & (F.col("step") >= 0), F.col("tag")))
    one = [*keys, "_text"]
    in_order = Window.partitionBy(*one).orderBy("entry")
    open_before = F.coalesce(F.sum("step").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # an opening tag and the one that closes it have as many elements around them
    level = F.when(F.col("step") < 0, F.col("open") - 1).otherwise(F.col("open"))
    levels = cut.withColumn("open", open_before).withColumn("level", level)
    whole = Window.partitionBy(*one)
    levels = levels.withColumns({"_end": F.sum("step").over(whole), "_least": F.min("level").over(whole)}).where("_end = 0 AND _least >= 0")
    siblings = Window.partitionBy(*one, "level").orderBy("entry")
    ended = levels.withColumns({"leave": F.when(F.col("step") == 0, F.col("entry")).otherwise(F.lead("entry").over(siblings)), "_closed_by": F.when(F.col("step") == 1, F.lead("name").over(siblings))})
    sound = ended.withColumn("_wrong", F.count_if((F.col("step") == 1) & (F.col("_closed_by") != F.col("name"))).over(whole))
    kept = sound.where(F.col("tag").isNotNull() & (F.col("_wrong") == 0))
    return kept.select(*one, "_copies", "entry", "leave", "level", "name", "tag")


def _named(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys])


def below(above: DataFrame, inner: DataFrame, keys: Sequence[str], upper: str, lower: str, levels: int | None = None, itself: bool = False) -> DataFrame:
    """Pairs of nodes of one document of which the second lies below the first (or is it, with `itself`), exactly
    `levels` below where that is given; columns but the keys get the prefixes `upper` and `lower`.

    The two are joined by document, and by level where `levels` is given: no pair across documents is ever formed.
    """
    keys = list(keys)
    a, b = _named(above, keys, upper), _named(inner, keys, lower)
    same = [F.col(f"_a_{k}").eqNullSafe(F.col(k)) for k in keys]
    a = a.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *[c for c in a.columns if c not in keys])
    on = same + ([F.col(f"{lower}_level") - levels == F.col(f"{upper}_level")] if levels is not None else [])
    starts = F.col(f"{lower}_entry") >= F.col(f"{upper}_entry") if itself else F.col(f"{lower}_entry") > F.col(f"{upper}_entry")
    # nodes are exploded rows, which the optimiser does not count: they meet by a shuffle
    return a.join(b.hint("merge"), on + [starts, F.col(f"{lower}_entry") <= F.col(f"{upper}_leave")]).drop(*[f"_a_{k}" for k in keys])
