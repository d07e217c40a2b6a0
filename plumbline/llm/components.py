"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import col
from plumbline.llm.common import durable, without


def _state(links: DataFrame) -> tuple[int, str | None]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).cast("string").alias("s")).first()
    return row["n"], row["s"]


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One round.  Large: a node's larger neighbours are hung on the least of its neighbourhood.  Small: the node and
    its smaller neighbours are.  Only minima are gathered, never a neighbourhood."""
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = links.where("b < a").union(turned.where("b < a")) if small else links.union(turned)
    least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # so that the join can split a hot node's rows
    met = both.join(least, "a")
    hung = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if small:
        hung = hung.union(least.select("a", F.col("m").alias("b")))
    else:
        hung = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").distinct()


def one_of_each(docs: DataFrame, doc_id: str, text: str, marks: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id, those without one coming last.

    marks (id, body: the text's hash, node) has every row of docs, roots (node, root) the nodes that are linked.  Rows
    that share a doc_id are decided one by one; of rows equal in doc_id and text one stays.
    """
    whole = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"))
    whole = whole.withColumns({"id": F.col("row").getField(doc_id), "body": F.xxhash64(F.coalesce(F.col("row").getField(text), F.lit("")))})
    met = F.struct(F.col("id").isNull().alias("unnamed"), "id", "body")
    nodes = marks.groupBy("node").agg(F.min(met).alias("least"))
    nodes = nodes.join(roots.withColumnRenamed("node", "its_node"), F.col("node") == F.col("its_node"), "left").select(F.coalesce("root", "node").alias("root"), "least")
    stay = durable(nodes.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.body"), "stay")
    stays = stay.select(F.col("id").alias("its_id"), F.col("body").alias("its_body"))
    gone = marks.join(stays, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("body") == F.col("its_body")), "left_anti").select("id", "body").distinct()
    kept = without(whole, durable(gone, "gone"), ["id", "body"])
    # rows that share both, if there are any, come from one row of each
    again = durable(marks.groupBy("id", "body").count().where("count > 1").select("id", "body"), "again")
    if again.isEmpty():
        return kept.select("row.*")
    many = kept.join(again.toDF("its_id", "its_body"), F.col("id").eqNullSafe(F.col("its_id")) & (F.col("body") == F.col("its_body")), "left_semi")
    once = without(kept, again, ["id", "body"]).select("row")
    return once.unionByName(many.groupBy("id", "body").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")).select("row.*")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, root): root is the least node of node's component.  Nodes without a link are left out.

    Each round's links are written to the shared folder; the number of rounds grows as the logarithm of the longest path.
    """
    links = durable(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = _state(links)
    while seen[0]:
        links = durable(_star(_star(links, small=False), small=True), "links")
        if (now := _state(links)) == seen:
            break
        seen = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
