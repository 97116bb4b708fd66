"""Guards on the given tables, group by group: what breaks an invariant."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import guards
from brindle.sources import fixtures as X
from brindle.sources.store import cut_lineage

QUERIES, ORACLES = {}, {}


def embedding_gaps(spark, sf_dir):
    """documents as states, with the embedding of their number if there is
    one: languages of which some have one and some have none."""
    found = X.table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(X.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    return guards.embedding_gaps(found, ["lang", "source"])


QUERIES["g_embedding_uniform"] = embedding_gaps
ORACLES["g_embedding_uniform"] = "SELECT lang, source, count(*) AS states, count(embedding) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY ALL HAVING count(embedding) > 0 AND count(embedding) < count(*)"


def provenance(spark, sf_dir):
    """Suppliers' lines: by supplier, one return flag and one discount class?"""
    lines = X.table(spark, sf_dir, "lineitem")
    state = lines.select("l_suppkey", F.create_map(F.lit("model"), "l_returnflag", F.lit("quantization"), F.when(F.col("l_discount") < 0.05, "low").otherwise("high"), F.lit("adapter_name"), F.lit("a")).alias("metadata"))
    return guards.provenance_conflicts(state, ["l_suppkey"])


QUERIES["g_provenance"] = provenance
ORACLES["g_provenance"] = """SELECT l_suppkey, concat_ws(',', CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'model' END, CASE WHEN count(DISTINCT l_discount < 0.05) > 1 THEN 'quantization' END) AS mixed FROM lineitem
GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_discount < 0.05) > 1"""


def broken_trajectories(spark, sf_dir):
    """Orders as trajectories of lines: numbers that repeat or are missing."""
    lines = X.table(spark, sf_dir, "lineitem")
    return guards.broken_trajectories(lines.select(F.col("l_orderkey").alias("trajectory_id"), (F.col("l_linenumber") - 1).alias("position")))


QUERIES["g_trajectory"] = broken_trajectories
ORACLES["g_trajectory"] = "SELECT l_orderkey AS trajectory_id, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) - 1 AS lo, max(l_linenumber) - 1 AS hi FROM lineitem GROUP BY 1 HAVING count(*) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*)"


def edge_faults(spark, sf_dir):
    """Lines as edges from suppliers to parts; parts of size 25 and more, and
    suppliers in debt, are no nodes."""
    lines = X.table(spark, sf_dir, "lineitem")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    edges = lines.select(name("s", "l_suppkey").alias("source_id"), F.col("l_returnflag").alias("action_id"), name("p", "l_partkey").alias("target_id"), (F.col("l_quantity") - 3).cast("long").alias("frequency"))
    nodes = X.table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(name("s", "s_suppkey").alias("node_id")).unionByName(X.table(spark, sf_dir, "part").where("p_size < 25").select(name("p", "p_partkey").alias("node_id")))
    return guards.edge_faults(nodes, edges)


QUERIES["g_builder"] = edge_faults
ORACLES["g_builder"] = """WITH e AS (SELECT 's' || l_suppkey AS source_id, l_returnflag AS action_id, 'p' || l_partkey AS target_id, count(*) AS n, min(CAST(l_quantity - 3 AS BIGINT)) AS least FROM lineitem GROUP BY ALL),
k AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size < 25)
SELECT * FROM (SELECT source_id, action_id, target_id, CASE WHEN n > 1 THEN 'repeats' WHEN least < 0 THEN 'negative' WHEN source_id NOT IN (FROM k) OR target_id NOT IN (FROM k) THEN 'unknown node' END AS fault FROM e) WHERE fault IS NOT NULL"""


def weights(spark, sf_dir):
    """Orders' shares of price by return flag, of which those in R are taken
    off twice: whether they are weights."""
    lines = X.table(spark, sf_dir, "lineitem")
    each = lines.groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    share = F.when(F.col("l_returnflag") == "R", -F.col("q")).otherwise(F.col("q"))
    by = each.groupBy("l_orderkey").agg(F.sum("q").alias("total"), F.map_from_entries(F.collect_list(F.struct("l_returnflag", share.alias("q")))).alias("w"))
    w = F.transform_values("w", lambda _, q: q / F.col("total"))
    return by.select("l_orderkey", guards.weights_ok(w).alias("weights"))


QUERIES["g_weights"] = weights
ORACLES["g_weights"] = "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') = 0 AS weights FROM lineitem GROUP BY 1"


def keys_of_maps(spark, sf_dir):
    """Orders' return flags of cheap lines and of the others: those that only
    one side has."""
    lines = X.table(spark, sf_dir, "lineitem")
    flags = lambda test: F.map_from_arrays(F.collect_set(F.when(test, F.col("l_returnflag"))), F.transform(F.collect_set(F.when(test, F.col("l_returnflag"))), lambda x: F.lit(1)))
    each = lines.groupBy("l_orderkey").agg(flags(F.col("l_discount") < 0.05).alias("a"), flags(F.col("l_discount") >= 0.05).alias("b"))
    return each.select("l_orderkey", guards.keys_differ(F.col("a"), F.col("b")).alias("differ"))


QUERIES["key_equality"] = keys_of_maps
ORACLES["key_equality"] = """WITH f AS (SELECT l_orderkey, l_returnflag, count(DISTINCT l_discount < 0.05) AS sides FROM lineitem GROUP BY ALL)
SELECT l_orderkey, coalesce(string_agg(l_returnflag, ',' ORDER BY l_returnflag) FILTER (sides = 1), '') AS differ FROM f GROUP BY 1"""


def observed(spark, sf_dir):
    """What is observed while scores are written: rows, positives, negatives
    and missing scores, and whether there are both classes."""
    lines = X.table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("target"), F.when(F.col("l_discount") > 0.02, F.col("l_tax")).alias("score"))
    metrics = {"n": F.count(F.lit(1)), "positives": F.sum("target"), "negatives": F.sum(1 - F.col("target")), "missing": F.count(F.lit(1)) - F.count("score")}
    rows, seen = guards.watched(lines, metrics)
    cut_lineage(rows, "observed")
    counts = {"n": 0, "positives": None, "negatives": None, "missing": 0} | guards.seen_of(seen)
    return spark.createDataFrame([(counts["n"], counts["positives"], counts["negatives"], counts["missing"], bool(counts["positives"] and counts["negatives"]))], "n long, positives long, negatives long, missing long, both_classes boolean")


QUERIES["f_both_classes"] = observed
ORACLES["f_both_classes"] = "SELECT count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS positives, count(*) FILTER (l_returnflag <> 'R') AS negatives, count(*) FILTER (NOT l_discount > 0.02) AS missing, count(DISTINCT l_returnflag = 'R') = 2 AS both_classes FROM lineitem"
