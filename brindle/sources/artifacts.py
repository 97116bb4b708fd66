"""Versioned artifacts: Parquet tables with a JSON sidecar, swapped in whole.

An artifact is a folder with one or more Parquet tables and ``metadata``. It
is written to a temporary folder beside its place and renamed, so readers see
the old or the new one; an old one is put back if the rename fails. Paths go
through Hadoop's file system, so any store that Spark can write will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import guards
from brindle.operators.vector_index import Index
from brindle.sources.store import cut_lineage

# The artifacts' versions and columns.
TRAJECTORIES_VERSION, READS = 3, (1, 2, 3)
GRAPH_VERSION = SCORES_VERSION = VISITS_VERSION = 1

STATES_SCHEMA = "trajectory_id string, position int, node_id string, timestep int, embedding array<float>, metadata_json string, hypothesis_distribution_json string, mass_capture float, top_k_logprobs_json string, action_id_to_next string, action_category_to_next string, action_metadata_to_next_json string"
TRAJECTORIES_SCHEMA = "trajectory_id string, primary_label string, confidence float, secondary_labels_json string, n_states int, n_actions int"
VISIT_COLUMNS = ("visit_seq", "trajectory_id", "timestep", "node_id", "embedding")
ASSEMBLY_COLUMNS = ("node_id", "assembly_index")
SCORE_COLUMNS = ("trajectory_id", "entropy_plateau", "voi_flatness", "distance_from_trajectory", "composite")


class ArtifactError(RuntimeError):
    """Any trouble with an artifact."""


class ArtifactExists(ArtifactError):
    """The place is taken and overwriting was not asked for."""


class ArtifactMissing(ArtifactError):
    """There is no artifact at the place."""


class VersionMismatch(ArtifactError):
    """The artifact has a version that this code does not read."""


class ColumnsMissing(ArtifactError):
    """A table lacks required columns."""


class Store:
    """The few file operations that artifacts need, by Hadoop's API."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.of = jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.of(path))

    def rename(self, a: str, b: str) -> bool:
        return self.fs.rename(self.of(a), self.of(b))

    def delete(self, path: str) -> None:
        self.fs.delete(self.of(path), True)


@contextmanager
def swapped(spark: SparkSession, path: str, overwrite: bool = False):
    """A temporary folder that takes ``path``'s place when the block ends
    well; the old folder stays if it does not."""
    store, path = Store(spark, path), path.rstrip("/")
    if store.exists(path) and not overwrite:
        raise ArtifactExists(path)
    temp, old = f"{path}.tmp-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        yield temp
        had = store.exists(path)
        if had and not store.rename(path, old):
            raise ArtifactError(f"cannot move {path} away")
        if not store.rename(temp, path):
            if had:
                store.rename(old, path)
            raise ArtifactError(f"cannot move {temp} to {path}")
        if had:
            store.delete(old)
    finally:
        if store.exists(temp):
            store.delete(temp)


def write_file(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """One small text file, whole or not at all: written beside and renamed."""
    with swapped(spark, path, overwrite) as temp:
        store = Store(spark, temp)
        out = store.fs.create(store.of(temp), False)
        out.write(bytearray(text.encode()))
        out.close()


def read_file(spark: SparkSession, path: str) -> str:
    if not Store(spark, path).exists(path):
        raise ArtifactMissing(path)
    return spark.read.text(path, wholetext=True).first()[0]


def _put_metadata(spark: SparkSession, folder: str, fields: dict) -> None:
    fields = {"created_at": datetime.now(UTC).isoformat()} | fields
    spark.createDataFrame([(json.dumps(fields, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/metadata")


def metadata(spark: SparkSession, path: str) -> dict:
    if not Store(spark, path).exists(f"{path}/metadata"):
        raise ArtifactMissing(path)
    return json.loads(spark.read.text(f"{path}/metadata", wholetext=True).first()[0])


def require_columns(df: DataFrame, names: tuple[str, ...]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnsMissing(", ".join(missing))


def _checked(spark: SparkSession, path: str, versions: tuple[int, ...]) -> dict:
    found = metadata(spark, path)
    if found.get("schema_version") not in versions:
        raise VersionMismatch(f"{path}: version {found.get('schema_version')}, reads {versions}")
    return found


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema``; absent ones are null."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def save_trajectories(trajectories: DataFrame, states: DataFrame, path: str, overwrite: bool = False, source_dataset: str | None = None, condition_id: str | None = None) -> None:
    """Cached trajectories, always in the newest version. JSON columns must
    hold JSON, and the two tables the same trajectories, each with as many
    states as it says and positions from 0 on."""
    spark = states.sparkSession
    for df in (trajectories, states):
        require_json(df, [c for c in df.columns if c.endswith("_json")])
    counted = states.groupBy("trajectory_id").agg(F.count("*").alias("_n"), F.count_distinct("position").alias("_d"), F.min("position").alias("_lo"), F.max("position").alias("_hi"))
    both = trajectories.withColumn("_here", F.lit(True)).join(counted, "trajectory_id", "full")
    whole = F.col("_here") & (F.col("_n") == F.col("_d")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("_n") - 1)
    if "n_states" in trajectories.columns:
        whole = whole & (F.col("n_states").isNull() | (F.col("n_states") == F.col("_n")))
    if not both.where(~F.coalesce(whole, F.lit(False))).isEmpty():
        raise ArtifactError("trajectories and states do not agree, or positions are not 0, 1, ...")
    with swapped(spark, path, overwrite) as temp:
        conformed(trajectories, TRAJECTORIES_SCHEMA).write.parquet(f"{temp}/trajectories.parquet")
        conformed(states, STATES_SCHEMA).write.parquet(f"{temp}/states.parquet")
        _put_metadata(spark, temp, {"schema_version": TRAJECTORIES_VERSION, "n_trajectories": trajectories.count(), "source_dataset": source_dataset, "condition_id": condition_id})


def load_trajectories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trajectories, states) of any readable version; columns that an older
    version lacks are null."""
    _checked(spark, path, READS)
    return conformed(spark.read.parquet(f"{path}/trajectories.parquet"), TRAJECTORIES_SCHEMA), conformed(spark.read.parquet(f"{path}/states.parquet"), STATES_SCHEMA)


def require_json(df: DataFrame, columns: list[str]) -> None:
    """Raise where a value that is not null is no JSON: one aggregate."""
    if not columns:
        return
    bad = df.agg(*[F.sum((F.col(c).isNotNull() & F.try_parse_json(c).isNull()).cast("int")).alias(c) for c in columns]).first()
    wrong = [c for c in columns if bad[c]]
    if wrong:
        raise ArtifactError(f"no JSON in {', '.join(wrong)}")


def decoded_states(states: DataFrame) -> DataFrame:
    """JSON columns as maps; a state's action to the next one as a struct, null
    at the end."""
    action = F.struct(F.col("action_id_to_next").alias("action_id"), F.col("action_category_to_next").alias("action_category"), F.from_json("action_metadata_to_next_json", "map<string,string>").alias("metadata"))
    return states.select(
        "*",
        F.from_json("hypothesis_distribution_json", "map<string,double>").alias("distribution"),
        F.from_json("top_k_logprobs_json", "map<string,double>").alias("top_k_logprobs"),
        F.from_json("metadata_json", "map<string,string>").alias("metadata"),
        F.when(F.col("action_id_to_next").isNotNull(), action).alias("action"),
    )


def decoded_outcomes(trajectories: DataFrame) -> DataFrame:
    """A trajectory's outcome as a struct; null without a primary label."""
    outcome = F.struct("primary_label", "confidence", F.from_json("secondary_labels_json", "map<string,string>").alias("secondary_labels"))
    return trajectories.select("*", F.when(F.col("primary_label").isNotNull(), outcome).alias("outcome"))


class StoredTrajectories:
    """A trajectory source that reads cached trajectories."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def metadata(self) -> dict:
        return _checked(self.spark, self.path, READS)

    def load(self) -> tuple[DataFrame, DataFrame]:
        trajectories, states = load_trajectories(self.spark, self.path)
        return decoded_outcomes(trajectories), decoded_states(states)


def nested(trajectories: DataFrame, states: DataFrame) -> DataFrame:
    """One row a trajectory with its states in order."""
    row = F.struct("position", *[c for c in states.columns if c not in ("trajectory_id", "position")])
    return trajectories.join(states.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(row)).alias("states")), "trajectory_id", "left")


def iter_trajectories(spark: SparkSession, path: str):
    """Trajectories one by one, a partition at a time on the driver."""
    return nested(*load_trajectories(spark, path)).toLocalIterator(prefetchPartitions=False)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, overwrite: bool = False, extra: dict | None = None) -> None:
    spark = nodes.sparkSession
    guards.edges_valid(nodes, edges)
    with swapped(spark, path, overwrite) as temp:
        conformed(nodes, "node_id string, visit_count int, is_terminal boolean").write.parquet(f"{temp}/nodes.parquet")
        conformed(edges, "source_id string, action_id string, target_id string, frequency int, voi float, consensus_rate float, classification tinyint").write.parquet(f"{temp}/edges.parquet")
        _put_metadata(spark, temp, {"schema_version": GRAPH_VERSION, "graph_metadata": extra or {}})


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    _checked(spark, path, (GRAPH_VERSION,))
    return spark.read.parquet(f"{path}/nodes.parquet"), spark.read.parquet(f"{path}/edges.parquet")


def vector_dimension(visits: DataFrame, dimension: int | None = None) -> int:
    """The length that all embeddings have, or must have if it is given."""
    seen = visits.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"), F.sum(F.col("embedding").isNull().cast("int")).alias("none")).first()
    want = dimension or seen["hi"] or 0
    if seen["none"] or (seen["hi"] is not None and (seen["lo"], seen["hi"]) != (want, want)):
        raise ArtifactError(f"embeddings must have {want} dimensions; found {seen['lo']} to {seen['hi']}, {seen['none']} missing")
    return want


def save_visits(visits: DataFrame, path: str, dimension: int | None = None, file_rows: int = 1 << 18) -> None:
    """Visits by timestep (the vector index: a folder for each), with a
    manifest of their numbers. A timestep's visits are dealt to several tasks,
    as many as its files of about ``file_rows`` ask for."""
    require_columns(visits, VISIT_COLUMNS)
    if not visits.groupBy("visit_seq").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ArtifactError("visit_seq repeats")
    length = vector_dimension(visits, dimension)
    counts = {str(r["timestep"]): r["n"] for r in visits.groupBy("timestep").agg(F.count("*").alias("n")).collect()}
    files = -(-max(counts.values(), default=1) // file_rows)
    with swapped(visits.sparkSession, path, True) as temp:
        part = F.pmod(F.xxhash64("visit_seq"), F.lit(files))
        visits.select(*VISIT_COLUMNS).repartition("timestep", part).write.partitionBy("timestep").parquet(f"{temp}/visits.parquet")
        _put_metadata(visits.sparkSession, temp, {"schema_version": VISITS_VERSION, "timesteps": counts, "dimension": length})


def vector_manifest(spark: SparkSession, path: str) -> dict[int, int]:
    """Timesteps with their numbers of visits."""
    return {int(k): n for k, n in _checked(spark, path, (VISITS_VERSION,))["timesteps"].items()}


def load_visits(spark: SparkSession, path: str) -> DataFrame | None:
    """The visits, or None where there is no such artifact."""
    if not Store(spark, path).exists(path):
        return None
    _checked(spark, path, (VISITS_VERSION,))
    found = spark.read.parquet(f"{path}/visits.parquet")
    require_columns(found, VISIT_COLUMNS)
    return found.select(*VISIT_COLUMNS)


def save_index(index: Index, path: str) -> None:
    """A vector index: its tree of centres and radii, and the members in a
    folder for each timestep, with the leaf that each is in."""
    with swapped(index.tree.sparkSession, path, True) as temp:
        index.members.repartition("timestep", "node").write.partitionBy("timestep").parquet(f"{temp}/members.parquet")
        index.tree.write.parquet(f"{temp}/tree.parquet")
        kind = index.members.schema["timestep"].dataType.simpleString()
        _put_metadata(index.tree.sparkSession, temp, {"schema_version": VISITS_VERSION, "depth": index.depth, "timestep": kind})


def load_index(spark: SparkSession, path: str) -> Index:
    found = _checked(spark, path, (VISITS_VERSION,))
    members = spark.read.parquet(f"{path}/members.parquet").withColumn("timestep", F.col("timestep").cast(found["timestep"]))
    return Index(members.select("visit_seq", "timestep", "embedding", "node"), spark.read.parquet(f"{path}/tree.parquet"), found["depth"])


def save_table(df: DataFrame, path: str, required: tuple[str, ...], extra: dict | None = None, overwrite: bool = True) -> None:
    """One table with metadata: scores, assembly indices."""
    require_columns(df, required)
    with swapped(df.sparkSession, path, overwrite) as temp:
        df.write.parquet(f"{temp}/table.parquet")
        _put_metadata(df.sparkSession, temp, {"schema_version": SCORES_VERSION} | (extra or {}))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    _checked(spark, path, (SCORES_VERSION,))
    return spark.read.parquet(f"{path}/table.parquet")


def save_scores(scores: DataFrame, path: str, weights: dict[str, float], prompt_versions: dict[str, int] | None = None) -> None:
    save_table(scores, path, SCORE_COLUMNS, {"weights": weights, "normalization": "rank_percentile", "prompt_versions": prompt_versions or {}})


def load_weights(spark: SparkSession, path: str) -> dict[str, float]:
    return _checked(spark, path, (SCORES_VERSION,))["weights"]


def save_assembly(indices: DataFrame, path: str) -> None:
    save_table(indices, path, ASSEMBLY_COLUMNS)


def save_results(tables: dict[str, DataFrame], summary: dict, path: str, overwrite: bool = True) -> None:
    """Result tables, each as one CSV file with a header, and a JSON summary:
    for tables that people read, of a row a rule, score or composite."""
    spark = next(iter(tables.values())).sparkSession
    with swapped(spark, path, overwrite) as temp:
        for name, table in tables.items():
            table.coalesce(1).write.option("header", True).csv(f"{temp}/{name}")
        spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.text(f"{temp}/summary")


def load_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{name}")


def append_json(rows: DataFrame, path: str, part: str | None = None) -> bool:
    """Add ``rows`` to the log at ``path`` as one part, whole or not at all:
    written aside, where readers don't look, and renamed. The parts' folders
    are the log's manifest: a part that is there already, as after a retry, is
    not added again, and False comes back."""
    store, name = Store(rows.sparkSession, path), part or uuid.uuid4().hex
    if store.exists(f"{path}/{name}"):
        return False
    aside = f"{path}/_writing-{uuid.uuid4().hex}"
    rows.write.json(aside)
    # Of two that write a part at once one is first; the other finds it there.
    if store.exists(f"{path}/{name}") or not store.rename(aside, f"{path}/{name}"):
        store.delete(aside)
        return False
    return True


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).json(path)


def remaining(work: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    """The units not processed yet."""
    return work.join(done.select(key), key, "left_anti")


def resumed(spark: SparkSession, work: DataFrame, path: str, process: Callable[[DataFrame], DataFrame], key: str = "question_id", parts: int = 1, run: str | None = None) -> DataFrame:
    """Process what the log at ``path`` lacks, append it, return the log. With
    ``parts`` the work is done in so many pieces, by the key's hash, each
    logged when it is done, so that a stop loses one piece at most. The log is
    read once. A ``run`` that is named and started again leaves out the pieces
    that it has logged, without looking at what is in them."""
    kind = work.schema[key].dataType
    done = spark.createDataFrame([], f"`{key}` {kind.simpleString()}")
    store, name = Store(spark, path), run or uuid.uuid4().hex
    if store.exists(path):
        log = read_log(spark, path)
        done = log.select(F.col(key).cast(kind).alias(key)) if key in log.columns else done
    done = cut_lineage(done, "done")
    for k in range(parts):
        part = f"{name}-{parts}-{k}"
        if not store.exists(f"{path}/{part}"):
            own = work.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k) if parts > 1 else work
            append_json(process(remaining(own, done, key)), path, part)
    return read_log(spark, path)
