"""Sweeps, their records and summaries, and the tables they are kept in."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embed, metrics, probe, sage
from ..operators.ranks import ranked, unused
from ..schema import TypedGraph, global_edges
from ..sources.graphs import flagged


def seeds(base: int, runs: int, warmup: int) -> list[int]:
    """A warm-up uses its first seed base + 1,000,000, in two passes of one seed; timed runs use base, base + 1, ..."""
    return [base + 1_000_000 + i for i in range(warmup) for _ in range(2)] + [base + i for i in range(runs)]


def accepted(f: Callable, **options) -> dict:
    """Those of ``options`` that ``f`` takes by name."""
    import inspect

    names = inspect.signature(f).parameters
    return {k: v for k, v in options.items() if k in names}


def evaluated(graph: TypedGraph, node_map: DataFrame, super_y: DataFrame, pred: DataFrame | None = None) -> dict:
    """Bound and scores of a map, judged on original nodes: of predictions (type_id, super_id, p), or of a probe that is fitted
    on supernodes (type_id, super_id, y)."""
    t_id = graph.types.where(F.col("node_type") == graph.target).first()["type_id"]
    bound = metrics.oracle_upper_bound(graph.nodes, node_map).first().asDict()
    if pred is None:
        pred = probed(graph, node_map, super_y, t_id)
    score = metrics.classification(metrics.on_originals(pred.select("type_id", "super_id", "p"), graph.nodes, node_map)).first().asDict()
    return {"upper_bound": bound["upper_bound"], "oracle_gap": (bound["upper_bound"] or 0) - (score["accuracy"] or 0)} | score


def probed(graph: TypedGraph, node_map: DataFrame, super_y: DataFrame, t_id: int) -> DataFrame:
    """A probe's predictions for supernodes, from the means of their members' embeddings."""
    h = embed.fast_embed(graph.nodes, global_edges(graph.edges, graph.types))
    sup = h.join(node_map.select("gid", "type_id", "super_id"), "gid").where(F.col("type_id") == t_id)
    mean = embed.vector_mean(sup.select("type_id", "super_id", F.col("h").alias("x")), ["type_id", "super_id"]).withColumnRenamed("x", "h")
    labelled = mean.join(super_y.select("type_id", "super_id", "y"), ["type_id", "super_id"])
    return probe.predicted(probe.fitted(labelled.where("y >= 0")), labelled)


def enough_validation(graph: TypedGraph, supernodes: DataFrame, least: int = 5, seed: int = 0) -> DataFrame:
    """Supernodes of the target type (super_id, y, flags); with fewer than ``least`` for validation, the labelled ones are split
    anew in the shares of the graph's own split."""
    if supernodes.where("is_val and y >= 0").limit(least).count() >= least:
        return supernodes
    own = graph.nodes.agg(*(F.count_if(F.col(c) & (F.col("y") >= 0)).alias(c) for c in ("is_train", "is_val", "is_test"))).first()
    total = max(1, sum(own))
    labelled = supernodes.where("y >= 0").drop("is_train", "is_val", "is_test").withColumnRenamed("super_id", "node_id")
    again = resplit(labelled, own["is_train"] / total, own["is_val"] / total, seed).withColumnRenamed("node_id", "super_id")
    return again.unionByName(supernodes.where("y < 0").withColumns({c: F.lit(False) for c in ("is_train", "is_val", "is_test")}))


def network(graph: TypedGraph, data, epochs: int = 200, hidden: int = 16, layers: int = 2, rate: float = 1e-2, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """(type_id, super_id, p) by a typed network trained on a quotient, with its soft labels where it has some, and the epochs'
    losses and accuracies. Supernodes without features have the log of their size."""
    t_id = graph.types.where(F.col("node_type") == graph.target).first()["type_id"]
    classes = 1 + int(graph.nodes.where(F.col("type_id") == t_id).agg(F.max("y")).first()[0] or 0)
    gid = lambda t, s: (F.col(t).cast("long") * F.lit(1 << 40) + F.col(s)).alias("gid")
    ours = F.col("type_id") == t_id
    split = enough_validation(graph, data.nodes.where(ours).select("super_id", "y", "is_train", "is_val", "is_test"), seed=seed)
    flags = split.select(F.lit(t_id).alias("type_id"), "super_id", "y", "is_train", "is_val")
    x = F.coalesce("x", F.array(F.log1p(F.col("size").cast("double")))).alias("x")
    soft = F.lit(None).cast("array<double>")
    if "y_soft" in data.nodes.columns:
        share = F.map_from_entries("y_soft")
        soft = F.when(F.size("y_soft") > 0, F.array(*[F.coalesce(F.try_element_at(share, F.lit(c)), F.lit(0.0)) for c in range(classes)]))
    nodes = data.nodes.select("type_id", "super_id", gid("type_id", "super_id"), x, soft.alias("soft")).join(flags, ["type_id", "super_id"], "left")
    ids = {r["node_type"]: r["type_id"] for r in graph.types.collect()}  # one row for each type
    number = F.create_map(*[F.lit(z) for kv in ids.items() for z in kv])
    ends = data.edges.withColumns({"st": number[F.col("src_type")], "dt": number[F.col("dst_type")]})
    g = ends.select("src_type", "rel", "dst_type", gid("st", "ssn").alias("s"), gid("dt", "dsn").alias("d"))
    model = sage.prepared(nodes, g, t_id, classes, hidden, layers)
    w = sage.trained(model, epochs, rate, seed=seed)
    pred = model.predicted(w).select(F.lit(t_id).alias("type_id"), F.pmod("gid", F.lit(1 << 40)).alias("super_id"), "p")
    return pred, model.history


def run_once(graph: TypedGraph, ratio: float, compressor: Callable, seed: int = 42, model: str = "probe", training: dict | None = None, **how) -> dict:
    """One record: compress (the seed goes to compressors that take one), bound, fit on supernodes, score on original nodes, and
    compare what is stored. ``model`` is the probe, or "gnn": a network trained on the quotient with options ``training``."""
    stage = Stages()
    with stage("compress"):
        res = compressor(graph, ratio=ratio, **how, **accepted(compressor, seed=seed))
    with stage("evaluate"):
        pred, history = network(graph, res.data, seed=seed, **(training or {})) if model == "gnn" else (None, [])
        found = evaluated(graph, res.node_map, res.data.nodes, pred)
    with stage("storage"):
        whole, small = (metrics.storage(n, e).first()["bytes"] for n, e in ((graph.nodes, graph.edges), (res.data.nodes, res.data.edges)))
    plain = {k: v for k, v in res.info.items() if isinstance(v, int | float | str | bool)}
    times = {f"seconds_{k}": v for k, v in stage.seconds.items()} | {"seconds": stage.seconds["compress"]}
    return plain | {"ratio": ratio, "seed": seed, "model": model, "epochs": len(history), "storage_ratio": small / max(1, whole)} | times | found


def run_baseline(graph: TypedGraph, seed: int = 42) -> dict:
    """The same probe on the graph as it is: every node is its own supernode."""
    t = time.time()
    one = graph.nodes.select("type_id", "gid", F.col("node_id").alias("super_id"), F.when(F.col("is_train"), F.col("y")).otherwise(-1).alias("y"))
    return {"method": "original", "ratio": 1.0, "seed": seed} | evaluated(graph, one.drop("y"), one) | {"seconds": time.time() - t}


def eval_pipeline(graph: TypedGraph, label: str, cmap: DataFrame, **how) -> dict:
    """A record for a stored map (gid, root): retention by type, the quotient, and its scores beside the original's."""
    from .api import finish

    res = finish(graph, cmap, {"method": label}, **how)
    kept = res.node_map.groupBy("type_id").agg((F.count_distinct("super_id") / F.count("*")).alias("kept")).join(graph.types, "type_id").collect()  # one row for each type
    found, base = evaluated(graph, res.node_map, res.data.nodes), run_baseline(graph)
    return {"method": label, "retention": res.ratio, "by_type": {r["node_type"]: r["kept"] for r in kept}, "baseline_accuracy": base["accuracy"], "accuracy_loss": (base["accuracy"] or 0) - (found["accuracy"] or 0)} | found


def run_sweep(graph: TypedGraph, ratios: list[float], compressor: Callable, runs: int = 3, warmup: int = 1, base_seed: int = 42, run: Callable = run_once, after: Callable[[list[dict]], None] | None = None, **how) -> list[dict]:
    """A record for each ratio and timed seed, which every run gets; warm-up runs come once, at the first ratio, and are
    thrown away. ``after`` gets a ratio's records when it is done, so a crash loses one ratio at most."""
    out = []
    for n, ratio in enumerate(ratios):
        warm = warmup if n == 0 else 0
        records = [run(graph, ratio, compressor, seed=seed, **how) | {"seed": seed} for seed in seeds(base_seed, runs, warm)][2 * warm :]
        if after:
            after(records)
        out += records
    return out


def resumed_sweep(graph: TypedGraph, ratios: list[float], compressor: Callable, log: str, config: str, runs: int = 3, base_seed: int = 42, run: Callable = run_once, **how) -> list[dict]:
    """A sweep that keeps its records in an append-only log, a folder that Spark writes: each run's record is there before the
    next begins, and runs whose configuration, ratio and seed the log already holds aren't repeated. All records of the
    sweep, old and new."""
    spark = graph.nodes.sparkSession
    wanted = [(float(ratio), seed) for ratio in ratios for seed in seeds(base_seed, runs, 0)]
    have = {(r["ratio"], r["seed"]): r for r in logged(spark, log, config)}
    for ratio, seed in wanted:
        if (ratio, seed) not in have:
            record = run(graph, ratio, compressor, seed=seed, **how) | {"config": config, "ratio": ratio, "seed": seed}
            appended(spark, log, record)
            have[ratio, seed] = record
    return [have[key] for key in wanted]


def appended(spark: SparkSession, log: str, record: dict) -> None:
    """One more record of a log. Records may differ in their fields, so each is a JSON text beside its configuration."""
    import json

    spark.createDataFrame([(record["config"], json.dumps(record, default=str))], "config string, record string").coalesce(1).write.mode("append").parquet(log)


def logged(spark: SparkSession, log: str, config: str) -> list[dict]:
    """The records of a configuration; a log that isn't there has none."""
    import json

    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("config string, record string").parquet(log)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [json.loads(r["record"]) for r in rows.where(F.col("config") == config).collect()]


class Stages:
    """Wall seconds of named stages: ``with stages("build"): ...``."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextlib.contextmanager
    def __call__(self, name: str):
        t = time.time()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.time() - t


def provenance(spark: SparkSession, **arguments) -> dict:
    """What a run depends on: versions, arguments, the session's size and the time."""
    import platform

    return {"python": platform.python_version(), "spark": spark.version, "machine": platform.platform(), "parallelism": spark.sparkContext.defaultParallelism, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "arguments": arguments}


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table; numbers with four places, missing values empty."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [columns, ["---"] * len(columns), *([cell(r.get(c)) for c in columns] for r in rows)]
    return "".join(f"| {' | '.join(x)} |\n" for x in lines)


def console(rows: list[dict], columns: list[str]) -> str:
    """The same as aligned plain text."""
    table = [columns, *([f"{v:.4f}" if isinstance(v := r.get(c), float) else "" if v is None else str(v) for c in columns] for r in rows)]
    width = [max(len(r[i]) for r in table) for i in range(len(columns))]
    return "\n".join("  ".join(x.rjust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in table)


def report(spark: SparkSession, folder: str, records: list[dict], keys: list[str], values: list[str], **arguments) -> None:
    """Writes into ``folder`` (any path that Spark writes): rows and summary as Parquet and CSV, a Markdown table of the
    summary, and a manifest of what was run. Summaries have a row for each configuration."""
    import json

    saved(spark, records, f"{folder}/rows", "overwrite")
    per = summary(spark.createDataFrame([{k: r.get(k) for k in (*keys, *values)} for r in records]), keys, values).orderBy(*keys)
    per.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/summary.csv")
    rows = [r.asDict() for r in per.collect()]
    manifest = {"records": len(records), "configurations": len(rows), "keys": keys, "values": values} | provenance(spark, **arguments)
    for name, text in (("summary.md", markdown(rows, per.columns)), ("manifest.json", json.dumps(manifest, indent=1, default=str))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


#: Names of methods in reports, and other names of data sets.
LABELS = {"main": "typed coarsening", "random_type": "random by type", "lsh": "hashed order", "cgc_homo": "greedy, untyped", "freehgc": "selection", "cgc_type": "typed coarsening, preset", "original": "original graph"}
ALIASES = {"acm": "acm3", "mag": "ogbn-mag", "lfm": "lastfm"}


def label(method: str) -> str:
    """A method's label; ``name:embedding`` gives the name's with the embedding."""
    name, _, emb = method.partition(":")
    return LABELS.get(name, name) + (f" on {emb}" if emb else "")


def summary(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and population deviation over runs; missing values don't count."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *(a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"))))


def best_ratio(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The ratio of the largest value in each group, ties to the smaller ratio."""
    return runs.groupBy(*keys).agg(F.max(F.struct(F.col(value), (-F.col("ratio")).alias("r"))).alias("b")).select(*keys, (-F.col("b.r")).alias("best_ratio"), F.col(f"b.{value}").alias(f"best_{value}"))


def model_means(runs: DataFrame, keys: list[str], model: str, value: str) -> DataFrame:
    """The mean over models of each model's mean."""
    return runs.groupBy(*keys, model).agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.avg("m").alias(f"{value}_mean"), F.count("*").alias("models"))


def finished(runs: DataFrame, keys: list[str], wanted: list[float]) -> DataFrame:
    """Keys whose runs cover all wanted ratios."""
    got = runs.groupBy(*keys).agg(F.collect_set("ratio").alias("done"))
    return got.where(F.size(F.array_except(F.array(*[F.lit(float(r)) for r in wanted]), "done")) == 0).select(*keys)


def saved(spark: SparkSession, records: list[dict], path: str, how: str = "append") -> None:
    """Appends records (a union of their columns) as Parquet; csv and json by the path's ending."""
    names = sorted({k for r in records for k in r})
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], names)
    kind = path.rpartition(".")[2] if path.rpartition(".")[2] in ("csv", "json") else "parquet"
    writer = df.write.mode(how)
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path) if kind == "json" else writer.parquet(path)


def cached_union(old: DataFrame, new: DataFrame, config: list[str]) -> DataFrame:
    """Rows of the cache whose configuration isn't among the new ones, and the new ones."""
    return old.join(new.select(*config).distinct(), config, "left_anti").unionByName(new, allowMissingColumns=True)


def resplit(nodes: DataFrame, train: float, val: float, seed: int = 0) -> DataFrame:
    """Supernode flags anew (node_id, y): int(train n), int(val n), the rest, in a stateless random order."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("node_id").cast("string")))
    r, n = unused(nodes.columns, "r", "n")
    a, b = F.floor(F.col(n) * train), F.floor(F.col(n) * val)
    return flagged(ranked(nodes, [], [key, "node_id"], r, n), F.lit(True), F.col(r), a, b).drop(r, n)
