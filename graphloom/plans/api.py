"""compress(): from a typed graph to a smaller one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baselines, coarsen, embed, metrics, quotient, reduce, sage, search, topology
from ..operators.tables import removed, stored
from ..schema import TypedGraph, global_edges, validated


@dataclass(frozen=True)
class Result:
    data: quotient.Compressed
    ratio: float
    node_map: DataFrame
    info: dict


@dataclass(frozen=True)
class Context:
    """What compressions of one graph share: the embedded kernel graph, the first candidates, the mediators' energies. ``paths``
    are its own tables, which :meth:`close` deletes; results that weren't read by then are lost."""

    graph: TypedGraph
    kernel: coarsen.Kernel
    links: DataFrame
    candidates: tuple[DataFrame, DataFrame]
    energies: DataFrame
    mean_degree: float
    max_candidates: int
    window: int
    hub_caps: bool | int | dict[int, int]
    explained: dict = field(default_factory=dict)
    paths: list[str] = field(default_factory=list)

    def close(self) -> None:
        removed(self.energies.sparkSession, self.paths)
        self.paths.clear()

    def __enter__(self) -> Context:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def embedded(graph: TypedGraph, hold: Callable[[DataFrame], DataFrame], paths: list[str], emb_method: str = "fast", dim: int = 4, hops: int = 2, max_candidates: int = 128, window: int = 20, hub_caps: bool | int | dict[int, int] = True, seed: int = 42, pretrain_epochs: int = 100, pca_dim: int | None = None) -> Context:
    """The context of ``graph``; ``hold`` cuts a table's lineage."""
    if emb_method not in ("fast", "relprop", "raw", "metapath", "gnn"):
        raise ValueError("emb_method must be fast, relprop, raw, metapath or gnn")
    validated(graph.edges, graph.types)
    g = global_edges(graph.edges, graph.types)
    k = coarsen.kernel_of(graph)
    if emb_method in ("metapath", "gnn"):
        if emb_method == "gnn":
            h = sage.embedding(graph, hold(g), hold(k.nodes), dim, pretrain_epochs, seed=seed)
        else:
            h = embed.metapath_embed(graph, g, dim, seed=seed)
        k = coarsen.Kernel(k.nodes.join(h, "gid", "left").select("gid", "type_id", F.coalesce("h", "x").alias("x")), k.edges)
    elif emb_method != "raw":
        h = (embed.fast_embed if emb_method == "fast" else embed.relation_embed)(graph.nodes, hold(g), hops, dim)
        k = coarsen.Kernel(k.nodes.join(h, "gid").select("gid", "type_id", F.coalesce("h", "x").alias("x")), k.edges)
    explained = {}
    if pca_dim:
        reduced, explained = reduce.pca_by_type(hold(k.nodes), pca_dim)
        k = coarsen.Kernel(reduced, k.edges)
    k = coarsen.Kernel(hold(k.nodes), hold(k.edges))
    adj = topology.adjacency(k.edges)
    deg = topology.degrees(adj, k.nodes)
    lists = topology.mediator_lists(adj, deg, topology.hub_caps(deg, hub_caps) if hub_caps is not False else None)
    ordered, near = coarsen.candidate_pairs(k, window, max(2, max_candidates), hub_caps)
    energies = hold(search.mediator_energies(lists, k.nodes, topology.feature_variance(k.nodes)))
    mean_degree = float(deg.agg(F.avg("degree")).first()[0] or 0)
    # The first pass of every run of a search starts with these candidates.
    return Context(graph, k, g, (ordered, hold(near)), energies, mean_degree, max(2, max_candidates), window, hub_caps, explained, paths)


def prepared(graph: TypedGraph, **options) -> Context:
    """A context for several compressions of ``graph`` (``options``: those of :func:`compress` that it takes over, from
    ``emb_method`` to ``pca_dim``). It keeps a copy of the graph, so its sources are read once; close it, or use it in a with block."""
    spark, paths = graph.nodes.sparkSession, []

    def hold(df: DataFrame) -> DataFrame:
        out, path = stored(df, "context")
        paths.append(path)
        return out

    try:
        own = replace(graph, types=hold(graph.types), nodes=hold(graph.nodes), edges=hold(graph.edges))
        return embedded(own, hold, paths, **options)
    except BaseException:
        removed(spark, paths)
        raise


def compressed_by(graph: TypedGraph, methods: dict[str, tuple[Callable, dict]], ratio: float, each: Callable[[str, Result], object], **options) -> dict[str, object]:
    """What ``each(name, result)`` makes of the result of each method (a compressor that takes a context, its options), all on one
    context, which is deleted afterwards."""
    with prepared(graph, **options) as c:
        return {name: each(name, run(c.graph, ratio, context=c, **how)) for name, (run, how) in methods.items()}


def compress(graph: TypedGraph, ratio: float = 0.1, emb_method: str = "fast", dim: int = 4, hops: int = 2, pairwise_merge: bool = True, merge_objective: str = "ward", skip_reassignment: bool = False, type_thresholds: bool = False, metapath_thresholds: bool = False, edge_weight_mode: str = "binary", use_soft_labels: bool = False, freeze_node_types: tuple[str, ...] = (), ratio_search: str = "fast", auto_search_runs: int = 8, auto_target_tolerance: float | None = None, max_candidates: int = 128, window: int = 20, hub_caps: bool | int | dict[int, int] = True, levels: int = 5, outers: int = 10, seed: int = 42, pretrain_epochs: int = 100, pca_dim: int | None = None, context: Context | None = None) -> Result:
    """Keeps about ``ratio`` of the nodes. Embeddings are 'fast', 'relprop', 'raw', 'metapath' or 'gnn' (a network trained for
    ``pretrain_epochs`` at most); ``pca_dim`` reduces each type's vectors. The search is 'fast' or 'precise'. Mediator lists are thinned to ``max_candidates`` and joined in a band of ``window`` ranks. A run has
    ``levels`` * ``outers`` passes at most, and ends at the wanted ratio or without merges. ``seed`` draws walks; all other
    steps are free of chance. A ``context`` of :func:`prepared` brings its own embeddings, candidates and seed."""
    if ratio_search not in ("fast", "precise"):
        raise ValueError("ratio_search must be fast or precise")
    if edge_weight_mode not in quotient.MODES:
        raise ValueError(f"edge_weight_mode must be one of {quotient.MODES}")
    c = context or embedded(graph, coarsen.settled, [], emb_method, dim, hops, max_candidates, window, hub_caps, seed, pretrain_epochs, pca_dim)
    graph, k, energies, want = c.graph, c.kernel, c.energies, 1 / ratio
    first = search.one_shot_scale(energies, want, c.mean_degree, fallback=lambda: search.cdf_scale(search.sampled_distances(c.links, k.nodes, graph), want))
    base = None
    if type_thresholds or metapath_thresholds:
        base = search.bases(energies, search.one_shot_share(want, c.mean_degree), ["t_src", "t_med"])
        if not metapath_thresholds:
            one = search.bases(energies, search.one_shot_share(want, c.mean_degree), ["t_src"])
            base = base.select("t_src", "t_med").join(one.select("t_src", "scale"), "t_src")
        base, first = coarsen.settled(base.select("t_src", "t_med", "scale")), 1.0

    def run(scale: float):
        scales = base.withColumn("scale", F.col("scale") * scale) if base is not None else None
        m, info = coarsen.coarsened(k, scale, want, levels=levels, outers=outers, window=c.window, cap=c.max_candidates, hubs=c.hub_caps, first=c.candidates, reassign=not skip_reassignment, pairwise=pairwise_merge, objective="dirichlet" if merge_objective == "dirichlet" else "ward", scales=scales)
        return m, info["nodes"] / max(1, info["supernodes"])

    if ratio_search == "fast":
        cmap, info = search.fast_search(run, first, ratio, base is not None)
    else:
        cmap, info = search.precise_search(run, first, ratio, auto_target_tolerance or 0.05, auto_search_runs)
    if c.explained:
        info = info | {"explained_variance": c.explained}
    return finish(graph, cmap, info, edge_weight_mode, use_soft_labels, freeze_node_types)


def finish(graph: TypedGraph, cmap: DataFrame, info: dict, edge_weight_mode: str = "binary", use_soft_labels: bool = False, freeze_node_types: tuple[str, ...] = ()) -> Result:
    """The quotient and what it keeps; the one back end of all compressors."""
    if freeze_node_types:
        cmap = quotient.freeze(cmap, graph.nodes, graph.types, list(freeze_node_types))
    data = quotient.build(graph, cmap, edge_weight_mode, use_soft_labels)
    kept = metrics.compression(graph.nodes, data.node_map, graph.edges, data.edges).first().asDict()
    return Result(data, kept["node_retention"], data.node_map, info | kept)


def compress_random_type(graph: TypedGraph, ratio: float = 0.1, seed: int = 42, **how) -> Result:
    return finish(graph, baselines.random_type(graph.nodes, ratio, seed), {"method": "random_type"}, **how)


def compress_lsh(graph: TypedGraph, ratio: float = 0.1, hash_bits: int = 16, **how) -> Result:
    return finish(graph, baselines.lsh(graph.nodes, ratio, hash_bits), {"method": "lsh"}, **how)


def compress_cgc_homo(graph: TypedGraph, ratio: float = 0.1, max_hub_degree: int = 512, max_candidates: int = 128, context: Context | None = None, **how) -> Result:
    """Greedy merges by degree, on the normalised features or on a context's embeddings."""
    graph, k = (context.graph, context.kernel) if context else (graph, coarsen.kernel_of(graph))
    k = k if context else coarsen.Kernel(coarsen.settled(k.nodes), coarsen.settled(k.edges))
    adj = topology.adjacency(k.edges)
    deg = topology.degrees(adj, k.nodes)
    cand = topology.two_hop_candidates(adj, deg, max_hub_degree, max_candidates)
    return finish(graph, coarsen.settled(baselines.cgc_homo(cand, k.nodes, deg, ratio)), {"method": "cgc_homo"}, **how)


def compress_freehgc(graph: TypedGraph, ratio: float = 0.1, num_hops: int = 2, **how) -> Result:
    k = coarsen.kernel_of(graph)
    g = global_edges(graph.edges, graph.types)
    reps = embed.hop_concat(embed.start(graph.nodes, 4), g, num_hops)
    return finish(graph, baselines.freehgc(graph, topology.adjacency(coarsen.settled(k.edges)), reps, ratio, num_hops), {"method": "freehgc"}, **how)


#: Compressors by name.
COMPRESSORS = {"main": compress, "random_type": compress_random_type, "lsh": compress_lsh, "cgc_homo": compress_cgc_homo, "freehgc": compress_freehgc, "cgc_type": lambda graph, ratio=0.1, **how: compress(graph, ratio, pairwise_merge=True, type_thresholds=False, metapath_thresholds=False, **how)}
#: Presets of options for ablations, by name.
VARIANTS = {
    "full": {}, "no_reassign": {"skip_reassignment": True}, "ball": {"pairwise_merge": False}, "dirichlet": {"merge_objective": "dirichlet"}, "raw": {"emb_method": "raw"}, "relprop": {"emb_method": "relprop"},
    "typed": {"type_thresholds": True}, "metapath": {"metapath_thresholds": True}, "count_edges": {"edge_weight_mode": "count"}, "log_edges": {"edge_weight_mode": "log_count"}, "density_edges": {"edge_weight_mode": "density"}, "soft_labels": {"use_soft_labels": True},
}
