"""Search requests: what to search, by which routes, and how to fuse them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Route:
    """One ranked list: the field, its metric, its limit and its own filter."""

    field: str = "summary_dense"
    metric: str = "COSINE"
    limit: int = 10
    where: str = ""
    drop_ratio: float = 0.0

    def __post_init__(self):
        if self.metric not in ("COSINE", "IP", "BM25"):
            raise ValueError(f"unknown metric {self.metric}")
        if not 0 < self.limit <= 500:
            raise ValueError("a route's limit is 1 to 500")


@dataclass(frozen=True)
class Fusion:
    method: str = "rrf"
    k: int = 60
    weights: tuple[float, ...] = (0.3, 0.4, 0.3)
    normalise: bool = True

    def __post_init__(self):
        if self.method not in ("rrf", "weighted"):
            raise ValueError(f"unknown fusion {self.method}")
        if not 0 < self.k <= 200:
            raise ValueError("k is 1 to 200")


@dataclass(frozen=True)
class Search:
    routes: tuple[Route, ...] = (Route(),)
    fusion: Fusion = field(default_factory=Fusion)
    limit: int = 10
    output: tuple[str, ...] = ("summary", "document", "source", "source_name", "lt_doc_id", "chunk_id", "text")

    def __post_init__(self):
        if not 0 < self.limit <= 50:
            raise ValueError("the limit is 1 to 50")


def default_search() -> Search:
    """The dense question vector and BM25, weighted 8 to 2, ten of each and in all."""
    return Search((Route("summary_dense", "COSINE", 10), Route("text_sparse", "IP", 10)), Fusion("weighted", weights=(0.8, 0.2)))


def api_search(limit: int, where: str = "", hybrid: bool = True) -> Search:
    """Both routes with twice the limit and reciprocal ranks, or the dense one alone."""
    if not hybrid:
        return Search((Route("summary_dense", "COSINE", limit, where),), limit=limit)
    return Search((Route("summary_dense", "COSINE", limit * 2, where), Route("text_sparse", "IP", limit * 2, where)), Fusion("rrf", 60), limit)


def search_from(values: dict) -> Search:
    """A request as nested dicts, checked; unknown names are errors."""
    routes = tuple(Route(**r) for r in values.get("routes", [{}]))
    fusion = dict(values.get("fusion", {}))
    if "weights" in fusion:
        fusion["weights"] = tuple(fusion["weights"])
    rest = {k: tuple(v) if k == "output" else v for k, v in values.items() if k not in ("routes", "fusion")}
    return Search(routes, Fusion(**fusion), **rest)
