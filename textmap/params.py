"""Parameters of each analysis step. Frozen: fitting never changes them."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TextParams:
    """Document frequencies: a float is a share of the corpus, an int a number of documents."""

    min_df: float | int = 0.01
    max_df: float | int = 0.6
    ngram_range: tuple[int, int] = (1, 1)
    accents: str | None = "ascii"
    norm: str | None = "l2"


@dataclass(frozen=True)
class LsaParams:
    n_components: int = 300
    tolerance: float = 1e-4
    max_steps: int = 60
    oversample: int = 20
    seed: int = 0


@dataclass(frozen=True)
class NmfParams:
    n_components: int = 200
    max_steps: int = 30
    inner_steps: int = 40
    tolerance: float = 1e-4
    seed: int = 0


@dataclass(frozen=True)
class LdaParams:
    n_topics: int = 200
    n_iter: int = 1
    seed: int = 0
    share_prior: float = 0.1
    term_prior: float = 0.01


@dataclass(frozen=True)
class SomParams:
    """``update``: "mean" is the batch map, "sum" adds raw deltas with the learning rate.

    ``decay``: "default", "sigma" or "sparse". ``topology``: "rect", "hex" or "torus".
    ``init``: "random" (seeded, uniform) or "first" (rows with the smallest ids).
    """

    kshape: tuple[int, int] = (9, 16)
    n_iter: int = 250
    learning_rate: float = 0.005
    decay: str = "default"
    topology: str = "rect"
    update: str = "mean"
    init: str = "random"
    seed: int = 0
    min_influence: float = 1e-6
    clip_below: float | None = None
    tolerance: float | None = None

    @property
    def n_nodes(self) -> int:
        return self.kshape[0] * self.kshape[1]


@dataclass(frozen=True)
class WardParams:
    n_clusters: int = 6


@dataclass(frozen=True)
class AnalysisParams:
    text: TextParams = field(default_factory=TextParams)
    lsa: LsaParams = field(default_factory=LsaParams)
    nmf: NmfParams = field(default_factory=NmfParams)
    lda: LdaParams = field(default_factory=LdaParams)
    som: SomParams = field(default_factory=SomParams)
    ward: WardParams = field(default_factory=WardParams)
    reducer: str = "lsa"
