"""Typed settings (M13): ``key: value`` lines; values may hold colons, blank lines are skipped."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


def parse_lines(lines: list[str]) -> dict[str, str]:
    """The later of two equal keys wins."""
    out = {}
    for line in lines:
        k, sep, v = line.partition(":")
        if sep and k.strip():
            out[k.strip()] = v.strip()
    return out


def as_bool(v: str) -> bool:
    return v.strip().lower() in ("true", "1", "yes")


def as_list(v: str) -> list[str]:
    return [x.strip() for x in v.split(",") if x.strip()]


@dataclass
class Config:
    """Every setting with its default; ``paths`` keeps the rest as text."""

    overwrite: bool = False
    markdown: bool = False
    std_txt_window_size: int = 5
    std_txt_rep_thresh: int = 5
    ignore_std_txt_str: str = ""
    hollow_quantile: float = 0.15
    hollow_quantile_threshold: int = 5
    lsh_thresh: float = 0.5
    lsh_num_perm: int = 200
    min_length: int = 100
    year_min: int = 1900
    year_max: int = 2024
    languages: str = "english"
    title_match_threshold: int = 80
    author_match_threshold: int = 60
    quick_data_merge_threshold: float = 0.95
    split_threshold: float = 0.90
    length_threshold: int = 20
    ngram_range: str = "1,4"
    max_doc_freq: float = 0.5
    max_svd_components: int = 250
    custom_stopwords: str = ""
    kmeans_init: str = "k-means++"
    kmeans_sim: str = "bic"
    k_n_init: int = 35
    group_iterations: int = 10
    num_groupings_small: int = 100
    num_groupings_large: int = 35
    reset_for_pipeline: bool = False
    use_search_query: bool = False
    agglomerative_distance: float = 0.55
    explained_variance: float = 0.001
    ensemble_keep: float = 0.65
    ensemble_noise: float = 0.01
    eps_factor: float = 0.7
    grid_step: float = 0.025
    elbow_cuts: int = 10
    merge_percentile: float = 90.0
    seed: int = 42
    folds: int = 5
    paths: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict[str, str]) -> Config:
        """Unknown keys become paths; a value of the wrong type is an error that names its key."""
        out, kinds = cls(), {f.name: type(f.default) for f in fields(cls) if f.name != "paths"}
        for k, v in values.items():
            if k not in kinds:
                out.paths[k] = v
                continue
            try:
                setattr(out, k, as_bool(v) if kinds[k] is bool else kinds[k](v))
            except ValueError as e:
                raise ValueError(f"{k}: {v!r} is no {kinds[k].__name__}") from e
        return out

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.of(parse_lines(f.read().splitlines()))

    @property
    def ngrams(self) -> tuple[int, int]:
        low, high = as_list(self.ngram_range)
        return int(low), int(high)
