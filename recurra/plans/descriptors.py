"""Descriptor registry: one entry per feature family of an image."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import gabor, rqa, tamura, texture, wavelet
from ..operators.framework import config_hash


@dataclass(frozen=True)
class Descriptor:
    """``build(tiles, **config)`` returns image_id plus ``names(config)``; ``halo`` is the tile margin, by configuration."""

    name: str
    build: Callable[..., DataFrame]
    halo: int | Callable[[dict], int]
    names: Callable[[dict], list[str]]
    config: dict = field(default_factory=dict)
    summary: str = ""

    def hash(self, config: dict | None = None) -> str:
        return config_hash({**self.config, **(config or {})})

    def margin(self, config: dict | None = None) -> int:
        return self.halo({**self.config, **(config or {})}) if callable(self.halo) else self.halo

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "config": self.config, "features": self.names(self.config)})


REGISTRY: dict[str, Descriptor] = {}


def register(descriptor: Descriptor) -> Descriptor:
    REGISTRY[descriptor.name] = descriptor
    return descriptor


def get_descriptor(name: str) -> Descriptor:
    if name not in REGISTRY:
        raise ValueError(f"unknown descriptor {name}; one of {', '.join(list_descriptors())}")
    return REGISTRY[name]


def list_descriptors() -> list[str]:
    return sorted(REGISTRY)


def descriptor_info(name: str) -> dict:
    d = get_descriptor(name)
    names = d.names(d.config)
    return {"name": name, "summary": d.summary, "config": d.config, "features": names, "count": len(names), "hash": d.hash()}


def _lbp_names(config):
    tag = f"_r{config['radius']}_p{config['points']}"
    bins = [f"lbp_hist_bin_{k}{tag}" for k in range(config["points"] + 2)]
    rest = ("mean", "std", "max", "min", "uniformity", "entropy", "uniform_ratio", "nonuniform_ratio")
    return bins + [f"lbp_{r}{tag}" for r in rest]


def _lbp_product_names(config):
    return [n for r in config["radii"] for p in config["points"] for n in _lbp_names({"radius": r, "points": p})]


def _wavelet_names(config):
    bands = wavelet.subbands(config["levels"])
    kinds = ("energy", "entropy", "mean", "std", "max", "n_coeffs")
    ratios = ("approx_total", "detail_total", "horizontal", "vertical", "diagonal")
    return [f"wavelet_{k}_{b}" for b in bands for k in kinds] + [f"wavelet_ratio_{r}" for r in ratios]


def _stat_names(config):
    names = [*config["moments"], *[f"p{p}" for p in config["percentiles"]], "range", "min", "max", "cv", "iqr"]
    names += [f"hist_bin_{k}" for k in range(config["bins"])]
    names += ["hist_mean", "hist_std", "hist_max", "hist_effective_bins"]
    names += ["entropy", "entropy_norm", "centroid_x", "centroid_y"]
    return [f"stat_{n}" for n in names]


def _gabor_names(config):
    return [
        f"gabor_{k}_f{f}_o{o}"
        for f in config["frequencies"] for o in config["orientations"] for k in gabor.GABOR_KINDS
    ]


register(Descriptor("glcm", texture.glcm_features, lambda c: max(c["distances"]), lambda c: [f"glcm_{p}" for p in texture.GLCM_PROPS],
                    {"levels": 256, "distances": [1], "angles": list(texture.ANGLES)}, "gray-level co-occurrence, all distances and angles averaged"))
register(Descriptor("lbp", texture.lbp_features, lambda c: c["radius"], _lbp_names, {"radius": 1, "points": 4},
                    "uniform local binary patterns"))
register(Descriptor("lbp_product", texture.lbp_product, lambda c: max(c["radii"]), _lbp_product_names,
                    {"radii": [1, 2, 3], "points": [8, 16, 24]}, "uniform local binary patterns of every radius with every number of points"))
register(Descriptor("wavelet", wavelet.wavelet_features, wavelet.halo_for("db4", 3), _wavelet_names,
                    {"wavelet": "db4", "levels": 3}, "subband statistics of a 2-D wavelet decomposition"))
register(Descriptor("rqa", rqa.rqa_features, 0, lambda c: [f"rqa_{n}" for n in rqa.RQA_NAMES],
                    {"percent": 10.0, "l_min": 2}, "recurrence quantification measures"))
register(Descriptor("statistical", texture.stat_features, 0, _stat_names,
                    {"bins": 64, "moments": list(texture.MOMENTS), "percentiles": list(texture.STAT_PERCENTILES)},
                    "moments, percentiles, histogram and centroid of the gray levels"))
register(Descriptor("gabor", gabor.gabor_features, gabor.halo_for(), _gabor_names,
                    {"frequencies": list(gabor.FREQUENCIES), "orientations": list(gabor.ORIENTATIONS), "sigma": 1.0},
                    "Gabor filter bank responses"))
register(Descriptor("tamura", tamura.tamura_features, tamura.HALO,
                    lambda c: [f"tamura_{n}_{s}" for n in tamura.NAMES for s in ("mean", "std")],
                    {"k_max": 6}, "Tamura texture measures"))

PUBLISHED = ("glcm", "lbp", "wavelet", "rqa", "statistical")


def halo_needed(names, configs: dict | None = None) -> int:
    return max(get_descriptor(n).margin((configs or {}).get(n)) for n in names)


def extract(tiles: DataFrame, names=PUBLISHED, configs: dict | None = None) -> DataFrame:
    """Features of several descriptors in one table. Stage ``tiles`` first: each family reads them.

    The tiles need ``halo_needed(names, configs)`` pixels of halo.
    """
    from ..operators.framework import combine

    configs = configs or {}
    tables = [
        get_descriptor(n).build(tiles, **{**get_descriptor(n).config, **configs.get(n, {})}) for n in names
    ]
    return combine(tables, key="image_id")
