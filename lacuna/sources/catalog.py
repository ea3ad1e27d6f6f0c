"""The catalogue of presets and data sets: built in, or read from YAML with the same four sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SECTIONS = ("datasets", "noisy_benchmarks", "synthetic_noisy_benchmarks", "hankel_benchmarks")

# Presets of the published results.
_SWEEP = {"n_rows": 400, "n_cols": 300, "rank": 10, "observed_fraction": 0.35, "eval_fraction": 0.2, "factor_scale": 1.0}
SYNTHETIC = {
    "sim_lr_gaussian_sigma_0p01": {"dgp_type": "low_rank_gaussian", "noise_type": "gaussian", "params": {**_SWEEP, "sigma": 0.01}},
    "sim_lr_gaussian_sigma_0p03": {"dgp_type": "low_rank_gaussian", "noise_type": "gaussian", "params": {**_SWEEP, "sigma": 0.03}},
    "sim_lr_gaussian_sigma_0p1": {"dgp_type": "low_rank_gaussian", "noise_type": "gaussian", "params": {**_SWEEP, "sigma": 0.1}},
    "sim_lr_gaussian_sigma_0p3": {"dgp_type": "low_rank_gaussian", "noise_type": "gaussian", "params": {**_SWEEP, "sigma": 0.3}},
    "sim_lr_gaussian_sigma_1p0": {"dgp_type": "low_rank_gaussian", "noise_type": "gaussian", "params": {**_SWEEP, "sigma": 1.0}},
    "sim_lr_gaussian_sigma_3p0": {"dgp_type": "low_rank_gaussian", "noise_type": "gaussian", "params": {**_SWEEP, "sigma": 3.0}},
    "sim_orthogonal_student_t": {"dgp_type": "low_rank_orthogonal", "noise_type": "student_t", "params": {"n_rows": 500, "n_cols": 350, "rank": 12, "observed_fraction": 0.3, "eval_fraction": 0.2, "singular_decay": 0.82, "df": 3.0, "scale": 0.2}},
    "sim_block_sparse_corrupt": {"dgp_type": "block_low_rank", "noise_type": "sparse_corruption", "params": {"n_rows": 360, "n_cols": 280, "rank": 8, "observed_fraction": 0.32, "eval_fraction": 0.25, "n_row_groups": 6, "n_col_groups": 5, "group_noise": 0.08, "corruption_fraction": 0.06, "corruption_scale": 2.5}},
}
HANKEL = {
    "hankel_gaussian_sigma_0p01": {"signal_model": "spectrally_sparse_complex", "mask_type": "uniform_random", "params": {"n": 256, "rank": 8, "window_length": 128, "noise_sigma": 0.01, "missing_fraction": 0.5}},
    "hankel_gaussian_sigma_0p05": {"signal_model": "spectrally_sparse_complex", "mask_type": "uniform_random", "params": {"n": 256, "rank": 8, "window_length": 128, "noise_sigma": 0.05, "missing_fraction": 0.5}},
    "hankel_gaussian_sigma_0p10": {"signal_model": "spectrally_sparse_complex", "mask_type": "uniform_random", "params": {"n": 256, "rank": 8, "window_length": 128, "noise_sigma": 0.10, "missing_fraction": 0.5}},
    "hankel_damped_block_missing": {"signal_model": "damped_spectrally_sparse", "mask_type": "contiguous_block", "params": {"n": 320, "rank": 10, "window_length": 160, "noise_sigma": 0.04, "missing_fraction": 0.4}},
}
# Data sets by name, with their kinds.
DATASETS = {
    name: {"kind": kind, "description": description}
    for kind, names in {
        "recommender": {
            "movielens_100k": "film ratings, tab separated", "movielens_1m": "film ratings, double colons", "movielens_latest_small": "film ratings, CSV", "movielens_20m": "film ratings, CSV",
            "movietweetings": "film ratings from tweets", "yelp_open_dataset": "reviews of businesses", "bookcrossing": "book ratings", "netflix_prize": "film ratings of the prize",
            "tripadvisor_hotelrec": "hotel reviews", "amazon_electronics_5core": "product reviews, electronics", "amazon_books_5core": "product reviews, books",
        },
        "causal_panel": {"prop99_smoking": "cigarette sales by state and year", "basque_gdpcap": "product per head by region and year"},
        "compressed_sensing": {"fastmri": "magnetic resonance scans", "acdc_cardiac_cine": "heart films"},
        "tabular": {"uci_repository": "mixed tables", "proteomics_benchmark_collection": "protein abundances", "ckd_ehr_abu_dhabi": "patients' records"},
    }.items()
    for name, description in names.items()
}
DEFAULT = {"datasets": DATASETS, "noisy_benchmarks": {}, "synthetic_noisy_benchmarks": SYNTHETIC, "hankel_benchmarks": HANKEL}


def load_catalog(path: str | None = None) -> dict[str, dict[str, dict]]:
    """The four sections by name; each must be a mapping of mappings."""
    if path is None:
        return {k: dict(v) for k, v in DEFAULT.items()}
    import yaml

    with open(path) as file:
        read = yaml.safe_load(file)
    if not isinstance(read, dict):
        raise ValueError("a catalogue is a mapping")
    out = {}
    for section in SECTIONS:
        entries = read.get(section) or {}
        if not isinstance(entries, dict) or not all(isinstance(e, dict) for e in entries.values()):
            raise ValueError(f"{section} must map names to mappings")
        out[section] = {name: {**entry, "params": dict(entry.get("params") or {})} for name, entry in entries.items()}
    return out


def listing(spark: SparkSession, catalog: dict[str, dict[str, dict]]) -> DataFrame:
    """(section, name, description), sorted."""
    rows = [(s, n, str(e.get("description", ""))) for s in SECTIONS for n, e in sorted(catalog[s].items())]
    return spark.createDataFrame(rows, "section string, name string, description string")
