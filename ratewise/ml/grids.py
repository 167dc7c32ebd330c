"""Hyper-parameter grids of the tuning runs.

Fixed values: the parameter lists of the six tuning grids (random forest,
gradient boosting and neural network; severity and frequency), in the
order they are listed for the original tuning runs.
"""

from __future__ import annotations

REFERENCE_GRIDS: dict[str, dict[str, list]] = {
    "rf_severity": {
        "ntrees": [100, 200],
        "max_depth": [3, 5, 7, 10, 15, 20, 30],
        "min_split_improvement": [0.01, 0.001, 0.0001],
        "mtries": [-1, 7, 20],
        "histogram_type": ["UniformAdaptive", "RoundRobin"],
        "sample_rate": [0.632],
        "categorical_encoding": ["EnumLimited"],
        "col_sample_rate_per_tree": [0.8],
        "seed": [16],
    },
    "gb_severity": {
        "ntrees": [300, 500, 1000],
        "max_depth": [1, 2, 3, 5, 7, 10],
        "learn_rate": [0.001, 0.0001],
        "min_split_improvement": [0.0001],
        "distribution": ["gaussian", "gamma"],
        "sample_rate": [0.632],
        "nbins": [56],
        "categorical_encoding": ["Eigen"],
        "col_sample_rate_per_tree": [0.8],
        "seed": [16],
    },
    "nn_severity": {
        "activation": ["Tanh"],
        "hidden": [[100], [100, 100], [200, 200], [100, 100, 100]],
        "adaptive_rate": [False],
        "rate": [0.01, 0.001, 0.0001, 0.00001],
        "rate_decay": [0.5],
        "momentum_start": [0.5],
        "momentum_stable": [0.99],
        "input_dropout_ratio": [0.1],
        "initial_weight_distribution": ["Normal"],
        "initial_weight_scale": [1],
        "loss": ["Automatic"],
        "distribution": ["gaussian", "laplace"],
        "stopping_metric": ["MAE"],
        "stopping_tolerance": [0.001],
        "categorical_encoding": ["EnumLimited"],
        "seed": [16],
        "mini_batch_size": [50],
    },
    "rf_frequency": {
        "ntrees": [100],
        "max_depth": [20, 15, 10, 7, 5],
        "min_split_improvement": [0.001, 0.01],
        "mtries": [20, 7],
        "histogram_type": ["RoundRobin"],
        "sample_rate": [0.632],
        "categorical_encoding": ["EnumLimited"],
        "col_sample_rate_per_tree": [0.8],
        "seed": [16],
    },
    "gb_frequency": {
        "ntrees": [300, 500, 1000],
        "max_depth": [1, 2, 3, 5, 7, 10],
        "learn_rate": [0.001, 0.0001],
        "min_split_improvement": [0.0001],
        "distribution": ["multinomial"],
        "sample_rate": [0.632],
        "nbins": [56],
        "categorical_encoding": ["Eigen"],
        "col_sample_rate_per_tree": [0.8],
        "seed": [16],
    },
    "nn_frequency": {
        "activation": ["Tanh"],
        "hidden": [[100], [100, 100], [200, 200], [100, 100, 100]],
        "adaptive_rate": [False],
        "rate": [0.1, 0.01, 0.005, 0.001, 0.0005],
        "rate_decay": [0.5],
        "momentum_start": [0.5],
        "momentum_stable": [0.99],
        "input_dropout_ratio": [0.1],
        "initial_weight_distribution": ["Normal"],
        "initial_weight_scale": [1],
        "loss": ["Automatic"],
        "distribution": ["multinomial"],
        "stopping_metric": ["logloss"],
        "stopping_tolerance": [0.001],
        "categorical_encoding": ["EnumLimited"],
        "seed": [16],
        "mini_batch_size": [100],
    },
}
