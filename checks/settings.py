"""Masking settings that the registered queries use."""

from veilframe.spec import MaskingConfig

NOISE = MaskingConfig("noise", noise_std=3.0, gender_mask_probability=0.15)
GENERAL = MaskingConfig("generalization", generalization_bin=20)
LAPLACE = MaskingConfig("differential_privacy", epsilon=1.0)
SWAP = MaskingConfig("data_swapping", swap_fraction=0.2)
PERTURB = MaskingConfig("feature_perturbation", perturbation_strength=0.2)
HYBRID = MaskingConfig(
    "hybrid", noise_std=1.5, generalization_bin=10, epsilon=2.0, gender_mask_probability=0.075,
    swap_fraction=0.10, perturbation_strength=0.10,
)
SIX = [NOISE, GENERAL, LAPLACE, SWAP, PERTURB, HYBRID]
ORDERS_NOISE = MaskingConfig("noise", noise_std=25.0, gender_mask_probability=0.10)
ORDERS_GENERAL = MaskingConfig("generalization", generalization_bin=50)
ORDERS_SWAP = MaskingConfig("data_swapping", swap_fraction=0.2)
ORDERS_PERTURB = MaskingConfig("feature_perturbation", perturbation_strength=0.01)
SWAP_BUCKETS = 16
CAP = 5000
SHARE = 0.25
KEPT = 8
WEIGHT = 0.55
PROPOSALS = 12
