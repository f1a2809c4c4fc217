"""Parameters of fingerprints, matching and retention, with their checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Params:
    simhash_bits: int = 128
    simhash_bands: int = 8
    ngram: int = 5
    minhash_perms: int = 128
    minhash_bands: int = 32
    max_hamming: int = 25
    max_bucket_size: int = 1000
    max_bucket_cap: int = 2000
    max_checks: int = 200
    jaccard_threshold: float = 0.4
    max_candidates: int = 20
    result_limit: int = 20
    sample_text_length: int = 160
    retention_days: int = 10
    grace_days: int = 2
    timezone: str = "Asia/Shanghai"

    def __post_init__(self):
        if (self.simhash_bits, self.simhash_bands, self.minhash_bands) != (128, 8, 32):
            raise ValueError("128 SimHash bits, 8 SimHash bands and 32 MinHash bands are fixed")
        if not 32 <= self.minhash_perms <= 128:
            raise ValueError("minhash_perms must be 32 to 128")
        if self.max_hamming < 0 or min(self.ngram, self.max_bucket_size, self.max_bucket_cap, self.max_checks, self.max_candidates, self.result_limit) < 1:
            raise ValueError("a limit is out of range")
        if not 0 <= self.jaccard_threshold <= 1:
            raise ValueError("jaccard_threshold must be 0 to 1")

    def meta(self) -> dict:
        """What a stored index depends on."""
        return {k: v for k, v in asdict(self).items() if k in ("simhash_bits", "simhash_bands", "ngram", "minhash_perms", "minhash_bands")}


DEFAULTS = Params()
EXACT_FPP, EXACT_CAPACITY = 1e-4, 10_000_000
MINHASH_FPP, MINHASH_DAILY_CAPACITY = 1e-5, 1_300_000
