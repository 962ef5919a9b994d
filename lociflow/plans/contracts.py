"""Settings of the pipelines, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass

from lociflow.functions.sequence import ALPHABET
from lociflow.functions.splits import SPLIT_SEED, SPLIT_WEIGHTS


def _whole(name: str, value: object, least: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")


def _flag(name: str, value: object) -> None:
    if not isinstance(value, bool):
        raise ValueError(f"{name} must be true or false")


@dataclass(frozen=True)
class Preprocessing:
    """Thresholds, window geometry and splits of the corpus."""

    min_sequence_length: int = 512
    max_ambiguity_fraction: float = 0.05
    window_size: int = 512
    window_stride: int = 384
    locus_block_size: int = 50_000
    ambiguity_mode: str = "mask"
    alphabet: tuple[str, ...] = ALPHABET
    split_weights: tuple[tuple[str, float], ...] = SPLIT_WEIGHTS
    split_seed: str = SPLIT_SEED

    def __post_init__(self) -> None:
        for name in ("min_sequence_length", "window_size", "window_stride", "locus_block_size"):
            _whole(name, getattr(self, name), 1)
        if not 0.0 <= self.max_ambiguity_fraction <= 1.0:
            raise ValueError("max_ambiguity_fraction must lie between 0 and 1")
        if self.locus_block_size < self.window_size:
            raise ValueError("a locus block must hold a window")
        if self.ambiguity_mode not in ("mask", "reject"):
            raise ValueError(f"no such ambiguity_mode: {self.ambiguity_mode}; it masks or rejects")
        if set(self.alphabet) != set(ALPHABET):
            raise ValueError(f"the alphabet is {''.join(ALPHABET)}")
        if not self.split_weights or any(w <= 0 for _, w in self.split_weights):
            raise ValueError("split weights must be positive")
        if len({n for n, _ in self.split_weights}) != len(self.split_weights):
            raise ValueError("split names must differ")


@dataclass(frozen=True)
class Tokenizer:
    """Where token ids come from; kept with each row."""

    identifier: str = "stride-6"
    revision: str = "1"
    max_tokens: int = 512
    alphabet: tuple[str, ...] = ALPHABET
    trust_remote_code: bool = False

    def __post_init__(self) -> None:
        _whole("max_tokens", self.max_tokens, 1)
        _flag("trust_remote_code", self.trust_remote_code)
        if not self.identifier or not self.revision:
            raise ValueError("a tokenizer needs an identifier and a pinned revision")


@dataclass(frozen=True)
class Export:
    """What the corpus keeps, and its layout."""

    format: str = "parquet"
    row_group_size: int = 50_000
    partition_keys: tuple[str, ...] = ("split", "contig")
    keep_coordinates: bool = True
    keep_sequence: bool = False
    keep_hash: bool = True

    def __post_init__(self) -> None:
        if self.format not in ("parquet", "webdataset"):
            raise ValueError("format must be 'parquet' or 'webdataset'")
        _whole("row_group_size", self.row_group_size, 1)
        for name in ("keep_coordinates", "keep_sequence", "keep_hash"):
            _flag(name, getattr(self, name))
        if not self.keep_sequence and not self.keep_hash:
            raise ValueError("an export keeps the windows or their hashes")
        if not set(self.partition_keys) <= {"split", "contig", "block_id"}:
            raise ValueError("partition keys are of split, contig and block_id")
