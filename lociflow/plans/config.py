"""TOML settings of the pipelines."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from lociflow.plans.contracts import Export, Preprocessing

#: How variant-effect scores enter the network.
VES_MODES = ("none", "weighted", "selection", "learnable")


@dataclass(frozen=True)
class Species:
    """One producer: a name, its individual, and its FASTA file."""

    name: str
    individual_id: str
    fasta: str

    @property
    def sample_id(self) -> str:
        return "-".join(self.name.lower().split())


@dataclass(frozen=True)
class CorpusPlan:
    """A whole corpus run."""

    species: tuple[Species, ...]
    output: str
    preprocessing: Preprocessing
    export: Export

    def __post_init__(self) -> None:
        if not self.species:
            raise ValueError("a corpus needs a species")
        if len({s.name for s in self.species}) != len(self.species):
            raise ValueError("species names must differ")


def resolved(path: str, base: str | Path) -> str:
    """An absolute path, or one with a scheme, as it is; others stand relative to the folder of the settings."""
    return path if "://" in path else str((Path(base) / path).resolve())


def peak_bytes(raw: int, platform: str) -> int:
    """Peak resident memory in bytes: Linux tells it in kilobytes, macOS in bytes."""
    if platform.startswith("linux"):
        return raw * 1024
    if platform == "darwin":
        return raw
    raise ValueError(f"unknown unit of memory on {platform}")


def _only(kind: type, table: dict, where: str):
    known = {f.name for f in fields(kind)}
    extra = sorted(set(table) - known)
    if extra:
        raise ValueError(f"unknown settings in [{where}]: {extra}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in table.items()})


def corpus_plan(path: str | Path) -> CorpusPlan:
    """Read and check a corpus plan; paths stand relative to the file."""
    path = Path(path)
    with path.open("rb") as f:
        raw = tomllib.load(f)
    at = lambda p: resolved(p, path.parent)
    prep = dict(raw.get("preprocessing", {}))
    if "overlap" in prep:
        prep["window_stride"] = prep.get("window_size", 512) - prep.pop("overlap")
    species = tuple(Species(s["name"], s.get("individual_id", s["name"]), at(s["fasta"])) for s in raw.get("species", []))
    return CorpusPlan(tuple(sorted(species, key=lambda s: s.name)), at(raw["output"]), _only(Preprocessing, prep, "preprocessing"), _only(Export, raw.get("export", {}), "export"))


@dataclass(frozen=True)
class GenotypePlan:
    """A genotype evaluation."""

    vcf: str
    metadata: str
    output: str
    trials: int = 0
    seed: int = 0
    ves_mode: str = "none"
    #: Parquet table of locus_key and score.
    scores: str | None = None
    #: FASTA file on which a scorer scores the loci, where no table is given.
    reference: str | None = None
    #: Loci that selection keeps in a run without trials; trials draw their own.
    top_k: int | None = None

    def __post_init__(self) -> None:
        if isinstance(self.trials, bool) or self.trials < 0:
            raise ValueError("trials must not be negative")
        if self.top_k is not None and (isinstance(self.top_k, bool) or self.top_k < 1):
            raise ValueError("top_k must be positive")
        if self.ves_mode not in VES_MODES:
            raise ValueError(f"ves_mode must be one of {VES_MODES}")


def genotype_plan(path: str | Path) -> GenotypePlan:
    path = Path(path)
    with path.open("rb") as f:
        raw = tomllib.load(f)
    plan = _only(GenotypePlan, raw.get("genotype", raw), "genotype")
    at = lambda p: resolved(p, path.parent)
    return GenotypePlan(at(plan.vcf), at(plan.metadata), at(plan.output), plan.trials, plan.seed, plan.ves_mode, at(plan.scores) if plan.scores else None, at(plan.reference) if plan.reference else None, plan.top_k)


#: What may stand in for a missing padding token.
PAD_FALLBACKS = ("eos", "unk", "add_pad")


@dataclass(frozen=True)
class TrainingPlan:
    """Settings of continued pre-training on a corpus: checked here, and run elsewhere."""

    corpus: str
    model_identifier: str
    model_revision: str
    max_steps: int
    output: str = "models"
    max_seq_length: int = 512
    mlm_probability: float = 0.15
    per_device_train_batch_size: int = 8
    per_device_eval_batch_size: int = 8
    gradient_accumulation_steps: int = 1
    learning_rate: float = 1e-4
    weight_decay: float = 0.01
    warmup_steps: int = 1000
    eval_every: int = 500
    eval_max_steps: int | None = None
    patience: int | None = None
    save_every: int = 1000
    log_every: int = 10
    gradient_clip: float = 1.0
    seed: int = 42
    pad_token_fallback: str = "eos"

    def __post_init__(self) -> None:
        for name in ("max_steps", "max_seq_length", "per_device_train_batch_size", "per_device_eval_batch_size", "gradient_accumulation_steps", "learning_rate", "eval_every", "save_every", "log_every"):
            if isinstance(getattr(self, name), bool) or getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("eval_max_steps", "patience"):
            if getattr(self, name) is not None and getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive, or left out")
        for name in ("weight_decay", "warmup_steps", "gradient_clip"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if not 0 < self.mlm_probability < 1:
            raise ValueError("mlm_probability must lie between 0 and 1")
        if self.pad_token_fallback not in PAD_FALLBACKS:
            raise ValueError(f"pad_token_fallback must be one of {PAD_FALLBACKS}")


def training_plan(path: str | Path, pinned: tuple[str, str] | None = None) -> TrainingPlan:
    """Read and check a training plan; pinned: the model and revision that it must name."""
    path = Path(path)
    with path.open("rb") as f:
        raw = tomllib.load(f).get("training", {})
    if missing := [k for k in ("corpus", "model_identifier", "model_revision", "max_steps") if k not in raw]:
        raise ValueError(f"missing settings in [training]: {missing}")
    plan = _only(TrainingPlan, raw | {"corpus": resolved(raw["corpus"], path.parent)}, "training")
    if pinned and (plan.model_identifier, plan.model_revision) != pinned:
        raise ValueError(f"the model is pinned to {pinned}")
    return plan
