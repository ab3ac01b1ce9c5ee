"""Parameters of an operator or a training run as a dict or as text."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field, is_dataclass
from enum import Enum
from pathlib import Path


@dataclass
class ModelConfig:
    """Few-shot episodes, and the optimiser and schedule of a training run, by name."""

    model_name: str = "prototypical"
    n_support: int = 10
    n_query: int = 10
    iterations: int = 100
    n_classes: int = 5
    embedding_size: int = 128
    optimizer: str = "AdamW"
    learning_rate: float = 1e-5
    weight_decay: float = 0.01
    optimizer_options: dict[str, object] = field(default_factory=dict)
    schedule: str = "StepLR"
    schedule_options: dict[str, object] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> ModelConfig:
        """From JSON with optimizer_type, optimizer_kwargs (lr, weight_decay and more), lr_scheduler_type and lr_scheduler_kwargs; unknown keys are an error."""
        raw = json.loads(text)
        options = dict(raw.pop("optimizer_kwargs", {}))
        own = {"optimizer": raw.pop("optimizer_type", cls.optimizer), "schedule": raw.pop("lr_scheduler_type", "none"), "schedule_options": raw.pop("lr_scheduler_kwargs", {})}
        own |= {"learning_rate": options.pop("lr", cls.learning_rate), "weight_decay": options.pop("weight_decay", 0.0), "optimizer_options": options}
        return cls(**raw, **own)


def parameters(thing: object) -> dict[str, object]:
    """Public attributes; members of an Enum by their value."""
    raw = asdict(thing) if is_dataclass(thing) and not isinstance(thing, type) else vars(thing)
    return {k: v.value if isinstance(v, Enum) else v for k, v in raw.items() if not k.startswith("_")}


def as_text(thing: object) -> str:
    return "__".join(f"{k}={v}" for k, v in parameters(thing).items())


def as_json(thing: object) -> str:
    return json.dumps(parameters(thing), ensure_ascii=False, indent=4, default=str)


def names(kind: type[Enum]) -> str:
    return " / ".join(m.name for m in kind)


def logger(name: str, path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A logger to the console and, with a path, to a file."""
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        shape = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        for handler in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
            handler.setFormatter(shape)
            log.addHandler(handler)
    return log


def clear_logs(folder: str) -> list[str]:
    """Delete the .log files of a folder, those below it not; their names. FileNotFoundError if there is no such folder."""
    found = sorted(p for p in Path(folder).iterdir() if p.suffix == ".log" and p.is_file())
    for p in found:
        p.unlink()
    return [p.name for p in found]
