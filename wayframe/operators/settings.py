"""Settings files of the three kinds of runs: every section stated as rules, checked once, and met with the readers of splits.

`context` runs retrieve contexts, `joint` runs train and ask a model for intention and trajectory together, `direct` runs ask a service. A rule
says a value's kind, its default and its bounds; keys without a rule stay as they are.
"""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

NEEDED = object()
#: The six neighbours of a sample, in the order of their places.
ROLES = ["phys_tl", "phys_tf", "phys_tff", "phys_ol", "phys_of", "phys_off"]


@dataclass(frozen=True)
class Rule:
    """A value's kind (int, float, str, bool, list or dict), its default, and what it must be besides; a nullable one may be null."""

    kind: type
    default: object = NEEDED
    least: float | None = None
    above: float | None = None
    most: float | None = None
    among: tuple = ()
    nullable: bool = False

    def read(self, name: str, value: object) -> object:
        if self.nullable and value in (None, ""):
            return None
        if self.kind in (int, float):
            whole = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
            if not whole or (self.kind is int and value != int(value)):
                raise ValueError(f"{name} must be {'a whole' if self.kind is int else 'a finite'} number")
            value = self.kind(value)
        elif not isinstance(value, self.kind):
            raise ValueError(f"{name} must be of kind {self.kind.__name__}")
        if self.kind is str and not (value := value.strip()):
            raise ValueError(f"{name} is blank")
        if self.least is not None and value < self.least or self.above is not None and value <= self.above or self.most is not None and value > self.most:
            raise ValueError(f"{name} is out of range: {value}")
        if self.among and value not in self.among:
            raise ValueError(f"{name} must be one of {', '.join(map(str, self.among))}")
        return value


def count(default: object = NEEDED, most: float | None = None) -> Rule:
    return Rule(int, default, least=1, most=most)


def from_zero(kind: type, default: object = NEEDED, most: float | None = None) -> Rule:
    return Rule(kind, default, least=0, most=most)


def positive(default: object = NEEDED) -> Rule:
    return Rule(float, default, above=0)


SAMPLES = {"history_steps": count(10), "future_steps": count(50), "sample_rate_hz": positive(10.0), "neighbor_roles": Rule(list, ROLES)}
PAIR = {"train_mat": Rule(str), "test_mat": Rule(str), "train_key": Rule(str), "test_key": Rule(str)}
MODES = {"prediction_mode": Rule(str, "top1", among=("top1",)), "horizons_seconds": Rule(list, [1, 2, 3, 4, 5])}
SERVICE = {"model": Rule(str, "qwen-plus"), "api_key_env": Rule(str, "LLM_API_KEY"), "base_url_env": Rule(str, "LLM_BASE_URL", nullable=True), "temperature": from_zero(float, 0.3), "max_tokens": count(4096)}
WAITS = {"timeout_seconds": positive(120.0), "max_api_retries": from_zero(int, 4), "max_format_retries": from_zero(int, 2), "initial_backoff_seconds": from_zero(float, 1.0), "max_backoff_seconds": from_zero(float, 30.0)}

#: Rules by kind of run, section and key. The sections without a default for what they need must be there.
RULES: dict[str, dict[str, dict[str, Rule]]] = {
    "context": {
        "data": PAIR | SAMPLES | {"history_steps": count(), "future_steps": count(), "sample_rate_hz": positive()},
        "paths": {},
        "llm": SERVICE | {"model": Rule(str), "temperature": from_zero(float, 0.7), "max_tokens": count(1200), "seed": Rule(int, 42)},
        "context": {"dimension": Rule(int, among=(17,)), "k": count(), "metric": Rule(str, "euclidean", among=("euclidean", "cosine")), "exclude_same_event": Rule(bool, True)},
        "intention_points": {"n_clusters": count(), "random_state": Rule(int, 42), "max_iter": count(100)},
        "model": {},
        "train": {"batch_size": count(64), "epochs": count(100), "learning_rate": positive(1e-4), "seed": Rule(int, 42)},
        "evaluation": MODES | {"prediction_mode": Rule(str, among=("top1",))},
    },
    "joint": {
        "data": PAIR | SAMPLES | {"future_steps": Rule(int, 50, among=(50,)), "sample_rate_hz": Rule(float, 10.0, among=(10.0,)), "intention_label_mode": Rule(str, "phase_left_event", among=("phase_left_event", "future_lateral_displacement")), "intention_lateral_threshold_m": positive(1.5)},
        "paths": {},
        "road": {"num_lanes": Rule(int, None, least=1, nullable=True), "lane_id_to_position": Rule(dict, {}), "neighbor_range_m": positive(200.0), "target_vehicle_type": Rule(str, "Vehicle")},
        "prompt": {"trajectory_precision": from_zero(int, 2, most=8), "history_stride": count(1)},
        "lora": {"r": count(64), "alpha": count(16), "dropout": from_zero(float, 0.05, most=1)},
        "training": {"epochs": positive(2.0), "batch_size": count(8), "gradient_accumulation_steps": count(8), "learning_rate": positive(5e-4), "weight_decay": from_zero(float, 0.0), "warmup_steps": from_zero(int, 600), "seed": Rule(int, 42)},
        "generation": {"batch_size": count(1), "max_input_tokens": count(2560), "max_new_tokens": count(1536), "do_sample": Rule(bool, False), "temperature": from_zero(float, 0.7), "top_p": Rule(float, 0.9, above=0, most=1), "num_beams": count(1), "seed": Rule(int, 42)},
        "evaluation": MODES | {"require_full_coverage": Rule(bool, True)},
    },
    "direct": {
        "data": {"test_mat": Rule(str), "test_key": Rule(str)} | SAMPLES | {"history_steps": Rule(int, 10, among=(10,)), "future_steps": Rule(int, 50, among=(50,)), "sample_rate_hz": Rule(float, 10.0, among=(10.0,))},
        "paths": {"test_prompts": Rule(str)},
        "prompt": {"context_mode": Rule(str, "target_and_neighbors", among=("target_only", "target_and_neighbors")), "trajectory_precision": from_zero(int, 2, most=8), "max_neighbors": from_zero(int, 6, most=6)},
        "llm": SERVICE | WAITS,
        "evaluation": MODES | {"require_full_coverage": Rule(bool, True)},
    },
}
#: Sections that a file must have, by kind of run; the others may be absent.
SECTIONS = {"context": tuple(RULES["context"]), "joint": ("data", "paths"), "direct": ("data", "paths")}
SPLITS = {"context": ("train", "test"), "joint": ("train", "test"), "direct": ("test",)}


def placeholder(text: str) -> bool:
    """A text in angle brackets, which stands for a value that is still to be given."""
    return text.strip().startswith("<") and text.strip().endswith(">")


def placed(name: str, path: object, root: Path) -> str:
    """A path taken from root where it is relative; placeholders and paths with a scheme stay."""
    if not isinstance(path, str) or not path.strip():
        raise ValueError(f"{name} must be a path")
    if placeholder(path) or "://" in path:
        return path.strip()
    return str((root / Path(path.strip()).expanduser()).resolve())


@dataclass(frozen=True)
class Settings:
    """Checked settings of a run: `settings["prompt"]["history_stride"]`."""

    kind: str
    sections: dict[str, dict]

    @classmethod
    def load(cls, path: str | Path, kind: str) -> Settings:
        """From a JSON file; relative paths are taken from the file's folder."""
        path = Path(path).expanduser().resolve()
        if not path.is_file():
            raise FileNotFoundError(f"no settings file: {path}")
        return cls.of(json.loads(path.read_text(encoding="utf-8")), kind, path.parent)

    @classmethod
    def of(cls, given: object, kind: str, root: Path) -> Settings:
        if kind not in RULES:
            raise ValueError(f"kind of run {kind!r} is not one of {', '.join(RULES)}")
        if not isinstance(given, dict):
            raise ValueError("settings must be a JSON object")
        if lacking := [s for s in SECTIONS[kind] if not isinstance(given.get(s), dict)]:
            raise ValueError(f"sections are missing: {', '.join(lacking)}")
        out: dict[str, dict] = copy.deepcopy(given)
        for section, rules in RULES[kind].items():
            held = given.get(section, {})
            if not isinstance(held, dict):
                raise ValueError(f"section {section} must be an object")
            out.setdefault(section, {})
            for key, rule in rules.items():
                value = held.get(key, rule.default)
                if value is NEEDED:
                    raise ValueError(f"{section}.{key} is missing")
                out[section][key] = copy.deepcopy(rule.read(f"{section}.{key}", value))
        whole(out)
        files = {k for k in PAIR if k.endswith("_mat")} & set(out["data"])
        out["data"] |= {k: placed(f"data.{k}", out["data"][k], root) for k in files}
        out["paths"] = {k: placed(f"paths.{k}", v, root) for k, v in out["paths"].items()}
        return cls(kind, out)

    def __getitem__(self, section: str) -> dict:
        return self.sections[section]

    def path(self, name: str) -> str:
        """A path of the section paths, which must not be a placeholder."""
        return actual(f"paths.{name}", self["paths"][name])

    def split(self, name: str) -> tuple[str, str]:
        """(path, key) of a split that this kind of run may read."""
        name = name.strip().lower()
        if name not in SPLITS[self.kind]:
            raise ValueError(f"a {self.kind} run reads only {' or '.join(SPLITS[self.kind])}, not {name!r}")
        return actual(f"data.{name}_mat", self["data"][f"{name}_mat"]), self["data"][f"{name}_key"]


def actual(name: str, path: str) -> str:
    if placeholder(path):
        raise ValueError(f"{name} is still a placeholder")
    return path


def whole(sections: dict[str, dict]) -> None:
    """Rules about several values together, and those of the operators that take a section."""
    roles = sections["data"]["neighbor_roles"]
    if len(roles) != 6 or len({str(r) for r in roles}) != 6:
        raise ValueError("data.neighbor_roles must name six different neighbours")
    if not all(isinstance(h, (int, float)) and not isinstance(h, bool) and h > 0 for h in sections["evaluation"]["horizons_seconds"]):
        raise ValueError("evaluation.horizons_seconds must be positive numbers")
    checks: dict[str, Callable[[dict], object]] = {"generation": generation, "llm": service, "road": lanes}
    for section, check in checks.items():
        if section in sections:
            check(sections[section])


def generation(section: dict):
    """The settings of a text generator."""
    from .runner import Generation

    s = section
    return Generation(s["batch_size"], s["max_input_tokens"], s["max_new_tokens"], s["do_sample"], s["temperature"], s["top_p"], s["num_beams"])


def service(section: dict):
    """The settings of a chat service; its model may be a placeholder until it is asked."""
    from ..sources.chat import ChatService

    return ChatService.of(section | ({"model": "any"} if placeholder(section["model"]) else {}))


def lanes(section: dict) -> dict[int, str]:
    """Places of lanes by their ids."""
    made = {int(k): str(v).strip() for k, v in section["lane_id_to_position"].items()}
    if not all(made.values()):
        raise ValueError("road.lane_id_to_position has a blank place")
    return made
