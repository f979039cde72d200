"""Action configurations (A8): limits, weights, per-token-type masks and templates.

A configuration is a few hundred bytes of JSON; it is read on the driver and its values
become literals of the augmentation expressions (so Catalyst folds them).
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

PRESET_DIR = os.path.join(os.path.dirname(os.path.dirname(__file__)), "presets")
TOKEN_TYPES = ["background_word", "slot_value", "pp_start"]


@dataclass(frozen=True)
class ActionConfig:
    config_id: str
    limits: dict
    weights: dict
    masks: dict
    templates: dict

    @classmethod
    def from_dict(cls, config_id: str, d: dict) -> "ActionConfig":
        return cls(config_id, dict(d["action_limits"]), dict(d["action_weights"]),
                   {k: dict(v) for k, v in d["action_weight_mask"].items()},
                   {k: list(v) for k, v in d["action_templates"].items()})

    @classmethod
    def load(cls, path: str, config_id: str | None = None) -> "ActionConfig":
        with open(path) as f:
            d = json.load(f)
        return cls.from_dict(config_id or os.path.splitext(os.path.basename(path))[0], d)

    @classmethod
    def preset(cls, name: str = "default") -> "ActionConfig":
        return cls.load(os.path.join(PRESET_DIR, f"{name}.json"), name)

    @property
    def actions(self) -> list[str]:
        """Action order of the sampler: template keys in byte order (`NULL` first)."""
        return sorted(self.templates)

    def limit(self, action: str) -> int:
        return int(self.limits.get(action, 1 << 30))

    @property
    def token_types(self) -> str:
        """"three" where the masks know prepositional starts, else "two"."""
        return "three" if "pp_start" in self.masks else "two"

    def mask(self, token_type: str) -> dict:
        # a token type the config has no mask for is treated as a background word
        return self.masks.get(token_type, self.masks.get("background_word", {}))

    def base_weight(self, token_type: str, action: str) -> float:
        return float(self.weights.get(action, 0)) * float(self.mask(token_type).get(action, 0))

    def can_fire(self, action: str) -> bool:
        return self.limit(action) > 0 and any(
            self.base_weight(t, action) > 0 for t in TOKEN_TYPES)

    def probabilities(self, token_type: str, used: dict | None = None) -> dict:
        """Normalised action probabilities for a token type given used counts."""
        used = used or {}
        g_used = sum(v for k, v in used.items() if k != "NULL")
        w = {}
        for a in self.actions:
            ok = used.get(a, 0) < self.limit(a)
            if a != "NULL":
                ok = ok and g_used < self.limit("GLOBAL")
            w[a] = self.base_weight(token_type, a) if ok else 0.0
        total = sum(w.values())
        return {a: (v / total if total else (1.0 if a == "NULL" else 0.0)) for a, v in w.items()}


def list_presets() -> list[str]:
    return sorted(os.path.splitext(f)[0] for f in os.listdir(PRESET_DIR) if f.endswith(".json"))
