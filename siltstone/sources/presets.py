"""Embedding presets: named choices of provider, model and dimension, assigned to the code and the text slot."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

from siltstone.functions.embedding import needs_new_vectors
from siltstone.operators.store import Document

from .registry import resolve_env

SLOTS = ("code", "text", "rerank")
LOCAL, CUSTOM = "local", "custom"

# Dimension and profile of the models that are known by name; a local model serves both profiles.
CATALOG = {
    "local": {"Xenova/multilingual-e5-small": (384, "text")},
    "openai": {"text-embedding-3-small": (1536, "text"), "text-embedding-3-large": (3072, "text")},
    "voyage": {
        "voyage-code-3": (1024, "code"),
        "voyage-3": (1024, "text"),
        "voyage-3-large": (1024, "text"),
        "voyage-4": (1024, "text"),
    },
}
# The model of a provider that names none, by slot.
DEFAULTS = {
    "local": {"code": "Xenova/multilingual-e5-small", "text": "Xenova/multilingual-e5-small"},
    "openai": {"code": "text-embedding-3-small", "text": "text-embedding-3-small"},
    "voyage": {"code": "voyage-code-3", "text": "voyage-4"},
}
_VARIABLE = re.compile(r"\$\{([A-Za-z_]\w*)\}")


_EMPTY: dict[str, dict] = {"preset": {}, "slot": {}}


class Presets:
    """Presets and assignments, which are few: a versioned document."""

    def __init__(self, spark: SparkSession, root: str):
        self.document = Document(spark, root)

    def _load(self) -> dict[str, dict[str, dict]]:
        return _EMPTY | self.document.load()

    def _set(self, kind: str, name: str, value: dict | None, new: bool = False) -> None:
        """Set (or, with None, forget) one preset or slot in the newest version."""

        def save(state: dict[str, dict[str, dict]]) -> dict[str, dict[str, dict]]:
            state = _EMPTY | state
            if new and name in state[kind]:
                raise ValueError(f"{kind} exists: {name}")
            rest = {k: v for k, v in state[kind].items() if k != name}
            return state | {kind: rest if value is None else rest | {name: value}}

        self.document.save(save)

    def configured(self) -> bool:
        return bool(self._load()["slot"])

    def names(self) -> list[str]:
        return sorted(self._load()["preset"])

    def assigned(self, slot: str) -> str | None:
        found = self._load()["slot"].get(slot)
        return found and found["preset"]

    def add(self, name: str, provider: str, model: str | None = None, slot: str = "code", **fields) -> dict:
        """A preset; a custom provider needs ``dim`` and ``base_url``, others are looked up in the catalog when resolved."""
        state = self._load()
        if name in state["preset"]:
            raise ValueError(f"preset exists: {name}")
        if provider != CUSTOM and provider not in CATALOG:
            raise ValueError(f"unknown provider: {provider}")
        own = {"provider": provider, "model": model or DEFAULTS.get(provider, {}).get(slot, "")} | {k: v for k, v in fields.items() if v is not None}
        self.check(own, name)
        self._set("preset", name, own, new=True)
        return own

    @staticmethod
    def check(preset: dict, name: str) -> None:
        if preset["provider"] == CUSTOM:
            for field in ("dim", "base_url"):
                if not preset.get(field):
                    raise ValueError(f"custom preset {name} needs {field}")
        elif preset["model"] not in CATALOG[preset["provider"]]:
            raise ValueError(f"unknown model of {preset['provider']}: {preset['model']}")

    def resolve(self, name: str, slot: str) -> dict:
        """provider, model, dims, profile and credentials of a preset in a slot; credentials come from the preset, or from one other."""
        presets = self._load()["preset"]
        if name not in presets:
            raise KeyError(f"unknown preset: {name}")
        p = presets[name]
        self.check(p, name)
        dims, profile = (p["dim"], slot) if p["provider"] == CUSTOM else CATALOG[p["provider"]][p["model"]]
        if p["provider"] == LOCAL:
            profile = slot
        if profile != slot:
            raise ValueError(f"preset {name} is for {profile}, not for {slot}")
        return {"provider": p["provider"], "model": p["model"], "dims": dims, "profile": profile, "base_url": p.get("base_url", ""), "credentials": resolve_env(self._credentials(presets, name)), "max_input_tokens": p.get("max_input_tokens")}

    @staticmethod
    def _credentials(presets: dict[str, dict], name: str) -> str:
        p = presets[name]
        if "credentials_from" not in p:
            return p.get("credentials", "")
        other = presets.get(p["credentials_from"])
        if other is None:
            raise KeyError(f"preset {name} takes credentials from {p['credentials_from']}, which is unknown")
        if "credentials_from" in other:
            raise ValueError(f"preset {name} takes credentials from {p['credentials_from']}, which takes them from another")
        return other.get("credentials", "")

    def assign(self, slot: str, name: str, indexed: list[dict]) -> dict:
        """Put a preset in a slot; ``indexed``: settings (provider, model, dims) that indexed sources were made with."""
        if slot not in SLOTS:
            raise ValueError(f"unknown slot: {slot}")
        state = self._load()
        if slot == "rerank":
            if name != "none" and name not in state["preset"]:
                raise KeyError(f"unknown preset: {name}")
            self._set("slot", slot, None if name == "none" else {"preset": name})
            return {"ok": True, "requires_reindex": False}
        new = self.resolve(name, slot)
        self._set("slot", slot, {"preset": name})
        return {"ok": True, "requires_reindex": any(needs_new_vectors(old, new) for old in indexed)}

    def unsearchable(self, profile: str) -> str | None:
        """Why sources of a profile cannot be searched; None where they can.  Without any assignment the built-in embedder serves."""
        state = self._load()
        if not state["slot"]:
            return None
        slot = state["slot"].get("code" if profile == "code" else "text")
        if slot is None:
            return "no preset is assigned"
        preset = state["preset"].get(slot["preset"])
        if preset is None:
            return f"unknown preset: {slot['preset']}"
        if preset["provider"] == LOCAL:
            return None
        m = _VARIABLE.fullmatch(self._credentials(state["preset"], slot["preset"]))
        return f"environment variable {m.group(1)} is not set" if m and not os.environ.get(m.group(1)) else None
