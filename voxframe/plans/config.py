"""Run configurations: preset and overrides merged and checked."""

from __future__ import annotations

import copy
import hashlib
import json
import math

from ..operators import OPERATORS

#: The names of the 20 stages of the pipeline besides the registered operators. No result depends on their order.
STAGES = (
    "standard_protocols", "realistic_acquisition", "realistic_appearance", "tone_mapping", "donor_histogram_transfer", "realistic_bias_field", "realistic_noise", "label_synthesis", "morphology", "orientation", "resolution", "artifact_overlay",
    "mp2rage_morphology", "mp2rage_noise_superset", "mp2rage_superset", "mp2rage_lower_feature", "mp2rage_posterior_fossa", "mp2rage_target_style", "hard_artifact_tail", "saliency_adversarial",
)
TOP = {"schema_version", "description", "training", "sampling", "augmentations"}


def deep_merge(base: dict, over: dict) -> dict:
    """Dicts merge, everything else is replaced; neither input changes."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def config_hash(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def preset(disabled: tuple[str, ...] = ("donor_histogram_transfer",)) -> list[dict]:
    """All stages and operators, enabled unless named."""
    return [{"name": n, "enabled": n not in disabled, "parameters": {}} for n in (*STAGES, *OPERATORS)]


def _check_range(name: str, value) -> None:
    if not isinstance(value, list) or len(value) != 2 or any(isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v) for v in value):
        raise ValueError(f"{name} must be two finite numbers")
    if value[0] > value[1]:
        raise ValueError(f"{name} is inverted")


def validate(config: dict) -> dict:
    """The configuration if it is complete and has nothing unknown; otherwise a ValueError that says what is wrong."""
    if unknown := set(config) - TOP:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    if config.get("schema_version") != 1:
        raise ValueError("schema_version must be 1")
    entries = config.get("augmentations")
    if not isinstance(entries, list):
        raise ValueError("augmentations must be a list")
    names = [e.get("name") for e in entries]
    if len(set(names)) < len(names):
        raise ValueError("an augmentation is listed twice")
    known = {*STAGES, *OPERATORS}
    if set(names) != known:
        raise ValueError(f"missing: {sorted(known - set(names))}; unknown: {sorted(set(names) - known)}")
    for e in entries:
        if extra := set(e) - {"name", "enabled", "parameters", "severity_range", "share"}:
            raise ValueError(f"{e['name']}: unknown keys {sorted(extra)}")
        if not isinstance(e.get("enabled"), bool):
            raise ValueError(f"{e['name']}: enabled must be true or false")
        if e["enabled"] and e["name"] == "donor_histogram_transfer":
            raise ValueError("donor_histogram_transfer must stay disabled")
        if "severity_range" in e:
            _check_range(f"{e['name']}.severity_range", e["severity_range"])
        if e["name"] in OPERATORS:
            op = OPERATORS[e["name"]]
            if extra := set(e.get("parameters", {})) - set(op.parameters):
                raise ValueError(f"{e['name']}: no parameters {sorted(extra)}")
            for p, v in e.get("parameters", {}).items():
                if isinstance(op.parameters[p], bool) != isinstance(v, bool) and isinstance(op.parameters[p], bool | int | float):
                    raise ValueError(f"{e['name']}.{p}: wrong type")
    shares = [e["share"] for e in entries if e.get("enabled") and "share" in e]
    if any(isinstance(s, bool) or not isinstance(s, int | float) or not 0 <= s <= 1 for s in shares) or math.fsum(shares) > 1 + 1e-12:
        raise ValueError("shares must be numbers in [0, 1] that sum to at most 1")
    return config


def resolve(base: dict, overrides: list[dict] = ()) -> dict:
    """Overrides by name on the preset of the configuration, validated; an unknown name raises."""
    out = deep_merge({"schema_version": 1, "training": {}, "sampling": {}, "augmentations": preset()}, base)
    at = {e["name"]: k for k, e in enumerate(out["augmentations"])}
    for o in overrides:
        if o.get("name") not in at:
            raise ValueError(f"no augmentation {o.get('name')!r}")
        out["augmentations"][at[o["name"]]] = deep_merge(out["augmentations"][at[o["name"]]], o)
    return validate(out)
